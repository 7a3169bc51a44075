import re


WORD = re.compile("[^\x20\x09-\x0d]+")


def documents(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


#: Nulls in every column, empty and very long texts, ties and repeated rows.
HARD = [
    (None, None, None, None),
    (1, "", "en", "a"),
    (2, "   \t\n", "en", "a"),
    (3, "one", None, "b"),
    (3, "one", None, "b"),
    (4, "word " * 30_000, "de", None),
    (5, "x" * 100_000, "fr", "b"),
    (6, "Ärger über\nÄrger über\nÄrger über 漢字 🙂 é", "de", "c"),
    (None, "no id here at all", "en", "c"),
    (7, "1 2 3 ### $$$ | <b>", "en", "c"),
]


def table(spark, sf_dir, name="documents"):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
