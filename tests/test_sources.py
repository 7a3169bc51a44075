import random

import pytest
from pyspark.sql import functions as F

from helixmill.functions import strings
from helixmill.operators import matching, repeats
from helixmill.operators.suffixes import suffixes
from helixmill.plans import index_store
from helixmill.sources import sequences, sinks
from helixmill.streaming.patterns import matched_stream, pattern_stream


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first\nACGT\nAC\n>two\n\n>three\nGG\n")
    found = sequences.from_fasta(spark, str(tmp_path / "a.fa"))
    assert [(r.seq_id, r.name, r.seq, r.len) for r in found.orderBy("seq_id").collect()] == [(0, "one", "ACGTAC", 6), (1, "two", "", 0), (2, "three", "GG", 2)]
    sinks.write_fasta(found, str(tmp_path / "out"))
    again = sequences.from_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.name, r.seq) for r in again.collect()) == [("one", "ACGTAC"), ("three", "GG"), ("two", "")]


def test_fasta_headers_may_have_the_mark_inside(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n>one A->B mutant\r\nAC\r\nGT\r\n>two>x\nG G\n>\nT")
    found = sequences.from_fasta(spark, str(tmp_path / "a.fa"))
    assert [(r.seq_id, r.name, r.seq) for r in found.orderBy("seq_id").collect()] == [(0, "one", "ACGT"), (1, "two>x", "GG"), (2, "", "T")]
    (tmp_path / "b.fa").write_text("ACGT\n>a\nA\n")
    with pytest.raises(ValueError, match="header"):
        sequences.from_fasta(spark, str(tmp_path / "b.fa")).collect()


def test_files_that_are_split_anywhere_keep_their_records(spark, tmp_path):
    rng = random.Random(1)
    made = [(f"r{i}", "".join(rng.choices("ACGTN", k=rng.randint(0, 30)))) for i in range(90)]
    for part, rows in (("1", made[:50]), ("2", made[50:])):
        (tmp_path / f"{part}.fq").write_text("".join(f"@{n} c\n{s}\n+\n{'I' * len(s)}\n" for n, s in rows))
        (tmp_path / f"{part}.fa").write_text("".join(f">{n} c\n{s[:9]}\n{s[9:]}\n" for n, s in rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        for found in (sequences.from_fastq(spark, str(tmp_path / "*.fq")), sequences.from_fasta(spark, str(tmp_path / "*.fa"))):
            assert [(r.name, r.seq) for r in found.orderBy("seq_id").collect()] == made
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "bad.fq").write_text("@a\nACG\n+\nII\n")
    with pytest.raises(ValueError, match="four lines"):
        sequences.from_fastq(spark, str(tmp_path / "bad.fq"))


def test_dna_keeps_every_place(spark):
    rows = spark.createDataFrame([(1, "acNNgt RXß\n🙂"), (2, None), (3, "")], "k long, t string")
    assert [r.seq for r in sequences.from_table(rows, "k", "t").orderBy("seq_id").collect()] == ["ACNNGTNNNNNN", "", ""]
    assert sequences.from_table(rows.where("k > 1"), "k", "t", "strict").count() == 2
    with pytest.raises(Exception, match="ACGTN"):
        sequences.from_table(rows, "k", "t", "strict").collect()
    codes = rows.limit(1).select(*(strings.encode(F.lit(c)).alias(c) for c in "$ACGTN"), strings.decode(F.lit(5)).alias("d")).first()
    assert list(codes) == [0, 1, 2, 3, 4, 5, "N"]
    with pytest.raises(Exception, match="alphabet"):
        rows.select(strings.encode(F.lit("x"))).collect()


def test_matches_as_binary_files(spark, tmp_path):
    ms = spark.createDataFrame([("p", 1, 4, 9), ("p", 0, 5, 8), ("q", 0, 0, None)], "name string, i long, len long, pos long")
    patterns = spark.createDataFrame([("p", "AC"), ("q", "G"), ("none", "")], "name string, seq string")
    files = sinks.write_matching(matching.arrays(ms, patterns), f"file://{tmp_path}/ms").collect()
    for kind, want in (("len", [("none", []), ("p", [5, 4]), ("q", [0])]), ("pos", [("none", []), ("p", [8, 9]), ("q", [0])])):
        assert sorted(x for f in files if f.kind == kind for x in sinks.read_matching(f.path)) == want


def test_lines_words_lengths_fastq(spark, tmp_path):
    (tmp_path / "l").write_text("ACGT\nGG\n")
    assert [r.seq for r in sequences.from_lines(spark, str(tmp_path / "l"), both_strands=True).orderBy("seq_id").collect()] == ["ACGT", "ACGT", "GG", "CC"]
    words = spark.createDataFrame([(" AC  GT\nA ",)], "t string")
    assert [r.seq for r in sequences.from_words(words, "t").orderBy("seq_id").collect()] == ["AC", "GT", "A"]
    (tmp_path / "n").write_text("x\t4\ny 7\n")
    assert [tuple(r) for r in sequences.lengths(spark, str(tmp_path / "n")).orderBy("name").collect()] == [("x", 4), ("y", 7)]
    (tmp_path / "q").write_text("@r1 c\nACG\n+\nIII\n@r2\nTT\n+\nII\n")
    assert [(r.name, r.seq) for r in sequences.from_fastq(spark, str(tmp_path / "q")).orderBy("seq_id").collect()] == [("r1", "ACG"), ("r2", "TT")]


def test_generated_is_repeatable(spark):
    a = sequences.generated(spark, 5, 3, 9, 1).orderBy("seq_id").collect()
    assert a == sequences.generated(spark, 5, 3, 9, 1).orderBy("seq_id").collect()
    assert len(a) == 10 and all(3 <= r.len <= 9 and set(r.seq) <= set("ACGT") for r in a)


def brute_repeats(seqs, least):
    """Maximal pairs by comparing all positions."""
    at = [(s, i) for s, x in enumerate(seqs) for i in range(len(x))]
    out = set()
    for p, (s, i) in enumerate(at):
        for t, j in at[p + 1 :]:
            n = 0
            while i + n < len(seqs[s]) and j + n < len(seqs[t]) and seqs[s][i + n] == seqs[t][j + n]:
                n += 1
            if n >= least and (not i or not j or seqs[s][i - 1] != seqs[t][j - 1]):
                out.add((s, i, t, j, n))
    return out


def test_repeats_equal_brute_force_on_random_collections(spark):
    rng = random.Random(5)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(0, 40))) for _ in range(8)]
    rows = spark.createDataFrame([(i, str(i), s, len(s)) for i, s in enumerate(seqs)], "seq_id long, name string, seq string, len long")
    assert {tuple(r) for r in repeats.maximal_repeats(suffixes(rows), 3).collect()} == brute_repeats(seqs, 3)


def brute_supermaximal(seqs, least):
    """(seq, pos, len, others) by comparing all positions."""
    at = [(s, i) for s, x in enumerate(seqs) for i in range(len(x))]
    of = {(s, i): max([0] + [common(seqs[s][i:], seqs[t][j:]) for t, j in at if (t, j) != (s, i)]) for s, i in at}
    out = set()
    for (s, i), n in of.items():
        if n >= least and (not i or of[s, i - 1] <= n):
            part = seqs[s][i : i + n]
            out.add((s, i, n, frozenset((t, j) for t, j in at if (t, j) != (s, i) and seqs[t].startswith(part, j))))
    return out


def common(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_repeats_of_a_doubled_table_equal_brute_force(spark):
    rng = random.Random(6)
    seqs = ["".join(rng.choices("ACGT", k=rng.randint(0, 40))) for _ in range(5)] + ["A" * 9, "", "ACGTACGTACGT", "ACGTACGTACGT"]
    rows = spark.createDataFrame([(i, str(i), s, len(s)) for i, s in enumerate(seqs)], "seq_id long, name string, seq string, len long")
    doubled = suffixes(rows, "doubling").cache()
    whole = doubled.where("lcp >= 1").selectExpr("sa_rank", "lcp as l")
    lcp = [r.lcp for r in doubled.orderBy("sa_rank").collect()]
    for block in (3, 16, 1 << 16):  # ranges over many blocks, over some, and in one
        for r in repeats.extents(doubled, whole, block).collect():
            lo, hi = r.sa_rank, r.sa_rank
            while lcp[lo] >= r.l:
                lo -= 1
            while hi + 1 < len(lcp) and lcp[hi + 1] >= r.l:
                hi += 1
            assert (r.lo, r.hi) == (lo, hi)
    assert {tuple(r) for r in repeats.maximal_repeats(doubled, 3).collect()} == brute_repeats(seqs, 3)
    found = repeats.supermaximal_repeats(doubled, 3).collect()
    assert {(r.seq, r.pos, r.len, frozenset(map(tuple, r.others))) for r in found} == brute_supermaximal(seqs, 3)
    assert sorted(found) == sorted(repeats.supermaximal_repeats(suffixes(rows, "strings"), 3).collect())


def test_store_and_sinks(spark, tmp_path):
    rows = sequences.generated(spark, 3, 5, 12, 4)
    table = suffixes(rows).cache()
    index_store.save(table, rows, str(tmp_path / "index"))
    assert index_store.load(spark, str(tmp_path / "index"), "suffixes").count() == table.count()
    minima = index_store.load(spark, str(tmp_path / "index"), "run_minima")
    sinks.write_run_minima(minima, str(tmp_path / "rlcp"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "rlcp")).collect()]
    assert sorted(lines) == sorted(f"( {r.loc}, {r.min_lcp})" for r in minima.collect())
    sizes = {r.relation: r.bytes for r in index_store.sizes(spark, str(tmp_path / "index")).collect()}
    assert set(sizes) == set(index_store.RELATIONS) and all(sizes.values())
    found = repeats.supermaximal_repeats(table, 2)
    sinks.write_tsv(found, str(tmp_path / "sm"))
    header, *lines = [x for f in sorted((tmp_path / "sm").glob("part-*")) for x in f.read_text().splitlines()]
    assert header == "seq\tpos\tlen\tocc"
    assert sorted(lines) == sorted("\t".join(map(str, [r.seq, r.pos, r.len, r.occ, *(x for o in r.others for x in o)])) for r in found.collect())


def test_streamed_patterns(spark, tmp_path):
    rows = sequences.generated(spark, 4, 20, 30, 9)
    table = suffixes(rows)
    patterns = spark.createDataFrame([("p", "ACGTACGT"), ("q", "TTTNA")], "name string, seq string")
    patterns.write.parquet(str(tmp_path / "in"))
    matched_stream(table, pattern_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    from helixmill.operators.matching import matching_statistics

    want = matching_statistics(table, patterns, on_bad="break").collect()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, want))
