import pytest

from helixmill.__main__ import main, options
from helixmill.functions.views import create_views
from helixmill.operators.maps import phi_map
from helixmill.operators.runs import rlbwt
from helixmill.operators.suffixes import suffixes
from helixmill.sources import sinks
from helixmill.sources.sequences import from_table


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "s.fa").write_text(">a\nTGAACTCTACACAACATATTTTGTCACCAAG\n")
    (tmp_path / "q.fa").write_text(">p\nACAACATCTT\n")
    index = str(tmp_path / "index")
    assert main(["build", "--input", str(tmp_path / "s.fa"), "--index", index, "--both-strands"], spark) == 0
    assert main(["verify", "--index", index, "--check", "lf", "--check", "text_by_psi"], spark) == 0
    assert capsys.readouterr().out.count("\tok\t") == 2
    assert main(["stats", "--index", index], spark) == 0
    assert "runs\t53" in capsys.readouterr().out
    assert main(["repeats", "--index", index, "--output", str(tmp_path / "sm"), "--kind", "SM", "-L", "4"], spark) == 0
    assert spark.read.text(str(tmp_path / "sm")).count() == 1 + 6
    assert main(["match", "--index", index, "--query", str(tmp_path / "q.fa"), "--output", str(tmp_path / "ms")], spark) == 0
    assert [r.len for r in spark.read.parquet(str(tmp_path / "ms")).orderBy("i").collect()] == [7, 6, 5, 4, 3, 2, 3, 3, 2, 1]
    assert main(["minlcp", "--index", index, "--output", str(tmp_path / "m")], spark) == 0
    assert main(["extract", "--index", index, "--sequence", "1", "--last", "5"], spark) == 0
    assert "CTTGG" in capsys.readouterr().out
    found = spark.read.parquet(str(tmp_path / "ms")).collect()
    query = ["match", "--index", index, "--query", str(tmp_path / "q.fa")]
    assert main([*query, "--output", str(tmp_path / "ms2"), "--record", str(tmp_path / "choices"), "--timings"], spark) == 0
    said = capsys.readouterr().out
    assert "match: " in said and "  write: " in said
    assert "patterns\t1" in {r.value for r in spark.read.text(str(tmp_path / "choices.stats")).collect()}
    assert main([*query, "--output", str(tmp_path / "ms3"), "--rule", "replay", "--replay", str(tmp_path / "choices")], spark) == 0
    assert sorted(spark.read.parquet(str(tmp_path / "ms3")).collect()) == sorted(found)
    assert main([*query, "--output", f"file://{tmp_path}/ms4", "--rule", "order", "--files", "binary"], spark) == 0
    (path,) = (f for f in (tmp_path / "ms4").glob("*.len") if f.stat().st_size)
    assert sinks.read_matching(f"file://{path}") == [("p", [7, 6, 5, 4, 3, 2, 3, 3, 2, 1])]
    create_views(spark, index, "toy_")
    assert spark.sql("select count(*) from toy_rlbwt where ch <> '$'").first()[0] == 51


def test_wrong_options():
    for args in (["repeats", "--index", "i", "--output", "o", "--kind", "LM"], ["repeats", "--index", "i", "--output", "o", "--kind", "SM", "-L", "0"], ["match", "--index", "i"], ["match", "--index", "i", "--query", "q", "--output", "o", "--rule", "replay"], ["none"]):
        with pytest.raises(SystemExit):
            options(args)


def test_an_index_from_runs_alone(spark, tmp_path):
    table = suffixes(from_table(spark.createDataFrame([(0, "ACGTAC"), (1, "GT")], "k long, t string"), "k", "t"))
    rlbwt(table).write.parquet(str(tmp_path / "runs"))
    assert main(["build", "--input", str(tmp_path / "runs"), "--format", "runs", "--index", str(tmp_path / "index")], spark) == 0
    assert sorted(spark.read.parquet(str(tmp_path / "index" / "suffixes")).select(*table.columns).collect()) == sorted(table.collect())
    assert sorted(spark.read.parquet(str(tmp_path / "index" / "phi")).collect()) == sorted(phi_map(table).collect())
