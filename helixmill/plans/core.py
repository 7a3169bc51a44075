"""The queries of the engine, over all rows and whole texts of benchmark. SQL states the same relations for DuckDB.

Most take the texts as they are; those named _dna read them as DNA, where every character but ACGTN counts as N, so that no place shifts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.functions.strings import common_prefix, decode, encode, point, reverse_complement
from helixmill.operators import inverse, maps, matching, repeats, runs, verify, walks
from helixmill.operators.suffixes import neighbours, positions, suffixes
from helixmill.plans import index_store
from helixmill.plans.registry import query
from helixmill.plans.tables import new_folder, ranked_within, stored
from helixmill.sources import sequences as seqs
from helixmill.sources import sinks

#: Least length of the repeats that are asked for.
LEAST = 6


def _sequences(spark: SparkSession, sf_dir: str, both_strands: bool = False, mode: str = "text") -> DataFrame:
    return seqs.from_table(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", mode, both_strands)


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes(_sequences(spark, sf_dir), mode="text")


def _table_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes(_sequences(spark, sf_dir, mode="dna"))


_DNA = "regexp_replace(translate(coalesce(text, ''), 'acgtn', 'ACGTN'), '(?s)[^ACGTN]', 'N', 'g')"
_SEQ = """s as (select (row_number() over (order by item_id nulls first, coalesce(text, '')) - 1)::bigint as seq_id,
  item_id::varchar as name, coalesce(text, '') as seq from benchmark),
st as materialized (select seq_id, name, seq, length(seq)::bigint as len, (sum(length(seq) + 1) over (order by seq_id) - length(seq) - 1)::bigint as start from s)"""
_SUF = f"""{_SEQ},
p as (select seq_id, o::bigint as off, (start + o)::bigint as text_pos, substr(seq, o::int + 1) as suf, case when o = 0 then '$' else substr(seq, o::int, 1) end as bwt
  from (select *, unnest(range(0, len + 1)) as o from st)),
r as (select *, (row_number() over (order by suf, seq_id) - 1)::bigint as sa_rank, lag(suf) over (order by suf, seq_id) as above, lag(bwt) over (order by suf, seq_id) as above_bwt from p),
l as (select *, coalesce(len(list_filter(range(1, least(length(suf), length(above)) + 1), lambda k: left(suf, k::int) = left(above, k::int))), 0)::bigint as lcp,
  case when bwt = '$' or above_bwt is null or above_bwt <> bwt then 1 else 0 end as head from r),
t as materialized (select seq_id, off, text_pos, suf, sa_rank, bwt, lcp, (sum(head) over (order by sa_rank) - 1)::bigint as run_id from l)"""
_RUNS = f"{_SUF},\nb as materialized (select run_id, min(bwt) as ch, count(*)::bigint as run_len, min(sa_rank)::bigint as start from t group by run_id)"
_NEAR = f"""{_SUF},
z as (select count(*) as n from t),
near as materialized (select t.text_pos, t.sa_rank, a.sa_rank as lf, b.sa_rank as psi, c.text_pos as phi, d.text_pos as inv_phi from (select t.*, z.n from t, z) t
  join t a on a.text_pos = (t.text_pos + t.n - 1) % t.n join t b on b.text_pos = (t.text_pos + 1) % t.n
  join t c on c.sa_rank = (t.sa_rank + t.n - 1) % t.n join t d on d.sa_rank = (t.sa_rank + 1) % t.n)"""


def _dna_sql(sql: str) -> str:
    """The same over the texts as DNA: N sorts behind T."""
    return sql.replace("coalesce(text, '') as seq", f"{_DNA} as seq").replace("order by suf, seq_id", "order by translate(suf, 'N', 'Z'), seq_id")


def _with(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"


@query("seq_ingest", _with(_SEQ, "select seq_id, name, seq, len from st"))
def seq_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir)


@query("seq_ingest_dna", _dna_sql(_with(_SEQ, "select seq_id, name, seq, len from st")))
def seq_ingest_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, mode="dna")


@query("seq_strands_dna", _dna_sql(_with(_SEQ, "select seq_id * 2 as seq_id, seq, len from st union all select seq_id * 2 + 1, reverse(translate(seq, 'ACGT', 'TGCA')), len from st")))
def seq_strands_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, both_strands=True, mode="dna").select("seq_id", "seq", "len")


@query("revcomp_dna", _dna_sql(_with(_SEQ, "select seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from st")))
def revcomp_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sequences(spark, sf_dir, mode="dna").select("seq_id", reverse_complement(F.col("seq")).alias("rc"))


@query("codes_dna", _dna_sql(_with(_SEQ, "select seq_id, o::bigint as off, (instr('$ACGTN', substr(seq, o::int + 1, 1)) - 1)::int as code, substr(seq, o::int + 1, 1) as letter from (select *, unnest(range(0, len)) as o from st)")))
def codes_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = positions(_sequences(spark, sf_dir, mode="dna")).where("c <> ''").select("seq_id", "off", encode(F.col("c")).alias("code"))
    return rows.withColumn("letter", decode(F.col("code")))


@query("seq_starts", _with(_SEQ, "select seq_id, start from st"))
def seq_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs.starts(_sequences(spark, sf_dir))


@query("seq_crop", _with(_SEQ, "select seq_id, substr(seq, 1, floor(len * 0.5)::int) as seq from st where seq_id < floor((select count(*) from st) * 0.5)"))
def seq_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs.cropped(_sequences(spark, sf_dir), 0.5).select("seq_id", "seq")


def _rows(name: str, columns: str):
    @query(name, _with(_SUF, f"select {columns} from t"))
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir).selectExpr(*columns.split(", "))


_rows("suffix_array", "sa_rank, seq_id, off, text_pos")
_rows("isa", "text_pos, sa_rank")
_rows("bwt", "sa_rank, bwt")
_rows("lcp_array", "sa_rank, lcp")
_rows("plcp", "text_pos, lcp")
_rows("suffixes_debug", "sa_rank, seq_id, off, text_pos, bwt, lcp, run_id")


@query("suffix_array_doubling", _with(_SUF, "select sa_rank, text_pos, lcp, run_id from t"))
def suffix_array_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes(_sequences(spark, sf_dir), "doubling", "text").select("sa_rank", "text_pos", "lcp", "run_id")


@query("suffixes_dna", _dna_sql(_with(_SUF, "select sa_rank, seq_id, off, text_pos, bwt, lcp, run_id from t")))
def suffixes_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_dna(spark, sf_dir).select("sa_rank", "seq_id", "off", "text_pos", "bwt", "lcp", "run_id")


@query("bit_widths", _with(_SUF, " union all ".join(f"select '{c}' as \"column\", greatest(1, length(ltrim(bin(max({c})), '0')))::int as bits from t" for c in ("seq_id", "off", "text_pos", "sa_rank", "lcp", "run_id"))))
def bit_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.bit_widths(_table(spark, sf_dir))


@query("rlbwt_runs", _with(_RUNS, "select run_id, ch, run_len, start from b"))
def rlbwt_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.rlbwt(_table(spark, sf_dir))


@query("rlbwt_stats", _with(_RUNS, "select ch, count(*)::bigint as runs, sum(run_len)::bigint as symbols, min(run_len)::bigint as shortest, max(run_len)::bigint as longest from b group by ch"))
def rlbwt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_statistics(runs.rlbwt(_table(spark, sf_dir)))


@query("from_rlbwt", _with(_SUF, "select sa_rank, bwt from t"))
def from_rlbwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs.from_runs(runs.rlbwt(_table(spark, sf_dir)))


_F = ", f as (select (row_number() over (order by case when ch = '$' then '' else ch end, run_id) - 1)::bigint as interval, ch, run_id, run_len as length from b)"


@query("f_column", _with(_RUNS + _F, "select interval, ch, run_id, length from f"))
def f_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.f_column(runs.rlbwt(_table(spark, sf_dir)), "text")


@query("c_array", _with(_RUNS, "select ch, symbols, coalesce(sum(symbols) over (order by case when ch = '$' then '' else ch end rows between unbounded preceding and 1 preceding), 0)::bigint as before from (select ch, sum(run_len)::bigint as symbols from b group by ch)"))
def c_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cumulative_counts(runs.rlbwt(_table(spark, sf_dir)), "text")


_MIN = "select t.run_id, max(t.sa_rank - m.top)::bigint as loc, max(t.lcp)::bigint as min_lcp from t join (select run_id, min(lcp) as low, min(sa_rank) as top from t group by run_id) m on t.run_id = m.run_id and t.lcp = m.low group by t.run_id"


@query("min_lcp_per_run", _with(_SUF, _MIN))
def min_lcp_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_minima(_table(spark, sf_dir))


@query("min_lcp_per_run_dna", _dna_sql(_with(_SUF, _MIN)))
def min_lcp_per_run_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_minima(_table_dna(spark, sf_dir))


@query("sequence_run_tops", _with(_RUNS, """select st.seq_id, st.len, coalesce(c.tops, 0)::bigint as tops, (sum(coalesce(c.tops, 0)) over (order by st.seq_id) - coalesce(c.tops, 0))::bigint as tops_before, st.start
from st left join (select t.seq_id, count(*) as tops from t join b on t.sa_rank = b.start group by t.seq_id) c on c.seq_id = st.seq_id"""))
def sequence_run_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sequence_run_tops(_table(spark, sf_dir))


def _near(name: str, at: str):
    @query(name, _with(_NEAR, f"select {at}, {name} from near"))
    def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
        return neighbours(_table(spark, sf_dir)).select(at, name)


_near("lf", "sa_rank")
_near("psi", "sa_rank")
_near("phi", "text_pos")
_near("inv_phi", "text_pos")

_TO = """select i.interval, i.start, i.length, j.interval as dest_interval, (i.dest - j.start)::bigint as dest_offset{more}
from iv i join iv j on i.dest >= j.start and i.dest < j.start + j.length"""
_LF_IV = ", iv as materialized (select b.run_id as interval, b.start, b.run_len as length, near.lf as dest from b join near on near.sa_rank = b.start)"
_RUNS_NEAR = _RUNS + _NEAR.removeprefix(_SUF)
_PSI_IV = _F + ", fs as (select interval, (sum(length) over (order by interval) - length)::bigint as start, length from f), iv as materialized (select fs.*, near.psi as dest from fs join near on near.sa_rank = fs.start)"


def _edge(side: str, name: str, shift: int) -> str:
    return f""", e as (select text_pos as start from t where sa_rank in (select {side}(sa_rank) from t group by run_id)),
ei as (select (row_number() over (order by start) - 1)::bigint as interval, start, (coalesce(lead(start) over (order by start), (select n from z)) - start)::bigint as length from e),
iv as materialized (select ei.*, near.{name} as dest, coalesce(x.lcp, 0)::bigint as sample from ei join near on near.text_pos = ei.start left join t x on x.sa_rank = near.sa_rank + {shift})"""


@query("lf_intervals", _with(_RUNS_NEAR + _LF_IV, _TO.format(more="")))
def lf_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.lf_map(_table(spark, sf_dir))


@query("psi_intervals", _with(_RUNS_NEAR + _PSI_IV, _TO.format(more="")))
def psi_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.psi_map(_table(spark, sf_dir), mode="text")


@query("phi_intervals", _with(_RUNS_NEAR + _edge("min", "phi", 0), _TO.format(more="")))
def phi_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.phi_map(_table(spark, sf_dir)).drop("sample")


@query("inv_phi_intervals", _with(_RUNS_NEAR + _edge("max", "inv_phi", 1), _TO.format(more="")))
def inv_phi_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.inv_phi_map(_table(spark, sf_dir)).drop("sample")


@query("plcp_samples", _with(_RUNS_NEAR + _edge("min", "phi", 0), "select interval, start, sample from iv"))
def plcp_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.phi_map(_table(spark, sf_dir)).select("interval", "start", "sample")


@query("plcp_below_samples", _with(_RUNS_NEAR + _edge("max", "inv_phi", 1), "select interval, start, sample from iv"))
def plcp_below_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.inv_phi_map(_table(spark, sf_dir)).select("interval", "start", "sample")


@query("lf_expanded", _with(_NEAR, "select sa_rank as position, lf as dest from near"))
def lf_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.expanded(maps.lf_map(_table(spark, sf_dir)))


@query("lf_inverted", _with(_NEAR, "select lf as position, sa_rank as dest from near"))
def lf_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.expanded(maps.inverted(maps.lf_map(_table(spark, sf_dir))))


@query("lf_inversion_orders", _with(_RUNS_NEAR + _LF_IV, """select a.at as interval, a.interval as pi, b.at as inv_pi from (select interval, (row_number() over (order by dest) - 1)::bigint as at from iv) a
join (select interval, (row_number() over (order by dest) - 1)::bigint as at from iv) b on a.at = b.interval"""))
def lf_inversion_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.permutations(maps.lf_map(_table(spark, sf_dir)))


@query("point_order", _with(_RUNS_NEAR + _LF_IV, "select interval, (row_number() over (order by dest) - 1)::bigint as place from iv"))
def point_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of intervals in the order of points: that of (interval, offset) is that of the places."""
    lf = maps.lf_map(_table(spark, sf_dir)).select(F.lit(0).alias("one"), "interval", point(F.col("dest_interval"), F.col("dest_offset")).alias("to"))
    return ranked_within(lf, "one", "place", F.col("to")).select("interval", "place")


_POINT = """select near.sa_rank, i.interval, ({to} - i.start)::bigint as "offset" from near join iv i on {to} >= i.start and {to} < i.start + i.length"""


@query("lf_move_steps", _with(_RUNS_NEAR + _LF_IV, _POINT.format(to="near.lf")))
def lf_move_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step of LF from every row, by interval and offset."""
    lf = stored(maps.lf_map(_table(spark, sf_dir)), "lf")
    points = lf.select("interval", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("offset"), "start")
    return maps.moved(lf, points.select("interval", "offset", (F.col("start") + F.col("offset")).alias("sa_rank"))).select("sa_rank", "interval", "offset")


@query("previous_points", _with(_RUNS_NEAR + _LF_IV, _POINT.format(to="((near.sa_rank + (select n from z) - 1) % (select n from z))")))
def previous_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lf = stored(maps.lf_map(_table(spark, sf_dir)), "lf")
    points = lf.select("interval", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("offset"), "start")
    return maps.previous(lf, points.select("interval", "offset", (F.col("start") + F.col("offset")).alias("sa_rank"))).select("sa_rank", "interval", "offset")


_FS = _F + ", fs as materialized (select interval, run_id, ch, (sum(length) over (order by interval) - length)::bigint as start, length from f)"
_TOPS = ", e as materialized (select (row_number() over (order by t.text_pos) - 1)::bigint as phi_interval, t.text_pos as start, coalesce(lead(t.text_pos) over (order by t.text_pos), (select count(*) from t)) as stop, t.run_id from t join b on t.sa_rank = b.start)"
_BOTTOMS = ", e as (select (row_number() over (order by t.text_pos) - 1)::bigint as inv_phi_interval, t.run_id from t join b on t.sa_rank = b.start + b.run_len - 1)"


@query("int_at_top", _with(_RUNS + _FS + _TOPS, "select fs.interval, e.phi_interval from fs join t on t.sa_rank = fs.start join e on t.text_pos >= e.start and t.text_pos < e.stop"))
def int_at_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.int_at_top(_table(spark, sf_dir), "text")


@query("int_at_end", _with(_RUNS + _FS + _TOPS, "select e.phi_interval, fs.interval from fs join t on t.sa_rank = fs.start join e on t.text_pos = e.stop - 1"))
def int_at_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.int_at_end(_table(spark, sf_dir), "text")


@query("int_at_top_by_run", _with(_RUNS + _TOPS, "select run_id, phi_interval from e"))
def int_at_top_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.int_at_top_by_run(_table(spark, sf_dir))


@query("int_at_bottom_by_run", _with(_RUNS + _BOTTOMS, "select run_id, inv_phi_interval from e"))
def int_at_bottom_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.int_at_bottom_by_run(_table(spark, sf_dir))


@query("psi_at_run_tops", _with(_RUNS + _FS, "select b.run_id, fs.interval, (b.start - fs.start)::bigint as \"offset\" from b join fs on b.start >= fs.start and b.start < fs.start + fs.length"))
def psi_at_run_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.psi_at_run_tops(_table(spark, sf_dir), "text")


@query("points_of_rows", _with(_RUNS + _FS + _TOPS, """select t.sa_rank, t.run_id, (t.sa_rank - b.start)::bigint as run_offset, fs.interval as psi_interval, (t.sa_rank - fs.start)::bigint as psi_offset, e.phi_interval, (t.text_pos - e.start)::bigint as phi_offset
from t join b on b.run_id = t.run_id join fs on t.sa_rank >= fs.start and t.sa_rank < fs.start + fs.length join e on t.text_pos >= e.start and t.text_pos < e.stop"""))
def points_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.points_of_rows(_table(spark, sf_dir), "text")


@query("plcp_of_samples", _with(_SUF, "select text_pos, lcp from t"))
def plcp_of_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    return maps.plcp_at(stored(maps.phi_map(table), "phi"), table.select("text_pos", F.col("text_pos").alias("at")), table.count())


@query("lcp_by_phi", _with(_SUF, "select sa_rank, lcp as by_phi, lcp as by_inv_phi from t"))
def lcp_by_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    near = stored(neighbours(table), "neighbours")
    return maps.lcp_by_phi(table, stored(maps.phi_map(table, near), "phi"), stored(maps.inv_phi_map(table, near), "inv_phi"))


@query("runs_of_maps", _with(_RUNS, "select run_id, ch, run_len, start from b"))
def runs_of_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    own = runs.rlbwt(table)
    f = stored(runs.f_column(own, "text").select("interval", "ch"), "f")
    return maps.runs_of_maps(stored(maps.lf_map(table), "lf"), f, maps.psi_starts(own, "text"))


# From a run-length BWT alone: the suffix order is made again from the runs.


def _runs_alone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(runs.rlbwt(_table(spark, sf_dir)), "rlbwt")


@query("text_from_runs", _with(_SEQ, "select seq_id, seq, len from st"))
def text_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.sequences_of(inverse.positions_of_runs(_runs_alone(spark, sf_dir), "text")).select("seq_id", "seq", "len")


@query("suffixes_from_runs", _with(_SUF, "select sa_rank, seq_id, off, text_pos, bwt, lcp, run_id from t"))
def suffixes_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.suffixes_of_runs(_runs_alone(spark, sf_dir), "text").select("sa_rank", "seq_id", "off", "text_pos", "bwt", "lcp", "run_id")


@query("min_lcp_from_runs", _with(_SUF, _MIN))
def min_lcp_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_minima(inverse.suffixes_of_runs(_runs_alone(spark, sf_dir), "text"))


@query("lf_from_runs", _with(_RUNS_NEAR + _LF_IV, _TO.format(more="")))
def lf_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.lf_of_runs(_runs_alone(spark, sf_dir), "text")


@query("psi_from_runs", _with(_RUNS_NEAR + _PSI_IV, _TO.format(more="")))
def psi_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverse.psi_of_runs(_runs_alone(spark, sf_dir), "text")


@query("phi_from_runs", _with(_RUNS_NEAR + _edge("min", "phi", 0), "select i.interval, i.start, i.length, j.interval as dest_interval, (i.dest - j.start)::bigint as dest_offset, i.sample from iv i join iv j on i.dest >= j.start and i.dest < j.start + j.length"))
def phi_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.phi_map(inverse.suffixes_of_runs(_runs_alone(spark, sf_dir), "text"))


@query("isa_samples", _with(_SUF, "select text_pos, sa_rank from t where text_pos % (select count(*) // count(distinct run_id) from t) = 0"))
def isa_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir)
    n, r = table.agg(F.count("*"), F.countDistinct("run_id")).first()
    return maps.isa_samples(table, n // r)


_SMEM = f"""{_SUF},
w as (select seq_id, off, k, substr(suf, 1, k::int) as sub, bwt, length(suf) as rest, suf, sa_rank from (select *, unnest(range({LEAST}, length(suf) + 1)) as k from t where length(suf) >= {LEAST})),
c as (select sub, count(*) as n from w group by sub),
x as (select w.seq_id, w.off, w.k, w.sub, c.n, w.sa_rank, case when bwt = '$' then 1 else (select n from c where c.sub = bwt || w.sub) end as on_left,
  case when rest = k then 1 else (select n from c where c.sub = substr(suf, 1, k::int + 1)) end as on_right from w join c on w.sub = c.sub where c.n > 1),
m as (select * from x where coalesce(on_left, 1) = 1 and coalesce(on_right, 1) = 1)"""


@query("smem", _with(_SMEM, "select seq_id as seq, off as pos, k::bigint as len, n::bigint as occ from m"))
def smem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.supermaximal_repeats(_table(spark, sf_dir), LEAST, others=False)


@query("smem_occurrences", _with(_SMEM, """select m.seq_id as seq, m.off as pos, m.k::bigint as len, (row_number() over (partition by m.seq_id, m.off, m.k order by w.sa_rank) - 1)::bigint as k,
  w.seq_id as other_seq, w.off as other_pos from m join w on w.sub = m.sub and w.sa_rank <> m.sa_rank"""))
def smem_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.occurrences(_table(spark, sf_dir), LEAST)


@query("smem_listed", _with(_SMEM, """select m.seq_id as seq, m.off as pos, m.k::bigint as len, m.n::bigint as occ,
  string_agg(w.seq_id::varchar || ':' || w.off::varchar, ',' order by w.sa_rank) as others from m join w on w.sub = m.sub and w.sa_rank <> m.sa_rank group by m.seq_id, m.off, m.k, m.n"""))
def smem_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.supermaximal_repeats(_table(spark, sf_dir), LEAST)
    return found.withColumn("others", F.array_join(F.transform("others", lambda o: F.concat_ws(":", o["seq"].cast("string"), o["pos"].cast("string"))), ","))


@query("smem_doubling", _with(_SMEM, "select seq_id as seq, off as pos, k::bigint as len, n::bigint as occ from m"))
def smem_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.supermaximal_repeats(suffixes(_sequences(spark, sf_dir), "doubling", "text"), LEAST, others=False)


@query("smem_dna", _dna_sql(_with(_SMEM.replace(f"range({LEAST}, ", "range(9, ").replace(f">= {LEAST})", ">= 9)"), "select seq_id as seq, off as pos, k::bigint as len, n::bigint as occ from m")))
def smem_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.supermaximal_repeats(_table_dna(spark, sf_dir), 9, others=False)


@query("lem", _with(_SUF, f"""select x.seq_id as seq1, x.off as pos1, y.seq_id as seq2, y.off as pos2,
  len(list_filter(range(1, least(length(x.suf), length(y.suf)) + 1), lambda k: left(x.suf, k::int) = left(y.suf, k::int)))::bigint as len
from t x join t y on left(x.suf, {LEAST}) = left(y.suf, {LEAST}) where length(x.suf) >= {LEAST} and length(y.suf) >= {LEAST} and x.text_pos < y.text_pos and (x.bwt = '$' or y.bwt = '$' or x.bwt <> y.bwt)"""))
def lem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.maximal_repeats(_table(spark, sf_dir), LEAST)


#: Pairs of ranks so far apart, and the cap of the comparison of texts.
_APART, _CAP = 5, 20
_LCE = "len(list_filter(range(1, least(length(x.suf), length(y.suf)) + 1), lambda k: left(x.suf, k::int) = left(y.suf, k::int)))::bigint"
_APART_SQL = f"from t x join t y on y.sa_rank = x.sa_rank + {_APART}"


@query("lce_by_rank", _with(_SUF, f'select x.sa_rank as "first", y.sa_rank as "last", {_LCE} as len {_APART_SQL} where {_LCE} >= 1'))
def lce_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common prefixes of suffixes some ranks apart, from LCPs."""
    table = _table(spark, sf_dir)
    pairs = table.select(F.col("sa_rank").alias("first"), (F.col("sa_rank") + _APART).alias("last"))
    return repeats.extensions(repeats.minima(table, 1), pairs)


@query("lce_by_text", _with(_SUF, f'select x.sa_rank as "first", y.sa_rank as "last", least({_CAP}, {_LCE})::bigint as len {_APART_SQL}'))
def lce_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by comparing texts forward, up to a cap."""
    own = _sequences(spark, sf_dir)
    rows = suffixes(own, mode="text").join(own.select("seq_id", "seq"), "seq_id").select("sa_rank", F.substring("seq", (F.col("off") + 1).cast("int"), F.lit(_CAP)).alias("part"))
    other = rows.select((F.col("sa_rank") - _APART).alias("sa_rank"), F.col("part").alias("other"))
    return rows.join(other, "sa_rank").select(F.col("sa_rank").alias("first"), (F.col("sa_rank") + _APART).alias("last"), common_prefix(F.col("part"), F.col("other"), _CAP).alias("len"))


@query("lce_dual", _with(_SUF, f'select x.sa_rank as "first", y.sa_rank as "last", {_LCE} as len {_APART_SQL}'))
def lce_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decide up to the cap, and LCPs beyond: short prefixes need no ranges, long ones no comparison."""
    near = stored(lce_by_text(spark, sf_dir), "near")
    long = near.where(F.col("len") == _CAP).select("first", "last")
    return near.where(F.col("len") < _CAP).unionByName(repeats.extensions(repeats.minima(_table(spark, sf_dir), _CAP), long))


def _matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The last quarter of the sequences are patterns, the others the collection."""
    all_rows = _sequences(spark, sf_dir)
    cut = all_rows.count() * 3 // 4
    return all_rows.where(F.col("seq_id") < cut), all_rows.where(F.col("seq_id") >= cut).select("name", "seq")


_MS = f"""{_SEQ},
cut as (select count(*) * 3 // 4 as c from st),
own as (select seq_id, seq, len, start from st, cut where seq_id < c),
pat as (select name, seq, len, unnest(range(0, len)) as i from st, cut where seq_id >= c),
k as (select name, i, seq, unnest(range(1, len - i + 1)) as n from pat),
hit as (select k.name, k.i, k.n, min(own.start + instr(own.seq, substr(k.seq, k.i::int + 1, k.n::int)) - 1) as pos from k join own on contains(own.seq, substr(k.seq, k.i::int + 1, k.n::int)) group by k.name, k.i, k.n),
best as (select name, i, max(n) as n from hit group by name, i)"""
#: The walk over the index of the first three quarters, step by step from the right end of each pattern; a character that they lack starts it anew.
_WALK = "with recursive " + _SUF.replace(_SEQ, _SEQ.replace("st as materialized (", "every as materialized (") + """,
cut as (select count(*) * 3 // 4 as c from every), st as materialized (select seq_id, name, seq, len, start from every, cut where seq_id < c),
pat as materialized (select name, seq, len from every, cut where seq_id >= c)""") + """,
top as (select max(sa_rank) as last, count(*) as n from t),
step as materialized (select t.sa_rank, a.sa_rank as lf from t, top join t a on a.text_pos = (t.text_pos + top.n - 1) % top.n),
ch as materialized (select distinct bwt as c from t where bwt <> '$'),
found as materialized (select t.sa_rank, t.lcp, t.bwt, c, max(case when t.bwt = c then t.sa_rank end) over above as up, min(case when t.bwt = c then t.sa_rank end) over below as down,
  count(case when t.bwt = c then 1 end) over above as g, count(case when t.bwt = c then 1 end) over below as h from t, ch window above as (partition by c order by t.sa_rank), below as (partition by c order by t.sa_rank desc)),
jump as materialized (select sa_rank, c, up, down, case when up is not null then min(case when bwt <> c then lcp end) over (partition by c, g order by sa_rank) end as up_lce,
  case when down is not null then min(lcp) over (partition by c, h order by sa_rank desc rows between unbounded preceding and 1 preceding) end as down_lce from found),
walk as (
  select name, len as i, last as row, 0::bigint as len, null::bigint as from_row, null::bigint as to_row, null::bigint as kept, true as known from pat, top
  union all
  select w.name, w.i - 1, case when j.c is null then top.last else s.lf end,
    case when j.c is null then 0 when j.up = w.row then w.len + 1 when j.down is null or coalesce(j.up_lce, -1) >= coalesce(j.down_lce, -1) then least(w.len, j.up_lce) + 1 else least(w.len, j.down_lce) + 1 end,
    case when j.up <> w.row or (j.up is null and j.c is not null) then w.row end,
    case when j.up <> w.row or (j.up is null and j.c is not null) then case when j.down is null or coalesce(j.up_lce, -1) >= coalesce(j.down_lce, -1) then j.up else j.down end end,
    case when j.up <> w.row or (j.up is null and j.c is not null) then case when j.down is null or coalesce(j.up_lce, -1) >= coalesce(j.down_lce, -1) then least(w.len, j.up_lce) else least(w.len, j.down_lce) end end, j.c is not null
  from walk w join pat on pat.name = w.name join top on true left join jump j on j.sa_rank = w.row and j.c = substr(pat.seq, w.i::int, 1)
  left join step s on s.sa_rank = case when j.up = w.row then w.row when j.down is null or coalesce(j.up_lce, -1) >= coalesce(j.down_lce, -1) then j.up else j.down end
  where w.i > 0)
"""


@query("ms_len", _with(_MS, "select pat.name, pat.i::bigint as i, coalesce(best.n, 0)::bigint as len from pat left join best on pat.name = best.name and pat.i = best.i"))
def ms_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    return matching.matched_by_order(own, patterns, "text").select("name", "i", "len")


@query("ms_pos_min", _with(_MS, "select pat.name, pat.i::bigint as i, coalesce(best.n, 0)::bigint as len, hit.pos::bigint as pos from pat left join best on pat.name = best.name and pat.i = best.i left join hit on hit.name = best.name and hit.i = best.i and hit.n = best.n"))
def ms_pos_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    return matching.matched_by_order(own, patterns, "text")


@query("ms_pos_min_by_index", _with(_MS, "select pat.name, pat.i::bigint as i, coalesce(best.n, 0)::bigint as len, hit.pos::bigint as pos from pat left join best on pat.name = best.name and pat.i = best.i left join hit on hit.name = best.name and hit.i = best.i and hit.n = best.n"))
def ms_pos_min_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    return matching.matching_statistics(suffixes(own, mode="text"), patterns, "min", "break")


_WALKED = _WALK + "select walk.name, walk.i::bigint as i, walk.len::bigint as len, case when walk.known then t.text_pos end::bigint as pos from walk join t on t.sa_rank = walk.row join pat on pat.name = walk.name where walk.i < pat.len"
_JUMPED = "select name, i::bigint as i, from_row::bigint as from_row, to_row::bigint as to_row, kept::bigint as len from walk where from_row is not null"


@query("ms_pos_reference", _WALKED)
def ms_pos_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    return matching.matching_statistics(suffixes(own, mode="text"), patterns, on_bad="break")


@query("ms_pos_by_joins", _WALKED)
def ms_pos_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    return walks.walked(suffixes(own, mode="text"), own, patterns, "break", "text")


@query("ms_repositionings", _WALK + _JUMPED)
def ms_repositionings(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    return matching.repositionings(suffixes(own, mode="text"), patterns, on_bad="break")


@query("ms_replayed", _WALKED)
def ms_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    table = suffixes(own, mode="text")
    return matching.replayed(table, patterns, stored(matching.repositionings(table, patterns, on_bad="break"), "choices"), on_bad="break")


@query("ms_counters", _WALK + """select w.name, count(*)::bigint as characters, count(w.from_row)::bigint as mismatches, sum(w.len)::bigint as matched, max(w.len)::bigint as longest
from walk w join pat on pat.name = w.name where w.i < pat.len group by w.name""")
def ms_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, patterns = _matched(spark, sf_dir)
    table = suffixes(own, mode="text")
    return matching.counters(matching.matching_statistics(table, patterns, on_bad="break"), matching.repositionings(table, patterns, on_bad="break"))


@query("ms_files", _with(_MS, """select pat.name, len(pat.seq)::bigint as n, sum(coalesce(best.n, 0))::bigint as total, max(coalesce(best.n, 0))::bigint as longest from pat left join best on pat.name = best.name and pat.i = best.i group by pat.name, pat.seq"""))
def ms_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary files of lengths and positions, written and read back."""
    own, patterns = _matched(spark, sf_dir)
    ms = matching.matched_by_order(own, patterns, "text")
    files = sinks.write_matching(matching.arrays(ms, patterns), new_folder(spark, "matching"))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(name, len(values), sum(values), max(values, default=0)) for path in pdf["path"] for name, values in sinks.read_matching(path)]
            yield pd.DataFrame(rows, columns=["name", "n", "total", "longest"])

    return files.where("kind = 'len'").mapInPandas(read, "name string, n long, total long, longest long")


def _doubled_sql(kind: str, at: str, rounds: int = 20) -> str:
    """Pointer doubling: least places of cycles of up to 2^rounds rows."""
    first = f"{kind}_0 as materialized (select {at} as x, {kind} as y, least({at}, {kind}) as m from near)"
    later = (f"{kind}_{k + 1} as materialized (select a.x, b.y, least(a.m, b.m) as m from {kind}_{k} a join {kind}_{k} b on a.y = b.x)" for k in range(rounds))
    return ", " + ", ".join([first, *later])


_KINDS = (("lf", "sa_rank"), ("psi", "sa_rank"), ("phi", "text_pos"), ("inv_phi", "text_pos"))
_CYCLES = "".join(_doubled_sql(k, at) for k, at in _KINDS)
_AGAIN = "(select count(*) from st left join (select seq_id, string_agg(bwt, '' order by off) as again from t where bwt <> '$' group by seq_id) x using (seq_id) where coalesce(x.again, '') <> st.seq) = 0"


@query("verify_permutations", _with(_NEAR + _CYCLES, " union all ".join([*(f"select '{k}' as \"check\", (select count(distinct m) from {k}_20) = 1 and (select count(distinct {k}) from near) = n as ok from z" for k, _ in _KINDS), *(f"select 'text_by_{k}', {_AGAIN}" for k in ("lf", "psi"))])))
def verify_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir)
    return verify.verify(suffixes(rows, mode="text"), rows).select("check", "ok")


@query("text_recover", _with(_SEQ, "select seq_id, seq from st"))
def text_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.recovered(_table(spark, sf_dir), "lf")


@query("text_recover_psi", _with(_SEQ, "select seq_id, seq from st"))
def text_recover_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.recovered(_table(spark, sf_dir), "psi")


@query("extract_sequence", _with(_SEQ, "select seq_id, substr(seq, 3, 20) as part from st where seq_id = 5"))
def extract_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.extract(_sequences(spark, sf_dir), 5, 2, 22)


@query("index_stats", _with(_RUNS, "select (select count(*) from t)::bigint as n, (select count(*) from st)::bigint as sequences, count(*)::bigint as runs, count(*) filter (ch <> '$')::bigint as runs_of_letters, max(run_len)::bigint as longest_run, (select max(lcp) from t)::bigint as longest_lcp from b"))
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.statistics(_table(spark, sf_dir))


# Files: written, read back, and held against what was written.


@query("index_rows", _with(_RUNS, " union all ".join([f"select '{k}' as relation, (select count(*) from st)::bigint as n" for k in ("sequences",)] + ["select 'suffixes', (select count(*) from t)"] + [f"select '{k}', (select count(*) from b)" for k in ("rlbwt", "run_minima", "lf", "psi", "phi", "inv_phi")])))
def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _sequences(spark, sf_dir), new_folder(spark, "index")
    index_store.save(suffixes(rows, mode="text"), rows, path, "text")
    return index_store.rows_of(spark, path)


@query("index_from_runs", _with(_RUNS_NEAR + _LF_IV, _TO.format(more="")))
def index_from_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LF of an index that was made from runs alone, stored and loaded."""
    path = new_folder(spark, "index")
    index_store.save_from_runs(_runs_alone(spark, sf_dir), path, "text")
    return index_store.load(spark, path, "lf")


@query("fasta_round_trip", _dna_sql(_with(_SEQ, "select seq_id, name, seq, len from st")))
def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "fasta")
    sinks.write_fasta(_sequences(spark, sf_dir, mode="dna"), path)
    return seqs.from_fasta(spark, path)


@query("fastq_round_trip", _dna_sql(_with(_SEQ, "select seq_id, name, seq, len from st")))
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "fastq")
    sinks.write_fastq(_sequences(spark, sf_dir, mode="dna"), path)
    return seqs.from_fastq(spark, path)


@query("lines_round_trip", _dna_sql(_with(_SEQ, "select seq_id, seq, len from st")))
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "lines")
    _sequences(spark, sf_dir, mode="dna").repartitionByRange("seq_id").sortWithinPartitions("seq_id").select("seq").write.text(path)
    return seqs.from_lines(spark, path).select("seq_id", "seq", "len")


@query("words_ingest", r"""select (row_number() over (order by item_id, k) - 1)::bigint as seq_id, w as seq, length(w)::bigint as len
from (select item_id, unnest(x) as w, unnest(range(1, len(x) + 1)) as k from (select item_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') as x from benchmark))""")
def words_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs.from_words(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text", "item_id").select("seq_id", "seq", "len")


@query("length_files", _with(_SEQ, "select name, len from st"))
def length_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "lengths")
    _sequences(spark, sf_dir).select(F.concat_ws("\t", "name", F.col("len").cast("string"))).write.text(path)
    return seqs.lengths(spark, path)


@query("run_minima_files", _with(_SUF, f"select '( ' || loc || ', ' || min_lcp || ')' as value from ({_MIN})"))
def run_minima_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "minima")
    sinks.write_run_minima(runs.run_minima(_table(spark, sf_dir)), path)
    return spark.read.text(path)


@query("smem_files", _with(_SMEM, """select 'seq' || chr(9) || 'pos' || chr(9) || 'len' || chr(9) || 'occ' as value union all
select m.seq_id || chr(9) || m.off || chr(9) || m.k || chr(9) || m.n || chr(9) || string_agg(w.seq_id || chr(9) || w.off, chr(9) order by w.sa_rank) from m join w on w.sub = m.sub and w.sa_rank <> m.sa_rank group by m.seq_id, m.off, m.k, m.n"""))
def smem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "smem")
    sinks.write_tsv(repeats.supermaximal_repeats(_table(spark, sf_dir), LEAST), path)
    return spark.read.text(path)


@query("lem_files", _with(_SUF, f"""select 'seq1' || chr(9) || 'pos1' || chr(9) || 'seq2' || chr(9) || 'pos2' || chr(9) || 'len' as value union all
select x.seq_id || chr(9) || x.off || chr(9) || y.seq_id || chr(9) || y.off || chr(9) || len(list_filter(range(1, least(length(x.suf), length(y.suf)) + 1), lambda k: left(x.suf, k::int) = left(y.suf, k::int)))
from t x join t y on left(x.suf, {LEAST}) = left(y.suf, {LEAST}) where length(x.suf) >= {LEAST} and length(y.suf) >= {LEAST} and x.text_pos < y.text_pos and (x.bwt = '$' or y.bwt = '$' or x.bwt <> y.bwt)"""))
def lem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "lem")
    sinks.write_tsv(repeats.maximal_repeats(_table(spark, sf_dir), LEAST), path)
    return spark.read.text(path)
