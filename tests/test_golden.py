"""Golden values of the toy collection and of edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from helixmill.operators import inverse, maps, matching, repeats, runs, verify, walks
from helixmill.operators.suffixes import pieces, positions, suffixes
from helixmill.plans.tables import as_of, stored

TOY = ["TGAACTCTACACAACATATTTTGTCACCAAG", "CTTGGTGACAAAATATGTTGTGTAGAGTTCA"]
BWT = "GACCACGCAGCTACAATGACTTTAACATAATA$ATTATTTGTATCGAATGC$GTGTTAGCTGTA"
SA = "31 63 62 41 42 12 2 28 43 39 10 8 13 25 3 29 55 57 44 15 46 17 61 40 11 27 9 24 14 26 6 4 32 30 1 38 56 35 53 22 36 51 58 48 7 54 45 16 60 23 5 0 37 34 52 21 50 47 59 33 20 49 19 18"
LCP = "0 0 0 1 3 2 3 2 2 1 4 3 3 2 2 1 2 2 1 4 2 2 0 2 3 3 2 3 2 1 1 2 2 0 1 2 2 1 1 2 2 3 2 3 0 2 2 3 1 3 2 1 3 2 2 3 3 3 1 2 3 4 2 3"
LEM3 = """0 0 1 5 3    0 2 0 12 3   0 8 0 10 3   0 8 0 13 3   0 8 1 7 3    0 9 0 24 3   0 10 0 13 3  0 10 1 7 4   0 11 0 27 3
0 13 1 7 3   0 15 1 12 4  0 18 0 19 3  0 20 1 1 3   0 20 1 17 4  0 21 1 15 3  0 21 1 20 3  0 23 1 28 3  0 27 1 8 3
1 1 1 17 3   1 4 1 19 3   1 9 1 10 3   1 15 1 18 3  1 15 1 20 3  1 16 1 26 3  1 18 1 20 3"""


def collection(spark, seqs):
    rows = [(i, f"s{i}", s, len(s)) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "seq_id long, name string, seq string, len long")


@pytest.fixture(scope="module")
def toy(spark):
    return suffixes(collection(spark, TOY)).cache()


def column(df, key, name):
    return [r[0] for r in df.orderBy(key).select(name).collect()]


def test_suffix_order(toy):
    assert column(toy, "sa_rank", "text_pos") == list(map(int, SA.split()))
    assert "".join(column(toy, "sa_rank", "bwt")) == BWT
    assert column(toy, "sa_rank", "lcp") == list(map(int, LCP.split()))
    assert toy.agg(F.countDistinct("run_id")).first()[0] == 53


def test_doubling_gives_the_same_rows(spark, toy):
    names = ("seq_id", "off", "text_pos", "sa_rank", "bwt", "lcp", "run_id")
    assert sorted(suffixes(collection(spark, TOY), "doubling").select(*names).collect()) == sorted(toy.select(*names).collect())


def test_run_minima(toy):
    got = [tuple(r) for r in runs.run_minima(toy).orderBy("run_id").select("loc", "min_lcp").collect()]
    want = "00 00 00 03 02 03 02 02 01 04 03 03 02 11 02 02 01 04 20 02 03 02 03 11 01 02 02 00 01 02 11 02 03 02 03 00 02 02 01 03 02 01 03 02 02 13 03 01 02 03 04 02 03".split()
    assert got == [(int(a), int(b)) for a, b in want]


def test_interval_maps(toy):
    lf = [tuple(r) for r in maps.lf_map(toy).orderBy("interval").select("dest_interval", "dest_offset", "length").limit(6).collect()]
    assert lf == [(27, 0, 1), (2, 0, 1), (18, 2, 2), (2, 1, 1), (19, 1, 1), (28, 0, 1)]
    psi = [tuple(r) for r in maps.psi_map(toy).orderBy("interval").select("dest_interval", "dest_offset", "length").limit(7).collect()]
    assert psi == [(27, 0, 1), (44, 0, 1), (1, 0, 1), (4, 0, 1), (7, 0, 1), (10, 0, 1), (11, 0, 2)]
    phi = [tuple(r) for r in maps.phi_map(toy).orderBy("interval").select("start", "dest_interval", "dest_offset", "sample").limit(4).collect()]
    assert phi == [(0, 5, 0, 1), (1, 24, 0, 1), (2, 11, 0, 3), (3, 21, 0, 2)]
    inv = [tuple(r) for r in maps.inv_phi_map(toy).orderBy("interval").select("start", "dest_interval", "dest_offset", "sample").limit(4).collect()]
    assert inv == [(0, 31, 0, 3), (2, 23, 0, 2), (4, 27, 0, 2), (5, 0, 0, 1)]
    back = {r.position: r.dest for r in maps.expanded(maps.inverted(maps.lf_map(toy))).collect()}
    assert all(back[r.dest] == r.position for r in maps.expanded(maps.lf_map(toy)).collect())


@pytest.mark.parametrize(("least", "n"), [(1, 38), (2, 38), (3, 28), (4, 6), (5, 0)])
def test_supermaximal_repeats_count(toy, least, n):
    assert repeats.supermaximal_repeats(toy, least).count() == n


def test_supermaximal_repeats(toy):
    rows = {(r.seq, r.pos): (r.len, r.occ, [tuple(o) for o in r.others]) for r in repeats.supermaximal_repeats(toy, 3).collect()}
    assert rows[0, 8] == (3, 4, [(1, 7), (0, 10), (0, 13)])
    assert rows[1, 20] == (3, 4, [(0, 21), (1, 18), (1, 15)])
    assert rows[0, 10] == (4, 2, [(1, 7)])


def test_maximal_repeats(toy):
    numbers = list(map(int, LEM3.split()))
    want = {tuple(numbers[i : i + 5]) for i in range(0, len(numbers), 5)}
    assert {tuple(r) for r in repeats.maximal_repeats(toy, 3).collect()} == want
    with pytest.raises(ValueError, match="pairs share"):
        repeats.maximal_repeats(toy, 1, most_pairs=10)
    with pytest.raises(ValueError, match="1 or more"):
        repeats.supermaximal_repeats(toy, 0)


MS = {
    "ACAACATCTT": ("7 6 5 4 3 2 3 3 2 1", "10 11 12 13 14 15 5 32 18 18"),
    "TTTTGACACCAAG": ("5 4 3 5 4 4 7 6 5 4 3 2 1", "18 19 33 37 38 8 24 25 26 27 28 57 48"),
}


def test_matching_statistics(spark, toy):
    patterns = spark.createDataFrame([(p, p) for p in MS], "name string, seq string")
    rows = matching.matching_statistics(toy, patterns).orderBy("name", "i").collect()
    for p, (lens, poss) in MS.items():
        assert [r.len for r in rows if r.name == p] == list(map(int, lens.split()))
        assert [r.pos for r in rows if r.name == p] == list(map(int, poss.split()))


@pytest.mark.parametrize("seqs", [TOY, ["", "ACGT", "ACGT", "N"]])
def test_matches_by_order_are_those_of_the_index(spark, monkeypatch, seqs):
    rows = collection(spark, seqs)
    patterns = spark.createDataFrame([(p, p) for p in MS] + [("x", "ACNGT"), ("empty", ""), ("none", None), ("lower", "zz"), ("same", "ACGT")], "name string, seq string")
    want = sorted(map(str, matching.matching_statistics(suffixes(rows), patterns, "min", "break").collect()))
    monkeypatch.setattr(matching, "BROADCAST_ROWS", 1)  # no index in one place
    assert sorted(map(str, matching.matched_by_order(rows, patterns).collect())) == want
    with pytest.raises(ValueError, match="too large"):
        matching.matching_statistics(suffixes(rows), patterns)


def test_the_walk_by_joins_is_that_over_the_index(spark, toy):
    patterns = spark.createDataFrame([(p, p) for p in MS] + [("e", ""), ("own", TOY[0][3:20]), ("bad", "ACNA")], "name string, seq string")
    want = matching.matching_statistics(toy, patterns, on_bad="break").collect()
    assert sorted(map(str, walks.walked(toy, collection(spark, TOY), patterns, "break").collect())) == sorted(map(str, want))
    with pytest.raises(ValueError, match="'N' does not occur"):
        walks.walked(toy, collection(spark, TOY), patterns.where("name = 'bad'")).collect()


def test_the_walk_by_joins_takes_rounds_by_choices_not_by_characters(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab$") for _ in range(n))
    seqs = [word(n) for n in (300, 40, 40, 1, 0)]
    seqs += [seqs[0][:150] + "b" + seqs[0][150:], seqs[1] * 2]
    patterns = [seqs[0], seqs[0][50:] + "z" + seqs[1], word(200), word(3), "$", "zz", "", None]
    rows, asked = collection(spark, seqs), spark.createDataFrame([(f"p{i}", p) for i, p in enumerate(patterns)], "name string, seq string")
    table = suffixes(rows, mode="text")
    want = sorted(map(str, matching.matching_statistics(table, asked, on_bad="break").collect()))
    tables = []

    def counted(df, name):
        tables.append(name)
        assert len(tables) <= 60, "a round per character"
        return stored(df, name)

    monkeypatch.setattr(walks, "stored", counted)
    assert sorted(map(str, walks.walked(table, rows, asked, "break", "text").collect())) == want
    tables.clear()
    monkeypatch.setattr(walks, "PIECE", 8)  # texts are compared over many pieces
    assert sorted(map(str, walks.walked(table, rows, asked, "break", "text").collect())) == want


def test_a_recorded_walk_is_replayed(spark, toy):
    patterns = spark.createDataFrame([(p, p) for p in MS] + [("e", "")], "name string, seq string")
    recorded = matching.repositionings(toy, patterns)
    want = matching.matching_statistics(toy, patterns)
    assert sorted(matching.replayed(toy, patterns, recorded).collect()) == sorted(want.collect())
    jumps = recorded.collect()
    rows = {(r.name, r.i): r for r in want.collect()}
    sa, bwt = column(toy, "sa_rank", "text_pos"), column(toy, "sa_rank", "bwt")
    rank = {p: r for r, p in enumerate(sa)}
    for p in MS:  # the walk leaves a row exactly where its character is not the wanted one
        row, expected = len(sa) - 1, []
        for i in reversed(range(len(p))):
            if bwt[row] != p[i]:
                expected.append((i, row, rank[sa[rank[rows[p, i].pos]] + 1]))
            row = rank[rows[p, i].pos]
        assert sorted((j.i, j.from_row, j.to_row) for j in jumps if j.name == p) == sorted(expected)
    total = {r.name: (r.characters, r.mismatches, r.matched, r.longest) for r in matching.counters(want, recorded).collect()}
    lens = list(map(int, MS["ACAACATCTT"][0].split()))
    assert total["ACAACATCTT"] == (10, sum(j.name == "ACAACATCTT" for j in jumps), sum(lens), max(lens))


def test_everything_from_runs(spark, toy):
    own = runs.rlbwt(toy)
    assert [(r.seq_id, r.seq) for r in inverse.sequences_of(inverse.positions_of_runs(own)).orderBy("seq_id").collect()] == list(enumerate(TOY))
    names = ("seq_id", "off", "text_pos", "sa_rank", "bwt", "lcp", "run_id")
    assert sorted(inverse.suffixes_of_runs(own).select(*names).collect()) == sorted(toy.select(*names).collect())
    found = inverse.positions_of_runs(own).cache()
    assert sorted(inverse.lf_of_runs(own, positions=found).collect()) == sorted(maps.lf_map(toy).collect())
    assert sorted(inverse.psi_of_runs(own, positions=found).collect()) == sorted(maps.psi_map(toy).collect())
    with pytest.raises(ValueError, match="invariants"):
        inverse.positions_of_runs(spark.createDataFrame([(0, "$", 2, 0)], "run_id long, ch string, run_len long, start long"))


def test_texts_of_empty_sequences_come_back(spark):
    table = suffixes(collection(spark, ["", "ANT", "", "AGT"]))
    for by in ("lf", "psi"):
        assert [r.seq for r in verify.recovered(table, by).orderBy("seq_id").collect()] == ["", "ANT", "", "AGT"]
    assert [r.seq for r in inverse.sequences_of(inverse.positions_of_runs(runs.rlbwt(table))).orderBy("seq_id").collect()] == ["", "ANT", "", "AGT"]


def test_edge_cases(spark):
    table = suffixes(collection(spark, ["CCAGA", "GAATG"]))
    assert "".join(column(table, "sa_rank", "bwt")) == "AGGGCAC$TA$A"
    rows = matching.matching_statistics(table, spark.createDataFrame([("p", "GGGAAGTT")], "name string, seq string")).orderBy("i").collect()
    assert [r.len for r in rows] == [1, 1, 3, 2, 2, 1, 1, 1] and [r.pos for r in rows] == [6, 6, 6, 7, 2, 6, 9, 9]
    unary = suffixes(collection(spark, ["AAAA", "AAA"]))
    assert column(unary, "sa_rank", "text_pos") == [4, 8, 3, 7, 2, 6, 1, 5, 0]
    assert repeats.maximal_repeats(unary, 1).count() == 11
    double = suffixes(collection(spark, ["", "ACGT", "ACGT"]))
    assert "".join(column(double, "sa_rank", "bwt")) == "$TT$$AACCGG"
    assert {tuple(r) for r in repeats.maximal_repeats(double, 1).collect()} == {(1, 0, 2, 0, 4)}
    order = suffixes(collection(spark, ["ANT", "AGT"])).orderBy("sa_rank").select("seq_id", "off").collect()
    assert list(map(tuple, order)) == [(0, 3), (1, 3), (1, 0), (0, 0), (1, 1), (0, 2), (1, 2), (0, 1)]
    with pytest.raises(Exception, match="does not occur"):
        matching.matching_statistics(double, spark.createDataFrame([("p", "x")], "name string, seq string")).collect()


def test_verify(spark, toy):
    rows = {r.check: r.ok for r in verify.verify(toy, collection(spark, TOY)).collect()}
    assert rows == dict.fromkeys(verify.CHECKS, True)
    rows = {r.check: r.ok for r in verify.verify(toy, collection(spark, [TOY[0], "A"]), ("text_by_lf", "text_by_psi")).collect()}
    assert rows == {"text_by_lf": False, "text_by_psi": False}
    # maps with two images exchanged
    good = {"lf": maps.lf_map(toy), "psi": maps.psi_map(toy), "phi": maps.phi_map(toy), "inv_phi": maps.inv_phi_map(toy)}
    swapped = F.when(F.col("interval") == 7, 9).when(F.col("interval") == 9, 7).otherwise(F.col("interval"))
    wrong = good | {k: good[k].drop("dest_interval", "dest_offset").join(good[k].select(swapped.alias("interval"), "dest_interval", "dest_offset"), "interval") for k in ("lf", "phi")}
    rows = {r.check: r.ok for r in verify.verify(toy, collection(spark, TOY), ("lf", "psi", "phi", "text_by_lf", "text_by_psi"), wrong).collect()}
    assert rows == {"lf": False, "psi": True, "phi": False, "text_by_lf": False, "text_by_psi": True}
    with pytest.raises(ValueError, match="checks"):
        verify.verify(toy, collection(spark, TOY), ("none",))


def test_cycles_of_random_permutations(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for name, n in (("one", 50), ("some", 300), ("fixed", 9), ("many", 40)):
        to = list(range(n))
        if name != "fixed":
            rng.shuffle(to)
        rows += [(name, x, y) for x, y in enumerate(to)]
        seen, want[name] = set(), 0
        for x in range(n):
            want[name] += x not in seen
            while x not in seen:
                seen.add(x)
                x = to[x]
    steps = spark.createDataFrame(rows, "name string, x long, y long")
    for small in (20, 1 << 16):  # contracted first, and not
        assert {r.name: r.cycles for r in verify.cycles(steps, small).collect()} == want


def test_as_of_is_the_last_start_at_or_before(spark):
    rng = random.Random(9)
    starts = sorted({0, *rng.sample(range(5000), 60)})
    points = [(rng.randrange(5000), k) for k in range(300)]
    found = as_of(spark.createDataFrame(points, "at long, k long"), "at", spark.createDataFrame([(s, f"v{s}") for s in starts], "s long, v string"), "s", ("v",), 5000)
    assert {r.k: (r.at, r.v) for r in found.collect()} == {k: (p, f"v{max(s for s in starts if s <= p)}") for p, k in points}


def test_pieces_of_any_size_give_the_same_positions(spark):
    rows = collection(spark, ["ACGT" * 3, "", "é\n🙂x", "G"])
    want = sorted(map(tuple, positions(rows).collect()))
    import helixmill.operators.suffixes as module

    for size in (1, 4, 5):
        cut = pieces(rows, size).collect()
        assert all(len(r.piece) <= size for r in cut) and sum(r.last for r in cut) == 4
        original, module.PIECE = module.PIECE, size
        module.pieces.__defaults__ = (size,)
        try:
            assert sorted(map(tuple, positions(rows).collect())) == want
        finally:
            module.PIECE = original
            module.pieces.__defaults__ = (original,)


def test_texts_sort_by_code_points_and_dna_has_n_last(spark):
    seqs = ["ZN", "NZ", "na"]
    for method in ("strings", "doubling"):
        table = suffixes(collection(spark, seqs), method, "text")
        order = [(r.seq_id, r.off) for r in table.orderBy("sa_rank").collect()]
        assert order == sorted(((s, o) for s, x in enumerate(seqs) for o in range(len(x) + 1)), key=lambda p: (seqs[p[0]][p[1] :], p[0]))
        back = inverse.sequences_of(inverse.positions_of_runs(runs.rlbwt(table), "text")).orderBy("seq_id").collect()
        assert [r.seq for r in back] == seqs
