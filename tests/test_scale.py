"""Plans that hold at size: what grows with the data is not broadcast, and its results are those of the plain definitions."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixlake.operators import cascade, columns, intervals, models, parses, trees
from helixlake.plans import registry
from helixlake.sources import formats, writers

SMOKE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["model_states", "tree_states", "length_bands"])
def test_states_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SMOKE))


def test_parents_by_place_are_those_of_the_connections(spark):
    nodes = trees.guide_trees(spark.createDataFrame([(1, "(<_><<_>>,)"), (2, ""), (3, "<_><_><_>")], "model long, structure string"))
    of = models.linked(nodes)
    wanted = trees.parents(trees.states(nodes)).select("model", "v", F.col("plast").alias("a"), F.col("pnum").alias("b"))
    both = of.join(wanted, ["model", "v"])
    assert both.count() == of.count() > 0 and both.filter("plast <> a or pnum <> b").count() == 0


def test_masks_with_many_runs_and_odd_lengths(spark):
    """Against each symbol by itself, over the bounds of the blocks that rows are looked at in."""
    import random

    random.seed(3)
    mask = "".join(random.choice("AC-.~9g") for _ in range(1300))
    rows = [(k, "".join(random.choice("ACgu-.N*") for _ in range(n))) for k, n in enumerate((1300, 1300, 1299, 511, 1, 1400))]
    df = spark.createDataFrame(rows, "k int, aseq string").withColumn("runs", writers.runs(F.lit(mask)))
    for gap in ("", "-"):
        found = {r.k: r.t for r in df.select("k", writers.cased(F.col("aseq"), F.col("runs"), gap).alias("t")).collect()}
        for k, text in rows:
            pairs = [(text[p] if p < len(text) else "", mask[p] if p < len(mask) else "") for p in range(max(len(text), len(mask)))]
            assert found[k] == "".join(("-" if not x.isalpha() else x.upper()) if m.isalnum() else (x.lower() if x.isalpha() else gap) for x, m in pairs)


def test_conserved_columns_meet_over_tasks(spark):
    rows = [("a", k, f"s{k}", "AcGU-A" if k % 2 else "ACgU-C") for k in range(40)] + [("b", 1, "x", "N-"), ("c", 1, "y", "--")]
    aln = spark.createDataFrame(rows, "aln_id string, idx long, name string, aseq string").repartition(7)
    assert {r.aln_id: r.same for r in writers.conserved(aln).collect()} == {"a": "ACGU  ", "b": "N ", "c": "  "}
    assert "Generate posexplode(split(" not in plan(writers.clustal(aln))


def test_rows_are_counted_and_scored_as_their_parses_are(spark):
    lines = spark.createDataFrame([(1, ",<__><<__>>", ".xxxxx.xxxxx.x."), (2, "<>", "x.x")], "model long, ss string, rf string")
    nodes = trees.guide_trees(lines.selectExpr("model", "ss structure"))
    rows = [(1, "a", "-AGAAC-GGAAC-C-"), (1, "b", "aAGANCuGGRAC.Ca"), (1, "c", "--G--C---AA--C-"), (2, "d", "GuC"), (2, "e", "Y--")]
    aln = spark.createDataFrame(rows, "model long, seq_id string, row string")
    of = parses.from_rows(aln, nodes, lines).cache()
    counts = parses.counts_of_rows(aln, nodes, lines)
    moved, emitted = parses.transition_counts(of), parses.emission_counts(of)
    told = {(r.model, r.v, r.kind, r.k): r.n for r in counts.collect()}
    assert told == {(r.model, r.v, "t", r.y): r.n for r in moved.collect()} | {(r.model, r.v, "e", r.k): r.n for r in emitted.collect()}
    fit = parses.parameters(trees.states(nodes), of)
    wanted = {r.seq_id: r for r in parses.scores(of, fit).collect()}
    found = parses.scores_of_rows(aln, nodes, lines, fit).collect()
    assert len(found) == 5
    for r in found:
        assert r.score == pytest.approx(wanted[r.seq_id].score) and r.structure == pytest.approx(wanted[r.seq_id].structure)


@pytest.mark.parametrize("name", ["parse_trees", "parse_counts", "parse_scores", "parse_bounds", "parse_inserts", "parsed_rows"])
def test_parses_are_not_broadcast(spark, name):
    assert "Broadcast" not in plan(registry.QUERIES[name](spark, SMOKE))


def test_identities_meet_as_blocks(spark):
    rows = [("a", 100, "AC-GN"), ("a", 1, "ACgG"), ("a", 2, None), ("a", 3, "--"), ("b", 200, "A")]
    found = columns.identities(spark.createDataFrame(rows, "aln_id string, seq_id long, row string"), blocks=3)
    assert {(r.s1, r.s2): r.pid for r in found.collect()} == {(100, 1): 0.75, (100, 2): 0.0, (100, 3): 0.0}


ROWS = [("a", 1, "AC..GU"), ("a", 2, "UG..CA~"), ("a", 3, "---.G-"), ("a", 3, "ACGé"), ("a", None, "ACGUG*"), ("a", 4, None), ("b", 5, "A" * 1500 + "CN-"), ("b", 6, "G" * 2100), ("c", 7, ""), ("d", 8, "N-N")]


def test_columns_are_counted_alike_in_any_number_of_tasks(spark):
    rows = spark.createDataFrame(ROWS, "aln_id string, seq_id long, row string")
    wanted = {}
    for aln in "abcd":
        texts = [(t or "").replace(".", "-").replace("_", "-") for a, _, t in ROWS if a == aln]
        for p in range(max(map(len, texts))):
            for t in texts:
                key = aln, p + 1, t[p] if p < len(t) else "-"
                wanted[key] = wanted.get(key, 0) + 1
    for n in (1, 7):
        found = columns.counts(rows.repartition(n)).collect()
        assert {(r.aln_id, r.apos, r.residue): r.n for r in found} == wanted and len(found) == len(wanted)


def test_rows_meet_their_columns(spark, monkeypatch):
    """Dealt into several tasks, with rows of one name, against the cells one by one."""
    monkeypatch.setattr(columns, "TOGETHER", 8)
    rows = spark.createDataFrame([r for r in ROWS if r[0] in "ad"], "aln_id string, seq_id long, row string")
    marks = columns.numbered_columns(rows).collect()
    assert {(r.aln_id, r.apos, r.cpos) for r in marks if r.aln_id == "a"} == {("a", p, k + 1) for k, p in enumerate(sorted(r.apos for r in marks if r.aln_id == "a"))}
    cells = {}
    for a, i, t in ROWS:
        if a in "ad":
            for p, c in enumerate((t or "").replace(".", "-")):
                cells.setdefault((a, i), []).append((p + 1, c))
    kept = {(r.aln_id, r.apos): r.cpos for r in marks}
    cut = {k: "".join(c for _, c in sorted((kept[k[0], p], c) for p, c in v if (k[0], p) in kept)) for k, v in cells.items()}
    assert {(r.aln_id, r.seq_id): r.row for r in columns.cut_down(rows, columns.consensus_columns(rows)).collect()} == {k: v for k, v in cut.items() if v}
    most = {}
    for (a, i), v in cells.items():
        of = {}
        for p, c in v:
            if (a, p) not in kept and c != "-":
                after = max((kept[a, q] for q, _ in v if (a, q) in kept and q <= p), default=0)
                of[after] = of.get(after, 0) + 1
        for k, n in of.items():
            most[a, k] = max(most.get((a, k), 0), n)
    assert most and {(r.aln_id, r.after): r.most for r in columns.insert_maxima(rows).collect()} == most
    assert sorted((r.aln_id, r.seq_id or 0) for r in columns.position_weights(rows).collect()) == sorted((a, i or 0) for a, i, _ in ROWS if a in "ad")


def test_rows_are_dealt_once(spark, monkeypatch):
    """Dealt rows have the columns and sums that rows have otherwise, also null ones, those of one name and those without an alignment; texts are read twice in all."""
    monkeypatch.setattr(columns, "TOGETHER", 8)
    rows = spark.createDataFrame([*ROWS, *ROWS[:2], ("z", 1, None), ("z", None, ""), (None, 2, "ACGU")], "aln_id string, seq_id long, row string")
    dealt, sizes = columns.dealt(rows)
    assert {r.aln_id: r.parts for r in sizes.collect()}["z"] == 2 and dealt.select("aln_id", "part").distinct().count() > sizes.count()
    of = lambda aln, *more: columns.row_sums(aln, columns.canonical_columns(aln).select("aln_id", "apos", F.col("acgu").cast("array<double>").alias("n")), ["n"], *more)
    seen = lambda df: sorted(map(str, df.collect()))
    assert seen(columns.column_table(dealt)) == seen(columns.column_table(rows))
    assert seen(of(dealt, sizes)) == seen(of(rows)) and of(rows).count() == rows.filter("aln_id is not null").count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert plan(registry.QUERIES["row_scores"](spark, SMOKE)).count("FileScan") == 2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("name", ["insert_maxima", "row_scores", "weighted_counts", "column_subset", "entropy_weights", "sequence_weights", "match_entropy", "column_posteriors", "consensus_rows", "transition_counts", "column_counts"])
def test_cells_are_no_rows(spark, name):
    assert "posexplode(split(" not in plan(registry.QUERIES[name](spark, SMOKE))


def test_regions_place_by_place():
    """Against the states one place after another, where places that end a region may reach the trigger too."""
    rng = np.random.default_rng(5)
    for k in range(200):
        m, b, e = (rng.choice([0.0, 0.05, 0.1, 0.2, 0.25, 0.6], 40) for _ in range(3))
        start, on, wanted = -1, False, []
        for j, (x, y, z) in enumerate(zip(m, b, e, strict=True), 1):
            if not on:
                start = j if x - y < 0.1 or start == -1 else start
                on = x >= 0.25
            elif x - z < 0.1:
                wanted.append((start, j))
                start, on = -1, False
        assert list(zip(*(v.tolist() for v in intervals.region_bounds(m, b, e)), strict=True)) == wanted, k


def test_bias_score_place_by_place():
    odds, stay, enter = [{"A": 1.1}, {"A": 1.6, "C": 0.4}], 0.9, 0.01
    for text in ("A", "CN", "ACCAGAAANA" * 37):
        n = len(text)
        p = n / (n + 1)
        a, b = 1 - enter, enter
        total = 0.0
        for k, c in enumerate(text):
            if k:
                a, b = a * p + b * (1 - stay), a * (1 - p) + b * stay
            a, b = a * odds[0].get(c, 1.0), b * odds[1].get(c, 1.0)
            total, a, b = total + math.log(a + b), a / (a + b), b / (a + b)
        assert models.bias_score(text, stay, enter, odds) == pytest.approx(total + n * math.log(p) + math.log(1 - p), rel=1e-12)


def test_sequences_are_scored_without_arrays_of_symbols(spark):
    for name in ("regions", "bias_null"):
        assert "aggregate(" not in plan(registry.QUERIES[name](spark, SMOKE))


def test_intervals_of_one_start_are_one_before_they_are_sorted(spark):
    rows = spark.createDataFrame([(1, 5, 9), (1, 5, 20), (1, 15, 16), (1, 21, 22), (1, None, 3), (1, None, 2), (2, 5, 5)], "g long, lo long, hi long")
    found = intervals.merge_overlapping(rows, ["g"], "lo", "hi")
    assert sorted(((r.g, r.lo, r.hi, r.n) for r in found.collect()), key=str) == sorted([(1, 5, 20, 3), (1, 21, 22, 1), (1, None, 3, 1), (1, None, 2, 1), (2, 5, 5, 1)], key=str)
    text = plan(found)
    assert text.index("HashAggregate", text.index("Window")) > 0 and "partial_max(hi" in text[text.index("Window") :]


def test_islands_come_to_tasks_one_after_another(spark):
    rows = [(g, lo, lo + n % 7, float(lo * n % 11)) for g in range(5) for n, lo in enumerate(range(1, 200, 2))]
    df = spark.createDataFrame(rows, "g long, lo long, hi long, score double")
    kept = intervals.remove_overlaps(df, ["g"], [F.desc("score"), F.asc("lo")], ["lo", "hi", "score"])
    wanted = set()
    for g in range(5):
        stays = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            if all(r[2] < s[1] or s[2] < r[1] for s in stays):
                stays.append(r)
        wanted |= set(stays)
    assert {tuple(r) for r in kept.collect()} == wanted and "FlatMapGroups" not in plan(kept)


def test_overlaps_are_looked_for_among_neighbours(spark):
    """Marks equal brute force on odd rows (no key, no place, no length, twice); rows by themselves come to no bin, and all of a plan shares one scan."""
    places = np.random.default_rng(3).integers(0, 60, (120, 2))
    made = [(None if k % 11 == 0 else k % 3, int(lo), None if k % 13 == 0 else int(lo) + int(n) % 7 * (20 if k % 17 == 0 else 1) - 1, float(k % 5), k // 2) for k, (lo, n) in enumerate(places)]
    made += [(7, 10, 12, 1.0, 200), (7, 13, 14, 2.0, 201), (7, 900, 990, 2.0, 202), (7, 14, 15, 2.0, 203), *[(8, 5, 9, 1.0, 204)] * 2, (9, -3, 3, 1.0, 205), (9, 3, 200, 1.0, 206)]
    rows = spark.createDataFrame(made, "g int, lo long, hi long, score double, id int")
    order = [F.desc("score"), F.asc("lo"), F.asc("hi"), F.asc("id")]
    ranked = {}
    for g, lo, hi, _, _ in sorted(made, key=lambda r: (-r[3], r[1], -math.inf if r[2] is None else r[2], r[4])):
        ranked.setdefault(g, []).append((lo, hi))
    wanted = []
    for g, of in ranked.items():
        better = [[] if g is None or hi is None else [j for j, (x, y) in enumerate(of[:k]) if y is not None and x <= hi and lo <= y] for k, (lo, hi) in enumerate(of)]
        wanted += [(g, k + 1, *of[k], bool(b), b[0] + 1 if b else None, next((j + 1 for j in b if not better[j]), None)) for k, b in enumerate(better)]
    found = intervals.first_overlaps(rows, ["g"], order, 16)
    assert found.columns == ["g", "rank", "lo", "hi", "score", "id", "any_rank", "marked", "win_rank"]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found.select("g", "rank", "lo", "hi", "marked", "any_rank", "win_rank").collect())
    assert any(w[5] != w[6] for w in wanted) and not intervals.first_overlaps(rows.filter("id < 0"), ["g"], order, 16).collect()
    near = intervals._binned(intervals._ranked(rows.filter("g = 7"), ["g"], order), ["g"], 16)
    assert sorted({r.lo for r in near.collect()}) == [13, 14]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stockholm_lines_are_numbered_without_sorting_them(spark):
    rows = [("x", 3, "one", "A" * 5), ("x", 1, "b", "C" * 5), ("y", 2, "u", "AC"), ("y", 1, "v", "ACGUA")]
    aln = spark.createDataFrame(rows, "aln_id string, idx long, name string, aseq string")
    notes = spark.createDataFrame([("x", "GF", None, "ID", "n\nm")], "aln_id string, kind string, name string, tag string, value string")
    lines = writers.stockholm(aln, notes, 3)
    told = {a: [r.line for r in lines.filter(F.col("aln_id") == a).orderBy("line_no").collect()] for a in "xy"}
    assert told["x"] == ["# STOCKHOLM 1.0", "#=GF ID n", "#=GF ID m", "b   CCC", "one AAA", "b   CC", "one AA", "//"]
    assert told["y"] == ["# STOCKHOLM 1.0", "v ACG", "u AC", "v UA", "//"]
    assert [r.line_no for r in lines.filter("aln_id = 'y'").orderBy("line_no").collect()] == [0, 1, 2, 3, 4]
    found, _ = formats.parse_stockholm(lines)
    assert {(r.aln_id, r.name, r.idx, r.aseq) for r in found.collect()} == {("x", "b", 0, "CCCCC"), ("x", "one", 1, "AAAAA"), ("y", "v", 0, "ACGUA"), ("y", "u", 1, "AC")}


def test_windows_of_many_sequences_are_scored_together():
    class Rows:
        select = filter = lambda self, *_: self
        mapInArrow = lambda self, scan, schema: scan

    model = [{"name": "m", "consensus": "ACGUUGCA", "mu": 2.0, "lambda": 0.7}]
    scan = cascade.filtered(Rows(), model, {"f1": 0.5, "f2": 0.5, "f3": 0.5, "f3b": 0.5}, strands=("+",))
    batch = pa.RecordBatch.from_pydict({"seq_id": list(range(40)), "seq": ["ACGUUGCAAC" * 3] * 40})
    found = list(scan(iter([batch])))
    assert len(found) == 1 and set(found[0]["seq_id"].to_pylist()) == set(range(40))


FAMILIES = [(1, ",<__><<__>>", ".xxxxx.xxxxxx."), (2, "<>", "x.x"), (3, "<>", "x.x"), (4, "", "."), (5, "<><>", None)]
MEMBERS = [(1, "a", "-AGAAC-GGAACC-"), (1, "b", "aAGANCuGGRACCa"), (1, "c", "--G--C---AAUC-"), (1, "d", "NRYKMSWBDHVUAC"), (2, "e", "GuC"), (2, "f", "Y--"), (3, "g", "GnC"), (3, "h", "--A"), (4, "i", "a"), (5, "j", "ACGU"), (5, "k", "GC"), (9, "l", "A")]


class Rows:
    """Stands for rows that come to one task in batches of three."""

    def __init__(self, rows, lines):
        of = {m: (ss, rf) for m, ss, rf in lines}
        rows = [(m, s, r, of[m][1], "=" + of[m][0]) for m, s, r in sorted(rows) if m in of and (of[m][1] is None or len(of[m][1]) == len(r))]
        schema = pa.schema([("model", pa.int64()), ("seq_id", pa.string()), ("row", pa.string()), ("rf", pa.string()), ("tree", pa.string())])
        self.batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[k : k + 3]], schema=schema) for k in range(0, len(rows), 3)]

    repartition = sortWithinPartitions = lambda self, *_: self
    mapInArrow = lambda self, f, _: [r for b in f(iter(self.batches)) for r in b.to_pylist()]


def test_scores_of_whole_families_are_those_of_their_parses(spark, monkeypatch):
    lines = spark.createDataFrame(FAMILIES, "model long, ss string, rf string")
    nodes = trees.guide_trees(lines.selectExpr("model", "ss structure"))
    aln = spark.createDataFrame(MEMBERS, "model long, seq_id string, row string")
    of = parses.from_rows(aln, nodes, lines).cache()
    wanted = {r.seq_id: (r.score, r.structure) for r in parses.scores(of, parses.parameters(trees.states(nodes), of)).collect()}
    assert set(wanted) == set("abcdefghij")
    found = {r.seq_id: (r.score, r.structure) for r in parses.fitted_scores(aln, lines).collect()}
    assert found == {k: pytest.approx(v) for k, v in wanted.items()}
    # A family that fills a task's tables is kept in a file, others stay whole.
    for rows in (1, 2, 5):
        monkeypatch.setattr(parses, "ROWS", rows)
        monkeypatch.setattr(parses, "_families", lambda aln, *_: Rows(MEMBERS, FAMILIES))
        told = parses.fitted_scores(None)
        assert len(told) == len(wanted) and {r["seq_id"]: (r["score"], r["structure"]) for r in told} == {k: pytest.approx(v) for k, v in wanted.items()}


@pytest.mark.parametrize("name", ["parse_scores", "parsed_rows"])
def test_rows_are_parsed_once_and_share_trees(spark, name):
    text = plan(registry.QUERIES[name](spark, SMOKE))
    # Once for the residues of documents, once for rows.
    assert text.count("MapInArrow") == 2 and "MapInPandas" not in text and "Window" not in text


def test_rows_of_whole_families_are_those_of_their_parses(spark, monkeypatch):
    lines = spark.createDataFrame(FAMILIES, "model long, ss string, rf string")
    nodes = trees.guide_trees(lines.selectExpr("model", "ss structure"))
    aln = spark.createDataFrame(MEMBERS, "model long, seq_id string, row string")
    of = parses.from_rows(aln, nodes, lines).cache()
    wanted = {(r.model, r.seq_id): r.row for r in parses.to_rows(of, nodes).collect()}
    for r in parses.reference_lines(of, nodes, lines).collect():
        wanted |= {(r.model, "#RF"): r.rf, (r.model, "#SS_cons"): r.ss}
    assert {(r.model, r.seq_id): r.row for r in parses.rows_given_back(aln, lines).collect()} == wanted
    for rows in (1, 2, 5):
        monkeypatch.setattr(parses, "ROWS", rows)
        monkeypatch.setattr(parses, "_families", lambda aln, *_: Rows(MEMBERS, FAMILIES))
        told = parses.rows_given_back(None)
        assert len(told) == len(wanted) and {(r["model"], r["seq_id"]): r["row"] for r in told} == wanted


def test_closing_gaps_of_psiblast_lines_are_told_by_their_number(spark):
    rows = [("a", 1, "s1", "AcG-U.é"), ("a", 2, "s22", "gu*NA-ACG"), ("a", 3, "s3", ""), ("a", 4, "s4", "ACGUACGUACG"), ("b", 7, "x", "ACG"), ("b", 9, "y", "A")]
    short = spark.createDataFrame(rows, "aln_id string, idx long, name string, aseq string").withColumn("alen", F.when(F.col("aln_id") == "a", 11).otherwise(3))
    spelled = short.select("aln_id", "idx", "name", F.expr("rpad(aseq, alen, '-')").alias("aseq"))
    wanted = {}
    for aln, idx, name, text in rows:
        mask, n = rows[0 if aln == "a" else 4][3], 11 if aln == "a" else 3
        own = [p < len(mask) and mask[p].isalnum() and mask[p].isascii() for p in range(n)]
        cased = "".join((x.upper() if o else x.lower()) if x.isascii() and x.isalpha() else "-" for x, o in zip(text.ljust(n, "-"), own, strict=True))
        wanted[aln, idx] = [name.ljust(3 if aln == "a" else 1) + "  " + cased[k : k + 4] for k in range(0, n, 4)]
    for each in (short, spelled):
        assert {(r.aln_id, r.idx): r.lines for r in writers.psiblast_rows(each, 4).collect()} == wanted
    assert {(r.idx, len(r.lines), r.rest, r.tail) for r in writers.psiblast_held(short, 4).filter("aln_id = 'a'").collect()} == {(1, 2, 1, 3), (2, 3, 0, 3), (3, 0, 3, 3), (4, 3, 0, 3)}
    assert "rpad(row" not in plan(registry.QUERIES["psiblast_lines"](spark, SMOKE))


def test_residues_of_many_texts_are_those_of_each(spark):
    from helixlake.sources import tables

    texts = ["Xylophone tie", None, "", "éßaİ\n", "JjZz", "acgut" * 50, "ﬁx K"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(1)
    wanted = {r.k: r.t for r in df.select("k", tables.residues_of(F.col("text")).alias("t")).collect()}
    assert {r.k: r.t for r in tables.with_residues(df, "text", "t").collect()} == wanted


def test_bounds_and_inserts_of_rows_are_those_of_their_parses(spark):
    lines = spark.createDataFrame(FAMILIES, "model long, ss string, rf string")
    nodes = trees.guide_trees(lines.selectExpr("model", "ss structure"))
    aln = spark.createDataFrame([*MEMBERS, (1, "none", "-" * 14), (5, "gaps", "--~-")], "model long, seq_id string, row string")
    of = parses.from_rows(aln, nodes, lines).cache()
    for whole, rows in ((parses.bounds, parses.bounds_of_rows), (parses.insert_lines, parses.insert_lines_of_rows)):
        wanted = {tuple(r) for r in whole(of).collect()}
        for told in (rows(aln, nodes, lines), rows(aln, lines=lines)):
            assert {tuple(r) for r in told.collect()} == wanted and len(wanted) == 12


@pytest.mark.parametrize("name", ["parse_trees", "parse_bounds", "parse_inserts"])
def test_parses_are_told_where_their_rows_are_made(spark, name):
    """Rows bring their structures, so that they are dealt out by part and by document and not again by family or name."""
    text = plan(registry.QUERIES[name](spark, SMOKE))
    assert text.count("SortMergeJoin") == 2 and text.index("MapInArrow") < text.index("SortMergeJoin") and "Aggregate" not in text[: text.index("SortMergeJoin")]


def test_counts_are_summed_up_where_their_family_is(spark, monkeypatch):
    text = plan(registry.QUERIES["parse_counts"](spark, SMOKE))
    assert "Aggregate" not in text[: text.index("MapInArrow")]
    lines = spark.createDataFrame(FAMILIES, "model long, ss string, rf string")
    nodes = trees.guide_trees(lines.selectExpr("model", "ss structure"))
    aln = spark.createDataFrame(MEMBERS, "model long, seq_id string, row string")
    of = parses.from_rows(aln, nodes, lines).cache()
    wanted = {(r.model, r.v, "t", r.y): r.n for r in parses.transition_counts(of).collect()} | {(r.model, r.v, "e", r.k): r.n for r in parses.emission_counts(of).collect()}
    assert {tuple(r)[:4]: r.n for r in parses.counts_of_rows(aln, lines=lines).collect()} == wanted
    for rows in (1, 2, 5):
        monkeypatch.setattr(parses, "ROWS", rows)
        monkeypatch.setattr(parses, "_families", lambda aln, *_: Rows(MEMBERS, FAMILIES))
        told = parses.counts_of_rows(None)
        assert len(told) == len(wanted) and {tuple(r.values())[:4]: r["n"] for r in told} == wanted


@pytest.mark.parametrize("width", [1, 3, 4, 7, 20])
def test_lines_of_closing_gaps_are_one(spark, width):
    rows = [("x", 3, "one", "AcG"), ("x", 1, "b", ""), ("x", 2, "z", "ACGUACGUACG"), ("y", 1, "v", "A"), ("y", 2, "u", "ACGU")]
    short = spark.createDataFrame(rows, "aln_id string, idx long, name string, aseq string").withColumn("alen", F.when(F.col("aln_id") == "x", 11).otherwise(4))
    spelled = short.select("aln_id", "idx", "name", F.expr("rpad(aseq, alen, '-')").alias("aseq"))
    notes = spark.createDataFrame([("x", "GF", None, "GA", "1 2")], "aln_id string, kind string, name string, tag string, value string")
    lines = writers.stockholm(short, notes, width)
    every = lambda df: sorted(tuple(r) for r in df.select("aln_id", "line_no", "line").collect())
    assert every(writers.every_line(lines)) == every(writers.stockholm(spelled, notes, width))
    assert lines.count() < len(every(writers.every_line(lines))) or width > 4
    read = lambda of: {tuple(r) for r in formats.parse_stockholm(of)[0].select("aln_id", "name", "idx", "aseq").collect()}
    assert read(lines) == read(writers.every_line(lines)) == {("x", "b", 0, "-" * 11), ("x", "z", 1, "ACGUACGUACG"), ("x", "one", 2, "AcG" + "-" * 8), ("y", "v", 0, "A---"), ("y", "u", 1, "ACGU")}
    assert formats.parse_stockholm(lines)[1].first().value == "1 2"


def test_no_whole_row_is_spelled_out_before_it_is_read(spark):
    assert "rpad(row" not in plan(registry.QUERIES["stockholm_round_trip"](spark, SMOKE))
