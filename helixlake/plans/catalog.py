"""Every query of the library by name, with its oracle in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.functions import alphabet as ab
from helixlake.functions import stats
from helixlake.operators import columns, intervals
from helixlake.operators import search as ungapped
from helixlake.sources import tables
from helixlake.sources.tables import HITS_SQL, SEQS_SQL

FLAGSHIP = "search"
#: Ungapped models: a favoured residue for each position (worth 2 bits, others cost 1), and the Gumbel tail of their scores.
MODELS = [
    {"name": "stem", "consensus": "GGCAUUCGAUGC", "mu": 4.0, "lambda": 0.8},
    {"name": "loop", "consensus": "ACGUUGCAAC", "mu": 3.5, "lambda": 0.8},
    {"name": "tail", "consensus": "UUUUCCGGAAUUGC", "mu": 4.5, "lambda": 0.8},
]
REPORT, INCLUDE = 20000.0, 2000.0


def digitized(spark: SparkSession, d: str) -> DataFrame:
    codes = ab.digitize(F.col("seq"))
    return tables.sequences(spark, d).filter("len > 0").select("seq_id", F.array_join(codes, ",").alias("codes"), ab.textize(codes).alias("text"))


def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return tables.sequences(spark, d).select("seq_id", ab.reverse_complement(F.col("seq")).alias("rc"))


def composition(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    freq = {f"f_{r.lower()}": F.round(ab.frequency(seq, r), 6) for r in "ACGU"}
    return tables.sequences(spark, d).select("seq_id", F.round(ab.gc_canonical(seq), 6).alias("gc"), F.round(ab.gc_span(seq), 6).alias("gc_span"), *(v.alias(k) for k, v in freq.items()))


def null_models(spark: SparkSession, d: str) -> DataFrame:
    seq, n = F.col("seq"), F.col("len")
    bias = stats.null3(n, [ab.frequency(seq, r) for r in "ACGU"])
    return tables.sequences(spark, d).filter("len > 0").select("seq_id", F.round(stats.null1(n), 6).alias("null1"), F.round(bias, 6).alias("null3"))


def composition_bias(spark: SparkSession, d: str) -> DataFrame:
    seq = F.col("seq")
    n = F.length(F.regexp_replace(seq, "[^ACGU]", ""))
    bias = stats.composition_bias(n, [ab.frequency(seq, r) for r in "ACGU"])
    return tables.sequences(spark, d).select("seq_id", F.round(bias, 6).alias("bias"))


def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("value")
    return tables.table(spark, d, "events").select(
        "event_id",
        F.round(stats.exponential_survival(x, 20.0, 0.02), 9).alias("exp_surv"),
        F.round(stats.gumbel_cdf(x, 50.0, 0.03), 9).alias("gumbel_cdf"),
        F.round(stats.gumbel_survival(x, 50.0, 0.03), 9).alias("gumbel_surv"),
        F.round(stats.evalue(x, 20.0, 0.02, 2.0e6, 1.0e6, 500), 6).alias("evalue"),
        F.round(stats.log2_odds(x / 500.0), 6).alias("log_odds"),
    )


def windows(spark: SparkSession, d: str) -> DataFrame:
    tiles = intervals.tile(tables.sequences(spark, d), 500, 50)
    return tiles.select("seq_id", "strand", "core", "ws", "we", (F.col("we") - F.col("ws") + 1).alias("n"))


def merged_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_overlapping(tables.hits(spark, d), ["seq_id", "strand"], "lo", "hi")


def split_windows(spark: SparkSession, d: str) -> DataFrame:
    merged = intervals.merge_overlapping(tables.hits(spark, d), ["seq_id", "strand"], "lo", "hi")
    return intervals.split_long(merged, 30, "lo", "hi").select("seq_id", "strand", "lo", "hi", "piece", "piece_end")


def _ranked() -> list:
    return [F.desc("score"), F.asc("lo"), F.asc("hi"), F.asc("hit_id"), F.asc("sub_id")]


def overlap_removal(spark: SparkSession, d: str) -> DataFrame:
    return intervals.remove_overlaps(tables.hits(spark, d), ["seq_id", "strand"], _ranked(), ["lo", "hi", "score", "hit_id", "sub_id"])


def overlap_marks(spark: SparkSession, d: str) -> DataFrame:
    marked = intervals.mark_overlaps(tables.hits(spark, d), ["seq_id", "strand"], _ranked(), 64)
    return marked.select("seq_id", "strand", "rank", "hit_id", "sub_id", F.col("marked").cast("int").alias("marked"), "any_rank")


def clan_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A left join of hits with their group, -1 for those without one; here nations of a region are the models of a clan."""
    clans = tables.table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("model"), F.col("n_regionkey").alias("clan"))
    models = tables.table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq_id"), F.col("s_nationkey").alias("model"))
    found = tables.hits(spark, d).join(models, "seq_id").join(clans, "model", "left")
    return found.groupBy("model", F.coalesce("clan", F.lit(-1)).alias("clan")).agg(F.count("*").alias("n"), F.max("score").alias("best"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    cents = tables.table(spark, d, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("x"))
    return columns.histogram(cents, "event_type", "x", 1000)


def expected_bins(spark: SparkSession, d: str) -> DataFrame:
    """What a Gumbel distribution expects in each bin that holds a score, beside what was observed."""
    low, high = F.col("bin") * 10.0, F.col("bin") * 10.0 + 10.0
    total = F.sum("n").over(Window.partitionBy("event_type"))
    expected = total * (stats.gumbel_cdf(high, 50.0, 0.03) - stats.gumbel_cdf(low, 50.0, 0.03))
    return score_histogram(spark, d).select("event_type", "bin", "n", F.round(expected, 6).alias("expected"))


def binned_tail(spark: SparkSession, d: str) -> DataFrame:
    """Where each group's tail of a tenth of its scores starts, on the bins' bounds."""
    found = columns.binned_tail(score_histogram(spark, d), "event_type", 10)
    return found.select("event_type", (F.col("bin") * 10.0).alias("phi"), "n_tail", "n_below")


def tail_above(spark: SparkSession, d: str) -> DataFrame:
    """Each group's tail of scores above 400, on the bins' bounds."""
    found = columns.tail_above(score_histogram(spark, d), "event_type", 40.0)
    return found.select("event_type", (F.col("bin") * 10.0).alias("phi"), "n_tail", "n_below")


def gumbel_newton(spark: SparkSession, d: str) -> DataFrame:
    fitted = columns.gumbel_newton(tables.table(spark, d, "events"), "event_type", "value")
    return fitted.select("event_type", "n", F.round("mu", 2).alias("mu"), F.round("lambda", 5).alias("lambda"))


def score_moments(spark: SparkSession, d: str) -> DataFrame:
    found = columns.moments(tables.table(spark, d, "events"), "event_type", "value")
    return found.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


def tail_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = columns.exponential_fit(columns.tail(tables.table(spark, d, "events"), "event_type", "value", 0.1), "event_type", "value")
    return fitted.select("event_type", "n", F.round("mu", 6).alias("mu"), F.round("lambda", 6).alias("lambda"))


def gumbel_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = columns.gumbel_location(tables.table(spark, d, "events"), "event_type", "value", 0.03)
    return fitted.select("event_type", "n", F.round("mu", 6).alias("mu"))


def search(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all models on both strands: windows, diagonals, the first filter, E-values, removal of overlaps, inclusion."""
    found = ungapped.search(tables.sequences(spark, d), MODELS, report=REPORT, include=INCLUDE)
    return found.select("seq_id", "strand", "model", "lo", "hi", "score", F.round("evalue", 6).alias("evalue"), F.col("included").cast("int").alias("included"))


def emission_totals(spark: SparkSession, d: str) -> DataFrame:
    """Each sequence's residues joined with every model's emission scores: the score of each position over all of them."""
    rows = [(m["name"], k, r, 2 if r == x else -1) for m in MODELS for k, x in enumerate(m["consensus"]) for r in "ACGU"]
    profile = F.broadcast(spark.createDataFrame(rows, "model string, k int, residue string, score int"))
    counts = tables.sequences(spark, d).select("seq_id", F.explode(F.split("seq", "")).alias("residue")).groupBy("seq_id", "residue").agg(F.count("*").alias("n"))
    return counts.join(profile, "residue").groupBy("seq_id", "model").agg(F.sum(F.col("n") * F.col("score")).alias("total"), F.max("score").alias("best"))


QUERIES = {f.__name__: f for f in (digitized, reverse_complement, composition, null_models, composition_bias, score_statistics, windows, merged_windows, split_windows, overlap_removal, overlap_marks, clan_lookup, score_histogram, expected_bins, binned_tail, tail_above, score_moments, tail_fit, gumbel_fit, gumbel_newton, search, emission_totals)}

_COUNTS = f"WITH {SEQS_SQL}, c AS (SELECT *, len(seq) AS l, len(seq) - len(translate(seq, 'ACGU', '')) AS n, len(seq) - len(translate(seq, 'GC', '')) AS gc, " + ", ".join(f"len(seq) - len(translate(seq, '{r}', '')) AS n{r}" for r in "ACGU") + " FROM seqs), f AS (SELECT *, " + ", ".join(f"CASE WHEN n > 0 THEN n{r}::DOUBLE / n ELSE 0.25e0 END AS f{r}" for r in "ACGU") + " FROM c)"
_ISLANDS = f"""WITH {HITS_SQL}, m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY seq_id, strand ORDER BY lo, hi
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY seq_id, strand ORDER BY lo, hi) = 1 THEN 1 ELSE 0 END AS new FROM hits),
  g AS (SELECT *, sum(new) OVER (PARTITION BY seq_id, strand ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m),
  islands AS (SELECT seq_id, strand, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM g GROUP BY seq_id, strand, island)"""
_BINS = "WITH h AS (SELECT event_type, ceil(round(value * 100) / 1000 - 1)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL)"


def _search_sql() -> str:
    """Kadane's running sums along every diagonal, a column for each position; a row's later residues by window functions."""
    parts, longest = [], max(len(m["consensus"]) for m in MODELS)
    turn = str.maketrans("ACGU", "UGCA")
    for m in MODELS:
        n = len(m["consensus"])
        for strand, word in (("+", m["consensus"]), ("-", m["consensus"][::-1].translate(turn))):
            sums = [f"greatest(0, {f's{k - 1} + ' if k else ''}CASE WHEN c{k} = '{x}' THEN 2 ELSE -1 END) AS s{k}" for k, x in enumerate(word)]
            parts.append(f"SELECT seq_id, '{m['name']}' AS model, '{strand}' AS strand, lo, lo + {n - 1} AS hi, greatest({', '.join(f's{k}' for k in range(n))}) AS score, {m['mu']}e0 AS mu, {m['lambda']}e0 AS lam FROM (SELECT seq_id, lo, {', '.join(sums)} FROM c WHERE lo + {n - 1} <= l)")
    leads = ", ".join(f"lead(x, {k}) OVER w AS c{k}" for k in range(longest))
    return f"""WITH RECURSIVE {SEQS_SQL}, x AS (SELECT seq_id, len(seq) AS l, unnest(string_split(seq, '')) AS x, generate_subscripts(string_split(seq, ''), 1) AS lo FROM seqs WHERE len(seq) > 0),
  z AS (SELECT 2e0 * sum(len(seq)) AS z FROM seqs), c AS (SELECT seq_id, l, lo, {leads} FROM x WINDOW w AS (PARTITION BY seq_id ORDER BY lo)), h AS ({' UNION ALL '.join(parts)}),
  v AS (SELECT h.*, 1 - exp(-exp(-lam * (score - mu))) AS pvalue, z FROM h, z WHERE score >= 8),
  e AS (SELECT *, pvalue * z AS evalue FROM v WHERE pvalue <= CASE WHEN z >= 2e10 THEN 0.06e0 WHEN z >= 2e8 THEN 0.15e0 ELSE 0.35e0 END),
  r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand, model ORDER BY score DESC, lo, hi) AS rank FROM e WHERE evalue <= {REPORT}),
  k AS (SELECT seq_id, strand, model, 0::BIGINT AS rank, []::STRUCT(lo BIGINT, hi BIGINT)[] AS kept, false AS stays FROM r GROUP BY ALL
  UNION ALL SELECT k.seq_id, k.strand, k.model, r.rank, CASE WHEN f THEN list_append(k.kept, {{'lo': r.lo, 'hi': r.hi}}) ELSE k.kept END, f
  FROM k JOIN r ON k.seq_id = r.seq_id AND k.strand = r.strand AND k.model = r.model AND r.rank = k.rank + 1, LATERAL (SELECT len(list_filter(k.kept, lambda y: y.lo <= r.hi AND r.lo <= y.hi)) = 0 AS f))
  SELECT seq_id, strand, model, lo, hi, score::INT AS score, round(evalue, 6) AS evalue, (evalue <= {INCLUDE})::INT AS included FROM r JOIN k USING (seq_id, strand, model, rank) WHERE stays"""


ORACLE_SQL = {
    "digitized": f"""WITH {SEQS_SQL} SELECT seq_id, array_to_string(list_transform(string_split(seq, ''),
  lambda c: (strpos('ACGU-RYMKSWHBVDN*~', c) - 1)::VARCHAR), ',') AS codes, seq AS text FROM seqs WHERE len(seq) > 0""",
    "reverse_complement": f"WITH {SEQS_SQL} SELECT seq_id, reverse(translate(seq, 'ACGU', 'UGCA')) AS rc FROM seqs",
    "composition": _COUNTS + " SELECT seq_id, round(CASE WHEN n > 0 THEN gc::DOUBLE / n ELSE 0.5e0 END, 6) AS gc, round(CASE WHEN l > 0 THEN gc::DOUBLE / l ELSE 0e0 END, 6) AS gc_span, " + ", ".join(f"round(f{r}, 6) AS f_{r.lower()}" for r in "ACGU") + " FROM f",
    "null_models": _COUNTS + ", b AS (SELECT *, log2(1e0 / 65536) + " + " + ".join(f"CASE WHEN f{r} > 0 THEN f{r} * l * log2(f{r} / 0.25e0) ELSE 0 END" for r in "ACGU") + " AS x FROM f WHERE l > 0) SELECT seq_id, round(l * ln(l / (l + 1e0)) + ln(1e0 / (l + 1e0)), 6) AS null1, round(greatest(0e0, x) + log2(1 + pow(2e0, -abs(x))), 6) AS null3 FROM b",
    "composition_bias": _COUNTS + " SELECT seq_id, round(greatest(0e0, n * (" + " + ".join(f"CASE WHEN f{r} > 0 THEN f{r} * log2(f{r} / 0.25e0) ELSE 0e0 END" for r in "ACGU") + ")), 6) AS bias FROM f",
    "score_statistics": """SELECT event_id, round(CASE WHEN value < 20 THEN 1e0 ELSE exp(-0.02e0 * (value - 20)) END, 9) AS exp_surv,
  round(exp(-exp(-0.03e0 * (value - 50))), 9) AS gumbel_cdf, round(1 - exp(-exp(-0.03e0 * (value - 50))), 9) AS gumbel_surv,
  round(CASE WHEN value < 20 THEN 1e0 ELSE exp(-0.02e0 * (value - 20)) END * 1000e0, 6) AS evalue,
  round(CASE WHEN value > 0 THEN ln(value / 500e0 / 0.25e0) * 1.44269504e0 ELSE -1e36 END, 6) AS log_odds FROM events""",
    "windows": f"""WITH {SEQS_SQL}, t AS (SELECT seq_id, len(seq) AS l, unnest(range(1, len(seq) + 1, 500)) AS core FROM seqs WHERE len(seq) > 0)
  SELECT seq_id, strand, core::INT AS core, greatest(1, core - 50)::INT AS ws, least(l, core + 499)::INT AS we,
  (least(l, core + 499) - greatest(1, core - 50) + 1)::INT AS n FROM t, (VALUES ('+'), ('-')) AS s(strand)""",
    "merged_windows": _ISLANDS + " SELECT * FROM islands",
    "split_windows": _ISLANDS + """ SELECT seq_id, strand, lo, hi, unnest(CASE WHEN hi - lo + 1 > 60 THEN range(lo, hi - 29, 30) ELSE [lo] END) AS piece,
  CASE WHEN hi - lo + 1 > 60 THEN least(hi, piece + 59) ELSE hi END AS piece_end FROM islands""",
    "overlap_marks": f"""WITH {HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand ORDER BY score DESC, lo, hi, hit_id, sub_id)::INT AS rank FROM hits),
  p AS (SELECT seq_id, strand, rank, lo, hi, unnest(range(lo // 64, hi // 64 + 1)) AS bin FROM r),
  b AS (SELECT b.seq_id, b.strand, b.rank, min(a.rank) AS any_rank FROM p a JOIN p b ON a.seq_id = b.seq_id AND a.strand = b.strand AND a.bin = b.bin AND a.rank < b.rank
  AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL)
  SELECT seq_id, strand, rank, hit_id, sub_id, (any_rank IS NOT NULL)::INT AS marked, any_rank FROM r LEFT JOIN b USING (seq_id, strand, rank)""",
    "overlap_removal": f"""WITH RECURSIVE {HITS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand ORDER BY score DESC, lo, hi, hit_id, sub_id) AS rank FROM hits),
  k AS (SELECT seq_id, strand, 0::BIGINT AS rank, []::STRUCT(lo BIGINT, hi BIGINT)[] AS kept, false AS stays FROM r GROUP BY ALL
  UNION ALL SELECT k.seq_id, k.strand, r.rank,
    CASE WHEN len(list_filter(k.kept, lambda y: y.lo <= r.hi AND r.lo <= y.hi)) = 0 THEN list_append(k.kept, {{'lo': r.lo, 'hi': r.hi}}) ELSE k.kept END,
    len(list_filter(k.kept, lambda y: y.lo <= r.hi AND r.lo <= y.hi)) = 0
  FROM k JOIN r ON k.seq_id = r.seq_id AND k.strand = r.strand AND r.rank = k.rank + 1)
  SELECT seq_id, strand, lo, hi, score, hit_id, sub_id FROM r JOIN k USING (seq_id, strand, rank) WHERE stays""",
    "search": _search_sql(),
    "emission_totals": f"""WITH {SEQS_SQL}, p(model, k, residue, score) AS (VALUES {", ".join(f"('{m['name']}', {k}, '{r}', {2 if r == x else -1})" for m in MODELS for k, x in enumerate(m["consensus"]) for r in "ACGU")}),
  c AS (SELECT seq_id, residue, count(*) AS n FROM (SELECT seq_id, unnest(string_split(seq, '')) AS residue FROM seqs) GROUP BY ALL)
  SELECT seq_id, model, sum(n * score)::BIGINT AS total, max(score) AS best FROM c JOIN p USING (residue) GROUP BY ALL""",
    "clan_lookup": f"""WITH {HITS_SQL} SELECT s_nationkey AS model, coalesce(n_regionkey, -1) AS clan, count(*) AS n, max(score) AS best
  FROM hits JOIN supplier ON s_suppkey = seq_id LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON n_nationkey = s_nationkey GROUP BY ALL""",
    "score_histogram": "SELECT event_type, ceil(round(value * 100) / 1000 - 1)::BIGINT AS bin, count(*) AS n FROM events GROUP BY ALL",
    "expected_bins": _BINS + """ SELECT event_type, bin, n, round(sum(n) OVER (PARTITION BY event_type)
  * (exp(-exp(-0.03e0 * (bin * 10e0 + 10 - 50))) - exp(-exp(-0.03e0 * (bin * 10e0 - 50)))), 6) AS expected FROM h""",
    "binned_tail": _BINS + """, c AS (SELECT *, (sum(n) OVER (PARTITION BY event_type ORDER BY bin DESC))::BIGINT AS above,
  (sum(n) OVER (PARTITION BY event_type))::BIGINT AS total FROM h)
  SELECT event_type, max(bin) * 10e0 AS phi, min(above) AS n_tail, any_value(total) - min(above) AS n_below FROM c WHERE above * 10 >= total GROUP BY ALL""",
    "tail_above": _BINS + " SELECT event_type, 400e0 AS phi, coalesce(sum(n) FILTER (bin >= 40), 0)::BIGINT AS n_tail, coalesce(sum(n) FILTER (bin < 40), 0)::BIGINT AS n_below FROM h GROUP BY ALL",
    # Newton's method from the moments' slope, a step for each row of the recursion.
    "gumbel_newton": """WITH RECURSIVE s AS (SELECT event_type, count(*) AS n, avg(value) AS mean, pi() / sqrt(6 * var_samp(value)) AS l0, min(value) AS low FROM events GROUP BY ALL),
  k AS (SELECT event_type, l0 AS l, 0 AS i FROM s UNION ALL
    SELECT event_type, l - value / slope, i + 1 FROM (SELECT k.event_type, any_value(l) AS l, any_value(i) AS i, 1 / any_value(l) - any_value(mean) + sum(w * x) / sum(w) AS value,
      pow(sum(w * x) / sum(w), 2) - sum(w * x * x) / sum(w) - 1 / pow(any_value(l), 2) AS slope
      FROM k JOIN s USING (event_type) JOIN (SELECT event_type AS t, value AS x FROM events) e ON e.t = k.event_type, LATERAL (SELECT exp(-l * (x - low)) AS w) GROUP BY k.event_type) WHERE i < 12),
  f AS (SELECT event_type, arg_max(l, i) AS l FROM k GROUP BY ALL)
  SELECT f.event_type, count(*) AS n, round(any_value(low) - ln(avg(exp(-l * (value - low)))) / any_value(l), 2) AS mu, round(any_value(l), 5) AS lambda FROM f JOIN s USING (event_type) JOIN events USING (event_type) GROUP BY f.event_type""",
    "score_moments": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance FROM events GROUP BY ALL",
    "tail_fit": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS k,
  floor(count(*) OVER (PARTITION BY event_type) * 0.1) AS m FROM events)
  SELECT event_type, count(*) AS n, round(min(value), 6) AS mu, round(1 / (avg(value) - min(value)), 6) AS lambda FROM r WHERE k <= m GROUP BY ALL""",
    "gumbel_fit": "SELECT event_type, count(*) AS n, round(-ln(avg(exp(-0.03e0 * value))) / 0.03e0, 6) AS mu FROM events GROUP BY ALL",
}
