"""Queries over windows, hits, their order and their accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.operators import intervals
from helixlake.sources import tables
from helixlake.sources.tables import HITS_SQL, SEQS_SQL

KEYS = ["seq_id", "strand"]
#: Probabilities of each symbol, of being inside, of just having entered and of just leaving, that the region query uses.
INSIDE = {"G": (0.9, 0.0, 0.0), "C": (0.5, 0.45, 0.0), "A": (0.15, 0.1, 0.0), "U": (0.2, 0.0, 0.15)}
OTHER = (0.22, 0.0, 0.05)


def tiles_2w(spark: SparkSession, d: str) -> DataFrame:
    return intervals.double_tiles(tables.sequences(spark, d), 40).select("seq_id", "ws", "we")


def extended_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hits as raw windows of a model of twelve positions, widened by the lengths expected before and after them."""
    lengths = spark.range(1, 13).select(F.col("id").cast("int").alias("k"), (F.col("id") / 24.0).alias("prefix"), ((13 - F.col("id")) / 24.0).alias("suffix"))
    raw = tables.hits(spark, d).select("hit_id", "sub_id", "seq_id", F.col("lo").alias("start"), (F.col("hi") - F.col("lo") + 1).alias("n"), (F.col("lo") % 12 + 1).cast("int").alias("first"), (F.col("hi") % 12 + 1).cast("int").alias("last"), F.lit(2040).alias("len"))
    found = intervals.extend(raw, lengths, 120)
    return found.groupBy("seq_id", "ws", "we").agg(F.count("*").alias("n"))


def merged_by_share(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_by_share(tables.hits(spark, d), KEYS, "lo", "hi", 0.5)


def merged_survivors(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge_survivors(tables.hits(spark, d), KEYS, "lo", "hi", "score", "hit_id")


def residue_tally(spark: SparkSession, d: str) -> DataFrame:
    return intervals.tally(tables.hits(spark, d), KEYS, "lo", "hi", "hit_id")


def record_scores(spark: SparkSession, d: str) -> DataFrame:
    """For each end point, from the nearest start on, the hits that beat all with nearer starts."""
    hits = tables.hits(spark, d).groupBy("seq_id", "strand", "hi", "lo").agg(F.max("score").alias("score")).withColumn("d", F.col("hi") - F.col("lo") + 1)
    return intervals.record_scores(hits, [*KEYS, "hi"], "d", "score", 2000.0).select("seq_id", "strand", "lo", "hi", "score")


def regions(spark: SparkSession, d: str) -> DataFrame:
    return intervals.regions(tables.sequences(spark, d).filter("len > 0"), INSIDE, OTHER)


def running_composition(spark: SparkSession, d: str) -> DataFrame:
    """G and C up to every hundredth place of a sequence, from which the composition of any span is a difference."""
    cells = tables.sequences(spark, d).select("seq_id", F.posexplode(F.split("seq", "")).alias("p", "c")).filter("c <> ''")
    blocks = cells.groupBy("seq_id", F.expr("p div 100").alias("block")).agg(F.count("*").alias("n"), F.sum(F.col("c").isin("G", "C").cast("long")).alias("gc"))
    up = Window.partitionBy("seq_id").orderBy("block")
    return blocks.select("seq_id", "block", F.sum("n").over(up).alias("n"), F.sum("gc").over(up).alias("gc"))


def ranked_values(spark: SparkSession, d: str) -> DataFrame:
    """The 10th and 100th highest value of each group, from a histogram of distinct values."""
    counts = tables.table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    above = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("event_type").orderBy(F.desc("value"))))
    return above.groupBy("event_type").agg(*(F.max(F.when(F.col("upto") >= k, F.col("value"))).alias(f"rank_{k}") for k in (10, 100)))


def band_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of each event type's histogram of values the bounds within which all but a share of either tail lies."""
    bins = tables.table(spark, d, "events").groupBy("event_type", F.floor("value").cast("long").alias("x")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("event_type")
    summed = bins.withColumns({"up": F.sum("n").over(by.orderBy("x")), "down": F.sum("n").over(by.orderBy(F.desc("x"))), "all": F.sum("n").over(by)})
    beta = F.col("all") * 0.01
    return summed.groupBy("event_type").agg(F.min(F.when(F.col("up") > beta, F.col("x"))).alias("dmin"), F.max(F.when(F.col("down") > beta, F.col("x"))).alias("dmax"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Hits with a model, a pass and an E-value."""
    return tables.hits(spark, d).select("*", (F.col("lo") % 7).alias("model"), (F.col("hi") % 5 + 1).cast("int").alias("pass_idx"), (1.0e6 / F.col("score")).alias("evalue"))


def hit_order(spark: SparkSession, d: str) -> DataFrame:
    """Each sequence's hits on the chosen strand in the order of a report: E-value, score, start, pass, stop."""
    top = _scored(spark, d).filter("strand = '+'")
    order = Window.partitionBy("seq_id").orderBy("evalue", F.desc("score"), "lo", F.desc("pass_idx"), "hi", "hit_id", "sub_id")
    return top.select("seq_id", F.row_number().over(order).alias("idx"), "lo", "hi", "pass_idx", F.round("evalue", 6).alias("evalue"))


def scan_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits of several models, marked where a better one of the same clan overlaps: with the best such, and the best unmarked one."""
    clans = spark.range(7).select(F.col("id").alias("model"), F.when(F.col("id") < 6, F.col("id") % 3).otherwise(-1).alias("clan"))
    hits = _scored(spark, d).join(F.broadcast(clans), "model")
    order = [F.asc("evalue"), F.desc("score"), F.asc("lo"), F.asc("model"), F.asc("hi"), F.asc("hit_id"), F.asc("sub_id")]
    marked = intervals.first_overlaps(hits.filter("clan >= 0"), ["seq_id", "strand", "clan"], order, 64)
    return marked.select("seq_id", "strand", "clan", "rank", "model", "hit_id", "sub_id", F.col("marked").cast("int").alias("marked"), "any_rank", "win_rank")


def union_of_passes(spark: SparkSession, d: str) -> DataFrame:
    """Hits of all passes together, without those that overlap a better one."""
    hits = _scored(spark, d)
    passes = hits.filter("pass_idx between 1 and 5")
    order = [F.desc("score"), F.asc("lo"), F.asc("hi"), F.asc("hit_id"), F.asc("sub_id")]
    return intervals.remove_overlaps(passes, KEYS, order, ["lo", "hi", "score", "pass_idx", "hit_id", "sub_id"]).groupBy("pass_idx").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("score"))


def pass_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Hits and residues that each filter lets through, by pass and over all passes (null)."""
    hits = _scored(spark, d).select("pass_idx", (F.col("hi") - F.col("lo") + 1).alias("n"), "evalue")
    past = lambda e: F.col("evalue") <= e
    stages = [(f"f{k}", past(e)) for k, e in ((1, 500.0), (3, 50.0), (5, 20.0))]
    sums = [x for name, c in stages for x in (F.sum(c.cast("long")).alias(f"n_{name}"), F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"res_{name}"))]
    return hits.rollup("pass_idx").agg(F.count("*").alias("n"), *sums)


QUERIES = {f.__name__: f for f in (tiles_2w, extended_windows, merged_by_share, merged_survivors, residue_tally, record_scores, regions, running_composition, ranked_values, band_bounds, hit_order, scan_hits, union_of_passes, pass_accounting)}

_SCORED = f"{HITS_SQL}, e AS (SELECT *, lo % 7 AS model, (hi % 5 + 1)::INT AS pass_idx, 1e6 / score AS evalue FROM hits)"
_OF = lambda i: "CASE c " + " ".join(f"WHEN '{k}' THEN {v[i]}e0" for k, v in INSIDE.items()) + f" ELSE {OTHER[i]}e0 END"

ORACLE_SQL = {
    "tiles_2w": f"""WITH {SEQS_SQL}, s AS (SELECT seq_id, len(seq) AS n FROM seqs WHERE len(seq) > 0), t AS (SELECT seq_id, n, unnest(range(0, 1 + CASE WHEN n > 80 THEN ceil((n - 80) / 41e0)::INT ELSE 0 END)) AS i FROM s)
  SELECT seq_id, (1 + i * 41)::INT AS ws, least(n, i * 41 + 80)::INT AS we FROM t""",
    "extended_windows": f"""WITH {HITS_SQL}, w AS (SELECT seq_id, lo, hi - lo + 1 AS n, lo % 12 + 1 AS a, hi % 12 + 1 AS b FROM hits)
  SELECT seq_id, trunc(greatest(1e0, lo - 120 * (0.1e0 + a / 24e0)))::BIGINT AS ws, trunc(least(2040e0, lo + n + 120 * (0.1e0 + (13 - b) / 24e0)))::BIGINT AS we, count(*) AS n FROM w GROUP BY ALL""",
    "merged_by_share": f"""WITH RECURSIVE {HITS_SQL}, r AS (SELECT seq_id, strand, lo, hi, row_number() OVER (PARTITION BY seq_id, strand ORDER BY lo, hi, hit_id, sub_id) AS k FROM hits),
  m AS (SELECT seq_id, strand, k, lo, hi, 1 AS run FROM r WHERE k = 1
    UNION ALL SELECT m.seq_id, m.strand, r.k, CASE WHEN j THEN least(m.lo, r.lo) ELSE r.lo END, CASE WHEN j THEN greatest(m.hi, r.hi) ELSE r.hi END, CASE WHEN j THEN run ELSE run + 1 END
    FROM m JOIN r ON r.seq_id = m.seq_id AND r.strand = m.strand AND r.k = m.k + 1,
    LATERAL (SELECT (least(m.hi, r.hi) - greatest(m.lo, r.lo) + 1) / (least(m.hi - m.lo, r.hi - r.lo) + 1e0) > 0.5e0 AS j))
  SELECT seq_id, strand, arg_max(lo, k) AS lo, arg_max(hi, k) AS hi FROM m GROUP BY seq_id, strand, run""",
    "merged_survivors": f"""WITH {HITS_SQL}, m AS (SELECT *, (coalesce(lag(hi) OVER w + 1 < lo, true))::INT AS new FROM hits WINDOW w AS (PARTITION BY seq_id, strand ORDER BY lo, hi, hit_id)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY seq_id, strand ORDER BY lo, hi, hit_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
  SELECT seq_id, strand, min(lo) AS lo, last(hi ORDER BY lo, hi, hit_id) AS hi, max(score) AS score FROM g GROUP BY seq_id, strand, run""",
    "residue_tally": f"""WITH {HITS_SQL}, m AS (SELECT *, greatest(0, coalesce(lag(hi) OVER (PARTITION BY seq_id, strand ORDER BY lo, hi, hit_id) - lo + 1, 0)) AS shared FROM hits)
  SELECT seq_id, strand, count(*) AS windows, sum(hi - lo + 1 - shared)::BIGINT AS residues FROM m GROUP BY ALL""",
    "record_scores": f"""WITH {HITS_SQL}, h AS (SELECT seq_id, strand, hi, lo, max(score) AS score FROM hits GROUP BY ALL HAVING max(score) >= 2000),
  b AS (SELECT *, max(score) OVER (PARTITION BY seq_id, strand, hi ORDER BY lo DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h)
  SELECT seq_id, strand, lo, hi, score FROM b WHERE best IS NULL OR score > best""",
    "regions": f"""WITH {SEQS_SQL}, c AS (SELECT seq_id, unnest(string_split(seq, '')) AS c, generate_subscripts(string_split(seq, ''), 1) AS j FROM seqs WHERE len(seq) > 0),
  v AS (SELECT seq_id, j, {_OF(0)} AS m, {_OF(1)} AS b, {_OF(2)} AS e FROM c),
  f AS (SELECT *, m >= 0.25e0 AS t, m - e < 0.1e0 AS x, m - b < 0.1e0 AS s FROM v),
  n AS (SELECT *, min(j) FILTER (x) OVER (PARTITION BY seq_id ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close, max(j) FILTER (s) OVER (PARTITION BY seq_id ORDER BY j ROWS UNBOUNDED PRECEDING) AS start FROM f),
  r AS (SELECT seq_id, close, first(start ORDER BY j) AS start FROM n WHERE t AND close IS NOT NULL GROUP BY ALL)
  SELECT seq_id, greatest(coalesce(start, 1), coalesce(lag(close) OVER (PARTITION BY seq_id ORDER BY close) + 1, 1))::INT AS first, close::INT AS last FROM r""",
    "running_composition": f"""WITH {SEQS_SQL}, b AS (SELECT seq_id, unnest(range(0, len(seq), 100)) AS p, seq FROM seqs), c AS (SELECT seq_id, p // 100 AS block, substr(seq, p + 1, 100) AS s FROM b)
  SELECT seq_id, block::BIGINT AS block, (sum(len(s)) OVER w)::BIGINT AS n, (sum(len(s) - len(translate(s, 'GC', ''))) OVER w)::BIGINT AS gc FROM c WINDOW w AS (PARTITION BY seq_id ORDER BY block)""",
    "ranked_values": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS k FROM events)
  SELECT event_type, max(value) FILTER (k = 10) AS rank_10, max(value) FILTER (k = 100) AS rank_100 FROM r GROUP BY ALL""",
    "band_bounds": """WITH h AS (SELECT event_type, floor(value)::BIGINT AS x, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY x) AS up,
  sum(n) OVER (PARTITION BY event_type ORDER BY x DESC) AS down, sum(n) OVER (PARTITION BY event_type) * 0.01e0 AS beta FROM h)
  SELECT event_type, min(x) FILTER (up > beta) AS dmin, max(x) FILTER (down > beta) AS dmax FROM s GROUP BY ALL""",
    "hit_order": f"""WITH {_SCORED} SELECT seq_id, (row_number() OVER (PARTITION BY seq_id ORDER BY evalue, score DESC, lo, pass_idx DESC, hi, hit_id, sub_id))::INT AS idx, lo, hi, pass_idx, round(evalue, 6) AS evalue FROM e WHERE strand = '+'""",
    "scan_hits": f"""WITH {_SCORED}, c AS (SELECT *, model % 3 AS clan FROM e WHERE model < 6),
  r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand, clan ORDER BY evalue, score DESC, lo, model, hi, hit_id, sub_id)::INT AS rank FROM c),
  p AS (SELECT r.*, unnest(range(lo // 64, hi // 64 + 1)) AS bin FROM r),
  o AS (SELECT DISTINCT b.seq_id, b.strand, b.clan, b.rank, a.rank AS better FROM p a JOIN p b ON a.seq_id = b.seq_id AND a.strand = b.strand AND a.clan = b.clan AND a.bin = b.bin AND a.rank < b.rank AND a.lo <= b.hi AND b.lo <= a.hi),
  m AS (SELECT seq_id, strand, clan, rank, min(better) AS any_rank FROM o GROUP BY ALL),
  w AS (SELECT o.seq_id, o.strand, o.clan, o.rank, min(o.better) AS win_rank FROM o ANTI JOIN m ON m.seq_id = o.seq_id AND m.strand = o.strand AND m.clan = o.clan AND m.rank = o.better GROUP BY ALL)
  SELECT seq_id, strand, clan, rank, model, hit_id, sub_id, (any_rank IS NOT NULL)::INT AS marked, any_rank, win_rank FROM r LEFT JOIN m USING (seq_id, strand, clan, rank) LEFT JOIN w USING (seq_id, strand, clan, rank)""",
    "union_of_passes": f"""WITH RECURSIVE {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY seq_id, strand ORDER BY score DESC, lo, hi, hit_id, sub_id) AS rank FROM e),
  k AS (SELECT seq_id, strand, 0::BIGINT AS rank, []::STRUCT(lo BIGINT, hi BIGINT)[] AS kept, false AS stays FROM r GROUP BY ALL
  UNION ALL SELECT k.seq_id, k.strand, r.rank, CASE WHEN f THEN list_append(k.kept, {{'lo': r.lo, 'hi': r.hi}}) ELSE k.kept END, f
  FROM k JOIN r ON k.seq_id = r.seq_id AND k.strand = r.strand AND r.rank = k.rank + 1, LATERAL (SELECT len(list_filter(k.kept, lambda y: y.lo <= r.hi AND r.lo <= y.hi)) = 0 AS f))
  SELECT pass_idx, count(*) AS n, round(sum(score), 2) AS score FROM r JOIN k USING (seq_id, strand, rank) WHERE stays GROUP BY ALL""",
    "pass_accounting": f"""WITH {_SCORED} SELECT pass_idx, count(*) AS n, """ + ", ".join(f"count(*) FILTER (evalue <= {e}) AS n_f{k}, coalesce(sum(hi - lo + 1) FILTER (evalue <= {e}), 0)::BIGINT AS res_f{k}" for k, e in ((1, 500), (3, 50), (5, 20))) + " FROM e GROUP BY ROLLUP (pass_idx)",
}
