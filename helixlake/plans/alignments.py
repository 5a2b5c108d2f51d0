"""Queries over the columns and rows of alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import stats
from helixlake.operators import columns
from helixlake.sources import tables
from helixlake.sources.tables import ALN_SQL


def column_counts(spark: SparkSession, d: str) -> DataFrame:
    return columns.counts(tables.alignments(spark, d))


def match_columns(spark: SparkSession, d: str) -> DataFrame:
    """Columns of an alignment of which at least half of the rows hold a residue."""
    per = columns.counts(tables.alignments(spark, d)).groupBy("aln_id", "apos").agg(F.sum(F.when(F.col("residue") != "-", F.col("n")).otherwise(0)).alias("held"), F.sum("n").alias("n"))
    return per.withColumn("share", F.col("held") / F.col("n")).filter("share >= 0.5").select("aln_id", "apos", F.round("share", 6).alias("share"))


def consensus_columns(spark: SparkSession, d: str) -> DataFrame:
    return columns.consensus_columns(tables.alignments(spark, d))


def sequence_weights(spark: SparkSession, d: str) -> DataFrame:
    return columns.position_weights(tables.alignments(spark, d)).select("aln_id", "seq_id", F.round("weight", 6).alias("weight"))


def given_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights that are given (here the rows' lengths, where known), or 1."""
    return tables.alignments(spark, d).select("aln_id", "seq_id", F.coalesce(F.when(F.length("row") % 2 == 0, F.length("row").cast("double")), F.lit(1.0)).alias("weight"))


def identities(spark: SparkSession, d: str) -> DataFrame:
    return columns.identities(tables.alignments(spark, d)).select("aln_id", "s1", "s2", F.round("pid", 6).alias("pid"))


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Each row's span and whether it is a fragment, whose open ends are missing data."""
    rows = columns.fragments(tables.alignments(spark, d))
    return rows.select("aln_id", "seq_id", "span", F.col("fragment").cast("int").alias("fragment"), F.when(F.col("fragment"), F.col("alen") - F.col("span")).otherwise(0).alias("missing"))


def column_subset(spark: SparkSession, d: str) -> DataFrame:
    """Rows cut down to their consensus columns, which are numbered anew."""
    aln = tables.alignments(spark, d)
    return columns.cut_down(aln, columns.consensus_columns(aln))


def sequence_subset(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose names a list has, each alignment's shape with them."""
    aln = tables.alignments(spark, d)
    wanted = tables.table(spark, d, "labels").select(F.col("doc_id").alias("seq_id")).distinct()
    return columns.shapes(aln.join(wanted, "seq_id", "left_semi"))


def match_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Mean entropy, and mean relative entropy to a uniform null model, of the canonical residues of an alignment's consensus columns."""
    vector = F.transform("acgu", lambda n: n.cast("double"))
    per = columns.canonical_columns(tables.alignments(spark, d)).withColumn("p", stats.normalized(vector))
    uniform = F.array(*[F.lit(0.25)] * 4)
    return per.groupBy("aln_id").agg(F.count("*").alias("columns"), F.round(F.avg(stats.entropy(F.col("p"))), 6).alias("entropy"), F.round(F.avg(stats.relative_entropy(F.col("p"), uniform)), 6).alias("relative_entropy"))


def invalid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Columns whose given probabilities do not sum to 1; here the share of an unknown residue is missing from them."""
    per = columns.counts(tables.alignments(spark, d)).filter("residue <> '-'").groupBy("aln_id", "apos").agg(F.sum(F.when(F.col("residue") != "N", F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("n"))
    return per.withColumn("total", F.col("known") / F.col("n")).filter(F.abs(F.col("total") - 1) > 0.01).groupBy("aln_id").agg(F.count("*").alias("invalid"))


def insert_maxima(spark: SparkSession, d: str) -> DataFrame:
    """The most residues that any row inserts between two consensus columns."""
    return columns.insert_maxima(tables.alignments(spark, d))


QUERIES = {f.__name__: f for f in (column_counts, match_columns, consensus_columns, sequence_weights, given_weights, identities, fragments, column_subset, sequence_subset, match_entropy, invalid_vectors, insert_maxima)}

_CELLS = f"""WITH {ALN_SQL}, shape AS (SELECT aln_id, count(*) AS nseq, max(len(row)) AS alen FROM aln GROUP BY ALL), cells AS (SELECT aln_id, seq_id, unnest(string_split(row, '')) AS residue, generate_subscripts(string_split(row, ''), 1)::INT AS apos FROM aln WHERE row <> ''),
  each AS (SELECT aln_id, apos, residue, count(*) AS n FROM cells GROUP BY ALL), counts AS (SELECT * FROM each UNION ALL SELECT aln_id, apos, '-', any_value(nseq) - sum(n)::BIGINT FROM each JOIN shape USING (aln_id) GROUP BY aln_id, apos HAVING sum(n) < any_value(nseq))"""
# For every column the gaps of rows that end before it and are no fragments, row by row.
_CONSENSUS = (
    _CELLS
    + """, frag AS (SELECT aln_id, seq_id, row, len(row) AS l, alen, len(row) < ceil(0.5e0 * alen) AS f FROM aln JOIN shape USING (aln_id)),
  held AS (SELECT aln_id, apos, sum(n) AS held FROM each GROUP BY ALL), ends AS (SELECT aln_id, l, count(*) AS k FROM frag WHERE NOT f GROUP BY ALL),
  open AS (SELECT h.aln_id, h.apos, h.held, coalesce(sum(k), 0) AS gaps FROM held h LEFT JOIN ends e ON e.aln_id = h.aln_id AND e.l < h.apos GROUP BY ALL),
  cons AS (SELECT aln_id, apos, (row_number() OVER (PARTITION BY aln_id ORDER BY apos))::INT AS cpos FROM open WHERE gaps / (held + gaps) < 0.5e0)"""
)

ORACLE_SQL = {
    "column_counts": _CELLS + " SELECT aln_id, apos, residue, n FROM counts",
    "match_columns": _CELLS + ", s AS (SELECT aln_id, apos, sum(n) FILTER (residue <> '-') / sum(n) AS share FROM counts GROUP BY ALL) SELECT aln_id, apos, round(share, 6) AS share FROM s WHERE share >= 0.5e0",
    "consensus_columns": _CONSENSUS + " SELECT aln_id, apos FROM cons",
    "sequence_weights": _CONSENSUS
    + """, used AS (SELECT c.* FROM cells c WHERE residue IN ('A', 'C', 'G', 'U') AND ((aln_id, apos) IN (SELECT (aln_id, apos) FROM cons) OR aln_id NOT IN (SELECT aln_id FROM cons))),
  c AS (SELECT *, count(*) OVER (PARTITION BY aln_id, apos, residue) AS copies FROM used), k AS (SELECT aln_id, apos, count(DISTINCT residue) AS kinds FROM used GROUP BY ALL),
  s AS (SELECT aln_id, seq_id, avg(1e0 / (kinds * copies)) AS raw FROM c JOIN k USING (aln_id, apos) GROUP BY ALL), a AS (SELECT aln_id, seq_id, coalesce(raw, 0) AS raw FROM aln LEFT JOIN s USING (aln_id, seq_id))
  SELECT aln_id, seq_id, round(CASE WHEN count(*) OVER w = 1 OR sum(raw) OVER w = 0 THEN 1 ELSE raw * count(*) OVER w / sum(raw) OVER w END, 6) AS weight FROM a WINDOW w AS (PARTITION BY aln_id)""",
    "given_weights": f"WITH {ALN_SQL} SELECT aln_id, seq_id, CASE WHEN len(row) % 2 = 0 THEN len(row)::DOUBLE ELSE 1e0 END AS weight FROM aln",
    "identities": _CELLS
    + """, q AS (SELECT * FROM cells WHERE seq_id % 100 = 0), n AS (SELECT q.aln_id, q.seq_id AS s1, c.seq_id AS s2, count(*) AS nid FROM q JOIN cells c ON q.aln_id = c.aln_id AND q.apos = c.apos AND q.residue = c.residue AND q.seq_id <> c.seq_id GROUP BY ALL),
  p AS (SELECT a.aln_id, a.seq_id AS s1, b.seq_id AS s2, least(len(a.row), len(b.row)) AS l FROM aln a JOIN aln b ON a.aln_id = b.aln_id AND a.seq_id <> b.seq_id WHERE a.seq_id % 100 = 0)
  SELECT p.aln_id, s1, s2, CASE WHEN l > 0 THEN round(coalesce(nid, 0)::DOUBLE / l, 6) ELSE 0e0 END AS pid FROM p LEFT JOIN n USING (aln_id, s1, s2)""",
    "fragments": _CONSENSUS + " SELECT aln_id, seq_id, l::INT AS span, f::INT AS fragment, (CASE WHEN f THEN alen - l ELSE 0 END)::INT AS missing FROM frag",
    "column_subset": _CONSENSUS + " SELECT aln_id, seq_id, string_agg(residue, '' ORDER BY cpos) AS row FROM cells JOIN cons USING (aln_id, apos) GROUP BY ALL",
    "sequence_subset": f"WITH {ALN_SQL} SELECT aln_id, count(*) AS nseq, max(len(row))::INT AS alen FROM aln WHERE seq_id IN (SELECT doc_id FROM labels) GROUP BY ALL",
    "match_entropy": _CONSENSUS
    + """, p AS (SELECT aln_id, apos, n::DOUBLE / sum(n) OVER (PARTITION BY aln_id, apos) AS p FROM counts SEMI JOIN cons USING (aln_id, apos) WHERE residue IN ('A', 'C', 'G', 'U')),
  e AS (SELECT aln_id, apos, -sum(p * log2(p)) AS e, sum(p * log2(p / 0.25e0)) AS r FROM p GROUP BY ALL) SELECT aln_id, count(*) AS columns, round(avg(e), 6) AS entropy, round(avg(r), 6) AS relative_entropy FROM e GROUP BY ALL""",
    "invalid_vectors": _CELLS + ", t AS (SELECT aln_id, apos, coalesce(sum(n) FILTER (residue <> 'N'), 0) / sum(n) AS t FROM counts WHERE residue <> '-' GROUP BY ALL) SELECT aln_id, count(*) AS invalid FROM t WHERE abs(t - 1) > 0.01e0 GROUP BY ALL",
    "insert_maxima": _CONSENSUS
    + """, c AS (SELECT c.aln_id, seq_id, apos, cpos, coalesce(max(cpos) OVER (PARTITION BY c.aln_id, seq_id ORDER BY apos), 0)::INT AS after FROM cells c LEFT JOIN cons USING (aln_id, apos)),
  n AS (SELECT aln_id, after, seq_id, count(*) AS n FROM c WHERE cpos IS NULL GROUP BY ALL) SELECT aln_id, after, max(n) AS most FROM n GROUP BY ALL""",
}
