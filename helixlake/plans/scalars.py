"""Queries of scalar functions over residues, scores and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.functions import alphabet as ab
from helixlake.functions import stats
from helixlake.sources import tables
from helixlake.sources.tables import SEQS_SQL

#: Singlet scores, null model and pair scores that the score queries use; any others would do.
SCORES = {"A": 1.5, "C": -0.5, "G": 0.75, "U": -2.0}
INTEGER_SCORES = {"A": 15, "C": -6, "G": 8, "U": -20}
NULL = {"A": 0.4, "C": 0.1, "G": 0.2, "U": 0.3}
PAIR_SCORES = {x + y: (3.0 if x + y in ab.CANONICAL_PAIRS else -1.0) + 0.25 * i - 0.125 * j for i, x in enumerate("ACGU") for j, y in enumerate("ACGU")}


def residue_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many residues, gaps and missing symbols the raw letters of a text hold, and its expected canonical counts."""
    seq = F.col("seq")
    symbols = F.split(F.translate(seq, "WN", "-~"), "")
    n = lambda test: F.size(F.filter(symbols, test)).cast("long")
    expected = [F.round(ab.expected_count(seq, r), 6).alias(f"e_{r.lower()}") for r in "ACGU"]
    return tables.sequences(spark, d).filter("len > 0").select("seq_id", n(ab.is_residue).alias("residues"), n(ab.is_gap).alias("gaps"), n(ab.is_missing).alias("missing"), *expected)


def symbol_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol that occurs, with its number and its average, integer and expected scores."""
    cells = tables.sequences(spark, d).select(F.explode(F.split("seq", "")).alias("symbol")).filter("symbol <> ''")
    x = F.col("symbol")
    average, expected = ab.average_score(x, SCORES), ab.expected_score(x, SCORES, NULL)
    return cells.groupBy("symbol").agg(F.count("*").alias("n")).select("symbol", "n", F.round(average, 6).alias("average"), ab.average_integer_score(x, INTEGER_SCORES).alias("integer"), F.round(expected, 6).alias("expected"))


def end_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair of a sequence's first and last symbol: its score, and whether it is canonical."""
    first, last = F.substring("seq", 1, 1), F.substring("seq", -1, 1)
    return tables.sequences(spark, d).filter("len > 1").select("seq_id", F.concat(first, last).alias("pair"), F.round(ab.pair_score(first, last, PAIR_SCORES), 6).alias("score"), ab.is_canonical_pair(first, last).cast("int").alias("canonical"))


def unaligned(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an alignment (here N is a gap) without their gaps, put into a background, and their insert blocks justified."""
    row = F.translate("seq", "N", "-")
    block = F.substring(row, 1, 12)
    placed = ab.embedded(F.lit("N" * 10), F.substring(F.col("plain"), 1, 5), F.lit(3))
    rows = tables.sequences(spark, d).filter("len > 0").select("seq_id", block.alias("block"), ab.without_gaps(row).alias("plain"))
    return rows.select("seq_id", "plain", placed.alias("placed"), ab.justified(F.col("block")).alias("left"), ab.justified(F.col("block"), left=False).alias("right"))


def checksums(spark: SparkSession, d: str) -> DataFrame:
    return tables.sequences(spark, d).filter("len > 0").select("seq_id", ab.checksum(ab.digitize(F.col("seq"))).alias("checksum"))


def score_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts and codes of values: posterior codes and their means, probabilities as bits, widths, truncation labels."""
    p, x = F.col("value") / 500.0, F.floor("value").cast("long")
    code = ab.posterior_code(p)
    text = ab.probability_text(F.ceil(F.col("value") / 5.0) / 100.0)
    label = ab.truncation_label(F.lit(1), F.lit(100), F.when(x % 2 == 0, 1).otherwise(2), F.when(x % 3 == 0, 100).otherwise(99))
    return tables.table(spark, d, "events").select(
        "event_id", code.alias("code"), F.round(ab.mean_of_code(code), 6).alias("mean"), text.alias("bits"), F.round(ab.probability_of_text(text), 5).alias("p"), ab.text_width(x - 200).alias("width"), label.alias("truncation")
    )


def distributions(spark: SparkSession, d: str) -> DataFrame:
    """Densities, tails and inverses of exponential and Gumbel distributions, and transforms of scores."""
    x, p = F.col("value"), F.col("value") / 500.0
    values = {
        "exp_cdf": stats.exponential_cdf(x, 20.0, 0.02),
        "exp_log_survival": stats.exponential_log_survival(x, 20.0, 0.02),
        "pdf": stats.gumbel_pdf(x, 50.0, 0.03) * 100,
        "log_pdf": stats.gumbel_log_pdf(x, 50.0, 0.03),
        "log_cdf": stats.gumbel_log_cdf(x, 50.0, 0.03),
        "log_survival": stats.gumbel_log_survival(x, 50.0, 0.03),
        "inverse_cdf": stats.gumbel_inverse_cdf(p, 50.0, 0.03),
        "inverse_survival": stats.gumbel_inverse_survival(p, 50.0, 0.03),
        "score_of_evalue": stats.score_of_evalue(x, 20.0, 0.02, 2.0e6, 1.0e6, 500),
        "profile_score_e": stats.profile_score_of_evalue(x, 1.0e6, 200, 5.0, 0.7),
        "profile_score_p": stats.profile_score_of_pvalue(p, 5.0, 0.7),
        "profile_evalue": stats.profile_evalue(x / 20.0, 1.0e6, 200, 5.0, 0.7),
        "log_sum": stats.log_sum2(x / 100.0, 3.0 - x / 200.0),
        "from_scaled": stats.probability_of_scaled(stats.scaled_score(p)),
    }
    return tables.table(spark, d, "events").select("event_id", stats.scaled_score(p).alias("scaled"), *(F.round(v, 6).alias(k) for k, v in values.items()))


def composition_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Of each sequence's canonical counts as a vector: normalized, its entropy, and its relative entropy to the null model."""
    counts = F.array(*(ab.count_of(F.col("seq"), r).cast("double") for r in "ACGU"))
    null = F.array(*(F.lit(NULL[r]) for r in "ACGU"))
    rows = tables.sequences(spark, d).select("seq_id", stats.normalized(counts).alias("v"))
    share = [F.round(F.col("v")[i], 6).alias(f"p_{r.lower()}") for i, r in enumerate("ACGU")]
    return rows.select("seq_id", *share, F.round(stats.entropy(F.col("v")), 6).alias("entropy"), F.round(stats.relative_entropy(F.col("v"), null), 6).alias("relative_entropy"))


def model_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets for models of the size of each part: relative entropy to weight down to, and the slope of a profile's tail."""
    clen, pairs = F.col("p_size").cast("double"), F.col("p_partkey") % 3
    target = stats.target_relative_entropy(clen, pairs)
    return tables.table(spark, d, "part").select("p_partkey", F.round(target, 6).alias("target"), F.round(stats.lambda_estimate(clen, target), 6).alias("slope"))


def filter_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Every filter's threshold for a search space of each order's price, in every mode."""
    z = F.col("o_totalprice") / F.pow(F.lit(10.0), F.col("o_orderkey") % 6)
    modes = F.array(*(F.lit(m) for m in ("default", "rfam", "mid", "nohmm", "max")))
    rows = tables.table(spark, d, "orders").select("o_orderkey", z.alias("z"), modes[(F.col("o_custkey") % 5).cast("int")].alias("mode"))
    return rows.withColumn("t", stats.filter_thresholds(F.col("z"), F.col("mode"))).groupBy("mode", "t.f1", "t.f2", "t.f3", "t.f4", "t.f5").agg(F.count("*").alias("n"))


def pass_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which hits each pass admits, by which ends it enforces, and which models are searched by their profile alone."""
    li = tables.table(spark, d, "lineitem")
    start, stop = F.col("l_partkey") % 5 + 1, F.col("l_partkey") % 5 + 1 + F.col("l_quantity").cast("long") % 7
    pass_idx, mode = (F.col("l_suppkey") % 5 + 1).cast("int"), F.element_at(F.array(F.lit("J"), F.lit("L"), F.lit("R")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    admitted = stats.admits_truncation(pass_idx, mode, start, stop, F.lit(1), F.lit(8), F.col("l_partkey") % 2 == 0)
    profile = stats.uses_profile_only(F.col("l_partkey") % 4 == 0, F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 5)
    keys = [pass_idx.alias("pass_idx"), stats.enforces_first(pass_idx).cast("int").alias("first"), stats.enforces_last(pass_idx).cast("int").alias("last"), mode.alias("mode"), admitted.cast("int").alias("admitted"), profile.cast("int").alias("profile_only")]
    return li.groupBy(*keys).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (residue_counts, symbol_scores, end_pairs, unaligned, checksums, score_texts, distributions, composition_vectors, model_targets, filter_tiers, pass_rules)}


def _values(scores: dict) -> str:
    return ", ".join(f"('{k}', {float(v)}e0)" for k, v in scores.items())


_DEGENERATE = "deg(symbol, m) AS (VALUES " + ", ".join(f"('{x}', '{m}')" for x, m in ({r: r for r in "ACGU"} | ab.DEGENERATE).items()) + "), mem AS (SELECT symbol, unnest(string_split(m, '')) AS r, len(m) AS n FROM deg)"
_GUMBEL_Y = "0.03e0 * (value - 50)"
_TIER_SQL = " ".join(f"WHEN z >= {least - stats.SLACK}::DOUBLE THEN [{f1}, {'NULL' if f2 is None else f2}, {rest}]" for least, f1, f2, rest in stats.TIERS[:-1]) + f" ELSE [{stats.TIERS[-1][1]}, NULL, {stats.TIERS[-1][3]}]"

ORACLE_SQL = {
    "residue_counts": f"""WITH {SEQS_SQL}, {_DEGENERATE}, c AS (SELECT seq_id, symbol, count(*) AS k FROM (SELECT seq_id, unnest(string_split(seq, '')) AS symbol FROM seqs WHERE len(seq) > 0) GROUP BY ALL),
  e AS (SELECT seq_id, r, sum(k * 1e0 / n) AS e FROM c JOIN mem USING (symbol) GROUP BY ALL)
  SELECT c.seq_id, coalesce(sum(k) FILTER (symbol NOT IN ('W', 'N')), 0)::BIGINT AS residues, coalesce(sum(k) FILTER (symbol = 'W'), 0)::BIGINT AS gaps, coalesce(sum(k) FILTER (symbol = 'N'), 0)::BIGINT AS missing,
  {", ".join(f"round(coalesce(any_value((SELECT e FROM e WHERE e.seq_id = c.seq_id AND r = '{r}')), 0e0), 6) AS e_{r.lower()}" for r in "ACGU")} FROM c GROUP BY c.seq_id""",
    "symbol_scores": f"""WITH {SEQS_SQL}, {_DEGENERATE}, sc(r, s) AS (VALUES {_values(SCORES)}), si(r, i) AS (VALUES {_values(INTEGER_SCORES)}), nu(r, w) AS (VALUES {_values(NULL)}),
  c AS (SELECT symbol, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS symbol FROM seqs) WHERE symbol <> '' GROUP BY ALL),
  m AS (SELECT symbol, avg(s) AS average, avg(i) AS im, sum(s * w) / sum(w) AS expected FROM mem JOIN sc USING (r) JOIN si USING (r) JOIN nu USING (r) GROUP BY ALL)
  SELECT symbol, c.n, round(average, 6) AS average, (CASE WHEN im < 0 THEN ceil(im - 0.5e0) ELSE floor(im + 0.5e0) END)::INT AS integer, round(expected, 6) AS expected FROM c JOIN m USING (symbol)""",
    "end_pairs": f"""WITH {SEQS_SQL}, {_DEGENERATE}, ps(p, s) AS (VALUES {_values(PAIR_SCORES)}),
  m AS (SELECT a.symbol || b.symbol AS pair, avg(s) AS score FROM mem a, mem b, ps WHERE p = a.r || b.r GROUP BY ALL),
  e AS (SELECT seq_id, substr(seq, 1, 1) || substr(seq, -1, 1) AS pair FROM seqs WHERE len(seq) > 1)
  SELECT seq_id, pair, round(score, 6) AS score, (pair IN ('AU', 'UA', 'GC', 'CG', 'GU', 'UG'))::INT AS canonical FROM e JOIN m USING (pair)""",
    "unaligned": f"""WITH {SEQS_SQL}, r AS (SELECT seq_id, translate(seq, 'N', '-') AS row FROM seqs WHERE len(seq) > 0), b AS (SELECT seq_id, substr(row, 1, 12) AS b, replace(row, '-', '') AS plain, FROM r),
  k AS (SELECT *, replace(b, '-', '') AS k FROM b)
  SELECT seq_id, plain, 'NN' || substr(plain, 1, 5) || repeat('N', 8 - len(substr(plain, 1, 5))::INT) AS placed, rpad(k, len(b)::INT, '.') AS left, lpad(k, len(b)::INT, '.') AS right FROM k""",
    "checksums": f"""WITH {SEQS_SQL}, c AS (SELECT seq_id, list_prepend(0::BIGINT, list_transform(string_split(seq, ''), lambda x: (strpos('ACGU-RYMKSWHBVDN', x) - 1)::BIGINT)) AS c FROM seqs WHERE len(seq) > 0),
  h AS (SELECT seq_id, list_reduce(c, lambda h, x: xor(((((h + x) & 4294967295) + (((h + x) & 4294967295) << 10)) & 4294967295), (((((h + x) & 4294967295) + (((h + x) & 4294967295) << 10)) & 4294967295) >> 6))) AS h FROM c),
  i AS (SELECT seq_id, (h + (h << 3)) & 4294967295 AS h FROM h), j AS (SELECT seq_id, xor(h, h >> 11) AS h FROM i)
  SELECT seq_id, (h + (h << 15)) & 4294967295 AS checksum FROM j""",
    "score_texts": """WITH v AS (SELECT event_id, value, value / 500e0 AS p, floor(value)::BIGINT AS x FROM events),
  c AS (SELECT *, CASE WHEN p + 0.05e0 >= 1 THEN '*' ELSE floor((p + 0.05e0) * 10)::INT::VARCHAR END AS code, ceil(value / 5e0) / 100e0 AS q FROM v),
  t AS (SELECT *, CASE WHEN q = 0 THEN '*' ELSE printf('%.3f', ln(q / 0.25e0) * 1.44269504e0) END AS bits FROM c)
  SELECT event_id, code, CASE code WHEN '*' THEN 0.975e0 WHEN '0' THEN 0.025e0 ELSE round(code::DOUBLE / 10, 6) END AS mean, bits, CASE bits WHEN '*' THEN 0e0 ELSE round(exp(bits::DOUBLE / 1.44269504e0) * 0.25e0, 5) END AS p,
  (CASE WHEN x = 200 THEN 0 ELSE len((x - 200)::VARCHAR) END)::INT AS width, CASE WHEN x % 2 <> 0 AND x % 3 <> 0 THEN '5''&3''' WHEN x % 2 <> 0 THEN '5''' WHEN x % 3 <> 0 THEN '3''' ELSE 'no' END AS truncation FROM t""",
    "distributions": f"""WITH v AS (SELECT event_id, value, value / 500e0 AS p, {_GUMBEL_Y} AS y FROM events)
  SELECT event_id, floor(0.5e0 + 1000 * log2(p / 0.25e0))::BIGINT AS scaled, round(CASE WHEN value < 20 THEN 0 ELSE 1 - exp(-0.02e0 * (value - 20)) END, 6) AS exp_cdf,
  round(CASE WHEN value < 20 THEN 0 ELSE -0.02e0 * (value - 20) END, 6) AS exp_log_survival, round(3e0 * exp(-y - exp(-y)), 6) AS pdf, round(ln(0.03e0) - y - exp(-y), 6) AS log_pdf, round(-exp(-y), 6) AS log_cdf,
  round(ln(1 - exp(-exp(-y))), 6) AS log_survival, round(50 - ln(-ln(p)) / 0.03e0, 6) AS inverse_cdf, round(50 - ln(-ln(1 - p)) / 0.03e0, 6) AS inverse_survival,
  round(20 + ln(value / 1000e0) / -0.02e0, 6) AS score_of_evalue, round(5 + ln(value / 5000e0) / -0.7e0, 6) AS profile_score_e, round(5 + ln(p) / -0.7e0, 6) AS profile_score_p,
  round(CASE WHEN value / 20e0 < 5 THEN 1e0 ELSE exp(-0.7e0 * (value / 20e0 - 5)) END * 5000e0, 6) AS profile_evalue, round(log2(pow(2e0, value / 100e0) + pow(2e0, 3 - value / 200e0)), 6) AS log_sum,
  round(0.25e0 * pow(2e0, floor(0.5e0 + 1000 * log2(p / 0.25e0)) / 1000e0), 6) AS from_scaled FROM v""",
    "composition_vectors": f"""WITH {SEQS_SQL}, c AS (SELECT seq_id, {", ".join(f"len(seq) - len(replace(seq, '{r}', '')) AS n{r}" for r in "ACGU")} FROM seqs), t AS (SELECT *, nA + nC + nG + nU AS t FROM c),
  v AS (SELECT seq_id, {", ".join(f"CASE WHEN t > 0 THEN n{r}::DOUBLE / t ELSE 0.25e0 END AS p{r}" for r in "ACGU")} FROM t)
  SELECT seq_id, {", ".join(f"round(p{r}, 6) AS p_{r.lower()}" for r in "ACGU")}, round({" ".join(f"- CASE WHEN p{r} > 0 THEN p{r} * log2(p{r}) ELSE 0e0 END" for r in "ACGU")}, 6) AS entropy,
  round({" + ".join(f"CASE WHEN p{r} > 0 THEN p{r} * log2(p{r} / {NULL[r]}e0) ELSE 0e0 END" for r in "ACGU")}, 6) AS relative_entropy FROM v""",
    "model_targets": """WITH t AS (SELECT p_partkey, p_size::DOUBLE AS c, p_partkey % 3 AS k FROM part), g AS (SELECT p_partkey, c, greatest((45e0 - log2(2e0 / (c * (c + 1)))) / c, CASE WHEN k > 0 THEN 0.59e0 ELSE 0.38e0 END) AS target FROM t)
  SELECT p_partkey, round(target, 6) AS target, round(ln(2e0) + 1.44e0 / (c * target), 6) AS slope FROM g""",
    "filter_tiers": f"""WITH o AS (SELECT o_totalprice / pow(10e0, o_orderkey % 6) AS z, ['default', 'rfam', 'mid', 'nohmm', 'max'][o_custkey % 5 + 1] AS mode FROM orders),
  t AS (SELECT mode, CASE WHEN mode IN ('max', 'nohmm') THEN [1, NULL, 1] WHEN mode = 'mid' THEN [1, NULL, 0.02] WHEN mode = 'rfam' THEN [0.06, 0.02, 0.0002] {_TIER_SQL} END::DOUBLE[] AS t FROM o)
  SELECT mode, t[1] AS f1, t[2] AS f2, t[3] AS f3, t[3] AS f4, t[3] AS f5, count(*) AS n FROM t GROUP BY ALL""",
    "pass_rules": """WITH h AS (SELECT l_partkey AS k, l_partkey % 5 + 1 AS a, l_partkey % 5 + 1 + l_quantity::BIGINT % 7 AS b, (l_suppkey % 5 + 1)::INT AS pass_idx, ['J', 'L', 'R'][l_linenumber % 3 + 1] AS mode FROM lineitem)
  SELECT pass_idx, (pass_idx IN (2, 4))::INT AS first, (pass_idx IN (3, 4))::INT AS last, mode, (pass_idx IN (1, 5) OR (a = 1 AND b = 8) OR CASE mode WHEN 'J' THEN k % 2 = 0 WHEN 'L' THEN b = 8 ELSE a = 1 END)::INT AS admitted,
  (CASE WHEN k % 4 = 0 OR k % 3 = 0 THEN false ELSE k % 2 = 0 OR k % 5 = 0 END)::INT AS profile_only, count(*) AS n FROM h GROUP BY ALL""",
}
