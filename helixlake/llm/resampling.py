"""Importance resampling of documents towards a target: hashed n-gram counts, gains of buckets, Gumbel noise, the highest scores.

Words are runs of letters, digits and non-ASCII characters, with A to Z in lower case. Features are all runs of 1 to `longest`
words; a feature's bucket is its CRC-32 modulo `buckets`. A bucket's gain is 1,000 times the log ratio of its smoothed shares
of the target's and the corpus's features, rounded down; a document's weight is the mean gain of its features, rounded down.

Everything is built-in expressions over exploded arrays. Counts meet by bucket (summed up in each task first), the table of gains
has one row a bucket, so that it is broadcast at any size of the corpus, and a document's sum is one row when it is shuffled.
Ranks come from ranges of the sort order: rows are numbered within a range, and a range starts where those before it end.

Defined results: null and empty texts and texts without words have no features, weight 0, and are never drawn; a null id makes
no score, so that its document is never drawn, though its features count. Repeated rows are documents of their own; rows with
equal score and id are ranked in any order. Without documents of `least` words nothing is drawn; an empty target has no features. Other
columns of the documents are dropped, whatever their names.
"""

from __future__ import annotations

import string
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm._shared import discard, saved, table

#: ASCII characters that are no part of words once letters are small.
BETWEEN = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))
BUCKETS, LONGEST, LEAST, PERCENT, SEED = 10_000, 2, 20, 25, 7


def words(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + BETWEEN, string.ascii_lowercase + " " * len(BETWEEN))
    return F.array_remove(F.split(plain, " "), "")


def features(of: Column, longest: int) -> Column:
    """All runs of 1 to `longest` words, each joined by a space, of an array of words."""

    def runs(n: int) -> Column:
        starts = F.slice(of, F.lit(1), F.greatest(F.size(of) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda w, i: F.concat(w, *(x for k in range(1, n) for x in (F.lit(" "), F.get(of, i + k)))))

    return F.concat(of, *(runs(n) for n in range(2, longest + 1)))


def number_of_features(n_words: int, longest: int) -> int:
    return sum(max(0, n_words - n + 1) for n in range(1, longest + 1))


def hashed(text: Column, longest: int, buckets: int) -> Column:
    """The buckets of a text's features."""
    bucket = lambda f: F.pmod(F.crc32(F.encode(f, "UTF-8")), F.lit(buckets)).cast("int")
    # The words are bound to a variable, since an expression would be evaluated again for every run.
    return F.get(F.transform(F.array(words(text)), lambda of: F.transform(features(of, longest), bucket)), F.lit(0))


def counts(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): in how many places each bucket stands in the arrays `buckets`."""
    return rows.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(s: DataFrame, t: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, by its counts in the corpus (bucket, s) and in the target (bucket, t)."""
    of_all = float(s.agg(F.sum("s")).first()[0] or 0)
    of_target = float(t.agg(F.sum("t")).first()[0] or 0)
    both = s.join(F.broadcast(t), "bucket", "left").select("bucket", F.col("s").cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    ratio = (F.col("t") + 1) * F.lit(of_all + buckets) / ((F.col("s") + 1) * F.lit(of_target + buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, rounded down, from the digest of a seed and an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighed(rows: DataFrame, gain: DataFrame, seed: int = SEED) -> DataFrame:
    """(row, doc_id, n_features, weight, score) of each row (row, doc_id, buckets)."""
    each = rows.select("row", "doc_id", F.explode_outer("buckets").alias("bucket"))
    sums = each.join(F.broadcast(gain), "bucket", "left").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total"))
    # Whole numbers: the remainder that is never negative makes the division go down.
    weight = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
    return sums.withColumn("weight", weight).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("total")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` (1, 2, 3, ...) in a total order: numbers within ranges of it, and where each range starts."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["n"] for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return dealt.drop("__part").withColumn("rank", F.lit(None).cast("long"))
    many = max(sizes) + 1
    starts = list(accumulate((sizes.get(p, 0) for p in range(many - 1)), initial=0))
    start = F.get(F.array(*(F.lit(x).cast("long") for x in starts)), F.col("__part"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("rank", within + start).drop("__part")


def resampled(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where a document is not drawn.

    Of the documents with `least` words or more `percent` of a hundred (rounded down) are drawn, those with the highest scores,
    of equal scores those with the smaller ids.
    """
    # Texts are split once; what is read again are the buckets, and the counts of which there are `buckets` at most.
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), hashed(F.col(text), longest, buckets).alias("buckets")))
    s = saved(counts(rows, "s"))
    t = saved(counts(target.select(hashed(F.col(target_text), longest, buckets).alias("buckets")), "t"))
    of = saved(weighed(rows, gains(s, t, buckets), seed))
    for done in (rows, s, t):
        discard(done)
    # The number of features grows with the number of words.
    eligible = (F.col("n_features") >= max(1, number_of_features(least, longest))) & F.col("score").isNotNull()
    drawn = of.filter(eligible).count() * percent // 100
    order = [F.desc("score"), F.asc("doc_id"), F.asc("row")]
    numbered = ranked(of.filter(eligible), order).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = of.filter(~F.coalesce(eligible, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return numbered.unionByName(rest).drop("row")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
