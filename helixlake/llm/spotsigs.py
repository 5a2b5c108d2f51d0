r"""SpotSigs fingerprints of documents, with built-in functions only.

A signature is a common word (anchor) with the chain of content words that follow it, other common words
skipped. Navigation and boilerplate hold few common words, running prose many, so signatures follow the
prose. A document's fingerprint is the sorted set of 32-bit hashes of its signatures, eight hex digits each; two
fingerprints are compared by Jaccard similarity, which `near_duplicates` prunes by the sizes of the sets.

Defined results: a null text is an empty one; a text without anchors has one signature, its words in order, so
that texts without words all have the fingerprint of no words; the likeness of equal fingerprints is 1. Of
rows with equal doc_id the order is by text; null ids come first; the only row of a table is its own next
row. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.llm._shared import saved, table

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were which with "
    "au ce dans de des du en est et il la le les par pas pour que qui sur un une "
    "auf das dem den der des die ein eine für ich im ist mit nicht sich sie und von zu "
    "al con del el es las lo los no por se su y"
).split()
#: Content words in a chain.
CHAIN = 2
#: Rows in a bucket of neighbours by doc_id, and buckets at most (their smallest ids go to the driver).
PER_BUCKET, BUCKETS = 2_000, 20_000



def _tree(words: list[str]) -> str:
    """A regular expression for exactly these words that branches letter by letter."""
    heads = sorted({w[0] for w in words if w})
    body = "|".join(h + _tree([w[1:] for w in words if w.startswith(h)]) for h in heads)
    return f"(?:{body})" + "?" * ("" in words) if body else ""


#: What stands between words: all of ASCII and Latin-1 but letters and digits, and general punctuation.
_BETWEEN = r"[\x00-\x2f\x3a-\x60\x7b-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2000-\u206f\u3000-\u3003]+"
#: Set before every anchor; plain text has letters, digits and spaces only.
_MARK = "\u0001"
_SKIP = f"(?: {_MARK}[^ ]++)*+"
_SIGNATURE = f"{_MARK}(?=([^ ]++" + f"{_SKIP} [^ ]++" * CHAIN + "))"


def with_signatures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sorted distinct 32-bit hashes of a text's signatures, as an array of eight-digit hex strings."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BETWEEN, " ")), F.lit(" "))
    marked = F.regexp_replace(plain, f" (?={_tree(list(ANCHORS))} )", f" {_MARK}")
    # The common words inside a chain go; the anchor before the first space stays.
    chains = F.transform(F.regexp_extract_all("__marked", F.lit(_SIGNATURE), F.lit(1)), lambda s: F.regexp_replace(s, f" {_MARK}[^ ]++", ""))
    whole = F.when(F.size("__chains") > 0, F.col("__chains")).otherwise(F.array("__marked"))
    hashed = F.transform(whole, lambda s: F.lpad(F.lower(F.hex(F.crc32(s.cast("binary")))), 8, "0"))
    # Columns one by one: an expression that is used twice is then computed once.
    return docs.withColumn("__marked", marked).withColumn("__chains", chains).withColumn(out, F.sort_array(F.array_distinct(hashed))).drop("__marked", "__chains")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of signatures."""
    both = F.size(F.array_intersect(a, b))
    return (both / (F.size(a) + F.size(b) - both)).cast("double")


def with_next(docs: DataFrame, *, per_bucket: int = PER_BUCKET) -> DataFrame:
    """(doc_id, text, sigs, next_text, next_sigs): each row with the one that follows it by doc_id; after the last, the first.

    Rows are dealt into buckets of doc_id ranges, of about equal size by quantiles, and each bucket also gets a
    copy of the first row of the bucket after it, so that no window spans more than a bucket.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    count = max(1, min(BUCKETS, -(-docs.count() // per_bucket)))
    edges = keyed.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 20 * count)).first()[0] if count > 1 else []
    bucket = F.size(F.filter(F.lit(edges), lambda e: e < F.col("key"))) if edges else F.lit(0)
    dealt = keyed.withColumn("bucket", bucket)
    # At most BUCKETS pairs: each bucket's smallest key goes to the bucket before it.
    first = sorted(dealt.groupBy("bucket").agg(F.min("key")).collect())
    goes = [(key, first[i - 1][0]) for i, (_, key) in enumerate(first)]
    targets = docs.sparkSession.createDataFrame(goes, "key long, bucket int")
    ghosts = keyed.join(F.broadcast(targets), "key").groupBy("key", "bucket").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    every = dealt.withColumn("ghost", F.lit(False)).unionByName(ghosts.withColumn("ghost", F.lit(True)))
    ordered = Window.partitionBy("bucket").orderBy("ghost", "key", "text")
    each = with_signatures(every, "text", "sigs")
    following = each.withColumns({"next_text": F.lead("text").over(ordered), "next_sigs": F.lead("sigs").over(ordered)})
    return following.filter("not ghost").drop("bucket", "ghost", "key")


def near_duplicates(prints: DataFrame, threshold: float = 0.75, *, id_col: str = "doc_id", sigs: str = "sigs") -> DataFrame:
    """Pairs (a < b, similarity) of distinct fingerprints with at least that likeness, each named by its smallest id; copies are joined by `sigs`.

    Sets are partitioned by length: partition p holds the sizes from t^-p up to t^-(p+1), so that a set can only match sets of
    its own partition and its two neighbours, and visits the one above. Within a partition only the floor(n - n*t) + 1 rarest
    signatures of a set are joined, one of which two matches must share; those of several sets are told from others first.
    """
    sets = saved(prints.groupBy(sigs).agg(F.min(id_col).alias("id")).select("id", F.col(sigs).alias("s"), F.size(sigs).alias("n")))
    rarity = saved(sets.select(F.explode("s").alias("sig")).groupBy("sig").agg(F.count("*").alias("df")))
    each = sets.select("id", "n", F.explode("s").alias("sig")).join(rarity, "sig")
    rarest = Window.partitionBy("id").orderBy("df", "sig")
    keys = each.withColumn("rank", F.row_number().over(rarest)).filter(F.col("rank") <= F.floor(F.col("n") * (1 - threshold)) + 1).filter("df > 1")
    # A thousandth more keeps sizes at a border on the safe side: they visit one partition too many.
    part = F.floor(F.log("n") / -math.log(threshold) * 1.001).cast("int")
    home = saved(keys.select("sig", "id", "n", part.alias("part")))
    visits = home.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
    a, b = visits.select("sig", "part", F.col("id").alias("a"), F.col("n").alias("na")), home.select("sig", "part", F.col("id").alias("b"), F.col("n").alias("nb"))
    met = a.join(b, ["sig", "part"]).filter((F.col("a") != F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").withColumn("similarity", likeness(F.col("sa"), F.col("sb"))).filter(F.col("similarity") >= threshold).select("a", "b", "similarity")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_signatures(rows.withColumn("edited", edited), "edited", "edited_sigs")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sigs", "").alias("fingerprint"),
        F.array_join("edited_sigs", "").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
