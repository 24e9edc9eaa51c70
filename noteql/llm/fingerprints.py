"""Document fingerprints: bottom-k sketches of word-shingle hashes, by DataFrame functions alone.

A sketch is the sorted array of the k least distinct hashes of a text's five-word shingles (fewer words: of the whole
sequence; no words: empty). Sketches of parts merge into that of the whole, and estimate resemblance, containment and
the number of distinct shingles; below k shingles they are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NULL_ID, materialize, partitions, read

K = 128
SHINGLE = 5
#: Documents whose ids agree but for so many low bits are a block.
BLOCK_BITS = 8
SPLIT = "[\\x20\\x09-\\x0D]+"


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once for an expression that uses it many times."""
    return F.transform(F.array(value), use)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """Bottom-k sketch (array of long) of a text column; null counts as empty. Hashes are xxhash64 of word hashes."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")
    ids = F.transform(words, lambda w: F.xxhash64(w))

    def hashes(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*[h[i + j] for j in range(shingle)]))
        return F.when(F.size(h) >= shingle, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))

    return F.slice(F.sort_array(F.array_distinct(_bind(ids, hashes))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(sketches: DataFrame, key_cols: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key: hashes of all parts, distinct and the least k by rank. Parts with null sketches add
    nothing. No part is gathered whole: distinct hashes are ranked within a salt first, and k of each salt go on."""
    h = sketches.select(*key_cols, F.explode(sketch_col).alias("h")).distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    for keys in ([*key_cols, "salt"], key_cols):
        h = h.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).where(F.col("rank") <= k)
    return h.groupBy(*key_cols).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness, 0 to 1: of the k least hashes of the union, the share that both have. Two empty
    sketches are alike (1.0)."""

    def share(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))

    return _bind(merged(a, b, k), share)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range."""
    place = (s[k - 1].cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; an empty a is contained in anything."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def shown(s: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.lower(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def successors(values: DataFrame, col: str) -> DataFrame:
    """(col, next) for every distinct non-null value: the next greater one, the least after the greatest."""
    spark = values.sparkSession
    spread = values.select(col).where(F.col(col).isNotNull()).distinct().repartitionByRange(partitions(spark), col)
    spread = materialize(spread.withColumn("part", F.spark_partition_id()))
    following = spread.withColumn("next", F.lead(col).over(Window.partitionBy("part").orderBy(col)))
    # One row a partition.
    order = Window.orderBy("part")
    heads = spread.groupBy("part").agg(F.min(col).alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"))
    return following.join(heads, "part").select(col, F.coalesce("next", "head").alias("next"))


def against_edits(docs: DataFrame, id_col="doc_id", text_col="text", k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, or
    all it has. Rows follow each other by doc_id, null first, then by text, so repeated rows are neighbours; after the
    last comes the first, so a lone row follows itself. Null texts count as empty. An empty table gives an empty
    result; other columns are not looked at. Texts are shuffled once, by block of neighbouring ids; only the last row
    of a block looks for its successor elsewhere.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    d = d.withColumn("block", F.shiftright("id", BLOCK_BITS))
    w = Window.partitionBy("block").orderBy("id", "t")
    led = d.withColumn("rank", F.row_number().over(w)).withColumn("u", F.lead("t").over(w))

    def edited(n) -> Column:
        half = F.floor(n / 2).cast("int")
        return F.concat(F.left("t", n - half), F.left("u", half))

    def sketched(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("n", F.char_length("t")).withColumn("e", edited(F.col("n")))
        rows = rows.withColumn("s", sketch(F.col("t"), k, shingle)).withColumn("es", sketch(F.col("e"), k, shingle))
        return rows.withColumn("sha", F.sha2("e", 256)).drop("t", "u", "e")

    inner = sketched(led).withColumn("us", F.lead("s").over(Window.partitionBy("block").orderBy("id", "rank"))).where(F.col("sha").isNotNull())
    nexts = successors(d, "block")
    heads = led.where("rank = 1").select(F.col("block").alias("next"), F.col("t").alias("u"), sketch(F.col("t"), k, shingle).alias("us"))
    tails = led.where("u is null").drop("u").join(nexts, "block").join(heads, "next")
    both = inner.unionByName(sketched(tails).select(inner.columns))
    return both.select(
        F.nullif("id", F.lit(NULL_ID)).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        shown(F.col("s")).alias("fingerprint"),
        shown(F.col("es")).alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("es"), k).alias("near_edited"),
        resemblance(F.col("s"), F.col("us"), k).alias("near_next"),
    )


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edits(read(spark, sf_dir, "documents"))
