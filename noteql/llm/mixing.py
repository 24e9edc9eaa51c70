"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts.

Rows of a null source form a source of their own, last in order; a null text has no words. Rows are ordered by a hash
of (doc_id, text), so the mix is the same whatever order the rows come in. Rows equal in both are separate candidates
that tie: which of them the cut falls on is open, but together they give the same rows in every run. Texts may be of
any length, as only their hash and size are kept. An empty table gives an empty result. Other columns of the input are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, kept_columns, materialize, partitions, read

#: Weights dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
OWN = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target), by water filling.

    The i-th source by code point, null last, weighs ``weights[i % len(weights)]``. A target stops at ``epochs`` times
    its source's size and the excess goes to the others by weight until none is above: that fixed point is
    ``least(cap, level * weight)``, whose level follows from prefix sums over the sources in order of cap / weight.
    One row a source passes here, none a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(rest))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def mix_sources(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs``; the columns named in ``keep`` come first in
    the place of doc_id, if any are; one that is named like a result gives way to it.

    Each source is passed over ``floor(target / source_size)`` times whole; of the rest, rows are taken by ascending
    hash key until the running sum of sizes meets the budget, where the last row is cut to the words still wanted.
    Running sums come in two steps: ranges of (source, key) are summed apart, and each range starts from the sum of
    the ranges before it, so one source of any size is spread over many tasks. Texts are read twice if columns are
    kept, for the sums of the ranges and for the result, and once if not, as sizes and keys are then written out.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("key"),
        F.struct(*(kept_columns(keep, OWN) or [F.col(id_col).alias("doc_id")])).alias("rest"),
    )
    rows = rows if keep else materialize(rows)
    # The keys are uniform, so equal ranges of them hold equal shares of a source, and no sampling need find them.
    ranges = partitions(spark)
    dealt = rows.withColumn("part", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * ranges).cast("int"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(dealt.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, epochs)
    starts = sums.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    # One row a source and range of keys.
    known = starts.alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "part", "start", "source_size", "target")
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("above", F.coalesce(F.sum("size").over(within), F.lit(0)))
    out = summed.alias("r").join(known.alias("k"), (F.col("r.part") == F.col("k.part")) & F.col("r.source").eqNullSafe(F.col("k.source")))
    budget = F.floor(F.col("target") + 1e-6)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - passes * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start") - F.col("above")))
    return out.select("rest.*", "size", "source_size", "target", (passes * F.col("size") + partial).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))
