"""Groups of rows that share a key, cut into pieces of bounded size so that no task holds a whole hot group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

#: Rows of one piece. A task holds two pieces at most.
PIECE = 1024


def pieces(keyed: DataFrame, key: list[str], row: str, piece: int = PIECE, least: int = 2) -> DataFrame:
    """Rows of ``keyed`` (key columns, a ``row`` identifier, unique in its group, and any more) whose group has at
    least ``least`` rows, with columns ``i`` and ``j``: a group of n rows falls into c = ceil(n / piece) parts by hash, and
    part p appears in the pairs of parts (i, j), i <= j, that it belongs to, as side 0 and 1. Every two rows of a group
    meet in at least one pair; the pairs of one large group go to different tasks. The counts are a table of their own,
    so that adaptive execution may split their join with the rows of a hot key.
    """
    counts = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("group_n")).where(F.col("group_n") >= least)
    met = keyed.join(materialize(counts), key)
    parts = F.ceil(F.col("group_n") / F.lit(piece)).cast("int")
    met = met.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64(F.lit(7), row), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    met = met.withColumn("q", F.explode(others))
    return met.withColumn("i", F.least("p", "q")).withColumn("j", F.greatest("p", "q")).drop("group_n", "parts", "q")


def each_piece(met: DataFrame, key: list[str], work, schema: str) -> DataFrame:
    """Run ``work`` over the pairs of pieces that ``pieces`` made. It gets an Arrow table of many whole pairs, sorted
    by column ``gid``, a hash of the group's key and the pair, and returns record batches; a table has one batch and
    the rest of one pair, so memory is bounded. Groups whose hashes collide come as one, which ``work`` must bear."""
    spark = met.sparkSession
    dealt = met.withColumn("gid", F.xxhash64(*key, "i", "j")).repartition(partitions(spark), "gid").sortWithinPartitions("gid")

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            gid = t.column("gid").to_numpy()
            if not len(gid):
                continue
            cut = int(np.searchsorted(gid, gid[-1]))
            held = t.slice(cut)
            if cut:
                yield from work(t.slice(0, cut))
        if held is not None and len(held):
            yield from work(held)

    return dealt.mapInArrow(run, schema)


def group_bounds(gid: np.ndarray) -> np.ndarray:
    """Where groups begin in a sorted array, and its length at the end."""
    return np.concatenate([[0], np.flatnonzero(gid[1:] != gid[:-1]) + 1, [len(gid)]])
