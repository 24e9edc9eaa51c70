"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, src="src", dst="dst") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable. Null ends are ignored.

    Alternates large-star and small-star steps until the links are stars around the smallest nodes, in about the
    logarithm of the number of nodes. Minima of neighbours are aggregated before they are shuffled; the links of a node
    meet its minimum in one task, as a minimum is no plain exchange that adaptive execution could split; every step is
    written to the shared folder.
    """
    e = links.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).where(F.col("hi") != F.col("lo")).distinct()
    e = materialize(e)
    while True:
        large = _star(e, both=True)
        small = materialize(_star(large, both=False))
        changed = small.join(e, ["hi", "lo"], "left_anti").limit(1).count() or e.join(small, ["hi", "lo"], "left_anti").limit(1).count()
        e = small
        if not changed:
            break
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def _star(e: DataFrame, both: bool) -> DataFrame:
    """Link neighbours to the smallest node around them: larger neighbours (both) or the smaller ones and the node."""
    out = e.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    ends = out.unionByName(e.select(F.col("lo").alias("node"), F.col("hi").alias("near"))) if both else out
    least = ends.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m"))
    met = ends.join(least, "node")
    if both:
        moved = met.where(F.col("near") > F.col("node")).select(F.col("near").alias("hi"), F.col("m").alias("lo"))
    else:
        moved = met.where(F.col("near") != F.col("m")).select(F.col("near").alias("hi"), F.col("m").alias("lo"))
        moved = moved.unionByName(least.select(F.col("node").alias("hi"), F.col("m").alias("lo")))
    return moved.where(F.col("hi") != F.col("lo")).distinct()


def find(parent: dict, x):
    """Root of ``x`` in a union-find forest, with path halving."""
    while (p := parent.get(x, x)) != x:
        parent[x] = x = parent.get(p, p)
    return x
