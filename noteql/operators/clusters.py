"""Exact nearest neighbours that read few vectors: clusters with bounds.

Vectors are kept by the nearest of a bounded number of centres, and of each cluster the widest angle of a member to its
centre. A member's angle to a query is at least the centre's less that width, so a cluster whose bound is below the
k-th similarity found so far holds no neighbour and is not read. Centres shape the cost alone, never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import acos, cos, isfinite, isqrt

import numpy as np
import pandas as pd
from noteql.operators.vectors import similarity
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Centres of a model at most, the vectors they are fitted on (those of least hash of their ids), and the rounds of it.
CENTRES, SAMPLE, ROUNDS = 256, 8192, 4
#: Clusters of vectors that have no direction (null, of no length, of another dimension than the centres), which are
#: like nothing, and of those with missing, infinite or extreme values, which are always read.
FLAT, ODD = -1, -2
#: Added to bounds, for the rounding of angles.
SLACK = 1e-6


def _plain(x: np.ndarray) -> bool:
    """Whether a vector has a direction and can be squared."""
    return bool(np.isfinite(x).all()) and 1e-150 < np.abs(x).max(initial=0.0) < 1e150


def fit(vectors: DataFrame, centres: int = CENTRES, sample: int = SAMPLE) -> np.ndarray:
    """Centres of unit length, at most the root of the sample's size of them, by rounds of means of nearest vectors."""
    rows = vectors.where(F.col("vector").isNotNull() & (F.size("vector") > 0)).select("note_id", "vector").orderBy(F.xxhash64("note_id"), "note_id").limit(sample).collect()
    found = [r.vector for r in rows if _plain(np.asarray(r.vector, float))]
    if not found:
        return np.zeros((0, 0))
    sizes = pd.Series([len(v) for v in found]).mode()
    x = np.array([v for v in found if len(v) == sizes[0]], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[: max(1, min(centres, isqrt(len(x))))].copy()
    for _ in range(ROUNDS):
        nearest = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    return c


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with their cluster and the cosine to its centre (null outside clusters)."""
    dimension = centres.shape[1]

    @F.pandas_udf("cluster int, cosine double")
    def place(column: pd.Series) -> pd.DataFrame:
        cluster, cosine = np.full(len(column), FLAT), np.full(len(column), np.nan)
        own = []
        for k, v in enumerate(column):
            x = None if v is None else np.asarray(v, float)
            if x is None:
                continue
            if x.any() and not _plain(x):
                cluster[k] = ODD
            elif len(x) == dimension and dimension and x.any():
                own.append(k)
        if own:
            x = np.array([column.iloc[k] for k in own], float)
            near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
            cluster[own], cosine[own] = near.argmax(1), near.max(1)
        return pd.DataFrame({"cluster": cluster, "cosine": pd.Series(cosine).where(~np.isnan(cosine), None)})

    out = vectors.withColumn("_p", place("vector"))
    return out.withColumn("cluster", F.col("_p.cluster")).withColumn("cosine", F.col("_p.cosine")).drop("_p")


def summary(rows: DataFrame) -> DataFrame:
    """(cluster, n, worst) of placed rows; ``worst`` is the least cosine to the centre. Summaries merge by sum and least."""
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("worst"))


@dataclass
class Clustered:
    """Vectors kept by cluster: ``read`` gives the rows (note_id, vector, cluster) of some clusters, or of all for None;
    ``known`` are (cluster, n, worst, centre), at most CENTRES and two."""

    read: Callable[[list[int] | None], DataFrame]
    known: list[tuple[int, int, float | None, list[float] | None]]

    def bounds(self, query: list[float]) -> dict[int, float] | None:
        """What the similarity of a member can be at most; None if the query's dimension is not the centres'."""
        q = np.array(query, float)
        size = float(np.linalg.norm(q))
        out = {}
        for cluster, _, worst, centre in self.known:
            if cluster == ODD:
                out[cluster] = float("inf")
            elif cluster == FLAT or size == 0:
                out[cluster] = 0.0
            elif centre is None or len(centre) != len(q) or not isfinite(size):
                return None
            else:
                angle = acos(min(1.0, max(-1.0, float(np.dot(centre, q)) / size)))
                width = acos(min(1.0, max(-1.0, 1.0 if worst is None else worst)))
                out[cluster] = max(0.0, cos(max(0.0, angle - width))) + SLACK
        return out

    def scan(self, clusters: list[int] | None, query: list[float]) -> DataFrame:
        return self.read(clusters).select("note_id", similarity(F.col("vector"), query).alias("similarity"))

    def nearest(self, query: list[float], k: int) -> DataFrame:
        """(note_id, similarity) of the k nearest, as a scan of all gives them, ties by id. Two reads: the clusters of the
        best bounds that hold k vectors, then those whose bound reaches the k-th of these, if any."""
        best = lambda df: df.orderBy(F.col("similarity").desc(), "note_id").limit(k)
        bounds = self.bounds(query)
        if bounds is None or not bounds or k <= 0:
            return best(self.scan(None, query))
        members = {c[0]: c[1] for c in self.known}
        order, first, held = sorted(bounds, key=lambda c: (-bounds[c], c)), [], 0
        for c in order:
            if held >= k and bounds[c] != float("inf"):
                break
            first.append(c)
            held += members[c]
        near = best(self.scan(first, query))
        found = near.collect()  # k rows
        rest = [c for c in order if c not in first and (len(found) < k or bounds[c] >= found[-1].similarity)]
        known = near.sparkSession.createDataFrame(found, near.schema)
        return best(known.unionByName(self.scan(rest, query))) if rest else best(known)

    def looked_at(self, query: list[float], worst: float) -> list[int]:
        """The clusters that may hold a vector of at least this similarity."""
        bounds = self.bounds(query)
        return [c[0] for c in self.known] if bounds is None else [c for c, b in bounds.items() if b >= worst]


def load(known: DataFrame, read: Callable[[list[int] | None], DataFrame]) -> Clustered:
    """From a table of (id, n, worst, centre), one row a cluster."""
    return Clustered(read, [(r.id, r.n, r.worst, r.centre) for r in known.select("id", "n", "worst", "centre").collect()])


def described(counted: DataFrame, centres: np.ndarray, before: DataFrame | None = None) -> DataFrame:
    """A summary, merged with that of earlier rows, with the centres beside it: (id, n, worst, centre), at most CENTRES
    and two rows. Of rows that went the counts and widths stay, which are then too great, and bounds hold."""
    merged: dict[int, tuple[int, float | None]] = {c: (0, None) for c in range(len(centres))}
    if before is not None:
        merged |= {r.id: (r.n, r.worst) for r in before.collect()}
    for r in counted.collect():
        n, worst = merged.get(r.cluster, (0, None))
        merged[r.cluster] = n + r.n, r.worst if worst is None or r.worst is not None and r.worst < worst else worst
    rows = [(int(c), int(n), worst, centres[c].tolist() if c >= 0 else None) for c, (n, worst) in sorted(merged.items())]
    return counted.sparkSession.createDataFrame(rows, "id int, n long, worst double, centre array<double>")
