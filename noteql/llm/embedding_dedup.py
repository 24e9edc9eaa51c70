"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import each_piece, group_bounds, pieces
from .common import materialize, read
from .components import connected_components

THRESHOLD = 0.98
RECALL = 0.9999
SEED = 42


def layout(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): as many sign bits as the count has, so that unrelated vectors seldom meet, and enough tables
    that a pair exactly at the threshold meets in one of them with probability ``recall``."""
    bits = max(12, math.ceil(math.log2(max(2, count))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - together))


def signatures(vectors: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """One signed integer for each vector and table: the signs of ``bits`` random projections."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal((vectors.shape[1], tables * bits))
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return (signs.astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(2)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): rows that can link, as doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0.0)
    return vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad & some).select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.transform(v, lambda x: F.when(x == 0.0, 0.0).otherwise(x)).alias("v"))


def near_duplicates(vectors: DataFrame, id_col="vec_id", vector_col="embedding", label_col="label", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links and component_id for each row.

    Rows link if their labels are equal and not null, their vectors have one length and their cosine in double
    precision is at least ``threshold``. Null and zero vectors and those with a null or non-finite component link with
    nothing. Equal vectors of one label are one node with a multiplicity, so copies are counted but never paired; a
    repeated row is a vector of its own. A row without vec_id carries links, but is not the name of a component. Buckets of any size
    are cut into pieces; a pair found in several tables counts in the first only. An empty table gives an empty result.
    """
    rows = materialize(usable(vectors, id_col, vector_col, label_col))
    nodes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # 128 bits of the content name a node.
    named = F.concat(F.xxhash64(F.lit(1), "label", "v").cast("string"), F.lit(":"), F.xxhash64(F.lit(2), "v", "label").cast("string"))
    nodes = materialize(nodes.withColumn("node", named))
    bits, tables = layout(nodes.count(), threshold, recall)

    def sign(batches):
        for b in batches:
            values = b.column(2).to_pylist()
            found: list = [None] * len(values)
            for size in {len(v) for v in values}:
                at = [k for k, v in enumerate(values) if len(v) == size]
                for k, s in zip(at, signatures(unit(np.array([values[k] for k in at], float)), bits, tables)):
                    found[k] = s
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(found, pa.list_(pa.int64()))], ["node", "label", "v", "copies", "s"])

    signed = materialize(nodes.select("node", "label", "v", "copies").mapInArrow(sign, "node string, label string, v array<double>, copies long, s array<long>"))
    keyed = signed.select("label", F.size("v").alias("dim"), "node", F.posexplode("s").alias("t", "key"))
    met = pieces(keyed, ["label", "dim", "t", "key"], "node").join(signed.select("node", "v", "copies", "s"), "node")

    def verify(table: pa.Table):
        bounds = group_bounds(table.column("gid").to_numpy())
        nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
        t, copies = table.column("t").to_numpy(), table.column("copies").to_numpy()
        vectors = table.column("v").combine_chunks()
        sizes = np.diff(vectors.offsets.to_numpy())
        s = table.column("s").combine_chunks().flatten().to_numpy().reshape(-1, tables)
        flat, at = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        side = (table.column("p").to_numpy() == table.column("i").to_numpy(), table.column("p").to_numpy() == table.column("j").to_numpy())
        counts: dict = {}
        links = set()
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            # Pairs of groups whose hashes collide are held apart by label, size and table.
            if len(set(labels[lo:hi])) > 1 or len(set(sizes[lo:hi])) > 1 or len(set(t[lo:hi])) > 1:
                kinds = sorted(set(zip(labels[lo:hi], sizes[lo:hi], t[lo:hi])))
                rows = [[k for k in range(lo, hi) if (labels[k], sizes[k], t[k]) == kind] for kind in kinds]
            else:
                rows = [np.arange(lo, hi)]
            for r in map(np.asarray, rows):
                x = unit(np.stack([flat[at[k] : at[k + 1]] for k in r]))
                ia, ib = np.flatnonzero(side[0][r]), np.flatnonzero(side[1][r])
                hits = np.argwhere(x[ia] @ x[ib].T >= threshold - 1e-9)
                a, b = ia[hits[:, 0]], ib[hits[:, 1]]
                # The verdict is by one formula, whatever pieces the pair met in.
                keep = r[a] < r[b] if len(ia) == len(r) == len(ib) else a != b
                a, b = a[keep], b[keep]
                keep = np.einsum("nd,nd->n", x[a], x[b]) >= threshold
                a, b = r[a[keep]], r[b[keep]]
                first = np.concatenate([(s[a[k : k + (1 << 14)]] == s[b[k : k + (1 << 14)]]).argmax(1) == t[r[0]] for k in range(0, len(a), 1 << 14)] or [np.empty(0, bool)])
                a, b = a[first], b[first]
                n = np.bincount(a - lo, copies[b], hi - lo) + np.bincount(b - lo, copies[a], hi - lo)
                for k in np.flatnonzero(n):
                    counts[nodes[lo + k]] = counts.get(nodes[lo + k], 0) + int(n[k])
                root = np.arange(hi - lo)
                for y, z in zip((a - lo).tolist(), (b - lo).tolist()):
                    if root[y] != root[z]:
                        links.add((nodes[lo + y], nodes[lo + z]))
                        root[root == root[z]] = root[y]
        rows = [(k, n, None) for k, n in counts.items()] + [(a, 0, b) for a, b in links]
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.string()))], ["node", "n", "other"])

    found = materialize(each_piece(met, ["label", "dim", "t", "key"], verify, "node string, n long, other string"))
    number = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    # Components are of nodes, as a node without a vec_id carries links too.
    comp = connected_components(found.where("other is not null").select("node", "other"), "node", "other")
    classes = materialize(nodes.select("node", "least", "copies").join(number, "node", "left").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    # Tables on both sides, so that adaptive execution may split a large component, and the copies of one vector.
    of = materialize(classes.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = classes.join(of, "component").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = rows.select("vec_id", named.alias("node")).join(materialize(classes), "node").select("vec_id", "n_links", "component_id")
    v = F.col(vector_col).cast("array<double>")
    rest = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    bad = F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(True)) | F.col("label").isNull() | ~F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False))
    return linked.unionByName(rest.where(bad).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
 r(vec_id, near) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.near = l.x),
 c AS (SELECT vec_id, min(near) AS component_id FROM r GROUP BY vec_id)
 SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c ON c.vec_id = e.vec_id"""
