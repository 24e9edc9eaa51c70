"""Nearest neighbours by clusters are those of a scan, and read what may hold them."""

import math
import os

import numpy as np
import pytest
from noteql.operators import clusters, vectors
from noteql.streaming import incremental
from pyspark.sql import functions as F


def catalog_of(spark, path, v, parts=4):
    c = incremental.Catalog(spark, path, parts=parts)
    centres = clusters.fit(v)
    near = clusters.placed(v.withColumn("model", F.lit("m")), centres)
    c.commit({"near": near, "clusters": clusters.described(clusters.summary(near), centres).withColumn("model", F.lit("m")).withColumn("part", F.lit(0))})
    return c, incremental.kept_vectors(c, "m")


def rows(df):
    return [(r.note_id, "nan" if math.isnan(r.similarity) else round(r.similarity, 9)) for r in df.collect()]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(9, 12))
    x = heads[rng.integers(0, 9, 900)] + rng.normal(scale=0.15, size=(900, 12))
    data = [(f"n{k:04}", [float(np.float32(y)) for y in v]) for k, v in enumerate(x)]
    data += [(f"twin{k}", data[5][1]) for k in range(6)]  # ties
    return spark.createDataFrame(data, "note_id string, vector array<float>"), data


def test_neighbours_are_those_of_a_scan_from_few_clusters(spark, blobs, tmp_path):
    v, data = blobs
    c, kept = catalog_of(spark, str(tmp_path / "c"), v)
    asked: list = []
    counted = clusters.Clustered(lambda some: asked.append(some) or kept.read(some), kept.known)
    for k, query in ((1, data[5][1]), (4, data[5][1]), (40, data[77][1]), (25, [1.0, -1.0] * 6)):
        assert rows(vectors.knn(counted, query, k)) == rows(vectors.knn(v, query, k))
    assert all(some is not None for some in asked)
    looked = sum(n for cl, n, *_ in kept.known if cl in set(asked[0]))
    assert looked < len(data) / 3, "a look-up among clear clusters reads few"
    assert rows(vectors.knn(counted, data[0][1], 2000)) == rows(vectors.knn(v, data[0][1], 2000))
    files = kept.read([kept.known[0][0]]).inputFiles()
    assert 0 < len(files) < len(c.table("near").inputFiles()), "other parts are not opened"
    assert rows(vectors.related(counted, "n0003", 5, of=v)) == rows(vectors.related(v, "n0003", 5)) == rows(vectors.related(kept, "n0003", 5))


def test_odd_vectors(spark, blobs, tmp_path):
    """Null, zero, other dimensions, missing, infinite and extreme values, and queries of each kind."""
    v, data = blobs
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 12, [1.0, 2.0], [], [None] + [1.0] * 11, [nan] * 12, [inf] + [0.0] * 11, [1e200] * 12, [1e-200] * 12, [-x for x in data[5][1]]]
    every = v.select("note_id", F.col("vector").cast("array<double>")).unionByName(spark.createDataFrame([(f"odd{k}", x) for k, x in enumerate(odd)], "note_id string, vector array<double>"))
    _, kept = catalog_of(spark, str(tmp_path / "c"), every)
    for query in (data[5][1], [0.0] * 12, [3.0, 1.0], [1e-3] + [0.0] * 11):
        for k in (3, 20):
            assert rows(vectors.knn(kept, query, k)) == rows(vectors.knn(every, query, k))
    empty = every.limit(0)
    _, none = catalog_of(spark, str(tmp_path / "e"), empty)
    assert rows(vectors.knn(none, data[0][1], 3)) == [] and clusters.fit(empty).shape == (0, 0)
    _, flat = catalog_of(spark, str(tmp_path / "f"), every.where("note_id in ('odd0', 'odd1')"))
    assert rows(vectors.knn(flat, data[0][1], 3)) == [("odd0", 0.0), ("odd1", 0.0)]


def test_a_workspace_keeps_its_clusters(spark, tmp_path):
    from noteql.api import Workspace

    root = str(tmp_path / "v")
    os.makedirs(root)

    def put(name, text):
        with open(os.path.join(root, name + ".md"), "w") as f:
            f.write(text)

    words = ["sea ship sail", "oven bread flour", "code test merge"]
    for k in range(12):
        put(f"n{k:02}", f"{words[k % 3]} w{k}")
    w = Workspace(spark, root, embedder=vectors.hashing_embedder(64))
    w.reindex()
    same = lambda: {k: rows(vectors.knn(w._vectors(), w.embedder(q), k)) == rows(vectors.knn(w.catalog.table("vectors"), w.embedder(q), k, model="hashing")) for k, q in ((3, "sea ship"), (9, "bread code"))}
    near = lambda: sorted((r.note_id, r.cluster) for r in w.catalog.table("near").collect())
    placed = lambda: sorted((r.note_id, r.placed) for r in w.catalog.table("vectors").collect())
    assert all(same().values()) and near() == placed() and len(near()) == 12
    before = w.catalog._pointer()["tables"]["near"]["parts"]
    put("n03", "oven bread of another kind")
    assert w.reindex() == {"update": 1}
    after = w.catalog._pointer()["tables"]["near"]["parts"]
    assert all(same().values()) and near() == placed() and len(near()) == 12
    assert any(before.get(p) == f for p, f in after.items()), "clusters that nothing left or entered stay as they are"
    put("new", "merge of code")
    os.remove(os.path.join(root, "n04.md"))
    assert w.reindex() == {"add": 1, "remove": 1} and all(same().values()) and near() == placed() and len(near()) == 12
    for k in range(60):
        put(f"m{k:02}", f"{words[k % 3]} x{k}")
    w.reindex()
    assert all(same().values()) and near() == placed() and len(near()) == 72 and w.catalog.note("models")["hashing"]["fitted"] == 72
    other = Workspace(spark, root, embedder=vectors.hashing_embedder(32), model="small")
    assert other.reindex(force=True) and rows(vectors.knn(other._vectors(), other.embedder("sea ship"), 4)) == rows(vectors.knn(other.catalog.table("vectors"), other.embedder("sea ship"), 4, model="small"))
    assert all(same().values()), "another model's vectors stay beside them"
    assert w.search("sea ship", "semantic").count() > 0 and w.search("sea ship", "hybrid").count() > 0
