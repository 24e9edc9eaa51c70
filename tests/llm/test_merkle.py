"""The manifest against trees built in Python, with short blocks as with the production ones."""

import hashlib
import random
import zlib

import duckdb
import pytest
from noteql.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """The last hash, and each node's siblings with their sides."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for n, a in enumerate(at):
            other = a ^ 1
            paths[n].append((a % 2, nodes[other] if other < len(nodes) else ""))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], paths


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        done[g] = (own, *tree([leaf(r) for r in own]))
    root, above = tree([done[g][1] for g in names])
    out = []
    for g, more in zip(names, above):
        own, subroot, paths = done[g]
        for r, path in zip(own, paths):
            path = path + more
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            h = leaf((*r[:3], r[3] + 1, r[4])) if tampered else leaf(r)
            for bit, s in path:
                h = sha(s + h if bit else h + s)
            out.append((r[0], leaf(r), subroot, root, sha("".join(s for _, s in path)), h, h == root))
    return sorted(out, key=str)


ROWS = [(i, None if i % 9 == 0 else f"s{i % 3}", [None, "de", "en", "ünï", ""][min(4, i % 7)], None if i % 11 == 0 else i, None if i % 13 == 0 else "é " * (i % 5)) for i in range(75)]
ROWS += [(None, "s", "en", 1, "null id"), (None, "s", "en", 1, "null id"), (None, None, None, None, None), (3, "s", "en", 2, "same id"), (7, "s0", "one", 1, "x" * 300_000), (5, "s", "en", 5, "twice"), (5, "s", "en", 5, "twice")]


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest(spark, tmp_path, height, monkeypatch):
    rnd = random.Random(height)
    rows = rnd.sample(ROWS, len(ROWS))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit(1)).withColumn("idx", F.lit("x")).withColumn("leaf", F.lit(None).cast("int"))
    df.repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], height))
    got = merkle.op12_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_sql_says_the_same(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(con.sql(merkle.ORACLE).fetchall(), key=str) == expected(ROWS)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_few_rows(spark, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == n and all(r.verified and len(r.steps) == [0, 0, 1, 2][n] for r in got)
    if n == 1:
        assert got[0].root == got[0].leaf


def test_what_was_changed_is_found(spark):
    df = spark.createDataFrame([(i, "s", "ab"[i % 2], i, f"text {i}") for i in range(40)], SCHEMA)
    claimed = [F.col(c) for c in merkle.FIELDS]
    claimed[4] = F.when(F.col("doc_id") == 17, F.lit("text 71")).otherwise(F.col("text"))
    assert [r.doc_id for r in merkle.manifest(df, claimed=claimed).where("not verified").collect()] == [17]


def test_levels_of_a_block_share_an_exchange(spark):
    """Windows over more and more levels need no shuffle besides the one by block."""
    nodes = spark.range(3000).selectExpr("string(id % 1) g", "id idx", "3000L size", "sha2(string(id), 256) h")
    plan = merkle._climb(nodes, merkle.HEIGHT)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
