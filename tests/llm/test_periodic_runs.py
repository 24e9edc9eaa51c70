"""Runs against a search of all places and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from noteql.llm import periodic_runs
from pyspark.sql import functions as F


def brute(w, least, exponent):
    found = {}
    n = len(w)
    for q in range(1, n // exponent + 1):
        x = 0
        while x + q < n:
            y = x
            while y + q < n and w[y] == w[y + q]:
                y += 1
            if y > x and y + q - x >= max(least, exponent * q):
                found.setdefault((x, y + q), q)
            x = max(y, x + 1) if y > x else x + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def sentence(rnd, n, letters):
    """Letters at random, with repetitions and copies of earlier stretches."""
    w = []
    while len(w) < n:
        kind = rnd.random()
        if kind < 0.3 and w:
            s = rnd.randrange(len(w))
            w += w[s : s + rnd.randint(1, 60)]
        elif kind < 0.6:
            w += [rnd.choice(letters) for _ in range(rnd.randint(1, 9))] * rnd.randint(1, 9)
        else:
            w += [rnd.choice(letters) for _ in range(rnd.randint(1, 20))]
    return w[:n]


@pytest.mark.parametrize("least, exponent", [(2, 2), (6, 2), (24, 3), (5, 3), (9, 4)])
def test_all_runs_are_found(least, exponent):
    rnd = random.Random(least)
    docs = [sentence(rnd, rnd.randint(0, 260), "abcdefghijklmnop"[: rnd.choice([1, 2, 3, 16])]) for _ in range(250)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    docs += [list(fib[-1]), list("a" * 500), list("ab" * 200), list("aab" * 90 + "aab" * 90), [], ["a"], ["a"] * 2, docs[3], docs[3]]
    assert periodic_runs.runs_of(docs, least, exponent) == [brute(d, least, exponent) for d in docs]


def test_previous_factors():
    rnd = random.Random(1)
    w = sentence(rnd, 300, "abc")
    code = np.array([ord(c) for c in w] + [1000])
    ranks, sa = periodic_runs.suffix_ranks(np.zeros(301, np.int64), code)
    assert sa.tolist() == sorted(range(301), key=lambda i: code[i:].tolist())
    length, source = periodic_runs.previous_factors(ranks, sa)

    def same(i, j):
        k = 0
        while max(i, j) + k < 300 and w[i + k] == w[j + k]:
            k += 1
        return k

    for i in range(300):
        assert length[i] == max((same(i, j) for j in range(i)), default=0)
        assert not length[i] or source[i] < i and same(i, source[i]) == length[i]
        back = periodic_runs.agreement(ranks, np.array([i]), np.array([300 - i]), back=True)[0]
        assert i == 150 or back == next(k for k in range(301) if k >= min(i, 300 - i) or w[i - 1 - k] != w[299 - i - k])


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 24, 3)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join("%d,%d,%d\n" % r for r in sorted(runs, key=lambda r: (r[0], r[2])))
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha(listed.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, " ".join(sentence(rnd, rnd.randint(0, 200), ["la", "é", "x y", "\x1c"]))) for i in range(150)]
    rows += [(None, "a " * 30), (200, None), (201, ""), (202, " \n\t"), (3, "twice " * 40), (3, "twice " * 40), (204, "a b c\x0bd " * 30), (205, "one")]
    rows += [(300, " ".join(f"w{rnd.randrange(3000)}" for _ in range(2000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("n_runs", F.lit(None).cast("int"))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r.n_runs for r in got.collect()) > 50


def test_operator(spark):
    df = spark.createDataFrame([(1, "so " + "ha ha ho " * 9 + "end", "k"), (2, None, None)], "doc_id long, text string, runs string")
    got = {r.doc_id: r for r in periodic_runs.find_runs(df).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 27, 3)] and got[1].collapsed_text == "so ha ha ho end" and got[1].n_words == 29
    assert got[2].runs == [] and got[2].collapsed_text == "" and got[2].n_words == 0
    assert periodic_runs.find_runs(df, keep=["runs", "doc_id"]).columns == ["doc_id", "n_words", "runs", "collapsed_text"]
    squares = periodic_runs.find_runs(df, least=2, exponent=2).where("doc_id = 1").first().runs
    assert [tuple(r) for r in squares] == brute(("so " + "ha ha ho " * 9 + "end").split(), 2, 2)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, exponent=1)


def test_long_document():
    rnd = random.Random(2)
    block = [rnd.randrange(500) for _ in range(1000)]
    w = [rnd.randrange(30000) for _ in range(150_000)] + block * 40 + [rnd.randrange(30000) for _ in range(50_000)]
    (s, length, q), = periodic_runs.runs_of([w])[0]
    assert q == 1000 and length >= 40_000 and s <= 150_000
