"""Every operator against brute force, on its production parameters and small awkward inputs."""

import hashlib
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from noteql.llm import bpe, components, embedding_dedup, fingerprints, language_id, licenses, line_dedup, mixing, simhash, substring_dedup, url_filter
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema="doc_id long, text string", parts=5):
    """Rows over several partitions, with an extra column whose name clashes with internal ones."""
    df = spark.createDataFrame(rows, schema).withColumn("shard", F.lit("x")).withColumn("kind", F.lit(None).cast("string"))
    return df.repartition(parts) if rows else df


def words(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def union(pairs, nodes):
    parent = {n: n for n in nodes}
    for a, b in pairs:
        a, b = components.find(parent, a), components.find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: components.find(parent, n) for n in nodes}


# Substring dedup


def removed(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        w = (t or "").encode().split()
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] != (i, p):
                gone.update(range(p, p + 20))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, hashlib.sha256(kept).hexdigest())] = (len(w), len(gone))
    return out


def test_substring_dedup(spark):
    rnd = random.Random(3)
    rows = [(i, words(rnd, rnd.randint(0, 90), rnd.choice([1, 2, 4]))) for i in range(120)]
    base = [words(rnd, 200) for _ in range(4)]
    for i in range(120, 300):
        b = rnd.choice(base).split()
        s = rnd.randint(0, 170)
        rows.append((i, f"x{i} " * rnd.randint(0, 25) + " ".join(b[s : s + rnd.randint(18, 60)]) + f" y{i}" * rnd.randint(0, 25)))
    rows += [(None, base[0]), (400, None), (401, ""), (-5, base[1]), (402, "\x1c\x85\u00a0one\ttwo\x0bthree"), (403, "long " + words(rnd, 30000, 5000)), (404, base[2]), (404, base[2])]
    got = substring_dedup.dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = removed(rows)
    for r in got:
        assert want[(r.doc_id, r.kept_sha256)] == (r.n_words, r.n_removed)
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert all(length >= 20 for _, length in r.factors) and sum(length for _, length in r.factors) == r.n_removed
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


# Document fingerprints


def shingles(t):
    w = (t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_against_the_edited_and_next_text(spark):
    rnd = random.Random(1)
    rows = [(i * rnd.choice([1, 700]), words(rnd, rnd.randint(0, 300))) for i in range(60)]
    rows = list(dict(rows).items()) + [(10**9, "same text here for all"), (10**9 + 1, "same text here for all"), (-7, None), (10**12, "é" * 33 + " 日本 " * 9)]
    got = {r.doc_id: r for r in fingerprints.against_edits(docs(spark, rows)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, u = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((got[i].near_edited, edited), (got[i].near_next, u)):
            exact = likeness(shingles(t), shingles(other))
            assert abs(value - exact) < 0.2 and (len(shingles(t) | shingles(other)) > fingerprints.K or abs(value - exact) < 1e-9)
    assert got[10**9].fingerprint == got[10**9 + 1].fingerprint
    one = fingerprints.against_edits(docs(spark, [(5, "a b c d e f")])).first()
    assert one.near_next == 1.0 and fingerprints.against_edits(docs(spark, [])).count() == 0


def test_sketches_merge_and_estimate(spark):
    rnd = random.Random(2)
    a, b = words(rnd, 3000, 10**6), words(rnd, 3000, 10**6)
    df = spark.createDataFrame([("x", a), ("x", b)], "k string, t string").withColumn("sketch", fingerprints.sketch(F.col("t")))
    merged = fingerprints.merge_sketches(df, ["k"]).first().sketch
    h = [sorted(r.sketch) for r in df.collect()]
    assert merged == sorted({*h[0], *h[1]})[: fingerprints.K]
    n = df.select(fingerprints.distinct_shingles(F.col("sketch"))).first()[0]
    assert abs(n - 2996) < 0.35 * 2996
    c = spark.createDataFrame([(" ".join(a.split()[:1500]), a)], "p string, q string").select(fingerprints.containment(fingerprints.sketch(F.col("p")), fingerprints.sketch(F.col("q")))).first()[0]
    assert c > 0.75


# SimHash


def test_simhash(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, rnd.randint(0, 30))) for i in range(100)]
    base = words(rnd, 300)
    for i in range(100, 260):
        w = base.split()
        for _ in range(rnd.randint(0, 12)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "One Two"), (303, "oNE  twO"), (304, rows[5][1]), (304, rows[5][1])]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fp = {r.doc_id: r.fp & (2**64 - 1) for r in got}
    assert fp[300] == fp[301] == 0 and fp[302] == fp[303]
    for i, t in rows[:5]:
        w = (t or "").lower().encode().split()
        s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        h = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(bytearray(x),) for x in s], "b binary").select(F.xxhash64("b")).collect()] if s else []
        assert fp[i] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    want = union([(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 4], fp)
    assert {r.doc_id: r.component_id for r in got} == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("count", [2, 1000, 10**6, 10**10])
def test_blocks_lose_no_pair(spark, count):
    blocks = simhash.layout(count)
    rnd = random.Random(count)
    pairs = []
    for _ in range(30):
        a = rnd.getrandbits(64)
        b = a
        for k in rnd.sample(range(64), 4):
            b ^= 1 << k
        pairs.append((a - 2**64 if a >> 63 else a, b - 2**64 if b >> 63 else b))
    df = spark.createDataFrame(pairs, "a long, b long")
    met = df.select(F.size(F.array_intersect(simhash.block_keys(F.col("a"), blocks), simhash.block_keys(F.col("b"), blocks))).alias("n"))
    assert met.where("n = 0").count() == 0


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, dtype=np.uint64)
    f = np.unique(np.array([base ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(200)], np.uint64))
    a, b = simhash.forest(f, 4)
    every = [(int(x), int(y)) for x, y in itertools.combinations(f, 2) if (int(x) ^ int(y)).bit_count() <= 4]
    nodes = [int(x) for x in f]
    assert len(a) < len(f) and union(zip(a.tolist(), b.tolist()), nodes) == union(every, nodes)


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist(), i % 3) for i in range(60)]
    for i in range(60, 200):
        v = np.array(rows[i % 4][1]) + rng.standard_normal(16) * 0.08
        rows.append((i, v.tolist(), rows[i % 4][2]))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, rows[0][1], 0), (206, rows[0][1], 0), (207, rows[0][1][:8], 0), (208, [], 0), (209, [float("inf")] * 16, 0), (210, (np.array(rows[0][1]) * 1e-200).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1)).repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    good = [(i, embedding_dedup.unit(np.array([v], float))[0], c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and any(v)]
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(good, 2) if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98]
    assert len(pairs) > 100
    want = union(pairs, got)
    for i, r in got.items():
        assert (r.n_links, r.component_id) == (sum(i in p for p in pairs), want[i])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_linked_by_a_row_without_id(spark):
    at = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]
    rows = [(2, at(10), 0), (None, at(19), 0), (1, at(28), 0), (3, at(90), 0), (None, at(200), 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(2, 1, 1), (None, 2, 1), (1, 1, 1), (3, 0, 3), (None, 0, None)], key=str)


def test_enough_tables_for_the_recall():
    for count in (10, 10**5, 10**10):
        bits, tables = embedding_dedup.layout(count)
        assert 1 - (1 - (1 - math.acos(0.98) / math.pi) ** bits) ** tables >= 0.9999


# URLs


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"),
        ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/", "allow"),
        ("http://www.example.net/en", "www.example.net", "/en", "net/", "block"),
        ("http://notexample.net/en/", "notexample.net", "/en/", "net/", "block"),
        ("https://b.example.com/de/?q", "b.example.com", "/de/", "example.com/de/", "block"),
        ("x://org/fr/#y", "org", "/fr/", "org/fr/", "allow"),
        ("http://a.net", "a.net", "", None, None),
        ("http://a.net?u=http://b.org/fr/", "a.net", "", None, None),
        ("no scheme", "", "", None, None),
        (None, "", "", None, None),
        ("http://ÀA.org/fr/\n", "Àa.org", "/fr/\n", "org/fr/", "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    h, p = url_filter.host_of(F.lit(url).cast("string")), url_filter.path_of(F.lit(url).cast("string"))
    assert spark.range(1).select(h, p, *url_filter.rule_of(h, p)).first()[:] == (host, path, rule, verdict)


def test_url_model_is_the_back_off_model(spark):
    rnd = random.Random(6)
    urls = ["^" + "".join(rnd.choices("abc/", k=rnd.randint(1, 9))) + "$" for _ in range(40)]
    rows = [(u, k % 3 > 0) for k, u in enumerate(urls)]
    value = {r.gram: r.value for r in url_filter.model(spark.createDataFrame(rows, "s string, good boolean")).collect()}
    count = ({}, {})
    for u, good in rows:
        for k in range(1, 5):
            for at in range(len(u) - k + 1):
                count[good][u[at : at + k]] = count[good].get(u[at : at + k], 0) + 1

    def p(side, context, c):
        n = count[side]
        if not context:
            return (n.get(c, 0) + 4 / 35) / (sum(v for g, v in n.items() if len(g) == 1) + 4)
        return (n.get(context + c, 0) + 4 * p(side, context[1:], c)) / (n.get(context, 0) + 4)

    for u in [*urls[:5], "^zzab$", "^aaaaaaaa$"]:
        exact = sum(math.log(p(1, u[max(0, k - 3) : k], u[k]) / p(0, u[max(0, k - 3) : k], u[k])) for k in range(len(u)))
        # A context that no known gram continues has its weight, so grams of the model suffice.
        assert abs(exact - sum(value.get(u[a:b], 0) for b in range(1, len(u) + 1) for a in range(max(0, b - 4), b))) < 1e-6


def test_url_filter(spark):
    rows = [(i, f"http://{'spam' if i % 2 else 'good'}{i % 9}.{'net' if i % 2 else 'org'}/{'fr'}/{i}") for i in range(80)] + [(100, "http://spam3.example/x"), (101, "http://good2.example/x"), (102, None), (103, "http://good2.example/x"), (None, "")]
    got = {r.page_id: r for r in url_filter.judge(docs(spark, rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and (got[100].verdict, got[101].verdict, got[103].verdict) == ("block", "allow", "allow")
    assert all(r.verdict == ("block" if i % 2 else "allow") for i, r in got.items() if i is not None and i < 80)
    # The threshold is as many standard deviations from both kinds of the held quarter, and decides what no rule does.
    held = {r.page_id for r in docs(spark, rows, "page_id long, url string").where(F.pmod(F.xxhash64(F.lit(5), F.coalesce("url", F.lit(""))), F.lit(4)) == 3).collect()}
    good, bad = (np.array([r.score for i, r in got.items() if i in held and r.rule and r.verdict == v]) for v in ("allow", "block"))
    even = (good.mean() * (bad.std() + 1e-9) + bad.mean() * (good.std() + 1e-9)) / (good.std() + bad.std() + 2e-9)
    assert len(good) > 3 and len(bad) > 3 and all(abs(r.threshold - even) < 1e-9 for r in got.values())
    assert all(r.verdict == ("block" if r.score < even else "allow") for r in got.values() if r.rule is None)
    # Repeated urls, and one of 200,000 characters, which takes time in proportion to its length.
    twice = url_filter.judge(docs(spark, rows + [(200, rows[-5][1]), (201, "http://spam3.net/" + "a/b" * 66_000)], "page_id long, url string")).collect()
    assert len(twice) == len(rows) + 2 and {r.verdict for r in twice if r.page_id == 201} == {"block"}
    assert len({(r.score, r.verdict) for r in twice if r.page_id in (100, 200)}) == 1
    few = url_filter.judge(docs(spark, [(1, "http://x.com/a")], "page_id long, url string")).first()
    assert few.verdict == "allow" and url_filter.judge(docs(spark, [], "page_id long, url string")).count() == 0


# BPE


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_path()
    library, rnd = Tokenizer.from_file(path), random.Random(7)
    parts = ["a", "aa", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "é", "ß", "日本", "😀", "1", "²", "'s", "'ll", "<|endoftext|>", "<|endo", "!!!", "$$$", "==", "\r\n", "ing", " un", "_"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(500)] + ["$" * n for n in range(40)] + ["ab" * 40, "x" * 3000, ""]
    rows = list(enumerate(texts)) + [(9000, None), (None, "no id")]
    got = bpe.encode(docs(spark, rows))
    want = {t: library.encode(t, add_special_tokens=False).ids for t in [*texts, "no id"]}
    by_id = {r.doc_id: r.ids for r in got.collect()}
    assert all(by_id[i] == want[t or ""] for i, t in rows)
    back = {r.doc_id: r.text for r in bpe.decode(got).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    for r in bpe.digests(docs(spark, rows[:50])).collect():
        assert r.n_tokens == len(by_id[r.doc_id]) and r.ids_sha256 == hashlib.sha256(",".join(map(str, by_id[r.doc_id])).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(by_id[r.doc_id], skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode(docs(spark, [])).count() == 0


def test_automaton_accepts_only_bpe():
    """Every pair of tokens that may follow each other is what BPE makes of their text, for a small vocabulary."""
    letters = {v: k for k, v in bpe.byte_letters().items()}
    base = [letters[b] for b in range(256)]
    merges = [("a", "b"), ("ab", "a"), ("a", "a"), ("aa", "aa"), ("b", "aa"), ("c", "ab"), ("aa", "b")]
    vocab = {s: i for i, s in enumerate([*base, *dict.fromkeys(x + y for x, y in merges)])}
    merges = [m for k, m in enumerate(merges) if "".join(m) not in ["".join(x) for x in merges[:k]]]
    automaton = bpe.Automaton(vocab, merges)

    def slow(text):
        parts = list(text)
        while True:
            pairs = [(merges.index((x, y)), k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if (x, y) in merges]
            if not pairs:
                return tuple(vocab[p] for p in parts)
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    for n in range(1, 9):
        for t in itertools.product("abc", repeat=n):
            assert automaton.encode_word("".join(t).encode()) == slow("".join(t))


# Licences


def test_licenses(spark):
    mit = "Copyright (c) 2020 X\n\n" + ":\n\n".join(licenses.SENTENCES["mit_grant"]) + ":\n\n" + licenses.SENTENCES["mit_notice"][0].replace(" shall", "\nshall") + ".\n\n" + licenses.SENTENCES["mit_as_is"][0] + "."
    bsd = ".\n".join([*licenses.SENTENCES["bsd_redist"], *licenses.SENTENCES["bsd_source"], *licenses.SENTENCES["bsd_binary"], "Neither the name of X " + licenses.SENTENCES["bsd_endorse"][0]]) + "."
    rows = [(1, mit), (2, bsd), (3, "a\nReleased under the MIT License.\nb"), (4, "This work is licensed under the GNU General Public License,\nversion 3. All rights reserved."), (5, None), (6, ""), (7, "The license of poetry. No warranty at all."), (8, bsd.replace("nor the", "nor some")), (None, "Licensed under CC BY-NC 4.0."), (9, "word " * 30000 + ". Licensed under the Apache License, Version 2.0.")]
    want = {1: ["MIT"], 2: ["BSD-3-Clause"], 3: ["MIT"], 4: ["GPL-3.0-only", "LicenseRef-All-Rights-Reserved"], 5: [], 6: [], 7: [], 8: ["BSD-2-Clause"], None: ["CC-BY-NC-4.0"], 9: ["Apache-2.0"]}
    # Under headings, in comments, before commas, with a stop within, wrapped, and ended too early.
    more = {
        20: ("MIT License\n" + mit.partition("\n\n")[2], ["MIT"]),
        21: ("Released under the MIT License, see LICENSE.", ["MIT"]),
        22: ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */", ["MPL-2.0"]),
        23: ("This work is dedicated to the public domain under CC0 1.0.", ["CC0-1.0"]),
        24: ("subject to the terms of the Mozilla Public License, v. 1.1", []),
        25: ("Permission is hereby granted. Free of charge, to any person", []),
        26: ("Licensed under\n\nthe MIT License", []),
        27: ("unlicensed under the MIT Licenses", []),
        28: ("# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Lesser General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.", ["LGPL-3.0-or-later"]),
        29: ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", ["GPL-2.0-only"]),
    }
    rows += [(k, t) for k, (t, _) in more.items()] + [(3, rows[2][1])]
    got = licenses.scan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.licenses for r in got} == want | {k: v for k, (_, v) in more.items()}
    assert licenses.scan(docs(spark, [])).count() == 0


def test_every_known_sentence_is_recognised(spark):
    known = [(name, s) for name, texts in licenses.SENTENCES.items() for s in texts]
    rows = [(k, f"Some words.\n\n{s}.\n\nMore words.") for k, (_, s) in enumerate(known)]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, rows)).collect()}
    assert [got[k].sentences for k in range(len(known))] == [[name] for name, _ in known]
    assert {x for _, ids in licenses.RULES for x in ids} == set(licenses.SENTENCES)


def brute_scan(text):
    """Sentences by going over all words, licences by going over all rules."""
    words_, names, k = licenses.normal(text or "").split(), [], 0
    while k < len(words_):
        here = [s for s in licenses.KNOWN if words_[k : k + len(s.split())] == s.split()]
        names += [licenses.KNOWN[max(here, key=len)]] if here else []
        k += len(max(here, key=len).split()) if here else 1
    left, found = names, set()
    for name, ids in sorted(licenses.RULES, key=lambda r: -len(r[1])):
        k = 0
        while k + len(ids) <= len(left):
            if left[k : k + len(ids)] == ids:
                left = left[:k] + [None] + left[k + len(ids) :]
                found.add(name)
            k += 1
    return names, sorted(found)


def test_licenses_against_brute_force_and_sql(spark):
    import duckdb
    import pandas as pd

    rnd = random.Random(12)
    every = [s for texts in licenses.SENTENCES.values() for s in texts]
    rows = []
    for i in range(300):
        parts = rnd.sample(every, rnd.randint(0, 4)) + [words(rnd, rnd.randint(0, 9)) for _ in range(rnd.randint(0, 3))]
        ids = rnd.choice(licenses.RULES)[1]
        parts += [rnd.choice(licenses.SENTENCES[x]) for x in ids] if rnd.random() < 0.5 else rnd.sample(parts, len(parts))
        text = "".join(p + rnd.choice([". ", "\n", ".\n\n", ", ", "; ", " | ", ""]) for p in parts)
        cut = rnd.random()
        rows.append((i, text.upper() if cut < 0.1 else text.replace(" ", "\n", 5) if cut < 0.3 else text[rnd.randint(0, 20) :] if cut < 0.4 else text))
    got = {r.doc_id: (r.sentences, r.licenses) for r in licenses.scan(docs(spark, rows)).collect()}
    assert got == {i: brute_scan(t) for i, t in rows} and sum(len(b) > 0 for _, b in got.values()) > 150
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    assert {i: (a, b) for i, a, b in duckdb.sql(licenses.oracle()).fetchall()} == {i: (",".join(a), ",".join(b)) for i, (a, b) in got.items()}


# Languages


def test_languages(spark):
    rnd = random.Random(8)
    kinds = {"en": "the and with house ing water think", "de": "der und nicht schön haus wasser denken", "fr": "le et avec maison eau pensée où", "es": "el y con casa agua pensar niño"}
    rows = [(i, " ".join(rnd.choices(kinds[v].split(), k=rnd.randint(5, 40))), v) for i in range(240) for v in [list(kinds)[i % 4]]]
    rows += [(900, None, "en"), (901, "123 --", "en"), (902, "", None), (903, "der und haus", None), (None, "the house and water", None), (904, "und " * 30000, "de")]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    held = {r.doc_id for r in df.where(language_id.held_out(F.col("doc_id"))).collect()}
    assert 40 < len(held) < 90 and all(got[i].lang_pred == v for i, t, v in rows if i in held and i < 900)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "de", "en"]
    none = language_id.predict(df, language_id.train(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in none.collect()} == {"und"} and language_id.train(df.limit(0)) is None


# Mixing


def filled(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by sharing out the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), [s for s in names if sizes[s]], float(sum(sizes.values()))
    while free and left > 1e-9:
        share = left / sum(w[s] for s in free)
        for s in free:
            target[s] += share * w[s]
        left = sum(max(0.0, target[s] - epochs * sizes[s]) for s in free)
        for s in free:
            target[s] = min(target[s], epochs * sizes[s])
        free = [s for s in free if target[s] < epochs * sizes[s]]
    return target


@pytest.mark.parametrize("scale", [(3, 300, 40, 2, 90), (1, 1, 1, 1, 1), (1, 1, 1, 1, 900), (900, 1, 1, 1, 0)])
def test_mixing(spark, scale):
    rnd = random.Random(9)
    rows = [(100 * k + j, words(rnd, rnd.randint(0, 2 * n)), s) for k, (s, n) in enumerate(zip(["a", "b", "z", "é", None], scale)) for j in range(30)]
    rows += [(7000, None, "a"), (7001, "x y", "empty\ttext"), (None, "p q r", "b"), (7002, "p q r", "b"), (7002, "p q r", "b")]
    out = mixing.mix_sources(docs(spark, rows, "doc_id long, text string, source string"), keep=["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = filled(sizes)
    for s, size in sizes.items():
        mine = [r for r in out if r.source == s]
        assert all(r.source_size == size and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r.taken <= 3 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    again = mixing.mix_sources(docs(spark, rows, "doc_id long, text string, source string", 2), keep=["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert mixing.mix_sources(docs(spark, [], "doc_id long, text string, source string")).count() == 0


def test_mixing_ties_long_texts_and_clashing_names(spark):
    """Rows of one id and one length in any order give one mix; a kept column named like a result gives way."""
    rnd = random.Random(13)
    rows = [(1, f"{rnd.randrange(10**8):08d} w w", rnd.choice("ab"), 7) for _ in range(200)] + [(2, "long " * 200_000, "c", 8), (3, None, None, 9)]
    runs = []
    for k in range(3):
        rnd.shuffle(rows)
        df = docs(spark, rows, "doc_id long, text string, source string, size int", 2 + k)
        runs.append(sorted((r.doc_id, r.text and r.text[:20], r["size"], r.taken) for r in mixing.mix_sources(df, keep=["doc_id", "text", "size"]).collect() if r.text))
    assert runs[0] == runs[1] == runs[2] and ("long long long long ", 200_000) in {(t, n) for _, t, n, _ in runs[0]}


# Lines


def without_near_lines(rows):
    first = {}
    for i, t in sorted(rows, key=lambda r: -(1 << 63) if r[0] is None else r[0]):
        for k, x in enumerate((t or "").split("\n")):
            if n := line_dedup.normal(x):
                first.setdefault(n, (-(1 << 63) if i is None else i, k))
    sets = {n: line_dedup.shingles(n) for n in first}
    pairs = [(a, b) for a, b in itertools.combinations(first, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = union(pairs, first)
    best = {}
    for n, c in comp.items():
        best[c] = min(best.get(c, first[n]), first[n])
    keep = {n for n in first if first[n] == best[comp[n]]}
    place = lambda i: -(1 << 63) if i is None else i
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not (n := line_dedup.normal(x)) or n in keep and first[n] == (place(i), k)) for i, t in rows}


def test_line_dedup(spark):
    rnd = random.Random(3)
    base = [words(rnd, rnd.randint(3, 40), 300) for _ in range(30)]
    rows = []
    for i in range(150):
        made = []
        for _ in range(rnd.randint(0, 5)):
            b = rnd.choice(base).split()
            for _ in range(rnd.randint(0, 2)):
                b[rnd.randrange(len(b))] = f"q{rnd.randrange(99)}"
            made.append(" ".join(b))
        rows.append((i, "\n".join(made)))
    rows += [(900, None), (901, ""), (902, "\n\n"), (903, "a\na\nA \nb"), (None, "b\nunique é line"), (904, "z" * 20000)]
    got = {r.doc_id: r for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert {i: r.kept_text for i, r in got.items()} == without_near_lines(rows)
    assert got[903].n_removed == 3 and got[900].kept_text is None
    twice = line_dedup.dedup(docs(spark, [(1, "one line\none line"), (1, "one line\none line"), (2, "one line")])).collect()
    assert sorted((r.doc_id, r.kept_text) for r in twice) == [(1, "one line"), (1, "one line"), (2, "")]
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_bands_find_pairs_at_the_threshold():
    rnd = random.Random(10)
    met = tried = 0
    while tried < 200:
        a = words(rnd, 40)
        w = a.split()
        for k in rnd.sample(range(40), rnd.randint(1, 4)):
            w[k] = f"n{rnd.randrange(999)}"
        b = " ".join(w)
        j = len(line_dedup.shingles(a) & line_dedup.shingles(b)) / len(line_dedup.shingles(a) | line_dedup.shingles(b))
        if 0.8 <= j < 0.9:
            x = line_dedup.bands([a, b])
            tried, met = tried + 1, met + bool((x[0] == x[1]).any())
    assert met >= 0.98 * tried


# Components


def test_components(spark):
    rnd = random.Random(11)
    pairs = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(50)] + [(rnd.randrange(3000, 3200), rnd.randrange(3000, 3200)) for _ in range(80)] + [(5, 5), (None, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long").repartition(5)).collect()}
    good = [(a, b) for a, b in pairs if a is not None and a != b]
    assert got == union(good, {x for p in good for x in p})
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_shards_of_ids(spark):
    """The two forms agree, and ids in steps of the shard count are spread."""
    from noteql.llm import common

    ids = [0, 1, -1, 2**62, -(2**63), *range(0, 102 * 5000, 102)]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(common.doc_shard_column(F.col("i"), 102)).collect()]
    assert got == common.doc_shard(np.array(ids), 102).tolist()
    assert max(np.bincount(got, minlength=102)) < 3 * len(ids) / 102


def test_lines_of_documents_that_share_an_id(spark):
    rows = [(1, "first line here\ncommon words of both"), (1, "other line there\ncommon words of both"), (2, "first line here\nother line there")]
    got = sorted((r.doc_id, r.kept_text) for r in line_dedup.dedup(docs(spark, rows)).collect())
    assert got == [(1, "first line here\ncommon words of both"), (1, "other line there\ncommon words of both"), (2, "")]


def test_stars_lose_no_link(spark):
    """Bands whose hub is near to few of lines that are near each other, one of them too large for a piece."""
    a = "the quick brown fox jumps over the lazy dog and runs away from here"
    rows = [a + x for x in ("", " a", " b", " c")] + [f"{a} {a} {k:04d}" for k in range(600)] + ["nothing like the others at all"]
    lines_ = dict(enumerate(rows, 10))
    keys = line_dedup.bands(rows)
    texts = spark.createDataFrame([(h, x, k.tobytes()) for (h, x), k in zip(lines_.items(), keys)], "h long, line string, keys binary")
    met = {}
    for h, k in zip(lines_, keys.view(np.int64).tolist()):
        for band in k:
            met.setdefault(band, []).append(h)
    # The last line is made the hub of every band of others.
    stars = [(band, lone, h) for band, hs in met.items() if len(hs) > 1 for lone in [max(lines_)] for h in hs]
    links = [(r.src, r.dst) for r in line_dedup.near_links(spark.createDataFrame(stars, "band long, src long, dst long"), texts).collect()]
    sets = {h: line_dedup.shingles(x) for h, x in lines_.items()}
    near = [(x, y) for hs in met.values() for x, y in itertools.combinations(hs, 2) if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    assert union(links, lines_) == union(near, lines_) and len(set(union(near, lines_).values())) < 5


def test_very_long_texts_and_repeated_rows(spark):
    """Rows come out once each and alike, texts whole."""
    import tokenizers

    rnd = random.Random(14)
    long = words(rnd, 60_000, 50_000) + " ünïcode ☃ " + "x" * 5_000
    rows = [(1, long), (1, long), (2, "same words in both rows"), (2, "same words in both rows"), (3, None), (3, None)]
    df = docs(spark, rows)
    prints = fingerprints.against_edits(df).collect()
    assert len(prints) == 6 and len({r.fingerprint for r in prints}) == 3 and {r.n_chars for r in prints} == {len(long), 23, 0}
    sketch = spark.createDataFrame([(long,)], "t string").select(fingerprints.distinct_shingles(fingerprints.sketch(F.col("t")))).first()[0]
    assert abs(sketch - len(shingles(long))) < 0.35 * len(shingles(long))
    near = simhash.near_duplicates(df).collect()
    assert len(near) == 6 and {(r.doc_id, r.fp & (1 << 64) - 1) for r in near} == {(i, simhash.fingerprint((t or "").encode())) for i, t in rows}
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    got = bpe.digests(df).collect()
    assert len(got) == 6 and all(r.ids_sha256 == hashlib.sha256(",".join(map(str, ids[r.doc_id])).encode()).hexdigest() for r in got)
    told = language_id.predict(df, None).collect()
    assert len(told) == 6 and {(r.lang_pred, r.score) for r in told} == {("und", 0.0)}
    assert language_id.predict(docs(spark, []), None).count() == 0
    found = licenses.scan(docs(spark, [(1, long + ". Released under the MIT License")] * 2)).collect()
    assert [r.licenses for r in found] == [["MIT"], ["MIT"]]


def test_language_training_and_prediction_against_a_plain_loop(spark):
    """The sample is what a loop over all rows takes, and predictions are those of the same model, one text at a time."""
    rnd = random.Random(15)
    kinds = {"en": "the and with house ing water think", "de": "der und nicht haus wasser denken", "es": "el y con casa agua pensar"}
    rows = [(i % 150, " ".join(rnd.choices(kinds[v].split(), k=rnd.randint(3, 20))), v) for i in range(180) for v in [list(kinds)[i % 3]]]
    rows += [(500 + k, "12 -- 3", "en") for k in range(50)] + [(900, rows[0][1], None), rows[1], rows[1]]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    hashed = {(r.doc_id, r.text): (r.pick, r.held) for r in df.select("doc_id", "text", F.xxhash64(F.lit(42), "doc_id", "text").alias("pick"), language_id.held_out(F.col("doc_id")).alias("held")).collect()}
    sample: dict = {}
    for i, t, v in sorted(set(r for r in rows if r[2]), key=lambda r: hashed[r[:2]][0]):
        if not hashed[i, t][1] and any(c.isalpha() for c in t) and len(sample.setdefault(v, [])) < 20:
            sample[v].append((i, v, language_id.profile(t).astype(np.float32).tobytes()))
    chosen = sorted(x for part in sample.values() for x in part)
    plain = language_id.Model.fit(np.stack([np.frombuffer(x, np.float32) for _, _, x in chosen]).astype(float), [v for _, v, _ in chosen])
    model = language_id.train(df, per_language=20)
    assert np.allclose(model.families.weights, plain.families.weights) and set(model.languages) == set(plain.languages)
    got = language_id.predict(df, model, keep=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        p = language_id.profile(r.text)
        langs, s = plain.predict(p[None]) if p is not None else (["und"], [0.0])
        assert r.lang_pred == langs[0] and abs(r.score - s[0]) < 1e-9
    clash = language_id.predict(df.withColumn("score", F.lit("x")), model, keep=["doc_id", "score"])
    assert clash.columns == ["doc_id", "lang_pred", "score"] and clash.count() == len(rows)


def test_a_full_table_changes_no_result(monkeypatch):
    """States beyond the kept ones are made for a word and dropped, and the table is begun anew at last."""
    rnd = random.Random(16)
    some = ["".join(rnd.choices("abcdeé ☃xyz", k=rnd.randint(1, 14))).encode() for _ in range(400)]
    want = [bpe.encoder(bpe.default_path()).automaton.encode_word(w) for w in some]
    small = bpe.Automaton.load(bpe.default_path())
    monkeypatch.setattr(bpe, "TABLE_STATES", 50)
    monkeypatch.setattr(bpe, "DROPPED_STATES", 300)
    begun, sizes = [], []
    monkeypatch.setattr(small, "_begin_table", lambda f=small._begin_table: (begun.append(1), f())[1])
    for w, ids in zip(some, want):
        assert small.encode_word(w) == ids
        sizes.append(len(small.table))
        assert len(small.table) == len(small.token) == len(small.under_way) <= 50 and len(small.numbers) <= 50
        assert all(to < 50 for entries in small.table for to in entries.values())
    assert begun and max(sizes) == 50


def test_words_that_step_side_by_side_get_their_own_paths(monkeypatch):
    """Whatever words are encoded together, also with a full table and long words among them; texts as the library."""
    rnd = random.Random(17)
    some = ["".join(rnd.choices("abcdeé ☃xyz", k=rnd.choice([1, 3, 14, 90]))).encode() for _ in range(300)]
    one = bpe.Automaton.load(bpe.default_path())
    want = [one.encode_word(w) for w in some]
    monkeypatch.setattr(bpe, "ABREAST", 200)
    for states in (bpe.TABLE_STATES, 50):
        monkeypatch.setattr(bpe, "TABLE_STATES", states)
        many = bpe.Automaton.load(bpe.default_path())
        path, counts = many.encode_words(some)
        assert [tuple(x.tolist()) for x in np.split(path, np.cumsum(counts)[:-1])] == want
        assert len(many.table) <= states
    import tokenizers

    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = [" ".join(rnd.choices(["ab", "x's", "'s", "12a", "é!", "!\n", "\nq", "a\n\nb", "", "<|endoftext|>"], k=rnd.randint(0, 6))) for _ in range(400)]
    texts[0] = "<|endoftext|>"
    monkeypatch.setattr(bpe, "SLICE", 500)
    fresh = bpe.Encoder(bpe.Automaton.load(bpe.default_path()))
    for rows, ids, ends in itertools.chain(fresh.slices(pa.array(texts)), fresh.slices(pa.array(texts[:1])), fresh.slices(pa.array([], pa.string()))):
        assert [x.tolist() for x in np.split(ids, ends[1:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts[rows]]


def test_shingles_as_numbers_are_compared_as_strings_are():
    """For lines of one-byte characters, others, both, short ones and ones with zero characters."""
    rnd = random.Random(18)
    some = ["", "a", "ab", "ab\0", "\0", "abcdefg", "abcdefg\0"] + ["".join(rnd.choices(letters, k=rnd.randint(1, 40))) for letters in ("ab", "aé\0", "aбÿ", "日本a") for _ in range(30)]
    some += [x + rnd.choice("abб") * rnd.randint(1, 3) for x in some]
    numbers = [line_dedup._numbered(x) for x in some]
    assert {type(x) for x in numbers} == {set, np.ndarray}
    for a, x in zip(some, numbers):
        for b, y in zip(some, numbers):
            both, all_ = len(line_dedup.shingles(a) & line_dedup.shingles(b)), len(line_dedup.shingles(a) | line_dedup.shingles(b))
            assert line_dedup._near(x, y) == (both >= line_dedup.THRESHOLD * all_ - 1e-9)
