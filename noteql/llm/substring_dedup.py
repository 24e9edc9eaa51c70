"""Substring dedup by windows of 20 words looked up in blocks, in the place of relative Lempel-Ziv parsing.

No match is extended greedily against reference text here. Equal windows have equal anchors, so looking anchors,
phrases and windows up by equality finds every repeated window, and factors are made of those afterwards.

Where every word run of 20 words (a window) that stands earlier must go, a document's repeated windows are all that is needed:

1. Reference index. Every window designates one anchor, the six-word gram in it with the least hash (leftmost of
   equals), so equal windows designate equal anchors. Consecutive windows with one anchor make a phrase, and a
   document is a sequence of phrases. The index of all phrases of all documents is dealt by anchor into blocks, and
   each document is looked up in every block that could hold a match.
2. Factors. In a block, a phrase whose text stands earlier extends the factor of its document: all its windows are
   duplicates. Phrases that share only the anchor with others are where factors begin, end or change their source;
   these boundaries are checked.
3. Boundary check. The windows of boundary phrases are dealt into blocks by their own hash, and all but the first
   occurrence of each are duplicates too.
4. Adjacent duplicate windows join to factors, at least 20 words long each; the words they cover are removed.

What stands together in one batch is settled there before anything is shuffled: of equal phrases or windows of a
batch one goes on, so a passage in a third of all documents sends one row a batch. Rows travel as packed arrays.
Hashes are of 64 bits, an anchor's and a phrase's or window's together.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, by_shard, doc_shard, doc_shard_column, group_starts, mix, pack, partitions, read, shard_count, text_bytes, unpack, word_ids

WINDOW = 20
GRAM = 6
BASE = np.uint64(0x9E3779B97F4A7C15)
# Kinds of rows in the packed exchanges.
LOOKUP, BOUNDARY, DUPLICATE = 0, 1, 2
SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary())])
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, inverse)):
            steps = np.full(size, b)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Hashes:
    """Hashes of any word span of an array of word ids, from prefix sums."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        power, self.inverse = (p[: n + 1] for p in _powers(n + 1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(ids * power[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def phrases(ids: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Anchor hash, phrase hash, first window and number of windows of each phrase of one document."""
    n = len(ids) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none.view(np.uint64), none.view(np.uint64), none, none, None
    h = Hashes(ids)
    at = np.arange(len(ids) - gram + 1)
    g = h.spans(at, at + gram)
    width = window - gram + 1
    value, where, have = g, at, 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:-step], value[step:]
        later = b < a
        value, where = np.where(later, b, a), np.where(later, where[step:], where[:-step])
        have += step
    first = np.flatnonzero(group_starts(where))
    count = np.diff(np.append(first, n))
    anchor = where[first]
    # Where the anchor lies in the phrase is part of it.
    n_hash = mix(h.spans(first, first + count + window - 1) + (anchor - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return g[anchor], n_hash, first, count, h


def _place(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Start and number of windows in one value that sorts by start."""
    return (start.astype(np.uint64) << np.uint64(8)) | count.astype(np.uint64)


def _split(place: np.ndarray):
    return (place >> np.uint64(8)).astype(np.int64), (place & np.uint64(255)).astype(np.int64)


def _signed(ids: np.ndarray) -> np.ndarray:
    """Order-preserving map of signed ids to unsigned and back."""
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def settle(g: np.ndarray, n: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """For rows of equal kind, sorted by (g, n, doc, place): the order, which rows repeat an earlier row's n at
    another place, and which are the first of their g."""
    order = np.lexsort((place, doc, n, g))
    new_g = group_starts(g[order])
    new_n = group_starts(g[order], n[order])
    head = np.maximum.accumulate(np.where(new_n, np.arange(len(order)), 0))
    od, op = doc[order], place[order]
    repeats = ~new_n & ((od != od[head]) | (op != op[head]))
    same = ~new_n & ~repeats
    return order, repeats, same, new_g


def _emit(kind: int, shard: np.ndarray, columns: list[np.ndarray], shards: int):
    for s, payload in by_shard(shard, columns, shards):
        yield kind, s, payload


def _first_stage(shards: int):
    """Phrases of each batch: LOOKUP rows (one for each anchor) by anchor, the other rows of repeated anchors and the
    duplicates within the batch by document."""

    def run(batches):
        for b in batches:
            ids = _signed(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            parts = []
            for d, text in zip(ids, text_bytes(b.column(1))):
                g, n, first, count, _ = phrases(word_ids(text.split()))
                if len(g):
                    parts.append((g, n, np.full(len(g), d), _place(first, count)))
            if parts:
                rows = [np.concatenate(c) for c in zip(*parts)]
                yield from _batches(list(_presettle(*rows, shards)))

    return run


def _presettle(g, n, doc, place, shards):
    lone, some = _apart(g)
    look = [[c[lone] for c in (g, n, doc, place)]]
    g, n, doc, place = (c[some] for c in (g, n, doc, place))
    order, repeats, same, new_g = settle(g, n, doc, place)
    g, n, doc, place = (c[order] for c in (g, n, doc, place))
    kept = ~repeats & ~same
    if len(g):
        # One row of each anchor looks up the index; it says whether the batch has the anchor with several texts.
        heads = np.flatnonzero(new_g)
        several = np.bincount(np.cumsum(new_g) - 1, kept) > 1
        look.append([g[heads], n[heads], doc[heads], place[heads] | (several.astype(np.uint64) << np.uint64(63))])
    look = [np.concatenate(c) for c in zip(*look)]
    yield from _emit(LOOKUP, (look[0] % np.uint64(shards)).astype(np.int64), look, shards)
    for kind, chosen in ((BOUNDARY, kept & ~new_g), (DUPLICATE, repeats)):
        yield from _emit(kind, doc_shard(_signed(doc[chosen]), shards), [n[chosen], doc[chosen], place[chosen]], shards)


def _apart(g: np.ndarray, flagged=False):
    """Indices of the rows whose anchor is there once, as for most, and of the others."""
    order = np.argsort(g)
    new = group_starts(g[order])
    lone = new & np.append(new[1:], True)
    lone &= ~(flagged[order] if flagged is not False else np.zeros(len(g), bool))
    return order[lone], order[~lone]


def _batches(rows, size: int = 4096):
    for at in range(0, len(rows), size):
        kinds, shard, payload = zip(*rows[at : at + size])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], ["kind", "shard", "payload"])


PACKED = "kind int, shard int, payload binary"


def _lookups(shards: int):
    """Blocks of the reference index: phrases that stand earlier are duplicates, other phrases with an anchor that has
    several texts are boundaries, phrases with a text of their own go."""

    def run(key, table):
        g, n, doc, place = unpack(table.column("payload").to_pylist(), 4)
        flagged = place >> np.uint64(63) > 0
        some = _apart(g, flagged)[1]
        g, n, doc, place, flagged = g[some], n[some], doc[some], place[some] & np.uint64((1 << 63) - 1), flagged[some]
        order, repeats, same, new_g = settle(g, n, doc, place)
        g, n, doc, place, flagged = (c[order] for c in (g, n, doc, place, flagged))
        group = np.cumsum(new_g) - 1
        several = (np.bincount(group, group_starts(g, n)) > 1) | (np.bincount(group, flagged) > 0) if len(g) else np.empty(0, bool)
        rows = []
        for kind, chosen in ((BOUNDARY, several[group] & ~repeats), (DUPLICATE, repeats)) if len(g) else ():
            rows += _emit(kind, doc_shard(_signed(doc[chosen]), shards), [n[chosen], doc[chosen], place[chosen]], shards)
        return pa.Table.from_batches(list(_batches(rows)), SCHEMA)

    return run


def _boundaries(shards: int):
    """Windows of boundary phrases, by their hash; duplicates found so far pass by document."""

    def run(key, docs, marks):
        rows = []
        known = _marks(marks)
        passed = [p for k, p in zip(marks.column("kind").to_pylist(), marks.column("payload").to_pylist()) if k == DUPLICATE]
        if passed:
            rows.append((DUPLICATE, key[0].as_py(), pack(*unpack(passed, 3))))
        w, a, doc, place = [], [], [], []
        for d, text in zip(_ids(docs), text_bytes(docs.column("text"))):
            mine = known(d, BOUNDARY)
            if not len(mine):
                continue
            g, n, first, count, h = phrases(word_ids(text.split()))
            at = _match(n, _place(first, count), mine)
            if len(at):
                c = count[at]
                start = np.repeat(first[at], c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c))
                w.append(h.spans(start, start + WINDOW))
                a.append(np.repeat(g[at], c))
                doc.append(np.full(len(start), d))
                place.append(_place(start, np.ones(len(start), np.int64)))
        if w:
            w, a, doc, place = map(np.concatenate, (w, a, doc, place))
            order, repeats, same, _ = settle(a, w, doc, place)
            w, a, doc, place = (x[order] for x in (w, a, doc, place))
            kept = ~repeats & ~same
            rows += _emit(LOOKUP, (w[kept] % np.uint64(shards)).astype(np.int64), [a[kept], w[kept], doc[kept], place[kept]], shards)
            rows.append((DUPLICATE, key[0].as_py(), pack(w[repeats], doc[repeats], place[repeats])))
        return pa.Table.from_batches(list(_batches(rows)), SCHEMA)

    return run


def _window_lookups(shards: int):
    def run(key, table):
        a, w, doc, place = unpack(table.column("payload").to_pylist(), 4)
        order, repeats, _, _ = settle(a, w, doc, place)
        chosen = order[repeats]
        rows = list(_emit(DUPLICATE, doc_shard(_signed(doc[chosen]), shards), [w[chosen], doc[chosen], place[chosen]], shards))
        return pa.Table.from_batches(list(_batches(rows)), SCHEMA)

    return run


def _ids(docs: pa.Table) -> np.ndarray:
    return _signed(docs.column("doc_id").to_numpy().astype(np.int64))


def _marks(table: pa.Table):
    """A look-up of the marks of one kind of a document: rows of (hash, place)."""
    by_kind = {}
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
    for kind in set(kinds):
        h, doc, place = unpack([p for k, p in zip(kinds, payloads) if k == kind], 3)
        order = np.argsort(doc, kind="stable")
        by_kind[kind] = h[order], doc[order], place[order]

    def of(d, kind) -> np.ndarray:
        if kind not in by_kind:
            return np.empty((0, 2), np.uint64)
        h, doc, place = by_kind[kind]
        a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
        return np.stack([h[a:b], place[a:b]], 1)

    return of


def _match(hashes: np.ndarray, places: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of a document's phrases have a mark: the same place and, as rows may share a doc_id, the same text."""
    order = np.argsort(places)
    at = order[np.clip(np.searchsorted(places[order], marks[:, 1]), 0, max(0, len(places) - 1))] if len(places) else np.empty(0, np.int64)
    if not len(at):
        return at
    return np.unique(at[(places[at] == marks[:, 1]) & (hashes[at] == marks[:, 0])])


def factors(words: int, starts: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Duplicate windows joined to factors: rows of (first word, words), each at least ``window`` long."""
    cover = np.zeros(words + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + counts - 1 + window, -1)
    inside = np.concatenate([[False], np.cumsum(cover)[:words] > 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return np.stack([edge[::2], edge[1::2] - edge[::2]], 1)


def _own(words: list[bytes], marks: np.ndarray) -> np.ndarray:
    """Of marks of rows that share a doc_id, those whose hash is that of this text's phrase or window there."""
    if len(words) < WINDOW:
        return marks[:0]
    start, count = _split(marks[:, 1])
    fits = start + count - 1 + WINDOW <= len(words)
    marks, start = marks[fits], start[fits]
    _, n, first, c, h = phrases(word_ids(words))
    windows = h.spans(start, start + WINDOW) == marks[:, 0]
    return marks[windows | np.isin(np.arange(len(marks)), _marks_of_phrases(n, _place(first, c), marks))]


def _marks_of_phrases(hashes, places, marks) -> np.ndarray:
    known = set(zip(hashes.tolist(), places.tolist()))
    return np.array([k for k, m in enumerate(marks.tolist()) if tuple(m) in known], np.int64)


def _parse():
    def run(key, docs, marks):
        known = _marks(marks)
        out = []
        ids = _ids(docs)
        numbers, times = np.unique(ids, return_counts=True)
        shared = set(numbers[times > 1].tolist())
        for d, signed, text in zip(ids, docs.column("doc_id").to_pylist(), text_bytes(docs.column("text"))):
            words = text.split()
            mine = known(d, DUPLICATE)
            if len(mine) and int(d) in shared:
                mine = _own(words, mine)
            spans = factors(len(words), *_split(mine[:, 1])).tolist() if len(mine) else []
            kept, at = [], 0
            for start, length in spans:
                kept += words[at:start]
                at = start + length
            kept = b" ".join(kept + words[at:])
            out.append((signed, len(words), sum(k for _, k in spans), hashlib.sha256(kept).hexdigest(), spans, kept.decode()))
        cols = list(zip(*out)) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_words", "n_removed", "kept_sha256", "factors", "kept_text"])

    return run


def dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, factors (arrays of first word and length) and kept_text for each row.

    A null text has no words. A null doc_id sorts before all others. Rows that share a doc_id share its positions: a
    window is earlier only if its doc_id or its start is smaller, so repeated rows all come out alike. Documents of
    fewer than 20 words stay as they are. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    shards = shard_count(spark)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    placed = d.withColumn("shard", doc_shard_column(F.col("doc_id"), shards)).repartition(partitions(spark), "shard")
    first = d.mapInArrow(_first_stage(shards), PACKED)
    key = F.when(F.col("kind") == LOOKUP, F.col("shard")).otherwise(F.col("shard") + shards)
    dealt = first.withColumn("at", key).repartition(partitions(spark), "at")
    # Rows that are settled already pass the look-ups in packets of their own.
    looked = dealt.groupBy("at").applyInArrow(_pass_or(_lookups(shards)), PACKED)
    ahead = placed.groupBy("shard").cogroup(looked.repartition(partitions(spark), "shard").groupBy("shard")).applyInArrow(_boundaries(shards), PACKED)
    dealt = ahead.withColumn("at", key).repartition(partitions(spark), "at")
    found = dealt.groupBy("at").applyInArrow(_pass_or(_window_lookups(shards)), PACKED)
    out = placed.groupBy("shard").cogroup(found.repartition(partitions(spark), "shard").groupBy("shard")).applyInArrow(
        _parse(), "doc_id long, n_words long, n_removed long, kept_sha256 string, factors array<array<long>>, kept_text string"
    )
    return out.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))


def _pass_or(look):
    def run(key, table):
        if table.column("kind")[0].as_py() == LOOKUP:
            return look(key, table)
        return table.select(["kind", "shard", "payload"])

    return run


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).drop("factors", "kept_text")


ORACLE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 p AS (SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
 d AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
 g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM d),
 a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
 t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM a ANTI JOIN g USING (doc_id, k) GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, (SELECT count(*) FROM g WHERE g.doc_id = w.doc_id) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON t.doc_id = w.doc_id"""
