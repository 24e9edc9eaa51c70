"""Periodic runs of words: where a document says the same words over and over.

A run is a stretch of words with a smallest period, at least so many words and so many periods long, that no neighbour
extends. All runs of a document come from its Lempel-Ziv blocks:

1. The suffix array, by prefix doubling, in which only suffixes that still tie are sorted again. The ranks of every
   round stay, and answer how far two places agree, forwards and backwards.
2. The LCP of neighbouring suffixes bounds how far to look for the nearest suffix on either side that begins earlier
   in the text; the longer agreement with those is the longest-previous-factor array, which cuts the blocks.
3. Main's boundary extensions: a run that touches a block boundary has, for one of those, a period below the two blocks'
   length, so extending each such period from the boundary both ways finds it.
4. A run that touches none lies within a block, whose source has the same run: runs, in buckets by their start, are
   copied from the source, block after block.

Documents are taken many at a time, with a mark of its own after each, so that numpy does the work of steps 1 to 3 for
all of them; memory follows ``BATCH_WORDS`` or the longest document. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, read, text_bytes

MIN_LENGTH = 24
MIN_EXPONENT = 3
#: Words of the documents that are gone through together.
BATCH_WORDS = 200_000


class Codes(dict):
    """Words to consecutive numbers."""

    def __missing__(self, word):
        code = self[word] = len(self)
        return code


def suffix_ranks(doc: np.ndarray, code: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of the 1, 2, 4, ... words from each place on until all differ, and the suffix array. ``doc`` ascends, and
    suffixes of different documents differ in their first rank; each document ends with a code of its own."""
    n = len(code)
    key = doc * (int(code.max()) + 1) + code
    tied, sa, ranks, width = np.arange(n), np.empty(n, np.int64), [], 1
    rank = np.zeros(n, np.int32)  # of the first of those that tie
    while True:
        order = np.argsort(key, kind="stable")
        tied, key = tied[order], key[order]
        new = np.ones(len(tied), bool)
        new[1:] = key[1:] != key[:-1]
        old = rank[tied]
        group = np.ones(len(tied), bool)
        group[1:] = old[1:] != old[:-1]
        at = np.arange(len(tied))
        slot = old + at - np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[tied] = np.maximum.accumulate(np.where(new, slot, 0))
        sa[slot] = tied
        ranks.append(rank)
        single = new & np.append(new[1:], True)
        tied = tied[~single]
        if not len(tied):
            return ranks, sa
        key = rank[tied].astype(np.int64) * n + rank[tied + width]
        width *= 2


def agreement(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words agree from ``i`` and ``j`` on, or before them. Agreement ends with the document, as whatever
    reaches over its end differs from all else."""
    out, top = np.zeros(len(i), np.int64), np.full(len(i), -1)
    alive = np.arange(len(i))
    for k, rank in enumerate(ranks):
        if back:
            alive = alive[np.minimum(i[alive], j[alive]) >= 1 << k]
        step = (1 << k) * back
        alive = alive[rank[i[alive] - step] == rank[j[alive] - step]]
        if not len(alive):
            break
        top[alive] = k
    some = top >= 0
    out[some] = 1 << top[some]
    for k in range(int(top.max(initial=-1)) - 1, -1, -1):
        at = np.flatnonzero(top > k)
        if back:
            at = at[np.minimum(i[at], j[at]) - out[at] >= 1 << k]
            more = ranks[k][i[at] - out[at] - (1 << k)] == ranks[k][j[at] - out[at] - (1 << k)]
        else:
            more = ranks[k][i[at] + out[at]] == ranks[k][j[at] + out[at]]
        out[at[more]] += 1 << k
    return out


def previous_factors(ranks: list[np.ndarray], sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the longest factor that also begins earlier in its document, and where. The two may overlap."""
    n = len(sa)
    lcp = np.zeros(n + 1, np.int64)
    lcp[1:n] = agreement(ranks, sa[:-1], sa[1:])
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends = np.flatnonzero(lcp == 0)
    far = int(np.diff(ends).max(initial=1))  # suffixes that begin with the same word
    least = [sa.astype(np.int32)]
    while 1 << len(least) < far:
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1], np.append(least[-1][half:], np.full(half, -1, np.int32))))
    for right in (False, True):
        rows = np.flatnonzero(lcp[1:] > 0 if right else lcp[:n] > 0)
        own = least[0][rows]
        edge = rows + right  # all from the row to the edge begin later
        for k in range(len(least) - 1, -1, -1):
            first = edge if right else edge - (1 << k)
            fits = (first >= 0) & (first + (1 << k) <= n)
            skip = fits & (least[k][np.where(fits, first, 0)] > own)
            edge = np.where(skip, edge + (1 << k if right else -(1 << k)), edge)
        near = edge if right else edge - 1
        inside = (near >= 0) & (near < n)
        rows, near = rows[inside], near[inside]
        here, there = sa[rows], sa[near]
        earlier = there < here
        here, there = here[earlier], there[earlier]
        found = agreement(ranks, here, there)
        better = found > length[here]
        length[here[better]], source[here[better]] = found[better], there[better]
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    steps, at, out = length.tolist(), 0, []
    n = len(steps)
    while at < n:
        out.append(at)
        at += steps[at] or 1
    out.append(n)
    return np.array(out)


def boundary_runs(ranks: list[np.ndarray], doc: np.ndarray, cuts: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs that touch a block boundary.

    A run has ``exponent`` periods q, so at most one boundary lies in it after its first q words, as the block from
    there on reaches its end. So either two blocks at a boundary are longer than the run without its first q words, or
    a block is that begins in those or ends with the run. Extending is tried from both sides of the boundary.
    """
    sizes = np.diff(cuts)
    at, both = cuts[1:-1], sizes[:-1] + sizes[1:]
    use = (doc[at] == doc[at - 1]) & (both * exponent > least * (exponent - 1))
    at, most = at[use], (both[use] - 1) // (exponent - 1)
    b = np.repeat(at, most)
    p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    n, first = len(doc), ranks[0]
    starts, ends, periods = [], [], []
    for x in (b, b - 1, b - 1 - p):
        ok = (x >= 0) & (x + p < n)
        ok[ok] = first[x[ok]] == first[x[ok] + p[ok]]
        x, q = x[ok], p[ok]
        s, e = x - agreement(ranks, x, x + q, back=True), x + q + agreement(ranks, x, x + q)
        keep = e - s >= np.maximum(least, exponent * q)
        starts.append(s[keep])
        ends.append(e[keep])
        periods.append(q[keep])
    s, e, q = map(np.concatenate, (starts, ends, periods))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.ones(len(s), bool)  # of one stretch, the smallest period
    new[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return list(zip(s[new].tolist(), e[new].tolist(), q[new].tolist()))


def copy_runs(runs: list[tuple[int, int, int]], cuts: np.ndarray, source: np.ndarray, least: int) -> dict[int, dict[int, int]]:
    """Start to end to period of the runs given and of those within blocks."""
    buckets: dict[int, dict[int, int]] = {}
    for s, e, q in runs:
        buckets.setdefault(s, {})[e] = q
    starts = sorted(buckets)
    sizes = np.diff(cuts)
    long = np.flatnonzero(sizes >= least + 2) if starts else ()
    for k in long:
        begin, size, origin = int(cuts[k]), int(sizes[k]), int(source[cuts[k]])
        i = bisect_right(starts, origin)
        # Copies begin later than what they are copied from, so the list may grow ahead of i.
        while i < len(starts) and starts[i] <= origin + size - least:
            for e, q in list(buckets[starts[i]].items()):
                if e < origin + size:
                    s = starts[i] + begin - origin
                    if s not in buckets:
                        buckets[s] = {}
                        insort(starts, s)
                    buckets[s].setdefault(e + begin - origin, q)
            i += 1
    return buckets


def runs_of(documents: list[list], least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each document, by start, then period. Documents are lists of words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    used = [k for k, d in enumerate(documents) if len(d) >= max(least, exponent)]
    if not used:
        return out
    sizes = np.array([len(documents[k]) + 1 for k in used])
    ends = np.cumsum(sizes) - 1
    doc = np.repeat(np.arange(len(used)), sizes)
    code, codes = np.empty(len(doc), np.int64), Codes()
    for k, end in zip(used, ends.tolist()):
        d = documents[k]
        code[end - len(d) : end] = np.fromiter(map(codes.__getitem__, d), np.int64, len(d))
    code[ends] = len(codes)
    ranks, sa = suffix_ranks(doc, code)
    length, source = previous_factors(ranks, sa)
    cuts = blocks(length)
    buckets = copy_runs(boundary_runs(ranks, doc, cuts, least, exponent), cuts, source, least)
    begins = ends - sizes + 1
    for s, bucket in buckets.items():
        d = int(doc[s])
        out[used[d]].extend((s - int(begins[d]), e - s, q) for e, q in bucket.items())
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run has after its first period."""
    if not runs:
        return words
    kept, upto = [], 0
    for s, e in sorted((s + q, s + length) for s, length, q in runs):
        if s > upto:
            kept += words[upto:s]
        upto = max(upto, e)
    return kept + words[upto:]


def _batches(rows, words):
    """Rows of (any, words), some BATCH_WORDS words at a time."""
    held, n = [], 0
    for r in rows:
        w = words(r)
        held.append((r[0], w))
        n += len(w) + 1
        if n >= BATCH_WORDS:
            yield held
            held, n = [], 0
    if held:
        yield held


def _each(docs: DataFrame, columns: list, text_col: str, schema, words, row, least: int, exponent: int) -> DataFrame:
    """``row(id, words, runs)`` for every row of docs, as columns after ``columns``."""
    picked = docs.select(*columns, F.col(text_col).alias("__text"))
    names = schema.fieldNames()
    made = slice(len(columns), None)
    types = [f.dataType for f in schema.fields[made]]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = [to_arrow_type(t) for t in types]
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = []
            for part in _batches(zip(ids, text_bytes(b.column(b.num_columns - 1))), words):
                found = runs_of([w for _, w in part], least, exponent)
                rows.extend(row(i, w, r) for (i, w), r in zip(part, found))
            cols = list(zip(*rows)) if rows else [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, arrow))], names)

    return picked.mapInArrow(run, schema)


def find_runs(docs: DataFrame, id_col="doc_id", text_col="text", least: int = MIN_LENGTH, exponent: int = MIN_EXPONENT, keep: list[str] | None = None) -> DataFrame:
    """n_words, runs (start, length and period in words, by start, then period) and collapsed_text, the words that no run
    has after its first period joined by one space, for each row; id_col, or the columns named in ``keep``, come first,
    and one that is named like a result gives way to it.

    Runs have at least ``least`` words and ``exponent`` periods (2 or more). A null or empty text has no words and
    collapses to the empty text. Repeated rows come out alike; ids are not looked at, and may be null; an empty table
    gives an empty result."""
    if exponent < 2 or least < 1:
        raise ValueError("runs have at least two periods and one word")
    columns = kept_columns(keep, ("n_words", "runs", "collapsed_text")) if keep is not None else [id_col]
    schema = docs.select(*columns).schema if columns else docs.select(F.lit(0).alias("row")).schema
    columns = columns or [F.lit(0).alias("row")]
    schema = schema.add("n_words", "long").add("runs", RUNS_TYPE).add("collapsed_text", "string")

    def row(_, words, runs):
        return len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], b" ".join(collapse(words, runs)).decode()

    return _each(docs, columns, text_col, schema, lambda r: r[1].split(), row, least, exponent)


def _runs_type():
    from pyspark.sql.types import ArrayType, LongType, StructType

    return ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))


RUNS_TYPE = _runs_type()


def repeated(doc_id, words: list) -> list:
    """The words of the query's contract: of every tenth document by checksum, the tail repeats its first words. A
    document without id is left as it is."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def summary(_, words: list, runs: list[tuple[int, int, int]]) -> tuple:
    top = None
    for r in runs:  # by start, then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, runs))).hexdigest()


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    schema = docs.select("doc_id").schema
    for name in ("n_runs", "start", "length", "period", "exponent_milli"):
        schema = schema.add(name, "long")
    schema = schema.add("runs_sha256", "string").add("collapsed_sha256", "string")
    return _each(docs, ["doc_id"], "text", schema, lambda r: repeated(r[0], r[1].split()), summary, MIN_LENGTH, MIN_EXPONENT)
