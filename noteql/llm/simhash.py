"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming distances, connected components."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import each_piece, group_bounds, pieces
from .common import materialize, read, text_bytes
from .components import connected_components

SHINGLE = 4
DISTANCE = 4
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of A-Z-lowered words, of which every run of ``shingle`` counts once for each time it stands there."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    k = min(shingle, len(words))
    starts = [0, *ends]
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(line[a : b - 1], SEED) for a, b in zip(starts, ends[k - 1 :])), np.uint64, len(words) - k + 1)
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for each row. A null text has no words and the fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in text_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def layout(count: int, distance: int = DISTANCE) -> int:
    """Number of blocks m for so many fingerprints, the cheapest: each of the keys of m - distance blocks is a row to
    shuffle, as dear as some 50 comparisons, and meets the fingerprints that share it by chance. Whatever m, no pair is
    lost. 15 keys a fingerprint serve some hundred million, 35 some ten thousand million."""

    def cost(m: int) -> float:
        return math.comb(m, distance) * (50 + count / 2 ** (64 * (m - distance) / m))

    return min(range(distance + 2, distance + 9), key=cost)


def block_keys(fp, blocks: int, distance: int = DISTANCE):
    """Array of (table, key): the bits of every choice of ``blocks - distance`` blocks. Two fingerprints that differ
    in at most ``distance`` bits agree in all blocks of at least one choice."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    structs = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(masks[c] for c in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        structs.append(F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*structs)


#: Groups up to this size are compared shift by shift, many at once.
SMALL = 32


def near_pairs(gid: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs of a group within ``distance`` connect, for groups sorted by ``gid``."""
    bounds = group_bounds(gid)
    sizes = np.diff(bounds)
    src, dst = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    g, f = gid[small], fp[small]
    for shift in range(1, min(SMALL, int(sizes.max()))):
        hit = (g[shift:] == g[:-shift]) & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= distance)
        src.append(f[:-shift][hit])
        dst.append(f[shift:][hit])
    for k in np.flatnonzero(sizes > SMALL):
        a, b = forest(fp[bounds[k] : bounds[k + 1]], distance)
        src.append(a)
        dst.append(b)
    return np.concatenate(src) if src else fp[:0], np.concatenate(dst) if dst else fp[:0]


def forest(f: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one group: rows are visited from row to near row, and each is compared with the rows not
    reached yet, so what is near most others is soon done."""
    left = np.arange(len(f))
    src, dst = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(f[left] ^ f[at]) <= distance
            found = left[near]
            src += [f[at]] * len(found)
            dst += f[found].tolist()
            front += found.tolist()
            left = left[~near]
    return np.array(src, np.uint64), np.array(dst, np.uint64)


def link_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst): links among the distinct values of ``fp`` that give the same components as all pairs within
    ``distance`` bits. A key shared by very many fingerprints is cut into pieces, and every pair of pieces gives a
    forest, not its pairs."""
    distinct = materialize(fps.select("fp").distinct())
    blocks = layout(distinct.count(), distance)
    keyed = distinct.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("k.table", "k.key", "fp")

    def run(table: pa.Table):
        a, b = near_pairs(table.column("gid").to_numpy(), table.column("fp").to_numpy().view(np.uint64), distance)
        pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["src", "dst"])

    met = pieces(keyed, ["table", "key"], "fp").select("table", "key", "i", "j", "fp")
    return each_piece(met, ["table", "key"], run, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links, itself included) for each row.

    Equal fingerprints are one node, so copies are never paired. Rows with a null doc_id keep their fingerprint and
    get the component of the others with it, null if none has an id. Repeated rows stay apart; an empty table gives
    an empty result; other columns are not looked at.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle))
    comp = connected_components(link_fingerprints(fps, distance))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = materialize(least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    # The smallest id of every component, aggregated before it is shuffled, then back to the fingerprints and rows. Both
    # sides are tables, so that adaptive execution may split a large component, and the copies of one text.
    firsts = materialize(classes.groupBy("component").agg(F.min("least").alias("component_id")))
    named = materialize(classes.join(firsts, "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
