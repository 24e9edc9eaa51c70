"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

A line is what stands between line feeds, lower-cased and with white space runs made one space; blank lines are left
alone. Lines are near if the Jaccard likeness of their sets of 7-character shingles is 0.8 or more (a shorter line is
one shingle), and of every component one line stays, the earliest by doc_id and line number.

Equal lines are one node, named by a 64-bit hash: what a batch has twice is settled there, and first occurrences are
looked up in packed blocks. Bands of four minima, ten of them, meet in blocks as well; pairs exactly at the threshold
share a band with probability 0.995. Texts of lines that meet others are fetched once by the document of their first
occurrence.

The lines of a band form a star around one of them, so a band of n lines gives n - 1 candidate pairs, and a pair that
several bands give is checked once. Where every pair of a star is near, the band is settled. Only the other bands, of
three lines or more, are gone through pair by pair, cut into pieces that different tasks check.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .buckets import each_piece, group_bounds, pieces
from .common import NULL_ID, by_shard, doc_shard, doc_shard_column, group_starts, kept_columns, materialize, mix, pack, partitions, read, shard_count, unpack
from .components import connected_components, find

SHINGLE = 7
THRESHOLD = 0.8
ROWS, BANDS = 4, 10
PIECE = 256
OWN = ("n_lines", "n_removed", "kept_text")
SLAB = 1 << 16
LINE, BAND, GONE, MET = 0, 1, 2, 3
PACKED = "kind int, shard int, payload binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("payload", pa.binary())])
_POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in (1, 2, 4, 6)]
_RNG = np.random.default_rng(42)
_A = (_RNG.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def normal(line: str) -> str:
    return " ".join(line.lower().split())


def lines(text: str) -> list[str]:
    return text.split("\n")


def shingles(line: str) -> set[str]:
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def bands(norm: list[str]) -> np.ndarray:
    """Band keys, one row a line: each from ``ROWS`` minima of the hashed shingles."""
    out = np.empty((len(norm), BANDS), np.uint64)
    at = 0
    while at < len(norm):
        size, end = 0, at
        while end < len(norm) and (end == at or size + len(norm[end]) <= SLAB):
            size += len(norm[end]) + SHINGLE
            end += 1
        # Short lines are filled up, so that they have one shingle.
        part = [s if len(s) >= SHINGLE else s + "\0" * (SHINGLE - len(s)) for s in norm[at:end]]
        x = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        b, b2, b4, b6 = _POWERS
        x2 = x[:-1] + b * x[1:]
        x4 = x2[:-2] + b2 * x2[2:]
        h = x4[: len(x) - 6] + b4 * x2[4 : len(x) - 2] + b6 * x[6:]
        h = (mix(h) >> np.uint64(32)).astype(np.uint32)
        count = np.array([len(s) for s in part]) - SHINGLE + 1
        stop = np.cumsum(count + SHINGLE - 1)
        inside = np.ones(len(x) + 1, bool)
        for k in range(1, SHINGLE):
            inside[stop - k] = False
        h = h[inside[: len(h)]]
        offsets = np.cumsum(count) - count
        least = np.empty((ROWS * BANDS, len(count)), np.uint64)
        permuted = np.empty_like(h)
        for k, (a, c) in enumerate(zip(_A, _B)):
            np.multiply(h, a, out=permuted)
            permuted += c
            least[k] = np.minimum.reduceat(permuted, offsets)
        for band in range(BANDS):
            m = least[band * ROWS : (band + 1) * ROWS]
            key = mix((m[0] << np.uint64(32)) | m[1]) + ((m[2] << np.uint64(32)) | m[3])
            out[at:end, band] = mix(key ^ mix(np.full(end - at, band + 1, np.uint64)))
        at = end
    return out


def _emit(kind, shard, columns, shards):
    return [(kind, s, p) for s, p in by_shard(shard, columns, shards)]


def _table(rows) -> pa.Table:
    kinds, shard, payload = zip(*rows) if rows else ((), (), ())
    return pa.table([pa.array(kinds, pa.int32()), pa.array(shard, pa.int32()), pa.array(payload, pa.binary())], schema=SCHEMA)


def _order(ids: np.ndarray) -> np.ndarray:
    return ids.view(np.uint64) ^ np.uint64(1 << 63)


def _shard_of(doc: np.ndarray, shards: int) -> np.ndarray:
    return doc_shard(_order(doc), shards)


def _repeats(h, doc, place):
    """The order by (h, doc, place), which rows there repeat an earlier h at another place, and which begin one."""
    order = np.lexsort((place, doc, h))
    new = group_starts(h[order])
    head = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    other = (doc[order] != doc[order][head]) | (place[order] != place[order][head])
    return order, ~new & other, new


def _first_stage(shards: int):
    def run(batches):
        for b in batches:
            ids = _order(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            hashes, docs, places, first = [], [], [], {}
            for d, text in zip(ids, b.column(1).to_pylist()):
                for k, line in enumerate(lines(text)):
                    line = normal(line)
                    if line:
                        h = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
                        hashes.append(h)
                        docs.append(d)
                        places.append(k)
                        first.setdefault(h, line)
            if not hashes:
                continue
            h, doc, place = np.array(hashes, np.uint64), np.array(docs, np.uint64), np.array(places, np.uint64)
            order, repeats, new = _repeats(h, doc, place)
            gone, kept = order[repeats], order[new]
            rows = _emit(LINE, (h[kept] % np.uint64(shards)).astype(np.int64), [h[kept], doc[kept], place[kept]], shards)
            rows += _emit(GONE, _shard_of(doc[gone], shards), [h[gone], doc[gone], place[gone]], shards)
            keys = bands(list(first.values())).ravel()
            node = np.repeat(np.fromiter(first, np.uint64, len(first)), BANDS)
            # Of lines of the batch that share a band the least looks it up; the others form a star around it.
            order = np.lexsort((node, keys))
            keys, node = keys[order], node[order]
            start = group_starts(keys)
            hub = node[start][np.cumsum(start) - 1]
            rows += _emit(BAND, (keys[start] % np.uint64(shards)).astype(np.int64), [keys[start], node[start]], shards)
            rows += _emit(MET, (node[~start] % np.uint64(shards)).astype(np.int64), [keys[~start], hub[~start], node[~start]], shards)
            yield from _table(rows).to_batches()

    return run


def _lookups(shards: int):
    """Of LINE blocks: first occurrences (still LINE) and the others (GONE). Of BAND blocks: stars of the batches' lines
    around the least (MET). What is settled passes."""

    def run(key, table):
        kind = table.column("kind")[0].as_py()
        if kind in (GONE, MET):
            return table.select(["kind", "shard", "payload"])
        if kind == BAND:
            band, node = unpack(table.column("payload").to_pylist(), 2)
            order = np.lexsort((node, band))
            band, node = band[order], node[order]
            start = group_starts(band)
            hub = node[start][np.cumsum(start) - 1]
            # A line that several batches have is there once.
            met = group_starts(band, node) & ~start
            return _table([(MET, 0, pack(band[met], hub[met], node[met]))] if met.any() else [])
        a, b, c = unpack(table.column("payload").to_pylist(), 3)
        order, repeats, new = _repeats(a, b, c)
        gone, kept = order[repeats], order[new]
        return _table(_emit(GONE, _shard_of(b[gone], shards), [a[gone], b[gone], c[gone]], shards) + [(LINE, 0, pack(a[kept], b[kept], c[kept]))])

    return run


def _rows(packed: DataFrame, width: int, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            cols = unpack(batch.column(0).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names)

    return packed.select("payload").mapInArrow(run, schema)


def _fetch(key, docs, wanted):
    """Texts and bands of lines by the place of their first occurrence."""
    want: dict = {}
    for h, d, p in zip(*(wanted.column(c).to_pylist() for c in ("h", "doc", "place"))):
        want.setdefault(d, []).append((p, h))
    out, seen = [], set()
    for d, text in zip(docs.column("doc").to_pylist(), docs.column("text").to_pylist()):
        if d in want:
            have = lines(text)
            for p, h in want[d]:
                line = normal(have[p]) if p < len(have) else ""
                if line and h not in seen and xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) == h & ((1 << 64) - 1):
                    seen.add(h)
                    out.append((h, line))
    h, text = zip(*out) if out else ((), ())
    keys = [k.tobytes() for k in bands(list(text))]
    return pa.table([pa.array(h, pa.int64()), pa.array(text, pa.string()), pa.array(keys, pa.binary())], ["h", "line", "keys"])


def _numbered(line: str) -> np.ndarray | set[str]:
    """A line's shingles for comparing: as sorted numbers, which are made in less time than strings, if all characters are
    of one byte. Seven bytes and, of a shorter line, its length fit in one number, so equal numbers are equal shingles."""
    try:
        data = line.encode("latin-1")
    except UnicodeEncodeError:
        return shingles(line)
    if len(data) < SHINGLE:
        return np.array([int.from_bytes(data, "little") | len(data) + 1 << 56], np.uint64)
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    x2 = x[:-1] | x[1:] << 8
    x4 = x2[:-2] | x2[2:] << 16
    out = x4[: len(x) - 6] | x2[4 : len(x) - 2] << 32 | x[6:] << 48
    out.sort()
    return out[group_starts(out)]


def _strings(numbers: np.ndarray) -> set[str]:
    """The shingles that ``_numbered`` made numbers of."""
    return {x.to_bytes(8, "little")[: (x >> 56) - 1 if x >> 56 else SHINGLE].decode("latin-1") for x in numbers.tolist()}


def _near(x: np.ndarray | set[str], y: np.ndarray | set[str]) -> bool:
    if isinstance(x, set) or isinstance(y, set):
        both = len((x if isinstance(x, set) else _strings(x)) & (y if isinstance(y, set) else _strings(y)))
    else:
        every = np.concatenate((x, y))
        every.sort()
        both = int(np.count_nonzero(every[1:] == every[:-1]))
    return both >= THRESHOLD * (len(x) + len(y) - both) - 1e-9


def _check(batches):
    """Whether the lines of each row (src, dst, a, b) are near. Rows of one ``src`` come together, so that its shingles
    are made once."""
    held, x = None, _numbered("")
    for batch in batches:
        src, a, b = (batch.column(k).to_pylist() for k in (0, 2, 3))
        near = []
        for s, m, n in zip(src, a, b):
            if s != held:
                held, x = s, _numbered(m)
            # A line has no more shingles than characters allow.
            near.append(max(1, len(n) - SHINGLE + 1) >= THRESHOLD * len(x) - 1e-9 and _near(x, _numbered(n)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["src", "dst", "near"])


def _verify(table: pa.Table):
    """Links that connect whatever near lines of a group connect. A pair is compared in the first band that it shares,
    and not if it is connected already; shingles are made of the lines that are compared."""
    gid = table.column("gid").to_numpy()
    bounds = group_bounds(gid)
    h, text = table.column("h").to_pylist(), table.column("line")
    band, part = table.column("band").to_numpy(), table.column("p").to_numpy()
    apart = table.column("i").to_numpy() != table.column("j").to_numpy()
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, BANDS)
    links = set()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        k = keys[lo:hi]
        here = (k == band[lo:hi, None]).argmax(1)
        first = (k[:, None] == k[None]).argmax(2)
        chosen = np.triu((first == here[:, None]) & (band[lo:hi, None] == band[None, lo:hi]), 1)
        if apart[lo]:
            chosen &= part[lo:hi, None] != part[None, lo:hi]
        sets: dict[int, np.ndarray | set[str]] = {}
        root: dict[int, int] = {}
        for a, b in np.argwhere(chosen).tolist():
            old, new = find(root, b), find(root, a)
            if old == new:
                continue
            for c in (a, b):
                if c not in sets:
                    sets[c] = _numbered(text[lo + c].as_py())
            x, y = sets[a], sets[b]
            if len(x) >= THRESHOLD * len(y) and len(y) >= THRESHOLD * len(x) and _near(x, y):
                root[old] = new
                links.add((h[lo + a], h[lo + b]))
    src, dst = zip(*links) if links else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def near_links(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst): links with the components that all near pairs within bands have, from the bands' stars (band, src,
    dst) and the lines (h, line, keys).

    Many lines may have one ``src``: its rows are dealt last, after the texts of ``dst`` are joined, and adaptive
    execution may split them, as both sides of that join are plain exchanges.
    """
    pairs = stars.select("src", "dst").distinct()
    met = pairs.join(texts.select(F.col("h").alias("dst"), F.col("line").alias("b")), "dst")
    met = met.join(texts.select(F.col("h").alias("src"), F.col("line").alias("a")), "src").select("src", "dst", "a", "b")
    checked = materialize(met.mapInArrow(_check, "src long, dst long, near boolean"))
    # Bands with a pair that is not near, if others of the band might be.
    open_bands = materialize(stars.join(checked.where(~F.col("near")), ["src", "dst"], "left_semi").select("band").distinct())
    members = stars.join(open_bands, "band", "left_semi").select("band", F.explode(F.array("src", "dst")).alias("h")).distinct()
    rest = pieces(materialize(members), ["band"], "h", PIECE, least=3).join(texts, "h")
    return checked.where("near").select("src", "dst").unionByName(each_piece(rest, ["band"], _verify, "src long, dst long"))


def _strip(key, docs, marks):
    """Documents without the marked lines."""
    gone: dict = {}
    for payload in marks.column("payload").to_pylist():
        h, d, p = unpack([payload], 3)
        for x, y, z in zip(h.tolist(), _order(d).view(np.int64).tolist(), p.tolist()):
            gone.setdefault(y, {}).setdefault(z, set()).add(x)
    out = []
    for d, text in zip(*(docs.column(c).to_pylist() for c in ("doc", "text"))):
        mine, have = gone.get(d, {}), lines(text)
        kept = have
        if mine:
            # Rows that share a doc_id are told apart by their lines' hashes.
            kept = [x for k, x in enumerate(have) if k not in mine or xxhash.xxh3_64_intdigest(normal(x).encode("utf-8", "surrogatepass")) not in mine[k]]
        out.append((len(have), len(have) - len(kept), "\n".join(kept)))
    cols = list(zip(*out)) if out else [()] * 3
    made = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()))]
    return pa.table([docs.column("doc"), docs.column("row"), docs.column("rest"), *made], ["doc", "row", "rest", "n_lines", "n_removed", "kept_text"])


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text (the text without the lines that repeat or nearly repeat others), after
    the columns named in ``keep``, doc_id if none are; a kept column named like a result gives way to it.

    A null text has one blank line and stays null. A null doc_id sorts before all others. Rows that share a doc_id
    share its places: a repeated row is no repetition, so both come out alike. An empty table gives an empty result;
    other columns are not looked at.
    """
    spark = docs.sparkSession
    shards, parts = shard_count(spark), partitions(spark)
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).isNull().cast("long").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.struct(*(kept_columns(keep, OWN) or [F.col(id_col).alias("doc_id")])).alias("rest"))
    placed = d.withColumn("shard", doc_shard_column(F.col("doc"), shards)).repartition(parts, "shard")
    key = F.col("shard") + F.col("kind") * shards
    dealt = d.select("doc", "text").mapInArrow(_first_stage(shards), PACKED).withColumn("at", key).repartition(parts, "at")
    found = materialize(dealt.groupBy("at").applyInArrow(_lookups(shards), PACKED))
    first = materialize(_rows(found.where(F.col("kind") == LINE), 3, "h long, doc long, place long")).withColumn("doc", F.col("doc").bitwiseXOR(F.lit(NULL_ID)))
    stars = materialize(_rows(found.where(F.col("kind") == MET), 3, "band long, src long, dst long"))
    met = stars.select(F.explode(F.array("src", "dst")).alias("h")).distinct()
    wanted = first.join(met, "h", "left_semi").withColumn("shard", doc_shard_column(F.col("doc"), shards)).repartition(parts, "shard")
    texts = materialize(placed.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_fetch, "h long, line string, keys binary"))
    comp = connected_components(near_links(stars, texts))
    members = materialize(comp.withColumnRenamed("node", "h").join(first, "h"))
    # Tables on both sides, so that adaptive execution may split a large component.
    keepers = materialize(members.groupBy("component").agg(F.min(F.struct("doc", "place", "h")).alias("keeper")))
    lost = materialize(members.join(keepers, "component").where(F.col("h") != F.col("keeper.h")).select("h", "doc", "place"))

    def packed(batches):
        for b in batches:
            h, doc, place = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            yield from _table(_emit(GONE, doc_shard(doc, shards), [h.view(np.uint64), _order(doc), place.view(np.uint64)], shards)).to_batches()

    marks = found.where(F.col("kind") == GONE).unionByName(lost.mapInArrow(packed, PACKED)).repartition(parts, "shard")
    out = placed.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_strip, d.select("doc", "row", "rest").schema.add("n_lines", "long").add("n_removed", "long").add("kept_text", "string"))
    return out.select("rest.*", "n_lines", "n_removed", F.when(F.col("row") == 0, F.col("kept_text")).alias("kept_text"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
