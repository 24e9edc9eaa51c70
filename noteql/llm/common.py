"""Helpers shared by the training-data operators: shared scratch tables, packed exchanges, word hashing."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract: runs of anything but space and U+0009 to U+000D. ``bytes.split()`` cuts at the same characters.
WORD_RE = "[^\\x20\\x09-\\x0D]+"
NULL_ID = -(1 << 63)
SHARDS_PER_PARTITION = 2
#: Names the scratch tables of this process.
RUN = f"noteql-{uuid.uuid4().hex[:12]}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session of one process, as in tests, may name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "noteql-shared")
    return path.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write a table to the shared folder and read it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{RUN}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the scratch tables that this process wrote to the shared folder; returns their number. Results that still
    read them must be stored before."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, f"{RUN}-*")) or ()]
    for path in found:
        fs.delete(path, True)
    return len(found)


def kept_columns(keep: list[str] | None, own) -> list[str]:
    """The columns to keep but those that are named like results, which take their place."""
    return [c for c in keep or () if c.lower() not in own]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shard_count(spark: SparkSession) -> int:
    """Shards of a packed exchange: a few for each shuffle partition, so that one stays small in memory, and not more, as
    every batch sends a packet to every shard."""
    return max(8, SHARDS_PER_PARTITION * partitions(spark))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising bijection on unsigned 64-bit integers (MurmurHash3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordIds(dict):
    """Word (bytes) to a 64-bit hash, remembered while the table is small."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORD_IDS = WordIds()


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORD_IDS.__getitem__, words), np.uint64, len(words))


def text_bytes(values) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null counts as empty."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def planes(column: np.ndarray) -> bytes:
    """A column of 64-bit values with its bytes transposed, so that constant high bytes compress away."""
    return np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8).T.tobytes()


def pack(*columns: np.ndarray) -> bytes:
    return b"".join(planes(c) for c in columns)


def unpack(payloads: list[bytes], width: int) -> list[np.ndarray]:
    """The columns of several packed payloads, one after another."""
    parts = []
    for p in payloads:
        n = len(p) // (8 * width)
        raw = np.frombuffer(p, np.uint8).reshape(width, 8, n)
        parts.append(np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(width, n * 8).view(np.uint64))
    if not parts:
        return [np.empty(0, np.uint64)] * width
    return list(np.concatenate(parts, axis=1))


def by_shard(shard: np.ndarray, columns: list[np.ndarray], shards: int):
    """Yield (shard, payload) with the rows of each shard, in their order."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    columns = [c[order] for c in columns]
    for s in np.flatnonzero(ends[1:] > ends[:-1]):
        yield int(s), pack(*(c[ends[s] : ends[s + 1]] for c in columns))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def doc_shard(ids: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a document id by its XXH64 (of 8 bytes, seed 42), the same as ``doc_shard_column``. Ids in steps of any
    width fall into all shards alike."""
    h = _rotated(ids.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), 31) * np.uint64(0x9E3779B185EBCA87)
    h ^= np.uint64(42 + 0x27D4EB2F165667C5 + 8)
    h = _rotated(h, 27) * np.uint64(0x9E3779B185EBCA87) + np.uint64(0x85EBCA77C2B2AE63)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), shards)


def doc_shard_column(ids, shards: int):
    return F.pmod(F.xxhash64(ids), F.lit(shards)).cast("int")


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """True where any of the sorted keys differs from the row before."""
    first = np.ones(len(keys[0]), bool)
    if len(first) > 1:
        first[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return first
