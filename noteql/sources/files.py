"""Files of a folder in any store: listed by Spark tasks, read whole or in byte ranges.

The driver knows the folder's name and no path below it. A listing is a table; folders still to be walked are the rows
that the next step deals out. A log is cut into ranges of bytes, so one of any size is read by many tasks: a line
belongs to the range that its first byte is in, and its number is its place there after the lines of all ranges before.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from noteql.scratch import stored
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTING = "relative_path string, folder boolean, size long, file_modified_at timestamp, created_at timestamp"
#: Entries that one task lists below a folder before it hands folders over to others.
WALK = 20_000
#: Bytes of a range, and of the whole files of one task.
RANGE = 8 << 20
TASK_BYTES, TASK_FILES = 64 << 20, 512
#: What counts as white space in a line.
WHITE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


class Rules:
    """Which files of a folder are wanted, and which folders are walked. ``skipped`` gets a folder's relative path."""

    def __init__(self, suffix: str | tuple[str, ...], skipped=None):
        self.suffix, self._skipped = suffix.lower() if isinstance(suffix, str) else tuple(x.lower() for x in suffix), skipped

    def wanted(self, path: str) -> bool:
        return path.lower().endswith(self.suffix)

    def skipped(self, folder: str) -> bool:
        return self._skipped is not None and self._skipped(folder)

    def reached(self, scope: str) -> bool:
        """Whether a walk from the top comes to a folder."""
        parts = scope.split("/")
        return not any(self.skipped("/".join(parts[:k])) for k in range(1, len(parts) + 1))


def at(root: str, relative: str = "") -> str:
    return f"{root.rstrip('/')}/{relative}" if relative else root


def store(url: str) -> tuple[stores.FileSystem, str]:
    """The store of a URL, and the path in it. Names without a scheme are local."""
    parts = urlsplit(url)
    if parts.scheme in ("", "file"):
        return stores.LocalFileSystem(), parts.path if parts.scheme else url
    return stores.FileSystem.from_uri(url)


def _children(url: str) -> Iterator[tuple[str, bool, int, int, float | None]]:
    """(name, folder, size, time of change in ns, time of birth) of what is in a folder; links are left out."""
    where, path = store(url)
    if isinstance(where, stores.LocalFileSystem):
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_symlink():
                    continue
                st = e.stat(follow_symlinks=False)
                if e.is_dir(follow_symlinks=False) or e.is_file(follow_symlinks=False):
                    yield e.name, e.is_dir(follow_symlinks=False), st.st_size, st.st_mtime_ns, getattr(st, "st_birthtime", None)
        return
    for info in where.get_file_info(stores.FileSelector(path, allow_not_found=True)):
        if info.type != stores.FileType.NotFound:
            yield info.base_name, info.type == stores.FileType.Directory, info.size or 0, info.mtime_ns or 0, None


def _kind(url: str) -> str | None:
    """folder or file; None for a link and for what is not there."""
    where, path = store(url)
    if isinstance(where, stores.LocalFileSystem) and os.path.islink(path):
        return None
    kind = where.get_file_info(path).type
    return {stores.FileType.Directory: "folder", stores.FileType.File: "file"}.get(kind)


def _row(path: str, folder: bool, size: int, changed: int, born: float | None) -> tuple:
    time = lambda ns: None if ns is None else pd.Timestamp(ns // 1000, unit="us", tz="UTC")
    return path, folder, size, time(changed), time(None if born is None else int(born * 1e9))


def _walk(root: str, start: str, rules: Rules, given: bool, walk: int) -> Iterator[tuple]:
    """Wanted files below a folder, and the folders that were not walked. A path that was given may be a file, and
    its own folder is listed for it."""
    if given:
        kind, (parent, _, name) = _kind(at(root, start)), start.rpartition("/")
        if kind == "file" and rules.wanted(start) and (not parent or rules.reached(parent)):
            yield from (_row(start, False, *rest) for n, folder, *rest in _children(at(root, parent)) if n == name and not folder)
        if kind != "folder" or start and not rules.reached(start):
            return
    waiting, seen = [start], 0
    while waiting:
        folder = waiting.pop()
        if seen >= walk:
            yield _row(folder, True, 0, 0, None)
            continue
        try:
            for name, is_folder, size, changed, born in _children(at(root, folder)):
                seen += 1
                path = f"{folder}/{name}" if folder else name
                if is_folder:
                    if not rules.skipped(path):
                        waiting.append(path)
                elif rules.wanted(path):
                    yield _row(path, False, size, changed, born)
        except FileNotFoundError:
            continue


def listing(spark: SparkSession, root: str, rules: Rules, scopes: list[str] | None = None, walk: int = WALK) -> DataFrame:
    """(relative_path, size, file_modified_at, created_at) of the wanted files, below the scopes alone if there are any.
    Real files only; what goes meanwhile is left out. One step for every so many levels of a deep or wide tree."""

    def step(given: bool):
        def run(frames):
            for frame in frames:
                rows = [r for start in frame["relative_path"] for r in _walk(root, start, rules, given, walk)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in LISTING.split(", ")])

        return run

    frontier = spark.createDataFrame([(s,) for s in ([""] if scopes is None else scopes)], "relative_path string")
    found, given = None, True
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        met = stored(frontier.repartition(width, "relative_path").mapInPandas(step(given), LISTING))
        files = met.where("not folder").drop("folder")
        found = files if found is None else found.unionByName(files)
        frontier, given = met.where("folder").select("relative_path"), False
        if frontier.isEmpty():
            return found


def _dealt(rows: DataFrame, size: str, *keys: str) -> DataFrame:
    """Rows dealt to as many tasks as their bytes and their number ask for."""
    total = rows.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, -(-(total.bytes or 0) // TASK_BYTES), -(-total.n // TASK_FILES))
    return rows.repartition(tasks, *keys)


def whole(files: DataFrame, root: str, kind: str) -> DataFrame:
    """kind, relative_path, times and text (``raw``) of listed files; what is gone since is left out."""

    def run(batches):
        for b in batches:
            rows = {k: [] for k in range(b.num_rows)}
            texts = []
            for k, path in enumerate(b.column(0).to_pylist()):
                where, full = store(at(root, path))
                try:
                    with where.open_input_stream(full) as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except FileNotFoundError:
                    del rows[k]
            kept = b.take(pa.array(list(rows), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(texts), pa.string()), *kept.columns, pa.array(texts, pa.string())], ["kind", *b.schema.names, "raw"])

    # Arrow batches follow the rows of one task, which its bytes bound.
    picked = _dealt(files.select("relative_path", "size", "file_modified_at", "created_at"), "size", "relative_path").drop("size")
    return picked.mapInArrow(run, "kind string, relative_path string, file_modified_at timestamp, created_at timestamp, raw string")


# Lines


def range_bytes(url: str, start: int, end: int) -> tuple[bytes, bytes]:
    """The lines that begin in a range of a file, whole, with their ends; and the bytes of the range itself."""
    where, path = store(url)
    with where.open_input_file(path) as f:
        f.seek(max(0, start - 1))
        data = f.read(end - max(0, start - 1))
        own = data[1:] if start else data
        if start:
            first = data.find(b"\n")
            if first < 0 or first + 1 >= len(data):
                return b"", own
            data = data[first + 1 :]
        if data and not data.endswith(b"\n"):
            rest = []
            while block := f.read(1 << 16):
                k = block.find(b"\n")
                rest.append(block if k < 0 else block[: k + 1])
                if k >= 0:
                    break
            data += b"".join(rest)
    return data, own


def lines_in(data: bytes) -> list[bytes]:
    """Lines without their ends, LF or CR LF; a CR before the end of the file stays."""
    out = data.split(b"\n")
    last = out.pop()
    out = [x[:-1] if x.endswith(b"\r") else x for x in out]
    return out + [last] if last else out


def log_ranges(files: DataFrame, root: str, size: int = RANGE) -> DataFrame:
    """(source_file, start, end, lines, first_line, digest): the ranges of listed files with their lines counted, the
    number of the line before their first, and what their bytes hash to. Files are read once for it; what is known of a
    range is a row, and the sums before it are taken for each file over those."""
    cut = files.select(F.col("relative_path").alias("source_file"), F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size))).alias("start"), F.col("size").alias("whole"))
    cut = cut.select("source_file", F.col("start").cast("long").alias("start"), F.least(F.col("start") + size, "whole").cast("long").alias("end")).withColumn("bytes", F.col("end") - F.col("start"))

    def run(frames):
        for frame in frames:
            for path, start, end in zip(frame["source_file"], frame["start"], frame["end"]):
                try:
                    data, own = range_bytes(at(root, path), int(start), int(end))
                except FileNotFoundError:
                    continue
                n = data.count(b"\n") + (not data.endswith(b"\n") and data != b"")
                yield pd.DataFrame([(path, start, end, n, hashlib.blake2b(own, digest_size=16).hexdigest())], columns=["source_file", "start", "end", "lines", "digest"])

    counted = _dealt(cut, "bytes", "source_file", "start").drop("bytes").mapInPandas(run, "source_file string, start long, end long, lines long, digest string")
    before = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return stored(stored(counted).withColumn("first_line", F.coalesce(F.sum("lines").over(before), F.lit(0))))


def read_ranges(ranges: DataFrame, root: str) -> DataFrame:
    """(source_file, source_line, raw_line) of the lines that are not blank, numbered from 1 in their file."""

    def run(frames):
        for frame in frames:
            for path, start, end, first in zip(frame["source_file"], frame["start"], frame["end"], frame["first_line"]):
                try:
                    data, _ = range_bytes(at(root, path), int(start), int(end))
                except FileNotFoundError:
                    continue
                texts = [x.decode("utf-8", "replace") for x in lines_in(data)]
                rows = [(path, first + k, t) for k, t in enumerate(texts, 1) if t.strip(WHITE)]
                yield pd.DataFrame(rows, columns=["source_file", "source_line", "raw_line"])

    picked = _dealt(ranges.select("source_file", "start", "end", "first_line", (F.col("end") - F.col("start")).alias("bytes")), "bytes", "source_file", "start").drop("bytes")
    return picked.mapInPandas(run, "source_file string, source_line int, raw_line string")


def log_states(ranges: DataFrame) -> DataFrame:
    """(source_file, fingerprint): equal fingerprints mean equal bytes. Ranges are merged in any order."""
    part = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "start", "end", "digest"))
    merged = ranges.groupBy("source_file").agg(F.sum("lines").alias("n"), part(1).alias("a"), part(2).alias("b"))
    return merged.select("source_file", F.concat_ws("-", F.col("n").cast("string"), F.hex("a"), F.hex("b")).alias("fingerprint"))
