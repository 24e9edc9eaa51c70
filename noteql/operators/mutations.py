"""Changes to metric logs, as transforms of row sets (source_file, source_line, raw_line)."""

from __future__ import annotations

import fcntl
import json
import os
import secrets
import time
from contextlib import contextmanager

from noteql.functions.dates import QueryError
from noteql.operators.metrics import FIELDS, parse_lines
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
UNCHANGED, CLEAR = object(), None


def new_id(now_ms: int | None = None) -> str:
    """26 characters: 48 bits of milliseconds and 80 random bits, in Crockford's base 32."""
    n = ((now_ms if now_ms is not None else time.time_ns() // 1_000_000) << 80) | secrets.randbits(80)
    return "".join(ALPHABET[(n >> shift) & 31] for shift in range(125, -1, -5))


def render(record: dict) -> str:
    """A record's line: known fields in their order, empty optional ones left out, then the others."""
    kept = {k: record[k] for k in FIELDS if record.get(k) not in (None, "", [], {})}
    return json.dumps(kept | {k: v for k, v in record.items() if k not in FIELDS}, ensure_ascii=False, separators=(",", ":"))


def _id_of(lines: DataFrame) -> DataFrame:
    return lines.withColumn("__id", F.try_variant_get(F.try_parse_json("raw_line"), "$.id", "string"))


def _checked(spark, record: dict) -> str:
    line = render(record)
    row = parse_lines(spark.createDataFrame([("", 1, line)], "source_file string, source_line int, raw_line string")).first()
    if row.status == "invalid":
        raise QueryError("; ".join(i.message for i in row.issues if i.severity == "error"))
    return line


def create(lines: DataFrame, source_file: str, record: dict) -> DataFrame:
    """With one row appended to a file; its id must be free in all files."""
    spark = lines.sparkSession
    line = _checked(spark, record)
    if not _id_of(lines).where(F.col("__id") == record["id"]).isEmpty():
        raise QueryError(f"id {record['id']!r} is taken")
    last = lines.where(F.col("source_file") == source_file).agg(F.max("source_line").alias("n")).first().n or 0
    return lines.unionByName(spark.createDataFrame([(source_file, last + 1, line)], "source_file string, source_line int, raw_line string"))


def _only(lines: DataFrame, record_id: str):
    found = _id_of(lines).where(F.col("__id") == record_id).limit(2).collect()
    if len(found) != 1:
        raise QueryError(f"id {record_id!r} names {'no row' if not found else 'several rows'}")
    return found[0]


def update(lines: DataFrame, record_id: str, patch: dict) -> DataFrame:
    """With the fields of one row set, or cleared where the patch says None; other rows keep their text."""
    row = _only(lines, record_id)
    record = json.loads(row.raw_line)
    for k, v in patch.items():
        if v is CLEAR:
            record.pop(k, None)
        elif v is not UNCHANGED:
            record[k] = v
    line = _checked(lines.sparkSession, record)
    here = (F.col("source_file") == row.source_file) & (F.col("source_line") == row.source_line)
    return lines.withColumn("raw_line", F.when(here, F.lit(line)).otherwise(F.col("raw_line")))


def delete(lines: DataFrame, record_id: str) -> DataFrame:
    """Without one row; a file without rows is no file."""
    row = _only(lines, record_id)
    return lines.where(~((F.col("source_file") == row.source_file) & (F.col("source_line") == row.source_line)))


def rename_file(lines: DataFrame, old: str, new: str) -> DataFrame:
    if not lines.where(F.col("source_file") == new).isEmpty():
        raise QueryError(f"{new!r} is there already")
    return lines.withColumn("source_file", F.when(F.col("source_file") == old, F.lit(new)).otherwise(F.col("source_file")))


def delete_file(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(F.col("source_file") != name)


def without_id(lines: DataFrame) -> DataFrame:
    """Rows that are objects whose id is absent, null or blank."""
    v = F.try_parse_json("raw_line")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.id", "variant"))
    blank = kind.isNull() | (kind == "VOID") | ((kind == "STRING") & (F.trim(F.try_variant_get(v, "$.id", "string")) == ""))
    return lines.where(F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & blank, F.lit(False)))


def assign_missing_ids(lines: DataFrame) -> DataFrame:
    """Rows without an id get one, in front; other rows keep their text. Ids are random, so whoever needs them twice
    stores the result. Only the rows without an id pass Python, in Arrow batches."""
    made = F.pandas_udf(lambda texts: texts.map(new_id_for), "string").asNondeterministic()
    missing = without_id(lines)
    rest = lines.join(missing.select("source_file", "source_line"), ["source_file", "source_line"], "left_anti")
    return rest.select(*lines.columns).unionByName(missing.withColumn("raw_line", made("raw_line")))


def new_id_for(line: str) -> str:
    """A line with a new id."""
    record = json.loads(line)
    return json.dumps({"id": new_id()} | {k: v for k, v in record.items() if k != "id"}, ensure_ascii=False, separators=(",", ":"))


@contextmanager
def exclusive(lock: str):
    """One writer at a time, over all that it reads, checks and writes."""
    os.makedirs(os.path.dirname(lock) or ".", exist_ok=True)
    with open(lock, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def edit_file(path: str, changed: dict[int, str | None], appended: list[str] = ()) -> int:
    """Replace lines of a log by number, remove those that are None, and append some; all others, blank ones too, stay as
    they are. The file is replaced at once, and removed if no line but blank ones is left. Returns the lines left."""
    left = 0
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8", newline="") as out:
        if os.path.exists(path):
            with open(path, encoding="utf-8", newline="") as have:
                for k, line in enumerate(have, 1):
                    line = changed.get(k, line) if k not in changed or changed[k] is None else changed[k] + "\n"
                    if line is not None:
                        left += bool(line.strip())
                        out.write(line if line.endswith("\n") else line + "\n")
        for line in appended:
            left += 1
            out.write(line + "\n")
    if left:
        os.replace(path + ".new", path)
    else:
        os.remove(path + ".new")
        if os.path.exists(path):
            os.remove(path)
    return left
