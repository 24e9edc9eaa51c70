"""Tables that a job writes to the folder that driver and executors share, and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from noteql.functions.dates import QueryError
from pyspark.sql import DataFrame, SparkSession

#: Names the tables of this process.
RUN = f"noteql-scratch-{uuid.uuid4().hex[:12]}"
#: The tables written within ``scope``, if in one.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session of one process, as in tests, may name none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise QueryError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "noteql-shared")
    return path.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """The table, written once: its size is known to the optimiser, and lost executors cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{RUN}-{uuid.uuid4().hex}"
    written = _WRITTEN.get()
    if written is not None:
        written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were stored within: for work that goes on for long and leaves nothing that
    reads them. Threads take part that run in a copy of the context."""
    mine: list[str] = []
    token = _WRITTEN.set(mine)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        for name in mine:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clean(spark: SparkSession) -> int:
    """Delete this process's tables; returns their number. Results that still read them must be stored before."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.globStatus(jvm.org.apache.hadoop.fs.Path(top, f"{RUN}-*")) or ()]
    for path in found:
        fs.delete(path, True)
    return len(found)
