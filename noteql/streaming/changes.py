"""What changed in a folder since it was last looked at: listings compared as tables, and told in a bounded number of paths.

A listing is made by tasks and kept in parts, so neither it nor what changed in it is ever on the driver. What is told
to those that handle changes are paths; where more changed than may be told one by one, the folders that hold them.
"""

from __future__ import annotations

from noteql.sources import files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths that a batch names at most. Beyond, folders stand for what is below them.
PATHS = 1000
STATE = ("size", "file_modified_at")


def hidden(folder: str) -> bool:
    return folder.rpartition("/")[2].startswith(".")


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size, file_modified_at) of the files of a folder in any store, hidden folders left out."""
    return files.listing(spark, root, files.Rules("", hidden)).select("relative_path", *STATE)


def differences(before: DataFrame | None, now: DataFrame) -> DataFrame:
    """(relative_path, change) of files that were added, changed or removed. A renamed file is one of each of two. Paths
    are expected once on a side; without a side before, all are added."""
    if before is None:
        return now.select("relative_path", F.lit("added").alias("change"))
    state = F.struct(*STATE).alias("state")
    both = before.select("relative_path", state).alias("b").join(now.select("relative_path", state).alias("n"), "relative_path", "full")
    b, n = F.col("b.state"), F.col("n.state")
    change = F.when(b.isNull(), "added").when(n.isNull(), "removed").when(~b.eqNullSafe(n), "changed")
    return both.select("relative_path", change.alias("change")).where("change is not null")


def told(changes: DataFrame, limit: int = PATHS) -> DataFrame:
    """(relative_path, change, files): every changed path if there are at most ``limit``. Else folders of the greatest
    depth that leaves so few, with the number of changed files below and ``reconcile`` for their change; paths that are
    not so deep stay. The empty path, which is the whole folder, is the last resort, so nothing is left out."""
    parts = F.split("relative_path", "/")
    cut = changes.select("relative_path", "change", parts.alias("parts"))
    # Every folder above a path, and the path: told apart by depth, counted once each, map-side first.
    at = cut.select(F.explode(F.sequence(F.lit(0), F.size("parts"))).alias("depth"), "parts", F.size("parts").alias("deep"))
    ends = at.select("depth", F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("scope"), "deep")
    # A path of fewer parts than a depth is itself at all greater depths, and is counted at its own once.
    widths = ends.groupBy("depth", "scope").agg(F.max((F.col("deep") == F.col("depth")).cast("int")).alias("is_path"), F.max((F.col("deep") > F.col("depth")).cast("int")).alias("is_folder"))
    counts = widths.groupBy("depth").agg(F.sum("is_path").alias("paths"), F.count(F.lit(1)).alias("scopes")).orderBy("depth").collect()
    depth, shallower = 0, 0
    for c in counts:  # one row for every depth of the tree
        if shallower + c.scopes <= limit:
            depth = c.depth
        shallower += c.paths
    scope = F.when(F.size("parts") <= depth, F.col("relative_path")).otherwise(F.array_join(F.slice("parts", 1, depth), "/"))
    rolled = cut.select(scope.alias("scope"), F.when(F.col("relative_path") == scope, F.col("change")).otherwise("reconcile").alias("change"))
    # One row a scope: a folder whose name a file had is told once, as a folder.
    return rolled.groupBy(F.col("scope").alias("relative_path")).agg(F.max_by("change", F.col("change") == "reconcile").alias("change"), F.count(F.lit(1)).alias("files"))


def fold(paths: list[str], limit: int = PATHS) -> dict[str, str]:
    """Each of some paths with what stands for it: a path above it that is given too, or itself; and if those are more
    than ``limit``, folders of the greatest depth that leaves so few. For lists that are bounded already."""
    given = set(paths)
    above = lambda parts: next((s for k in range(len(parts)) if (s := "/".join(parts[:k])) in given), "/".join(parts))
    tops = {p: above(p.split("/")) for p in paths}
    deep = max((s.count("/") + 1 for s in tops.values()), default=0)
    for depth in range(deep, -1, -1):
        out = {p: "/".join(s.split("/")[:depth]) for p, s in tops.items()}
        if len(set(out.values())) <= limit:
            return out
    return dict.fromkeys(paths, "")
