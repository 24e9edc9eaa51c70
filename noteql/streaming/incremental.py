"""Keeping the index current: snapshot differences, their application, and a stream of change batches.

An index is a folder of versions. Its tables are cut into parts by a hash of the note's id; a commit writes the parts
that changed to a new folder and then a new version file, which names the folder of every part, so readers see a whole
version or the one before. Files are reached by Hadoop's file systems alone, so the folder may be in any store.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context

from noteql.functions import extract
from noteql.functions.dates import QueryError
from noteql.operators import clusters, fts, links, metrics
from noteql.scratch import scope, stored
from noteql.sources import files
from noteql.streaming import changes
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA_VERSION = 8
#: Parts of every table of a new index.
PARTS = 32
#: How the rows of a part come, so that a scan for a term, or for a key and a span of days, reads few row groups.
ORDER = ("cluster", "term", "cls", "link_key", "target_key", "key_lower", "key", "day", "note_id")
#: What the part of a row is told by: the first of these columns that there is.
BY = ("cluster", "link_key", "target_key", "note_id", "source_id", "source_file", "relative_path")
#: Versions whose files stay for readers that are still at them, and how long those of no version stay that another
#: commit may be writing.
KEPT_VERSIONS, KEPT_MS = 4, 24 * 3600 * 1000


class Conflict(QueryError):
    """Somebody else has committed since the version that a commit rests on."""


class Catalog:
    """Versioned tables under a folder, in parts by note_id, or by source_id or source_file where there is none."""

    def __init__(self, spark: SparkSession, path: str, parts: int = PARTS):
        self.spark, self.path, self.parts = spark, path, parts
        self._jvm, self._known = spark.sparkContext._jvm, {}
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _versions(self) -> list[int]:
        found = self._fs.globStatus(self._at("version-*.json")) or ()
        return sorted(int(f.getPath().getName()[8:-5]) for f in found)

    def _pointer(self, version: int | None = None) -> dict:
        versions = self._versions()
        if not versions:
            return {"schema": SCHEMA_VERSION, "version": 0, "parts": self.parts, "tables": {}}
        version = version or versions[-1]
        if version not in self._known:  # a version never changes
            stream = self._fs.open(self._at(f"version-{version:012d}.json"))
            try:
                self._known[version] = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
        current = json.loads(self._known[version])
        if current["schema"] > SCHEMA_VERSION:
            raise QueryError("the index is of a newer version than this program")
        return current if current["schema"] == SCHEMA_VERSION else current | {"schema": SCHEMA_VERSION, "parts": self.parts, "tables": {}}

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    def part(self, name: str) -> Column:
        """The part that rows with this id belong to."""
        return F.pmod(F.xxhash64(F.col(name)), F.lit(self._pointer()["parts"])).cast("int")

    def parts_of(self, values: list) -> list[int]:
        """The parts that rows with these values are in."""
        kind = "int" if all(isinstance(v, int) for v in values) else "string"
        rows = self.spark.createDataFrame([(v,) for v in values], f"value {kind}")
        return sorted(r.part for r in rows.select(self.part("value").alias("part")).distinct().collect())

    def table(self, name: str, parts: list[int] | None = None) -> DataFrame | None:
        """A table, or some of its parts; files of the others are not looked at."""
        current = self._pointer()["tables"].get(name)
        return None if current is None else self.read(current, parts)

    def read(self, entry: dict, parts: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        folders = sorted(f"{self.path}/{f}" for p, f in entry["parts"].items() if parts is None or int(p) in set(parts))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame, parts: list[int] | None = None) -> dict:
        """Writes a table, or some parts of it, of the rows given; the others stay as they are. What it returns becomes
        the table by a commit, and can be read before."""
        current, folder = self._pointer(), f"{name}-{uuid.uuid4().hex}"
        by = next((c for c in BY if c in df.columns), "part")
        placed = df if by == "part" else df.drop("part").withColumn("part", F.pmod(F.xxhash64(by), F.lit(current["parts"])).cast("int"))
        order = [c for c in ORDER if c in df.columns] or [by]
        # A large part goes to several tasks and small ones share one, by their bytes; each task sorts its rows.
        placed = placed.hint("rebalance", F.col("part")).sortWithinPartitions("part", *order)
        placed.write.partitionBy("part").parquet(f"{self.path}/{folder}")
        made = {f.getPath().getName()[5:]: f"{folder}/{f.getPath().getName()}" for f in self._fs.globStatus(self._at(folder, "part=*")) or ()}
        before = current["tables"].get(name, {"parts": {}})["parts"]
        kept = {} if parts is None else {p: f for p, f in before.items() if int(p) not in set(parts)}
        return {"parts": kept | made, "schema": df.drop("part").schema.jsonValue()}

    def commit(self, tables: dict[str, DataFrame | dict], changed: dict[str, list[int]] | None = None, based_on: int | None = None, notes: dict | None = None) -> int:
        """A new version with these tables, given as rows or as ``write`` returned them. For tables named in ``changed``
        only those parts are written, of the rows given, and the others stay; other tables are written whole. ``notes``
        are kept in the version, by name. Raises Conflict if the version is not the one after ``based_on``, or if
        another writer was first; what was written for it goes then."""
        current = self._pointer()
        base, made = current["version"], []
        try:
            if based_on is not None and base != based_on:
                raise Conflict(f"version {base} was committed meanwhile")
            for name, df in tables.items():
                entry = df if isinstance(df, dict) else self.write(name, df, (changed or {}).get(name))
                before = set(current["tables"].get(name, {"parts": {}})["parts"].values())
                made += [f.split("/")[0] for f in entry["parts"].values() if f not in before]
                current["tables"][name] = entry
            current["version"] = base + 1
            current["notes"] = current.get("notes", {}) | (notes or {})
            self._publish(current)
        except Conflict:
            for folder in set(made):
                self._fs.delete(self._at(folder), True)
            raise
        self.vacuum()
        return current["version"]

    def note(self, name: str):
        """What the current version keeps by a name, if anything."""
        return self._pointer().get("notes", {}).get(name)

    def _publish(self, current: dict) -> None:
        """The version file is created where none is: one of several writers succeeds, whatever they see before it."""
        final, text = self._at(f"version-{current['version']:012d}.json"), json.dumps(current).encode()
        self._fs.mkdirs(self._at())
        lost = Conflict(f"version {current['version']} was committed by another writer")
        where = self._fs.makeQualified(final).toUri()
        if where.getScheme() == "file":
            # Complete under a name of its own first; a link to it is made at once, and fails if there is one.
            draft = f"{where.getPath()}.{uuid.uuid4().hex}"
            with open(draft, "xb") as f:
                f.write(text)
            try:
                os.link(draft, where.getPath())
            except FileExistsError:
                raise lost from None
            finally:
                os.remove(draft)
            return
        try:
            stream = self._fs.createFile(final).overwrite(False).build()
            try:
                stream.write(bytearray(text))
            finally:
                stream.close()
        except Py4JJavaError as e:
            if self._fs.exists(final):
                raise lost from e
            raise

    def remove_others(self, folder: str) -> int:
        """Remove what else is in the folder that this index is in; returns how many."""
        top = self._jvm.org.apache.hadoop.fs.Path(folder)
        others = [f.getPath() for f in self._fs.listStatus(top) if f.getPath().getName() != self._at().getName()]
        for path in others:
            self._fs.delete(path, True)
        return len(others)

    def vacuum(self, keep: int = KEPT_VERSIONS, age_ms: int = KEPT_MS) -> int:
        """Remove the version files but the last ones, the folders that those of the removed alone name, and folders of
        no version that are older than ``age_ms``, which commits that failed have left; returns how many."""
        versions = self._versions()
        folders = lambda some: {f.split("/")[0] for v in some for t in self._pointer(v)["tables"].values() for f in t["parts"].values()}
        named, used = folders(versions[-keep:]), folders(versions[:-keep])
        now = self._jvm.java.lang.System.currentTimeMillis()
        stray = [f.getPath() for f in self._fs.listStatus(self._at()) if f.isDirectory() and re.fullmatch(r"[a-z_]+-[0-9a-f]{32}", f.getPath().getName()) and f.getPath().getName() not in named | used and now - f.getModificationTime() > age_ms]
        old = [self._at(f"version-{v:012d}.json") for v in versions[:-keep]] + [self._at(f) for f in used - named] + stray
        for path in old:
            self._fs.delete(path, True)
        return len(old)


def file_states(spark: SparkSession, path: str) -> str:
    """A name for the files at a path as they are now: their paths, sizes and times of change, hashed."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    found = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    states = []
    while found.hasNext():
        f = found.next()
        states.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(states)).encode()).hexdigest()[:24]


def below(path: Column, scope: str) -> Column:
    """Paths at or under a scope, as a prefix that reaches the scan."""
    return F.lit(True) if scope == "" else (path == scope) | F.startswith(path, F.lit(scope + "/"))


def in_scopes(rows: DataFrame, scopes: list[str] | None) -> DataFrame:
    if scopes is None:
        return rows
    test = F.lit(False)
    for s in scopes:
        test = test | below(F.col("relative_path"), s)
    return rows.where(test)


def plan(inventory: DataFrame, index: DataFrame, scopes: list[str] | None = None, force: bool = False, stale_vectors: DataFrame | None = None) -> DataFrame:
    """(note_id, action) for notes to add, update or remove: a full outer join of what is there (note_id,
    relative_path, file_modified_at, fingerprint) and what is indexed, within the scopes. A note is updated if that is
    forced, its vector is stale, its file is newer, or its fingerprint differs."""
    now = in_scopes(inventory, scopes).select("note_id", F.col("file_modified_at").alias("m1"), F.col("fingerprint").alias("f1"))
    old = in_scopes(index, scopes).select("note_id", F.col("file_modified_at").alias("m0"), F.col("fingerprint").alias("f0"))
    both = now.join(old, "note_id", "full")
    changed = F.lit(force) | (F.col("m1") > F.col("m0")) | ~F.col("f1").eqNullSafe(F.col("f0"))
    if stale_vectors is not None:
        both = both.join(stale_vectors.select("note_id").distinct().withColumn("sv", F.lit(True)), "note_id", "left")
        changed = changed | F.coalesce("sv", F.lit(False))
    action = F.when(F.col("f1").isNull() & F.col("m1").isNull(), "remove").when(F.col("f0").isNull() & F.col("m0").isNull(), "add").when(changed, "update")
    return both.select("note_id", action.alias("action")).where("action is not null")


def fingerprinted(notes: DataFrame) -> DataFrame:
    meta = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return notes.withColumn("fingerprint", extract.content_fingerprint(F.col("relative_path"), F.transform_values(meta, lambda k, v: F.coalesce(v, F.lit("null"))), F.col("content")))


def apply(index: DataFrame, notes: DataFrame, actions: DataFrame) -> DataFrame:
    """The index with removed and updated notes taken out and added and updated ones put in. A note that was there
    keeps its created_at."""
    out = index.join(actions.where("action in ('remove', 'update')").select("note_id"), "note_id", "left_anti")
    new = notes.join(actions.where("action in ('add', 'update')").select("note_id"), "note_id", "left_semi")
    born = index.select("note_id", F.col("created_at").alias("born"))
    new = new.join(born, "note_id", "left").withColumn("created_at", F.coalesce("born", "created_at")).drop("born")
    return out.unionByName(new.select(*index.columns))


def remove_note(index: DataFrame, edges: DataFrame, vectors: DataFrame, note_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without a note: its row, its links and its vector go, links to it lead nowhere."""
    kept = edges.where(F.col("source_id") != note_id)
    gone = F.col("target_id").eqNullSafe(F.lit(note_id))
    kept = kept.withColumn("reason", F.when(gone, "unresolved").otherwise(F.col("reason"))).withColumn("target_id", F.when(~gone, F.col("target_id")))
    return index.where(F.col("note_id") != note_id), kept, vectors.where(F.col("note_id") != note_id)


def _parts(catalog: Catalog, **columns: Column | DataFrame) -> dict[str, list[int]]:
    """The parts that the rows of each table (of one column) are in. One job; at most as many rows as there are parts."""
    every = None
    for name, df in columns.items():
        rows = df.select(F.lit(name).alias("name"), catalog.part(df.columns[0]).alias("part"))
        every = rows if every is None else every.unionByName(rows)
    found = every.distinct().collect()
    return {name: sorted(r.part for r in found if r.name == name) for name in columns}


def reindex(catalog: Catalog, notes: DataFrame, scopes: list[str] | None = None, force: bool = False, again: Callable[[DataFrame], DataFrame] | None = None, marks: dict | None = None) -> dict[str, int]:
    """One pass: what is to be added, updated and removed, and a commit of the parts that this touches.

    Notes, terms and lengths are rewritten in the parts of changed notes. Links are kept by their look-up keys, and so is
    what they can lead to: keys that changed notes gain or lose are a delta, and the links of those keys, found in
    their parts alone, are resolved again, as are those of changed notes. ``again`` reads the notes of some ids (column
    note_id) anew, so that of the others nothing but their fingerprints is made. ``marks`` are kept in the version.
    Returns the number of notes by action; nothing is written if nothing is to be done."""
    states = fingerprinted(notes)
    version, index = catalog.version, catalog.table("notes")
    first = index is None
    actions = stored(plan(states, states.limit(0) if first else index, scopes, force))
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    if not counts:
        return {}
    ids, changed = actions.select("note_id"), actions.where("action <> 'remove'").select("note_id")
    fresh = fingerprinted(again(changed)) if again is not None else states.join(changed, "note_id", "left_semi")
    parts = None if first else _parts(catalog, notes=ids)["notes"]
    here = lambda name: catalog.table(name, parts)
    if first:
        entry = {"notes": catalog.write("notes", fresh)}
    else:
        was = stored(here("notes").join(ids, "note_id", "left_semi"))
        born = was.select("note_id", F.col("created_at").alias("born"))
        fresh = fresh.join(born, "note_id", "left").withColumn("created_at", F.coalesce("born", "created_at")).drop("born")
        entry = {"notes": catalog.write("notes", here("notes").join(ids, "note_id", "left_anti").unionByName(fresh.select(*index.columns)), parts)}
    # From here on changed notes are read as they were written.
    fresh = catalog.read(entry["notes"], parts).join(changed, "note_id", "left_semi")
    # Links and terms have nothing to do with each other, so their jobs run side by side.
    with ThreadPoolExecutor(2) as pool:
        side = lambda f, *args: pool.submit(copy_context().run, f, *args)  # noqa: E731  tables of both are of one scope
        made = [side(_link_tables, catalog, None if first else was, fresh, ids), side(_term_tables, catalog, fresh, ids, parts)]
        for m in made:
            entry |= m.result()
    catalog.commit(entry, None, version, marks)
    return counts


def _link_tables(catalog: Catalog, was: DataFrame | None, fresh: DataFrame, ids: DataFrame) -> dict[str, dict]:
    """Target keys and links with changed notes as they are now instead of as they were."""
    found = stored(links.extract_links(fresh).withColumn("link_key", links.link_key(F.col("target"))))
    if was is None:
        targets = catalog.write("targets", links.target_keys(fresh))
        return {"targets": targets, "edges": catalog.write("edges", links.resolve(found, None, sets=links.sets_of(catalog.read(targets))))}
    before, after = links.target_keys(was), links.target_keys(fresh)
    delta = stored(before.exceptAll(after).unionByName(after.exceptAll(before)))
    left = links.extract_links(was).select(links.link_key(F.col("target")).alias("link_key"))
    moved = links.moved_keys(delta)
    at = _parts(catalog, targets=delta.select("target_key"), edges=left.unionByName(found.select("link_key")).unionByName(moved))
    kept = catalog.table("targets", at["targets"]).join(ids, "note_id", "left_anti")
    mine = after.where(catalog.part("target_key").isin(at["targets"]))
    targets = catalog.write("targets", kept.unionByName(mine.select(kept.columns)), at["targets"])
    others = catalog.table("edges", at["edges"]).join(ids.withColumnRenamed("note_id", "source_id"), "source_id", "left_anti")
    again = stored(others.join(moved, "link_key", "left_semi").select(found.columns).unionByName(found))
    keys = catalog.read(targets, _parts(catalog, keys=links.looked_for(again))["keys"])
    resolved = links.resolve(again, None, sets=links.sets_of(keys))
    return {"targets": targets, "edges": catalog.write("edges", others.join(moved, "link_key", "left_anti").select(resolved.columns).unionByName(resolved), at["edges"])}


def _term_tables(catalog: Catalog, fresh: DataFrame, ids: DataFrame, parts: list[int] | None) -> dict[str, dict]:
    """Terms of changed notes are made anew, those of their neighbours in a part are taken over."""
    postings, lengths = fts.build(fresh, extract.content_document(F.col("note_id"), F.col("title"), F.col("content")), extract.metadata_document(F.col("metadata_json")), stem=True, said=F.concat_ws("\n", "note_id", "title", "content", "metadata_json"))
    if parts is not None:
        kept = lambda name: catalog.table(name, parts).join(ids, "note_id", "left_anti")
        postings, lengths = kept("postings").unionByName(postings), kept("lengths").unionByName(lengths)
    out = {"postings": catalog.write("postings", postings, parts), "lengths": catalog.write("lengths", lengths, parts)}
    terms, corpus = fts.summaries(catalog.read(out["postings"], parts), catalog.read(out["lengths"], parts), catalog.part("note_id"))
    return out | {"terms": catalog.write("terms", terms, parts), "corpus": catalog.write("corpus", corpus, parts)}


def reindex_metrics(catalog: Catalog, logs: DataFrame, root: str, force: bool = False, size: int = files.RANGE) -> dict[str, int]:
    """The same for metric logs, from their listing (relative_path, size, file_modified_at): a log is parsed again if its
    bytes differ or that is forced. All logs are read in ranges of ``size`` bytes, whose hashes tell what changed; the
    ranges of changed logs are read again as lines. Tables metric_files (source_file, fingerprint, file_modified_at,
    counts), metric_rows, the parsed rows with their issues, by key and day, and metric_days, what every log adds to the
    sums of a day."""
    version = catalog.version
    ranges = files.log_ranges(logs, root, size)
    now = logs.select(F.col("relative_path").alias("source_file"), "file_modified_at").join(files.log_states(ranges), "source_file")
    old, rows, days = (catalog.table(n) for n in ("metric_files", "metric_rows", "metric_days"))
    before = now.limit(0) if old is None else old.select("source_file", "fingerprint", "file_modified_at")
    both = now.alias("a").join(before.alias("b"), "source_file", "full").select("source_file", F.col("a.fingerprint").alias("f1"), F.col("b.fingerprint").alias("f0"))
    action = F.when(F.col("f1").isNull(), "remove").when(F.col("f0").isNull(), "add").when(F.lit(force) | (F.col("f1") != F.col("f0")), "update")
    actions = stored(both.select("source_file", action.alias("action")).where("action is not null"))
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    if not counts:
        return {}
    parts = [r.part for r in actions.select(catalog.part("source_file").alias("part")).distinct().collect()]
    touched, changed = actions.select("source_file"), actions.where("action <> 'remove'").select("source_file")
    # Lines are read and parsed once, as three tables are made of them.
    parsed = stored(metrics.clustered(metrics.parse_lines(files.read_ranges(ranges.join(changed, "source_file", "left_semi"), root))))
    summary = now.join(changed, "source_file", "left_semi").join(metrics.file_summary(parsed), "source_file", "left").na.fill(0)
    sums = metrics.daily_parts(metrics.records(parsed))
    only = None
    if old is not None and rows is not None and days is not None:
        here = lambda df: df.where(catalog.part("source_file").isin(parts)).join(touched, "source_file", "left_anti")
        parsed, summary, sums = here(rows).unionByName(parsed), here(old).unionByName(summary), here(days).unionByName(sums)
        only = {n: parts for n in ("metric_files", "metric_rows", "metric_days")}
    catalog.commit({"metric_files": summary, "metric_rows": parsed, "metric_days": sums}, only, version)
    return counts


def kept_index(catalog: Catalog, stem: bool = True) -> fts.Kept | None:
    tables = [catalog.table(n) for n in ("postings", "lengths", "terms", "corpus")]
    return None if any(t is None for t in tables) else fts.Kept(*tables, stem=stem)


def kept_vectors(catalog: Catalog, model: str) -> clusters.Clustered | None:
    """A model's vectors by cluster (tables ``near`` and ``clusters``); a look-up opens the parts of its clusters alone."""
    known = catalog.table("clusters")
    if known is None or catalog.table("near") is None:
        return None

    def read(some: list[int] | None) -> DataFrame:
        if some is None:
            return catalog.table("near").where(F.col("model") == model)
        return catalog.table("near", catalog.parts_of(some)).where((F.col("model") == model) & F.col("cluster").isin(some))

    return clusters.load(known.where(F.col("model") == model), read)


def model_changed(meta: dict | None, model: dict) -> bool:
    """Whether stored vectors are of another preset, repository or dimension, and must all go."""
    return meta is None or any(meta.get(k) != model.get(k) for k in ("preset", "repository", "dimension"))


FAILED = "relative_path string, error string, tries int"
#: How often a folder is looked at.
TICK = {"processingTime": "1 second"}


def watch(spark: SparkSession, root: str, handle: Callable[[list[str]], None], checkpoint: str, trigger: dict | None = None, catalog: Catalog | None = None, limit: int = changes.PATHS, name: str | None = None):
    """Calls ``handle`` with the changed paths of every batch: files, or folders that stand for more than ``limit`` files.

    At every tick the folder is listed by tasks and compared with its listing of the last batch that counted, which is
    kept in the catalogue (one in the checkpoint folder if none is given) in parts. Both may be in any store. Batches
    count once, and failed ones are tried again: see ``look``. Tables that a batch stores go at its end. ``name`` is the
    query's, by which ``Progress.follow`` knows it."""
    catalog = catalog or Catalog(spark, f"{checkpoint.rstrip('/')}/seen")

    def batch(_: DataFrame, number: int) -> None:
        with scope(spark):
            look(catalog, root, handle, checkpoint, number, limit)

    # The source counts the triggers, so that each is a batch; what it is about is in the folder.
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.queryName(name) if name else writer).trigger(**(trigger or TICK)).start()


def look(catalog: Catalog, root: str, handle: Callable[[list[str]], None], checkpoint: str, number: int, limit: int = changes.PATHS) -> bool:
    """One batch: what changed below a folder since the last one that counted; returns whether it was handled now.

    The new listing is committed with the batch's number, in the parts that changed, after the changes were handled: a
    batch that is stopped before that finds them again. Where the old listing is lost, or the folder cannot be listed,
    nobody knows what changed, and the whole folder (the empty path) is told; in the latter case as an issue, with the
    next batch, and the old listing stays."""
    name = f"batch:{stream_name(catalog.spark, checkpoint)}"
    done = catalog.note(name)
    if done is not None and done >= number:
        return False
    try:
        now = stored(changes.snapshot(catalog.spark, root))
    except Exception as e:  # noqa: BLE001  a store that does not answer is no folder without files
        return _settle(catalog, name, number, {"": f"{type(e).__name__}: {e}"}, {}, limit=limit)
    try:
        seen = catalog.table("seen")
        found = stored(changes.differences(seen, now))
        lost = seen is None and done is not None
    except Exception:  # noqa: BLE001  files of the listing are gone or cannot be read
        seen, found, lost = None, stored(changes.differences(None, now)), True
    moved = not found.isEmpty()
    paths = [""] if lost else [r.relative_path for r in changes.told(found, limit).select("relative_path").collect()] if moved else []
    tables, parts = {}, {}
    if seen is None and (moved or lost):
        tables = {"seen": now}
    elif moved:
        parts = {"seen": _parts(catalog, seen=found.select("relative_path"))["seen"]}
        tables = {"seen": now.where(catalog.part("relative_path").isin(parts["seen"]))}
    return run_batch(catalog, handle, checkpoint, number, paths, tables, parts, limit)


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name of a stream for its batches: the id that its checkpoint folder gives it, which a new one would not have."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint, "metadata")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return checkpoint
    stream = fs.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def run_batch(catalog: Catalog, handle: Callable[[list[str]], None], checkpoint: str, number: int, paths: list[str], tables: dict[str, DataFrame] | None = None, changed: dict[str, list[int]] | None = None, limit: int = changes.PATHS) -> bool:
    """Handles the paths of one batch of a stream, and those of batches that failed; returns whether that was done now.

    A batch counts once: its number is kept in a version of the index, with the ``tables`` given (and the parts of them
    that ``changed``), and one that comes again after that does nothing. The paths of a batch that fails are kept as
    issues (table ``failed``: relative_path, error, tries) and are tried again with the next batch; of more than
    ``limit`` their folders are."""
    name = f"batch:{stream_name(catalog.spark, checkpoint)}"
    done, failed = catalog.note(name), catalog.table("failed")
    if done is not None and done >= number:
        return False
    open_ = {} if failed is None else {r.relative_path: r.tries for r in failed.collect()}
    stands = changes.fold(sorted({*paths, *open_}), limit)
    todo = sorted(set(stands.values()))
    if not todo and not tables:
        return False
    errors = {}
    try:
        if todo:
            handle(todo)
    except Exception as e:  # noqa: BLE001  the stream outlives a bad batch
        errors = dict.fromkeys(todo, f"{type(e).__name__}: {e}")
    tries = {}
    for path, n in open_.items():
        tries[stands[path]] = max(n, tries.get(stands[path], 0))
    return _settle(catalog, name, number, errors, tries, tables, changed, limit) if errors or open_ or tables or todo else False


def _settle(catalog: Catalog, name: str, number: int, errors: dict[str, str], tries: dict[str, int], tables: dict[str, DataFrame] | None = None, changed: dict[str, list[int]] | None = None, limit: int = changes.PATHS) -> bool:
    """Commits a batch with the paths that stay open; returns whether none does."""
    failed = catalog.table("failed")
    kept = {}
    if "" in errors and not tries and failed is not None:  # the folder could not be listed: what was open stays so
        kept = {r.relative_path: (r.relative_path, r.error, r.tries) for r in failed.collect()}
        tries = {p: r[2] for p, r in kept.items()}
    rows = list((kept | {p: (p, e[:2000], tries.get(p, 0) + 1) for p, e in errors.items()}).values())
    tables = dict(tables or {})
    if rows or failed is not None and not failed.isEmpty():
        tables["failed"] = catalog.spark.createDataFrame(rows, FAILED)
    catalog.commit(tables, changed, notes={name: number})
    return not errors
