"""One object for a collection on disk: its index, and every question by name.

``Workspace.call("search", query="a NOT b")`` and ``Workspace.search("a NOT b")`` are the same. Answers are DataFrames,
or dicts of them for context views; ``payload`` makes documents of small ones.
"""

from __future__ import annotations

import os
from datetime import UTC, date, datetime

import numpy as np
from noteql.functions import extract
from noteql.functions.dates import QueryError
from noteql.operators import clusters, context, fts, links, metrics, mutations, notes, vectors
from noteql.plans.query import clean_for_embedding
from noteql.scratch import stored
from noteql.sources import files, vault
from noteql.streaming.incremental import Catalog, kept_index, kept_vectors, model_changed, reindex, reindex_metrics, watch
from noteql.streaming.progress import Progress
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vectors of a model are put in new clusters when there are so many times as many as when its centres were fitted.
GROWTH = 4


def _near(rows: DataFrame) -> DataFrame:
    """Vectors as they are kept by cluster."""
    return rows.select(F.col("placed").alias("cluster"), "note_id", "model", "vector", "cosine")


class Workspace:
    def __init__(self, spark: SparkSession, root: str, index: str | None = None, settings: vault.Settings | None = None, embedder: vectors.Embedder | None = None, model: str = "hashing"):
        self.spark, self.root = spark, root
        self.settings = settings or vault.load_settings(root)
        self.catalog = Catalog(spark, index or os.path.join(root, self.settings.internal))
        self.embedder, self.model = embedder or vectors.hashing_embedder(), model

    # The index

    def reindex(self, paths: list[str] | None = None, force: bool = False, progress: Progress | None = None) -> dict[str, int]:
        """Brings notes, links and terms up to date, for some paths or all; then metric logs, and vectors of notes that
        changed. ``progress`` is told of every phase."""
        tell = progress or Progress()
        scopes = None if paths is None else vault.scopes(paths)
        tell("notes", "running")
        listed = vault.list_vault(self.spark, self.root, settings=self.settings, subtrees=scopes, distinct=True)
        load = lambda some: vault.load_notes(vault.inventory(files.whole(some, self.root, "notes"), distinct=True))
        named = listed.withColumn("note_id", vault.note_id(F.col("relative_path")))
        counts = reindex(self.catalog, load(listed), scopes, force, lambda ids: load(named.join(ids, "note_id", "left_semi").drop("note_id")))
        tell("notes", "done", counts)
        logs = self._reindex_logs(force)
        tell("metrics", "done", logs)
        if counts:
            tell("vectors", "running")
            self._embed()
        tell("vectors", "done")
        return counts

    def _logs(self) -> DataFrame:
        return vault.list_vault(self.spark, self.root, "metrics", self.settings)

    def _reindex_logs(self, force: bool = False) -> dict[str, int]:
        return reindex_metrics(self.catalog, self._logs(), self.root, force)

    def _embed(self) -> None:
        """Vectors of this model for notes that changed or have none, in the parts of those notes alone; vectors of other
        models stay beside them. A model that is not what it was loses all of its own."""
        described = {"preset": self.model, "repository": type(self.embedder).__name__, "dimension": len(self.embedder("dimension"))}
        models = self.catalog.note("models") or {}
        current = self.notes.withColumn("indexed_at", F.coalesce("file_modified_at", F.lit(datetime(1970, 1, 1, tzinfo=UTC))))
        stored_ = self.catalog.table("vectors")
        every = self.spark.createDataFrame([], "note_id string, vector array<float>, model string, indexed_at timestamp, placed int, cosine double") if stored_ is None else stored_
        old = every.where(F.col("model") == self.model)
        if model_changed(models.get(self.model), described):
            old = old.limit(0)
        touched = stored(vectors.stale(current, old, self.model).withColumn("stale", F.lit(True)).unionByName(every.select("note_id").join(current, "note_id", "left_anti").distinct().withColumn("stale", F.lit(False))))
        parts = None if stored_ is None else sorted(r.part for r in touched.select(self.catalog.part("note_id").alias("part")).distinct().collect())
        if parts == []:
            return
        fields = F.from_json("metadata_json", "map<string,string>")
        lines = F.transform(F.map_entries(F.map_filter(fields, lambda k, v: v.isNotNull() & ~k.isin("title", "tags"))), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
        text = extract.embedding_text(F.col("title"), F.coalesce(lines, F.array().cast("array<string>")), F.col("tags"), F.col("content"))
        made = stored(vectors.embed_notes(current.join(touched.where("stale"), "note_id", "left_semi"), text, self.embedder, self.model, F.col("indexed_at")))
        known = self.catalog.table("clusters")
        ours = None if known is None else known.where(F.col("model") == self.model)
        size, fitted = old.count() + made.count(), models.get(self.model, {}).get("fitted", 0)
        if ours is None or self.catalog.table("near") is None or old.isEmpty() or size > GROWTH * fitted:
            entry, fitted = self._place_all(every, made, touched, known), size
        else:
            entry = self._place(parts, made, touched, known, ours)
        self.catalog.commit(entry, notes={"models": models | {self.model: described | {"fitted": fitted}}})

    def _staying(self, rows: DataFrame, touched: DataFrame, how: str = "left_anti") -> DataFrame:
        """Vectors of notes that are gone go, and those of this model whose notes changed."""
        of = touched.select("note_id", F.when(F.col("stale"), F.lit(self.model)).alias("of"))
        return rows.join(of, (rows.note_id == of.note_id) & F.coalesce(rows.model == F.col("of"), F.lit(True)), how)

    def _place_all(self, every: DataFrame, made: DataFrame, touched: DataFrame, known: DataFrame | None) -> dict:
        """All vectors of this model by new centres."""
        staying, columns = self._staying(every, touched), made.columns
        mine = stored(staying.where(F.col("model") == self.model).select(columns).unionByName(made))
        centres = clusters.fit(mine)
        placed = clusters.placed(mine, centres).withColumnRenamed("cluster", "placed")
        others = staying.where(F.col("model") != self.model)
        entry = {"vectors": self.catalog.write("vectors", others.unionByName(placed))}
        rows = self.catalog.read(entry["vectors"])
        entry["near"] = self.catalog.write("near", _near(rows))
        counted = clusters.summary(_near(rows.where(F.col("model") == self.model)))
        return entry | self._clusters(clusters.described(counted, centres), known)

    def _place(self, parts: list[int] | None, made: DataFrame, touched: DataFrame, known: DataFrame, ours: DataFrame) -> dict:
        """New vectors by the centres there are: the parts of their notes, and of the clusters they leave and enter."""
        centres = {r.id: r.centre for r in ours.select("id", "centre").collect() if r.centre is not None}
        table = np.zeros((max(centres, default=-1) + 1, len(next(iter(centres.values()), []))))
        for cluster, centre in centres.items():
            table[cluster] = centre
        here = self.catalog.table("vectors", parts)
        placed = clusters.placed(made, table).withColumnRenamed("cluster", "placed")
        entry = {"vectors": self.catalog.write("vectors", self._staying(here, touched).unionByName(placed), parts)}
        fresh = self.catalog.read(entry["vectors"], parts).where(F.col("model") == self.model).join(touched.where("stale"), "note_id", "left_semi")
        left = self._staying(here, touched, "left_semi")
        both = left.select("placed").unionByName(fresh.select("placed")).distinct().collect()  # cluster numbers
        at = self.catalog.parts_of([r.placed for r in both])
        entry["near"] = self.catalog.write("near", self._staying(self.catalog.table("near", at), touched).unionByName(_near(fresh)), at)
        return entry | self._clusters(clusters.described(clusters.summary(_near(fresh)), table, ours), known)

    def _clusters(self, mine: DataFrame, known: DataFrame | None) -> dict:
        """The table of clusters with this model's rows as given; it has one part."""
        mine = mine.withColumn("model", F.lit(self.model))
        return {"clusters": self.catalog.write("clusters", (mine if known is None else known.where(F.col("model") != self.model).unionByName(mine)).withColumn("part", F.lit(0)))}

    def _vectors(self) -> clusters.Clustered:
        found = kept_vectors(self.catalog, self.model)
        if found is None:
            raise QueryError("nothing is indexed yet")
        return found

    def watch(self, checkpoint: str, trigger: dict | None = None, progress: Progress | None = None, name: str = "watch"):
        """A stream that reindexes what changes on disk. ``progress`` is told of its batches and of the phases of each; the
        listener that tells of batches stays until ``spark.streams.removeListener`` (it is the query's ``listener``)."""
        listener = None if progress is None else progress.follow(self.spark, name)
        query = watch(self.spark, self.root, lambda paths: self.reindex(paths, progress=progress), checkpoint, trigger, self.catalog, name=None if progress is None else name)
        query.listener = listener
        return query

    def _table(self, name: str) -> DataFrame:
        found = self.catalog.table(name)
        if found is None:
            raise QueryError("nothing is indexed yet")
        return found

    @property
    def notes(self) -> DataFrame:
        return self._table("notes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    @property
    def parsed(self) -> DataFrame:
        """Parsed rows of the logs, from the index."""
        found = self.catalog.table("metric_rows")
        none = "source_file string, source_line int, raw_line string"
        return metrics.parse_lines(self.spark.createDataFrame([], none)) if found is None else found

    @property
    def records(self) -> DataFrame:
        return metrics.records(self.parsed)

    def knowledge(self) -> context.Knowledge:
        logs = self.catalog.table("metric_files")
        logs = None if logs is None else logs.withColumnRenamed("source_file", "relative_path")
        return context.Knowledge(self.notes, self.records, self.edges, self.catalog.table("vectors"), metrics.issues(self.parsed), logs, self.catalog.table("metric_days"), kept_index(self.catalog))

    # Search

    def _indexed(self) -> fts.Kept:
        found = kept_index(self.catalog)
        if found is None:
            raise QueryError("nothing is indexed yet")
        return found

    def search(self, query: str, mode: str = "fts", limit: int = fts.DEFAULT_LIMIT, now: datetime | None = None) -> DataFrame:
        dates = vault.metadata_dates(self.notes)
        if mode == "fts":
            found = fts.search(self._indexed(), query, limit, now, dates)
        elif mode == "semantic":
            q = fts.parse(query, now)
            found = vectors.semantic_search(self._indexed(), self._vectors(), self.embedder(clean_for_embedding(query)), limit, q.filters, q.excludes, dates, stem=True)
        elif mode == "hybrid":
            found = vectors.hybrid_search(self._indexed(), self._vectors(), query, self.embedder, limit, now, dates)
        else:
            raise QueryError(f"unknown mode {mode!r}")
        words = F.lit(" ".join(sorted(fts.words_of([fts.parse(query, now).expr]))))
        noted = self.notes.select("note_id", "title", "relative_path", F.col("metadata_json").alias("metadata"), "content")
        # As many rows as the limit.
        out = found.join(noted, "note_id", "left").withColumn("preview", extract.snippet(F.coalesce("content", F.lit("")), words)).drop("content")
        return out.orderBy(F.col("score" if "score" in found.columns else "similarity").desc(), "note_id")

    def related(self, note: str, strategy: str = "auto", limit: int = fts.DEFAULT_LIMIT) -> DataFrame:
        found = kept_vectors(self.catalog, self.model)
        indexed = None if found is None else self._indexed()
        return vectors.related_notes(strategy, self.resolve(note), limit, self.notes, self.edges, indexed, found, self.embedder, metadata_dates=vault.metadata_dates(self.notes))

    # Links

    def resolve(self, reference: str) -> str:
        return links.resolve_reference(reference, self.notes)

    def backlinks(self, note: str) -> DataFrame:
        return links.backlinks(self.edges, self.resolve(note))

    def forward_links(self, note: str) -> DataFrame:
        return links.forward_links(self.edges, self.resolve(note))

    def link_context(self, note: str) -> DataFrame:
        return links.around(self.edges, self.resolve(note))

    def orphans(self) -> DataFrame:
        return links.orphans(self.notes, self.edges)

    def unresolved(self) -> DataFrame:
        return links.unresolved(self.edges)

    # Notes

    def note(self, note: str) -> DataFrame:
        return self.notes.where(F.col("note_id") == self.resolve(note))

    def list_notes(self, category: str | None = None, status: str | None = None, date_range: str | None = None, limit: int | None = None, now: datetime | None = None) -> DataFrame:
        span = None if date_range is None else notes.list_range(date_range, now or datetime.now(UTC))
        with_map = self.notes.withColumn("metadata", F.from_json("metadata_json", "map<string,string>"))
        return notes.list_notes(with_map, category, status, span, limit)

    def create_note(self, path: str, metadata: dict | None = None, body: str = "") -> dict[str, int]:
        vault.create_note(self.root, path, metadata or {}, body)
        return self.reindex([path])

    def replace_note(self, path: str, metadata: dict | None = None, body: str = "") -> dict[str, int]:
        vault.replace_note(self.root, path, metadata or {}, body)
        return self.reindex([path])

    def delete_note(self, path: str) -> dict[str, int]:
        vault.delete_note(self.root, path)
        return self.reindex([path])

    def stats(self) -> DataFrame:
        return notes.stats(self.notes)

    def recent(self, n: int = 10) -> DataFrame:
        return notes.recent(self.notes, n)

    def conventions(self) -> dict[str, DataFrame]:
        eav = vault.metadata_rows(self.notes)
        return {"naming": notes.naming_histogram(self.notes, F.col("note_id")), "metadata": notes.metadata_profile(eav), "kinds": notes.kinds(eav)}

    # Metric logs

    def metrics_search(self, query: str = "", limit: int | None = context.METRIC_LIMIT, now: datetime | None = None) -> DataFrame:
        return metrics.search(self.records, query, limit, now)

    def metrics_read(self, reference: str) -> DataFrame:
        return metrics.entries(metrics.by_id(self.records, reference), metrics.issues(self.parsed))

    def metrics_sum(self, query: str, limit: int = 31, now: datetime | None = None) -> DataFrame:
        return metrics.daily_sum(metrics.search(self.records, query, None, now), limit)

    def metrics_issues(self) -> DataFrame:
        return metrics.issues(self.parsed)

    def metrics_files(self) -> DataFrame:
        return metrics.file_summary(self.parsed)

    # Changes to logs. Every one holds the lock from its first read to the index's last write.

    def _changing(self):
        return mutations.exclusive(os.path.join(self.root, self.settings.internal, "metrics.lock"))

    def _lines(self) -> DataFrame:
        return files.read_ranges(files.log_ranges(self._logs(), self.root), self.root)

    def _store(self, before: DataFrame, after: DataFrame) -> None:
        """Write what differs; changed rows alone come to the driver."""
        gone = {(r.source_file, r.source_line) for r in before.exceptAll(after).collect()}
        self._edit(gone, [(r.source_file, r.source_line, r.raw_line) for r in after.exceptAll(before).collect()])

    def _edit(self, gone: set, new: list) -> None:
        for name in sorted({f for f, _ in gone} | {f for f, _, _ in new}):
            changed = {line: None for f, line in gone if f == name} | {line: text for f, line, text in new if f == name and (f, line) in gone}
            mutations.edit_file(os.path.join(self.root, name), changed, [text for f, line, text in sorted(new) if f == name and (f, line) not in gone])
        self._reindex_logs()

    def metrics_create(self, source_file: str, record: dict) -> None:
        with self._changing():
            before = self._lines()
            self._store(before, mutations.create(before, source_file, record))

    def metrics_update(self, record_id: str, patch: dict) -> None:
        with self._changing():
            before = self._lines()
            self._store(before, mutations.update(before, record_id, patch))

    def metrics_delete(self, record_id: str) -> None:
        with self._changing():
            before = self._lines()
            self._store(before, mutations.delete(before, record_id))

    def metrics_assign_ids(self) -> int:
        """Gives rows without an id one; returns how many."""
        with self._changing():
            # Those rows alone come to the driver, and are given their random ids once.
            rows = mutations.without_id(self._lines()).collect()
            self._edit({(r.source_file, r.source_line) for r in rows}, [(r.source_file, r.source_line, mutations.new_id_for(r.raw_line)) for r in rows])
            return len(rows)

    def metrics_create_file(self, name: str) -> None:
        with self._changing():
            vault.create_file(self.root, name)
            self._reindex_logs()

    def metrics_rename_file(self, old: str, new: str) -> None:
        with self._changing():
            vault.rename_file(self.root, old, new)
            self._reindex_logs()

    def metrics_delete_file(self, name: str) -> None:
        with self._changing():
            vault.delete_file(self.root, name)
            self._reindex_logs()

    # Context

    def context_day(self, day: date, **limits) -> dict[str, DataFrame]:
        return context.day_view(self.knowledge(), day, **limits)

    def context_week(self, day: date, **limits) -> dict[str, DataFrame]:
        return context.week_view(self.knowledge(), day, **limits)

    def context_month(self, day: date, **limits) -> dict[str, DataFrame]:
        return context.month_view(self.knowledge(), day, **limits)

    def context_changed(self, days: int, now: datetime | None = None, **limits) -> dict[str, DataFrame]:
        return context.changed_view(self.knowledge(), now or datetime.now(UTC), days, **limits)

    def context_note(self, note: str, **limits) -> dict[str, DataFrame]:
        return context.note_view(self.knowledge(), self.resolve(note), **limits)

    def context_metric(self, target: str, dates: str | None = None, now: datetime | None = None, **limits) -> dict[str, DataFrame]:
        """A record's key by ``metric:id``, or a key, within a range if one is given."""
        k = self.knowledge()
        key = target
        if target.startswith("metric:"):
            found = metrics.by_id(k.records, target).first()
            if found is None:
                raise QueryError(f"no record is called {target!r}")
            key = found.key
        rows = metrics.search(k.records, f'key:"{key}"' + (f" date:{dates}" if dates else ""), None, now)
        parts = k.days.where(F.lower("key") == key.lower()) if k.days is not None and not dates else None
        return context.metric_view(k, rows, name=target, span=dates, parts=parts, **limits)

    def context_source(self, source: str, **limits) -> dict[str, DataFrame]:
        return context.source_view(self.knowledge(), source, **limits)

    # By name

    def call(self, name: str, **params):
        if name.startswith("_") or not callable(getattr(type(self), name, None)):
            raise QueryError(f"no question is called {name!r}")
        return getattr(self, name)(**params)


payload = context.payload
