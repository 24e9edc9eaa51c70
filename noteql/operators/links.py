"""The link graph: resolution of raw targets, and one-hop questions over the edges."""

from __future__ import annotations

from noteql.functions import extract
from noteql.functions.dates import QueryError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalise_target(target: Column) -> Column:
    """A clean relative path without .md; null for absolute paths and those that climb out."""
    t = F.replace(F.trim(target), F.lit("\\"), F.lit("/"))
    t = F.regexp_replace(F.regexp_replace(t, r"(^|/)(\./)+", "$1"), r"/{2,}", "/")
    bad = t.isNull() | (t == "") | t.rlike(r"^/|^[A-Za-z]:/|(^|/)\.\.(/|$)")
    return F.when(~bad, F.nullif(F.regexp_replace(F.regexp_replace(t, r"(?i)\.md$", ""), r"^/+|/+$", ""), F.lit("")))


def lookup_key(text: Column) -> Column:
    return F.lower(F.replace(F.trim(text), F.lit("\\"), F.lit("/")))


def target_keys(notes: DataFrame) -> DataFrame:
    """(kind, target_key, note_id): what links can name the notes (note_id, title, aliases) by, folded: id, title, alias."""
    row = lambda kind, name: F.struct(F.lit(kind).alias("kind"), lookup_key(name).alias("target_key"))
    named = F.concat(F.array(row("id", F.col("note_id")), row("title", F.col("title"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: row("alias", x)))
    return notes.select(F.inline(named), "note_id").where("target_key is not null").distinct()


def sets_of(keys: DataFrame) -> dict[str, DataFrame]:
    """Look-up tables from target keys: by exact id, by folded id, by title, by alias, one row a key."""
    of = lambda kind: keys.where(F.col("kind") == kind)
    one = lambda kind: of(kind).groupBy(F.col("target_key").alias("k")).agg(F.min("note_id").alias(f"{kind}_id"), F.countDistinct("note_id").alias(f"{kind}_n"))
    return {"exact": of("id").select(F.col("note_id").alias("k"), F.col("note_id").alias("exact_id")).distinct()} | {kind: one(kind) for kind in ("id", "title", "alias")}


def target_sets(notes: DataFrame) -> dict[str, DataFrame]:
    return sets_of(target_keys(notes))


def link_key(target: Column) -> Column:
    """What links are kept by: every link that a note's id, title or alias may decide has the key that ``moved_keys`` gives
    for it."""
    return F.coalesce(lookup_key(normalise_target(target)), lookup_key(target), F.lit(""))


def looked_for(links: DataFrame, target: str = "target") -> DataFrame:
    """(target_key): all that links may be decided by."""
    return links.select(F.explode(F.array_compact(F.array(lookup_key(normalise_target(F.col(target))), lookup_key(F.col(target))))).alias("target_key")).distinct()


def moved_keys(keys: DataFrame) -> DataFrame:
    """(link_key) of the links that target keys may decide: an id is compared with a link's path, the others with its text."""
    return keys.select(F.when(F.col("kind") == "id", F.col("target_key")).otherwise(link_key(F.col("target_key"))).alias("link_key")).distinct()


def _looked_up(links: DataFrame, sets: dict[str, DataFrame], target: str) -> DataFrame:
    out = links.withColumn("__t", normalise_target(F.col(target))).withColumn("__k", lookup_key(F.col("__t"))).withColumn("__l", lookup_key(F.col(target)))
    for name, by in (("exact", "__t"), ("id", "__k"), ("title", "__l"), ("alias", "__l")):
        out = out.join(sets[name].withColumnRenamed("k", f"__{name}"), F.col(by) == F.col(f"__{name}"), "left").drop(f"__{name}")
    return out


def resolve(links: DataFrame, notes: DataFrame | None, target: str = "target", sets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``links`` with target_id and reason: an exact id, an id by folded case (least), a title (least), an alias that
    exactly one note claims, or unresolved. All are equality joins on tables of one row a key, made of
    the notes or given as ``sets``."""
    out = _looked_up(links, sets or target_sets(notes), target)
    alias = F.when(F.col("alias_n") == 1, F.col("alias_id"))
    out = out.withColumn("target_id", F.coalesce("exact_id", "id_id", "title_id", alias))
    reason = F.when(F.coalesce("exact_id", "id_id").isNotNull(), "direct").when(F.col("title_id").isNotNull(), "title").when(alias.isNotNull(), "alias").otherwise("unresolved")
    return out.withColumn("reason", reason).select(*links.columns, "target_id", "reason")


def extract_links(notes: DataFrame) -> DataFrame:
    """One row for each distinct wikilink of each note: source_id, raw, target, display, heading."""
    raws = notes.select(F.col("note_id").alias("source_id"), F.explode(extract.wikilinks(F.col("content"))).alias("raw"))
    return raws.withColumn("link", extract.parse_link(F.col("raw"))).select("source_id", "raw", "link.target", "link.display", "link.heading")


def edges_of(notes: DataFrame) -> DataFrame:
    return resolve(extract_links(notes), notes)


def refresh(edges: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges resolved anew, those of them that changed)."""
    again = resolve(edges.withColumnRenamed("target_id", "old_id").withColumnRenamed("reason", "old_reason"), notes)
    changed = again.where(~(F.col("target_id").eqNullSafe(F.col("old_id")) & F.col("reason").eqNullSafe(F.col("old_reason"))))
    return again.drop("old_id", "old_reason"), changed.drop("old_id", "old_reason")


def resolve_reference(text: str, notes: DataFrame) -> str:
    """The one note a user's reference names: exact id, folded id, title, alias; several of one kind are an error."""
    row = _looked_up(notes.sparkSession.createDataFrame([(text,)], "ref string"), target_sets(notes), "ref").first()
    if row.exact_id is not None:
        return row.exact_id
    for name in ("id", "title", "alias"):
        if (row[f"{name}_n"] or 0) > 1:
            raise QueryError(f"{text!r} is the {name} of several notes")
        if row[f"{name}_n"] == 1:
            return row[f"{name}_id"]
    raise QueryError(f"no note is called {text!r}")


def backlinks(edges: DataFrame, note_id) -> DataFrame:
    return edges.where(F.col("target_id") == note_id).orderBy("source_id", "raw")


def forward_links(edges: DataFrame, note_id) -> DataFrame:
    return edges.where(F.col("source_id") == note_id).orderBy(F.col("target_id").asc_nulls_first(), "raw")


def around(edges: DataFrame, note_id) -> DataFrame:
    """Back and forward links of a note in one table, by ``direction``."""
    both = backlinks(edges, note_id).withColumn("direction", F.lit("back"))
    return both.unionByName(forward_links(edges, note_id).withColumn("direction", F.lit("forward")))


def orphans(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Notes without resolved outgoing and without incoming links."""
    resolved = edges.where(F.col("target_id").isNotNull())
    out = notes.join(resolved.select(F.col("source_id").alias("note_id")), "note_id", "left_anti")
    return out.join(resolved.select(F.col("target_id").alias("note_id")), "note_id", "left_anti").select("note_id")


def unresolved(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("target_id").isNull())


def neighbours(edges: DataFrame, note_id) -> DataFrame:
    """Notes one link away by number of distinct reasons, then id; reasons joined by "; ". Every raw link that leads
    to a note is a reason, and so is that the note links back, however often it does."""
    out = edges.where((F.col("source_id") == note_id) & F.col("target_id").isNotNull()).select(F.col("target_id").alias("note_id"), F.concat(F.lit("Outbound link via [["), "raw", F.lit("]]")).alias("why"))
    back = edges.where(F.col("target_id") == note_id).select(F.col("source_id").alias("note_id"), F.concat(F.lit("Backlink from "), "source_id").alias("why"))
    both = out.unionByName(back).where(F.col("note_id") != note_id)
    ranked = both.groupBy("note_id").agg(F.countDistinct("why").alias("reasons_n"), F.array_join(F.array_sort(F.collect_set("why")), "; ").alias("reasons"))
    return ranked.orderBy(F.col("reasons_n").desc(), "note_id")


def context_links(edges: DataFrame) -> DataFrame:
    """Edges as context links: kind, from, to, reason; an unresolved link points at its raw text."""
    kind = F.when(F.col("target_id").isNull(), "unresolved_link").otherwise("note_link")
    return edges.select(kind.alias("kind"), F.col("source_id").alias("from"), F.coalesce("target_id", "raw").alias("to"), F.col("reason"))


def first_per(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
