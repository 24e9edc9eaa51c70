"""Lists of notes, and profiles of a collection."""

from __future__ import annotations

from datetime import datetime

from noteql.functions import extract
from noteql.functions.dates import DateRange, QueryError, range_of
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_notes(notes: DataFrame, category: str | None = None, status: str | None = None, span: DateRange | None = None, limit: int | None = None) -> DataFrame:
    """Notes by id whose metadata (map of strings) has the category and status, whatever the case, and whose day (the
    first ten characters of the id, else the metadata's date) meets the range."""
    if limit is not None and limit < 1:
        raise QueryError("a limit is at least 1")
    out = notes
    for name, value in (("category", category), ("status", status)):
        if value is not None:
            out = out.where(F.lower(F.trim(F.try_element_at("metadata", F.lit(name)))) == value.strip().lower())
    if span is not None:
        day = F.coalesce(F.try_to_date(F.left("note_id", F.lit(10))), F.try_to_date(F.try_element_at("metadata", F.lit("date"))))
        out = out.where(span.overlaps_day(day))
    out = out.orderBy("note_id")
    return out if limit is None else out.limit(limit)


def list_range(text: str, now: datetime) -> DateRange:
    """The simpler date grammar of lists: a literal or start..end."""
    if ".." in text:
        first, _, second = text.partition("..")
        return range_of("..", first.strip() or None, second.strip() or None, now)
    return range_of(None, text.strip(), None, now)


def stats(notes: DataFrame) -> DataFrame:
    """One row: total_notes, total_words, average_words (null without notes)."""
    out = notes.agg(F.count(F.lit(1)).alias("total_notes"), F.coalesce(F.sum(extract.word_count(F.col("raw"))), F.lit(0)).cast("long").alias("total_words"))
    return out.withColumn("average_words", F.when(F.col("total_notes") > 0, F.col("total_words") / F.col("total_notes")))


def recent(notes: DataFrame, n: int) -> DataFrame:
    return notes.orderBy(F.col("file_modified_at").desc_nulls_last(), "note_id").limit(n)


def naming_histogram(notes: DataFrame, note_id: Column, examples: int = 3) -> DataFrame:
    """(pattern, count, examples) of the last parts of ids: the first ids are kept by rank, so no class is gathered
    whole."""
    named = notes.select(extract.naming_class(extract.leaf(note_id)).alias("pattern"), note_id.alias("note_id"))
    counts = named.groupBy("pattern").agg(F.count(F.lit(1)).alias("count"))
    ranked = named.withColumn("r", F.row_number().over(Window.partitionBy("pattern").orderBy("note_id"))).where(F.col("r") <= examples)
    shown = ranked.groupBy("pattern").agg(F.array_sort(F.collect_list("note_id")).alias("examples"))
    return counts.join(shown, "pattern").orderBy(F.col("count").desc(), "pattern")


def metadata_profile(eav: DataFrame, top: int = 10) -> DataFrame:
    """(field, note_count, value, value_count, rank): the most frequent values of each field from (note_id, key,
    value_json), counted before they are ranked."""
    fields = eav.groupBy("key").agg(F.countDistinct("note_id").alias("note_count"))
    values = eav.where(~F.substr("value_json", F.lit(1), F.lit(1)).isin("{", "[")).groupBy("key", "value_json").agg(F.count(F.lit(1)).alias("value_count"))
    w = Window.partitionBy("key").orderBy(F.col("value_count").desc(), "value_json")
    ranked = values.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return fields.join(ranked, "key", "left").select(F.col("key").alias("field"), "note_count", F.col("value_json").alias("value"), "value_count", "rank")


def kinds(eav: DataFrame) -> DataFrame:
    """(field, kinds): the JSON kinds a field's values have."""
    kind = F.schema_of_variant(F.try_parse_json("value_json"))
    name = F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    return eav.groupBy(F.col("key").alias("field")).agg(F.array_sort(F.collect_set(name)).alias("kinds"))
