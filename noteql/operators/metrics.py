"""Metric logs: validation of NDJSON rows, search, roll-ups and co-occurrence."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from noteql.functions.dates import QueryError
from noteql.plans.metrics_query import MetricsQuery, parse
from noteql.scratch import stored
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The units of the metric keys that are known.
UNITS = {
    "body.weight": ["kg"],
    "body.fat_percentage": ["%"],
    "body.fat_mass": ["kg"],
    "body.fat_free_mass": ["kg"],
    "medication.semaglutide_dose": ["mg"],
    "nutrition.energy_intake": ["kcal"],
    "recovery.heart_rate_variability": ["ms"],
    "recovery.oxygen_saturation": ["%"],
    "recovery.respiratory_rate": ["br/min"],
    "recovery.resting_heart_rate": ["bpm"],
    "recovery.skin_temperature": ["Cel"],
    "sleep.duration": ["min"],
    "sleep.efficiency": ["%"],
    "whoop.day_strain": ["score"],
    "whoop.recovery_score": ["%"],
    "whoop.sleep_performance": ["%"],
}
FIELDS = ("id", "ts", "key", "value", "source", "date", "unit", "origin_id", "note", "context", "tags")
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
ISSUE = "struct<severity:string,code:string,field:string,message:string>"


def read_lines(files: DataFrame) -> DataFrame:
    """(source_file, source_line, raw_line) of the lines that are not blank, from (path, value) of whole files that are
    at hand as texts. ``sources.files`` reads logs of any size in ranges."""
    lines = files.select(F.col("path").alias("source_file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw_line"))
    return lines.where(~F.col("raw_line").rlike(r"^\s*$")).select("source_file", (F.col("pos") + 1).alias("source_line"), "raw_line")


def fingerprint(raw: Column) -> Column:
    """SHA-256 of a log's lines that are not blank: each one's number from 1 in 8 bytes, lowest first, its text and a
    line feed. Equal fingerprints mean equal rows."""
    number = lambda i: F.regexp_replace(F.lpad(F.hex((i + 1).cast("long")), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1")
    lines = F.transform(F.split(raw, "\r?\n"), lambda x, i: F.when(x.rlike(r"^\s*$"), "").otherwise(F.concat(number(i), F.hex(F.encode(x, "UTF-8")), F.lit("0A"))))
    return F.sha2(F.unhex(F.array_join(lines, "")), 256)


def _issue(severity: str, code: str, field: str | None, message) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), text.alias("message"))


def _bad(test: Column, code: str, field: str | None, message, severity: str = "error") -> Column:
    return F.when(test, _issue(severity, code, field, message))


def _kind(name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))


def _string(name: str) -> Column:
    return F.when(F.col(f"k_{name}") == "STRING", F.trim(F.try_variant_get("v", f"$.{name}", "string")))


def parse_lines(lines: DataFrame, units: dict[str, list[str]] = UNITS) -> DataFrame:
    """Every line with its fields, ``issues`` in field order, duplicates last, and ``status``.

    Types are those of the JSON: a number in quotes is no number. Null lines count as no JSON. Runs on DataFrame
    functions; set spark.sql.variant.allowDuplicateKeys so that of equal keys the last counts.
    """
    r = lines.withColumn("v", F.try_parse_json("raw_line")).withColumn("top", F.schema_of_variant("v"))
    obj = F.startswith("top", F.lit("OBJECT"))
    # Few steps, each of many columns: a plan is analysed anew for every step.
    r = r.withColumns({f"k_{name}": F.when(obj, _kind(name)) for name in FIELDS})
    none = lambda n: F.col(f"k_{n}").isNull() | (F.col(f"k_{n}") == "VOID")
    numeric = F.col("k_value").rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    tags = F.when(F.startswith("k_tags", F.lit("ARRAY")), F.try_variant_get("v", "$.tags", "array<variant>"))
    allowed = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    r = r.withColumns(
        {name: F.nullif(_string(name), F.lit("")) for name in ("id", "key", "source", "unit", "origin_id", "note", "ts", "date")}
        | {
            "value": F.when(numeric, F.try_variant_get("v", "$.value", "double")),
            "context_json": F.when(F.startswith("k_context", F.lit("OBJECT")), F.to_json(F.try_variant_get("v", "$.context", "variant"))),
            "tags_v": tags,
            "extra": F.when(obj, F.array_sort(F.array_except(F.json_object_keys("raw_line"), F.array(*map(F.lit, FIELDS))))),
        }
    )
    tags_ok = ~F.exists("tags_v", lambda x: F.coalesce(F.schema_of_variant(x), F.lit("")) != "STRING")
    texts = F.transform("tags_v", lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    r = r.withColumns({
        "ts_utc": F.when(F.col("ts").rlike(TIMESTAMP), F.try_to_timestamp(F.upper("ts"))),
        "date_text": F.col("date"),
        "date": F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date")),
        "tags": F.when(tags_ok, F.array_sort(F.array_distinct(F.filter(texts, lambda t: t != "")))),
        "units": F.try_element_at(allowed, F.col("key")),
    })
    checks = []
    for name, code in (("id", "invalid_id"), ("ts", "invalid_ts"), ("key", "invalid_key"), ("value", "invalid_value"), ("source", "invalid_source")):
        checks.append(_bad(obj & none(name), code, name, f"missing required field {name}"))
        wrong = "must be a number" if name == "value" else "must be a string that is not blank" if name != "ts" else "must be an RFC 3339 time"
        have = F.col("ts_utc") if name == "ts" else F.col(name)
        checks.append(_bad(obj & ~none(name) & have.isNull(), code, name, wrong))
    checks.append(_bad(~none("date") & F.col("date").isNull() & ~((F.col("k_date") == "STRING") & F.col("date_text").isNull()), "invalid_date", "date", "must be a day as YYYY-MM-DD"))
    for name in ("unit", "origin_id", "note"):
        checks.append(_bad(~none(name) & (F.col(f"k_{name}") != "STRING"), f"invalid_{name}", name, "must be a string"))
    checks.append(_bad(~none("context") & F.col("context_json").isNull(), "invalid_context", "context", "must be an object"))
    checks.append(_bad(~none("tags") & F.col("tags").isNull(), "invalid_tags", "tags", "must be an array of strings"))
    known, unit = F.col("units").isNotNull(), F.col("unit")
    checks.append(_bad(F.col("key").isNotNull() & ~known, "unknown_metric_key", "key", "unknown metric key", "warning"))
    checks.append(_bad(known & unit.isNotNull() & ~F.array_contains("units", unit), "unit_mismatch", "unit", "unit does not fit the key", "warning"))
    checks.append(_bad(F.col("key").isNotNull() & ~known & unit.isNotNull(), "unknown_unit", "unit", "unit of an unknown key", "warning"))
    unknown = F.transform(F.coalesce("extra", F.array().cast("array<string>")), lambda k: F.struct(F.lit("warning").alias("severity"), F.lit("unknown_field").alias("code"), k.alias("field"), F.lit("unknown field").alias("message")))
    whole = [_bad(F.col("v").isNull(), "invalid_json", None, "not JSON"), _bad(F.col("v").isNotNull() & ~obj, "invalid_row_type", None, "not an object")]
    r = r.withColumn("issues", F.concat(F.array_compact(F.array(*whole, *checks)), unknown))
    twice = repeated(lines)
    for name, severity in (("id", "error"), ("origin_id", "warning")):
        known = twice.where(F.col("name") == name).select("source_file", F.col("text").alias(name), F.lit(True).alias("__twice"))
        r = r.join(known, ["source_file", name], "left")
        more = F.when(F.col("__twice"), F.array(_issue(severity, f"duplicate_{name}", name, f"{name} is there more than once in the file"))).otherwise(F.array().cast(f"array<{ISSUE}>"))
        r = r.withColumn("issues", F.concat("issues", more)).drop("__twice")
    r = r.withColumn("status", F.when(F.exists("issues", lambda x: x["severity"] == "error"), "invalid").when(F.size("issues") > 0, "warning").otherwise("valid"))
    extra = F.when(F.size("extra") > 0, F.to_json(F.map_filter(F.from_json("raw_line", "map<string,string>"), lambda k, _: F.array_contains("extra", k))))
    r = r.withColumn("tags_json", F.when(F.size("tags") > 0, F.to_json("tags"))).withColumn("extra_fields_json", extra)
    keep = ["source_file", "source_line", "raw_line", "id", "ts", "ts_utc", "key", "value", "source", "date", "unit", "origin_id", "note", "context_json", "tags", "tags_json", "extra_fields_json", "issues", "status"]
    return r.select(*keep)


def repeated(lines: DataFrame) -> DataFrame:
    """(source_file, name, text) of the ids and origin ids that several lines of a file have. Two fields are read for it,
    and counts are aggregated before they are shuffled. The table is stored, so its size decides how lines are joined to
    it: as a rule it is small and sent to them, and no line is shuffled."""
    v = lines.select("source_file", F.try_parse_json("raw_line").alias("v"))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    text = lambda name: F.when(F.schema_of_variant(field(name)) == "STRING", F.nullif(F.trim(F.try_variant_get(field(name), "$", "string")), F.lit("")))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), text(n).alias("text")) for n in ("id", "origin_id")])
    each = v.select("source_file", F.inline(pairs)).where("text is not null")
    return stored(each.groupBy("source_file", "name", "text").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))


def records(parsed: DataFrame) -> DataFrame:
    """Rows that become records: complete and without an error."""
    return parsed.where((F.col("status") != "invalid") & F.col("value").isNotNull()).drop("issues")


def issues(parsed: DataFrame) -> DataFrame:
    """One row for each issue, numbered from 0 in its line."""
    return parsed.select("source_file", "source_line", F.posexplode("issues").alias("issue_ordinal", "i")).select("source_file", "source_line", "issue_ordinal", "i.*")


def file_summary(parsed: DataFrame) -> DataFrame:
    of = lambda s: F.sum(F.size(F.filter("issues", lambda x: x["severity"] == s)))
    return parsed.groupBy("source_file").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("status") != "invalid").alias("record_count"), of("warning").alias("warning_count"), of("error").alias("error_count"))


def bucket() -> Column:
    """The day a record counts for: its date, else the local day of its timestamp."""
    return F.coalesce(F.col("date"), F.try_to_date(F.substr("ts", F.lit(1), F.lit(10))))


def clustered(rows: DataFrame) -> DataFrame:
    """Rows with what an index orders them by."""
    return rows.withColumn("key_lower", F.lower("key")).withColumn("day", bucket())


def search(recs: DataFrame, query: str | MetricsQuery, limit: int | None = None, now: datetime | None = None) -> DataFrame:
    """Records that a question asks for, newest first up to a limit. Of kept rows few are read for it."""
    q = parse(query, now) if isinstance(query, str) else query
    found = recs.where(q.pruning()) if {"key_lower", "day"} <= set(recs.columns) else recs
    found = found.where(q.predicate())
    if limit is None:
        return found
    at = F.coalesce(F.unix_micros(F.col("date").cast("timestamp")), F.unix_micros("ts_utc"))
    return found.orderBy(at.desc(), "source_file", "source_line").limit(limit)


def by_id(recs: DataFrame, reference: str) -> DataFrame:
    return recs.where(F.col("id") == reference.removeprefix("metric:"))


def entries(recs: DataFrame, issue_rows: DataFrame) -> DataFrame:
    """Records with their issues as an array in order."""
    i = issue_rows.groupBy("source_file", "source_line").agg(F.array_sort(F.collect_list(F.struct("issue_ordinal", "severity", "code", "field", "message"))).alias("issues"))
    return recs.join(i, ["source_file", "source_line"], "left")


def daily_sum(recs: DataFrame, limit: int) -> DataFrame:
    """(bucket, total, record_count), newest first; no records, several keys or several units are an error."""
    kinds = recs.agg(F.countDistinct("key").alias("k"), F.countDistinct(F.coalesce("unit", F.lit("\0"))).alias("u")).first()
    if kinds.k != 1 or kinds.u != 1:
        raise QueryError("a sum needs records, of one key and one unit")
    return recs.groupBy(bucket().alias("bucket")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("record_count")).orderBy(F.col("bucket").desc()).limit(limit)


def rollups(recs: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """Daily buckets of each group of ``by``: day, total, count, with active_days, record_total and newest of the group.
    Groups of more than one unit (none counts as one) are left out; totals are taken before buckets are cut."""
    day = recs.withColumn("bucket", bucket()).groupBy(*by, "bucket").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.min(F.coalesce("unit", F.lit("\0"))).alias("u0"), F.max(F.coalesce("unit", F.lit("\0"))).alias("u1"))
    return _of_one_unit(day, by, buckets)


def _of_one_unit(day: DataFrame, by: list[str], buckets: int | None) -> DataFrame:
    # One row a day and group from here on.
    w = Window.partitionBy(*by)
    out = day.withColumn("active_days", F.count("bucket").over(w)).withColumn("record_total", F.sum("n").over(w)).withColumn("newest", F.max("bucket").over(w))
    out = out.withColumn("__a", F.min("u0").over(w)).withColumn("__b", F.max("u1").over(w)).where("__a = __b")
    if buckets is not None:
        out = out.withColumn("__r", F.row_number().over(w.orderBy(F.col("bucket").desc()))).where(F.col("__r") <= buckets).drop("__r")
    return out.withColumn("unit", F.nullif("__a", F.lit("\0"))).drop("u0", "u1", "__a", "__b")


def daily_parts(recs: DataFrame) -> DataFrame:
    """(source_file, key, source, unit, day, total, n): what each log adds to a day's sums. Parts of several logs are
    added, those of a changed log replaced, so roll-ups of kept parts never read records."""
    by = ["source_file", "key", "source", "unit"]
    return recs.groupBy(*by, bucket().alias("day")).agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def rollups_of_parts(parts: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """``rollups`` of the records that the parts are of."""
    unit = F.coalesce("unit", F.lit("\0"))
    day = parts.groupBy(*by, F.col("day").alias("bucket")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min(unit).alias("u0"), F.max(unit).alias("u1"))
    return _of_one_unit(day, by, buckets)


def rollup_order() -> list[Column]:
    return [F.col("active_days").desc(), F.col("record_total").desc(), F.col("newest").desc(), F.col("key"), F.col("source")]


def window_rollups(recs: DataFrame, groups: int, buckets: int, parts: bool = False) -> DataFrame:
    """Roll-ups by key and source of the most active groups; of records, or of daily parts."""
    made = (rollups_of_parts if parts else rollups)(recs, ["key", "source"], buckets)
    top = made.select("key", "source", "active_days", "record_total", "newest").distinct().orderBy(*rollup_order()).limit(groups)
    return made.join(F.broadcast(top.select("key", "source")), ["key", "source"], "left_semi")


def target_rollups(recs: DataFrame, buckets: int, parts: bool = False) -> DataFrame:
    """One roll-up if there is at most one source, else one a source; of records, or of daily parts."""
    several = recs.agg(F.countDistinct("source").alias("n")).first().n > 1
    return (rollups_of_parts if parts else rollups)(recs, ["key", "source"] if several else ["key"], buckets)


def prefix_length(a: Column, b: Column) -> Column:
    """Number of leading dot-separated segments that two keys share."""
    pairs = F.zip_with(F.split(a, r"\."), F.split(b, r"\."), lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    return F.aggregate(pairs, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")), lambda s: s["n"])


def co_recorded(recs: DataFrame, target: DataFrame, limit: int | None = None) -> DataFrame:
    """Other keys on the days of ``target`` records, those of the nearest namespace first: overlap_days counts records,
    as the field has always done."""
    t = target.withColumn("day", bucket())
    days = t.groupBy("day").agg(F.collect_set("source").alias("sources"))
    key = t.agg(F.min("key").alias("target_key"))
    c = recs.withColumn("day", bucket()).join(days, "day").join(F.broadcast(key)).where(F.col("key") != F.col("target_key"))
    out = c.groupBy("key").agg(
        F.count(F.lit(1)).alias("overlap_days"),
        F.count_if(F.array_contains("sources", F.col("source"))).alias("same_source_overlap_days"),
        F.first(prefix_length(F.col("key"), F.col("target_key"))).alias("shared_prefix"),
        F.max(F.struct("ts_utc", "id", "source")).alias("latest"),
    )
    out = out.select("key", "overlap_days", "same_source_overlap_days", "shared_prefix", F.col("latest.ts_utc").alias("latest_ts"), F.col("latest.id").alias("latest_id"), F.col("latest.source").alias("latest_source"))
    order = [F.col("shared_prefix").desc(), F.col("same_source_overlap_days").desc(), F.col("overlap_days").desc(), F.col("latest_ts").desc(), F.col("key"), F.col("latest_source")]
    return out if limit is None else out.orderBy(*order).limit(limit)


def distinct_values(recs: DataFrame, name: str) -> DataFrame:
    return recs.select(name).distinct().orderBy(name)


def activity_window(recs: DataFrame) -> DataFrame:
    return recs.agg(F.min(bucket()).alias("first_day"), F.max(bucket()).alias("last_day"))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
