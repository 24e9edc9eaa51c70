"""Context views, roll-ups, mutations and extraction applied to the synthetic tables, with the same in SQL.

``documents`` are made a diary: some notes are named by days, and some mention records, metric keys and sources after
their text. Their file times are spread over 400 days, so that some are near the events' month and some are not.
"""

from __future__ import annotations

from datetime import date

from noteql.functions import extract, text
from noteql.functions.dates import Bound, DateRange, midnight
from noteql.operators import context, fts, links, metrics, mutations, notes, vectors
from noteql.plans import query as note_query
from noteql.queries import EDGES, IDX, NOW, PARSED, RECS, _bm25, event_lines, event_records, indexed, note_table, page_edges, page_notes, register, table, vector_table
from noteql.sources import vault
from noteql.streaming import incremental
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is put after a note's text, by its number.
MENTIONS = [
    ("doc_id % 50 = 3", "' and metric:e' || doc_id || '.'"),
    ("doc_id % 31 = 5", "' all of Web.Click'"),
    ("doc_id % 17 = 2", "' one web, click more'"),
    ("doc_id % 23 = 4", "' seen by u3'"),
    ("doc_id = 4", "' metric:e7 web.click on 2024-01-09 and 2024-02-30'"),
    ("doc_id = 40", "' web.view web.error for u2, metric:e11'"),
    ("doc_id = 41", "' on 2024-01-12.'"),
]
DIARY_COLUMNS = f"""CASE WHEN doc_id < 30 THEN strftime(DATE '2024-01-01' + CAST(doc_id AS INT), '%Y-%m-%d') ELSE CAST(doc_id AS VARCHAR) END AS note_id,
 text || {" || ".join(f"CASE WHEN {when} THEN {says} ELSE '' END" for when, says in MENTIONS)} AS content, DATE '2024-01-01' + CAST(doc_id * 7 % 400 AS INT) AS day, doc_id"""
DIARY = f"diary AS (SELECT *, ' ' || trim(regexp_replace(lower(note_id || ' ' || content), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS words FROM (SELECT {DIARY_COLUMNS} FROM documents))"


def diary(spark, d) -> DataFrame:
    i = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1704067200) + i * 7 % 400 * 86400)
    says = [F.when(F.expr(when), F.expr(what.replace("doc_id", "CAST(doc_id AS STRING)"))).otherwise("") for when, what in MENTIONS]
    named = F.when(i < 30, F.date_format(F.date_add(F.lit(date(2024, 1, 1)), i.cast("int")), "yyyy-MM-dd")).otherwise(i.cast("string"))
    return table(spark, d, "documents").select(
        named.alias("note_id"), F.lit(None).cast("string").alias("title"), F.concat("text", *says).alias("content"), F.concat(F.col("source"), F.lit("/"), i.cast("string"), F.lit(".md")).alias("relative_path"),
        at.alias("file_modified_at"), F.when(i % 10 != 0, at).alias("created_at"), F.array().cast("array<string>").alias("aliases"), i.alias("doc_id"),
    )


def knowledge(spark, d) -> context.Knowledge:
    return context.Knowledge(diary(spark, d), event_records(spark, d), page_edges(spark, d))


#: Evidence (note_id, kind, tier, reason, day), pruned to at most %d rows; ``span`` has the target's first and last day.
PRUNED = """, strong AS (SELECT count(*) AS n FROM ev WHERE kind < 2), best AS (SELECT * FROM ev, span, strong WHERE kind < 2 OR n = 0 OR day BETWEEN a - 45 AND b + 45 OR TRY_CAST(note_id AS DATE) BETWEEN a - 45 AND b + 45
 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY kind, tier, reason) = 1), m AS (SELECT least(count(*), {limit}) AS s FROM best WHERE kind < 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY kind < 2 ORDER BY kind, day DESC, note_id) AS k FROM best)
 SELECT note_id, kind, reason, confidence FROM r, m WHERE k <= CASE WHEN kind < 2 THEN {limit} ELSE least(CASE WHEN s >= 2 THEN 1 ELSE 2 END, {limit} - s) END"""


@register("context_metric_notes", f"""WITH {RECS}, {DIARY}, target AS (SELECT * FROM recs WHERE key = 'web.click' AND source = 'u1'), span AS (SELECT min(bucket) AS a, max(bucket) AS b FROM target),
 ev AS (SELECT note_id, 0 AS kind, 0 AS tier, 'Note explicitly references matching metric record `metric:e' || doc_id || '`' AS reason, NULL::DOUBLE AS confidence, day FROM diary WHERE doc_id % 50 = 3 AND 'e' || doc_id IN (SELECT id FROM target)
 UNION ALL SELECT note_id, 0, 0, 'Note explicitly references matching metric record `metric:' || id || '`', NULL, day FROM diary JOIN target ON (doc_id = 4 AND id = 'e7') OR (doc_id = 40 AND id = 'e11')
 UNION ALL SELECT note_id, 0, 1, 'Note explicitly mentions metric key `web.click`', NULL, day FROM diary WHERE doc_id % 31 = 5 OR doc_id = 4
 UNION ALL SELECT note_id, 1, 2, 'Same day as metric activity', NULL, day FROM diary WHERE doc_id < 30 AND TRY_CAST(note_id AS DATE) IN (SELECT bucket FROM target WHERE dated)
 UNION ALL SELECT note_id, 2, 3, 'Note text matches metric key', 0.35, day FROM diary WHERE contains(words, ' web click ')){PRUNED.format(limit=200)}""")  # fmt: skip
def context_metric_notes(spark, d):
    k = knowledge(spark, d)
    return context.notes_for_metric(k, k.records.where("key = 'web.click' AND source = 'u1'"), 200).select("note_id", "kind", "reason", "confidence")


@register("context_metric_notes_inferred", f"""WITH {RECS}, {DIARY}, target AS (SELECT * FROM recs WHERE key = 'web.click' AND source = 'u1'), span AS (SELECT min(bucket) AS a, max(bucket) AS b FROM target),
 ev AS (SELECT note_id, 2 AS kind, 3 AS tier, 'Note text matches metric key' AS reason, 0.35::DOUBLE AS confidence, day FROM diary WHERE contains(words, ' one web ')){PRUNED.format(limit=5)}""")  # fmt: skip
def context_metric_notes_inferred(spark, d):
    """Without stronger evidence inferred notes of any day may stay, two at most."""
    k = knowledge(spark, d)
    target = k.records.where("key = 'web.click' AND source = 'u1'").withColumns({"id": F.concat(F.lit("x"), "id"), "key": F.lit("one.web"), "date": F.lit(None).cast("date")})
    return context.notes_for_metric(k, target, 5).select("note_id", "kind", "reason", "confidence")


@register("context_source_notes", f"""WITH {RECS}, {DIARY}, target AS (SELECT * FROM recs WHERE source = 'u3'), span AS (SELECT min(bucket) AS a, max(bucket) AS b FROM target),
 ev AS (SELECT note_id, 0 AS kind, 0 AS tier, 'Note explicitly mentions source `u3`' AS reason, NULL::DOUBLE AS confidence, day FROM diary WHERE contains(words, ' u3 ')
 UNION ALL SELECT note_id, 1, 1, 'Same day as source metric activity', NULL, day FROM diary WHERE doc_id < 30 AND TRY_CAST(note_id AS DATE) IN (SELECT bucket FROM target WHERE dated)
 UNION ALL SELECT note_id, 2, 2, 'Note text mentions metric key `' || key || '` emitted by source `u3`', 0.3, day FROM diary JOIN (SELECT DISTINCT key FROM target) ON ((doc_id % 31 = 5 OR doc_id = 4) AND key = 'web.click') OR (doc_id = 40 AND key IN ('web.view', 'web.error'))){PRUNED.format(limit=400)}""")  # fmt: skip
def context_source_notes(spark, d):
    k = knowledge(spark, d)
    return context.notes_for_source(k, "u3", k.records.where("source = 'u3'"), 400).select("note_id", "kind", "reason", "confidence")


#: Structural evidence of a day, or a day and key: at most 16 records each, in the order of the log.
_LISTED = "row_number() OVER (PARTITION BY {by} ORDER BY t_at DESC, source_file, event_id) <= 16"


@register("context_note_metrics_keyed", f"""WITH {RECS}, few AS (SELECT * FROM recs WHERE key = 'web.click' AND bucket IN (DATE '2024-01-05', DATE '2024-01-09') QUALIFY {_LISTED.format(by="bucket")}),
 kept AS (SELECT *, count_if(source = 'u3') OVER (PARTITION BY bucket) AS named FROM few),
 ev AS (SELECT id, key, ts, 0 AS kind, 'Note contains explicit metric reference' AS reason FROM recs WHERE id = 'e7'
 UNION ALL SELECT id, key, ts, 1, 'Note references day ' || bucket || CASE WHEN named > 0 THEN ', metric key `web.click`, and source `u3`' ELSE ' and metric key `web.click`' END FROM kept WHERE named = 0 OR source = 'u3')
 SELECT id, kind, reason FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind) AS k FROM ev) WHERE k = 1 ORDER BY kind, ts DESC, key, id LIMIT 8""")  # fmt: skip
def context_note_metrics_keyed(spark, d):
    """A note of a day that mentions a key and a source: other keys of its days do not count, nor do other sources of a
    day that has the source's records."""
    k = knowledge(spark, d)
    return context.metrics_for_note(k, k.notes.where("doc_id = 4"), 8).select("id", "kind", "reason")


@register("context_note_metrics_latest", f"""WITH {RECS}, ev AS (SELECT id, key, ts, 0 AS kind, 'Note contains explicit metric reference' AS reason FROM recs WHERE id = 'e11'),
 few AS (SELECT * FROM recs WHERE key IN ('web.view', 'web.error') AND key NOT IN (SELECT key FROM ev) QUALIFY {_LISTED.format(by="key")}),
 kept AS (SELECT *, count_if(source = 'u2') OVER (PARTITION BY key) AS n FROM few), latest AS (SELECT * FROM kept WHERE n = 0 OR source = 'u2' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, source_file, event_id) = 1)
 SELECT id, kind, reason FROM ev UNION ALL SELECT id, 2, 'Note explicitly mentions ' || CASE WHEN n > 0 THEN 'source `u2` and ' ELSE '' END || 'metric key `' || key || '`; latest matching record' FROM latest""")  # fmt: skip
def context_note_metrics_latest(spark, d):
    """A note without a day: the latest record of each mentioned key that no reference names, of the source it names."""
    k = knowledge(spark, d)
    return context.metrics_for_note(k, k.notes.where("doc_id = 40"), 8).select("id", "kind", "reason")


@register("context_note_metrics_day", f"WITH {RECS} SELECT id, 1 AS kind, 'Note references day 2024-01-12 with recorded metrics' AS reason FROM (SELECT * FROM recs WHERE bucket = DATE '2024-01-12' QUALIFY {_LISTED.format(by='bucket')}) ORDER BY ts DESC, key, id LIMIT 8")
def context_note_metrics_day(spark, d):
    k = knowledge(spark, d)
    note = k.notes.where("doc_id = 41").withColumn("content", F.regexp_extract("content", r"( on 2024-01-12\.)$", 1))
    return context.metrics_for_note(k, note, 8).select("id", "kind", "reason")


@register("context_note_days", f"""WITH {RECS}, days AS (SELECT unnest([DATE '2024-01-03', DATE '2024-01-20', DATE '2024-06-01', DATE '2024-01-09', DATE '2023-01-01']) AS day),
 ev AS (SELECT bucket AS day, CASE WHEN key = 'web.click' THEN 0 ELSE 1 END AS kind, ts FROM recs WHERE bucket IN (SELECT day FROM days) AND (key <> 'web.click' OR bucket <> DATE '2024-01-20')),
 best AS (SELECT day, min(kind) AS kind, arg_min(ts, (kind, -epoch_us(ts))) AS ts FROM ev GROUP BY day)
 SELECT CAST(row_number() OVER (ORDER BY kind NULLS LAST, ts DESC NULLS LAST, days.day DESC) AS INT) AS place, CAST(days.day AS VARCHAR) AS day FROM days LEFT JOIN best ON days.day = best.day""")  # fmt: skip
def context_note_days(spark, d):
    named = spark.createDataFrame([(date.fromisoformat(x),) for x in ("2024-01-03", "2024-01-20", "2024-06-01", "2024-01-09", "2023-01-01")], "day date")
    r = event_records(spark, d).where((F.col("key") != "web.click") | (metrics.bucket() != F.lit(date(2024, 1, 20))))
    e = r.withColumn("kind", F.when(F.col("key") == "web.click", 0).otherwise(1)).withColumn("confidence", F.lit(None).cast("double"))
    ranked = context.day_ranking(named, e).select(F.col("day").cast("string").alias("day"))
    return ranked.withColumn("place", F.monotonically_increasing_id().cast("int") + 1).select("place", "day")


_MIXED = "CASE WHEN event_id % 3 = 0 THEN 'app.ui.' || event_type WHEN event_id % 3 = 1 THEN 'web.' || event_type ELSE 'web.deep.' || event_type END"


def mixed_records(spark, d) -> DataFrame:
    kind = F.regexp_extract("key", r"\.(\w+)$", 1)
    return event_records(spark, d).withColumn("key", F.concat(F.when(F.col("source_line") % 3 == 0, "app.ui.").when(F.col("source_line") % 3 == 1, "web.").otherwise("web.deep."), kind))


@register("co_recorded_ranked", f"""WITH r AS (SELECT 'e' || event_id AS id, ts, {_MIXED} AS key, 'u' || user_id % 7 AS source, CAST(ts AS DATE) AS bucket FROM events), t AS (SELECT bucket, list(DISTINCT source) AS s FROM r WHERE key = 'web.deep.click' GROUP BY bucket)
 SELECT key, count(*) AS overlap_days, CAST(count_if(list_contains(s, source)) AS BIGINT) AS same_source_overlap_days, CASE WHEN key LIKE 'web.deep.%' THEN 2 WHEN key LIKE 'web.%' THEN 1 ELSE 0 END AS shared_prefix
 FROM r JOIN t USING (bucket) WHERE key <> 'web.deep.click' GROUP BY key ORDER BY shared_prefix DESC, same_source_overlap_days DESC, overlap_days DESC, max(ts) DESC, key LIMIT 6""")  # fmt: skip
def co_recorded_ranked(spark, d):
    r = mixed_records(spark, d)
    return metrics.co_recorded(r, r.where("key = 'web.deep.click'"), 6).select("key", "overlap_days", "same_source_overlap_days", "shared_prefix")


_UNITS = "(key, source) IN (SELECT (key, source) FROM recs GROUP BY key, source HAVING count(DISTINCT unit) = 1)"


@register("window_rollups", f"""WITH {RECS}, d AS (SELECT key, source, bucket, sum(value) AS total, count(*) AS n FROM recs WHERE {_UNITS} AND t_at >= TIMESTAMP '2024-01-08' AND t_at <= TIMESTAMP '2024-01-14' GROUP BY ALL),
 g AS (SELECT key, source FROM d GROUP BY ALL ORDER BY count(*) DESC, sum(n) DESC, max(bucket) DESC, key, source LIMIT 4), r AS (SELECT *, row_number() OVER (PARTITION BY key, source ORDER BY bucket DESC) AS k FROM d WHERE (key, source) IN (SELECT (key, source) FROM g))
 SELECT key, source, CAST(bucket AS VARCHAR) AS bucket, round(total, 4) AS total, n FROM r WHERE k <= 5""".replace(_UNITS, "(key, source) IN (SELECT (key, source) FROM recs WHERE t_at >= TIMESTAMP '2024-01-08' AND t_at <= TIMESTAMP '2024-01-14' GROUP BY key, source HAVING count(DISTINCT unit) = 1)"))  # fmt: skip
def window_rollups(spark, d):
    k = knowledge(spark, d)
    return context.week_view(k, date(2024, 1, 10))["rollups"].select("key", "source", F.col("bucket").cast("string"), F.round("total", 4).alias("total"), "n")


@register("target_rollups", f"WITH {RECS}, d AS (SELECT key, source, bucket, sum(value) AS total, count(*) AS n FROM recs WHERE key = 'web.view' GROUP BY ALL) SELECT key, source, CAST(bucket AS VARCHAR) AS bucket, round(total, 4) AS total, n FROM d QUALIFY row_number() OVER (PARTITION BY source ORDER BY bucket DESC) <= 5")
def target_rollups(spark, d):
    k = knowledge(spark, d)
    return context.metric_view(k, k.records.where("key = 'web.view'"), name="web.view")["rollups"].select("key", "source", F.col("bucket").cast("string"), F.round("total", 4).alias("total"), "n")


@register("target_rollup_one_source", f"WITH {RECS} SELECT key, CAST(bucket AS VARCHAR) AS bucket, round(sum(value), 4) AS total, count(*) AS n FROM recs WHERE key = 'web.view' AND source = 'u2' GROUP BY key, recs.bucket ORDER BY recs.bucket DESC LIMIT 3")
def target_rollup_one_source(spark, d):
    r = event_records(spark, d).where("key = 'web.view' AND source = 'u2'")
    return metrics.target_rollups(r, 3).select("key", F.col("bucket").cast("string"), F.round("total", 4).alias("total"), "n")


@register("metrics_read_by_id", f"WITH {RECS} SELECT id, key, source, round(value, 6) AS value FROM recs WHERE id = 'e42'")
def metrics_read_by_id(spark, d):
    return metrics.by_id(event_records(spark, d), "metric:e42").select("id", "key", "source", F.round("value", 6).alias("value"))


@register("metrics_entries", f"WITH {PARSED} SELECT st.source_file, CAST(st.event_id AS INT) AS source_line, coalesce(array_to_string(list_sort(list(code) FILTER (code IS NOT NULL)), ','), '') AS codes FROM st LEFT JOIN iss ON st.event_id = iss.event_id WHERE status <> 'invalid' GROUP BY st.source_file, st.event_id")
def metrics_entries(spark, d):
    parsed = metrics.parse_lines(event_lines(spark, d))
    found = metrics.entries(metrics.records(parsed), metrics.issues(parsed))
    codes = F.array_join(F.array_sort(F.transform(F.coalesce("issues", F.array().cast("array<struct<issue_ordinal:int,severity:string,code:string,field:string,message:string>>")), lambda x: x["code"])), ",")
    return found.select("source_file", "source_line", codes.alias("codes"))


@register("metrics_distinct", f"WITH {RECS} SELECT DISTINCT key FROM recs")
def metrics_distinct(spark, d):
    return metrics.distinct_values(event_records(spark, d), "key")


@register("metrics_note_attention", f"WITH {PARSED}, {EDGES} SELECT 'metric_issue' AS kind, count(*) AS n FROM iss UNION ALL SELECT 'unresolved_link', count(*) FROM edges WHERE target_id IS NULL")
def metrics_note_attention(spark, d):
    found = context.attention(metrics.issues(metrics.parse_lines(event_lines(spark, d))), page_edges(spark, d))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# Views


@register("context_day_updated", f"WITH {DIARY} SELECT note_id FROM diary WHERE day = DATE '2024-03-11' AND doc_id % 10 = 0 ORDER BY note_id LIMIT 5")
def context_day_updated(spark, d):
    """Notes of the day's time that were not created on it."""
    return context.day_view(knowledge(spark, d), date(2024, 3, 11))["updated"].select("note_id")


@register("context_day_links", f"""WITH {RECS}, {DIARY}, made AS (SELECT 'day:2024-01-08' AS "from", 'note:' || note_id AS "to", 'Daily note for requested day' AS reason FROM diary WHERE note_id = '2024-01-08'
 UNION ALL SELECT 'day:2024-01-08', 'metric:' || id, 'Metric recorded on 2024-01-08' FROM (SELECT * FROM recs WHERE bucket = DATE '2024-01-08' ORDER BY ts DESC, source_file, event_id LIMIT 10)) SELECT * FROM made""")  # fmt: skip
def context_day_links(spark, d):
    return context.day_view(knowledge(spark, d), date(2024, 1, 8))["links"].select("from", "to", "reason")


@register("context_month_created", f"WITH {DIARY} SELECT note_id FROM diary WHERE day >= DATE '2024-03-01' AND day < DATE '2024-04-01' AND doc_id % 10 <> 0 ORDER BY day DESC, note_id LIMIT 12")
def context_month_created(spark, d):
    return context.month_view(knowledge(spark, d), date(2024, 3, 9), 12)["created"].select("note_id")


@register("context_changed_updated", f"WITH {DIARY} SELECT note_id FROM diary WHERE day >= TIMESTAMP '2024-01-06 12:00:00' AND day <= TIMESTAMP '2024-01-20 12:00:00' AND doc_id % 10 = 0 ORDER BY day DESC, note_id LIMIT 9")
def context_changed_updated(spark, d):
    return context.changed_view(knowledge(spark, d), NOW, 14, 9)["updated"].select("note_id")


@register("context_source_latest", f"WITH {RECS} SELECT key, id FROM recs WHERE source = 'u5' QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, source_file, event_id) = 1")
def context_source_latest(spark, d):
    return context.source_view(knowledge(spark, d), "u5")["metrics"].select("key", "id")


@register("context_record_days", f"WITH {RECS} SELECT CAST(bucket AS VARCHAR) AS day FROM (SELECT * FROM recs WHERE source = 'u5' ORDER BY ts DESC, source_file, event_id LIMIT 40) GROUP BY bucket")
def context_record_days(spark, d):
    return context.source_view(knowledge(spark, d), "u5", metric_limit=40)["days"].select(F.col("day").cast("string"))


@register("context_note_related", f"""WITH {EDGES}, near AS (SELECT target_id AS note_id FROM edges WHERE source_id = 'Page 7' AND target_id IS NOT NULL UNION SELECT source_id FROM edges WHERE target_id = 'Page 7')
 SELECT note_id, 1 AS kind, 'Graph link' AS reason FROM near WHERE note_id <> 'Page 7' ORDER BY note_id LIMIT 4""")  # fmt: skip
def context_note_related(spark, d):
    n = page_notes(spark, d).select("note_id", "title", F.lit("").alias("content"), F.lit("x.md").alias("relative_path"), F.lit(None).cast("timestamp").alias("file_modified_at"), F.lit(None).cast("timestamp").alias("created_at"), "aliases")
    k = context.Knowledge(n, event_records(spark, d), page_edges(spark, d))
    return context.note_view(k, "Page 7", 4)["related"].select("note_id", "kind", "reason").where("kind = 1")


@register("daily_notes", f"WITH {RECS}, {DIARY} SELECT note_id FROM diary WHERE TRY_CAST(note_id AS DATE) IN (SELECT bucket FROM recs WHERE dated AND key = 'web.error' AND source = 'u6')")
def daily_notes(spark, d):
    days = event_records(spark, d).where("key = 'web.error' AND source = 'u6'").select(F.col("date").alias("day")).where("day is not null")
    return context.daily_notes(diary(spark, d), days).select("note_id")


@register("adjacent_days", f"WITH {RECS}, {DIARY} SELECT CAST(x AS VARCHAR) AS day, x IN (SELECT bucket FROM recs) OR CAST(x AS VARCHAR) IN (SELECT note_id FROM diary) AS active FROM (SELECT unnest([DATE '2024-01-30', DATE '2024-02-01']) AS x)")
def adjacent_days(spark, d):
    return context.adjacent(diary(spark, d), event_records(spark, d), date(2024, 1, 31)).select(F.col("day").cast("string"), "active")


@register("without_noise", "SELECT doc_id FROM documents WHERE doc_id % 11 NOT IN (2, 3)")
def without_noise(spark, d):
    i = F.col("doc_id")
    named = F.when(i % 11 == 2, F.lit("x/Agents.MD")).when(i % 11 == 4, F.lit("x/agents.md.md")).otherwise(F.lit("agents.md/y.md"))
    n = table(spark, d, "documents").select("doc_id", named.alias("relative_path"), F.when(i % 11 == 3, "CLAUDE").otherwise(i.cast("string")).alias("note_id"))
    return context.without_noise(n).select("doc_id")


# Files


FILES = "files AS (SELECT 'f' || k || '.log' AS relative_path, TIMESTAMP '2024-01-01' + INTERVAL (k) DAY AS file_modified_at FROM range(9) t(k))"


def files(spark) -> DataFrame:
    return spark.range(9).select(F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".log")).alias("relative_path"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 86400).alias("file_modified_at"))


@register("metric_files", f"WITH {FILES} SELECT relative_path FROM files WHERE relative_path IN (SELECT 'f' || event_id % 5 || '.log' FROM events WHERE event_type = 'click') OR file_modified_at >= TIMESTAMP '2024-01-03' AND file_modified_at < TIMESTAMP '2024-01-08'")
def metric_files(spark, d):
    r = event_records(spark, d).where("key = 'web.click'").withColumn("source_file", F.concat(F.lit("f"), (F.col("source_line") % 5).cast("string"), F.lit(".log")))
    span = DateRange(Bound(midnight(date(2024, 1, 3))), Bound(midnight(date(2024, 1, 8)), False))
    return context.merge_files(context.files_modified(files(spark), span), context.files_for_records(files(spark), r)).select("relative_path")


# Links


@register("links_around", f"WITH {EDGES} SELECT 'back' AS direction, source_id, raw FROM edges WHERE target_id = 'Page 3' UNION ALL SELECT 'forward', source_id, raw FROM edges WHERE source_id = 'Page 3'")
def links_around(spark, d):
    return links.around(page_edges(spark, d), "Page 3").select("direction", "source_id", "raw")


@register("links_refresh", f"WITH {EDGES} SELECT source_id, raw FROM edges WHERE target_id = 'Page 14' AND reason = 'direct'")
def links_refresh(spark, d):
    """Links that lead elsewhere once a page is gone and no other has its id, title or alias."""
    n = page_notes(spark, d).withColumn("title", F.concat(F.lit("only "), "note_id")).withColumn("aliases", F.array(F.concat(F.lit("alias "), "note_id")))
    every = links.resolve(page_edges(spark, d).select("source_id", "raw", F.col("raw").alias("target")), n)
    return links.refresh(every, n.where("note_id <> 'Page 14'"))[1].select("source_id", "raw")


@register("context_link_rows", f"WITH {EDGES} SELECT DISTINCT reason, source_id AS \"from\", coalesce(target_id, raw) AS \"to\" FROM edges")
def context_link_rows(spark, d):
    return context.dedupe_links(links.context_links(page_edges(spark, d))).select("from", "to", "reason")


@register("target_normalise", r"SELECT doc_id, 'Dir/Note ' || doc_id % 7 AS target FROM documents")
def target_normalise(spark, d):
    made = F.concat(F.lit(" ./Dir\\Note "), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 2 == 0, ".MD ").otherwise(".md"))
    return table(spark, d, "documents").select("doc_id", links.normalise_target(made).alias("target"))


# What is read out of notes


_PAGE_TITLE = r"regexp_extract(html, '<title>([^<\n]*)</title>', 1)"


@register("titles", rf"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Own' WHEN trim({_PAGE_TITLE}) = '' THEN NULL ELSE trim({_PAGE_TITLE}) END AS title FROM pages")
def titles(spark, d):
    head = F.regexp_extract("html", r"<title>([^<\n]*)</title>", 1)
    body = F.concat(F.lit("no title\n ## "), head, F.lit("\n# other\n"))
    none = F.when(F.trim(head) == "", F.lit("text only")).otherwise(body)
    return table(spark, d, "pages").select("page_id", extract.title(F.when(F.col("page_id") % 3 == 0, F.lit(" Own ")), none).alias("title"))


@register("page_wikilinks", r"""SELECT page_id, array_to_string(list_distinct(list_filter(list_transform(regexp_extract_all(html, '<a href="/[^"]*">([^<]*)</a>', 1), lambda x: trim(x)), lambda x: x <> '')).list_sort(), '|') AS links FROM pages""")
def page_wikilinks(spark, d):
    """The pages' own links, written as a note's."""
    body = F.regexp_replace(F.regexp_replace("html", r"\[\[|\]\]", ""), r'<a href="/[^"]*">([^<]*)</a>', "[[$1]]")
    return table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(extract.wikilinks(body)), "|").alias("links"))


@register("aliases", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang || '|' || source END AS aliases FROM documents")
def aliases(spark, d):
    given = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit(" "), F.lit(""))).otherwise(F.array(F.concat(F.lit(" "), "lang"), F.lit("  "), F.concat("source", F.lit("\t "))))
    return table(spark, d, "documents").select("doc_id", F.array_join(extract.aliases(F.transform(given, lambda x: F.translate(x, "\t", " "))), "|").alias("aliases"))


@register("metadata_dates", "SELECT CAST(o_orderkey AS VARCHAR) AS note_id, unnest(['due', 'seen']) AS key, CAST(o_orderdate AS TIMESTAMPTZ) AS value FROM orders")
def metadata_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    doc = F.concat(F.lit('{"due": "'), day, F.lit('", "n": 5, "odd": "2024-1-1", "seen": ["no", "'), day, F.lit('T00:00:00Z"]}'))
    found = vault.metadata_dates(table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("note_id"), doc.alias("metadata_json")))
    return found.select("note_id", "key", "value")


@register("note_dates", f"WITH {DIARY} SELECT note_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat([CASE WHEN doc_id < 30 THEN note_id END], regexp_extract_all(content, '\\b\\d{{4}}-\\d{{2}}-\\d{{2}}\\b')), lambda x: CAST(TRY_CAST(x AS DATE) AS VARCHAR)), lambda x: x IS NOT NULL))), ',') AS days FROM diary")
def note_dates(spark, d):
    found = extract.note_dates(F.col("note_id"), F.lit(None).cast("string"), F.col("content"))
    return diary(spark, d).select("note_id", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("days"))


@register("metric_references", f"WITH {DIARY} SELECT note_id, CASE WHEN doc_id = 4 THEN 'e7' WHEN doc_id = 40 THEN 'e11' ELSE 'e' || doc_id END AS ref FROM diary WHERE doc_id IN (4, 40) OR doc_id % 50 = 3")
def metric_references(spark, d):
    return diary(spark, d).select("note_id", F.explode(extract.metric_refs(F.col("content"))).alias("ref"))


@register("metric_key_mentions", r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g'), '\b[a-z][a-z0-9_]*(?:\.[a-z][a-z0-9_]*)+\b'))) AS key FROM documents")
def metric_key_mentions(spark, d):
    plain = F.regexp_replace(F.lower("text"), r"[^\x00-\x7F]", "_")
    return table(spark, d, "documents").select("doc_id", F.explode(extract.metric_keys(plain)).alias("key"))


@register("previews", "SELECT doc_id, CASE WHEN length(trim(text, ' \t\n\r')) > 240 THEN left(trim(text, ' \t\n\r'), 240) || '...' ELSE trim(text, ' \t\n\r') END AS preview FROM documents")
def previews(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.preview(F.col("text")).alias("preview"))


@register("content_documents", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || lang || chr(10) || chr(10) || text) AS digest FROM documents")
def content_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(extract.content_document(F.col("doc_id").cast("string"), F.col("lang"), F.col("text")), "UTF-8")).alias("digest"))


@register("metadata_documents", "SELECT doc_id, 'lang:' || lang || ' ' || lang || chr(10) || 'n:' || n_chars || ' ' || n_chars || chr(10) || 'tags:a a' || chr(10) || 'tags:' || source || ' ' || source AS words FROM documents")
def metadata_documents(spark, d):
    meta = F.concat(F.lit('{"tags": ["a", "'), "source", F.lit('"], "lang": "'), "lang", F.lit('", "no": null, "n": '), F.col("n_chars").cast("string"), F.lit("}"))
    return table(spark, d, "documents").select("doc_id", extract.metadata_document(meta).alias("words"))


@register("embedding_texts", "SELECT doc_id, md5(lang || chr(10) || chr(10) || 'Metadata:' || chr(10) || 'n: ' || n_chars || chr(10) || 'source: ' || source || chr(10) || chr(10) || 'Tags: a, b' || CASE WHEN text <> '' THEN chr(10) || chr(10) || text ELSE '' END) AS digest FROM documents")
def embedding_texts(spark, d):
    lines = F.array(F.concat(F.lit("source: "), "source"), F.concat(F.lit("n: "), F.col("n_chars").cast("string")))
    made = extract.embedding_text(F.col("lang"), lines, F.array(F.lit("a"), F.lit("b")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(F.encode(made, "UTF-8")).alias("digest"))


@register("similarity_texts", "SELECT doc_id, lang || ' #' || source AS words FROM documents")
def similarity_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", extract.similarity_text(F.col("lang"), F.array("source"), F.col("text")).alias("words"))


@register("metadata_kinds", "SELECT field, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM (SELECT 'a' AS field, CASE WHEN doc_id % 2 = 0 THEN 'string' ELSE 'number' END AS kind FROM documents UNION ALL SELECT 'b', CASE doc_id % 3 WHEN 0 THEN 'array' WHEN 1 THEN 'null' ELSE 'object' END FROM documents) GROUP BY field")
def metadata_kinds(spark, d):
    i = F.col("doc_id")
    eav = table(spark, d, "documents").select(F.explode(F.create_map(F.lit("a"), F.when(i % 2 == 0, F.lit('"x"')).otherwise(F.lit("1.5")), F.lit("b"), F.when(i % 3 == 0, F.lit("[1]")).when(i % 3 == 1, F.lit("null")).otherwise(F.lit("{}")))).alias("key", "value_json"))
    return notes.kinds(eav).select("field", F.array_join("kinds", ",").alias("kinds"))


# Search


@register("fts_id_set", f"WITH {IDX} SELECT note_id FROM idx WHERE doc_id % 5 = 0 AND modified >= TIMESTAMPTZ '2024-01-02 00:00:00+00'")
def fts_id_set(spark, d):
    ids = table(spark, d, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("note_id"))
    return fts.within(note_table(spark, d), ids.unionByName(ids), note_query.parse("modified:>=2024-01-02", NOW).filters).select("note_id")


@register("fts_enriched", f"SELECT note_id, title, relative_path, metadata FROM ({_bm25([('hand', 'cm')], 't0 > 0', 5)}) JOIN (SELECT CAST(doc_id AS VARCHAR) AS note_id, regexp_extract(text, '^([^.\\n]*)', 1) AS title, source || '/' || doc_id || '.md' AS relative_path, lang || ',' || source AS metadata FROM documents) USING (note_id)")
def fts_enriched(spark, d):
    found = fts.enrich(fts.search(indexed(spark, d), "hand", 5, NOW), note_table(spark, d), "hand")
    return found.select("note_id", "title", "relative_path", F.concat_ws(",", F.col("metadata.lang"), F.col("metadata.source")).alias("metadata"))


@register("vector_fetch", "SELECT CAST(vec_id AS VARCHAR) AS note_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id = 5")
def vector_fetch(spark, d):
    return vectors.of_note(vector_table(spark, d), "5", "m").select("note_id", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@register("lists_by_day", "SELECT CAST(o_orderdate AS DATE)::VARCHAR || '-' || o_orderkey AS note_id FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def lists_by_day(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-"), F.col("o_orderkey").cast("string")).alias("note_id"), F.create_map().cast("map<string,string>").alias("metadata"))
    return notes.list_notes(o, span=notes.list_range("1995-03-01..1995-03-31", NOW)).select("note_id")


# Mutations and the index


def log_lines(spark, d) -> DataFrame:
    i = F.col("event_id")
    line = F.concat(F.lit('{"id":"m'), i.cast("string"), F.lit('","ts":"2024-01-01T00:00:00Z","key":"body.weight","value":1,"source":"s"}'))
    return table(spark, d, "events").select(F.concat(F.lit("f"), (i % 3).cast("string")).alias("source_file"), i.cast("int").alias("source_line"), line.alias("raw_line"))


_LOG = "SELECT 'f' || event_id % 3 AS source_file, event_id, '{\"id\":\"m' || event_id || '\",\"ts\":\"2024-01-01T00:00:00Z\",\"key\":\"body.weight\",\"value\":1,\"source\":\"s\"}' AS raw_line FROM events"


@register("mutation_create", f"WITH l AS ({_LOG}) SELECT source_file, raw_line FROM l UNION ALL SELECT 'f1', '{{\"id\":\"new\",\"ts\":\"2024-01-02T00:00:00Z\",\"key\":\"body.weight\",\"value\":2.5,\"source\":\"s\"}}'")
def mutation_create(spark, d):
    new = {"value": 2.5, "source": "s", "key": "body.weight", "ts": "2024-01-02T00:00:00Z", "id": "new"}
    return mutations.create(log_lines(spark, d), "f1", new).select("source_file", "raw_line")


@register("mutation_update", f"WITH l AS ({_LOG}) SELECT source_file, CASE WHEN event_id = 9 THEN replace(replace(raw_line, '1,\"source\"', '7,\"source\"'), '}}', ',\"odd\":true}}') ELSE raw_line END AS raw_line FROM l")
def mutation_update(spark, d):
    return mutations.update(log_lines(spark, d), "m9", {"value": 7, "odd": True, "note": None}).select("source_file", "raw_line")


@register("mutation_delete", f"WITH l AS ({_LOG}) SELECT source_file, raw_line FROM l WHERE event_id <> 12")
def mutation_delete(spark, d):
    return mutations.delete(log_lines(spark, d), "m12").select("source_file", "raw_line")


@register("mutation_files", f"WITH l AS ({_LOG}) SELECT CASE source_file WHEN 'f1' THEN 'g1' ELSE source_file END AS source_file, count(*) AS n FROM l WHERE source_file <> 'f2' GROUP BY 1")
def mutation_files(spark, d):
    out = mutations.delete_file(mutations.rename_file(log_lines(spark, d), "f1", "g1"), "f2")
    return out.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


@register("mutation_assign_ids", "SELECT 'f' || event_id % 3 AS source_file, event_id % 4 IN (0, 1, 2) AS given, count(*) AS n FROM events GROUP BY ALL")
def mutation_assign_ids(spark, d):
    """Rows that get an id are those without one, with null and with a blank one; each gets one of its own."""
    i = F.col("source_line")
    line = F.when(i % 4 == 0, F.lit('{"key":"a"}')).when(i % 4 == 1, F.lit('{"id":null,"key":"a"}')).when(i % 4 == 2, F.lit('{"id":" ","key":"a"}')).otherwise(F.col("raw_line"))
    made = mutations.assign_missing_ids(log_lines(spark, d).withColumn("raw_line", line))
    given = made.select("source_file", F.get_json_object("raw_line", "$.id").alias("id")).withColumn("given", F.col("id").rlike("^[0-9A-HJKMNP-TV-Z]{26}$"))
    distinct = given.groupBy("id").agg(F.first("source_file").alias("source_file"), F.first("given").alias("given"))
    return distinct.groupBy("source_file", "given").agg(F.count(F.lit(1)).alias("n"))


@register("index_apply", "SELECT CAST(doc_id AS VARCHAR) AS note_id, doc_id % 5 = 2 AS edited FROM documents WHERE doc_id % 5 <> 1")
def index_apply(spark, d):
    n = note_table(spark, d).withColumn("metadata_json", F.to_json("metadata"))
    i = F.col("note_id").cast("long") % 5
    now = incremental.fingerprinted(n.withColumn("content", F.when(i == 2, F.lit("new")).otherwise(F.col("content"))))
    old = incremental.fingerprinted(n).where(i != 0)
    out = incremental.apply(old, now.where(i != 1), incremental.plan(now.where(i != 1), old))
    return out.select("note_id", (F.col("content") == "new").alias("edited"))


@register("index_scope", "SELECT CAST(doc_id AS VARCHAR) AS note_id FROM documents WHERE source = 'src1' OR source || '/' || doc_id || '.md' = 'src2/7.md'")
def index_scope(spark, d):
    return incremental.in_scopes(note_table(spark, d), ["src1", "src2/7.md"]).select("note_id")


@register("index_remove_note", f"WITH {EDGES} SELECT source_id, raw, CASE WHEN target_id = 'Page 2' THEN NULL ELSE target_id END AS target_id FROM edges WHERE source_id <> 'Page 2'")
def index_remove_note(spark, d):
    v = vector_table(spark, d)
    return incremental.remove_note(page_notes(spark, d), page_edges(spark, d), v, "Page 2")[1].select("source_id", "raw", "target_id")


@register("literal_quoting", "SELECT doc_id FROM documents WHERE contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' the and ')")
def literal_quoting(spark, d):
    """A phrase with the query language's own words and signs."""
    return table(spark, d, "documents").where(text.has_phrase(F.col("text"), F.lit('"the" AND'))).select("doc_id")



