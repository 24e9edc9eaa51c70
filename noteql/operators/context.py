"""What surrounds a day, a span of days, a note, a metric or a source: sections as DataFrames.

A ``Knowledge`` holds the tables; every view returns a dict of small, ordered DataFrames. Evidence comes in kinds:
explicit, structural, inferred, in that order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from noteql.functions import extract
from noteql.functions.dates import Bound, DateRange, QueryError, add_months, day_range, midnight
from noteql.functions.text import has_phrase
from noteql.operators import fts, links, metrics
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPLICIT, STRUCTURAL, INFERRED = 0, 1, 2
KINDS = {EXPLICIT: "explicit", STRUCTURAL: "structural", INFERRED: "inferred"}
#: What a link made of evidence is called.
LINK_KINDS = {EXPLICIT: "explicit", STRUCTURAL: "structural", INFERRED: "related"}
NOTE_LIMIT, METRIC_LIMIT = 5, 10
ROLLUP_GROUPS, ROLLUP_BUCKETS = 4, 5
NEAR_DAYS = 45
#: Fixed value: how a note's id begins that names a day.
ID_DATE = r"^(\d{4}-\d{2}-\d{2})(?:$|[-_])"
#: Endings of a source's name that a note may leave out.
SOURCE_SUFFIXES = ("-health-log", "_health_log", "-log", "_log")


@dataclass
class Knowledge:
    """notes: note_id, title, content, relative_path, file_modified_at, created_at, and any more (metadata_json counts
    among what a note says). records and edges as made by the metrics and links operators; vectors, issues of metric
    rows files (relative_path, file_modified_at, and any more) and days,
    the daily parts of the records (``metrics.daily_parts``), are optional, and so is the kept index of the notes'
    ``extract.content_document`` and ``metadata_document``, by which notes that mention something are found. noise: names of files that instruct
    programs."""

    notes: DataFrame
    records: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    issues: DataFrame | None = None
    files: DataFrame | None = None
    days: DataFrame | None = None
    index: fts.Kept | None = None
    noise: tuple[str, ...] = extract.NOISE


def said(notes: DataFrame, metadata: bool = False) -> Column:
    """What a note says: id, title and content, and its metadata if asked for."""
    return F.concat_ws("\n", "note_id", "title", "content", *(["metadata_json"] if metadata and "metadata_json" in notes.columns else []))


def id_date(note_id: Column) -> Column:
    return F.try_to_date(F.nullif(F.regexp_extract(note_id, ID_DATE, 1), F.lit("")))


def without_noise(notes: DataFrame, names=extract.NOISE) -> DataFrame:
    """Notes other than files that instruct programs, whatever the case of their names."""
    leaf = F.lower(F.element_at(F.split("relative_path", "/"), -1))
    stems = [n.removesuffix(".md") for n in names]
    return notes.where(~(F.coalesce(leaf.isin(*names), F.lit(False)) | F.lower("note_id").isin(*stems)))


def daily_notes(notes: DataFrame, days: DataFrame) -> DataFrame:
    """Notes whose id is one of the days (column ``day``)."""
    return notes.join(days.select(F.date_format("day", "yyyy-MM-dd").alias("note_id")).distinct(), "note_id", "left_semi")


def touched(notes: DataFrame, span: DateRange, column: str) -> DataFrame:
    """Notes created or modified in a range, newest first."""
    return notes.where(span.contains(F.col(column))).orderBy(F.col(column).desc(), "note_id")


def merge_capped(groups: list[DataFrame], key: str, limit: int, order: list[Column] | None = None) -> DataFrame:
    """Groups one after another, the first of equal keys, up to the limit. Each group is ranked by ``order`` and cut to
    the limit before they meet."""
    parts = []
    for k, g in enumerate(groups):
        cut = g.orderBy(*(order or [F.col(key)])).limit(limit)
        parts.append(cut.withColumn("__g", F.lit(k)).withColumn("__p", F.row_number().over(Window.orderBy(*(order or [F.col(key)])))))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    first = links.first_per(every, [key], [F.col("__g"), F.col("__p")])
    return first.orderBy("__g", "__p").limit(limit).drop("__g", "__p")


def best_evidence(evidence: DataFrame, key: str, time: str) -> DataFrame:
    """The strongest kind for each key; of equal kinds the newest, null times last, then the first tier (column
    ``tier``, if there is one) and reason."""
    tier = [F.col("tier")] if "tier" in evidence.columns else []
    return links.first_per(evidence, [key], [F.col("kind"), F.col(time).desc_nulls_last(), *tier, F.col("reason")])


def evidence_order(key: str, time: str) -> list[Column]:
    return [F.col("kind"), F.col(time).desc_nulls_last(), F.col(key)]


def prune(evidence: DataFrame, key: str, time: str, limit: int) -> DataFrame:
    """At most ``limit`` strong rows; inferred ones at most one beside two strong or more, else two, if there is room."""
    strong = F.col("kind") < INFERRED
    order = Window.partitionBy("__strong").orderBy(*evidence_order(key, time))
    out = evidence.withColumn("__strong", strong).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= limit)
    n = F.sum(F.col("__strong").cast("int")).over(Window.partitionBy())
    room = F.least(F.when(n >= 2, 1).otherwise(2), F.lit(limit) - n)
    return out.withColumn("__room", room).where(F.col("__strong") | (F.col("__r") <= F.col("__room"))).drop("__strong", "__r", "__room").orderBy(*evidence_order(key, time))


def near_anchor(notes: DataFrame, span: tuple[date, date], days: int = NEAR_DAYS) -> Column:
    """Whether a note's id day or a file time lies within the days around a span."""
    low, high = span[0] - timedelta(days=days), span[1] + timedelta(days=days)
    tests = [id_date(F.col("note_id")), F.col("file_modified_at").cast("date"), F.col("created_at").cast("date")]
    return metrics.any_of([F.coalesce(t.between(F.lit(low), F.lit(high)), F.lit(False)) for t in tests])


def active_days(notes: DataFrame, records: DataFrame, with_timestamps: bool = False) -> DataFrame:
    """Distinct days that a note's id or a record's date names; with timestamps records without a date count too."""
    of_records = metrics.bucket() if with_timestamps else F.col("date")
    both = notes.select(id_date(F.col("note_id")).alias("day")).unionByName(records.select(of_records.alias("day")))
    return both.where("day is not null").distinct()


def adjacent(notes: DataFrame, records: DataFrame, day: date) -> DataFrame:
    """(day, active) for the days before and after."""
    both = notes.sparkSession.createDataFrame([(day - timedelta(days=1),), (day + timedelta(days=1),)], "day date")
    active = active_days(notes, records, True).withColumn("active", F.lit(True))
    return both.join(active, "day", "left").select("day", F.coalesce("active", F.lit(False)).alias("active")).orderBy("day")


def dedupe_links(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.dropDuplicates(["kind", "from", "to", "reason"]).orderBy("from", "to", "reason")
    return out if limit is None else out.limit(limit)


def attention(issue_rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, subject, message): issues of metric rows, and links that lead nowhere."""
    a = issue_rows.select(F.lit("metric_issue").alias("kind"), F.concat_ws(":", "source_file", F.col("source_line").cast("string")).alias("subject"), F.col("message"))
    b = links.unresolved(edges).select(F.lit("unresolved_link").alias("kind"), F.col("source_id").alias("subject"), F.concat(F.lit("no note for "), "raw").alias("message"))
    return a.unionByName(b)


#: So many notes are read by their ids; if there are more, they are joined.
CANDIDATES = 2000


def may_say(k: Knowledge, notes: DataFrame, phrases: list[str]) -> DataFrame:
    """Notes that may say one of the phrases, words that follow each other, in any case or inflection: by the words' positions in the kept index, so that
    no other texts are read; all notes, if there is no index. Notes with marks or signs that the index and a literal
    reading take apart differently are always among them. What they do say is for the caller to look up in their texts."""
    terms = [t for t in map(fts.Term, phrases) if fts.words_of([t], k.index.stem)] if k.index is not None else []
    if k.index is None:
        return notes
    rows = k.index.rows(fts.words_of(terms, k.index.stem) | {fts.IRREGULAR})
    test = metrics.any_of([F.map_contains_key("hits", F.lit(fts.IRREGULAR)), *[fts.frequency(t, k.index.stem, True) > 0 for t in terms]])
    ids = rows.where(test).select("note_id")
    few = [r.note_id for r in ids.limit(CANDIDATES + 1).collect()]
    return notes.where(F.col("note_id").isin(few)) if len(few) <= CANDIDATES else notes.join(ids, "note_id", "left_semi")


def _tiers(tiers: list) -> DataFrame:
    """Rows (note_id, times, kind, tier, reason, confidence) of several (notes, kind, reason, confidence)."""
    every = None
    for k, (rows, kind, reason, confidence) in enumerate(tiers):
        rows = rows.select("note_id", "file_modified_at", "created_at", F.lit(kind).alias("kind"), F.lit(k).alias("tier"), reason.alias("reason"), F.lit(confidence).cast("double").alias("confidence"))
        every = rows if every is None else every.unionByName(rows)
    return every


def _note_evidence(tiers: list, target: DataFrame, limit: int) -> DataFrame:
    """The best of the tiers for each note, pruned. If there is any stronger evidence, inferred notes must lie near the
    target records' days."""
    every = _tiers(tiers)
    span = metrics.activity_window(target).first()
    strong = every.where(F.col("kind") < INFERRED)
    if span.first_day is not None and not strong.isEmpty():
        every = every.where((F.col("kind") < INFERRED) | near_anchor(every, (span.first_day, span.last_day)))
    return prune(best_evidence(every, "note_id", "file_modified_at"), "note_id", "file_modified_at", limit).drop("tier")


def _mentioned(k: Knowledge, notes: DataFrame, what: DataFrame, kind: str) -> DataFrame:
    """(note_id, ref): what of the distinct ``ref`` in ``what`` each note mentions, ``kind`` being that of the index's terms.
    The index knows it; without one it is looked for in the texts. Ids alone are shuffled."""
    if k.index is None:
        said_ = said(notes, True)
        refs = notes.select("note_id", "file_modified_at", "created_at", F.explode(extract.metric_keys(said_) if kind == fts.KEY else extract.metric_refs(said_)).alias("ref"))
        return refs.join(what.select("ref").distinct(), "ref", "left_semi")
    refs = k.index.postings.where(F.startswith("term", F.lit(kind))).select("note_id", F.substring("term", len(kind) + 1, 1 << 30).alias("ref"))
    return refs.join(what.select("ref").distinct(), "ref", "left_semi").join(notes.select("note_id", "file_modified_at", "created_at"), "note_id")


def notes_for_metric(k: Knowledge, target: DataFrame, limit: int = NOTE_LIMIT) -> DataFrame:
    """(note_id, kind, reason, confidence, ...) for target records of one key: notes that refer to a record or mention
    the key, notes of a record's date, and notes that have the key's words, the last within 45 days of the records if
    there is any stronger evidence."""
    notes = without_noise(k.notes, k.noise)
    key = target.agg(F.min("key").alias("key")).first().key
    if key is None or limit < 1:
        return _note_evidence([(notes.limit(0), EXPLICIT, F.lit(""), None)], target, max(1, limit))
    by_ref = _mentioned(k, notes, target.select(F.col("id").alias("ref")), fts.REFERENCE)
    by_key = _mentioned(k, notes, target.limit(1).select(F.lit(key.lower()).alias("ref")), fts.KEY)
    tiers = [
        (by_ref, EXPLICIT, F.concat(F.lit("Note explicitly references matching metric record `metric:"), "ref", F.lit("`")), None),
        (by_key, EXPLICIT, F.lit(f"Note explicitly mentions metric key `{key}`"), None),
        (daily_notes(notes, target.select(F.col("date").alias("day")).where("day is not null")), STRUCTURAL, F.lit("Same day as metric activity"), None),
        (may_say(k, notes, [key]).where(has_phrase(said(notes), F.lit(key))), INFERRED, F.lit("Note text matches metric key"), 0.35),
    ]
    return _note_evidence(tiers, target, limit)


def notes_for_source(k: Knowledge, source: str, target: DataFrame, limit: int = NOTE_LIMIT) -> DataFrame:
    """Notes that mention a source, notes of a date it has records for, and notes that mention one of its keys, the last
    within 45 days of the records if there is any stronger evidence."""
    notes = without_noise(k.notes, k.noise)
    mention = _mentioned(k, notes, target.select(F.lower("key").alias("ref")), fts.KEY)
    tiers = [
        (may_say(k, notes, [source]).where(has_phrase(said(notes), F.lit(source))), EXPLICIT, F.lit(f"Note explicitly mentions source `{source}`"), None),
        (daily_notes(notes, target.select(F.col("date").alias("day")).where("day is not null")), STRUCTURAL, F.lit("Same day as source metric activity"), None),
        (mention, INFERRED, F.concat(F.lit("Note text mentions metric key `"), "ref", F.lit(f"` emitted by source `{source}`")), 0.3),
    ]
    return _note_evidence(tiers, target, limit)


def names_source(text: Column, source: Column) -> Column:
    """Whether a text mentions a source by its name, or by the name without its ending if three letters are left."""
    tests = has_phrase(text, source)
    for end in SOURCE_SUFFIXES:
        short = F.trim(F.left(source, F.char_length(source) - len(end)))
        tests = tests | (F.endswith(F.trim(source), F.lit(end)) & (F.octet_length(short) >= 3) & has_phrase(text, short))
    return tests


def record_order() -> list[Column]:
    return [F.col("ts_utc").desc(), F.col("source_file"), F.col("source_line")]


def metrics_for_note(k: Knowledge, note: DataFrame, limit: int = METRIC_LIMIT) -> DataFrame:
    """Records that a note refers to by id; records of its days, of the keys it mentions if it mentions any; and the
    latest record of every mentioned key without stronger evidence.

    Of the records of one day and key, or of one key, those of the sources that the note mentions stay, if it mentions
    any of theirs; references are not touched by that. A day, or a day and key, gives at most twice the limit.
    """
    everything = said(note, True)
    n = note.select(said(note).alias("text"), extract.metric_refs(everything).alias("refs"), extract.metric_keys(everything).alias("keys"), extract.note_dates(F.col("note_id"), F.get_json_object("metadata_json", "$.date") if "metadata_json" in note.columns else F.lit(None).cast("string"), everything).alias("days"))
    r = k.records.withColumn("day", metrics.bucket())
    cols = [*r.columns, "kind", "reason", "confidence"]
    evidence = lambda kind, reason, confidence=None: [F.lit(kind).alias("kind"), reason.alias("reason"), F.lit(confidence).cast("double").alias("confidence")]
    by_ref = n.select(F.explode("refs").alias("id")).distinct().join(r, "id").select(*r.columns, *evidence(EXPLICIT, F.lit("Note contains explicit metric reference")))
    # One note's days and keys from here on. Records are found by them before anything is ranked.
    days = n.select("text", "keys", F.explode("days").alias("day"))
    listed = [F.coalesce(F.col("date").cast("timestamp"), F.col("ts_utc")).desc(), F.col("source_file"), F.col("source_line")]
    few = lambda rows, by: rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*listed))).where(F.col("__n") <= 2 * limit).drop("__n")
    plain = few(days.where(F.size("keys") == 0).join(r, "day"), ["day"])
    plain = plain.select(*r.columns, *evidence(STRUCTURAL, F.concat(F.lit("Note references day "), F.col("day").cast("string"), F.lit(" with recorded metrics"))))
    keyed = days.select("text", "day", F.explode("keys").alias("mention")).join(r.withColumn("mention", F.lower("key")), ["day", "mention"])
    keyed = _of_named_sources(few(keyed, ["day", "mention"]), ["day", "mention"])
    both = F.concat(F.lit("Note references day "), F.col("day").cast("string"), F.when(F.col("named"), ",").otherwise(" and"), F.lit(" metric key `"), "mention", F.lit("`"), F.when(F.col("named"), F.concat(F.lit(", and source `"), "source", F.lit("`"))).otherwise(""))
    strong = by_ref.unionByName(plain.select(cols)).unionByName(keyed.select(*r.columns, *evidence(STRUCTURAL, both)))
    open_keys = n.select("text", F.explode("keys").alias("mention")).join(strong.select(F.col("key").alias("mention")).distinct(), "mention", "left_anti")
    latest = _of_named_sources(few(open_keys.join(r.withColumn("mention", F.lower("key")), "mention"), ["mention"]), ["mention"])
    latest = links.first_per(latest, ["mention"], record_order())
    why = F.concat(F.lit("Note explicitly mentions "), F.when(F.col("named"), F.concat(F.lit("source `"), "source", F.lit("` and "))).otherwise(""), F.lit("metric key `"), "mention", F.lit("`; latest matching record"))
    every = strong.unionByName(latest.select(*r.columns, *evidence(INFERRED, why, 0.45)))
    return best_evidence(every, "id", "ts_utc").orderBy("kind", F.col("ts_utc").desc(), "key", "id").limit(limit)


def _of_named_sources(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``named``, whether the text mentions their source; within each group of ``by`` the named ones alone, if
    there are any."""
    rows = rows.withColumn("named", names_source(F.col("text"), F.col("source")))
    any_named = F.max(F.col("named").cast("int")).over(Window.partitionBy(*by))
    return rows.withColumn("__any", any_named).where((F.col("__any") == 0) | F.col("named")).drop("__any")


def day_ranking(days: DataFrame, evidence: DataFrame) -> DataFrame:
    """A note's days (column ``day``) in the order of the best evidence of their records: days with records first, by
    kind, confidence, newest record; then, and of equals, the latest day."""
    best = links.first_per(evidence.select(metrics.bucket().alias("day"), "kind", "confidence", "ts_utc"), ["day"], [F.col("kind"), F.col("confidence").desc_nulls_last(), F.col("ts_utc").desc()])
    ranked = days.select("day").distinct().join(best, "day", "left")
    return ranked.orderBy(F.col("kind").asc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("ts_utc").desc_nulls_last(), F.col("day").desc())


# Files, links and pivots


def files_for_records(files: DataFrame, records: DataFrame) -> DataFrame:
    """Files that hold some of the records, by path."""
    return files.join(records.select(F.col("source_file").alias("relative_path")).distinct(), "relative_path", "left_semi").orderBy("relative_path")


def files_modified(files: DataFrame, span: DateRange) -> DataFrame:
    """Files modified in a range, newest first."""
    return files.where(span.contains(F.col("file_modified_at"))).orderBy(F.col("file_modified_at").desc(), "relative_path")


def merge_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files of both, each path once, the first table's before the second's; newest first."""
    both = first.withColumn("__g", F.lit(0)).unionByName(second.withColumn("__g", F.lit(1)))
    return links.first_per(both, ["relative_path"], [F.col("__g")]).drop("__g").orderBy(F.col("file_modified_at").desc(), "relative_path")


def link_rows(rows: DataFrame, kind, origin, to, reason, confidence=None) -> DataFrame:
    """(kind, from, to, reason, confidence) of rows; strings are constants, Columns are read from each row."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(col(kind).alias("kind"), col(origin).alias("from"), col(to).alias("to"), col(reason).alias("reason"), col(confidence).cast("double").alias("confidence"))


def _at(kind: str, name) -> Column:
    return F.concat(F.lit(kind + ":"), name if isinstance(name, Column) else F.col(name))


def note_day_links(note_id: str, days: DataFrame) -> DataFrame:
    """From a note to the days it names."""
    named = F.col("day").cast("string")
    return link_rows(days.orderBy("day"), "structural", f"note:{note_id}", _at("day", named), F.concat(F.lit("Note references day "), named))


def day_links(day: date, daily: DataFrame, backlinks: DataFrame, records: DataFrame) -> DataFrame:
    """Between a day and its notes, the notes that link to it, and its records. Notes may carry a ``reason``."""
    here = f"day:{day.isoformat()}"
    why = lambda rows, default: F.coalesce(F.col("reason"), F.lit(default)) if "reason" in rows.columns else F.lit(default)
    out = link_rows(daily, "structural", here, _at("note", "note_id"), why(daily, "Daily note for requested day"))
    out = out.unionByName(link_rows(backlinks, "structural", _at("note", "note_id"), here, why(backlinks, "Links to this day")))
    return out.unionByName(link_rows(records, "structural", here, _at("metric", "id"), f"Metric recorded on {day.isoformat()}"))


def window_links(target: str, note_reason: str, notes: DataFrame, metric_reason: str, records: DataFrame) -> DataFrame:
    """From a span of days to its notes and records."""
    return link_rows(notes, "structural", target, _at("note", "note_id"), note_reason).unionByName(link_rows(records, "structural", target, _at("metric", "id"), metric_reason))


def evidence_links(evidence: DataFrame, origin, to) -> DataFrame:
    """A link for each row of evidence, named by its kind."""
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in LINK_KINDS.items() for x in pair]), F.col("kind"))
    return link_rows(evidence, kind, origin, to, F.col("reason"), F.col("confidence"))


class Pivots(list):
    """Suggestions of what to ask next, each question once: dicts of kind, target, question, reason, evidence and
    confidence."""

    def add(self, kind: str, target, reason: str, row: dict | None = None, evidence: int | None = STRUCTURAL, question: str | None = None) -> None:
        row = row or {}
        evidence = row["kind"] if row.get("kind") is not None else evidence
        asked = (kind, question or str(target))
        if target is not None and all((p["kind"], p["question"]) != asked for p in self):
            self.append({"kind": kind, "target": str(target), "question": asked[1], "reason": reason, "evidence": KINDS.get(evidence), "confidence": row.get("confidence")})

    def rollup(self, row: dict | None, span: str | None, reason: str) -> None:
        if row is not None:
            parts = [f"key:{row['key']}", *([f"source:{row['source']}"] if row.get("source") else []), *([f"date:{span}"] if span else [])]
            self.add("metrics_sum", row["key"], reason, question=" ".join(parts))


def _head(df: DataFrame | None) -> dict | None:
    row = None if df is None else df.first()
    return None if row is None else row.asDict()


def note_pivots(note_id: str, days: DataFrame, notes: DataFrame, records: DataFrame) -> Pivots:
    out = Pivots()
    out.add("note", note_id, "Read the anchor note directly.", evidence=None)
    day, record, note = _head(days), _head(records), _head(notes)
    if day:
        out.add("context_day", day["day"], "Explore the surrounding day context.")
    if record:
        out.add("context_metric", record["key"], "Follow the strongest metric lead.", record, None)
    if note:
        out.add("context_note", note["note_id"], "Inspect the strongest related note.", note, None)
    return out


def day_pivots(day: str, notes: DataFrame, records: DataFrame, days: DataFrame) -> Pivots:
    """``notes`` and ``days`` are few and in order: leads, and days to compare with."""
    out = Pivots()
    leads = [r.asDict() for r in notes.collect()]
    first = next((r for r in leads if r["note_id"] == day), leads[0] if leads else None)
    other = next((r for r in leads if r["note_id"] != day), None)
    record, compare = _head(records), _head(days)
    if first:
        out.add("note", first["note_id"], "Read the daily note or strongest note lead for this day.", first)
    if record:
        out.add("context_metric", record["key"], "Inspect a metric recorded on this day.")
    if compare:
        out.add("context_day", compare["day"], "Compare this day against the nearest adjacent active day.")
    if other:
        out.add("context_note", other["note_id"], "Inspect a note that changed or linked into this day.", other)
    return out


def window_pivots(target: str, notes: DataFrame, records: DataFrame, days: DataFrame, rollups: DataFrame, reason: str) -> Pivots:
    out = day_pivots(target, notes, records, days)
    out.rollup(_head(rollups), target, reason)
    return out


def metric_pivots(target: str, records: DataFrame, notes: DataFrame, days: DataFrame, related: DataFrame, rollups: DataFrame, span: str | None = None) -> Pivots:
    out = Pivots()
    out.add("metrics_read", target, "Inspect the exact metric target directly.", evidence=None)
    day, note, other = _head(days), _head(notes), _head(related)
    if day:
        out.add("context_day", day["day"], "Explore a day where this metric was active.")
    if note:
        out.add("context_note", note["note_id"], "Inspect the strongest related note.", note, None)
    if other:
        out.add("context_metric", other["key"], "Compare against a nearby co-occurring metric.")
    elif record := _head(records.withColumn("day", metrics.bucket())):
        out.add("context_day", record["day"], "Inspect the day containing the latest record.")
    out.rollup(_head(rollups), span, "Inspect the daily trend for this metric.")
    return out


def source_pivots(source: str, records: DataFrame, notes: DataFrame, days: DataFrame, rollups: DataFrame, span: str | None = None) -> Pivots:
    """The newest record's key is the source's first metric lead."""
    out = Pivots()
    record, day, note = _head(records), _head(days), _head(notes)
    if record:
        out.add("context_metric", record["key"], f"Inspect a metric emitted by source {source}.")
    if day:
        out.add("context_day", day["day"], "Inspect an active day for this source.")
    if note:
        out.add("context_note", note["note_id"], "Inspect the strongest related note for this source.", note, None)
    out.rollup(_head(rollups), span, f"Inspect the strongest daily trend for source {source}.")
    return out


def record_days(records: DataFrame) -> DataFrame:
    """Days of the records, the newest record's first."""
    return records.groupBy(metrics.bucket().alias("day")).agg(F.max("ts_utc").alias("ts_utc")).orderBy(F.col("ts_utc").desc(), F.col("day").desc()).select("day")


def latest_per_key(records: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest record of every key, newest first. The newest is an aggregate, so a frequent key is reduced before it
    is shuffled."""
    newest = F.min_by(F.struct(*records.columns), F.struct(-F.unix_micros("ts_utc"), F.col("source_file"), F.col("source_line")))
    out = records.groupBy("key").agg(newest.alias("r")).select("r.*").orderBy(*record_order())
    return out if limit is None else out.limit(limit)


def week_of(day: date) -> tuple[date, date]:
    first = day - timedelta(days=day.weekday())
    return first, first + timedelta(days=6)


def month_of(day: date) -> tuple[date, date]:
    first = day.replace(day=1)
    return first, (add_months(midnight(first), 1) - timedelta(days=1)).date()


def day_view(k: Knowledge, day: date, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT) -> dict:
    """A day: its note, notes created and updated, records, links to it, and the days beside it."""
    if note_limit < 1 or metric_limit < 1:
        raise QueryError("a limit is at least 1")
    out = _span_view(k, day_range(midnight(day)), day, day, note_limit, metric_limit)
    sources = links.backlinks(k.edges, day.isoformat()).select(F.col("source_id").alias("note_id")).distinct()
    linking = without_noise(k.notes, k.noise).join(sources, "note_id", "left_semi").select("note_id", "file_modified_at", "created_at").orderBy("note_id").limit(note_limit)
    around = adjacent(k.notes, k.records, day)
    made = day_links(day, out["daily_notes"], linking, out["metrics"]).unionByName(out["links"].withColumn("confidence", F.lit(None).cast("double")))
    leads = merge_capped([x.select("note_id") for x in (out["daily_notes"], linking, out["created"], out["updated"])], "note_id", note_limit)
    more = {"adjacent_days": around, "backlinks": links.backlinks(k.edges, day.isoformat()), "links": dedupe_links(made, 3 * note_limit + metric_limit), "leads": leads}
    return out | more | {"pivots": day_pivots(day.isoformat(), leads, out["metrics"], around.where("active").select("day"))}


def week_view(k: Knowledge, day: date, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT) -> dict:
    """The week from Monday that holds a day. Records without a date count until the last day's midnight."""
    return _days_view(k, *week_of(day), note_limit, metric_limit, "week")


def month_view(k: Knowledge, day: date, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT) -> dict:
    return _days_view(k, *month_of(day), note_limit, metric_limit, "month")


def changed_view(k: Knowledge, now: datetime, days: int, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT) -> dict:
    """What changed in the last days; daily notes are those of updated notes' days, files also those modified."""
    if days < 1:
        raise QueryError("at least one day")
    first = (now - timedelta(days=days)).date()
    low, high = Bound(now - timedelta(days=days)), Bound(now)
    out = _days_view(k, first, now.date(), note_limit, metric_limit, "changed", low, high)
    updated = out["updated"].select(id_date(F.col("note_id")).alias("day")).where("day is not null")
    if k.files is not None:
        out["files"] = merge_files(files_modified(k.files, DateRange(low, high)), out["files"])
    return out | {"daily_notes": daily_notes(k.notes, updated).orderBy("note_id").limit(note_limit)}


def _days_view(k, first: date, last: date, note_limit, metric_limit, name: str, low: Bound | None = None, high: Bound | None = None):
    span = DateRange(low or Bound(midnight(first)), high or Bound(midnight(last) + timedelta(days=1), False))
    out = _span_view(k, span, first, last, note_limit, metric_limit, DateRange(Bound(midnight(first)), Bound(midnight(last))))
    leads = merge_capped([x.select("note_id") for x in (out["daily_notes"], out["created"], out["updated"])], "note_id", note_limit)
    made = window_links(f"{name}:{first}..{last}", f"Note active in the requested {name}", leads, f"Metric recorded in the requested {name}", out["metrics"])
    out["links"] = dedupe_links(made.unionByName(out["links"].withColumn("confidence", F.lit(None).cast("double"))), 3 * note_limit + metric_limit)
    return out | {"leads": leads, "pivots": window_pivots(f"{first}..{last}", leads, out["metrics"], out["active_days"], out["rollups"], f"Inspect the strongest daily trend of the {name}.")}


def _span_view(k: Knowledge, span: DateRange, first: date, last: date, note_limit: int, metric_limit: int, record_span: DateRange | None = None):
    notes = without_noise(k.notes, k.noise)
    created = touched(notes, span, "created_at")
    updated = touched(notes, span, "file_modified_at").join(created.select("note_id"), "note_id", "left_anti")
    at = F.coalesce(F.col("date").cast("timestamp"), F.col("ts_utc"))
    found = k.records.where((record_span or span).contains(at))
    days = notes.where(id_date(F.col("note_id")).between(F.lit(first), F.lit(last)))
    touched_ids = created.select("note_id").unionByName(updated.select("note_id")).distinct()
    activity = links.context_links(k.edges.join(touched_ids.withColumnRenamed("note_id", "source_id"), "source_id", "left_semi"))
    out = {
        "daily_notes": days.orderBy("note_id").limit(note_limit),
        "created": created.orderBy(F.col("created_at").desc(), "note_id").limit(note_limit),
        "updated": updated.orderBy(F.col("file_modified_at").desc(), "note_id").limit(note_limit),
        "metrics": found.orderBy(*record_order()).limit(metric_limit),
        "rollups": metrics.window_rollups(found, min(metric_limit, ROLLUP_GROUPS), min(metric_limit, ROLLUP_BUCKETS)),
        "links": dedupe_links(activity, 2 * note_limit),
        "active_days": active_days(notes, k.records).where(F.col("day").between(F.lit(first), F.lit(last))).orderBy("day"),
    }
    return out | _attached(k, found)


def _attached(k: Knowledge, records: DataFrame, edges: DataFrame | None = None) -> dict[str, DataFrame]:
    """Files of the records, and what of them and of the edges needs attention, where the knowledge has the tables."""
    out = {}
    if k.files is not None:
        out["files"] = files_for_records(k.files, records)
    if k.issues is not None:
        of = k.issues.join(records.select("source_file", "source_line").distinct(), ["source_file", "source_line"], "left_semi")
        none = k.edges.limit(0) if edges is None else edges
        out["attention"] = attention(of, none).orderBy("message")
    return out


def note_view(k: Knowledge, note_id: str, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT) -> dict:
    """A note: neighbours, then notes that have its title or id, then near vectors, until the limit; and its records."""
    from noteql.operators import vectors

    note = k.notes.where(F.col("note_id") == note_id)
    head = note.select("title").first()
    if head is None:
        raise QueryError(f"no note is called {note_id!r}")
    others = without_noise(k.notes, k.noise).where(F.col("note_id") != note_id)
    item = lambda rows, kind, reason, confidence: rows.select("note_id", "file_modified_at", "created_at", F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(confidence).cast("double").alias("confidence"))
    linked = links.neighbours(k.edges, note_id).select("note_id")
    groups = [item(k.notes.join(linked, "note_id", "left_semi"), STRUCTURAL, "Graph link", None)]
    for term in dict.fromkeys(t for t in ((head.title or "").strip(), note_id.strip()) if t):
        groups.append(item(others.where(has_phrase(F.concat_ws("\n", "note_id", "title", "content"), F.lit(term))), INFERRED, "Textual match", 0.35))
    if k.vectors is not None and vectors.vector_of(k.vectors, note_id) is not None:
        groups.append(item(others.join(vectors.related(k.vectors, note_id, 2 * note_limit).select("note_id"), "note_id", "left_semi"), INFERRED, "Semantic match", 0.25))
    near = merge_capped(groups, "note_id", note_limit, note_item_order()).orderBy(*note_item_order())
    found = metrics_for_note(k, note, metric_limit)
    everything = said(note, True)
    named = note.select(F.explode(extract.note_dates(F.col("note_id"), F.lit(None).cast("string"), everything)).alias("day"))
    days = day_ranking(named, found)
    edges = links.around(k.edges, note_id)
    kept = links.context_links(edges.where("target_id is not null")).withColumn("confidence", F.lit(None).cast("double"))
    made = evidence_links(found, f"note:{note_id}", _at("metric", "id")).unionByName(note_day_links(note_id, named)).unionByName(kept)
    out = {"note": note, "related": near, "metrics": found, "days": days, "links": dedupe_links(made), "edges": edges}
    return out | _attached(k, found, links.forward_links(k.edges, note_id)) | {"pivots": note_pivots(note_id, days, near, found)}


def metric_view(k: Knowledge, target: DataFrame, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT, name: str | None = None, span: str | None = None, parts: DataFrame | None = None) -> dict:
    """Records of a metric: roll-ups over all of them (or of their daily parts), the newest, notes by evidence, and keys recorded beside it."""
    if target.isEmpty():
        raise QueryError(f"metric {name!r} was not found" if name else "no record of that metric was found")
    newest = target.orderBy(*record_order()).limit(metric_limit)
    here = name or newest.first().key
    found = notes_for_metric(k, newest, note_limit)
    days, related = record_days(newest), metrics.co_recorded(k.records, newest, metric_limit)
    rollups = metrics.target_rollups(target if parts is None else parts, min(metric_limit, ROLLUP_BUCKETS), parts is not None)
    made = link_rows(newest, "structural", _at("metric", "id"), _at("source", "source"), "Metric record source").unionByName(evidence_links(found, _at("note", "note_id"), here))
    out = {"records": newest, "rollups": rollups, "notes": found, "days": days, "co_recorded": related, "activity": metrics.activity_window(target), "sources": metrics.distinct_values(newest, "source"), "links": made}
    return out | _attached(k, newest) | {"pivots": metric_pivots(here, newest, found, days, related, rollups, span)}


def source_view(k: Knowledge, source: str, note_limit: int = NOTE_LIMIT, metric_limit: int = METRIC_LIMIT, span: str | None = None) -> dict:
    target = k.records.where(F.lower("source") == source.lower())
    if target.isEmpty():
        raise QueryError(f"source {source!r} was not found")
    newest = target.orderBy(*record_order()).limit(metric_limit)
    found, days = notes_for_source(k, source, newest, note_limit), record_days(newest)
    parts = None if k.days is None else k.days.where(F.lower("source") == source.lower())
    rollups = metrics.window_rollups(target if parts is None else parts, min(metric_limit, ROLLUP_GROUPS), min(metric_limit, ROLLUP_BUCKETS), parts is not None)
    made = link_rows(newest, "structural", f"source:{source}", _at("metric", "id"), "Metric record belongs to the requested source").unionByName(evidence_links(found, _at("note", "note_id"), f"source:{source}"))
    out = {"records": newest, "rollups": rollups, "notes": found, "days": days, "metrics": latest_per_key(target, metric_limit), "keys": metrics.distinct_values(target, "key"), "activity": metrics.activity_window(target), "links": made}
    return out | _attached(k, target) | {"pivots": source_pivots(source, newest, found, days, rollups, span)}


def note_item_order() -> list[Column]:
    return [F.col("kind").asc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("file_modified_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("note_id")]


def payload(sections: dict) -> dict[str, list[dict]]:
    """The sections as one document, for small results."""
    return {name: [r.asDict(recursive=True) for r in df.collect()] if isinstance(df, DataFrame) else list(df) for name, df in sections.items()}
