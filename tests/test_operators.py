import json
from datetime import UTC, date, datetime

import pytest
from noteql.functions import extract, text
from noteql.functions.dates import QueryError
from noteql.operators import context, fts, links, metrics, mutations, notes, vectors
from pyspark.sql import functions as F

NOW = datetime(2024, 5, 10, 12, tzinfo=UTC)


def made(spark, rows):
    cols = [(i, t, None if m is None else datetime(2024, 5, m, tzinfo=UTC)) for i, t, m in rows]
    n = spark.createDataFrame(cols, "note_id string, content string, file_modified_at timestamp").withColumn("created_at", F.col("file_modified_at"))
    return fts.index_text(n, F.col("content"), F.lit(""))


def ids(df):
    return [r.note_id for r in df.collect()]


def test_exclusions_come_before_the_limit(spark):
    rows = [(f"b{k}", "apple banned", 1) for k in range(10)] + [("good", "apple " + "pad " * 50, 1)]
    assert ids(fts.search(made(spark, rows), "apple NOT banned", 1, NOW)) == ["good"]


def test_rank_prefers_frequent_terms_and_short_notes(spark):
    rows = [("strong", "apple apple", 1), ("medium", "apple and some more words", 1), ("weak", "apple " + "pad " * 40, 1), ("none", "pear", 1)] + [(f"x{k}", "other words", 1) for k in range(9)]
    found = fts.search(made(spark, rows), "apple", 2, NOW).collect()
    assert [r.note_id for r in found] == ["strong", "medium"]
    assert found[0]["rank"] < found[1]["rank"] < 0 and found[0].score > found[1].score > 0


def test_filter_only(spark):
    rows = [("old", "a", 1), ("new", "a", 9), ("newer", "banned", 10), ("no time", "a", None)]
    assert ids(fts.search(made(spark, rows), "modified:>=2024-05-05 NOT banned", 5, NOW)) == ["new"]
    with pytest.raises(QueryError):
        fts.search(made(spark, rows), "a", 0, NOW)


def test_phrases_and_unicode(spark):
    rows = [("1", "Größe über alles", 1), ("2", "über Größe", 1), ("3", "a a a", 1)]
    assert ids(fts.matching_ids(made(spark, rows), '"größe über"', NOW)) == ["1"]
    assert made(spark, rows).where("note_id = '3'").select(fts.frequency(fts.Term("a"))).first()[0] == 3


def test_degenerate_scores(spark):
    rows = spark.createDataFrame([(-5.0,), (-0.1,), (0.0,), (3.0,), (float("nan"),), (float("-inf"),), (None,)], "r double")
    got = [r[0] for r in rows.select(fts.score(F.col("r"))).collect()]
    assert got[0] > got[1] > 0 and got[2:] == [0.0] * 5


@pytest.mark.parametrize("word,stem", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("falling", "fall"), ("agreed", "agre"), ("happy", "happi"), ("formalize", "formal"), ("adjustment", "adjust"), ("controlling", "control"), ("rate", "rate"), ("sky", "sky")])
def test_porter(word, stem):
    assert text.porter(word) == stem


def test_tags_links_and_titles(spark):
    body = "#top a#no !#no [#no] #日本 #Тег-1 #a/b\n# Head\n[[A|x]] ![[e.png]] [[A|x]] [[B#h]] [[ ]] [[|y]]"
    r = spark.createDataFrame([(body,)], "t string").select(
        extract.inline_tags(F.col("t")).alias("tags"), F.transform(extract.wikilinks(F.col("t")), extract.parse_link).alias("links"), extract.title(F.lit(" "), F.col("t")).alias("title")
    ).first()
    assert set(r.tags) == {"top", "日本", "Тег-1", "a"} and r.title == "top a#no !#no [#no] #日本 #Тег-1 #a/b"
    assert [(x.target, x.display, x.heading) for x in r.links] == [("A", "x", None), ("B", None, "h"), (None, "y", None)]


def test_note_dates_and_refs(spark):
    t = F.lit("on 2024-02-30 and 2024-02-29, metric:abc.def. body.weight Body.Fat")
    r = spark.range(1).select(extract.note_dates(F.lit("2024-01-15-x"), F.lit(None), t).alias("d"), extract.metric_refs(t).alias("r"), extract.metric_keys(t).alias("k")).first()
    assert r.d == [date(2024, 1, 15), date(2024, 2, 29)] and r.r == ["abc.def"] and {"body.weight", "body.fat"} <= set(r.k)


def note_rows(spark):
    rows = [("Hub", "Center", ["main"], "[[other]] [[CENTER]] [[solo]] [[twin]] [[gone]]"), ("Other", None, None, "[[Hub]]"), ("X", None, ["solo", "twin"], ""), ("Y", None, ["twin"], "[[Y]]"), ("Z", None, None, "[[gone]]")]
    return spark.createDataFrame(rows, "note_id string, title string, aliases array<string>, content string")


def test_link_cascade_orphans_and_refresh(spark):
    n = note_rows(spark)
    e = links.edges_of(n).cache()
    got = {(r.source_id, r.raw): (r.target_id, r.reason) for r in e.collect()}
    assert got[("Hub", "other")] == ("Other", "direct") and got[("Hub", "CENTER")] == ("Hub", "title")
    assert got[("Hub", "solo")] == ("X", "alias") and got[("Hub", "twin")] == (None, "unresolved")
    assert [r.note_id for r in links.orphans(n, e).collect()] == ["Z"]
    assert {r.source_id for r in links.backlinks(e, "Hub").collect()} == {"Hub", "Other"}
    again, changed = links.refresh(e, n.where("note_id <> 'Y'"))
    assert {r.raw for r in changed.collect()} == {"twin", "Y"}
    assert links.resolve_reference("center", n) == "Hub"
    for bad in ("twin", "nobody"):
        with pytest.raises(QueryError):
            links.resolve_reference(bad, n)


def test_targets(spark):
    r = [x[0] for x in spark.createDataFrame([(x,) for x in ["a/b.md", "./a\\b", "/abs", "../up", "a/../b", " ", "C:/x"]], "t string").select(links.normalise_target(F.col("t"))).collect()]
    assert r == ["a/b", "a/b", None, None, None, None, None]


def line(**kw):
    base = {"id": "1", "ts": "2024-04-01T01:00:00+04:00", "key": "body.weight", "value": 80.5, "source": "scale"}
    return json.dumps({k: v for k, v in (base | kw).items() if v is not ...})


def parsed(spark, *lines_):
    return metrics.parse_lines(spark.createDataFrame([("f", k, x) for k, x in enumerate(lines_, 1)], "source_file string, source_line int, raw_line string"))


def codes(df):
    return [[i.code for i in r.issues] for r in df.orderBy("source_line").collect()]


def test_validation(spark):
    got = codes(parsed(spark, line(unit="kg", tags=["b", "a", "b"]), "{", "[1]", line(id=..., key=" ", source=None), line(id="2", value="5"), line(id="3", context=[], tags=[1]), line(id="4", key="a.b", unit="x", extra=1), line(id="5", unit="lb"), line(id="6", origin_id="o"), line(id="6", origin_id="o"), line(id="7", date="2024-02-30"), line(id="8", ts="2024")))
    assert got == [[], ["invalid_json"], ["invalid_row_type"], ["invalid_id", "invalid_key", "invalid_source"], ["invalid_value"], ["invalid_context", "invalid_tags"], ["unknown_metric_key", "unknown_unit", "unknown_field"], ["unit_mismatch"], ["duplicate_id", "duplicate_origin_id"], ["duplicate_id", "duplicate_origin_id"], ["invalid_date"], ["invalid_ts"]]
    rec = metrics.records(parsed(spark, line(unit="kg", tags=["b", "a", "b"], x={"y": 1}))).first()
    assert rec.tags == ["a", "b"] and rec.ts_utc == datetime(2024, 3, 31, 21) and json.loads(rec.extra_fields_json)["x"]


def test_daily_buckets_are_local_and_units_must_agree(spark):
    r = metrics.records(parsed(spark, line(), line(id="2", value=1), line(id="3", date="2024-04-02", value=2)))
    assert [(x.bucket, x.total) for x in metrics.daily_sum(r, 5).collect()] == [(date(2024, 4, 2), 2.0), (date(2024, 4, 1), 81.5)]
    mixed = metrics.records(parsed(spark, line(), line(id="2", unit="kg")))
    with pytest.raises(QueryError):
        metrics.daily_sum(mixed, 5)
    assert metrics.rollups(mixed, ["key", "source"]).isEmpty()
    assert metrics.search(r, "date:2024-03", None, NOW).count() == 2


def test_prefixes(spark):
    assert spark.range(1).select(metrics.prefix_length(F.lit("a.b.c"), F.lit("a.b.x")), metrics.prefix_length(F.lit("a"), F.lit("b.a")), metrics.prefix_length(F.lit("a.x.c"), F.lit("a.y.c"))).first()[:] == (2, 0, 1)


def test_mutations(spark):
    rows = spark.createDataFrame([("f", 1, line()), ("f", 2, '{"id": null, "a": 1}')], "source_file string, source_line int, raw_line string")
    more = mutations.create(rows, "f", json.loads(line(id="9")))
    assert more.count() == 3
    with pytest.raises(QueryError):
        mutations.create(more, "g", json.loads(line(id="9")))
    with pytest.raises(QueryError):
        mutations.create(rows, "f", {"id": "x"})
    changed = mutations.update(more, "9", {"note": "n", "value": 3})
    assert json.loads(changed.where("source_line = 3").first().raw_line)["note"] == "n"
    assert mutations.delete(changed, "9").count() == 2
    ids_ = [json.loads(r.raw_line)["id"] for r in mutations.assign_missing_ids(rows).orderBy("source_line").collect()]
    assert ids_[0] == "1" and len(ids_[1]) == 26
    assert mutations.new_id(0)[:10] == "0" * 10


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "note_id string, vector array<float>").withColumn("model", F.lit("m"))
    assert ids(vectors.knn(v, [1.0, 0.0], 2)) == ["a", "b"] and ids(vectors.related(v, "a", 2)) == ["b"]
    t = spark.createDataFrame([("t", 0.1), ("both", 0.2)], "note_id string, score double")
    s = spark.createDataFrame([("both", 0.1), ("s1", 0.59), ("s2", 0.61)], "note_id string, similarity double")
    assert ids(vectors.fuse(t, s, 10)) == ["s2", "t"]
    e = vectors.hashing_embedder(16)
    assert e("same words") == e("same words") and abs(sum(x * x for x in e("same words")) - 1) < 1e-9


def knowledge(spark):
    n = [("2024-04-01", None, "weight metric:1", 1), ("Hub", "Project Hub", "about body.weight", 2), ("Rel", None, "the project hub lives", 3), ("AGENTS", None, "body.weight", 4)]
    rows = [(i, t, c, f"{i}.md", datetime(2024, 4, d, 8, tzinfo=UTC), datetime(2024, 4, d, 8, tzinfo=UTC)) for i, t, c, d in n]
    notes_ = spark.createDataFrame(rows, "note_id string, title string, content string, relative_path string, file_modified_at timestamp, created_at timestamp")
    r = metrics.records(parsed(spark, line(), line(id="2", key="sleep.duration", date="2024-04-01"), line(id="3", date="2024-04-02")))
    e = links.edges_of(notes_.withColumn("aliases", F.lit(None).cast("array<string>")))
    # Small plans: the tables as they are stored.
    r, e = (spark.createDataFrame(df.collect(), df.schema) for df in (r, e))
    return context.Knowledge(notes_, r, e)


def test_context_views(spark):
    k = knowledge(spark)
    day = context.day_view(k, date(2024, 4, 1))
    assert ids(day["daily_notes"]) == ["2024-04-01"] and ids(day["created"]) == ["2024-04-01"]
    assert [r.active for r in day["adjacent_days"].collect()] == [False, True]
    m = context.metric_view(k, k.records.where("key = 'body.weight'"))
    assert ids(m["notes"])[:2] == ["Hub", "2024-04-01"] and "AGENTS" not in ids(m["notes"])
    assert [r.key for r in m["co_recorded"].collect()] == ["sleep.duration"]
    note = context.note_view(k, "Hub")
    assert ids(note["related"]) == ["Rel"] and [r.id for r in note["metrics"].collect()] == ["1"]
    assert context.week_of(date(2024, 5, 5)) == (date(2024, 4, 29), date(2024, 5, 5))
    assert context.month_of(date(2024, 2, 10)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert context.payload({"x": note["related"]})["x"][0]["note_id"] == "Rel"
    with pytest.raises(QueryError):
        context.note_view(k, "none")


def test_profiles(spark):
    want = {
        "Misc": ["", "x/ "], "ISO date (YYYY-MM-DD)": ["2024-01-01", "d/2024-13-99"], "ISO week (YYYY-Www)": ["2024-W01"], "Numeric identifiers": ["7"], "kebab-case": ["a-b", "c-d"], "snake_case": ["a_b"],
        "PascalCase": ["AbCd"], "Title Case": ["Abc", "Ab Cd", "Él D'ö"], "Uppercase identifiers": ["AB 1"], "Mixed": ["abc", "AbC1 foo", "Mixed-Case Thing", "é"],
    }
    n = spark.createDataFrame([(x,) for v in want.values() for x in v], "id string")
    got = notes.naming_histogram(n, F.col("id")).collect()
    assert {r.pattern: r.examples for r in got} == {k: sorted(v)[:3] for k, v in want.items()} and all(r["count"] == len(want[r.pattern]) for r in got)
    assert [(r["count"], r.pattern) for r in got] == sorted(((r["count"], r.pattern) for r in got), key=lambda r: (-r[0], r[1]))
    empty = notes.stats(spark.createDataFrame([], "raw string")).first()
    assert (empty.total_notes, empty.total_words, empty.average_words) == (0, 0, None)


@pytest.mark.parametrize("strong,inferred,want", [(0, 4, (0, 2)), (1, 4, (1, 2)), (2, 4, (2, 1)), (4, 4, (4, 1)), (5, 4, (5, 0)), (9, 4, (5, 0)), (3, 0, (3, 0))])
def test_prune(spark, strong, inferred, want):
    rows = [(f"s{k}", k % 2, datetime(2024, 5, 1 + k)) for k in range(strong)] + [(f"w{k}", 2, None) for k in range(inferred)]
    got = context.prune(spark.createDataFrame(rows, "note_id string, kind int, at timestamp"), "note_id", "at", 5).collect()
    assert (sum(r.kind < 2 for r in got), sum(r.kind == 2 for r in got)) == want


def test_evidence_of_notes_and_records(spark):
    """Keys narrow a note's days, stronger keys are skipped, references are not narrowed by sources, inferred notes of
    other times go where there is stronger evidence, and limits hold."""
    k = knowledge(spark)
    old = datetime(2023, 1, 1, tzinfo=UTC)
    extra = spark.createDataFrame([("Old", None, "body weight of old", "Old.md", old, old), ("Near", None, "body weight again", "Near.md", datetime(2024, 4, 20, tzinfo=UTC), None)], k.notes.schema)
    k.notes = k.notes.unionByName(extra)
    got = context.notes_for_metric(k, k.records.where("key = 'body.weight'"), 9).collect()
    assert [(r.note_id, r.kind) for r in got] == [("Hub", 0), ("2024-04-01", 0), ("Near", 2)]
    assert got[1].reason == "Note explicitly references matching metric record `metric:1`" and got[2].confidence == 0.35
    none = k.records.where("key = 'body.weight'").withColumns({"id": F.lit("x"), "key": F.lit("weight.of"), "date": F.lit(None).cast("date")})
    assert [r.note_id for r in context.notes_for_metric(k, none, 9).collect()] == ["Old"]
    found = lambda text, note="2024-04-02": [(r.id, r.kind) for r in context.metrics_for_note(k, k.notes.limit(1).withColumns({"note_id": F.lit(note), "content": F.lit(text)}), 9).collect()]
    assert found("sleep.duration") == [("2", 2)] and found("nothing") == [("3", 1)]
    assert found("body.weight metric:2") == [("2", 0), ("3", 1)] and found("of 2024-04-01 body.weight sleep.duration") == [("1", 1), ("3", 1), ("2", 1)]


def test_sources_named_by_a_note(spark):
    rows = [("a b my-log c", "my-log", True), ("only my c", "my-log", False), ("run data", "run-log", True), ("the fit tracker", "fit tracker_health_log", True), ("x", "-log", False)]
    df = spark.createDataFrame(rows, "text string, source string, want boolean")
    assert df.where(context.names_source(F.col("text"), F.col("source")) != F.col("want")).isEmpty()


def test_links_and_pivots(spark):
    k = knowledge(spark)
    k.files = spark.createDataFrame([("f", datetime(2024, 4, 1, tzinfo=UTC)), ("g", datetime(2024, 4, 2, tzinfo=UTC))], "relative_path string, file_modified_at timestamp")
    day = context.day_view(k, date(2024, 4, 1))
    assert [(p["kind"], p["target"]) for p in day["pivots"]] == [("note", "2024-04-01"), ("context_metric", day["metrics"].first().key), ("context_day", "2024-04-02")]
    assert {(r["from"], r["to"]) for r in day["links"].collect()} >= {("day:2024-04-01", "note:2024-04-01"), ("day:2024-04-01", "metric:2")}
    note = context.note_view(k, "Hub")
    assert [p["kind"] for p in note["pivots"]] == ["note", "context_metric", "context_note"] and note["pivots"][1]["evidence"] == "inferred"
    m = context.metric_view(k, k.records.where("key = 'body.weight'"), name="body.weight", span="2024-04")
    assert m["pivots"][-1]["question"].startswith("key:body.weight") and m["pivots"][-1]["question"].endswith("date:2024-04")
    assert ("note:Hub", "body.weight", "explicit") in {(r["from"], r["to"], r["kind"]) for r in m["links"].collect()}
    s = context.source_view(k, k.records.first().source)
    assert s["pivots"][0]["kind"] == "context_metric" and {r.relative_path for r in s["files"].collect()} <= {"f", "g"}
    out = context.Pivots()
    out.add("note", "a", "x")
    out.add("note", "a", "y")
    assert len(out) == 1
    for view in (lambda: context.metric_view(k, k.records.limit(0), name="no"), lambda: context.source_view(k, "no"), lambda: metrics.daily_sum(k.records.limit(0), 3)):
        with pytest.raises(QueryError):
            view()


def test_related_notes(spark):
    embed = vectors.hashing_embedder(64)
    rows = [("a", "apple tart", "sugar and apples", ["food"]), ("b", "apple pie", "apples and sugar #food", []), ("c", "stone wall", "rocks", []), ("d", "é" * 600, None, ["x"])]
    n = spark.createDataFrame(rows, "note_id string, title string, content string, tags array<string>").withColumn("file_modified_at", F.lit(datetime(2024, 1, 1, tzinfo=UTC)))
    text = extract.similarity_text(F.col("title"), F.col("tags"), F.col("content"))
    got = {r.note_id: r.t for r in n.select("note_id", text.alias("t")).collect()}
    assert got == {"a": "apple tart #food", "b": "apple pie apples and sugar #food", "c": "stone wall rocks", "d": "é" * 256}
    v = vectors.embed_notes(n, F.concat_ws(" ", "title", "content"), embed, "m", F.col("file_modified_at"))
    e = spark.createDataFrame([("a", "C", "c", "direct"), ("a", "the c", "c", "alias"), ("b", "a", "a", "direct")], "source_id string, raw string, target_id string, reason string")
    indexed = fts.index_text(n, F.concat_ws(" ", "title", "content"), F.lit(""))
    graph = vectors.related_notes("graph", "a", 5, n, e).collect()
    assert [(r.note_id, r.reason) for r in graph] == [("c", "Outbound link via [[C]]; Outbound link via [[the c]]"), ("b", "Backlink from b")]
    assert vectors.related_notes("auto", "a", 1, n, e, indexed, v, embed).first().note_id == "b"
    assert [r.note_id for r in vectors.related_notes("hybrid", "b", 3, n, e, indexed, v, embed).collect()][:1] == ["a"]
    assert [r.note_id for r in vectors.related_notes("semantic", "a", 5, n, e).collect()] == ["c", "b"]
    with pytest.raises(QueryError):
        vectors.related_notes("odd", "a", 1, n, e)


def test_snippets(spark):
    rows = [
        ("a " * 30 + "running dog " + "b " * 30 + "dog runs dogs " + "c " * 30, "run dog"),
        ("Short text.", "none"),
        ("", "x"),
        (None, "x"),
        ("one Two three", "two"),
        ("z " * 40, "q"),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, w string").select(extract.snippet(F.coalesce("t", F.lit("")), F.col("w"))).collect()]
    assert got[0].startswith("...") and got[0].endswith("...") and "[[dog]] [[runs]] [[dogs]]" in got[0] and len(got[0].strip(".").split()) == 20
    assert got[1:5] == ["Short text", "", "", "one [[Two]] three"] and got[5] == "z " * 19 + "z..."
    assert extract.best_window([(5, "a"), (50, "a"), (52, "b")], 100, 20) == 42 and extract.best_window([(99, "a")], 100, 20) == 80
