"""The kept index: ranking by bounds, folding, links by keys, versions that one writer makes, batches that count once."""

import os
import random
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from noteql.functions import text
from noteql.operators import fts, links
from noteql.sources import vault
from noteql.streaming import incremental
from pyspark.sql import functions as F


def collection(spark, rows):
    return spark.createDataFrame(rows, "note_id string, content string, meta string").withColumn("file_modified_at", F.expr("timestamp_seconds(cast(length(content) as long) * 86400)")).withColumn("created_at", F.col("file_modified_at"))


def kept_of(spark, notes, path, stem=False):
    c = incremental.Catalog(spark, str(path), parts=4)
    postings, lengths = fts.build(notes, F.col("content"), F.col("meta"), stem)
    terms, corpus = fts.summaries(postings, lengths, c.part("note_id"))
    c.commit({"postings": postings, "lengths": lengths, "terms": terms, "corpus": corpus})
    return incremental.kept_index(c, stem)


def test_classes_left_out_hold_none_of_the_best(spark, tmp_path, monkeypatch):
    """Whatever the bounds leave out, the best are those of a ranking of all notes."""
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(f"n{i:03}", " ".join(rnd.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rnd.choice([3, 9, 30, 100, 400, 1500]))), rnd.choice(["m1 w0", "m2", ""])) for i in range(250)]
    notes = collection(spark, rows)
    kept = kept_of(spark, notes, tmp_path / "k")
    kept.postings, kept.terms = kept.postings.cache(), kept.terms.cache()
    every = fts.index_text(notes, F.col("content"), F.col("meta")).cache()
    seen = []
    rows_of = fts.Kept.rows
    monkeypatch.setattr(fts.Kept, "rows", lambda self, words, every=False, classes=None: seen.append(classes) or rows_of(self, words, every, classes))
    for query in ("w0", "w3 OR w40", "w5 w9", "(w1 OR w50) AND w2", '"w0 w1" OR w30', "content:w0 metadata:m1", "w7 NOT w8", "w2 modified:>=1970-06-01", "absent OR metadata:m2"):
        for limit in (4,):
            del seen[:]
            got = [(r.note_id, round(r.rank, 9)) for r in fts.search(kept, query, limit).collect()]
            assert got == [(r.note_id, round(r.rank, 9)) for r in fts.search(every, query, limit).collect()], query
    stats = kept.statistics({"w0"})
    del seen[:]
    fts.search(kept, "w0", 1).collect()
    assert stats.notes == 250 and len(seen[-1]) < len(stats.shortest)


def test_a_search_reads_neither_lengths_nor_other_terms(spark, tmp_path):
    rows = [(f"n{i}", f"apple pear{i} " + "pad " * (i % 50), "") for i in range(60)]
    kept = kept_of(spark, collection(spark, rows), tmp_path / "k")
    found = fts.search(kept, "apple OR pear7", 3)
    assert found.inputFiles() and all("/postings-" in f for f in found.inputFiles())
    assert "PushedFilters: [In(term, [apple,pear7]), In(cls," in found._jdf.queryExecution().executedPlan().toString()


def test_accents(spark, tmp_path):
    rows = [("a", "Le café d'été, naïve Ångström", ""), ("b", "café ete", ""), ("c", "Ἑλλάς ёлка", ""), ("d", "straße øre", "")]
    notes = collection(spark, rows)
    for stem in (False, True):
        for index in (kept_of(spark, notes, tmp_path / f"k{stem}", stem), fts.index_text(notes, F.col("content"), F.col("meta"), stem)):
            found = lambda q: sorted(r.note_id for r in fts.matching_ids(index, q, stem=stem).collect())  # noqa: B023, E731
            assert found("cafe") == found("CAFÉ") == found('"café ete"' if False else "café") == ["a", "b"]
            assert found("angstrom naive") == ["a"] and found("ελλας") == ["c"] and found("елка") == ["c"]
            assert found("strasse") == [] and found("øre") == ["d"] and found("ore") == []
    words = "Crème BRÛLÉE ŵ ő Ǻ"
    assert spark.createDataFrame([(words,)], "t string").select(text.folded_tokens(F.col("t"))).first()[0] == text.tokenize(words)


# Links


class Vault:
    """Notes on disk, passes over some of them, and a comparison of the links kept with those of a pass over everything."""

    def __init__(self, spark, folder):
        self.spark, self.root = spark, str(folder / "v")
        os.makedirs(self.root)
        self.catalog = incremental.Catalog(spark, str(folder / "index"), parts=16)

    def put(self, name, body="", **metadata):
        vault.replace_note(self.root, name, metadata, body) if os.path.exists(os.path.join(self.root, name)) else vault.create_note(self.root, name, metadata, body)

    def notes(self, scopes=None):
        return vault.load_notes(vault.inventory(vault.read_vault(self.spark, self.root, settings=vault.Settings(), subtrees=scopes)))

    def sync(self, *names):
        before = self.catalog._pointer()["tables"].get("edges", {"parts": {}})["parts"]
        counts = incremental.reindex(self.catalog, self.notes(list(names) or None), list(names) or None)
        edges = self.catalog.table("edges").select("source_id", "raw", "target_id", "reason")
        every = links.edges_of(self.notes()).select(edges.columns)
        got = {(r.source_id, r.raw): (r.target_id, r.reason) for r in edges.collect()}
        assert got == {(r.source_id, r.raw): (r.target_id, r.reason) for r in every.collect()} and edges.count() == len(got)
        keys = self.catalog.table("targets").select("kind", "target_key", "note_id")
        assert sorted(map(tuple, keys.collect())) == sorted(map(tuple, links.target_keys(self.notes()).collect()))
        after = self.catalog._pointer()["tables"]["edges"]["parts"]
        self.rewritten = {int(p) for p in {*before, *after} if before.get(p) != after.get(p)}
        return counts, got


def test_links_follow_ids_titles_and_aliases(spark, tmp_path):
    v = Vault(spark, tmp_path)
    for k in range(20):
        v.put(f"other/{k}.md", f"[[elsewhere {k}]] [[other/{k + 1}.md]]")
    v.put("Source.md", "[[Later]] [[the name]] [[Twin]] [[sub\\Deep.md]] [[./sub//deep]] [[Old Title|x]]")
    counts, got = v.sync()
    assert counts == {"add": 21} and got["Source", "Later"] == (None, "unresolved")
    # Notes that come: by an id in another case, by a path; by an alias, which of several claimed by two leads nowhere.
    v.put("later.md", "")
    v.put("sub/Deep.md", "", title="Old Title", aliases=["the name", "Twin"])
    v.put("second.md", "", aliases=["twin"])
    _, got = v.sync("later.md", "sub", "second.md")
    assert got["Source", "Later"] == ("later", "direct") and got["Source", "sub\\Deep.md"] == ("sub/Deep", "direct") == got["Source", "./sub//deep"]
    assert got["Source", "Old Title|x"] == ("sub/Deep", "title") and got["Source", "the name"] == ("sub/Deep", "alias") and got["Source", "Twin"] == (None, "unresolved")
    # One gives the alias up, and it leads to the other; the parts of other keys stay.
    v.put("sub/Deep.md", "", title="New Title", aliases=["the name"])
    _, got = v.sync("sub/Deep.md")
    assert got["Source", "Twin"] == ("second", "alias") and got["Source", "Old Title|x"] == (None, "unresolved") and len(v.rewritten) <= 3
    # A title is stronger than an alias, an id than both.
    v.put("third.md", "", title="Twin")
    assert v.sync("third.md")[1]["Source", "Twin"] == ("third", "title") and len(v.rewritten) <= 2
    v.put("Twin.md", "")
    assert v.sync("Twin.md")[1]["Source", "Twin"] == ("Twin", "direct") and len(v.rewritten) <= 1
    # What links and leads goes; a text without other keys touches its own links alone.
    vault.delete_note(v.root, "Twin.md")
    vault.delete_note(v.root, "later.md")
    vault.delete_note(v.root, "other/3.md")
    v.put("other/7.md", "[[elsewhere 7]] more")
    counts, got = v.sync("Twin.md", "later.md", "other")
    assert counts == {"remove": 3, "update": 1} and got["Source", "Twin"] == ("third", "title") and got["Source", "Later"] == (None, "unresolved") and got["other/2", "other/3.md"] == (None, "unresolved")


# Versions


def test_one_of_several_writers_makes_a_version(spark, tmp_path):
    c = incremental.Catalog(spark, str(tmp_path / "c"))
    t = spark.createDataFrame([("a", 1)], "note_id string, n int")
    c.commit({"t": t})
    first, second = c._pointer() | {"version": 2, "notes": {"by": 1}}, c._pointer() | {"version": 2, "notes": {"by": 2}}
    c._publish(first)
    with pytest.raises(incremental.Conflict):
        c._publish(second)
    assert c.note("by") == 1 and [f for f in os.listdir(c.path) if "version" in f] == ["version-000000000001.json", "version-000000000002.json"] or len(c._versions()) == 2
    # What a commit that lost has written goes at once; what one that died has written goes by its age.
    real = c._publish
    c._publish = lambda current: (_ for _ in ()).throw(incremental.Conflict("late"))
    before = set(os.listdir(c.path))
    with pytest.raises(incremental.Conflict):
        c.commit({"t": t})
    assert set(os.listdir(c.path)) == before
    c._publish = real
    stray = os.path.join(c.path, f"t-{uuid.uuid4().hex}")
    os.makedirs(stray)
    assert c.vacuum() == 0 and c.vacuum(age_ms=-1) == 1 and not os.path.exists(stray) and c.table("t").count() == 1


WRITER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from noteql.streaming import incremental
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").config("spark.driver.memory", "1g").getOrCreate()
c = incremental.Catalog(spark, {path!r}, parts=1)
done = 0
while done < 4:
    version, table = c.version, c.table("t")
    row = spark.createDataFrame([({name!r} + str(done), done)], "note_id string, n int")
    try:
        c.commit({{"t": row if table is None else table.unionByName(row)}}, based_on=version)
        done += 1
    except incremental.Conflict:
        pass
"""


def test_writers_in_two_processes_lose_nothing(spark, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = [WRITER.format(root=root, path=str(tmp_path / "c"), name=n) for n in "ab"]
    running = [subprocess.Popen([sys.executable, "-c", x], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) for x in code]
    assert [p.wait(timeout=240) for p in running] == [0, 0]
    c = incremental.Catalog(spark, str(tmp_path / "c"))
    assert sorted(r.note_id for r in c.table("t").collect()) == sorted(f"{n}{k}" for n in "ab" for k in range(4)) and c.version == 8


# Batches


def test_batches_count_once_and_failed_ones_are_tried_again(spark, tmp_path):
    c = incremental.Catalog(spark, str(tmp_path / "c"))
    handled: list[list[str]] = []

    def handle(paths):
        if "bad.md" in paths and len(handled) < 2:
            handled.append(["failed", *paths])
            raise OSError("no such disk")
        handled.append(paths)

    run = lambda n, *paths: incremental.run_batch(c, handle, str(tmp_path / "ck"), n, list(paths))
    assert run(0, "a.md") and not run(0, "a.md") and handled == [["a.md"]]
    assert not run(1, "bad.md", "b.md")
    assert [(r.relative_path, r.error, r.tries) for r in c.table("failed").orderBy("relative_path").collect()] == [("b.md", "OSError: no such disk", 1), ("bad.md", "OSError: no such disk", 1)]
    # A stream that starts again repeats its last batch: it is in the index already.
    assert not run(1, "bad.md", "b.md") and len(handled) == 2
    assert run(2, "c.md") and handled[-1] == ["b.md", "bad.md", "c.md"] and c.table("failed").isEmpty()
    # Killed between the work and the mark: the work is done again, as it would have been had it not been done.
    killed = lambda paths: (_ for _ in ()).throw(KeyboardInterrupt())
    with pytest.raises(KeyboardInterrupt):
        incremental.run_batch(c, killed, str(tmp_path / "ck"), 3, ["d.md"])
    assert run(3, "d.md") and handled[-1] == ["d.md"] and not run(3, "d.md")


# Evidence


def test_mentions_are_found_in_the_index_alone(spark, tmp_path):
    """The evidence of an index is that of the texts: glued words, marks, other cases, quotes in metadata."""
    from noteql.functions import extract
    from noteql.operators import context

    texts = ["éweb.click", "web.clické too", "symmetric:e1.", "metric:e2", "Web-Click!", "web click", "wéb click", "web click", "webs clicking", "all of WEB.Click", "x.web.click", "the fit log", "fit́ log", "other", "u1 says", "nothing"]
    rows = [(f"n{i:02}", None if i % 3 else f"T {i}", t, f"n{i:02}.md") for i, t in enumerate(texts)] + [("2024-05-01", None, "a day", "d.md"), ("AGENTS", None, "web.click", "AGENTS.md")]
    notes = spark.createDataFrame(rows, "note_id string, title string, content string, relative_path string").withColumn("metadata_json", F.when(F.col("note_id") == "n13", F.lit('{"ref":"metric:e3","k":"web.click"}')).otherwise(F.lit("{}")))
    notes = notes.withColumn("file_modified_at", F.lit("2024-05-02 00:00:00").cast("timestamp")).withColumn("created_at", F.col("file_modified_at"))
    c = incremental.Catalog(spark, str(tmp_path / "k"), parts=3)
    postings, lengths = fts.build(notes, extract.content_document(F.col("note_id"), F.col("title"), F.col("content")), F.lit(""), True, context.said(notes, True))
    terms, corpus = fts.summaries(postings, lengths, c.part("note_id"))
    c.commit({"notes": notes, "postings": postings, "lengths": lengths, "terms": terms, "corpus": corpus})
    records = spark.createDataFrame([(f"e{i}", "web.click", f"2024-05-0{i}T00:00:00Z", "u1") for i in range(1, 4)], "id string, key string, ts string, source string").selectExpr("*", "to_date(ts) date", "timestamp(ts) ts_utc", "'f' source_file", "1 source_line", "1.0D value", "cast(null as string) unit")
    plain = context.Knowledge(notes, records, None)
    kept = context.Knowledge(c.table("notes"), records, None, index=incremental.kept_index(c))
    for found in (lambda k: context.notes_for_metric(k, records, 99), lambda k: context.notes_for_source(k, "u1", records, 99), lambda k: context.notes_for_source(k, "fit", records.withColumn("key", F.lit("no.key")), 99)):
        rows_ = lambda k: sorted(map(str, found(k).select("note_id", "kind", "reason", "confidence").collect()))  # noqa: B023, E731
        assert rows_(kept) == rows_(plain) and len(rows_(plain)) > 1
    assert len(context.notes_for_metric(plain, records, 99).collect()) > 4


def test_evidence_of_tables_writes_no_copy_of_the_texts(spark):
    """A question asked once of a table builds no index of it: nothing but Spark's own shuffles goes to disk."""
    import __spark_entry__
    from noteql import scratch

    shared = Path(scratch.shared_folder(spark).removeprefix("file://"))
    there = lambda: {str(p) for p in shared.rglob("*.parquet")}
    before = there()
    for name in ("context_metric_notes", "context_metric_notes_inferred", "context_source_notes"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
        assert there() == before, name
