import os
import threading
import time

import pytest
from noteql import scratch
from noteql.functions import extract
from noteql.operators import fts, links, metrics, mutations
from noteql.sources import files, vault
from noteql.streaming import incremental
from pyspark.sql import functions as F

FILES = {
    "Hub.md": "---\ntitle: Project Hub\ntags: [a, b]\nwhen: 2024-01-15\nn: 012\nok: yes\n---\n[[sub/Note]] [[missing]] #c\n",
    "sub/Note.md": "no frontmatter\n",
    ".hidden.md": "kept",
    "B.MD": "upper",
    "_x.md": "kept too",
    "Empty.md": "---\n---\nbody",
    "Bad.md": "---\n: [\n---\nbody",
    ".dir/no.md": "x",
    "attachments/no.md": "x",
    "Templates/no.md": "x",
    "note.txt": "x",
    "metrics/a.ndjson": '{"id": "1"}\n\n{"id": "2"}\n',
}


@pytest.fixture
def root(tmp_path):
    for path, body in FILES.items():
        full = tmp_path / "v" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_text(body)
    return str(tmp_path / "v")


def loaded(spark, root, **kw):
    return vault.load_notes(vault.inventory(vault.read_vault(spark, root, settings=vault.Settings(ignored=["Templates"]), **kw)))


def test_inventory_and_loading(spark, root):
    n = {r.note_id: r for r in loaded(spark, root).collect()}
    assert set(n) == {"Hub", "sub/Note", ".hidden", "B", "_x", "Empty", "Bad"}
    assert n["Hub"].title == "Project Hub" and n["Hub"].tags == ["a", "b", "c"] and '"2024-01-15"' in n["Hub"].metadata_json
    assert n["Empty"].content.startswith("---") and n["Bad"].content.startswith("---") and n["Bad"].metadata_json == "{}"
    assert {r.key for r in vault.metadata_dates(loaded(spark, root)).collect()} == {"when"}
    assert {r.note_id for r in loaded(spark, root, subtrees=["sub", "sub/Note.md"]).collect()} == {"sub/Note"}
    assert vault.read_vault(spark, root, "metrics").count() == 1
    assert vault.scopes(["a/b", "a", "c/d", "c/d/e"]) == ["a", "c/d"]


def snapshot(catalog):
    notes = sorted((r.note_id, r.fingerprint) for r in catalog.table("notes").collect())
    edges = sorted((r.source_id, r.raw, str(r.target_id), r.reason) for r in catalog.table("edges").collect())
    return notes, edges


def test_incremental_passes_equal_a_full_one(spark, root, tmp_path):
    step = incremental.Catalog(spark, str(tmp_path / "step"))
    assert incremental.reindex(step, loaded(spark, root)) == {"add": 7}
    assert incremental.reindex(step, loaded(spark, root)) == {}
    vault.create_note(root, "missing.md", {}, "here now")
    vault.delete_note(root, "sub/Note.md")
    time.sleep(0.01)
    vault.replace_note(root, "B.MD", {"k": 1}, "[[Project Hub]]")
    assert not os.path.exists(os.path.join(root, "sub"))
    got = incremental.reindex(step, loaded(spark, root), scopes=["missing.md", "sub", "B.MD"])
    assert got == {"add": 1, "remove": 1, "update": 1}
    full = incremental.Catalog(spark, str(tmp_path / "full"))
    incremental.reindex(full, loaded(spark, root))
    assert snapshot(step) == snapshot(full)
    assert ("B", "Project Hub", "Hub", "title") in snapshot(step)[1]


def test_removal_and_models(spark):
    n = spark.createDataFrame([("a", None, None, "[[b]]"), ("b", None, None, "")], "note_id string, title string, aliases array<string>, content string")
    v = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "note_id string, vector array<float>")
    i, e, w = incremental.remove_note(n, links.edges_of(n), v, "b")
    assert i.count() == 1 and w.count() == 1 and (e.first().target_id, e.first().reason) == (None, "unresolved")
    assert incremental.model_changed(None, {}) and not incremental.model_changed({"dimension": 3}, {"dimension": 3})


def test_stream_sees_edits_deletions_and_renames(spark, root, tmp_path):
    seen: list[set] = []
    stream = incremental.watch(spark, root, lambda paths: seen.append(set(paths)), str(tmp_path / "ck"), {"processingTime": "200 milliseconds"})

    def until(test):
        end = time.time() + 60
        while not test() and time.time() < end:
            time.sleep(0.2)
        assert test()

    try:
        until(lambda: any("Hub.md" in s for s in seen))
        os.rename(os.path.join(root, "_x.md"), os.path.join(root, "y.md"))
        os.remove(os.path.join(root, "B.MD"))
        until(lambda: {"_x.md", "y.md", "B.MD"} <= set().union(*seen[1:]))
    finally:
        stream.stop()


def test_workspace(spark, root):
    from datetime import date

    from noteql.api import Workspace
    from noteql.functions.dates import QueryError

    w = Workspace(spark, root, settings=vault.Settings(ignored=["Templates"]))
    assert w.reindex() == {"add": 7} and w.reindex() == {}
    assert [r.note_id for r in w.call("search", query="frontmatter").collect()] == ["sub/Note"]
    assert [r.note_id for r in w.search("tags:a").collect()] == ["Hub"]
    assert w.search("kept", mode="hybrid").count() >= 1 and w.search("kept", mode="semantic").count() >= 1
    assert [r.source_id for r in w.backlinks("sub/note").collect()] == ["Hub"] and w.resolve("project hub") == "Hub"
    assert {r.raw for r in w.unresolved().collect()} == {"missing"} and "Hub" not in {r.note_id for r in w.orphans().collect()}
    assert w.create_note("missing.md", {}, "x") == {"add": 1} and w.unresolved().isEmpty()
    assert w.stats().first().total_notes == 8 and w.conventions()["naming"].count() > 0
    w.metrics_create("metrics/a.ndjson", {"id": "9", "ts": "2024-04-01T01:00:00Z", "key": "body.weight", "value": 1.5, "source": "s"})
    w.metrics_update("9", {"note": "n"})
    assert [r.id for r in w.metrics_search("key:body.weight").collect()] == ["9"] and w.metrics_read("metric:9").first().note == "n"
    assert [r.id for r in w.context_metric("metric:9")["records"].collect()] == ["9"]
    assert w.context_day(date(2024, 4, 1))["metrics"].count() == 1 and w.context_note("Hub")["related"].count() >= 1
    w.metrics_delete("9")
    assert w.metrics_search().isEmpty() and w.metrics_files().first().row_count == 2
    with pytest.raises(QueryError):
        w.call("_table")


def test_commits_write_the_parts_that_changed(spark, root, tmp_path):
    c = incremental.Catalog(spark, str(tmp_path / "c"), parts=8)
    incremental.reindex(c, loaded(spark, root))
    before = c._pointer()["tables"]
    vault.replace_note(root, "Hub.md", {"title": "Project Hub", "tags": ["a"], "aliases": ["HQ"]}, "[[sub/note]] fresh words")
    assert incremental.reindex(c, loaded(spark, root), scopes=["Hub.md"]) == {"update": 1}
    after = c._pointer()["tables"]
    for name in ("notes", "postings", "lengths"):
        changed = [p for p in after[name]["parts"] if after[name]["parts"][p] != before[name]["parts"].get(p)]
        assert len(changed) == 1 and c.table(name).count() == incremental.Catalog(spark, c.path).table(name).count()
    kept = incremental.kept_index(c)
    assert [r.note_id for r in fts.search(kept, '"fresh words"').collect()] == ["Hub"]
    text = fts.index_text(c.table("notes"), extract.content_document(F.col("note_id"), F.col("title"), F.col("content")), extract.metadata_document(F.col("metadata_json")), stem=True)
    for query in ("note", "fresh OR note", "kept NOT fresh", "NOT fresh", "content:words", '"fresh words" OR tags:a'):
        a, b = fts.search(kept, query, 9), fts.search(text, query, 9, stem=True)
        rounded = lambda df: [(r.note_id, round(r.rank, 9)) for r in df.collect()]
        assert rounded(a) == rounded(b)
        assert {r.note_id for r in fts.matching_ids(kept, query).collect()} == {r.note_id for r in fts.matching_ids(text, query, stem=True).collect()}
    with pytest.raises(incremental.Conflict):
        c.commit({"lengths": c.table("lengths")}, based_on=c.version - 1)


def test_old_versions_go(spark, tmp_path):
    c = incremental.Catalog(spark, str(tmp_path / "c"))
    for k in range(7):
        c.commit({"t": spark.createDataFrame([(str(k), k)], "note_id string, n int")})
    assert c.version == 7 and c.table("t").first().n == 6
    folders = [f for f in os.listdir(c.path) if f.startswith("t-")]
    assert len(folders) == incremental.KEPT_VERSIONS and len(c._versions()) == incremental.KEPT_VERSIONS


def test_metric_logs_are_kept_in_the_index(spark, root, tmp_path):
    """A log is parsed again when its text changes, whatever its time says."""
    c = incremental.Catalog(spark, str(tmp_path / "c"))
    pass_ = lambda: incremental.reindex_metrics(c, vault.list_vault(spark, root, "metrics"), root, size=50)
    first = pass_()
    assert first["add"] >= 1 and pass_() == {}
    path = os.path.join(root, "metrics/a.ndjson")
    stat, before = os.stat(path), c.table("metric_rows").where("source_file = 'metrics/a.ndjson'").count()
    with open(path, "a") as f:
        f.write('{"id":"77","ts":"2024-04-01T01:00:00Z","key":"body.weight","value":1.5,"source":"s"}\n')
    os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert pass_() == {"update": 1}
    assert c.table("metric_rows").where("source_file = 'metrics/a.ndjson'").count() == before + 1
    kept, made = c.table("metric_days"), metrics.rollups(metrics.records(c.table("metric_rows")), ["key"])
    assert sorted(map(str, metrics.rollups_of_parts(kept, ["key"]).select(made.columns).collect())) == sorted(map(str, made.collect())) and not kept.isEmpty()
    assert [r.id for r in metrics.search(metrics.records(c.table("metric_rows")), "key:Body.Weight date:2024-04-01", 5).collect()] == ["77"]
    os.remove(path)
    assert pass_()["remove"] == 1 and c.table("metric_days").isEmpty() and c.table("metric_rows").where("source_file = 'metrics/a.ndjson'").isEmpty()


def test_metric_fingerprint(spark):
    import hashlib
    import struct

    for raw in ("a\n\nb\r\n \t\nc", "", "\n", "é\n"):
        lines = [(k, x) for k, x in enumerate(raw.replace("\r\n", "\n").split("\n"), 1) if x.strip()]
        want = hashlib.sha256(b"".join(struct.pack("<Q", k) + x.encode() + b"\n" for k, x in lines)).hexdigest()
        assert spark.createDataFrame([(raw,)], "r string").select(metrics.fingerprint(F.col("r"))).first()[0] == want


def test_concurrent_creates_keep_every_record_and_blank_lines_stay(spark, root):
    from threading import Thread

    from noteql.api import Workspace

    path = os.path.join(root, "metrics/a.ndjson")
    with open(path, "a") as f:
        f.write("\n\n")
    w = Workspace(spark, root, settings=vault.Settings(ignored=["Templates"]))
    w.reindex()
    have = w.metrics_files().where("source_file = 'metrics/a.ndjson'").first().row_count
    record = lambda k: {"id": f"c{k}", "ts": "2024-04-01T01:00:00Z", "key": "body.weight", "value": k, "source": "s"}
    threads = [Thread(target=w.metrics_create, args=("metrics/a.ndjson", record(k))) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.id for r in w.records.where("id like 'c%'").collect()} == {"c0", "c1"}
    assert w.metrics_files().where("source_file = 'metrics/a.ndjson'").first().row_count == have + 2
    with open(path) as f:
        assert "\n\n\n" in f.read()
    w.metrics_rename_file("metrics/a.ndjson", "metrics/b.ndjson")
    assert {r.source_file for r in w.records.where("id = 'c1'").collect()} == {"metrics/b.ndjson"}
    with pytest.raises(FileExistsError):
        w.metrics_create_file("metrics/b.ndjson")
    w.metrics_delete_file("metrics/b.ndjson")
    assert w.records.where("id = 'c1'").isEmpty()


def test_edits_of_log_files(tmp_path):
    path = str(tmp_path / "x.ndjson")
    with open(path, "w") as f:
        f.write("a\n\nb\nc")
    assert mutations.edit_file(path, {3: "B", 1: None}, ["d"]) == 3
    with open(path) as f:
        assert f.read() == "\nB\nc\nd\n"
    assert mutations.edit_file(path, {2: None, 3: None, 4: None}) == 0 and not os.path.exists(path)


def test_progress():
    from noteql.streaming.progress import FRAMES, Progress

    now, seen = [0.0], []
    p = Progress(listeners=[seen.append], clock=lambda: now[0])
    sent = []
    for at in (0.0, 0.1, 0.4, 0.6, 0.7):
        now[0] = at
        sent.append(p("notes", "running", {"add": at}))
    assert sent == [True, False, False, True, False] and p("notes", "done") and len(seen) == 3
    assert p.status["notes"]["state"] == "done"
    for k in range(FRAMES + 5):
        p(f"x{k}", "done")
    assert len(p.frames) == FRAMES


def test_readers_of_progress():
    """A fast reader gets every frame; a slow one the present state of all phases, and what follows."""
    from noteql.streaming.progress import Progress

    p = Progress()
    p("notes", "done", {"add": 1})
    fast, slow = p.reader(), p.reader(size=3)
    got = []
    thread = threading.Thread(target=lambda: got.extend(fast))
    thread.start()
    for k in range(20):
        p(f"step{k % 2}", "done", {"n": k})
    p.leave(fast)
    thread.join(30)
    assert [f["counts"] for f in got] == [{"add": 1}] + [{"n": k} for k in range(20)]
    lagged = slow.get(0)
    assert (lagged["state"], lagged["counts"]) == ("lagged", {"missed": 21})
    assert {k: f["counts"] for k, f in lagged["status"].items()} == {"notes": {"add": 1}, "step0": {"n": 18}, "step1": {"n": 19}}
    assert slow.get(0) is None
    p("step0", "failed")
    assert slow.get(0)["state"] == "failed" and slow.get(0.01) is None
    p.leave(slow)
    p("step0", "done")
    assert slow.get() is None and list(slow) == []


def test_frames_of_a_running_pass(spark, root, tmp_path):
    from noteql.api import Workspace
    from noteql.streaming.progress import Progress

    p = Progress()
    reader = p.reader()
    query = Workspace(spark, root, settings=vault.Settings(ignored=["Templates"])).watch(str(tmp_path / "ck"), {"availableNow": True}, p)
    frames = []
    try:
        assert query.awaitTermination(180) and query.exception() is None
        while (frame := reader.get(30)) is not None:
            frames.append((frame["phase"], frame["state"]))
            if frames[-1] == ("watch", "done"):
                break
    finally:
        spark.streams.removeListener(query.listener)
    phases = [f for f in frames if f[0] != "watch"]
    assert phases == [("notes", "running"), ("notes", "done"), ("metrics", "done"), ("vectors", "running"), ("vectors", "done")]
    assert frames.index(("watch", "running")) < frames.index(("watch", "done")) == len(frames) - 1
    assert p.status["notes"]["counts"] == {"add": 7} and p.status["watch"]["state"] == "done"


def test_settings_of_the_editor(root):
    import json

    os.makedirs(os.path.join(root, ".obsidian"), exist_ok=True)
    with open(os.path.join(root, ".obsidian", "app.json"), "w") as f:
        json.dump({"attachmentFolderPath": "Files", "userIgnoreFilters": ["Old/"]}, f)
    with open(os.path.join(root, "noteql.toml"), "w") as f:
        f.write('attachments = "Other"\nignored = ["Mine"]\nmetrics_root = "logs"\n')
    s = vault.load_settings(root)
    assert (s.attachments, s.ignored, s.metrics_root) == ("Files", ["Old", "Mine"], "logs")


def test_conventions_of_metric_logs(tmp_path):
    """The plugin's settings come before the workspace's, as a whole; names, kinds and values that do not fit are skipped."""
    import json

    root, plugin = str(tmp_path), tmp_path / ".obsidian/plugins/metrics-lens/data.json"
    plugin.parent.mkdir(parents=True)
    default = vault.load_settings(root).metrics
    assert (default.source, default.root, default.write_file, default.reference_prefix, default.week_start, default.day_start_hour) == ("default", "metrics", "metrics/All.ndjson", "metric:", "monday", 0)
    (tmp_path / "noteql.toml").write_text('[metrics]\nroot = "Work"\nday_start_hour = 24\nextensions = ["a", ".A", " "]\n')
    own = vault.load_settings(root)
    assert (own.metrics.source, own.metrics_root, own.metrics_suffix, own.metrics.day_start_hour) == ("workspace", "Work", (".a",), 0)
    plugin.write_text(json.dumps({"metricsRoot": "Plug", "supportedExtensions": [".plugin.ndjson", "LOG"], "defaultWriteFile": "Plug/In.plugin.ndjson", "recordReferencePrefix": "plugin-metric:", "weekStartsOn": 2, "dayStartHour": 6}))
    s = vault.load_settings(root)
    assert (s.metrics_root, s.metrics_suffix, s.metrics.write_file, s.metrics.reference_prefix, s.metrics.week_start, s.metrics.day_start_hour) == ("Plug", (".plugin.ndjson", ".log"), "Plug/In.plugin.ndjson", "plugin-metric:", "tuesday", 6)
    assert s.metrics.source == str(plugin) and files.Rules(s.metrics_suffix).wanted("Plug/x.Log") and not files.Rules(s.metrics_suffix).wanted("Plug/x.a")
    plugin.write_text(json.dumps({"metricsRoot": 5, "metrics": {"root": "Nested"}, "weekStart": 9, "calendar": {"weekStartDay": "Sunday", "dayStartHour": True}, "defaultFile": "../out"}))
    n = vault.load_settings(root).metrics
    assert (n.root, n.extensions, n.write_file, n.week_start, n.day_start_hour) == ("Nested", (".ndjson",), "Nested/All.ndjson", "sunday", 0)
    plugin.write_text("[]")
    assert vault.load_settings(root).metrics.root == "metrics", "it leaves everything out"
    plugin.write_text("{")
    assert vault.load_settings(root).metrics_root == "Work"


def test_scopes_are_walked_alone(spark, root, tmp_path):
    """Below scopes, in skipped folders too, the reader lists what a walk over everything would keep of them."""
    for name in ("a/b/c.md", "a/d.md", "a/d.MD", "Templates/x/y.md", "a/.h/z.md"):
        full = os.path.join(root, name)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(name)
    settings = vault.Settings(ignored=["Templates"])
    listed = lambda subtrees=None, kind="notes", where=root, **kw: sorted(r.relative_path for r in vault.list_vault(spark, where, kind, settings, subtrees, **kw).collect())

    every = listed()
    for scopes in (["a"], ["a/b", "Hub.md"], ["Templates"], ["Templates/x/y.md"], ["a/.h"], ["missing"], [""], ["a/d.md", "sub"], [".hidden.md"]):
        assert listed(scopes) == [p for p in every if any(s == "" or p == s or p.startswith(s + "/") for s in scopes)]
    once = listed(distinct=True)
    assert set(every) - set(once) == {"a/d.md"}
    found = vault.read_vault(spark, root, settings=settings)
    assert {r.relative_path for r in vault.inventory(found).collect()} == set(once)
    assert listed(["metrics"], "metrics") == listed(None, "metrics") == listed(["metrics/a.ndjson", "sub"], "metrics") == ["metrics/a.ndjson"]
    assert listed(where=f"file://{root}") == every


def test_a_deep_and_wide_tree_is_listed_in_steps(spark, root, monkeypatch):
    """Folders that one task leaves are dealt out again; links lead nowhere; nothing is walked on the driver."""
    want = set()
    for k in range(12):
        for name in (f"w/{k}/n.md", f"w/{k}/x/{k}.md", "w/" + "/".join("d" for _ in range(k + 1)) + f"/{k}.md"):
            full = os.path.join(root, name)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "w") as f:
                f.write(name)
            want.add(name)
    os.symlink(os.path.join(root, "sub"), os.path.join(root, "w/link"))
    os.symlink(os.path.join(root, "Hub.md"), os.path.join(root, "w/link.md"))
    rules = vault.rules(vault.Settings())
    one = files.listing(spark, root, rules, ["w"])
    walked = lambda *args: pytest.fail("the driver walks")
    steps = []
    monkeypatch.setattr(files, "stored", lambda df: steps.append(1) or scratch.stored(df))
    with monkeypatch.context() as m:
        m.setattr(os, "walk", walked)
        many = files.listing(spark, root, rules, ["w"], walk=2)
    rows = lambda df: sorted((r.relative_path, r.size, r.file_modified_at) for r in df.collect())
    assert {r[0] for r in rows(one)} == want and rows(many) == rows(one) and len(steps) > 3


@pytest.mark.parametrize("size", [1, 3, 7, 64, 1 << 20])
def test_lines_of_ranges_are_those_of_the_file(spark, tmp_path, size, monkeypatch):
    texts = {"a.ndjson": b'{"id":"1"}\r\n\r\n \t\n{"id":"2"}\n\xc3\xa9\r\nlast\r', "b.ndjson": b"", "c.ndjson": b"\n\n", "sub/_d.NDJSON": b"one", "e.ndjson": b"x\n" * 5 + b"y" * 40 + b"\n\r\nz\n", "no.txt": b"no"}
    for name, data in texts.items():
        full = tmp_path / "l" / name
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(data)
    want = []
    for name, data in texts.items():
        if name == "no.txt":
            continue
        lines = data.decode().split("\n")
        tail = lines.pop()
        lines = [x[:-1] if x.endswith("\r") else x for x in lines] + [tail]
        want += [(name, k, x) for k, x in enumerate(lines, 1) if x.strip()]
    root = f"file://{tmp_path}/l"
    listed = files.listing(spark, root, files.Rules(".ndjson"))
    ranges = files.log_ranges(listed, root, size)
    got = sorted(map(tuple, files.read_ranges(ranges, root).collect()))
    assert got == sorted(want)
    states = {r.source_file: r.fingerprint for r in files.log_states(ranges).collect()}
    assert len(states) == 5 and states == {r.source_file: r.fingerprint for r in files.log_states(files.log_ranges(listed, root, size)).collect()}
    (tmp_path / "l/c.ndjson").write_bytes(b" \n")
    again = {r.source_file: r.fingerprint for r in files.log_states(files.log_ranges(listed, root, size)).collect()}
    assert {k for k in states if states[k] != again[k]} == {"c.ndjson"}


def test_tags_and_aliases_of_metadata(spark):
    blocks = {"a": "tags: [x, [y, 'z w'], 3]\naliases: [A, ' ']", "b": "tags: one, two", "c": "tags: null", "d": "other: 1", "e": "tags: []\naliases: B"}
    rows = [(k, f"---\n{b}\n---\nbody", f"{k}.md", None, None) for k, b in blocks.items()]
    files = spark.createDataFrame(rows, "note_id string, raw string, relative_path string, file_modified_at timestamp, created_at timestamp")
    got = {r.note_id: (r.tags, r.aliases) for r in vault.load_notes(files).collect()}
    assert got == {"a": (["3", "w", "x", "y", "z"], ["A"]), "b": (["one", "two"], None), "c": ([], None), "d": ([], None), "e": ([], ["B"])}
