"""The change stream: differences, what is told of them, batches, restarts, and what is lost."""

import os
import shutil

import pytest
from noteql import scratch
from noteql.streaming import changes, incremental


def put(root, path, text="x"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def frame(spark, *rows):
    return spark.createDataFrame([(p, n, None) for p, n in rows], "relative_path string, size long, file_modified_at timestamp")


def pairs(df):
    return {r.relative_path: r.change for r in df.collect()}


def test_differences(spark):
    old, now = frame(spark, ("a", 1), ("b", 1), ("c", 1)), frame(spark, ("a", 1), ("b", 2), ("d", 1))
    assert pairs(changes.differences(old, now)) == {"b": "changed", "c": "removed", "d": "added"}
    assert pairs(changes.differences(None, now)) == dict.fromkeys("abd", "added")
    assert pairs(changes.differences(now, now)) == {} and pairs(changes.differences(old, frame(spark).limit(0))) == dict.fromkeys("abc", "removed")


def test_what_is_told_is_bounded_and_leaves_nothing_out(spark):
    paths = [f"a/b{i}/c{j}.md" for i in range(3) for j in range(4)] + ["top.md", "a/x.md"]
    every = spark.createDataFrame([(p, "changed") for p in paths], "relative_path string, change string")
    for limit in (0, 1, 2, 3, 5, 13, 14, 99):
        got = {r.relative_path: (r.change, r.files) for r in changes.told(every, limit).collect()}
        assert len(got) <= max(1, limit) and sum(n for _, n in got.values()) == len(paths)
        assert all(any(s in ("", p) or p.startswith(s + "/") for s in got) for p in paths)
        assert set(changes.fold(paths, limit).values()) == set(got)
    assert {r.relative_path: r.change for r in changes.told(every, 5).collect()} == {"a/b0": "reconcile", "a/b1": "reconcile", "a/b2": "reconcile", "a/x.md": "changed", "top.md": "changed"}
    assert pairs(changes.told(every, 1)) == {"": "reconcile"} and pairs(changes.told(every.limit(0))) == {}
    assert changes.fold(["", "a/b"]) == {"": "", "a/b": ""} and changes.fold(["a", "a/b", "ab"]) == {"a": "a", "a/b": "a", "ab": "ab"} and changes.fold([]) == {}
    # A file that became a folder.
    both = spark.createDataFrame([("a", "removed"), ("a/b", "added"), ("a/c", "added")], "relative_path string, change string")
    assert pairs(changes.told(both, 2)) == {"a": "reconcile"}


@pytest.fixture
def watched(spark, tmp_path):
    root, handled = str(tmp_path / "root"), []
    for p in ("a.md", "sub/b.md", "sub/deep/c.md", ".hidden/d.md"):
        put(root, p)
    c = incremental.Catalog(spark, f"file://{tmp_path}/c", parts=3)
    return root, handled, c, lambda n, handle=handled.append, limit=99: incremental.look(c, root, handle, f"file://{tmp_path}/ck", n, limit)


def test_batches_rest_on_the_last_that_counted(spark, watched):
    root, handled, c, look = watched
    assert look(0) and handled == [["a.md", "sub/b.md", "sub/deep/c.md"]] and not look(0) and not look(1)
    version = c.version
    assert not look(2) and c.version == version, "nothing changed, nothing is written"
    os.rename(os.path.join(root, "a.md"), os.path.join(root, "z.md"))
    put(root, "sub/b.md", "longer")
    shutil.rmtree(os.path.join(root, "sub/deep"))

    def killed(paths):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        look(3, killed)
    assert look(3) and handled[1:] == [["a.md", "sub/b.md", "sub/deep/c.md", "z.md"]] and not look(3)
    assert {r.relative_path for r in c.table("seen").collect()} == {"z.md", "sub/b.md"}
    for i in range(5):
        put(root, f"many/{i}/n.md")
    assert look(4, limit=2) and handled[-1] == ["many"], "one folder stands for its files"
    shutil.rmtree(root)
    assert look(5) and len(handled[-1]) == 7 and c.table("seen").isEmpty()


def test_failed_batches_and_lost_listings_are_reconciled(spark, watched, monkeypatch):
    root, handled, c, look = watched

    def bad(paths):
        raise OSError("no such disk")

    assert not look(0, bad) and c.table("failed").count() == 3 and c.table("seen").count() == 3
    put(root, "new.md")
    whole = changes.snapshot
    monkeypatch.setattr(changes, "snapshot", lambda *a: bad(a))
    assert not look(1) and handled == [], "what cannot be listed is not taken for empty"
    issues = {r.relative_path: (r.error, r.tries) for r in c.table("failed").collect()}
    assert issues.pop("") == ("OSError: no such disk", 1) and set(issues) == {"a.md", "sub/b.md", "sub/deep/c.md"} and c.table("seen").count() == 3
    monkeypatch.setattr(changes, "snapshot", whole)
    assert look(2) and handled == [[""]] and c.table("failed").isEmpty()
    for folder in os.listdir(c.path[7:]):
        if folder.startswith("seen-"):
            shutil.rmtree(os.path.join(c.path[7:], folder))
    os.remove(os.path.join(root, "a.md"))
    assert look(3) and handled[-1] == [""] and c.table("seen").count() == 3
    assert not look(4)


def test_more_failed_paths_than_may_be_told_become_folders(spark, tmp_path):
    c, seen = incremental.Catalog(spark, str(tmp_path / "c")), []

    def bad(paths):
        raise OSError("no")

    for n in range(4):
        assert not incremental.run_batch(c, bad, str(tmp_path / "ck"), n, [f"d/{n}{k}.md" for k in range(2)], limit=5)
    assert [(r.relative_path, r.tries) for r in c.table("failed").collect()] == [("d", 4)]
    assert incremental.run_batch(c, seen.append, str(tmp_path / "ck"), 4, ["e.md"], limit=5) and seen == [["d", "e.md"]]


def test_a_stream_goes_on_from_its_checkpoint_and_leaves_no_tables(spark, tmp_path):
    """Stopped and started again, on a folder named by a URL: what changed meanwhile is told, and nothing else."""
    root, handled = str(tmp_path / "root"), []
    put(root, "a.md")
    put(root, "sub/b.md")

    def once():
        query = incremental.watch(spark, f"file://{root}", handled.append, f"file://{tmp_path}/ck", {"availableNow": True})
        assert query.awaitTermination(120) and query.exception() is None

    shared = scratch.shared_folder(spark)[7:]
    before = set(os.listdir(shared))
    once()
    assert handled == [["a.md", "sub/b.md"]]
    os.remove(os.path.join(root, "a.md"))
    put(root, "sub/c.md")
    once()
    assert handled[1:] == [["a.md", "sub/c.md"]]
    once()
    assert len(handled) == 2 and set(os.listdir(shared)) == before


def test_scope_deletes_its_own_tables_alone(spark):
    kept = scratch.stored(spark.range(3))
    with scratch.scope(spark):
        gone = scratch.stored(spark.range(4))
        assert gone.count() == 4
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        gone.count()
