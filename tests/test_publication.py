"""Atomic publication: two writers, writers that die, retention, and a version check on merges."""

import threading

import pytest
from pyspark.sql import functions as F

from tideline.sources import publication, sinks
from tideline.sources.publication import Conflict, DuplicateRows, Releases, Table


def rows(spark, ids, v="x"):
    return spark.createDataFrame([(i, v) for i in ids], "id long, v string").coalesce(1)


def test_two_writers_never_double_a_key(spark, tmp_path):
    """Both read the same state; the second one to commit looks again."""
    new = rows(spark, range(10))
    tables = [Table(spark, f"{tmp_path}/t", new.schema) for _ in range(2)]
    meet = threading.Barrier(2)

    def write(table):
        seen = []

        def made(old):
            if not seen:
                seen.append(1)
                meet.wait(60)  # both have read the empty table now
            return new.join(old.select("id"), "id", "left_anti")

        table.change(made)

    threads = [threading.Thread(target=write, args=(t,)) for t in tables]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert tables[0].log.numbers() == [1, 2]
    assert sorted(r.id for r in tables[0].read().collect()) == list(range(10))
    assert tables[0].read(1).count() == 10
    # what the writer that lost had written is gone
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 2


def test_append_once_and_merge(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", rows(spark, []).schema)
    assert t.append_once(rows(spark, [1, 2])) == 1
    with pytest.raises(DuplicateRows):
        t.append_once(rows(spark, [2, 3]))
    with pytest.raises(DuplicateRows):
        t.append_once(rows(spark, [4, 4]))
    assert t.read().count() == 2 and t.log.number() == 1
    assert t.append_new(rows(spark, [2, 3, 3], "y")) == 2
    t.merge(rows(spark, [2], "z").union(rows(spark, [2, 9], "zz")), "id", F.length("v"))
    assert {r.id: r.v for r in t.read().collect()} == {1: "x", 2: "zz", 3: "y", 9: "zz"}
    assert {r.id: r.v for r in t.read(2).collect()} == {1: "x", 2: "x", 3: "y"}
    assert sinks.stored(spark, f"{tmp_path}/t", t.schema).count() == 4
    assert sinks.stored(spark, f"{tmp_path}/none", "id long, v string").count() == 0


def test_a_writer_that_dies_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    r = Releases(spark, f"{tmp_path}/r")
    r.publish(rows(spark, [1]), "a")

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(publication.Log, "commit", dies)
    with pytest.raises(OSError):
        r.publish(rows(spark, [1, 2]), "b")
    t = Table(spark, f"{tmp_path}/t", rows(spark, []).schema)
    with pytest.raises(OSError):
        t.append_new(rows(spark, [1]))
    monkeypatch.setattr(publication, "folder_digest", dies)
    with pytest.raises(OSError):
        r.publish(rows(spark, [1, 2, 3]), "c")
    monkeypatch.undo()
    assert r.state()["current"] == "a" and r.current().count() == 1 and t.read().count() == 0
    with pytest.raises(Conflict):  # the folder is there, though no event names it
        r.publish(rows(spark, [5]), "b")
    r.sweep()
    r.publish(rows(spark, [5, 6]), "b")
    assert r.state()["current"] == "b" and r.current().count() == 2
    assert sorted(p.name for p in (tmp_path / "r" / "versions").iterdir()) == ["a", "b"]


def test_digest_retention_and_champion(spark, tmp_path):
    r = Releases(spark, f"{tmp_path}/r")
    for k in range(5):
        r.publish(rows(spark, range(k + 1)), f"v{k}", {"metric": k})
    with pytest.raises(Conflict):
        r.publish(rows(spark, [7]), "v3")
    with pytest.raises(KeyError):
        r.promote("v9")
    r.promote("v1")
    state = r.state()
    assert (state["current"], state["champion"]) == ("v4", "v1") and state["versions"]["v2"]["rows"] == 3 and state["versions"]["v2"]["about"] == {"metric": 2}
    assert len(state["versions"]["v2"]["sha256"]) == 64 and r.intact("v2")
    assert r.retain(2) == ["v0", "v2"]
    assert list(r.state()["versions"]) == ["v1", "v3", "v4"] and sorted(p.name for p in (tmp_path / "r" / "versions").iterdir()) == ["v1", "v3", "v4"]
    assert r.retain(0) == ["v3"] and r.current().count() == 5  # the current one stays whatever is asked
    part = next((tmp_path / "r" / "versions" / "v4").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    (tmp_path / "r" / "versions" / "v4" / f".{part.name}.crc").unlink()
    assert not r.intact("v4") and r.intact("v1")
