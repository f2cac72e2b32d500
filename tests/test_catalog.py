"""Publishing with rollback, concurrent writers, version differences."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import catalog as K

ROWS = "x int, y string"


def put(spark, root, rows, **kw):
    return K.publish(spark.createDataFrame(rows, ROWS), root, "ds", "f.csv", "me", "Retail", 40.0, len(rows), **kw)


def live(spark, root):
    return sorted(tuple(r) for r in K.read_dataset(spark, root, "ds").select("x", "y").collect())


def state(spark, root):
    return {t: K.read_catalog(spark, root, t).count() for t in K.CATALOG_SCHEMAS}


@pytest.mark.parametrize("fails_in", ["data", "second append", "last append", "commit"])
def test_failed_publish_leaves_no_trace(spark, tmp_path, monkeypatch, fails_in):
    root = str(tmp_path)
    put(spark, root, [(1, "a"), (2, "b")])
    before, files = state(spark, root), sorted(p for p in tmp_path.rglob("*.parquet"))
    bad = spark.createDataFrame([(1, "t")], "insight_order int, text string").withColumn(
        "text", F.raise_error(F.lit("planned")).cast("string"))
    if fails_in == "data":
        fail = spark.createDataFrame([(3, "c")], ROWS).withColumn("y", F.raise_error(F.lit("planned")).cast("string"))
        with pytest.raises(Exception, match="planned"):
            K.publish(fail, root, "ds", "f.csv", "me", "Retail", 40.0, 1)
    elif fails_in == "last append":
        with pytest.raises(Exception, match="planned"):
            put(spark, root, [(3, "c")], metadata={"generated_insights": bad})
    else:
        real = K.Publish.rows

        def rows(self, table, what):
            if table == "upload_history":
                raise OSError("planned")
            real(self, table, what)

        if fails_in == "commit":
            monkeypatch.setattr(K, "_create_new", lambda *a: (_ for _ in ()).throw(OSError("planned")))
        else:
            monkeypatch.setattr(K.Publish, "rows", rows)
        with pytest.raises(OSError, match="planned"):
            put(spark, root, [(3, "c")])
        monkeypatch.undo()
    assert live(spark, root) == [(1, "a"), (2, "b")] and state(spark, root) == before
    assert sorted(p for p in tmp_path.rglob("*.parquet")) == files and K.orphans(spark, root) == []
    put(spark, root, [(3, "c")])
    assert live(spark, root) == [(3, "c")]
    assert [tuple(r) for r in K.read_dataset(spark, root, "ds", seq=1).orderBy("x").collect()] == [(1, "a"), (2, "b")]
    assert K.read_catalog(spark, root, "datasets").select("record_count").collect() == [(1,)]


def test_concurrent_writer_is_refused(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [(1, "a")])
    slow = K.Publish(spark, root, "ds")
    slow.data(spark.createDataFrame([(9, "slow")], ROWS))
    put(spark, root, [(2, "fast")])
    with pytest.raises(K.ConcurrentWriteError):
        with slow:
            slow.rows("audit_logs", [("me", "a", "t", "ds", "d", None)])
    assert live(spark, root) == [(2, "fast")] and K.orphans(spark, root) == []
    assert K.commits(spark, root).count() == 2


def test_orphans_of_a_dead_writer(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, [(1, "a")])
    dead = K.Publish(spark, root, "ds")
    dead.data(spark.createDataFrame([(5, "z")], ROWS))
    dead.rows("audit_logs", [("me", "a", "t", "ds", "d", None)])
    assert live(spark, root) == [(1, "a")] and K.read_catalog(spark, root, "audit_logs").count() == 1
    assert len(K.orphans(spark, root)) == 2 and len(K.remove_orphans(spark, root)) == 2
    assert K.orphans(spark, root) == [] and live(spark, root) == [(1, "a")]


def test_names_that_are_no_paths(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "a")], ROWS)
    K.write_dataset(df, root, "../up/ä b", "v/1")
    assert K.read_dataset(spark, root, "../up/ä b", "v/1").count() == 1
    assert {p.name for p in tmp_path.iterdir()} == {"datasets", "catalog"}
    with pytest.raises(LookupError):
        K.read_dataset(spark, root, "none")
    assert K.read_catalog(spark, root, "generated_kpis").count() == 0


def test_version_difference(spark):
    cols = "k int, v string, d double"
    nan = float("nan")
    old = [(1, "a", 1.0)] * 3 + [(2, "b", None), (3, None, nan), (None, "n", 0.0), (4, "gone", 1.0), (5, "old", 2.0)]
    new = [(1, "a", 1.0), (2, "b", None), (3, None, nan), (None, "n", 0.0), (None, "n", 0.0), (5, "new", 2.0), (6, "in", 1.0)]
    got = K.version_difference(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols), ["k"])
    assert sorted(((r["k"] or 0, r["v"], r["change"], r["copies"]) for r in got.collect())) == [
        (0, "n", "added", 1), (1, "a", "removed", 2), (4, "gone", "removed", 1), (5, "new", "changed_to", 1),
        (5, "old", "changed_from", 1), (6, "in", "added", 1)]
    same = spark.createDataFrame(old, cols)
    assert K.version_difference(same, same, ["k"]).collect() == []
