"""The id runs beside the event table: what an append reads, and what a failed one leaves."""

import pytest
from helpers import log
from pyspark.sql import functions as F

from eventloom.sources import files, id_index, store

DAY = "2026-06-11"


def stored(spark, path):
    return sorted(r._id for r in store.read_events(spark, path).collect())


def scanned(df):
    """Rows that came out of the file scans of a collected frame."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if "AdaptiveSparkPlan" in plan.nodeName():
            plan = plan.executedPlan()
        leaves = plan.collectLeaves()
        for leaf in (leaves.apply(i) for i in range(leaves.size())):
            if "QueryStage" in leaf.nodeName():
                plans.append(leaf.plan())
            elif "Scan parquet" in leaf.nodeName():
                total += leaf.metrics().apply("numOutputRows").value()
    return total


def big_day(spark, path, n, runs=3):
    ids = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 32).alias("_id"), F.lit(DAY).alias("event_date"))
    for i in range(runs):
        id_index._write(ids.filter(F.crc32("_id") % runs == i), f"{path}/in{i}")
        id_index._admit(spark, path, f"{path}/in{i}")
    return ids


def test_lookup_reads_follow_the_batch(spark, tmp_path):
    for n in (50_000, 500_000):
        path = str(tmp_path / str(n))
        ids = big_day(spark, path, n)
        there = [r._id for r in ids.limit(20).collect()]
        new = [f"{i:032x}" for i in range(20)]
        found = id_index.listed(spark, path, [DAY], there + new)
        assert sorted(r._id for r in found.collect()) == sorted(there)
        # a page of each of the three runs for an id, and one for all the new ids
        assert scanned(found) <= min(n, 21 * 3 * 2000)
        fresh = id_index.listed(spark, path, [DAY], [f"{i:030x}zz" for i in range(20)])
        assert not fresh.collect() and scanned(fresh) <= 2000


def test_lists_up_to_the_limit(spark, tmp_path):
    ids = big_day(spark, str(tmp_path), 5000)
    some = [r._id for r in ids.limit(id_index.LISTED - 1).collect()] + ["none"]
    assert id_index.listed(spark, str(tmp_path), [DAY], some).distinct().count() == id_index.LISTED - 1
    assert id_index.listed(spark, str(tmp_path), [DAY], []).isEmpty()


def test_runs_merge(spark, tmp_path):
    path = str(tmp_path / "events")
    for i in range(20):
        store.append_new(spark, path, log(spark, [dict(_id=f"{i:03d}"), dict(_id=f"{i - 1:03d}")]))
    assert len(stored(spark, path)) == 21
    assert len(files.listed(spark, f"{id_index.root(path)}/event_date={DAY}")) < id_index.FAN
    assert id_index.runs(spark, path, [DAY]).distinct().count() == 21


def test_list_and_join_agree(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "events")
    store.append_new(spark, path, log(spark, [dict(_id=i) for i in "abc"]))
    for listed in (id_index.LISTED, 0):
        monkeypatch.setattr(id_index, "LISTED", listed)
        held = id_index.known(spark, path, [DAY, "2026-06-12"], log(spark, [dict(_id=i) for i in "bcx"]), 3)
        assert sorted(r._id for r in held.collect()) == ["b", "c"]
    store.append_new(spark, path, log(spark, [dict(_id=i) for i in "cde"]))
    assert stored(spark, path) == list("abcde")


@pytest.mark.parametrize("where", ["stage", "_write_laid_out", "publish", "_admit", "rows"])
def test_failed_append_is_made_good(spark, tmp_path, where, monkeypatch):
    """Whatever the append dies in, or after, running it again leaves each id once."""
    path = str(tmp_path / "events")
    store.append_new(spark, path, log(spark, [dict(_id=i) for i in "ab"]))
    module = store if where in ("_write_laid_out", "rows") else id_index
    name = "_write_laid_out" if where == "rows" else where
    real = getattr(module, name)

    def die(*args, **kw):
        if where in ("stage", "rows"):
            real(*args, **kw)
        raise RuntimeError("lost")

    monkeypatch.setattr(module, name, die)
    batch = log(spark, [dict(_id=i) for i in "bcd"])
    with pytest.raises(RuntimeError):
        store.append_new(spark, path, batch)
    monkeypatch.undo()
    for again in (log(spark, [dict(_id=i) for i in "de"]), batch, batch):
        store.append_new(spark, path, again)
    assert stored(spark, path) == list("abcde")
    assert not files.exists(spark, f"{path}__ids_pending")


def test_rows_written_otherwise_are_known(spark, tmp_path):
    """A table without runs, plain writes beside them, compaction and retention."""
    path = str(tmp_path / "events")
    store.write_events(log(spark, [dict(_id=i) for i in "ab"]), path)
    store.append_new(spark, path, log(spark, [dict(_id=i) for i in "bc"]))
    store.write_events(log(spark, [dict(_id="d"), dict(_id="x", received_at="2026-06-12T00:00:00Z")]), path)
    store.append_new(spark, path, log(spark, [dict(_id="d"), dict(_id="x", received_at="2026-06-12T01:00:00Z"), dict(_id="e")]))
    store.compact_day(spark, path, DAY)
    store.append_new(spark, path, log(spark, [dict(_id="e", expires_at="2026-06-20T00:00:00Z"), dict(_id="f", expires_at="2026-06-20T00:00:00Z")]))
    assert stored(spark, path) == list("abcdefx")
    store.expire_events(spark, path, "2026-06-21T00:00:00Z")
    store.append_new(spark, path, log(spark, [dict(_id="f"), dict(_id="a")]))
    assert stored(spark, path) == list("abcdefx")
    store.write_events(log(spark, [dict(_id="z")]), path, "overwrite")
    store.append_new(spark, path, log(spark, [dict(_id="a"), dict(_id="z")]))
    assert stored(spark, path) == ["a", "z"]
