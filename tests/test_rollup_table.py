"""Stored hours against the scan, and what appends, retention and failures do to them."""

import pytest
from conftest import SF_SMALL
from helpers import log
from test_id_index import scanned

from eventloom.operators import pages, rollups
from eventloom.sources import beside, files, rollup_table, store
from eventloom.sources.tables import event_log, project_table

SPAN = {"from_": "2024-01-01", "to": "2024-03-01"}
DAYS = [f"2024-01-{d:02d}" for d in range(1, 32)]
ADDED = ["total", "debug", "info", "warn", "error", "error_rate", "cost_usd", "input_tokens", "output_tokens"]


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("bucket", *ADDED).collect())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rolled") / "events")
    ev = event_log(spark, SF_SMALL)
    for batch in (ev.filter("received_at < '2024-01-12 07:30:00'"), ev):
        rollup_table.update(spark, path, store.append_new(spark, path, batch))
    return path


@pytest.mark.parametrize("more", [{}, {"app": "svc1", "event": "cron."}, {"project": "alpha"}])
def test_sums_equal_the_scan(spark, table, more):
    ev = event_log(spark, SF_SMALL)
    if "project" in more:
        more = {**more, "projects": project_table(spark)}
    for group in ("hour", "day"):
        assert rows(rollup_table.stats(spark, table, group, **SPAN, **more)) == rows(rollups.stats(ev, group, **SPAN, **more))
    window = {"from_": "2024-01-05T06:00:00Z", "to": "2024-01-05T09:00:00Z"}
    assert rows(rollup_table.stats(spark, table, "hour", **window)) == rows(rollups.stats(ev, "hour", **window))
    with pytest.raises(ValueError):
        rollup_table.stats(spark, table, "hour", from_="2024-01-05T06:30:00Z", to="2024-01-06")


def test_percentiles_are_within_the_rank_bound(spark, table):
    latency = {}
    for r in rollups.measures(event_log(spark, SF_SMALL)).selectExpr("date_trunc('day', received_at) as day", "latency").filter("latency is not null").collect():
        latency.setdefault(r.day, []).append(r.latency)
    for r in rollup_table.stats(spark, table, "day", **SPAN).collect():
        values = latency[r.bucket]
        for p, share in rollups.STATS_PERCENTILES.items():
            below, upto = (sum(f(v) for v in values) / len(values) for f in (lambda v: v < r[p], lambda v: v <= r[p]))
            assert below - 0.01 <= share <= upto + 0.01


def test_repeats_failures_and_replaced_files(spark, tmp_path, monkeypatch):
    path, window = str(tmp_path / "events"), {"from_": "2026-06-11", "to": "2026-06-12"}
    count = lambda: [r.total for r in rollup_table.stats(spark, path, "day", **window).collect()]
    assert count() == []
    for i in range(20):
        store.write_events(log(spark, [dict(_id=f"{i}a"), dict(_id=f"{i}b", expires_at="2026-06-12T00:00:00Z")]), path)
        rollup_table.update(spark, path, ["2026-06-11"] * 2)
    assert count() == [40] and len(files.listed(spark, f"{rollup_table.root(path)}/event_date=2026-06-11")) <= beside.FAN + 1
    moves = iter([True])

    def lost(*args):
        if next(moves, None):
            raise RuntimeError("lost")
        return move(*args)

    move = files.move
    store.write_events(log(spark, [dict(_id="x")]), path)
    monkeypatch.setattr(files, "move", lost)
    with pytest.raises(RuntimeError):
        rollup_table.update(spark, path, ["2026-06-11"])
    monkeypatch.undo()
    rollup_table.update(spark, path, ["2026-06-11"])
    assert count() == [41]
    store.expire_events(spark, path, "2026-06-13T00:00:00Z")
    assert count() == []  # rows of replaced files do not count; the new files are not known yet
    rollup_table.update(spark, path, ["2026-06-11"])
    assert count() == [21]


def test_trace_reads_only_row_groups_that_may_hold_the_id(spark, tmp_path):
    path = str(tmp_path / "events")
    days = [f"2026-06-{d:02d}T00:00:00Z" for d in range(1, 13)]
    docs = [dict(_id=f"{d}-{i}", received_at=t, ids=dict(requestId=f"r{d}-{i}")) for d, t in enumerate(days) for i in range(40)]
    store.write_events(log(spark, [*docs, dict(_id="last", received_at=days[3], ids=dict(requestId="r9-7"))]), path)
    found = pages.trace(store.read_events(spark, path), "requestId", "r9-7")
    assert [r._id for r in found.collect()] == ["last", "9-7"]
    assert scanned(found) <= 2 * (41 + 40) < len(docs)  # the sort reads twice
    assert not pages.trace(store.read_events(spark, path), "taskId", "r9-7").collect()


def test_days_are_followed_together_and_told_apart(spark, tmp_path):
    """One task that writes several days names its files alike; the jobs of an update do not follow the number of days."""
    path = str(tmp_path / "t")
    ev = log(spark, [dict(_id=f"d{d}", received_at=f"2026-06-{d:02d}T01:00:00Z") for d in range(1, 11)])
    store.write_events(ev, path)
    days = [f"2026-06-{d:02d}" for d in range(1, 11)]
    names = [beside.name(f) for d in days for f in beside.data_files(spark, path, d)]
    assert len(set(names)) == len(names) == 10
    spark.sparkContext.setJobGroup("follow", "ten days")
    try:
        rollup_table.update(spark, path, days)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("follow")) < 10
    assert [r.total for r in rollup_table.stats(spark, path, "day", "2026-06-01", "2026-06-11").collect()] == [1] * 10
