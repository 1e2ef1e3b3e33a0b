"""Plans stay the ones we want."""

import pytest
from conftest import SF_SMALL

import __spark_entry__ as contract
from eventloom.operators import rollups
from eventloom.operators.filters import filter_events
from eventloom.registry import QUERIES
from eventloom.sources import store
from eventloom.sources.tables import event_log


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("stream", "dedup", "append", "retention", "read_s", "segment", "bad_"))))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name != "redact":
        assert "Python" not in text and "Pandas" not in text


def test_rollup_reads_only_its_columns_and_shuffles_once(spark):
    ev = event_log(spark, SF_SMALL)
    counts = rollups.group_counts(ev, "data.status")
    assert plan(counts).count("Exchange ") == 1
    assert "ReadSchema: struct<event_type:string>" in plan(counts)
    page = contract.queries()["logs_page"](spark, SF_SMALL)
    assert "TakeOrderedAndProject" in plan(page)


def test_store_prunes_days_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(event_log(spark, SF_SMALL), path)
    ev = store.read_events(spark, path)
    text = plan(filter_events(ev, {"from": "2024-01-05T06:00:00Z", "to": "2024-01-06", "app": "svc1", "data.latencyMs__gte": "100"}))
    scan = text[text.index("PartitionFilters"):]
    assert "event_date" in scan[: scan.index("PushedFilters")]
    pushed = scan[scan.index("PushedFilters"):]
    assert "EqualTo(app,svc1)" in pushed and "received_at" in pushed and "hot.latencyMs.num" in pushed
    stats = plan(rollups.stats(ev, "hour", "2024-01-05", "2024-01-06"))
    assert "data:variant" not in stats and "message" not in stats[stats.index("ReadSchema"):]


def test_duplicate_check_does_not_shuffle_the_store(spark, tmp_path):
    path = str(tmp_path / "events")
    ev = event_log(spark, SF_SMALL)
    store.write_events(ev, path)
    batch = filter_events(ev, {"from": "2024-01-10", "to": "2024-01-11"})
    fresh = store.new_rows(store.read_events(spark, path), batch)
    text = plan(fresh)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("LeftSemi")[0]
    assert fresh.count() == 0


def test_page_of_a_table_opens_its_newest_days_only(spark, tmp_path):
    from helpers import log

    from eventloom.operators.pages import logs_page, walk_pages
    from eventloom.sources import store

    days = [f"2026-06-{d:02d}T0{h}:00:00Z" for d in range(1, 21) for h in range(5)]
    store.write_events(log(spark, [dict(_id=f"{i:03d}", received_at=t, app="ab"[i % 2]) for i, t in enumerate(days)]), str(tmp_path))
    ev = store.read_events(spark, str(tmp_path))
    page = logs_page(ev, 7)
    assert [r._id for r in page.collect()] == [f"{i:03d}" for i in range(99, 92, -1)]
    assert "2026-06-19" in page._jdf.queryExecution().executedPlan().toString()
    walked = [r._id for p in walk_pages(ev, 30) for r in p.collect()]
    assert walked == [f"{i:03d}" for i in range(99, -1, -1)]
    projects = spark.createDataFrame([("p", ["a"])], "slug string, apps array<string>")
    assert [r._id for p in walk_pages(ev, 30, None, projects, "p") for r in p.collect()] == [f"{i:03d}" for i in range(98, -1, -2)]


def test_small_percentiles_share_the_rollup_shuffle(spark):
    df = rollups.stats(event_log(spark, SF_SMALL), "day", "2024-01-01", "2024-03-01")
    df.collect()
    assert plan(df).count("Exchange hashpartitioning") == plan(df).count("+- Exchange hashpartitioning") and "Join" not in plan(df)


def test_top_values_take_one_scan(spark):
    from conftest import SF_SMALL

    from eventloom.plans import dashboards
    from eventloom.sources.tables import WHOLE, event_log

    df = dashboards.top_by(event_log(spark, SF_SMALL), "userId", params=WHOLE)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") + plan.count("Scan parquet") <= 2 and "WindowGroupLimit" in plan
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
