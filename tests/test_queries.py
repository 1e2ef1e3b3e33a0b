"""Rollups, filters and pages on small golden logs."""

import random

import pytest
from helpers import ids, log
from pyspark.sql import functions as F

from eventloom.operators import audit, pages, percentiles, rollups
from eventloom.operators.filters import filter_events, scope_project
from eventloom.plans import dashboards, lenses
from eventloom.sources.store import to_store

FROM, TO = "2026-06-11T00:00:00Z", "2026-06-11T03:00:00Z"


@pytest.fixture(scope="module")
def hourly(spark):
    at = lambda t: f"2026-06-11T{t}Z"
    return log(spark, [
        dict(app="dash", event="ai.request", received_at=at("00:10:00.000"),
             data=dict(latencyMs=100, status=200, costUsd=0.1, inputTokens=10, outputTokens=5)),
        dict(app="dash", event="ai.request", level="error", received_at=at("00:59:59.999"),
             data=dict(durationMs=300, status="500", costUsd=0.2, inputTokens=20, outputTokens=5)),
        dict(app="dash", event="db.query", level="warn", received_at=at("00:00:00.000"), data=dict(keysExamined=7)),
        dict(app="dash", event="cron.run", level="debug", received_at=at("00:45:00.000")),
        dict(app="dash", event="ai.request", received_at=at("01:00:00.000"), data=dict(status=204)),
        dict(app="dash", event="db.query", received_at=at("01:30:00.000")),
        dict(app="other", event="ai.request", level="error", received_at=at("02:15:00.000"), data=dict(latencyMs=50)),
        dict(app="dash", received_at="2026-06-10T23:59:59.999Z", data=dict(costUsd=99)),
        dict(app="dash", received_at=at("03:00:00.000"), data=dict(costUsd=99)),
    ])


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("stored", [False, True])
def test_hourly_stats(hourly, exact, stored):
    ev = to_store(hourly) if stored else hourly
    got = [tuple(r)[1:] for r in rollups.stats(ev, "hour", FROM, TO, exact=exact).collect()]
    assert got == [
        (4, 1, 1, 1, 1, 100.0, 300.0, 300.0, 0.5, 0.3, 30.0, 10.0),
        (2, 0, 2, 0, 0, None, None, None, 0.0, 0.0, 0.0, 0.0),
        (1, 0, 0, 0, 1, 50.0, 50.0, 50.0, None, 0.0, 0.0, 0.0),
    ]


def test_stats_over_stats(hourly):
    buckets = rollups.stats(hourly, "hour", FROM, TO)
    assert tuple(dashboards.metric_cards(buckets).head()) == (7, 2, pytest.approx(200 / 7), 0.3, 40.0, 300.0)
    assert tuple(dashboards.stats_strip(buckets).head()) == (7, 0.3, pytest.approx(2 / 6), pytest.approx(250.0))
    assert tuple(dashboards.metric_cards(buckets.limit(0)).head()) == (0, 0, 0.0, 0.0, 0.0, None)
    assert [r.cum_cost_usd for r in dashboards.cumulative_cost(buckets).collect()] == [0.3, 0.3, 0.3]


def test_event_prefix_is_literal(spark):
    ev = log(spark, [dict(event=e) for e in ("ai.request", "aixrequest", "ai.", "AI.request")])
    assert ids(filter_events(ev, {"event": "ai."})) == ["id-000", "id-002"]


@pytest.fixture(scope="module")
def ties(spark):
    return log(spark, [
        dict(_id=f"id-{i:02d}", event=("ai.request", "db.query")[i % 2], level=("debug", "info", "warn", "error")[i % 4],
             message=f"event number {i}", ids=dict(requestId=f"r-{i}"), data=dict(latencyMs=i * 10, ok=i % 2 == 0, code=str(i)),
             received_at=f"2026-06-11T10:{i // 4:02d}:00Z")
        for i in range(25)
    ])


@pytest.mark.parametrize("stored", [False, True])
def test_pages_split_ties(ties, stored):
    ev = to_store(ties) if stored else ties
    walked = [ids(p) for p in pages.walk_pages(ev, 10)]
    assert [len(p) for p in walked] == [10, 10, 5]
    order = sorted(range(25), key=lambda i: (i // 4, f"id-{i:02d}"), reverse=True)
    assert sum(walked, []) == [f"id-{i:02d}" for i in order]


@pytest.mark.parametrize("stored", [False, True])
def test_a_whole_walk_takes_few_jobs(spark, ties, stored):
    ev = ties.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("_id", F.concat("_id", F.lit("-"), "copy")).drop("copy")
    ev = to_store(ev) if stored else ev
    spark.sparkContext.setJobGroup("walk", "a walk of many pages")
    try:
        got = pages.all_pages(ev, 4, {"level": "warn,error"}).select("_id", "page").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = sorted(((i // 4, f"id-{i:02d}-{c}") for i in range(25) if i % 4 > 1 for c in range(20)), reverse=True)
    assert sorted(tuple(r) for r in got) == sorted((key, at // 4) for at, (_, key) in enumerate(want))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("walk")) < 30  # 60 pages
    assert pages.all_pages(ev, 4, {"level": "debug", "app": "none"}).count() == 0


@pytest.mark.parametrize("params, want", [
    ({"level": "warn,error"}, [i for i in range(25) if i % 4 > 1]),
    ({"ids.requestId": "r-7"}, [7]),
    ({"data.latencyMs": "70"}, [7]),
    ({"data.code": "7"}, [7]),
    ({"data.code__gte": "0"}, []),
    ({"data.ok": "true"}, list(range(0, 25, 2))),
    ({"data.latencyMs__gte": "50", "data.latencyMs__lte": "70"}, [5, 6, 7]),
    ([("data.latencyMs", "70"), ("data.latencyMs__gte", "80")], []),
    ([("data.latencyMs", "abc"), ("data.latencyMs__gte", "230")], [23, 24]),
    ([("data.latencyMs__gte", "230"), ("data.latencyMs", "10")], [1]),
    ([("data.latencyMs__gte", "0"), ("data.latencyMs__gte", "240")], [24]),
    ({"q": "NUMBER 1$"}, [1]),
    ({"q": "number [2]4"}, [24]),
    ({"from": "2026-06-11T10:01:00Z", "to": "2026-06-11T10:02:00Z"}, [4, 5, 6, 7]),
    ({"event": "db.", "data.latencyMs__lte": "30"}, [1, 3]),
    ({"data.missing": "x"}, []),
    ({"app": "", "limit": "5"}, list(range(25))),
])
@pytest.mark.parametrize("stored", [False, True])
def test_filters(ties, params, want, stored):
    ev = to_store(ties) if stored else ties
    assert sorted(ids(filter_events(ev, params))) == [f"id-{i:02d}" for i in want]


@pytest.mark.parametrize("params", [
    {"level": "warn,loud"}, {"nope": "1"}, {"data.": "1"}, {"data.__gte": "1"}, {"data.x__gte": "abc"}, {"q": "("}, {"q": "x" * 257},
    {"from": "yesterday"}, {"from": "2026-01-02", "to": "2026-01-01"},
])
def test_bad_filters(ties, params):
    with pytest.raises(ValueError):
        filter_events(ties, params)


def test_groupby_kinds_null_group_and_rest(spark):
    values = [1, 1.0, "1", True, None, "MISSING", {"a": 1}, {"a": 1}, [1], False, "b", "B"]
    ev = log(spark, [dict(data={} if v == "MISSING" else dict(k=v)) for v in values])
    window = {"from": FROM, "to": TO}
    rows = rollups.groupby(ev, "data.k", params=window).collect()
    assert [(r.value, r.kind, r["count"]) for r in rows] == [
        (None, "null", 2), ("1", "number", 2), ('{"a":1}', "object", 2), ("1", "string", 1), ("B", "string", 1), ("b", "string", 1),
        ("[1]", "array", 1), ("false", "boolean", 1), ("true", "boolean", 1),
    ]
    assert {(r.total, r.other_count) for r in rows} == {(12, 0)}
    top = rollups.groupby(ev, "data.k", limit=2, params=window).collect()
    assert {(r.total, r.other_count) for r in top} == {(12, 8)}
    like = rollups.groupby(ev, "data.k", like="B", params=window).collect()
    assert [(r.value, r.total) for r in like] == [("B", 2), ("b", 2)]
    for bad in ("$where", "data.a b", "message", ""):
        with pytest.raises(ValueError):
            rollups.groupby(ev, bad)


def test_drill(spark):
    ev = log(spark, [dict(data=dict(k=v)) for v in (1, "1", None)] + [{}])
    assert lenses.drill({"level": "error"}, "data.k", True) == {"level": "error", "data.k": "true"}
    assert lenses.drill({}, "level", "loud") == {}
    assert ids(lenses.drill_events(ev, None, "data.k", 1)) == ["id-000", "id-001"]
    assert ids(lenses.drill_events(ev, None, "data.k", None)) == ["id-002", "id-003"]
    with pytest.raises(ValueError):
        lenses.lens("nope")


def test_jobs(spark):
    at = lambda m: f"2026-06-11T01:{m:02d}:00Z"
    ev = log(spark, [
        dict(event="cron.a", received_at=at(1), data=dict(latencyMs=10, status="ok")),
        dict(event="cron.a", received_at=at(2), data=dict(latencyMs="30", status="FAILED")),
        dict(event="cron.a", received_at=at(3), data=dict(durationMs=99, status=500)),
        dict(event="cron.b", received_at=at(1), level="error", _id="z"),
        dict(event="cron.b", received_at=at(1), _id="y"),
        dict(event="cron.c", received_at=at(1), data=dict(status=True)),
        dict(event="cronx", received_at=at(1)),
    ])
    rows = rollups.jobs(ev, from_=FROM, to=TO).collect()
    assert {r.total_jobs for r in rows} == {3}
    got = [tuple(r)[0:1] + tuple(r)[2:-1] for r in rows]
    assert got == [
        ("cron.a", "ok", 3, 1, 0.6667, 10.0, 30.0),
        ("cron.b", "failed", 2, 1, 0.5, None, None),
        ("cron.c", "ok", 1, 0, 1.0, None, None),
    ]


def test_facets_and_names(spark):
    ev = log(spark, [
        dict(app="b", event="y", ids=dict(u=1), data=dict(z=None, a=dict(deep=1))), dict(app="b", event="x", ids=dict(t=1)),
        dict(app="a", event="x", data={}), dict(app="b", event="x"),
    ])
    assert [tuple(r) for r in rollups.facets(ev, FROM, TO).collect()] == [("data", "a"), ("data", "z"), ("ids", "t"), ("ids", "u")]
    assert [tuple(r) for r in rollups.event_names(ev).collect()] == [("a", "x"), ("b", "x"), ("b", "y")]
    assert [tuple(r) for r in rollups.event_names(ev, app="b").collect()] == [("b", "x"), ("b", "y")]


def test_project_scope(spark):
    ev = log(spark, [dict(app=a) for a in ("web", "api", "x")])
    projects = spark.createDataFrame([("p", ["web", "api"]), ("none", [])], "slug string, apps array<string>")
    assert len(ids(scope_project(ev, projects, "p"))) == 2
    assert ids(scope_project(ev, projects, "p", "api")) == ["id-001"]
    assert ids(scope_project(ev, projects, "p", "x")) == [] == ids(scope_project(ev, projects, "none"))
    with pytest.raises(ValueError):
        scope_project(ev, projects, "unknown")


@pytest.mark.parametrize("held, few, split", [(1 << 15, 4096, 4096), (100, 1, 16), (0, 4, 7)])
def test_exact_percentiles_on_skewed_groups(spark, monkeypatch, held, few, split):
    """One group with a third of the rows, one repeated value, negatives, huge and tiny values; held or narrowed."""
    for name, value in (("HELD", held), ("FEW", few), ("SPLIT", split)):
        monkeypatch.setattr(percentiles, name, value)
    rng = random.Random(11)
    rows = [("hot", rng.choice([7.0, rng.uniform(-50, 5000)])) for _ in range(3000)]
    rows += [("same", 3.25)] * 1000 + [(f"g{i % 50}", rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 12)) for i in range(4000)]
    rows += [("hot", None), ("empty", None), ("pair", 1.0), ("pair", 1.0000000000000002), ("hot", float("inf")), ("hot", 5e-324), ("hot", 1.7e308)]
    ps = {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in percentiles.exact(df, ["g"], df.v, ps).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        vs.sort()
        for name, p in ps.items():
            rank = max(1, -int(-p * len(vs) // 1))
            assert got[g][name] == vs[rank - 1], (g, name)


def test_audits(spark):
    key = lambda xs: spark.createDataFrame([(x,) for x in xs], "k string")
    acked, held = key("aabc"), key("bbcd")
    assert tuple(audit.delivery_audit(acked, held, "k").head()) == (3, 3, 1, 1)
    assert [r.k for r in audit.missing_keys(acked, held, "k").collect()] == ["a"]
    requests = spark.createDataFrame([(10, 9, True, float(i)) for i in range(1, 101)] + [(10, 0, False, 999.0)], "sent int, accepted int, ok boolean, ack_ms double")
    assert tuple(audit.load_summary(requests, 2000).head()) == (1010, 900, 100, 1, 450.0, 50.0, 99.0)


def test_tail(ties):
    page = pages.newest(ties, 5)
    tail = filter_events(ties, {"level": "error"})
    merged = ids(pages.merge_tail(page, tail.unionByName(tail), 3))
    assert merged == ["id-24", "id-23", "id-22", "id-21", "id-20", "id-19", "id-15", "id-11"]


def test_text_search_is_checked_by_the_engine_that_runs_it(spark):
    ev = log(spark, [dict(_id="a", message="ÄRGER x"), dict(_id="b", message="none")])
    assert ids(filter_events(ev, {"q": "ärger"})) == ["a"]
    for q in ("[[]", "(?P<n>x)", "x{,3}", "("):
        try:
            filter_events(ev, {"q": q}).count()
        except ValueError:
            pass


def test_job_cards_count_all_jobs_and_pages_tell_the_total(spark):
    from eventloom.plans import dashboards

    ev = log(spark, [dict(_id=f"{i:03d}", event=f"cron.j{i}", level="error" if i >= 200 else "info") for i in range(230)])
    span = {"from_": "2026-06-10T00:00:00Z", "to": "2026-06-12T00:00:00Z"}
    cards = {r.name: r.value for r in dashboards.overview(ev, **span).collect() if r.section == "card"}
    assert (cards["jobs"], cards["failing_jobs"]) == (230, 30)
    page = rollups.jobs(ev, **span)
    assert page.count() == 200 and page.head().total_jobs == 230 and rollups.jobs(ev, limit=None, **span).count() == 230


def test_a_window_that_ends_at_midnight_leaves_the_next_day_closed(spark, tmp_path):
    from eventloom.sources import store

    store.write_events(log(spark, [dict(_id=str(d), received_at=f"2026-06-1{d}T00:00:00Z") for d in (1, 2)]), str(tmp_path))
    got = filter_events(store.read_events(spark, str(tmp_path)), {"from": "2026-06-11T00:00:00Z", "to": "2026-06-12T00:00:00Z"})
    assert ids(got) == ["1"]
    assert "event_date <= 2026-06-11" in got._jdf.queryExecution().optimizedPlan().toString() or "2026-06-11" in str(got._jdf.queryExecution().executedPlan())


def test_percentiles_of_a_million_values_in_a_narrow_band(spark):
    """No range that is put in order holds more than a few values, and few rounds lead there."""
    n = 1_000_000
    values = spark.range(n).select(F.lit("g").alias("g"), (F.lit(1e-4) + F.col("id") * 1e-10).alias("v"))
    ps = {"p50": 0.5, "p99": 0.99}
    assert not percentiles.fits(values, ["g"], "v")
    got = percentiles.exact(values, ["g"], F.col("v"), ps).head()
    assert got.p50 == 1e-4 + (n // 2 - 1) * 1e-10 and got.p99 == 1e-4 + (n * 99 // 100 - 1) * 1e-10
    state = percentiles.narrowed(values.select(F.col("g").alias("_k0"), F.col("v").alias("_v"), F.lit(1).alias("_n")), ["_k0"], ps)
    assert all(r["_many"] <= percentiles.FEW for r in state.collect())
