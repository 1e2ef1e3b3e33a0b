"""Envelopes to the store: validation cases, the 250-event set, replay, retention, streams."""

import json

import pytest
from conftest import SF_SMALL
from helpers import log
from pyspark.sql import functions as F

from eventloom.operators import audit, envelopes, pages, rollups
from eventloom.operators.filters import filter_events
from eventloom.schema import Limits
from eventloom.sources import segments, store
from eventloom.sources.synthetic import gen_envelopes
from eventloom.sources.tables import event_log, stream_event_log
from eventloom.streaming.ingest import run_ingest
from eventloom.streaming.live import stream_stats

SOURCES = [("k1", "appA", "prod", "write"), ("k2", "appB", "prod", "write"), ("r", "appA", "prod", "read")]


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame(SOURCES, "source_id string, app string, env string, mode string")


def batches(spark, bodies, source="k1"):
    rows = [(f"b{i:03d}", source, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "batch_id string, source_id string, body string")
    return df.withColumn("received_at", F.lit("2026-06-11T10:00:00Z").cast("timestamp"))


def deep(n):
    v = 1
    for _ in range(n):
        v = [v]
    return v


X = {"event": "x"}
REJECTED = [
    ("nope{", None, "request body is not valid JSON"),
    ([], None, "empty batch"),
    ([X] * 501, None, "batch exceeds 500 events"),
    ("5", 0, "event envelope must be a JSON object"),
    ("null", 0, "event envelope must be a JSON object"),
    ([X, [X]], 1, "event envelope must be a JSON object"),
    ([X, json.dumps(X)], 1, "event envelope must be a JSON object"),
    ({}, 0, "event is required and must be a non-empty string"),
    ({"event": ""}, 0, "event is required and must be a non-empty string"),
    ({"event": 42}, 0, "event is required and must be a non-empty string"),
    ({"event": None}, 0, "event is required and must be a non-empty string"),
    ({"event": "e" * 201}, 0, "event exceeds 200 chars"),
    ({"event": "😀" * 101}, 0, "event exceeds 200 chars"),
    ({"event": "a\nb"}, 0, "event must not contain control characters"),
    ({"event": "a\u001fb"}, 0, "event must not contain control characters"),
    ({"event": "x", "user": 1}, 0, 'unknown key "user"'),
    ({"event": "x", "level": "fatal"}, 0, "level must be one of debug|info|warn|error"),
    ({"event": "x", "level": None}, 0, "level must be one of debug|info|warn|error"),
    ({"event": "x", "ts": "nope"}, 0, "ts must be a Date.parse-able string"),
    ({"event": "x", "ts": 1749600000000}, 0, "ts must be a Date.parse-able string"),
    ({"event": "x", "ts": "10:30"}, 0, "ts must be a Date.parse-able string"),
    ({"event": "x", "ts": None}, 0, "ts must be a Date.parse-able string"),
    ({"event": "x", "message": 42}, 0, "message must be a string"),
    ({"event": "x", "ids": []}, 0, "ids must be a plain object"),
    ({"event": "x", "ids": None}, 0, "ids must be a plain object"),
    ({"event": "x", "ids": {f"k{i}": "v" for i in range(11)}}, 0, "ids exceeds 10 keys"),
    ({"event": "x", "ids": {"a": "1", "b": {}}}, 0, "ids.b must be a string, number, or boolean"),
    ({"event": "x", "ids": {"a": None}}, 0, "ids.a must be a string, number, or boolean"),
    ({"event": "x", "ids": {"a": deep(40)}}, 0, "ids nesting exceeds 32 levels"),
    ({"event": "x", "data": []}, 0, "data must be a plain object"),
    ({"event": "x", "data": "s"}, 0, "data must be a plain object"),
    ({"event": "x", "data": {"a": deep(32)}}, 0, "data nesting exceeds 32 levels"),
    ([X, {"event": "x", "level": "fatal"}, {"event": ""}], 1, "level must be one of debug|info|warn|error"),
    ("[" + " " * 1_048_576 + "]", None, "request body too large"),
]


def test_rejections(spark, sources):
    accepted, rejected = envelopes.normalize(batches(spark, [b for b, _, _ in REJECTED]), sources)
    assert accepted.count() == 0
    got = {r.batch_id: (r["index"], r.error) for r in rejected.collect()}
    for i, (body, index, error) in enumerate(REJECTED):
        assert got.get(f"b{i:03d}") == (index, error), str(body)[:80]


def test_sources(spark, sources):
    for source, error in (("r", "write key required"), ("who", "unauthorized")):
        accepted, rejected = envelopes.normalize(batches(spark, [X], source), sources)
        assert accepted.count() == 0 and rejected.head().error == error


def test_bodies_of_one_source_spread_over_tasks(spark, sources):
    """A registry of unknown size is joined by a shuffle, which one hot source must not put into one task."""
    hot = spark.range(2000).selectExpr("cast(id as string) as batch_id", "'chat' as source_id", "timestamp'2026-06-11' as received_at", "'{\"event\":\"x\"}' as body")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        checked = envelopes.check_batches(hot, sources)
        tasks = [r["n"] for r in checked.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 2000 and max(tasks) < 1500


def test_accepted_values(spark, sources):
    big = {"b": "y" * 300, "a": {"n": 1e3}}
    bodies = [
        X,
        {"event": "ai.request", "level": "warn", "ts": "2026-06-11T09:00:00Z", "message": "m" * 600,
         "ids": {"taskId": "abc", "attempt": 3, "cached": False, "half": 0.5, "big": 1e3, "tiny": 0.000001, "huge": 1e21},
         "data": {"model": "m", "latencyMs": 41200}},
        [{"event": "e" * 200, "ts": "2026-06-11"}, {"event": "x", "ts": "2026-06-11T09:00:00.123+02:00"}, X],
        {"event": "x", "data": big},
        {"event": "x", "data": {"a": deep(31)}},
        {"event": "a b", "message": "😀" * 300},
        '{"event": "x", "level": "warn", "level": "error"}',
    ]
    accepted, rejected = envelopes.normalize(batches(spark, bodies), sources, Limits(max_data_units=256, head_chars=20))
    assert rejected.count() == 0
    rows = accepted.orderBy("_id").collect()
    assert len({r._id for r in rows}) == len(rows) == 9 and {len(r._id) for r in rows} == {32}
    full = accepted.filter("event = 'ai.request'").withColumn("data", F.to_json("data")).head()
    assert (full.app, full.env, full.level, full.ts, len(full.message)) == ("appA", "prod", "warn", "2026-06-11T09:00:00Z", 512)
    assert full.ids == {"taskId": "abc", "attempt": "3", "cached": "false", "half": "0.5", "big": "1000", "tiny": "0.000001", "huge": "1e+21"}
    assert json.loads(full.data) == {"model": "m", "latencyMs": 41200}
    cut = accepted.filter("try_variant_get(data, '$._truncated', 'boolean')").selectExpr(
        "try_variant_get(data, '$._originalBytes', 'int') n", "try_variant_get(data, '$._head', 'string') h").head()
    assert cut.h == '{"b":"' + "y" * 14 and cut.n >= len('{"b":"' + "y" * 300 + '","a":{"n":1000}}')
    assert accepted.filter("event = 'a b'").head().message == "😀" * 256
    life = accepted.selectExpr("level", "(unix_micros(expires_at) - unix_micros(received_at)) / 86400e6 as d").distinct().collect()
    assert {(r.level, r.d) for r in life} == {("info", 30.0), ("warn", 90.0), ("error", 90.0)}
    again = envelopes.normalize(batches(spark, bodies), sources, Limits(max_data_units=256, head_chars=20))[0]
    assert sorted(r._id for r in again.select("_id").collect()) == [r._id for r in rows]


@pytest.fixture(scope="module")
def golden(spark, sources):
    """The 250-event set: seven batches of one app and one of another, a second apart."""
    sizes = [("k1", n) for n in (1, 2, 5, 10, 25, 50, 100)] + [("k2", 57)]
    envs = [r.envelope for r in gen_envelopes(spark, 250).orderBy("n").collect()]
    rows, start = [], 0
    for i, (source, n) in enumerate(sizes):
        rows.append((f"b{i}", source, "[" + ",".join(envs[start : start + n]) + "]", f"2026-06-11T10:00:{i:02d}Z"))
        start += n
    df = spark.createDataFrame(rows, "batch_id string, source_id string, body string, at string")
    accepted, rejected = envelopes.normalize(df.withColumn("received_at", F.to_timestamp("at")), sources)
    assert rejected.count() == 0
    return accepted


@pytest.fixture(scope="module")
def landed(spark, golden, tmp_path_factory):
    """The set as sealed segments, with a corrupt line and a torn tail."""
    where = tmp_path_factory.mktemp("segments")
    lines = [r.value for r in segments.to_lines(golden).collect()]
    (where / "seg-0000000000001.ndjson").write_text("\n".join(lines[:100]) + "\nnot json\n\n")
    (where / "seg-0000000000002.ndjson").write_text("\n".join(lines[100:]) + "\n" + lines[0][:50])
    (where / "other.txt").write_text("ignored\n")
    return str(where)


def check_golden(ev):
    window = {"from_": "2026-06-11T10:00:00Z", "to": "2026-06-11T11:00:00Z"}
    for params, n in [
        ({"level": "error"}, 25), ({"app": "appB"}, 57), ({"event": "ai."}, 84), ({"data.latencyMs__gte": "240"}, 10),
        ({"data.latencyMs__gte": "100", "data.latencyMs__lte": "104"}, 5), ({"data.status": "500"}, 25), ({"ids.n": "42"}, 1),
        ({"q": "^event number 42$"}, 1),
    ]:
        assert filter_events(ev, params).count() == n, params
    assert [p.count() for p in pages.walk_pages(ev, 100)] == [100, 100, 50]
    (r,) = rollups.stats(ev, "hour", **window).collect()
    assert tuple(r)[1:] == (250, 0, 200, 25, 25, 124.0, 237.0, 247.0, 0.1, 2.5, 840.0, 420.0)
    assert ev.select("_id").distinct().count() == ev.count() == 250


def test_golden_set(golden):
    check_golden(golden)


def test_segments(spark, landed):
    assert segments.read_segments(spark, landed).count() == 250
    report = {r.path[-24:]: (r.lines, r.corrupt, r.torn_tail) for r in segments.segment_report(spark, landed).collect()}
    assert report == {"seg-0000000000001.ndjson": (101, 1, False), "seg-0000000000002.ndjson": (150, 0, True)}


def test_stream_ingest_and_full_replay(spark, landed, golden, tmp_path):
    path, rejects = str(tmp_path / "events"), str(tmp_path / "rejects")
    for attempt in ("one", "two", "two"):
        run_ingest(spark, landed, path, str(tmp_path / attempt), rejects, max_files=1, available_now=True).awaitTermination()
    ev = store.read_events(spark, path)
    check_golden(ev)
    assert spark.read.text(rejects).filter("value = 'not json'").count() >= 1
    sent = golden.selectExpr("ids['n'] as n")
    assert tuple(audit.delivery_audit(sent, ev.selectExpr("ids['n'] as n"), "n").head()) == (250, 250, 0, 0)


def test_append_skips_repeats_in_batch_and_store(spark, tmp_path):
    path = str(tmp_path / "events")
    one = log(spark, [dict(_id="a"), dict(_id="a"), dict(_id="b", received_at="2026-06-12T00:00:00Z")])
    two = log(spark, [dict(_id="b", received_at="2026-06-12T00:00:00Z"), dict(_id="c", received_at="2026-06-13T00:00:00Z")])
    for batch in (one, two, one, two.limit(0)):
        store.append_new(spark, path, batch)
    assert sorted(r._id for r in store.read_events(spark, path).collect()) == ["a", "b", "c"]


def test_append_ranks_only_rows_of_repeated_ids(spark, tmp_path, monkeypatch):
    ranked, one_per_id = [], store.one_per_id
    monkeypatch.setattr(store, "one_per_id", lambda batch: ranked.append(batch.count()) or one_per_id(batch))
    path = str(tmp_path / "t")
    store.append_new(spark, path, log(spark, [dict(_id=f"u{i}") for i in range(6)]))
    assert ranked == []
    store.append_new(spark, path, log(spark, [dict(_id=i, message=str(n)) for n, i in enumerate(("u1", "v", "w", "w"))]))
    assert ranked == [2]
    assert sorted(r._id for r in store.read_events(spark, path).collect()) == ["u0", "u1", "u2", "u3", "u4", "u5", "v", "w"]


def test_append_keeps_one_instant_of_an_id(spark, tmp_path):
    """An id is one event on its day, in one batch or several, and always the same copy of it stays."""
    path = str(tmp_path / "events")
    early, late = ("2026-06-11T01:00:00Z", "2026-06-11T02:00:00Z")
    both = log(spark, [dict(_id="a", received_at=late, message="late"), dict(_id="a", received_at=early, message="early")])
    for batch in (both, log(spark, [dict(_id="a", received_at=late)])):
        store.append_new(spark, path, batch)
    assert [r.message for r in store.read_events(spark, path).collect()] == ["early"]


def test_append_opens_only_the_days_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    store.write_events(log(spark, [dict(_id=str(d), received_at=f"2026-06-{d:02d}T00:00:00Z") for d in range(1, 10)]), path)
    read = store.read_events(spark, path, ["2026-06-03", "2030-01-01"])
    assert {f.split("event_date=")[1][:10] for f in read.inputFiles()} == {"2026-06-03"} and read.count() == 1
    assert store.read_events(spark, path, ["2030-01-01"]).columns == read.columns


def test_unreadable_lines_go_to_rejects_by_default(spark, tmp_path):
    """Replayed lines without readable instants or required fields are stored never, and rejected each time."""
    source, path = tmp_path / "in", str(tmp_path / "events")
    source.mkdir()
    good = {"_id": "a", "app": "x", "env": "prod", "event": "e", "level": "info", "receivedAt": "2026-06-11T00:00:00Z", "expiresAt": "2027-01-01T00:00:00Z"}
    bad = [{**good, "_id": "b", "receivedAt": "garbage"}, {**good, "_id": "c", "expiresAt": "soon"}, {k: v for k, v in good.items() if k != "app"}]
    (source / "seg-1.ndjson").write_text("".join(json.dumps(x) + "\n" for x in [good, *bad]) + "not json\n")
    for attempt in range(3):
        run_ingest(spark, str(source), path, str(tmp_path / f"cp{attempt}"), available_now=True).awaitTermination()
    assert [r._id for r in store.read_events(spark, path).collect()] == ["a"]
    assert spark.read.text(f"{path}__rejects").count() == 4


def test_expire_events(spark, tmp_path):
    path = str(tmp_path / "events")
    day = lambda d: f"2026-06-{d:02d}T05:00:00Z"
    store.write_events(log(spark, [
        dict(_id="old", received_at=day(1), expires_at=day(8)), dict(_id="kept", received_at=day(1), expires_at=day(30)),
        dict(_id="gone", received_at=day(2), expires_at=day(9)), dict(_id="new", received_at=day(9), expires_at=day(30)),
    ]), path)
    now = "2026-06-09T05:00:00Z"
    table = store.read_events(spark, path)
    assert sorted(r._id for r in store.apply_retention(table, now).collect()) == ["kept", "new"]
    assert [str(d) for d in store.expire_events(spark, path, now)] == ["2026-06-01", "2026-06-02"]
    assert sorted(r._id for r in store.read_events(spark, path).collect()) == ["kept", "new"]
    assert store.expire_events(spark, path, now) == []


def test_api_json(spark):
    ev = log(spark, [dict(_id="a", ids=dict(u=1), data=dict(z=None, n=1.5), received_at="2026-06-11T00:00:00.123Z")])
    assert json.loads(pages.to_api_json(ev).head().json) == {
        "_id": "a", "app": "a", "env": "prod", "event": "x", "level": "info", "ids": {"u": "1"}, "data": {"z": None, "n": 1.5},
        "receivedAt": "2026-06-11T00:00:00.123Z", "expiresAt": "2027-01-01T00:00:00.000Z",
    }


def test_stream_stats_equal_batch_stats(spark, tmp_path):
    out = str(tmp_path / "out")

    def keep(df, epoch):
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(out)

    live = stream_stats(stream_event_log(spark, SF_SMALL), "day")
    live.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out).drop("epoch").distinct()
    want = rollups.stats(event_log(spark, SF_SMALL), "day", "2024-01-01", "2024-03-01")
    key = lambda df: sorted(tuple(r)[:8] for r in df.collect())
    assert key(got.select(want.columns)) == key(want)


def test_side_columns_equal_the_variant(spark):
    """What the adapter puts in the side columns is what the writer would extract."""
    ev = event_log(spark, SF_SMALL)
    both = ev.select("_id", "hot").join(store.to_store(ev.drop("hot")).selectExpr("_id", "hot as derived"), "_id")
    same = " and ".join(f"hot.{k} <=> derived.{k}" for k in ev.schema["hot"].dataType.fieldNames())
    assert both.filter(f"not ({same})").count() == 0


def _expiring(spark, ids, expires_at):
    return log(spark, [dict(_id=i, expires_at=expires_at) for i in ids])


@pytest.mark.parametrize("moved", [False, True])
def test_expire_finishes_an_interrupted_run_beside_ingest(spark, tmp_path, moved, monkeypatch):
    """Rows appended while retention runs, or between a failed run and the next, stay."""
    path, now = str(tmp_path / "events"), "2026-06-13T00:00:00Z"
    store.write_events(_expiring(spark, "a", "2026-06-12T00:00:00Z").unionByName(_expiring(spark, "b", "2026-07-01T00:00:00Z")).coalesce(1), path)
    finish, delete = store.finish_retention, store.files.delete

    def die(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(*((store.files, "delete") if moved else (store, "finish_retention")), lambda *a: die() if "__retained" not in str(a[1]) or not moved else delete(*a))
    if not moved:
        calls = iter([finish, die])
        monkeypatch.setattr(store, "finish_retention", lambda *a: next(calls)(*a))
    with pytest.raises(RuntimeError):
        store.expire_events(spark, path, now)
    monkeypatch.undo()
    store.write_events(_expiring(spark, "c", "2026-07-01T00:00:00Z"), path)
    store.expire_events(spark, path, now)
    assert sorted(r._id for r in store.read_events(spark, path).collect()) == ["b", "c"]
    assert not store.files.exists(spark, f"{path}__retained")


def test_compact_day(spark, tmp_path):
    path = str(tmp_path / "events")
    for i in "abc":
        store.write_events(_expiring(spark, i, "2026-07-01T00:00:00Z"), path)
    store.compact_day(spark, path, "2026-06-11")
    read = store.read_events(spark, path)
    assert sorted(r._id for r in read.collect()) == ["a", "b", "c"] and len(read.inputFiles()) == 1


def test_archive_of_finished_segments(spark, landed, tmp_path):
    import shutil

    source, archive = tmp_path / "in", tmp_path / "done"
    shutil.copytree(landed, source)
    for _ in range(2):
        run_ingest(
            spark, str(source), str(tmp_path / "events"), str(tmp_path / "cp"), max_files=1, available_now=True, archive=str(archive)
        ).awaitTermination()
    assert store.read_events(spark, str(tmp_path / "events")).count() == 250


@pytest.mark.parametrize("text", ["x" * 900_000, '"' * 300_000, "\\" * 300_000, "[{" * 300_000, '"[' * 200_000])
def test_long_strings_in_data(spark, sources, text):
    good, bad = envelopes.normalize(batches(spark, [{"event": "x", "data": {"a": [text], "b": {text[:3000]: 1}}}]), sources)
    assert bad.isEmpty()
    assert [json.loads(r.d)["_truncated"] for r in good.select(F.to_json("data").alias("d")).collect()] == [True]
    deeper = envelopes.normalize(batches(spark, [{"event": "x", "data": {"t": text, "a": deep(40)}}]), sources)[1]
    assert [r.error for r in deeper.collect()] == ["data nesting exceeds 32 levels"]
