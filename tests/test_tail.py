"""What is kept over micro-batches: the tail, the counts of the rollup."""

from helpers import log

from conftest import SF_SMALL
from eventloom import registry
from eventloom.operators import rollups
from eventloom.sources import files
from eventloom.streaming.live import keep_counts, keep_tail, read_counts, read_tail, stream_tail

AT = "2026-06-11T00:{:02d}:00Z"


def batch(spark, *minutes, **more):
    return log(spark, [dict(_id=f"m{m:02d}", received_at=AT.format(m), **more) for m in minutes])


def tail(spark, state):
    return [(r._id, r.arrived) for r in read_tail(spark, state).collect()]


def test_earlier_arrivals_stay_and_seen_ids_move_up(spark, tmp_path):
    state = str(tmp_path / "tail")
    assert read_tail(spark, state) is None
    keep_tail(spark, state, batch(spark, 1, 2, 3, 3), 0, 4)
    assert tail(spark, state) == [("m03", 0), ("m02", 0), ("m01", 0)]
    keep_tail(spark, state, batch(spark, 9), 1, 4)
    keep_tail(spark, state, batch(spark, 1, 2), 2, 4)
    assert tail(spark, state) == [("m02", 2), ("m01", 2), ("m09", 1), ("m03", 0)]
    keep_tail(spark, state, batch(spark, 0), 3, 4)  # late, but the latest arrival; the oldest goes
    assert tail(spark, state) == [("m00", 3), ("m02", 2), ("m01", 2), ("m09", 1)]
    keep_tail(spark, state, batch(spark), 4, 4)
    assert tail(spark, state) == [("m00", 3), ("m02", 2), ("m01", 2), ("m09", 1)]


def test_a_retried_batch_changes_nothing(spark, tmp_path):
    state = str(tmp_path / "tail")
    keep_tail(spark, state, batch(spark, 1, 2), 0, 3)
    for rows in ((5,), (5,), (3, 5)):  # an attempt may have seen less than the one that counts
        keep_tail(spark, state, batch(spark, *rows), 1, 3)
    assert tail(spark, state) == [("m05", 1), ("m03", 1), ("m02", 0)]
    keep_tail(spark, state, batch(spark, 7), 0, 3)  # a stream begun anew
    assert tail(spark, state) == [("m07", 0)]


def test_a_restarted_stream_goes_on_with_its_tail(spark, tmp_path):
    source, checkpoint, got = str(tmp_path / "in"), str(tmp_path / "cp"), []
    for minutes in ((1, 2), (3,)):
        batch(spark, *minutes, level="error").unionByName(batch(spark, 50)).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(batch(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
        deliver = lambda df, epoch: got.append([r._id for r in df.collect()])
        stream_tail(stream, deliver, {"level": "error"}, 2, checkpoint=checkpoint, available_now=True).awaitTermination()
    assert got == [["m02", "m01"], ["m03", "m02"]]


def test_live_percentiles_are_exact_in_large_buckets(spark, tmp_path):
    """60,000 values a day: beyond what an approximate summary holds exactly."""
    state = str(tmp_path / "counts")
    ev = log(spark, [dict(level="error")]).join(spark.range(60_000)).selectExpr(
        "concat('e', id) as _id", "app", "env", "event", "level", "ts", "message", "ids",
        "parse_json(to_json(named_struct('latencyMs', pmod(xxhash64(id), 1000003) / 7, 'status', 500))) as data",
        "timestamp'2026-06-11 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as received_at", "expires_at",
    )
    assert read_counts(spark, state) is None
    late, early = ev.filter("_id > 'e3'"), ev.filter("_id <= 'e3'")  # the second micro-batch is older than the first
    for epoch, part in ((0, late), (1, early), (1, early)):
        keep_counts(state, part, epoch, "day")
    want = rollups.stats(ev, "day", "2026-06-11", "2026-06-12")
    assert read_counts(spark, state).select(want.columns).collect() == want.collect()
    assert want.head().total == 60_000


def test_arrivals_of_the_registered_tail_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(8).write.parquet(f"{tmp_path}/sf/events.parquet")
    monkeypatch.setattr(registry, "shared_path", lambda session, name: f"{tmp_path}/{name}")
    with_many = registry.QUERIES["stream_tail"](spark, f"{tmp_path}/sf").collect()
    assert len(files.listed(spark, f"{tmp_path}/arrivals")) > 8  # four arrivals, one task each before
    assert [r.arrived for r in with_many] == sorted((r.arrived for r in with_many), reverse=True) and len({r._id for r in with_many}) == len(with_many) == 30
