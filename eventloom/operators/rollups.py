"""Windowed rollups: time buckets, top groups, discovered names, job health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.times import bucket, resolve_window
from eventloom.functions.values import (
    IDENTIFIER,
    STRING,
    field,
    first_present,
    object_keys,
    quote,
    to_double,
    value_kind,
    value_text,
)
from eventloom.operators import percentiles
from eventloom.operators.filters import Params, event_prefix, filter_events, in_window, pairs, scope
from eventloom.schema import (
    FAILED_STATUSES,
    GROUPS_DEFAULT,
    GROUPS_MAX,
    JOB_PREFIXES,
    JOBS_MAX,
    LEVELS,
    LIKE_TEXT_MAX,
)

STATS_PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
JOBS_PERCENTILES = {"p50_ms": 0.5, "p95_ms": 0.95}


def measures(ev: DataFrame, *kept: str) -> DataFrame:
    """The numbers the time-bucket rollup needs, one narrow row per event, with the columns that are `kept`."""
    return ev.selectExpr(
        *kept,
        "received_at",
        "level",
        to_double(first_present(field(ev, "data.latencyMs"), field(ev, "data.durationMs"))) + " as latency",
        to_double(field(ev, "data.status")) + " as status",
        to_double(field(ev, "data.costUsd"), 0) + " as cost",
        to_double(field(ev, "data.inputTokens"), 0) + " as tokens_in",
        to_double(field(ev, "data.outputTokens"), 0) + " as tokens_out",
    )


def bucket_aggregates(latency: str | None = None) -> list:
    """Aggregates of one bucket, over :func:`measures`; `latency` is SQL for its percentiles, if they are among them."""
    out = ["count(*) as total"]
    out += [f"count_if(level = '{name}') as {name}" for name in LEVELS]
    if latency:
        out.append(f"{latency} as _latency")
    out += [
        "count(status) as _statuses",
        "count_if(status >= 400) as _status_errors",
        "round(sum(cost), 6) as cost_usd",
        "sum(tokens_in) as input_tokens",
        "sum(tokens_out) as output_tokens",
    ]
    return [F.expr(e) for e in out]


def bucket_columns(df: DataFrame, key: str = "bucket") -> DataFrame:
    """Final columns of the time-bucket rollup; `key` is SQL for the bucket."""
    latency = STATS_PERCENTILES
    if "_latency" in df.columns:
        latency = [f"_latency[{i}] as {p}" for i, p in enumerate(STATS_PERCENTILES)]
    return df.selectExpr(
        f"{key} as bucket",
        "total",
        *LEVELS,
        *latency,
        "if(_statuses > 0, _status_errors / _statuses, null) as error_rate",
        "cost_usd",
        "input_tokens",
        "output_tokens",
    )


def stats(
    ev: DataFrame, group: str = "hour", from_=None, to=None, app=None, event=None,
    projects=None, project=None, now=None, exact: bool = True,
) -> DataFrame:
    """Volume by level, latency percentiles, error rate, cost and tokens per UTC hour or day.

    One shuffle of per-bucket partial aggregates.  Percentiles are exact: among
    those aggregates where a count of every bucket's latencies shows that they
    may be held, else by :func:`eventloom.operators.percentiles.exact`.
    `exact=False` takes a bounded summary instead, for streams and quick looks.
    Buckets without events are absent; a bucket without latencies or statuses
    has NULL there.
    """
    start, end = resolve_window(from_, to, now)
    rows = scope(in_window(ev, start, end), app, projects, project)
    if event:
        rows = rows.filter(event_prefix(event))
    rows = measures(rows).selectExpr("*", f"{bucket('received_at', group)} as bucket")
    how = percentiles.approximate
    if exact:
        how = percentiles.held if percentiles.fits(rows, ["bucket"], "latency") else None
    totals = rows.groupBy("bucket").agg(*bucket_aggregates(how and how("latency", STATS_PERCENTILES.values())))
    if how is None:
        latency = percentiles.exact(rows, ["bucket"], F.col("latency"), STATS_PERCENTILES)
        totals = totals.join(latency, "bucket", "left")
    return bucket_columns(totals).orderBy("bucket")


def top_groups(counts: DataFrame, limit: int) -> DataFrame:
    """Groups by count, largest first, ties by value in kind order."""
    return counts.orderBy(F.desc("count"), F.asc_nulls_first("rank"), "num", "str").limit(limit)


def group_counts(ev: DataFrame, by: str) -> DataFrame:
    """Event count per typed value of a field; missing and null share one group."""
    return ev.selectExpr(f"{field(ev, by)} as t").groupBy("t.rank", "t.num", "t.str").agg(F.count("*").alias("count"))


def top_values(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The largest groups of several fields, from one scan: ``dim, value, count``, `limits` naming how many of each.

    Spark keeps only each task's largest groups of a field before they are
    ranked, so no task ever sees all values of one.
    """
    one = [f"named_struct('dim', {quote(by)}, 't', {field(rows, by)})" for by in limits]
    counts = rows.selectExpr(f"explode(array({', '.join(one)})) as d").groupBy("d.dim", "d.t.rank", "d.t.num", "d.t.str")
    order = Window.partitionBy("dim").orderBy(F.desc("count"), F.asc_nulls_first("rank"), "num", "str")
    ranked = counts.agg(F.count("*").alias("count")).withColumn("_nth", F.row_number().over(order))
    most = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    top = ranked.filter(F.col("_nth") <= max(limits.values())).filter(F.col("_nth") <= most[F.col("dim")])
    return top.selectExpr("dim", "count", "struct(rank, num, str) as t").selectExpr("dim", f"{value_text('t')} as value", "count")


def selected(ev: DataFrame, params: Params | None = None, projects=None, project=None, now=None) -> DataFrame:
    """Events that match parameters, in their window (by default the last 24 hours) and project."""
    given = [(k, v) for k, v in pairs(params) if k not in ("limit", "after")]
    start, end = resolve_window(dict(given).get("from"), dict(given).get("to"), now)
    given = [(k, v) for k, v in given if k not in ("from", "to")] + [("from", start), ("to", end)]
    rows = filter_events(ev, given)
    return rows if project is None else scope(rows, dict(given).get("app"), projects, project)


def groupby(
    ev: DataFrame, by: str, limit: int = GROUPS_DEFAULT, like: str | None = None, params: Params | None = None,
    projects=None, project=None, now=None,
) -> DataFrame:
    """Top groups of one field, each with the total over all groups and the rest not shown.

    Columns ``value, kind, count, total, other_count``.  `like` keeps groups
    whose text value contains it, ignoring case.  The total is a scalar subquery
    over the same grouped shuffle, so the log is scanned once and no task sees
    all groups.
    """
    if not by or not IDENTIFIER.match(by):
        raise ValueError("invalid by field")
    limit = min(max(int(limit), 1), GROUPS_MAX)
    if like is not None and len(like) > LIKE_TEXT_MAX:
        raise ValueError(f"like exceeds {LIKE_TEXT_MAX} chars")
    counts = group_counts(selected(ev, params, projects, project, now), by)
    if like:
        counts = counts.filter(f"rank = {STRING} and contains(lower(str), {quote(like.lower())})")
    total = counts.agg(F.sum("count")).scalar()
    shown = F.sum("count").over(Window.partitionBy())  # at most `limit` rows here
    return (
        top_groups(counts, limit)
        .withColumn("total", total)
        .selectExpr("count", "total", "struct(rank, num, str) as t")
        .selectExpr(f"{value_text('t')} as value", f"{value_kind('t')} as kind", "count", "total")
        .withColumn("other_count", F.greatest(F.lit(0), F.col("total") - shown))
    )


def facets(ev: DataFrame, from_=None, to=None, app=None, projects=None, project=None, now=None) -> DataFrame:
    """Distinct `ids` keys and top-level `data` keys in a window: ``kind, key``, sorted.

    One scan tags both key sets; duplicates collapse before the shuffle.
    """
    start, end = resolve_window(from_, to, now)
    rows = scope(in_window(ev, start, end), app, projects, project)
    tagged = [
        f"transform(coalesce({keys}, array()), k -> named_struct('kind', '{kind}', 'key', k))"
        for kind, keys in (("ids", "map_keys(ids)"), ("data", object_keys("data")))
    ]
    found = rows.selectExpr(f"explode(concat({', '.join(tagged)})) as f")
    return found.select("f.kind", "f.key").distinct().orderBy("kind", "key")


def event_names(ev: DataFrame, app=None, projects=None, project=None) -> DataFrame:
    """Distinct event names per app: ``app, event``, both sorted."""
    return scope(ev, app, projects, project).select("app", "event").distinct().orderBy("app", "event")


def job_failed(ev: DataFrame) -> str:
    """SQL for whether a job event is a failure: an error level, or a status that says so."""
    status = field(ev, "data.status")
    words = ", ".join(quote(w) for w in FAILED_STATUSES)
    return f"(level = 'error' or coalesce({status}.rank = {STRING} and lower({status}.str) in ({words}), false))"


def jobs(
    ev: DataFrame, prefixes=JOB_PREFIXES, from_=None, to=None, app=None,
    projects=None, project=None, now=None, exact: bool = True, fallback: bool = False, limit: int | None = JOBS_MAX,
) -> DataFrame:
    """Health per job event: runs, failures, success rate, last run, latency percentiles.

    Largest first, ties by name, a page of `limit` (None for all); `total_jobs`
    tells how many there are in all.  The last run is the greatest
    ``(received_at, _id)``, found by aggregation rather than a sort.  `fallback`
    lets `durationMs` stand in for a missing `latencyMs`.
    """
    start, end = resolve_window(from_, to, now)
    rows = scope(in_window(ev, start, end).filter(event_prefix(*prefixes)), app, projects, project)
    latency = field(rows, "data.latencyMs")
    if fallback:
        latency = first_present(latency, field(rows, "data.durationMs"))
    runs = rows.selectExpr(
        "event as name", "received_at", "_id", f"{job_failed(rows)} as failed", f"{to_double(latency)} as latency"
    )
    out = ["count(*) as runs", "count_if(failed) as failures", "max(struct(received_at, _id, failed)) as _last"]
    how = percentiles.approximate
    if exact:
        how = percentiles.held if percentiles.fits(runs, ["name"], "latency") else None
    if how:
        out.append(how("latency", JOBS_PERCENTILES.values()) + " as _latency")
    health = runs.groupBy("name").agg(*[F.expr(e) for e in out])
    total = health.agg(F.count("*")).scalar()  # over the same shuffle
    if how is None:
        health = health.join(percentiles.exact(runs, ["name"], F.col("latency"), JOBS_PERCENTILES), "name", "left")
        latency = list(JOBS_PERCENTILES)
    else:
        latency = [f"_latency[{i}] as {p}" for i, p in enumerate(JOBS_PERCENTILES)]
    page = (
        health.selectExpr(
            "name",
            "_last.received_at as last_run_at",
            "if(_last.failed, 'failed', 'ok') as last_status",
            "runs",
            "failures",
            "round((runs - failures) / runs, 4) as success_rate",
            *latency,
        )
        .withColumn("total_jobs", total)
        .orderBy(F.desc("runs"), "name")
    )
    return page if limit is None else page.limit(limit)
