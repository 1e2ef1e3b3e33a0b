"""Aggregates of rollups: headline cards, strips, overview, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.times import resolve_window
from eventloom.functions.values import NUMBER, field, to_double
from eventloom.operators.filters import Params, event_prefix, in_window, scope
from eventloom.operators.rollups import groupby, job_failed, selected, top_values
from eventloom.schema import JOB_PREFIXES, SUGGEST_MAX

SLOW_MS = 300
USER_KEY = "userEmail"


def metric_cards(stats: DataFrame) -> DataFrame:
    """One row over time buckets: total, errors, error percent, cost, tokens, peak p95.

    Buckets without latency do not count towards the peak.
    """
    total, errors = F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("error"), F.lit(0))
    return stats.agg(
        total.alias("total"),
        errors.alias("errors"),
        F.when(total > 0, errors / total * 100).otherwise(F.lit(0.0)).alias("error_percent"),
        F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0.0)).alias("tokens"),
        F.max("p95").alias("peak_p95"),
    )


def stats_strip(stats: DataFrame) -> DataFrame:
    """One row over time buckets: total, cost, and error rate and p95 weighted by bucket totals.

    Buckets that lack a value do not weigh in.
    """

    def weighted(name: str):
        weight = F.sum(F.when(F.col(name).isNotNull(), F.col("total")))
        return F.when(weight > 0, F.sum(F.col(name) * F.col("total")) / weight)

    return stats.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0.0)).alias("cost_usd"),
        weighted("error_rate").alias("weighted_error_rate"),
        weighted("p95").alias("weighted_p95"),
    )


def cumulative_cost(stats: DataFrame, by: str | None = None) -> DataFrame:
    """Time buckets with running cost, per `by` when given.

    The input has one row per hour or day, so one ordered partition is small.
    """
    spec = Window.partitionBy(by) if by else Window.partitionBy()
    running = spec.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return stats.withColumn("cum_cost_usd", F.round(F.sum("cost_usd").over(running), 6))


def share_of_max(groups: DataFrame, with_other: bool = True) -> DataFrame:
    """Top groups with their rounded percent of the largest; the rest counts as a bar if `with_other`."""
    whole = Window.partitionBy()  # over at most 100 shown groups
    top = F.max("count").over(whole)
    if with_other:
        top = F.greatest(top, F.max("other_count").over(whole))
    return groups.withColumn("share_percent", F.round(100 * F.col("count") / F.greatest(top, F.lit(1))).cast("int"))


def top_by(
    ev: DataFrame, user_key: str = USER_KEY, limit: int = 5, params: Params | None = None,
    projects=None, project=None, now=None,
) -> DataFrame:
    """Top apps, users and models in one table ``dim, value, count, share_percent``."""
    rows = selected(ev, params, projects, project, now)
    top = top_values(rows, dict.fromkeys(("app", f"ids.{user_key}", "data.model"), limit))
    most = F.greatest(F.max("count").over(Window.partitionBy("dim")), F.lit(1))  # `limit` rows each
    return top.select("dim", "value", "count", F.round(100 * F.col("count") / most).cast("int").alias("share_percent"))


def overview(
    ev: DataFrame, slow_ms: float = SLOW_MS, user_key: str = USER_KEY, prefixes=JOB_PREFIXES,
    from_=None, to=None, projects=None, project=None, now=None,
) -> DataFrame:
    """The landing page in one table ``section, name, value``.

    Section ``card`` has warnings and errors, cost, tokens, slow events, jobs
    and failing jobs; ``user`` the five and ``service`` the ten largest groups.
    Event-level cards, job cards and groups take one pass each.
    """
    start, end = resolve_window(from_, to, now)
    rows = scope(in_window(ev, start, end), None, projects, project)
    latency = field(rows, "data.latencyMs")
    cost, tokens_in, tokens_out = (
        to_double(field(rows, f"data.{k}"), 0) for k in ("costUsd", "inputTokens", "outputTokens")
    )
    cards = rows.selectExpr(
        "level in ('warn', 'error') as loud", f"{cost} as cost", f"{tokens_in} + {tokens_out} as tokens",
        f"coalesce({latency}.rank = {NUMBER} and {latency}.num >= {float(slow_ms)}D, false) as slow",
    ).selectExpr(
        "cast(count_if(loud) as double) as warn_error",
        "coalesce(round(sum(cost), 6), 0D) as cost_usd",
        "coalesce(sum(tokens), 0D) as tokens",
        "cast(count_if(slow) as double) as slow_events",
    )
    health = (
        rows.filter(event_prefix(*prefixes))
        .selectExpr("event", "received_at", "_id", f"{job_failed(rows)} as failed")
        .groupBy("event")
        .agg(F.max(F.struct("received_at", "_id", "failed")).alias("last"))
    )
    jobs = health.selectExpr("cast(count(*) as double) as jobs", "cast(count_if(last.failed) as double) as failing_jobs")

    def as_rows(df: DataFrame) -> DataFrame:
        return df.unpivot([], df.columns, "name", "value").select(F.lit("card").alias("section"), "name", "value")

    top = top_values(rows, {f"ids.{user_key}": 5, "app": 10})
    section = F.when(F.col("dim") == "app", "service").otherwise("user")
    return (
        as_rows(cards)
        .unionByName(as_rows(jobs))
        .unionByName(top.select(section.alias("section"), F.col("value").alias("name"), F.col("count").cast("double").alias("value")))
    )


def event_suggest(ev: DataFrame, app: str | None = None, typed: str = "") -> DataFrame:
    """Distinct event names, in one app or all, that contain the typed text; sorted."""
    names = scope(ev, app)
    if typed:
        names = names.filter(F.contains(F.lower("event"), F.lit(typed.lower())))
    return names.select("event").distinct().orderBy("event")


def value_suggest(ev: DataFrame, key: str, typed: str, params: Params | None = None, now=None) -> DataFrame:
    """The eight largest values of an id key that contain the typed text; none when nothing is typed."""
    typed = typed.strip()
    groups = groupby(ev, f"ids.{key}", SUGGEST_MAX, typed or None, params, now=now)
    out = groups.filter(F.col("kind") == "string").select("value", "count")
    return out if typed else out.limit(0)


def apps(ev: DataFrame) -> DataFrame:
    """All apps seen, sorted."""
    return ev.select("app").distinct().orderBy("app")
