"""Event search: newest-first pages, keyset paging, live-tail merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.times import EPOCH, iso
from eventloom.operators.filters import Params, filter_events, pairs, scope
from eventloom.schema import EVENT_COLUMNS, PAGE_DEFAULT, PAGE_MAX, TAIL_MAX
from eventloom.session import shared_path


def newest(df: DataFrame, n: int) -> DataFrame:
    """The `n` newest events; a per-partition top-n and a merge, never a full sort."""
    return df.orderBy(F.desc("received_at"), F.desc("_id")).limit(n)


def page_limit(limit) -> int:
    """Page size clamped to 1..500."""
    try:
        return min(max(int(limit), 1), PAGE_MAX)
    except (TypeError, ValueError):
        raise ValueError(f'invalid limit "{limit}"') from None


def logs_page(
    ev: DataFrame, limit: int = PAGE_DEFAULT, after: tuple | None = None, params: Params | None = None,
    projects=None, project=None,
) -> DataFrame:
    """One page of matching events, newest first, with ``has_more``.

    `after` is the ``(received_at, _id)`` of the last row of the page before.
    One row beyond the page is fetched to know whether another page follows.
    """
    limit = page_limit(dict(pairs(params)).get("limit", limit))
    given = pairs(params) + ([("after", after)] if after is not None else [])
    rows = filter_events(ev, given)
    if project is not None:
        rows = scope(rows, dict(pairs(params)).get("app"), projects, project)
    if "event_date" in ev.columns:
        rows = _around_newest(rows, limit + 1)
    columns = [c for c in EVENT_COLUMNS if c in ev.columns]
    top = newest(rows.select(*columns), limit + 1)
    everything = Window.orderBy(F.desc("received_at"), F.desc("_id"))  # at most 501 rows here
    return (
        top.withColumn("_row", F.row_number().over(everything))
        .withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
        .filter(F.col("_row") <= limit)
        .orderBy("_row")
        .drop("_row")
    )


def _around_newest(rows: DataFrame, n: int) -> DataFrame:
    """Rows of a stored log from the instant of the n-th newest on.

    Day folders are opened newest first, twice as many each time, until they
    hold `n` rows; that pass reads instants and filter columns only.  Payloads
    are then read from the few days and row groups that hold the page.
    """
    days = sorted({d for f in rows.inputFiles() if (d := _day_of(f))}, reverse=True)
    many = 1
    while True:
        since = rows if many >= len(days) else rows.filter(F.col("event_date") >= F.lit(days[many - 1]).cast("date"))
        instants = since.select("received_at").orderBy(F.desc("received_at")).limit(n)
        seen = instants.select(F.unix_micros(F.min("received_at")).alias("at"), F.count("*").alias("n")).head()
        if seen["n"] >= n or many >= len(days):
            break
        many *= 2
    if seen["at"] is None:
        return rows.limit(0)
    at = F.timestamp_micros(F.lit(seen["at"]))
    return rows.filter((F.col("received_at") >= at) & (F.col("event_date") >= F.to_date(at)))


def _day_of(file: str) -> str | None:
    """The day in a table file's path."""
    found = re.search(r"/event_date=(\d{4}-\d\d-\d\d)/", file)
    return found and found[1]


def next_key(page: DataFrame) -> tuple | None:
    """Where the page after this one starts, or None at the end."""
    key = F.min(F.struct(F.unix_micros("received_at").alias("micros"), "_id"))
    last = page.filter("has_more").select(key.alias("k")).head()["k"]
    return None if last is None else (EPOCH + timedelta(microseconds=last["micros"]), last["_id"])


def walk_pages(
    ev: DataFrame, limit: int = PAGE_MAX, params: Params | None = None, projects=None, project=None,
) -> Iterator[DataFrame]:
    """Pages until none follows, in a project or all, for interactive readers; ties never repeat or drop rows.

    Each page is a read of the log; a whole walk at once is :func:`all_pages`.
    To move a whole result somewhere, write ``filter_events(...)`` instead.
    """
    after = None
    while True:
        page = logs_page(ev, limit, after, params, projects, project)
        yield page
        after = next_key(page)
        if after is None:
            return


def all_pages(
    ev: DataFrame, limit: int = PAGE_MAX, params: Params | None = None, projects=None, project=None,
) -> DataFrame:
    """The matching events with the number of their page in a walk, ``page``, from 0; the log is read twice, however many pages.

    A first read samples the order; rows are sorted over its ranges and written to the shared
    folder with their place in their range, so the places stay as they are when
    tasks run again; how many rows come before a range is a sum over a row per
    range.
    """
    limit = page_limit(dict(pairs(params)).get("limit", limit))
    rows = filter_events(ev, params)
    if project is not None:
        rows = scope(rows, dict(pairs(params)).get("app"), projects, project)
    order = [F.desc("received_at"), F.desc("_id")]
    ranged = rows.select(*[c for c in EVENT_COLUMNS if c in ev.columns]).repartitionByRange(*order).sortWithinPartitions(*order)
    path = shared_path(ev.sparkSession, "walk")
    ranged.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    placed = ev.sparkSession.read.parquet(path).withColumn("_range", F.shiftright("_at", 33))
    ranges = placed.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per task
    upto = F.sum("_n").over(Window.orderBy("_range"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        placed.join(ranges.select("_range", (upto - F.col("_n")).alias("_before")), "_range")
        .withColumn("page", F.floor(place / limit).cast("int"))
        .drop("_at", "_range", "_before")
    )


def trace(ev: DataFrame, key: str, value: str) -> DataFrame:
    """Everything one correlation id touched, across apps, in time order."""
    return filter_events(ev, {f"ids.{key}": value}).orderBy("received_at", "_id")


def exclude_page(tail: DataFrame, page: DataFrame) -> DataFrame:
    """Tail rows that are not already on the page."""
    return tail.join(page.select("_id"), "_id", "left_anti")


def tail_buffer(tail: DataFrame, n: int = TAIL_MAX) -> DataFrame:
    """The newest `n` distinct tail rows."""
    return newest(tail.dropDuplicates(["_id"]), n)


def merge_tail(page: DataFrame, tail: DataFrame, n: int = TAIL_MAX) -> DataFrame:
    """Page and newest tail rows together, each event once; the page's copy wins."""
    fresh = tail_buffer(exclude_page(tail, page), n)
    return page.unionByName(fresh.select(*page.columns)).orderBy(F.desc("received_at"), F.desc("_id"))


def to_api_json(df: DataFrame) -> DataFrame:
    """Events as one JSON document per row: reader field names, ISO instants, absent fields left out."""
    return df.selectExpr(f"{document_sql(df.columns)} as json")


def document_sql(columns) -> str:
    """SQL for the JSON document of an event with the given columns."""
    names = {"received_at": "receivedAt", "expires_at": "expiresAt"}
    parts = [f"'{names.get(c, c)}', {iso(c) if c in names else c}" for c in EVENT_COLUMNS if c in columns]
    return f"to_json(named_struct({', '.join(parts)}))"
