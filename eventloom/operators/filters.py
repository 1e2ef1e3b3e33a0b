"""The shared filter surface and project scope.

The texts of its errors are fixed values that readers already know.

Filters take the parameter names readers already use (``app``, ``level``,
``event``, ``from``, ``to``, ``q``, ``ids.<key>``, ``data.<path>``,
``data.<path>__gte``, ``data.<path>__lte``) as a mapping or as ordered pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.times import check_window, instant, lit_instant
from eventloom.functions.values import BOOLEAN, NUMBER, STRING, parts, quote
from eventloom.schema import INDEXED_IDS, LEVELS, QUERY_TEXT_MAX

# Fixed value: what counts as a number in a filter.
NUMERIC_PARAM = re.compile(r"^-?\d+(\.\d+)?$", re.ASCII)
Params = Mapping | Iterable[tuple[str, object]]


def pairs(params: Params | None) -> list[tuple[str, object]]:
    """Parameters as ordered pairs."""
    if params is None:
        return []
    return list(params.items()) if isinstance(params, Mapping) else list(params)


class DataTerm:
    """What the parameters so far require of one `data` path.

    An equality is a set of accepted values and a range a set of bounds.  A
    later parameter on the same path replaces what was there, with one
    exception: a range joins an equality that accepts several types.
    """

    def __init__(self):
        self.accepted: list | None = None
        self.bounds: dict[str, float] = {}

    def equal(self, raw: str) -> None:
        self.bounds = {}
        if NUMERIC_PARAM.match(raw):
            self.accepted = [float(raw), raw]
        elif raw in ("true", "false"):
            self.accepted = [raw == "true", raw]
        else:
            self.accepted = [raw]

    def bound(self, side: str, value: float) -> None:
        if self.accepted is not None and len(self.accepted) == 1:
            self.accepted = None
        self.bounds[side] = value

    def predicate(self, rank: str, num: str, text: str) -> str:
        """SQL over the parts of the path's typed value."""
        tests = []
        if self.accepted is not None:
            options = []
            for v in self.accepted:
                if isinstance(v, bool):
                    options.append(f"({rank} = {BOOLEAN} and {num} = {int(v)})")
                elif isinstance(v, float):
                    options.append(f"({rank} = {NUMBER} and {num} = {v!r}D)")
                else:
                    options.append(f"({rank} = {STRING} and {text} = {quote(v)})")
            tests.append("(" + " or ".join(options) + ")")
        if self.bounds:
            tests.append(f"{rank} = {NUMBER}")
            tests += [f"{num} {'>=' if side == 'gte' else '<='} {v!r}D" for side, v in self.bounds.items()]
        return " and ".join(tests)


def _check_regex(spark: SparkSession, q: str) -> None:
    """Refuses what the engine that will run it cannot compile."""
    if len(q) > QUERY_TEXT_MAX:
        raise ValueError(f"q exceeds {QUERY_TEXT_MAX} chars")
    try:
        spark._jvm.java.util.regex.Pattern.compile(q)
    except (Py4JJavaError, IllegalArgumentException):
        raise ValueError("q is not a valid regular expression") from None


def _levels(raw) -> list[str]:
    tokens = raw.split(",") if isinstance(raw, str) else list(raw)
    for t in tokens:
        if t not in LEVELS:
            raise ValueError(f'invalid level "{t}"')
    return tokens


def window_predicate(ev: DataFrame, from_=None, to=None) -> Column:
    """``[from, to)`` on ``received_at``, with the partition bounds it implies.

    Catalyst does not derive ``event_date`` bounds from ``received_at``, so they
    are stated here wherever the log is partitioned by day.
    """
    tests = [F.lit(True)]
    dated = "event_date" in ev.columns
    if from_ is not None:
        tests.append(F.col("received_at") >= lit_instant(from_))
        if dated:
            tests.append(F.col("event_date") >= F.to_date(lit_instant(from_)))
    if to is not None:
        tests.append(F.col("received_at") < lit_instant(to))
        if dated:
            last = lit_instant(to) - F.expr("interval 1 microsecond")  # `to` itself is outside
            tests.append(F.col("event_date") <= F.to_date(last))
    return reduce(lambda a, b: a & b, tests)


def in_window(ev: DataFrame, from_, to) -> DataFrame:
    return ev.filter(window_predicate(ev, from_, to))


def after_predicate(ev: DataFrame, after: tuple) -> Column:
    """Rows that come after ``(received_at, _id)`` in newest-first order."""
    at, last_id = lit_instant(instant(after[0], "cursor")), after[1]
    older = (F.col("received_at") < at) | ((F.col("received_at") == at) & (F.col("_id") < last_id))
    # Implied by the line above, but only a plain bound prunes row groups and days.
    older = older & (F.col("received_at") <= at)
    if "event_date" in ev.columns:
        older = older & (F.col("event_date") <= F.to_date(at))
    return older


def event_prefix(*prefixes: str) -> Column:
    """Event names that start with any of the literal prefixes."""
    return reduce(lambda a, b: a | b, [F.col("event").startswith(p) for p in prefixes])


def predicate(ev: DataFrame, params: Params | None = None) -> Column:
    """One boolean column for all the given filter parameters; unknown names are errors."""
    simple: dict[str, Column] = {}
    data: dict[str, DataTerm] = {}
    bounds: dict[str, object] = {}

    for name, raw in pairs(params):
        if raw is None or name == "limit":  # a page size is not a filter
            continue
        if name in ("app", "env"):
            if raw == "":
                simple.pop(name, None)
            else:
                simple[name] = F.col(name) == raw
        elif name == "level":
            simple[name] = F.col("level").isin(_levels(raw))
        elif name == "event":
            simple[name] = event_prefix(raw)
        elif name in ("from", "to"):
            bounds[name] = instant(raw, name)
        elif name == "q":
            _check_regex(ev.sparkSession, raw)
            simple[name] = F.col("message").rlike("(?iu)" + raw)
        elif name == "after":
            simple[name] = after_predicate(ev, raw)
        elif name.startswith("ids.") and len(name) > len("ids."):
            key = name[len("ids.") :]
            simple[name] = F.col("ids").getItem(key) == str(raw)
            if key in INDEXED_IDS and "hot_ids" in ev.columns:
                simple[name] = (F.col(f"hot_ids.{key}") == str(raw)) & simple[name]
        elif name.startswith("data.") and len(name) > len("data."):
            side = name[-3:] if name.endswith(("__gte", "__lte")) else None
            key = name[: -len("__gte")] if side else name
            if len(key) <= len("data."):
                raise ValueError(f'unknown parameter "{name}"')
            text = raw if isinstance(raw, str) else ("true" if raw else "false") if isinstance(raw, bool) else str(raw)
            term = data.setdefault(key, DataTerm())
            if side is None:
                term.equal(text)
            elif NUMERIC_PARAM.match(text):
                term.bound(side, float(text))
            else:
                raise ValueError(f"{name} requires a numeric value")
        else:
            raise ValueError(f'unknown parameter "{name}"')

    if "from" in bounds and "to" in bounds:
        check_window(bounds["from"], bounds["to"])
    tests = [window_predicate(ev, bounds.get("from"), bounds.get("to")), *simple.values()]
    tests += [F.expr(term.predicate(*parts(ev, key))) for key, term in data.items()]
    return reduce(lambda a, b: a & b, tests)


def filter_events(ev: DataFrame, params: Params | None = None) -> DataFrame:
    """Events that satisfy every given parameter."""
    return ev.filter(predicate(ev, params))


def is_null(ev: DataFrame, by: str) -> Column:
    """Events in the null group of a field: the value is missing or null."""
    return F.expr(f"{parts(ev, by)[0]} is null")


def project_apps(projects: DataFrame, slug: str) -> list[str]:
    """Member apps of one project.  Unknown slugs are errors; a project has at most 200 apps."""
    row = projects.filter(F.col("slug") == slug).select("apps").head()
    if row is None:
        raise ValueError(f'unknown project "{slug}"')
    return list(row["apps"] or [])


def scope_project(ev: DataFrame, projects: DataFrame, slug: str, app: str | None = None) -> DataFrame:
    """Events whose app belongs to a project, narrowed to `app` when given.

    The member list is one dimension row of at most 200 short names, so it goes
    into the plan as a literal list: unlike a join it reaches the file scan as a
    pushed filter and costs no exchange.  An empty project matches nothing.
    """
    members = project_apps(projects, slug)
    if app:
        members = [app] if app in members else []
    return ev.filter(F.col("app").isin(members)) if members else ev.filter(F.lit(False))


def scope(ev: DataFrame, app: str | None = None, projects: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """App and project scope of the windowed queries; an empty `app` means all apps."""
    if project is not None:
        if projects is None:
            raise ValueError("project scope needs the projects table")
        return scope_project(ev, projects, project, app)
    return ev.filter(F.col("app") == app) if app else ev
