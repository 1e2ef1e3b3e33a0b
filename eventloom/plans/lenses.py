"""Named views over the filter surface, and drilling from a cell into a filter."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.operators.filters import Params, filter_events, is_null, pairs
from eventloom.operators.rollups import groupby
from eventloom.plans.dashboards import SLOW_MS, USER_KEY
from eventloom.schema import LEVELS

LENSES = ("errors", "ai-usage", "by-user", "by-service", "slow-ops", "cron")


def lens(name: str, base: Params | None = None, slow_ms: float = SLOW_MS, user_key: str = USER_KEY) -> dict:
    """A named view: ``{"params": filter parameters, "by": group field or None}``.

    The view's own parameters replace those of `base` with the same name.
    """
    own: dict[str, tuple[dict, str | None]] = {
        "errors": ({"level": "warn,error"}, None),
        "ai-usage": ({"event": "ai."}, None),
        "by-user": ({}, f"ids.{user_key}"),
        "by-service": ({}, "app"),
        "slow-ops": ({"data.latencyMs__gte": f"{slow_ms:g}"}, None),
        "cron": ({"event": "cron."}, None),
    }
    if name not in own:
        raise ValueError(f"unknown lens: {name}")
    params, by = own[name]
    return {"params": {**dict(pairs(base)), **params}, "by": by}


def apply_lens(ev: DataFrame, name: str, base: Params | None = None, now=None, **options) -> DataFrame:
    """Events of a view, or its groups when the view groups."""
    view = lens(name, base, **options)
    if view["by"]:
        return groupby(ev, view["by"], params=view["params"], now=now)
    return filter_events(ev, view["params"])


def drill(params: Params | None, by: str, value) -> dict:
    """Filter parameters narrowed to one cell of a breakdown by a field.

    ``None`` stands for the null group; :func:`drill_events` applies it.
    """
    out = dict(pairs(params))
    if by == "level" and value not in LEVELS:
        return out
    if value is None:
        return out
    out[by] = ("true" if value else "false") if isinstance(value, bool) else str(value)
    return out


def drill_events(ev: DataFrame, params: Params | None, by: str, value) -> DataFrame:
    """Events behind one cell of a breakdown, including the null group."""
    rows = filter_events(ev, drill(params, by, value))
    return rows.filter(is_null(ev, by)) if value is None else rows
