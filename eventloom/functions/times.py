"""Instants, windows and time buckets.  All times are UTC."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.schema import DEFAULT_WINDOW_SECONDS, RANGE_PRESETS

GROUPS = ("hour", "day")
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def instant(raw, name: str = "instant") -> datetime:
    """A driver-side instant from a datetime, ISO-8601 text or epoch milliseconds."""
    if isinstance(raw, datetime):
        return raw if raw.tzinfo else raw.replace(tzinfo=timezone.utc)
    if isinstance(raw, int) or (isinstance(raw, str) and raw.isascii() and raw.isdigit()):
        return EPOCH + timedelta(milliseconds=int(raw))
    try:
        parsed = datetime.fromisoformat(raw)
    except (TypeError, ValueError):
        # Fixed values, here and below: texts that readers already know.
        raise ValueError(f'invalid {name} "{raw}" (ISO-8601 or epoch-ms expected)') from None
    return parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)


def check_window(from_: datetime, to: datetime) -> None:
    if from_ >= to:
        raise ValueError("from must be earlier than to (got an inverted or empty time window)")


def resolve_window(from_=None, to=None, now=None) -> tuple[datetime, datetime]:
    """Half-open window ``[from, to)``: `to` defaults to now, `from` to a day before `to`."""
    end = instant(to, "to") if to is not None else instant(now or datetime.now(timezone.utc))
    start = instant(from_, "from") if from_ is not None else end - timedelta(seconds=DEFAULT_WINDOW_SECONDS)
    check_window(start, end)
    return start, end


def preset_window(preset: str, now) -> tuple[datetime, datetime]:
    """Window of a named range preset ending at `now`."""
    if preset not in RANGE_PRESETS:
        raise ValueError(f"unknown range preset: {preset}")
    end = instant(now)
    return end - timedelta(seconds=RANGE_PRESETS[preset]), end


def lit_instant(value: datetime) -> Column:
    """A timestamp literal that does not depend on the driver's local zone."""
    return F.lit(value.astimezone(timezone.utc)).cast("timestamp")


def bucket(ts: str, unit: str) -> str:
    """SQL for the start of the UTC hour or day."""
    if unit not in GROUPS:
        raise ValueError(f"group must be one of: {', '.join(GROUPS)}")
    return f"date_trunc('{unit}', {ts})"


def parse_instant(text: str) -> str:
    """SQL for the timestamp of text holding ISO-8601 or epoch milliseconds; NULL if neither."""
    return f"if({text} rlike '^[0-9]+$', timestamp_millis(try_cast({text} as bigint)), try_to_timestamp({text}))"


def iso(ts: str) -> str:
    """SQL for ISO-8601 text with milliseconds and ``Z``."""
    return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSSXXX\")"


def expires_at(received_at: str, level: str, ttl_days: dict) -> str:
    """SQL for ``received_at`` plus the level's retention; fractions of a day are allowed."""
    whens = " ".join(f"when '{name}' then {int(days * 86_400_000_000)}" for name, days in ttl_days.items())
    return f"timestamp_micros(unix_micros({received_at}) + case {level} {whens} end)"
