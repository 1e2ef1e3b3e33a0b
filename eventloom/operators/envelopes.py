"""Posted bodies to events: checks, defaults, stamps.

A body is one envelope or an array of envelopes and is admitted or rejected as a
whole.  All checks run inside the row that holds the body (at most 1 MB and 500
envelopes), so classifying and exploding batches needs no shuffle; the only join
is the source lookup.

Checks take SQL expression text (`v` a variant, `env` an envelope's
``map<string,variant>``) and give SQL for the reason, NULL when all is well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.functions.text import longer_than, sha_prefix, utf16_head, utf16_units
from eventloom.functions.times import expires_at, iso
from eventloom.functions.values import (
    as_array,
    as_object,
    as_text,
    deeper_than,
    get,
    json_kind,
    number_text,
    quote,
)
from eventloom.schema import DEFAULT_LEVEL, ENVELOPE_KEYS, EVENT_COLUMNS, LEVELS, Limits

LIMITS = Limits()

# The reasons senders see.
REASONS = {
    "source": "unauthorized",
    "mode": "write key required",
    "body": "request body too large",
    "json": "request body is not valid JSON",
    "empty": "empty batch",
    "batch": "batch exceeds {max_batch} events",
    "object": "event envelope must be a JSON object",
    "key": 'unknown key "',
    "event": "event is required and must be a non-empty string",
    "event_long": "event exceeds {max_event_chars} chars",
    "event_control": "event must not contain control characters",
    "level": "level must be one of debug|info|warn|error",
    "ts": "ts must be a Date.parse-able string",
    "message": "message must be a string",
    "ids": "ids must be a plain object",
    "ids_depth": "ids nesting exceeds {max_depth} levels",
    "ids_keys": "ids exceeds {max_ids_keys} keys",
    "ids_value": " must be a string, number, or boolean",
    "data": "data must be a plain object",
    "data_depth": "data nesting exceeds {max_depth} levels",
}


def _reason(name: str, limits: Limits = LIMITS) -> str:
    return quote(REASONS[name].format(**vars(limits)))


def _first(*checks: tuple[str, str]) -> str:
    """The reason of the first condition that holds."""
    return "case " + " ".join(f"when {broken} then {reason}" for broken, reason in checks) + " end"


def _names(values) -> str:
    return ", ".join(quote(v) for v in values)


def check_object(v: str) -> str:
    """Reason when an envelope is not a JSON object."""
    return _first((f"{as_object(v)} is null", _reason("object")))


def check_keys(env: str) -> str:
    """Reason that names a key outside the envelope."""
    unknown = f"array_except(map_keys({env}), array({_names(ENVELOPE_KEYS)}))"
    return _first((f"size({unknown}) > 0", f"concat({_reason('key')}, {unknown}[0], '\"')"))


def check_event(v: str, limits: Limits = LIMITS) -> str:
    """Reason when `event` is missing, not text, empty, too long or has control characters."""
    text = as_text(v)
    return _first(
        (f"coalesce({json_kind(v)} <> 'string' or {text} = '', true)", _reason("event")),
        (longer_than(text, limits.max_event_chars), _reason("event_long", limits)),
        (f"{text} rlike {quote('[' + chr(92) + 'x00-' + chr(92) + 'x1f]')}", _reason("event_control")),
    )


def check_level(v: str) -> str:
    """Reason when `level` is present but not one of the levels."""
    good = f"{json_kind(v)} = 'string' and {as_text(v)} in ({_names(LEVELS)})"
    return _first((f"{v} is not null and not ({good})", _reason("level")))


def norm_level(v: str) -> str:
    """The level, or the default when absent."""
    return f"coalesce({as_text(v)}, {quote(DEFAULT_LEVEL)})"


def check_ts(v: str) -> str:
    """Reason when `ts` is present but not an ISO-8601 date in text."""
    # Spark alone would also take a bare time of day.
    dated = f"{as_text(v)} rlike '^[-+]?[0-9]{{4,6}}($|-)' and try_to_timestamp({as_text(v)}) is not null"
    good = f"{json_kind(v)} = 'string' and {dated}"
    return _first((f"{v} is not null and not ({good})", _reason("ts")))


def check_message(v: str) -> str:
    """Reason when `message` is present but not text."""
    return _first((f"{v} is not null and {json_kind(v)} <> 'string'", _reason("message")))


def norm_message(v: str, limits: Limits = LIMITS) -> str:
    """The message, cut to its maximum length."""
    return utf16_head(as_text(v), limits.max_message_chars)


def check_ids(v: str, limits: Limits = LIMITS) -> str:
    """Reason when `ids` is not a flat object of at most ten scalars."""
    entries = as_object(v)
    bad = f"map_keys(map_filter({entries}, (k, x) -> {json_kind('x')} not in ('string', 'number', 'boolean')))"
    reason = _first(
        (f"{entries} is null", _reason("ids")),
        (f"size({bad}) > 0 and {deeper_than(f'to_json({v})', limits.max_depth)}", _reason("ids_depth", limits)),
        (f"size({entries}) > {limits.max_ids_keys}", _reason("ids_keys", limits)),
        (f"size({bad}) > 0", f"concat('ids.', {bad}[0], {_reason('ids_value')})"),
    )
    return f"if({v} is null, null, {reason})"


def norm_ids(v: str) -> str:
    """`ids` with every value as text; numbers print as JSON numbers do."""
    number = number_text(get("x", "$", "double"))
    return f"transform_values({as_object(v)}, (k, x) -> if({json_kind('x')} = 'number', {number}, {as_text('x')}))"


def check_data(v: str, limits: Limits = LIMITS) -> str:
    """Reason when `data` is not an object or nests too deep."""
    reason = _first(
        (f"{as_object(v)} is null", _reason("data")),
        (deeper_than(f"to_json({v})", limits.max_depth), _reason("data_depth", limits)),
    )
    return f"if({v} is null, null, {reason})"


def truncate_data(v: str, raw: str, limits: Limits = LIMITS) -> str:
    """`data`, or a stub with its original size and head when it is oversize.

    `raw` is the JSON text in the sender's key order; it is only looked at when
    the value is oversize.
    """
    stub = (
        f"to_variant_object(named_struct('_truncated', true, '_originalBytes', {utf16_units(raw)}, "
        f"'_head', {utf16_head(raw, limits.head_chars)}))"
    )
    return f"if({longer_than(f'to_json({v})', limits.max_data_units)}, {stub}, {v})"


def envelope_reason(env: str, limits: Limits = LIMITS) -> str:
    """Why an envelope is invalid, in the order checks are made; `env` is NULL for non-objects."""
    item = {k: f"{env}[{quote(k)}]" for k in ENVELOPE_KEYS}
    checks = [
        check_keys(env),
        check_event(item["event"], limits),
        check_level(item["level"]),
        check_ts(item["ts"]),
        check_message(item["message"]),
        check_ids(item["ids"], limits),
        check_data(item["data"], limits),
    ]
    return f"if({env} is null, {_reason('object')}, coalesce({', '.join(checks)}))"


def _items(v: str) -> str:
    """A body's envelopes: the array's items, or the lone value."""
    return f"coalesce({as_array(v)}, if({v} is null, null, array({v})))"


def explode_batches(df: DataFrame) -> DataFrame:
    """One row per envelope of each body, with its position; a lone object is position 0.

    Bodies that are not JSON give no rows.
    """
    kept = [c for c in df.columns if c != "body"]
    parsed = df.selectExpr(*kept, "try_parse_json(body) as _value")
    return parsed.selectExpr(*kept, f"posexplode({_items('_value')}) as (pos, envelope)")


def stamp_source(df: DataFrame, sources: DataFrame) -> DataFrame:
    """`app` and `env` of each batch's source, with a reason for unknown or read-only sources.

    The registry is joined without a hint: Spark broadcasts it when its size is
    known to be small.  When it is not, the batches of a source are dealt over
    as many parts as a shuffle has, each of which meets a copy of the source's
    row, so few sources never put whole bodies into few tasks.
    """
    reason = _first(
        ("app is null", _reason("source")), ("coalesce(mode <> 'write', true)", _reason("mode"))
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = sources.selectExpr("source_id", "app", "env", "mode", f"explode(sequence(0, {parts - 1})) as _part")
    dealt = df.selectExpr("*", f"cast(pmod(xxhash64(batch_id), {parts}) as int) as _part")
    return dealt.join(known, ["source_id", "_part"], "left").drop("_part").selectExpr("*", f"{reason} as reason")


def derive_id(app: str, received_at: str, seq: str, envelope: str) -> str:
    """Event id: equal inputs always give the same id, so replays collapse."""
    return sha_prefix(f"concat_ws('\\n', {app}, {iso(received_at)}, {seq}, {envelope})", 32)


def batch_seq(batch_id: str, pos: str) -> str:
    """What tells identical envelopes of one instant apart, stable when a task is retried."""
    return f"concat_ws('-', {batch_id}, {pos})"


def check_batches(df: DataFrame, sources: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Batches with their parsed envelopes and the verdict: ``reason`` and ``index``.

    `reason` is NULL for admitted batches; `index` is the position of the first
    bad envelope, or NULL when the batch as a whole is at fault.
    """
    fits = f"octet_length(body) <= {limits.max_body_bytes}"
    whole = _first(
        (f"not ({fits})", _reason("body")),
        ("_value is null", _reason("json")),
        ("size(_items) = 0", _reason("empty")),
        (f"size(_items) > {limits.max_batch}", _reason("batch", limits)),
    )
    kept = ["batch_id", "source_id", "received_at", "body", "app", "env"]
    return (
        stamp_source(df, sources)
        .selectExpr(*kept, "reason", f"if(reason is null and {fits}, try_parse_json(body), null) as _value")
        .selectExpr(*kept, "reason", "_value", f"{_items('_value')} as _items")
        .selectExpr(*kept, f"coalesce(reason, {whole}) as reason", "_items")
        .selectExpr("*", f"if(reason is null, transform(_items, e -> {as_object('e')}), null) as _envs")
        .selectExpr("*", f"transform(_envs, e -> {envelope_reason('e', limits)}) as _reasons")
        .selectExpr("*", "nullif(array_position(transform(_reasons, r -> r is not null), true), 0) - 1 as _bad")
        .selectExpr(*kept, "_envs", "coalesce(reason, get(_reasons, cast(_bad as int))) as reason", "cast(_bad as int) as index")
    )


# Both sides pick their batches inside an explode rather than by a filter: a
# filter on `reason` would be pushed below the checks and evaluate them again.


def rejected(checked: DataFrame) -> DataFrame:
    """``batch_id, index, error`` of the batches that were not admitted."""
    verdict = "named_struct('batch_id', batch_id, 'index', index, 'error', reason)"
    return checked.selectExpr(f"inline(if(reason is null, null, array({verdict})))")


def accepted(checked: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Events of the admitted batches, in stored form."""
    stamped = ["batch_id", "pos", "received_at", "app", "env"]
    rows = checked.selectExpr(
        "batch_id", "received_at", "body", "app", "env",
        "posexplode(if(reason is null, _envs, null)) as (pos, _env)",
    )
    rows = rows.selectExpr(*stamped, "body", *[f"_env[{quote(k)}] as _{k}" for k in ENVELOPE_KEYS])
    # An array's items are addressed by position; only oversize data is ever read this way.
    raw = "get_json_object(body, if(ltrim(body) like '[%', concat('$[', pos, '].data'), '$.data'))"
    rows = rows.selectExpr(
        *stamped,
        f"{as_text('_event')} as event",
        f"{norm_level('_level')} as level",
        f"{as_text('_ts')} as ts",
        f"{norm_message('_message', limits)} as message",
        f"{norm_ids('_ids')} as ids",
        f"{truncate_data('_data', raw, limits)} as data",
    )
    envelope = "to_json(struct(event, level, ts, message, ids, data))"
    return rows.selectExpr(
        f"{derive_id('app', 'received_at', batch_seq('batch_id', 'pos'), envelope)} as _id",
        *[c for c in EVENT_COLUMNS if c not in ("_id", "expires_at")],
        f"{expires_at('received_at', 'level', limits.ttl_days)} as expires_at",
    )


def normalize(df: DataFrame, sources: DataFrame, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """Batches ``batch_id, source_id, received_at, body`` to (accepted events, rejected batches)."""
    checked = check_batches(df, sources, limits)
    return accepted(checked, limits), rejected(checked)
