"""Column layout and fixed values of the event log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must be what senders and readers already rely on.
# ---------------------------------------------------------------------------

LEVELS = ("debug", "info", "warn", "error")
DEFAULT_LEVEL = "info"
ENVELOPE_KEYS = ("event", "level", "ts", "message", "ids", "data")

# Sort order of JSON value kinds, lowest first.
KIND_RANK = {"null": 1, "number": 2, "string": 3, "object": 4, "array": 5, "boolean": 8}

FAILED_STATUSES = ("error", "failed", "failure")
JOB_PREFIXES = ("cron.",)

# Keys of `data` that carry meaning for the rollups.  They are extracted into
# typed side columns at write time, so rollups never decode the variant.
HOT_KEYS = (
    "latencyMs",
    "durationMs",
    "status",
    "costUsd",
    "inputTokens",
    "outputTokens",
    "model",
)

# Correlation ids that are looked up by value; stored as columns of their own.
INDEXED_IDS = ("requestId", "taskId")

# Request/response key pairs of a payload, in priority order.
PAYLOAD_PAIRS = (
    ("request", "response"),
    ("req", "res"),
    ("prompt", "completion"),
    ("input", "output"),
    ("messages", "output"),
)

# Time range presets, in seconds.
RANGE_PRESETS = {"15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "7d": 604800}

SENSITIVE_KEYS = "password|secret|token|apikey|api_key|authorization"

DEFAULT_WINDOW_SECONDS = 86400
PAGE_DEFAULT, PAGE_MAX = 100, 500
GROUPS_DEFAULT, GROUPS_MAX = 20, 100
JOBS_MAX = 200
SUGGEST_MAX = 8
TAIL_MAX = 30
QUERY_TEXT_MAX = 256
LIKE_TEXT_MAX = 128


@dataclass(frozen=True)
class Limits:
    """Admission limits of the ingest path (fixed default values)."""

    max_body_bytes: int = 1_048_576
    max_batch: int = 500
    max_event_chars: int = 200
    max_message_chars: int = 512
    max_ids_keys: int = 10
    max_data_units: int = 65_536
    max_depth: int = 32
    head_chars: int = 4096
    ttl_days: dict = field(default_factory=lambda: {"debug": 7, "info": 30, "warn": 90, "error": 90})


# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

# One JSON value in groupable, sortable, filterable form: `rank` is NULL for a
# missing or null value; numbers and booleans are in `num`, text (or the JSON
# text of containers) in `str`.
TYPED_VALUE = T.StructType(
    [
        T.StructField("rank", T.IntegerType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("str", T.StringType()),
    ]
)

HOT_SCHEMA = T.StructType([T.StructField(k, TYPED_VALUE) for k in HOT_KEYS])

HOT_IDS_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in INDEXED_IDS])

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("_id", T.StringType(), False),
        T.StructField("app", T.StringType(), False),
        T.StructField("env", T.StringType(), False),
        T.StructField("event", T.StringType(), False),
        T.StructField("level", T.StringType(), False),
        T.StructField("ts", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("ids", T.MapType(T.StringType(), T.StringType())),
        T.StructField("data", T.VariantType()),
        T.StructField("received_at", T.TimestampType(), False),
        T.StructField("expires_at", T.TimestampType(), False),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# What the table on disk holds: the event, the typed side columns and the
# partition column.
STORE_COLUMNS = [*EVENT_COLUMNS, "hot", "hot_ids", "event_date"]

BATCH_SCHEMA = "batch_id STRING, source_id STRING, received_at TIMESTAMP, body STRING"
SOURCE_SCHEMA = "source_id STRING, app STRING, env STRING, mode STRING"
PROJECT_SCHEMA = (
    "slug STRING, name STRING, name_lower STRING, apps ARRAY<STRING>, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)
