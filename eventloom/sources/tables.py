"""The driver tables as an event log, batches and documents.

One fixed projection of ``events`` plays the log.  Typed side columns come
straight from the table's columns; `data` is built from the same values, so a
query that stays on the side columns never builds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eventloom.functions.times import expires_at
from eventloom.functions.values import typed_number, typed_text
from eventloom.schema import HOT_KEYS, Limits

# Reading `ts` as an instant keeps time filters on the column itself, where they
# reach the file scan.
EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
NOW = "2024-01-16T00:00:00Z"
WHOLE = {"from": "2024-01-01T00:00:00Z", "to": "2024-03-01T00:00:00Z"}

PROJECTS = [("alpha", ["svc0", "svc1"]), ("beta", ["svc2"]), ("empty", [])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name == "events":
        reader = reader.schema(EVENTS)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as an event log."""
    return as_event_log(table(spark, sf_dir, "events"))


def stream_event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a stream of events."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return as_event_log(reader.parquet(sf_dir))


def as_event_log(events: DataFrame) -> DataFrame:
    """Rows of ``events`` in event-log form."""
    numbers = {
        "latencyMs": "case when event_type in ('view', 'purchase', 'error') then value end",
        "durationMs": "case when event_type = 'signup' then value end",
        "status": "case event_type when 'error' then 500 when 'purchase' then 200 end",
        "costUsd": "case when event_type = 'purchase' then round(value / 1000, 6) end",
        "inputTokens": "case when event_type = 'purchase' then event_id % 1000 end",
    }
    hot = ", ".join(f"'{k}', {typed_number(numbers[k]) if k in numbers else typed_text('null')}" for k in HOT_KEYS)
    data = ", ".join(f"'{k}', {e}" for k, e in numbers.items()) + ", 'k', cast(get_json_object(props, '$.k') as bigint)"
    return events.selectExpr(
        "lpad(cast(event_id as string), 12, '0') as _id",
        "concat('svc', user_id % 5) as app",
        "if(user_id % 2 = 0, 'prod', 'stg') as env",
        """case event_type when 'purchase' then 'ai.request' when 'signup' then 'cron.signup'
                           when 'error' then 'cron.sync' when 'view' then 'db.query' else 'http.click' end as event""",
        """case when event_type = 'error' then 'error' when value >= 100 then 'warn'
                when value < 5 then 'debug' else 'info' end as level""",
        "cast(null as string) as ts",
        "concat('event number ', event_id) as message",
        "map('userId', cast(user_id as string)) as ids",
        f"parse_json(to_json(named_struct({data}))) as data",
        "ts as received_at",
        f"named_struct({hot}) as hot",
    ).selectExpr("*", f"{expires_at('received_at', 'level', Limits().ttl_days)} as expires_at")


def project_table(spark: SparkSession) -> DataFrame:
    """The fixed projects of the driver data."""
    return spark.createDataFrame(PROJECTS, "slug STRING, apps ARRAY<STRING>")
