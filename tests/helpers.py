"""Small event logs for tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from eventloom.schema import EVENT_COLUMNS

T0 = "2026-06-11T00:00:00.000Z"


def log(spark, docs):
    """An event log from dictionaries; absent fields get defaults."""
    rows = []
    for i, d in enumerate(docs):
        ids = {k: str(v) for k, v in d["ids"].items()} if "ids" in d else None
        rows.append((
            d.get("_id", f"id-{i:03d}"), d.get("app", "a"), d.get("env", "prod"), d.get("event", "x"), d.get("level", "info"),
            d.get("ts"), d.get("message"), ids, json.dumps(d["data"]) if "data" in d else None,
            d.get("received_at", T0), d.get("expires_at", "2027-01-01T00:00:00Z"),
        ))
    schema = (
        "_id string, app string, env string, event string, level string, ts string, message string, "
        "ids map<string,string>, data string, received_at string, expires_at string"
    )
    df = spark.createDataFrame(rows, schema)
    return (
        df.withColumn("data", F.parse_json("data"))
        .withColumn("received_at", F.to_timestamp("received_at"))
        .withColumn("expires_at", F.to_timestamp("expires_at"))
        .select(*EVENT_COLUMNS)
    )


def ids(df):
    return [r["_id"] for r in df.select("_id").collect()]
