"""Delivery and load audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import percentiles


def missing_keys(acked: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Acknowledged keys that the store does not hold."""
    return acked.select(key).distinct().join(store.select(key), key, "left_anti")


def duplicate_keys(store: DataFrame, key: str) -> DataFrame:
    """Keys the store holds more than once, with their count."""
    return store.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def delivery_audit(acked: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """One row: acknowledged, stored, missing and duplicated keys.

    Both sides are counted per key before they meet, so each key joins at most
    one row on either side however often it was sent or stored.
    """
    sent = acked.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("sent"))
    held = store.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("held"))
    return sent.join(held, key, "full").agg(
        F.count("sent").alias("acked"),
        F.count("held").alias("found"),
        F.count_if(F.col("sent").isNotNull() & F.col("held").isNull()).alias("missing"),
        F.count_if(F.col("held") > 1).alias("duplicates"),
    )


def load_summary(requests: DataFrame, elapsed_ms: float) -> DataFrame:
    """One row over requests ``sent, accepted, ok, ack_ms``: counts, throughput, ack percentiles.

    Percentiles are exact nearest-rank over acknowledged requests.
    """
    rows = requests.selectExpr("0 as run", "sent", "ok", "if(ok, accepted, 0) as accepted", "if(ok, ack_ms, null) as ack_ms")
    counts = rows.agg(
        F.sum("sent").alias("sent"),
        F.sum("accepted").alias("accepted"),
        F.count_if("ok").alias("acked"),
        F.count_if(~F.col("ok")).alias("errors"),
    )
    acks = percentiles.exact(rows, ["run"], F.col("ack_ms"), {"ack_p50_ms": 0.5, "ack_p99_ms": 0.99})
    # Two rows with each column filled once, folded into one.
    both = counts.unionByName(acks.drop("run"), allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    seconds = max(1.0, float(elapsed_ms)) / 1000
    return one.selectExpr(
        "sent", "accepted", "acked", "errors",
        f"round(accepted / {seconds}D, 1) as throughput_per_sec",
        "round(ack_p50_ms, 3) as ack_p50_ms",
        "round(ack_p99_ms, 3) as ack_p99_ms",
    )
