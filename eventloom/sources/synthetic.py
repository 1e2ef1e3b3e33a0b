"""Deterministic test events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gen_envelopes(spark: SparkSession, n: int, run_id: str = "run") -> DataFrame:
    """``n, envelope``: event by n%3, level by n%10 and n%5, latency n.

    The values are fixed; answers of the 250-event set depend on them.
    """
    n_ = F.col("n")
    event = F.when(n_ % 3 == 0, "ai.request").when(n_ % 3 == 1, "db.query").otherwise("cron.run")
    level = F.when(n_ % 10 == 0, "error").when(n_ % 5 == 0, "warn").otherwise("info")
    ai = n_ % 3 == 0
    data = F.struct(
        n_.alias("latencyMs"),
        F.when(n_ % 10 == 0, 500).otherwise(200).alias("status"),
        F.lit(0.01).alias("costUsd"),
        F.when(ai, 10).alias("inputTokens"),
        F.when(ai, 5).alias("outputTokens"),
    )
    envelope = F.struct(
        event.alias("event"),
        level.alias("level"),
        F.concat(F.lit("event number "), n_.cast("string")).alias("message"),
        F.struct(F.lit(run_id).alias("runId"), n_.cast("string").alias("n")).alias("ids"),
        data.alias("data"),
    )
    return spark.range(n).select(F.col("id").alias("n")).select("n", F.to_json(envelope).alias("envelope"))
