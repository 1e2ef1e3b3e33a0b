"""Helpers the operators share: inputs, materialised steps, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df`, computed once into the shared folder and read back.

    The written table outlives lost executors and cuts the lineage, so later
    steps never repeat the work behind it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`written`; what the step shuffled is deleted once it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def doc_key(docs: DataFrame, column: str = "doc_id", text: str = "text") -> DataFrame:
    """The id and text of each row, null text as empty; every other column is left out."""
    return docs.select(F.col(column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def partitions_for(rows: int, per: int) -> int:
    """How many partitions hold `rows` rows, `per` in each at most on average."""
    return max(1, -(-rows // per))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected `edges` (a, b): node, component (its smallest node).

    Every node takes the smallest label among its neighbours and its own, then
    the label of its label; both steps aggregate map-side, so a node with very
    many neighbours costs one partial minimum per task.  Rounds go on until no
    label changes; each is written to the shared folder.  The number of rounds
    follows the logarithm of a component's width, one for stars.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), name)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("seen"))
        step = labels.join(near, "node").select("node", F.least("component", "seen").alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = step.join(jump, "component", "left").select(
            "node", F.least("component", F.coalesce("root", "component")).alias("component"), "was"
        )
        moved = written(moved, name)
        labels = moved.select("node", "component")
        if moved.filter("component <> was").isEmpty():
            return labels
