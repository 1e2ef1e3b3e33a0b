"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the semantics depend on: buckets are UTC, sender data may
# repeat a key (the last one counts), and malformed input must never throw.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Runtime settings for plan quality; AQE coalesces small shuffles, splits skewed
# ones and turns joins into broadcasts from sizes it has measured.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

_local_roots: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings this package relies on to a session, and return it."""
    for key, value in {**SETTINGS, **TUNING}.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may leave it unset; it then gets a
    temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.conf.get("spark.app.id", "")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_roots[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_root`."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
