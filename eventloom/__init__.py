"""Structured-event log analytics on Spark.

Everything here takes DataFrames and gives DataFrames.  An *event log* is any
DataFrame with the columns of :data:`eventloom.schema.EVENT_SCHEMA`; the
operators in :mod:`eventloom.operators` query it, :mod:`eventloom.sources` reads
and writes it, :mod:`eventloom.streaming` keeps it fed, and
:mod:`eventloom.plans` composes the dashboard rollups.
"""

from eventloom.session import configure

__all__ = ["configure"]
