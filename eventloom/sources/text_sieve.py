"""Which grams the texts of each data file have, kept beside the event table, so that text searches open few files.

`<table>__grams/event_date=<day>/` has Bloom filters of one hash: bitmaps of the
grams of the messages and of the payloads of a data file, cut into buckets of
32,768 bits, of which a lookup reads only those its grams fall into.  A file
without all mandatory grams of a search holds no hit and is not opened; the
others are read and matched as ever, so a search gives the same rows with and
without a sieve.  The sieve follows the event table as
:mod:`eventloom.sources.beside` says; data files it does not know are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import grams
from eventloom.functions.times import instant
from eventloom.functions.values import quote
from eventloom.operators import documents
from eventloom.operators.filters import Params, filter_events, in_window, pairs
from eventloom.schema import EVENT_SCHEMA
from eventloom.sources import beside, files
from eventloom.sources.store import STORE_SCHEMA, read_events

#: Bits of a data file's bitmap for one kind of text, and of one bucket (Spark's own size of a bitmap).
BITS, BUCKET = 1 << 18, 32768
#: Characters whose grams are taken at a time.
PIECE = 64
KEYS = ["file", "field", "bucket"]
SCHEMA = "file string, field string, bucket int, bits binary"
_READ = T.StructType([f for f in EVENT_SCHEMA.fields if f.name in ("message", "ids", "data")])


def root(path: str) -> str:
    return f"{path.rstrip('/')}__grams"


def _place(gram: str) -> str:
    return f"pmod(xxhash64({gram}), {BITS})"


def bitmaps(spark: SparkSession, data_files: list[str]) -> DataFrame:
    """The sieve's rows of some data files; each file has one row of its own (bucket -1) even where it has no text."""
    # short numbers stand for names and fields where a row is a gram
    ev = spark.read.schema(_READ).parquet(*data_files).withColumn("_file", F.expr(f"xxhash64({beside.NAME})"))
    payload = "concat_ws(' ', to_json(ids), to_json(data))"
    kinds = f"inline(array(named_struct('_field', 0, 'text', message), named_struct('_field', 1, 'text', {payload})))"
    texts = ev.selectExpr("_file", kinds).selectExpr("_file", "_field", f"{grams.folded('text')} as text")
    # pieces overlap, so that no gram is cut
    cut = f"(?s)(?=(.{{1,{PIECE + grams.GRAM - 1}}})).{{1,{PIECE}}}"
    pieces = texts.select("_file", "_field", F.explode(F.regexp_extract_all("text", F.lit(cut), F.lit(1))).alias("piece"))
    starts = f"sequence(1, length(piece) - {grams.GRAM - 1})"
    placed = pieces.filter(f"length(piece) >= {grams.GRAM}").selectExpr(
        "_file", "_field", f"explode(transform({starts}, i -> cast({_place(f'substring(piece, i, {grams.GRAM})')} as int))) as place"
    )
    # each task sends a file's places once, so what moves is bounded by the bitmaps and not by the texts
    each = placed.distinct().selectExpr("_file", "_field", f"cast(place div {BUCKET} as int) as bucket", f"cast(place % {BUCKET} as long) as bit")
    maps = each.groupBy("_file", "_field", "bucket").agg(F.expr("bitmap_construct_agg(bit) as bits"))
    known = spark.createDataFrame([(beside.name(f),) for f in data_files], "file string")
    # names that share a number share their bits, which only opens more files
    named = maps.join(known.selectExpr("file", "xxhash64(file) as _file"), "_file")
    named = named.selectExpr("file", "if(_field = 0, 'message', 'payload') as field", "bucket", "bits")
    return named.unionByName(known.selectExpr("file", "'' as field", "-1 as bucket", "cast(null as binary) as bits"))


def update(spark: SparkSession, path: str, days: Iterable) -> None:
    """Adds the bitmaps of those data files of the days that the sieve does not have."""
    beside.follow(spark, path, root(path), days, SCHEMA, KEYS, lambda new: bitmaps(spark, new), ["field", "bucket"])


def _holding(spark: SparkSession, kept: list[str], field: str, need: grams.Need) -> set[str]:
    """Names of the data files that have what the need asks for."""
    wanted = grams.grams_of(need)
    # where the grams lie: a row per gram of the expression
    spots = spark.createDataFrame([(g,) for g in wanted], "gram string").selectExpr("gram", f"{_place('gram')} as place").collect()
    at = {r["gram"]: (r["place"] // BUCKET, r["place"] % BUCKET) for r in spots}
    names = {g: f"g{i}" for i, g in enumerate(wanted)}

    def set_in(bucket: int, bit: int) -> str:
        return f"bucket = {bucket} and getbit(cast(conv(hex(substring(bits, {bit // 8 + 1}, 1)), 16, 10) as int), {bit % 8}) = 1"

    rows = spark.read.schema(SCHEMA).parquet(*kept).filter((F.col("field") == field) & F.col("bucket").isin(sorted({b for b, _ in at.values()})))
    per_file = rows.groupBy("file").agg(*[F.expr(f"bool_or({set_in(*at[g])})").alias(names[g]) for g in wanted])
    return {r["file"] for r in per_file.filter(grams.holds(need, names.__getitem__)).select("file").collect()}


def _days(spark: SparkSession, path: str, from_=None, to=None) -> list[date]:
    """The days of the table that a window touches."""
    mark = "event_date="
    held = [date.fromisoformat(n[len(mark) :]) for f in files.listed(spark, path) if (n := f.rsplit("/", 1)[-1]).startswith(mark) and n[len(mark) :] != "__HIVE_DEFAULT_PARTITION__"]
    first = instant(from_, "from").date() if from_ is not None else date.min
    last = (instant(to, "to") - timedelta(microseconds=1)).date() if to is not None else date.max
    return [d for d in held if first <= d <= last]


def candidates(spark: SparkSession, path: str, field: str, need: grams.Need, from_=None, to=None) -> DataFrame:
    """The events of the data files, on the days of a window, that may have what the need asks for.

    File names pass through the driver, as for any read of the table; texts and bitmaps do not.
    """
    days = _days(spark, path, from_, to)
    if need is None:
        return read_events(spark, path, days)
    kept = [f for d in days for f in beside.kept_files(spark, root(path), d)]
    held = [f for d in days for f in beside.data_files(spark, path, d)]
    if kept:
        known = {r["file"] for r in spark.read.schema(SCHEMA).parquet(*kept).filter("bucket = -1").select("file").distinct().collect()}
        hits = _holding(spark, kept, field, need)
        held = [f for f in held if (n := beside.name(f)) in hits or n not in known]
    if not held:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).option("basePath", path).parquet(*held)


def filter_stored(spark: SparkSession, path: str, params: Params) -> DataFrame:
    """:func:`eventloom.operators.filters.filter_events` over the table; `q` opens only files that may match."""
    given = dict(pairs(params))
    q = given.get("q")
    ev = candidates(spark, path, "message", grams.of_expression(q) if q else None, given.get("from"), given.get("to"))
    return filter_events(ev, params)


def search_stored(spark: SparkSession, path: str, text: str, from_=None, to=None) -> DataFrame:
    """:func:`eventloom.operators.documents.search_docs` over the table, opening only files whose payloads may hold the text."""
    need = grams.of_text(text) if documents.in_json_text(text) else None
    ev = candidates(spark, path, "payload", need, from_, to)
    window = (instant(from_, "from") if from_ is not None else None, instant(to, "to") if to is not None else None)
    return documents.search_docs(in_window(ev, *window), text)
