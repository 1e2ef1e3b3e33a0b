"""Percentiles per group: exact whatever a group's size, or approximate in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import shared_path

ACCURACY = 10_000
#: Values of a group that one aggregate may hold; beyond, ranks are located by narrowing.
HELD = 1 << 15
#: Ranges that one round of narrowing splits a range into, and distinct values that need no further round.
SPLIT, FEW = 4096, 4096


def approximate(value: str, ps) -> str:
    """SQL for nearest-rank percentiles from a bounded, mergeable summary.

    The rank error is at most 1/10,000 of the group, so groups below 5,000 rows
    come out exact; state per group is bounded and combines map-side.
    """
    return f"percentile_approx({value}, array({', '.join(f'{float(p)}D' for p in ps)}), {ACCURACY})"


def held(value: str, ps) -> str:
    """SQL for exact nearest-rank percentiles of a group whose values one aggregate may hold."""
    return f"percentile_disc(array({', '.join(f'{float(p)}D' for p in ps)})) within group (order by {value})"


def _large(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The keys of groups with more values than one aggregate may hold."""
    rows = df.filter(f"{value} is not null").groupBy(*keys).agg(F.count("*").alias("_size"))
    return rows.filter(F.col("_size") > HELD).select(*keys)


def fits(df: DataFrame, keys: list[str], value: str) -> bool:
    """Whether every group's values may be held by one aggregate, by counting them."""
    return _large(df, keys, value).isEmpty()


def exact(df: DataFrame, keys: list[str], value: Column, ps: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles, one row per group, columns named by `ps`.

    Groups are counted first.  Those of up to HELD values come from one
    aggregate.  The others are never in one task: :func:`narrowed` locates
    their ranks.  Groups without values, or with a NULL key, give no row.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], value.cast("double").alias("_v"))
    rows = rows.filter(" and ".join(f"{n} is not null" for n in [*names, "_v"]))
    large = _large(rows, names, "_v")
    some = not large.isEmpty()
    if some:
        large = _kept(large, "large")
    small = (rows.join(large, names, "left_anti") if some else rows).groupBy(*names).agg(F.expr(held("_v", ps.values())).alias("_all"))
    out = small.select(*names, *[F.col("_all")[i].alias(p) for i, p in enumerate(ps)])
    if some:
        values = rows.join(large, names, "left_semi").groupBy(*names, "_v").agg(F.count("*").alias("_n"))
        out = out.unionByName(_selected(_kept(values, "values"), names, ps))
    return out.withColumnsRenamed(dict(zip(names, keys)))


def counted(values: DataFrame, keys: list[str], value: str, count: str, ps: dict[str, float]) -> DataFrame:
    """:func:`exact` over distinct values of each group that come with their counts."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = values.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).alias("_v"), F.col(count).alias("_n"))
    rows = rows.filter(" and ".join(f"{n} is not null" for n in [*names, "_v"]))
    return _selected(_kept(rows, "values"), names, ps).withColumnsRenamed(dict(zip(names, keys)))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """`df` computed once, in the shared folder."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scale(value: Column) -> Column:
    """An increasing function of a number that tells magnitudes apart, for ranges that span several."""
    size = F.when(F.abs(value) == float("inf"), F.lit(3300.0)).otherwise(F.log2(F.abs(value)) + 1100)
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * size)


def _bin(value: Column, low: Column, high: Column) -> Column:
    """Which of SPLIT parts of low..high a value is in: equal parts, or of equal magnitude where the ends differ by more than a factor of two."""
    near = (F.signum(low) == F.signum(high)) & (F.abs(high) <= 2 * F.abs(low)) & (F.abs(low) <= 2 * F.abs(high)) & (F.abs(low) < float("inf"))
    linear = (value - low) / (high - low)
    scaled = (_scale(value) - _scale(low)) / (_scale(high) - _scale(low))
    return F.floor(F.when(near, linear).otherwise(scaled) * SPLIT)


def narrowed(values: DataFrame, names: list[str], ps: dict[str, float]) -> DataFrame:
    """For each group and percentile a range of at most FEW distinct values that holds it, and its rank there.

    `values` has distinct values `_v` with counts `_n`.  A round splits each open
    range between its smallest and largest value, counts the parts by partial
    aggregation, and goes on with the part that holds the rank.  Values that
    differ by magnitudes are told apart by magnitude first; so rounds are few:
    at most two for that, and four for the 52 bits inside one.
    """
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("p"), F.lit(float(p)).alias("share")) for n, p in ps.items()]))
    whole = values.groupBy(*names).agg(
        F.sum("_n").alias("_total"), F.count("*").alias("_many"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("_w.share") * F.col("_total"))).cast("long")
    columns = [*names, "_p", "_rank", "_many", "_low", "_high"]
    state = _kept(whole.withColumn("_w", wanted).withColumn("_p", F.col("_w.p")).withColumn("_rank", rank).select(*columns), "ranks")
    while True:
        wide = state.filter(F.col("_many") > FEW)
        if wide.isEmpty():
            return state
        inside = values.join(wide, names).filter("_v between _low and _high")
        parts = inside.groupBy(*names, "_p", "_rank", _bin(F.col("_v"), F.col("_low"), F.col("_high")).alias("_bin")).agg(
            F.sum("_n").alias("_n"), F.count("*").alias("_many"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
        )
        # SPLIT rows per range
        upto = F.sum("_n").over(Window.partitionBy(*names, "_p").orderBy("_bin"))
        parts = parts.withColumn("_before", upto - F.col("_n")).filter("_rank > _before and _rank <= _before + _n")
        state = _kept(parts.withColumn("_rank", F.col("_rank") - F.col("_before")).select(*columns).unionAll(state.filter(F.col("_many") <= FEW)), "ranks")


def _selected(values: DataFrame, names: list[str], ps: dict[str, float]) -> DataFrame:
    """The percentiles of large groups, from the few values of each narrowed range."""
    inside = values.join(narrowed(values, names, ps), names).filter("_v between _low and _high")
    upto = F.sum("_n").over(Window.partitionBy(*names, "_p").orderBy("_v"))
    found = inside.withColumn("_before", upto - F.col("_n")).filter("_rank > _before and _rank <= _before + _n")
    return found.groupBy(*names).agg(*[F.max(F.when(F.col("_p") == p, F.col("_v"))).alias(p) for p in ps])
