"""Projects: named sets of apps, a small dimension kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import longer_than, slugify
from eventloom.functions.values import as_array, as_object, as_text, json_kind
from eventloom.session import shared_path

# Limits of a project.
NAME_MAX, APPS_MAX, APP_MAX = 80, 200, 128


def validate_projects(df: DataFrame) -> DataFrame:
    """Check project bodies: adds ``name``, ``apps`` and ``error`` to ``body STRING`` rows.

    `error` is NULL for valid bodies; names are trimmed, repeated apps dropped
    keeping the first.
    """
    name = f"trim({as_text('_name')})"
    unknown = "array_except(map_keys(_b), array('name', 'apps'))"
    bad_app = f"exists(_apps, a -> coalesce({json_kind('a')} <> 'string', true) or {as_text('a')} = '')"
    long_app = f"exists(_apps, a -> {longer_than(as_text('a'), APP_MAX)})"
    # The order of the checks and the texts that readers already know.
    checks = [
        ("_b is null", "'project body must be a JSON object'"),
        (f"size({unknown}) > 0", f"concat('unknown key \"', {unknown}[0], '\"')"),
        ("_name is null", "'name is required'"),
        (f"{json_kind('_name')} <> 'string'", "'name must be a string'"),
        (f"{name} = ''", "'name must be a non-empty string'"),
        (longer_than(name, NAME_MAX), f"'name exceeds {NAME_MAX} chars'"),
        ("_given is not null and _apps is null", "'apps must be an array of strings'"),
        (f"size(_apps) > {APPS_MAX}", f"'apps exceeds {APPS_MAX} entries'"),
        (bad_app, "'each app must be a non-empty string'"),
        (long_app, f"'app name exceeds {APP_MAX} chars'"),
    ]
    error = "case " + " ".join(f"when {broken} then {reason}" for broken, reason in checks) + " end"
    return (
        df.selectExpr("*", f"{as_object('try_parse_json(body)')} as _b")
        .selectExpr("*", "_b['name'] as _name", "_b['apps'] as _given")
        .selectExpr("*", f"{as_array('_given')} as _apps")
        .selectExpr("*", f"{error} as error")
        .selectExpr(
            *df.columns,
            f"if(error is null, {name}, null) as name",
            f"if(error is null, coalesce(array_distinct(transform(_apps, a -> {as_text('a')})), array()), null) as apps",
            "error",
        )
    )


def unique_names(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows ``name, created_at, …`` to (kept, conflicting): the earliest of each name, ignoring case, is kept."""
    key = F.lower("name")
    first = Window.partitionBy("name_lower").orderBy("created_at", "name")
    ranked = df.withColumn("name_lower", key).withColumn("_nth", F.row_number().over(first))
    return ranked.filter("_nth = 1").drop("_nth"), ranked.filter("_nth > 1").drop("_nth")


def assign_slugs(df: DataFrame) -> DataFrame:
    """Give each row of ``name, created_at, …`` its slug.

    In creation order a name takes its slug root, then ``root-2``, ``root-3``…
    A numbered slug that is also some other name's root goes to whichever row
    was created first; the later one moves on.  Ordinary roots are numbered by
    a window.  Roots that collide with a numbered form of another root are
    settled together, in rounds over a small table in the shared folder.
    """
    root = F.expr(slugify("name", NAME_MAX))
    rows = df.withColumn("_root", F.when(root == "", "project").otherwise(root))
    nth = Window.partitionBy("_root").orderBy("created_at", "name")
    rows = rows.withColumn("_nth", F.row_number().over(nth))

    # The family of a root: the root without its trailing numbers.
    rows = rows.withColumn("_family", F.regexp_replace("_root", r"(-\d+)+$", ""))
    roots = rows.groupBy("_family").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"))
    mixed = roots.filter(F.col("_lo") != F.col("_hi")).select("_family")

    plain = rows.join(mixed, "_family", "left_anti").withColumn("slug", _numbered(F.col("_root"), F.col("_nth")))
    settled = _settle(rows.join(mixed, "_family", "left_semi"))
    return plain.select(*df.columns, "slug").unionByName(settled.select(*df.columns, "slug"))


def _numbered(root: Column, n: Column) -> Column:
    return F.when(n == 1, root).otherwise(F.concat_ws("-", root, n.cast("string")))


def _settle(rows: DataFrame) -> DataFrame:
    """Slugs of families that hold several roots.

    Every row has a number that its own cannot be below; at first, its place
    among the rows of its root.  Of rows that meet at one slug the earliest
    stays and the others' numbers rise, until none meet: then each row's number
    is the first that was free when it was created.
    """
    state = _kept(rows.select("_root", "_nth", F.struct("created_at", "name").alias("_at"), F.col("_nth").alias("_k")))
    of_slug = Window.partitionBy("_slug").orderBy("_at")
    while True:
        held = state.withColumn("_slug", _numbered(F.col("_root"), F.col("_k"))).withColumn("_lost", F.row_number().over(of_slug) > 1)
        if held.filter("_lost").isEmpty():
            break
        state = _kept(_raised(held))
    return rows.join(state.select("_root", "_nth", "_k"), ["_root", "_nth"]).withColumn("slug", _numbered(F.col("_root"), F.col("_k")))


def _raised(held: DataFrame) -> DataFrame:
    """One round: the rows that lost their slug move on, and the later rows of their roots with them.

    Slugs of other roots' rows that are older than a root's first loser are
    taken for that loser and all later rows of its root, so those rows skip all
    of them at once: the n-th of them has the n-th number that is left, counted
    from the number that was lost.
    """
    first = held.filter("_lost").groupBy("_root").agg(F.min("_nth").alias("_from"), F.min("_k").alias("_lowest"), F.min("_at").alias("_since"))
    # a slug is number 1 of the root of that name, and number k of the root without its last number k
    last = F.regexp_extract("_slug", r"-([1-9]\d{0,8})$", 1)
    readings = F.array(
        F.struct(F.col("_slug").alias("of"), F.lit(1).alias("k")),
        F.struct(F.regexp_replace("_slug", r"-[1-9]\d{0,8}$", "").alias("of"), last.try_cast("int").alias("k")),
    )
    read = held.select("_root", "_at", F.explode(readings).alias("r")).select(F.col("_root").alias("_by"), "_at", F.col("r.of").alias("_root"), F.col("r.k").alias("k"))
    others = read.filter("_by <> _root and k is not null").join(first, "_root")
    taken = others.filter("_at < _since and k >= _lowest").select("_root", (F.col("k") - F.col("_lowest") + 1).alias("k")).distinct()
    left = F.col("k") - F.row_number().over(Window.partitionBy("_root").orderBy("k"))  # numbers below that are not taken
    blocks = taken.select("_root", left.alias("_place"), F.lit(1).alias("_block"))
    rows = held.join(first.drop("_since"), "_root", "left").withColumn("_place", F.col("_nth") - F.col("_from") + 1).withColumn("_block", F.lit(0))
    so_far = Window.partitionBy("_root").orderBy("_place", "_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    skipped = rows.unionByName(blocks, allowMissingColumns=True).withColumn("_skipped", F.sum("_block").over(so_far)).filter("_block = 0")
    jumped = F.when(F.col("_place") > 0, F.col("_lowest") - 1 + F.col("_place") + F.col("_skipped")).otherwise(0)
    least = F.greatest(F.col("_k") + F.col("_lost").cast("int"), jumped) - F.col("_nth")
    # rows of one root have rising numbers
    rising = Window.partitionBy("_root").orderBy("_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return skipped.select("_root", "_nth", "_at", (F.col("_nth") + F.max(least).over(rising)).cast("int").alias("_k"))


def _kept(df: DataFrame) -> DataFrame:
    """Writes a round's table to the shared folder and reads it back, which ends its lineage."""
    path = shared_path(df.sparkSession, "slugs")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def list_projects(df: DataFrame) -> DataFrame:
    """Projects by name, ignoring case."""
    return df.select("slug", "name", "apps").orderBy(F.lower("name"))
