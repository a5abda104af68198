"""Ordered computations inside a group that never pull a whole group into one task.

A plain ``Window.partitionBy("repo_id").orderBy("seq")`` sorts an entire repository in a
single task.  The helpers below cut every group into buckets that follow the order,
aggregate one row per bucket (combined map-side before the shuffle), run the window over
those few bucket rows only, and finish inside each bucket.  Results equal the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repochron.session import stage

#: rows of one group that share a bucket when the order column is a dense position
BLOCK_ROWS = 65536


def block_of(position: Column | str, rows: int = BLOCK_ROWS) -> Column:
    """Bucket of a dense zero-based position."""
    column = F.col(position) if isinstance(position, str) else position
    return F.floor(column / F.lit(rows)).cast("long")


def _offsets(df: DataFrame, group: Sequence[str], bucket: str, amount: Column) -> DataFrame:
    per_bucket = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_amount"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.select(*group, bucket, F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_before"))


def prefix_sum(
    df: DataFrame, group: Sequence[str], order: str, value: Column, name: str,
    *, inclusive: bool = True, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sum of an integer ``value`` along a dense position column ``order``."""
    marked = df.withColumn("_bucket", block_of(order, rows)).withColumn("_value", value.cast("long"))
    offsets = _offsets(marked, group, "_bucket", F.col("_value"))
    upto = 0 if inclusive else -1
    frame = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, upto)
    return (
        marked.join(offsets, [*group, "_bucket"])
        .withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(frame), F.lit(0)))
        .drop("_bucket", "_value", "_before")
    )


def number_rows(
    df: DataFrame, group: Sequence[str], bucket: Column, order: Sequence[Column], name: str,
) -> DataFrame:
    """One-based row number along ``order``; ``bucket`` must not decrease along it."""
    marked = df.withColumn("_bucket", bucket)
    offsets = _offsets(marked, group, "_bucket", F.lit(1))
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        marked.join(offsets, [*group, "_bucket"])
        .withColumn(name, (F.row_number().over(inside) + F.col("_before")).cast("long"))
        .drop("_bucket", "_before")
    )


#: limits that are compared one by one once the stretch of them is known
_STRETCH = 16


def _key_limits(df: DataFrame, group: Sequence[str], key: str, buckets: int) -> DataFrame:
    """Approximate quantiles of the key in each group, written: another run of the sketch may give other ones.

    In stretches, with the last one of each: a row is compared with these and with one stretch, not with all.
    """
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    limits = df.groupBy(*group).agg(F.percentile_approx(key, steps, 1000).alias("_limits"))
    starts = range(1, buckets, _STRETCH)
    stretches = F.when(F.col("_limits").isNotNull(), F.array(*[F.slice("_limits", i, _STRETCH) for i in starts]))
    return stage(limits.select(*group, stretches.alias("_limits"), F.transform(stretches, lambda s: F.element_at(s, -1)).alias("_ends")))


def _slot(key: str) -> Column:
    """Number of the limits below the key."""
    passed = F.least(F.size(F.filter("_ends", lambda end: end < F.col(key))), F.size("_ends") - 1)
    return passed * _STRETCH + F.size(F.filter(F.get("_limits", passed), lambda limit: limit < F.col(key)))


def number_rows_by_key(df: DataFrame, group: Sequence[str], key: str, name: str, *, buckets: int = 256) -> DataFrame:
    """One-based row number along a unique BIGINT ``key``.

    Bucket limits are approximate quantiles of the key, taken per group in one partial
    aggregation, so equal-sized buckets come out whatever the distribution; the numbers
    themselves are exact because any limits split the order consistently.
    """
    limits = _key_limits(df, group, key, buckets)
    bucketed = df.join(limits, list(group)).withColumn("_slot", _slot(key).cast("long"))
    return number_rows(bucketed.drop("_limits", "_ends"), group, F.col("_slot"), [F.col(key)], name).drop("_slot")


def row_at(df: DataFrame, group: Sequence[str], key: str, place: str, *, buckets: int = 256) -> DataFrame:
    """The row at the one-based ``place`` (a column, one value in a group) along a unique BIGINT ``key``.

    Rows are counted by buckets of the key, so only the rows of the one bucket that holds the place
    are put in order: no group is ever sorted.
    """
    places = stage(df.groupBy(*group).agg(F.min(place).alias("_place")))
    limits = _key_limits(df, group, key, buckets)
    slotted = df.join(places, list(group)).join(limits, list(group)).withColumn("_slot", _slot(key))
    counts = slotted.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_place"))
    # at most ``buckets`` rows of a group
    upto = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_upto", F.sum("_n").over(upto))
    wanted = stage(counts.filter((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place"))).select(
        *group, "_slot", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_inside")))
    near = slotted.drop("_limits", "_ends", "_place").join(wanted, [*group, "_slot"])
    order = Window.partitionBy(*group).orderBy(key)
    return near.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") == F.col("_inside")).drop("_slot", "_inside", "_at")


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group.

    ``row_number() <= k`` is planned as a group limit that runs before the shuffle, so at
    most ``k`` rows per group and input partition travel.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(name) <= k)
