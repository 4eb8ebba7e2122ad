"""Running totals and ranks that stay bounded per task.

A plain ``sum() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a hot
key to one task.  Here a key's rows are cut into ordered slices by sampled
range boundaries; only the per-slice totals meet in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_totals(
    df: DataFrame, keys: list[str], order: list[str], value: str, out: str
) -> DataFrame:
    """Add the sum of `value` over all earlier rows of the same key.

    Rows are range partitioned by (keys, order), so each task holds one
    contiguous slice.  The slice number is part of both window keys: inside a
    slice the running sum is a window over that slice only, and the carry from
    earlier slices is a window over one total per (key, slice).
    """
    w_slice = Window.partitionBy("_slice", *keys).orderBy(*order)
    w_carry = Window.partitionBy(*keys).orderBy("_slice")
    from voltmap.session import cut

    sliced = cut(
        df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    totals = sliced.groupBy("_slice", *keys).agg(F.sum(value).alias("_total"))
    carry = totals.withColumn(
        "_carry",
        F.coalesce(
            F.sum("_total").over(w_carry.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    ).drop("_total")
    inner = F.coalesce(
        F.sum(value).over(w_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    same_key = F.col("s._slice") == F.col("c._slice")
    for k in keys:
        same_key = same_key & F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}"))
    return (
        sliced.withColumn("_inner", inner)
        .alias("s")
        .join(carry.alias("c"), same_key)
        .select("s.*", "c._carry")
        .withColumn(out, F.col("_inner") + F.col("_carry"))
        .drop("_slice", "_inner", "_carry")
    )


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on a costly computed column without evaluating it twice.

    A plain filter is pushed below the projections that compute its columns,
    which copies their whole expression into the condition.  The partition id is
    not deterministic for the optimizer, so the filter stays above them.
    """
    pinned = df.withColumn("_pin", F.spark_partition_id())
    return pinned.filter(condition & (F.col("_pin") >= 0)).drop("_pin")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the greatest by `order`.  Combines map-side, no window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r")
    )
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the least by `order`."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_r")
    )
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)
