"""Exact nearest-rank percentiles without sorting a group in one task.

Values are integers.  A group is first reduced to (value, count); then two
bounded windows find each rank: one over at most 65,536 high-part buckets, one
over at most 65,536 values of the bucket that holds the rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOW_BITS = 16


def nearest_rank(
    df: DataFrame, keys: list[str], value: str, percents: dict[str, float]
) -> DataFrame:
    """Columns of `percents` per key: the value at index round_half_even(p * (n - 1))."""
    histogram = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("long").alias("_v"))
        .agg(F.count("*").alias("_n"))
        .withColumn("_high", F.shiftright("_v", LOW_BITS))
    )
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_high")
    buckets = (
        histogram.groupBy(*keys, "_high")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.sum("_bn").over(upto) - F.col("_bn"))
        .withColumn("_total", F.sum("_bn").over(per_key))
    )
    targets = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.rint(F.lit(p) * (F.col("_total") - 1)).cast("long").alias("rank"))
            for name, p in percents.items()
        ]
    )
    wanted = (
        buckets.withColumn("_t", F.explode(targets))
        .filter((F.col("_t.rank") >= F.col("_before")) & (F.col("_t.rank") < F.col("_before") + F.col("_bn")))
        .select(*keys, "_high", "_before", "_t.name", "_t.rank")
    )
    inside = Window.partitionBy(*keys, "name").orderBy("_v")
    found = (
        histogram.join(wanted, [*keys, "_high"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
        .filter((F.col("rank") < F.col("_upto")) & (F.col("rank") >= F.col("_upto") - F.col("_n")))
    )
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in percents]
    )
