"""How filters of a corpus interact, over every order they could be applied in.

A document's failures are a bit mask.  In the lexicographic list of all orders (Lehmer ranks),
those that share a first part stand side by side, so the orders in which a mask is removed at
a given step are a few intervals of ranks.  Each mask adds its count where an interval
begins and takes it away where it ends; a prefix sum over the ranks gives what every order
removes at every step.  Documents are touched once, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
MARKS = "[#$%&*|]"
FILTERS = "ABCDE"
_GAPS = r"[\x20\x09-\x0D]+"


def lehmer_rank(prefix: Sequence[int], n: int) -> int:
    """Rank of the first of all orders of 0..n-1 that begin with `prefix`."""
    rank, left = 0, list(range(n))
    for i, x in enumerate(prefix):
        rank += left.index(x) * factorial(n - 1 - i)
        left.remove(x)
    return rank


def removal_intervals(n: int) -> Iterator[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last) of the orders that remove a mask at a step.

    A mask goes at step s where the s-th filter is in it and none of the earlier ones is;
    the (n - s)! orders of the rest follow one another.
    """
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            rank = lehmer_rank(prefix, n)
            earlier = sum(1 << x for x in prefix[:-1])
            for mask in range(1 << n):
                if mask >> prefix[-1] & 1 and not mask & earlier:
                    yield mask, step, rank, rank + factorial(n - step)


def text_mask(text: Column) -> Column:
    """Bits of the conditions on one text: 1 few words, 2 repetitive, 4 capitals, 8 marks."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _GAPS, -1), lambda w: w != "")
    few = F.size(words) < LEAST_WORDS
    same = 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    loud = 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text)
    bits = (few, same, loud, text.rlike(MARKS))
    return sum((F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)), F.lit(0))


def masks(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """Documents counted by failures: part, mask, n, good, toxic.

    The fifth bit (16) marks a text identical to that of a smaller id anywhere in the table.
    Texts meet by their SHA-256 hash, after rows of one id and text were counted together, and
    every aggregation combines before its shuffle, so a text that a third of all rows share
    is a few rows.  Null texts are empty, null parts are the empty string; a row
    without an id is a copy of none and has no labels; repeated rows count each, and are no
    copies of one another; a document with several label rows is good (toxic) if one says so.
    An empty table gives no rows.  Other columns, whatever their names, are not read.
    """
    rows = docs.select(
        F.col(id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        text_mask(F.col(text)).alias("mask"),
        F.when(F.col(id).isNotNull(), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("said"),
    )
    alike = rows.groupBy("id", "part", "mask", "said").agg(F.count("*").alias("n"))
    marks = (
        labels.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id"))
        .agg(
            F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
            F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
        )
    )
    counted = F.struct(
        F.col("n").alias("n"),
        (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    measured = alike.join(marks, "id", "left").select("id", "part", "mask", "said", counted.alias("c"))
    names = ("n", "good", "toxic")
    by_text = measured.groupBy("said", "part", "mask").agg(
        F.min("id").alias("least"), F.min_by("c", "id").alias("first"),
        *[F.sum(f"c.{x}").alias(x) for x in names],
    )
    # A text meets here once per part, so no group is larger than the number of parts.
    least = F.min("least").over(Window.partitionBy("said"))
    own = F.when(F.col("said").isNull(), F.struct(*names)).when(F.col("least") == F.col("all_least"), F.col("first"))
    split = by_text.withColumn("all_least", F.when(F.col("said").isNotNull(), least)).withColumn("own", own)
    kept = [F.coalesce(F.col("own")[x], F.lit(0)) for x in names]
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[k.alias(x) for k, x in zip(kept, names)]),
        F.struct((F.col("mask") + 16).alias("mask"), *[(F.col(x) - k).alias(x) for k, x in zip(kept, names)]),
    )
    return (
        split.select("part", F.inline(both)).filter("n > 0")
        .groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in names])
    )


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does at each step of each order, from `masks`.

    One row per part, order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, zeros included.  The tables of intervals and orders depend on the
    number of filters alone (840 and 600 rows for five).  No parts, no rows.
    """
    spark, n = counts.sparkSession, len(filters)
    intervals = spark.createDataFrame(
        list(removal_intervals(n)), "mask int, step int, begin int, end int"
    )
    orders = spark.createDataFrame(
        [
            (rank, "".join(filters[x] for x in order), step, order[step - 1])
            for rank, order in enumerate(permutations(range(n)))
            for step in range(1, n + 1)
        ],
        "rank int, filter_order string, step int, bit int",
    )
    names = ("n", "good", "toxic")
    ends = F.array(
        F.struct(F.col("begin").alias("rank"), *[F.col(x).alias(x) for x in names]),
        F.struct(F.col("end").alias("rank"), *[(-F.col(x)).alias(x) for x in names]),
    )
    steps = counts.join(F.broadcast(intervals), "mask").select("part", "step", F.inline(ends))
    parts = counts.groupBy("part").agg(F.sum("n").alias("total"))
    ranks = F.sequence(F.lit(0), F.lit(factorial(n) - 1))
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(ranks).alias("rank"), *[F.lit(0).cast("long").alias(x) for x in names]
    )
    differences = steps.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(x).alias(x) for x in names])
    run = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = differences.select("part", "step", "rank", *[F.sum(x).over(run).alias(x) for x in names])
    failing = counts.select("part", "mask", "n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bit")).groupBy(
        "part", "bit"
    ).agg(
        F.sum(F.when(F.expr("shiftright(mask, bit) & 1 = 1"), F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.expr("mask = shiftleft(1, bit)"), F.col("n")).otherwise(0)).alias("unique_fails"),
    )
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return (
        removed.join(F.broadcast(orders), ["rank", "step"])
        .join(parts, "part").join(failing, ["part", "bit"])
        .select(
            "part", "filter_order", "step",
            (F.col("total") - F.sum("n").over(so_far)).alias("kept"),
            F.col("n").alias("removed"),
            (F.col("fails") - F.col("n")).alias("redundant"),
            "unique_fails",
            F.col("good").alias("good_lost"),
            F.col("toxic").alias("toxic_lost"),
            F.sum("n").over(Window.partitionBy("part", "bit")).alias("shapley"),
        )
    )
