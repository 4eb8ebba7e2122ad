"""Mix sources to target word counts with exact quotas per output shard.

The words of a source lie on one line: its documents in an order permuted by a keyed hash,
cut into blocks.  A target of r times the source's size draws every block floor(r) times and
then blocks from the start of the line until the quota is exact to the word; the document at
the end is taken in part.  A splitting tree deals the drawn blocks to output shards: each
node halves its vector of block quotas by a multivariate hypergeometric draw, so every shard
has a fair, exact and disjoint share; each shard then shuffles its documents locally.

Only one row per source (its weight, size and number of blocks: the mixture's configuration)
comes to the driver; documents meet in blocks of about `block_words` words, whatever the source.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmap.llm.text import words
from voltmap.session import cut

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: A source's words are cut into blocks of `block_words`, or into so many larger ones.
MAX_BLOCKS = 1_000_000


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(id, source, key, size) of each row; null texts have no words.

    `key` is a hash of id and text: rows that share it are repeats of one row.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = words(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("source"), b.column("key"), pa.array(found.counts, pa.int64())],
                ["id", "source", "key", "size"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(source).alias("source"), _key(doc_id, text).alias("key"),
        F.col(text).alias("text"),
    )
    return rows.mapInArrow(count, f"id {kind}, source string, key long, size long")


def _key(doc_id: str, text: str):
    return F.xxhash64(F.lit(29), F.col(doc_id).cast("string"), F.col(text))


def targets(totals: list[tuple[str | None, int]], weights=WEIGHTS, limit: float = LIMIT) -> dict:
    """Source -> target words.  `weights` repeat over the sources by code point, null last.

    All sizes are shared by weight; a share above `limit` times the source's size stops
    there and its excess is shared again among the rest, until none is above.
    """
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, free, out = float(sum(size.values())), set(size), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > limit * size[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: float(limit * size[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Splitting tree: (sources, shards) block counts; rows sum to the quotas.

    A node of m shards gives floor(m / 2) of them that share of its blocks, drawn without
    replacement over all its blocks (multivariate hypergeometric, source by source).
    """
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    todo = [(quotas.astype(np.int64), 0, shards)]
    while todo:
        have, first, m = todo.pop()
        if m == 1:
            out[:, first] = have
            continue
        half = m // 2
        rng = np.random.default_rng([seed, first, m])
        left, draws = int(have.sum()), int(have.sum()) * half // m
        taken = np.zeros_like(have)
        for i, n in enumerate(have):
            taken[i] = _hypergeometric(rng, int(n), left - int(n), draws)
            left, draws = left - int(n), draws - int(taken[i])
        todo += [(taken, first, half), (have - taken, first + half, m - half)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among `draws`; beyond numpy's range by the normal limit, kept inside its bounds."""
    if not good or not draws:
        return 0
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n, p = good + bad, good / (good + bad)
    spread = (draws * p * (1 - p) * (n - draws) / max(n - 1, 1)) ** 0.5
    return int(min(max(round(rng.normal(draws * p, spread)), draws - bad, 0), good, draws))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
    limit: int = LIMIT, block_words: int = 50_000, shards: int = 64, seed: int = 17,
) -> DataFrame:
    """One row per document row: id, key, source, size, source_size, target, takes.

    `takes` is an array (at most `limit` long) of (draw, shard, slot, words): the document's
    first `words` words go to the output shard, which orders its documents by slot.  Only the
    document at the end of a source's quota is taken in part.

    Null sources are one source of their own, last in order; null and empty texts have size 0
    and are never taken; repeated rows are separate documents; an empty table gives no rows.
    Every row keeps its place on reruns, whatever the partitioning.
    """
    rows = cut(sizes(docs, doc_id, text, source))
    per_source = [(r[0], int(r[1] or 0)) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    goal = targets(per_source, weights, limit)
    order = sorted(per_source, key=lambda x: (x[0] is None, x[0] or ""))
    whole = [int(goal[s] // n) if n else 0 for s, n in order]
    rest = [round(goal[s] - whole[i] * n) for i, (s, n) in enumerate(order)]
    count = [min(max(1, -(-n // block_words)), MAX_BLOCKS) for _, n in order]
    plan = _table(
        docs, "number int, source string, source_size long, target double, blocks long, whole long, rest long",
        [(i, s, n, goal[s], count[i], whole[i], rest[i]) for i, (s, n) in enumerate(order)],
    )
    placed = (
        rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
        .drop(plan["source"])
        .withColumn("order", F.xxhash64(F.lit(seed), F.col("key")))
        .withColumn("block", F.pmod(F.shiftrightunsigned("order", 3), F.col("blocks")))
    )
    before = Window.partitionBy("number").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(
        placed.groupBy("number", "block")
        .agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
        .withColumn("begins", F.coalesce(F.sum("words").over(before), F.lit(0)))
    )
    last = dict(blocks.filter("begins < rest").groupBy("number").count().collect())
    drawn = [whole[i] * count[i] + last.get(i, 0) for i in range(len(order))]
    tree = split(np.array(drawn, dtype=np.int64), shards, seed).cumsum(axis=1)
    dealt = _table(
        docs, "number int, upto array<long>, stride long, draws long",
        [(i, [int(x) for x in tree[i]], _stride(drawn[i], seed + i), drawn[i]) for i in range(len(order))],
    )
    inside = Window.partitionBy("number", "block").orderBy("order", "key", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    line = (
        placed.join(blocks.drop("rest", "words"), ["number", "block"])
        .withColumn("at", F.col("begins") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(dealt, "number")
    )
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("at")))

    def take(epoch: int):
        n = F.when(F.col("whole") > epoch, F.col("size")).when(F.col("whole") == epoch, part).otherwise(F.lit(0))
        wide = (F.col("blocks") * epoch + F.col("block")).cast("decimal(38,0)") * F.col("stride")
        permuted = F.when(F.col("draws") > 0, F.pmod(wide, F.col("draws").cast("decimal(38,0)")).cast("long"))
        return F.struct(
            F.lit(epoch).alias("draw"), F.size(F.filter("upto", lambda x: x <= permuted)).alias("shard"),
            F.xxhash64(F.lit(seed + 1 + epoch), F.col("key")).alias("slot"), n.cast("long").alias("words"),
        )

    takes = F.filter(F.array(*[take(e) for e in range(limit)]), lambda x: x["words"] > 0)
    return line.select("id", "key", "source", "size", "source_size", "target", takes.alias("takes"))


def _table(docs: DataFrame, names: str, rows: list[tuple]) -> DataFrame:
    return docs.sparkSession.createDataFrame(rows, names)


def _stride(n: int, seed: int) -> int:
    """A step that is prime to n: j -> j * step mod n permutes the draws."""
    rng, n = random.Random(seed), max(n, 1)
    while True:
        step = rng.randrange(1, n + 1)
        if np.gcd(step, n) == 1:
            return step


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: `docs` with one row per take, a partial take's text cut after its words.

    Columns and their order are those of `docs`; n_chars, if there, follows the text.
    """
    same = Window.partitionBy("_key").orderBy(F.lit(0))
    rows = docs.withColumn("_key", _key("doc_id", "text")).withColumn("_n", F.row_number().over(same))
    takes = mix(docs, **options).select(F.col("key").alias("_key"), F.explode("takes").alias("_take"), F.col("size").alias("_size"))
    # Repeats of one row are alike: the takes of a repeated row go round its rows.
    turns = rows.groupBy("_key").agg(F.count("*").alias("_rows"))
    turn = Window.partitionBy("_key").orderBy("_take.draw", "_take.words")
    takes = takes.join(turns, "_key").withColumn("_n", (F.row_number().over(turn) - 1) % F.col("_rows") + 1)
    out = rows.join(takes, ["_key", "_n"]).withColumn("text", first_words("text", "_take.words", "_size"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


@F.pandas_udf(T.StringType())
def first_words(texts: pd.Series, upto: pd.Series, size: pd.Series) -> pd.Series:
    """The text up to the end of its `upto`-th word; the whole text if it has no more."""
    out = []
    for text, n, n_all in zip(texts, upto, size):
        if text is not None and n < n_all:
            raw = text.encode()
            text = raw[: words(pa.array([raw])).ends[int(n) - 1]].decode()
        out.append(text)
    return pd.Series(out, dtype=object)
