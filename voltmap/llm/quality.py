"""Importance resampling: documents like the target text, by Gumbel top-k.

Two bag models of hashed one- and two-word grams, one of the target (labelled good documents),
one of all raw text, give each document a log importance: the mean log-ratio of its grams
times `SHARPNESS`.  Adding Gumbel noise drawn from a hash of the document and keeping the
k largest keys samples k documents without replacement in proportion to their importance.
The k-th key is found exactly by narrowing a histogram of the keys, digit by digit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltmap.llm.lm import pair_keys, tokens, word_keys
from voltmap.llm.text import Words, pieces, words
from voltmap.session import cut

BUCKETS = 1 << 16
#: The target is a bounded sample: so many labelled rows at most, by hash.
MAX_LABELS = 200_000
SHARE = 0.85
SHARPNESS = 40.0
ADD = 1.0
#: Bits that one step of the search for the k-th key settles.
DIGIT_BITS = 16


def grams(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each gram of all texts in turn, and the range of each text."""
    token, before, bounds = tokens(found)
    both = np.empty(2 * len(token), dtype=np.uint64)
    both[0::2], both[1::2] = word_keys(token), pair_keys(before, token)
    return (both % np.uint64(BUCKETS)).astype(np.int64), 2 * bounds


def _good_ids(labels: DataFrame, doc_id: str, label: str) -> np.ndarray:
    """Sorted ids of rows labelled 1 whose crc32(id as text) mod 4 is not 2; ids of mixed labels are left out."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    rows = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (remainder != 2))
        .groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.min(label).alias("good")).filter("good = 1")
        .orderBy(F.xxhash64(F.lit(3), "id")).limit(MAX_LABELS).select("id").toArrow()
    )
    return np.sort(rows.column("id").to_numpy())


def log_ratios(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Log-ratio of target and raw share per bucket; the raw model counts every document."""
    ids = docs.sparkSession.sparkContext.broadcast(_good_ids(labels, doc_id, label))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = ids.value
        totals = np.zeros((2, BUCKETS), dtype=np.int64)
        for b in batches:
            for p in pieces(b, "text"):
                bucket, bounds = grams(words(p.column("text")))
                totals[1] += np.bincount(bucket, minlength=BUCKETS)
                own = np.isin(p.column("id").fill_null(-(1 << 62)).to_numpy(), good)
                if own.any():
                    totals[0] += np.bincount(bucket[np.repeat(own, np.diff(bounds))], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS), pa.int64()), pa.array(totals[0]), pa.array(totals[1])],
            ["bucket", "target", "raw"],
        )

    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    table = (
        given.mapInArrow(count, "bucket long, target long, raw long").groupBy("bucket")
        .agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    )
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if len(table):
        at = table.column("bucket").to_numpy()
        target[at], raw[at] = table.column("target").to_numpy(), table.column("raw").to_numpy()
    if not target.any():
        return np.zeros(BUCKETS)
    share = (target + ADD) / (target.sum() + ADD * BUCKETS)
    return np.log(share) - np.log((raw + ADD) / (raw.sum() + ADD * BUCKETS))


def resample(
    docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = 23, doc_id: str = "doc_id",
    text: str = "text", label: str = "quality",
) -> DataFrame:
    """id, log_ratio, draw, kept of every row; exactly round(share * rows) rows are kept.

    log_ratio is the mean over the document's grams (its end counts as a word, so empty and
    null texts have one); draw is the Gumbel key.  Ties are kept by id (nulls first), then by a
    hash of the text; rows alike in all of these are told apart arbitrarily.  Without good
    labels every log_ratio is 0 and the sample is uniform.
    """
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, doc_id, text, label))
    kind = docs.schema[doc_id].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratios.value
        for b in batches:
            for p in pieces(b, "text"):
                bucket, bounds = grams(words(p.column("text")))
                mean = np.add.reduceat(table[bucket], bounds[:-1]) / np.diff(bounds)
                uniform = (p.column("key").to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5
                draw = SHARPNESS * mean - np.log(-np.log(uniform / 2.0**53))
                yield pa.RecordBatch.from_arrays(
                    [p.column("id"), p.column("key"), pa.array(mean), pa.array(draw), pa.array(_ordered(draw))],
                    ["id", "key", "log_ratio", "draw", "rank"],
                )

    given = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    rows = cut(given.mapInArrow(score, f"id {kind}, key long, log_ratio double, draw double, rank long"))
    tie = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    row = F.monotonically_increasing_id()
    # Larger comes first in each: by rank, then among ties by id, hash and row.
    order = {"_0": F.col("rank"), "_1": F.bitwise_not(tie), "_2": F.col("key"), "_3": F.bitwise_not(row)}
    rows = rows.withColumns(order)
    kept = _largest(rows, list(order), round(share * rows.count()))
    return rows.select("id", "log_ratio", "draw", kept.alias("kept"))


def _largest(rows: DataFrame, order: list[str], keep: int) -> Column:
    """Condition that holds for exactly `keep` rows, the largest by the columns in turn.

    Each step counts the open rows by the next digit and settles all digits but one.
    """
    kept, left = F.lit(False), F.lit(True)
    for column in order:
        for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
            digit = F.shiftright(column, shift)
            counts = rows.filter(left).groupBy(digit.alias("d")).count().collect()
            edge = None
            for value, many in sorted(map(tuple, counts), reverse=True):
                if many > keep:
                    edge = value
                    break
                keep -= many
            if edge is None:
                return kept | left
            kept = kept | (left & (digit > edge))
            left = left & (digit == edge)
            if keep == 0:
                return kept
    return kept


def _ordered(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
