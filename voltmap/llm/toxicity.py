"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts, per token feature, how many labelled documents have it.  Features are a
word and its first bytes; a Dirichlet prior chains them, from the base rate over the shortest
prefix to the whole word, so unseen forms of a known stem keep the stem's odds.  A token's
score is its log-odds above the base rate less a drift.  A linear scan finds all maximal
scoring segments of a text; the extreme-value law of the best segment of harmless text
(lambda, K) says which are significant, and a logistic curve over that evidence, fitted on
labelled documents that the counts have not seen, turns it into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltmap.llm.text import Words, distinct, pieces, words

THRESHOLD = 0.3
WIDTHS = (4, 5, 6, None)
#: The fit is on a bounded sample: so many labelled rows at most, by hash, and so many features.
MAX_LABELS = 200_000
MAX_FEATURES = 500_000
PRIOR = 2.0
DRIFT = 1.0
LEAST_TOXIC = 3
ALPHA = 0.05


@dataclass
class Model:
    base: float
    keys: list[np.ndarray]
    toxic: list[np.ndarray]
    seen: list[np.ndarray]
    scale: float = 1.0
    k: float = 1.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def token_scores(self, found: Words) -> np.ndarray:
        hashes = found.prefix_hashes(WIDTHS)
        _, first, inverse = np.unique(hashes[-1], return_index=True, return_inverse=True)
        rate = np.full(len(first), self.base)
        for level, own in enumerate(hashes):
            keys = self.keys[level]
            if not len(keys):
                continue
            own = own[first]
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = keys[at] == own
            at = at[hit]
            rate[hit] = (self.toxic[level][at] + PRIOR * rate[hit]) / (self.seen[level][at] + PRIOR)
        odds = np.log(rate / (1 - rate)) - math.log(self.base / (1 - self.base)) - DRIFT
        return odds[inverse]

    def passages(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        return maximal_segments(scores)

    def significant(self, score: float, n: int) -> float:
        """Evidence above the significance bound, in nats; negative if not significant."""
        return self.scale * score - math.log(self.k * n) + math.log(-math.log1p(-ALPHA))

    def evidence(self, segments: list[float], n: int) -> np.ndarray:
        above = [e for s in segments if (e := self.significant(s, n)) > 0]
        best = self.scale * max(segments, default=0.0) - math.log(self.k * max(n, 1))
        return np.array([1.0, min(max(best, -20.0), 20.0), math.log1p(sum(above)), math.log1p(len(above))])

    def probability(self, segments: list[float], n: int) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.evidence(segments, n) @ self.weights, -30, 30))))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), left to right, in linear time.

    Only positive tokens are visited: a segment begins and ends at one.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0).tolist():
        begin, low, high = i, sums[i], sums[i + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            begin, low = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
        found.append((begin, i + 1, low, high))
    return [(b, e, high - low) for b, e, low, high in found]


def _labelled(labels: DataFrame, doc_id: str, label: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (sorted), labels and folds of the training rows; repeated ids count once, as toxic if any is."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    rows = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (remainder != 2))
        .groupBy(F.col(doc_id).cast("long").alias("id"))
        .agg(F.max(label).alias("toxic"))
        .orderBy(F.xxhash64(F.lit(3), "id"))
        .limit(MAX_LABELS)
        .select("id", F.col("toxic").cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(4)).alias("f"))
        .toArrow()
        .sort_by("id")
    )
    return tuple(rows.column(c).to_numpy() for c in ("id", "toxic", "f"))


def _pick(batch: pa.RecordBatch, ids: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose id is among `ids`, and their places there."""
    if not len(ids):
        return batch.slice(0, 0), np.zeros(0, dtype=np.int64)
    own = batch.column("id").cast(pa.int64()).fill_null(-(1 << 62)).to_numpy()
    at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
    hit = np.flatnonzero(ids[at] == own)
    return batch.take(pa.array(hit)), at[hit]


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> Model:
    """Fit on labelled rows whose crc32(id as text) mod 4 is not 2.

    Three quarters of them give the counts, the rest the extreme-value law and the curve.
    Without labels of both kinds, every score is the base rate (0.5 if there is none).
    """
    spark = docs.sparkSession
    ids, toxic, fold = _labelled(labels, doc_id, label)
    counting, fitting = fold != 0, fold == 0
    base = float((toxic[counting].sum() + 0.5) / (counting.sum() + 1))
    empty = [np.zeros(0, dtype=np.uint64)] * len(WIDTHS)
    model = Model(base, empty, empty, empty)
    if not toxic[counting].any() or not toxic[fitting].any() or toxic.all():
        model.weights[0] = math.log(base / (1 - base)) if len(ids) else 0.0
        return model
    given = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    shared = spark.sparkContext.broadcast((ids[counting], toxic[counting]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, toxic = shared.value
        for b in batches:
            chosen, at = _pick(b, ids)
            done = 0
            for p in pieces(chosen, "text"):
                mark = toxic[at[done : done + len(p)]].astype(np.int64)
                done += len(p)
                found = words(p.column("text"))
                for level, own in enumerate(found.prefix_hashes(WIDTHS)):
                    values, bounds = distinct(own, found.bounds)
                    key, inverse = np.unique(values, return_inverse=True)
                    bad = np.bincount(inverse, np.repeat(mark, np.diff(bounds)), len(key))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), level, dtype=np.int32)), pa.array(key.view(np.int64)),
                         pa.array(bad.astype(np.int64)), pa.array(np.bincount(inverse, minlength=len(key)))],
                        ["level", "key", "toxic", "seen"],
                    )

    table = (
        given.mapInArrow(count, "level int, key long, toxic long, seen long")
        .groupBy("level", "key")
        .agg(F.sum("toxic").alias("toxic"), F.sum("seen").alias("seen"))
        .filter(F.col("toxic") >= LEAST_TOXIC)
        .orderBy(F.desc("toxic"), "level", "key")
        .limit(MAX_FEATURES)
        .toArrow()
    )
    level = table.column("level").to_numpy()
    key = table.column("key").to_numpy().view(np.uint64)
    for name, values in (("keys", key), ("toxic", table.column("toxic").to_numpy()), ("seen", table.column("seen").to_numpy())):
        order = np.argsort(key, kind="stable")
        setattr(model, name, [values[order[level[order] == i]] for i in range(len(WIDTHS))])
    return _calibrate(given, model, ids[fitting], toxic[fitting])


def _calibrate(given: DataFrame, model: Model, ids: np.ndarray, toxic: np.ndarray) -> Model:
    """Extreme-value law from harmless documents, then the logistic curve; all on the bounded sample."""
    shared = given.sparkSession.sparkContext.broadcast((model, ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids = shared.value
        for b in batches:
            chosen, at = _pick(b, ids)
            done = 0
            for p in pieces(chosen, "text"):
                found = words(p.column("text"))
                scores = model.token_scores(found)
                rows = []
                for i in range(len(p)):
                    own = scores[found.bounds[i] : found.bounds[i + 1]]
                    value, many = np.unique(np.round(own, 1), return_counts=True)
                    segments = [s for _, _, s in maximal_segments(own)]
                    rows.append((int(at[done + i]), len(own), segments, value.tolist(), many.tolist()))
                done += len(p)
                columns = list(zip(*rows)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["at", "n", "segments", "value", "many"]
                )

    schema = "at long, n long, segments array<double>, value array<double>, many array<long>"
    rows = given.mapInArrow(scan, schema).toArrow().to_pylist()
    rows = [r for r in rows if r["n"]]
    calm = [r for r in rows if not toxic[r["at"]]]
    tokens: dict[float, int] = {}
    for r in calm:
        for value, many in zip(r["value"], r["many"]):
            tokens[value] = tokens.get(value, 0) + many
    if not calm or len(calm) == len(rows):
        return model
    value, share = np.array(list(tokens)), np.array(list(tokens.values()), dtype=float)
    share /= share.sum()
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (share * np.exp(np.minimum(mid * value, 700))).sum() > 1 else (mid, high)
    model.scale = low
    # The mean of a Gumbel law lies Euler's constant above its mode, ln(K n).
    mode = np.mean([low * max(r["segments"], default=0.0) - math.log(r["n"]) for r in calm]) - 0.5772156649
    model.k = math.exp(mode)
    x = np.array([model.evidence(r["segments"], r["n"]) for r in rows])
    model.weights = _logistic(x, np.array([toxic[r["at"]] for r in rows], dtype=float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += step / max(1.0, np.abs(step).max() / 2)
    return w


def scorer(spark: SparkSession, model: Model):
    """Column function: text -> probability of the toxic label; null and empty texts have no tokens."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for p in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            found = words(p.column("text"))
            tokens = model.token_scores(found)
            for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
                segments = [s for _, _, s in maximal_segments(tokens[a:b])]
                out.append(model.probability(segments, b - a))
        return pa.array(out, pa.float64())

    return score


def passages(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, begin, end, score, p_value, passage) of every significant toxic passage.

    begin and end count code points of the text; p_value is that of the extreme-value law.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    span = "array<struct<begin: long, end: long, score: double, p_value: double, passage: string>>"

    @F.arrow_udf(span)
    def spans(texts: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for p in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            found = words(p.column("text"))
            tokens = model.token_scores(found)
            raw = found.data.tobytes()
            for i, text in enumerate(p.column("text").to_pylist()):
                a, b = found.bounds[i], found.bounds[i + 1]
                own, origin = [], int(found.starts[a]) if b > a else 0
                lead = len(text) - len(text.lstrip(" \t\n\v\f\r")) if text else 0
                for begin, end, s in maximal_segments(tokens[a:b]):
                    if model.significant(s, b - a) > 0:
                        low, high = int(found.starts[a + begin]), int(found.ends[a + end - 1])
                        passage = raw[low:high].decode()
                        at = lead + len(raw[origin:low].decode())
                        p_value = -math.expm1(-model.k * (b - a) * math.exp(-model.scale * s))
                        own.append({"begin": at, "end": at + len(passage), "score": s, "p_value": p_value, "passage": passage})
                out.append(own)
        fields = [("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64()), ("passage", pa.string())]
        return pa.array(out, pa.list_(pa.struct(fields)))

    found = docs.select(F.col(doc_id).cast(kind).alias("id"), F.explode(spans(F.col(text))).alias("span"))
    return found.select("id", "span.*")


def held_out(doc_id: str | Column) -> Column:
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))
