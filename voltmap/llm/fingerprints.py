"""Homomorphic multiset fingerprints of documents.

A fingerprint is the sum of one wide vector per paragraph, lane by lane modulo a power of two:
four 64-bit lanes from a cryptographic hash of the paragraph, and `LANES` 16-bit lanes to which
each run of three words of the paragraph adds +1 or -1.  Order does not matter, and a
paragraph is inserted or deleted by adding or subtracting its vector.  Equal multisets of
paragraphs have equal fingerprints; the 16-bit lanes estimate how much two of them share.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmap.llm.text import pieces, seeded, shingles, words

LANES = 256
WIDTH = 3
#: Rows of one sorted part, about.
PART_ROWS = 10_000
MAX_PARTS = 50_000


class Vectors:
    """Fingerprints of a batch: strong (n, 4) modulo 2**64 and soft (n, LANES) modulo 2**16."""

    def __init__(self, strong: np.ndarray, soft: np.ndarray):
        self.strong, self.soft = strong, soft

    @staticmethod
    def of(texts: list[str]) -> Vectors:
        paragraphs = [t.encode().split(b"\n") for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in paragraphs])]).astype(np.int64)
        flat = [x for p in paragraphs for x in p]
        digests = b"".join([hashlib.blake2b(x, digest_size=32).digest() for x in flat])
        each = np.frombuffer(digests, dtype="<u8").reshape(-1, 4)
        strong = np.add.reduceat(each, bounds[:-1], axis=0) if len(texts) else each
        found = words(pa.array(flat, pa.binary()))
        runs = shingles(found, found.hashes(), WIDTH)
        h = seeded(runs.values, 8)
        owner = np.searchsorted(runs.bounds[bounds], np.arange(len(h)), "right") - 1
        lane = owner * LANES + (h % np.uint64(LANES)).astype(np.int64)
        sign = 1.0 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1))
        soft = np.bincount(lane, sign, len(texts) * LANES).astype(np.int64).astype(np.uint16)
        return Vectors(strong, soft.reshape(-1, LANES))

    def text(self) -> list[str]:
        return [base64.b64encode(a.tobytes() + b.tobytes()).decode() for a, b in zip(self.strong, self.soft)]

    @staticmethod
    def read(fingerprints: list[str]) -> Vectors:
        raw = np.frombuffer(b"".join(map(base64.b64decode, fingerprints)), dtype=np.uint8)
        raw = raw.reshape(-1, 32 + 2 * LANES)
        return Vectors(raw[:, :32].copy().view("<u8"), raw[:, 32:].copy().view("<u2"))

    def rows(self, which) -> Vectors:
        return Vectors(self.strong[which], self.soft[which])


def likeness(a: Vectors, b: Vectors) -> np.ndarray:
    """Estimated share of common runs of words, 0 to 1 (1 for equal fingerprints)."""
    x, y = a.soft.view(np.int16).astype(np.float64), b.soft.view(np.int16).astype(np.float64)
    size = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    shared = np.where(size > 0, 2 * (x * y).sum(axis=1) / np.maximum(size, 1), 0.0)
    same = (a.strong == b.strong).all(axis=1) & (a.soft == b.soft).all(axis=1)
    return np.where(same, 1.0, np.clip(shared, 0, 1))


def _combine(sign: int):
    @F.arrow_udf(T.StringType())
    def combine(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = Vectors.read(a.to_pylist()), Vectors.read(b.to_pylist())
        if sign > 0:
            return pa.array(Vectors(x.strong + y.strong, x.soft + y.soft).text(), pa.string())
        return pa.array(Vectors(x.strong - y.strong, x.soft - y.soft).text(), pa.string())

    return combine


#: Column functions: the fingerprint with the paragraphs of another inserted, or deleted.
inserted, deleted = _combine(1), _combine(-1)


@F.arrow_udf(T.StringType())
def fingerprint(texts: pa.Array) -> pa.Array:
    """Column function: text -> fingerprint; null and empty texts are one empty paragraph."""
    out: list[str] = []
    for p in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        out += Vectors.of([t or "" for t in p.column("text").to_pylist()]).text()
    return pa.array(out, pa.string())


def with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of a document's code points replaced by as many from
    the start of the next document by id (after the last: the first).  Null texts are empty;
    null ids come first; rows with one id follow each other by a hash of their text; an empty
    table gives no rows.

    Documents are dealt to ranges of ids and sorted there; the first row of each range is
    sent to the range before as well, so neighbours meet without a join.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = given.count()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, min(rows // PART_ROWS, MAX_PARTS))
    lowest = -(1 << 63)
    at = F.coalesce(F.col("id").cast("long"), F.lit(lowest))
    found = given.select(at.cast("double").alias("x")).approxQuantile(
        "x", [i / parts for i in range(1, parts)], 0.1 / parts
    )
    cuts = np.array(sorted({int(x) for x in found}), dtype=np.int64)
    placed = given.withColumn("part", _part(cuts)(at))
    heads = sorted(placed.groupBy("part").agg(F.min(at).alias("head")).collect())
    # A part's last row is followed by the first of the next part, the last part's by the first of all.
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    goes = F.array_compact(
        F.array(
            F.struct("part", F.lit(0).alias("ahead")),
            F.when(_before(before)(at).isNotNull(), F.struct(_before(before)(at).alias("part"), F.lit(1).alias("ahead"))),
        )
    )
    both = placed.select("id", "text", F.explode(goes).alias("to")).select("id", "text", "to.*")
    dealt = both.repartitionById(len(cuts) + 1, "part").sortWithinPartitions(
        "part", "ahead", F.col("id").asc_nulls_first(), F.xxhash64("text")
    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for b in batches:
            for p in pieces(b, "text"):
                rows = pending + list(zip(*(p.column(c).to_pylist() for c in ("part", "ahead", "id", "text"))))
                yield from _edited(rows, p.schema.field("id").type)
                pending = rows[-1:]

    return dealt.mapInArrow(
        walk,
        f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def _edited(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last, whose follower is not here yet."""
    pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
    if not pairs:
        return
    texts = [t for *_, t in rows]
    at = [i for i, row in enumerate(rows[:-1]) if not row[1]]
    edited = []
    for i in at:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    plain, other = Vectors.of(texts), Vectors.of(edited)
    own, follower = plain.rows(at), plain.rows([i + 1 for i in at])
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][2] for i in at], kind), pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(own.text()),
            pa.array(other.text()), pa.array(likeness(own, other)), pa.array(likeness(own, follower)),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _part(cuts: np.ndarray):
    """Column function: the number of cuts at or below an id."""

    @F.arrow_udf(T.IntegerType())
    def part(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    return part


def _before(parts: dict[int, int]):
    """Column function: the part before the one that an id heads; null for other ids."""
    heads = np.array(sorted(parts), dtype=np.int64)
    follows = np.array([parts[h] for h in heads.tolist()], dtype=np.int32)

    @F.arrow_udf(T.IntegerType())
    def before(ids: pa.Array) -> pa.Array:
        own = ids.to_numpy()
        at = np.minimum(np.searchsorted(heads, own), len(heads) - 1)
        return pa.array(follows[at], pa.int32(), mask=heads[at] != own)

    return before
