"""Tokens of two tokenizers aligned by the bytes they cover.

Both tokenize the same bytes.  A byte offset where a token of each ends is a cut; between
two cuts lies a group, and tokens of one group are linked.  Cuts are found by divide and
conquer: the end nearest to the middle of a stretch that a bisection finds among the other
tokenizer's ends splits it, both halves go on, and a stretch without one is a leaf.  All
stretches of a batch are halved at once in numpy.

Tokenizing is shared between equal stretches of text: neither tokenizer joins a space
to a character other than white space before it, so texts part there and each distinct part is
encoded once per worker.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltmap.llm import text as T
from voltmap.session import cut, shared_folder

#: Ids of either tokenizer are below 2**ID_BITS.
ID_BITS = 22
#: Most (pair, count) rows that one pass broadcasts; further pairs go in further passes.
PASS_PAIRS = 1 << 21
#: Links of a group above this are counted by distinct ids instead of being listed.
LISTED_LINKS = 1 << 12
#: Parts remembered by a worker; beyond it, it forgets all but the most frequent half.
REMEMBERED = 1 << 19
#: Text handled at once, in bytes.
PIECE_BYTES = 1 << 18

_encoders: dict[tuple[str, str], Encoder] = {}
_PART = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indexes of the ends in `a` that `b` has too, in order.

    `a` and `b` are increasing; stretch i is a[first[i]..last[i]], whose last end is shared.
    Every other end is tried once: what a search from the middle has passed is left out
    of both halves.
    """
    found = [last]
    low, high = first, last  # open for search: low <= index < high
    while len(low):
        some = low < high
        low, high = low[some], high[some]
        mid = (low + high) >> 1
        pick = np.full(len(low), -1, dtype=np.int64)
        left, right = mid.copy(), mid.copy()  # tried so far: left <= index < right
        searching, step = np.arange(len(low)), 0
        while len(searching):
            at = mid[searching] + ((step + 1) >> 1 if step & 1 else -(step >> 1))
            inside = (at >= low[searching]) & (at < high[searching])
            tried, at = searching[inside], at[inside]
            left[tried] = np.minimum(left[tried], at)
            right[tried] = np.maximum(right[tried], at + 1)
            value = a[at]
            place = np.minimum(np.searchsorted(b, value), len(b) - 1)
            hit = b[place] == value
            pick[tried[hit]] = at[hit]
            rest = searching[pick[searching] < 0]
            searching = rest[(left[rest] > low[rest]) | (right[rest] < high[rest])]
            step += 1
        split = pick >= 0
        found.append(pick[split])
        # Beyond the pick everything that was tried on the way is known not to be shared.
        low, high = (
            np.concatenate([low[split], np.maximum(right[split], pick[split] + 1)]),
            np.concatenate([np.minimum(left[split], pick[split]), high[split]]),
        )
    return np.sort(np.concatenate(found))


class Encoder:
    """Ids and byte lengths of both tokenizers for the parts of texts."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        a_size, b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        if max(a_size, b_size) > 1 << ID_BITS:
            raise ValueError(f"ids do not fit {ID_BITS} bits")
        signs = _byte_signs()
        self.a_bytes = [bytes(signs[c] for c in self.a.id_to_token(i) or "" if c in signs) for i in range(a_size)]
        self.b_bytes = [_piece_bytes(self.b, i) for i in range(b_size)]
        if any(" " in x.lstrip(" ") for x in (self.b.id_to_piece(i).replace("▁", " ") for i in range(b_size))):
            raise ValueError("pieces reach over spaces: texts cannot be parted there")
        self.a_length = np.array([len(x) for x in self.a_bytes], dtype=np.int64)
        self.b_length = np.array([len(x) for x in self.b_bytes], dtype=np.int64)
        ends = [(",", "|"), (",", ";")]
        sizes = (a_size, b_size)
        self.names = [f"{i}{end}" for (inner, outer), n in zip(ends, sizes) for end in (inner, outer) for i in range(n)]
        self.b_space = [self.b.piece_to_id("▁")]
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        self.bounds = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.faithful, self.uses = np.zeros(0, dtype=bool), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the most used half of the parts."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: REMEMBERED // 2])
        parts = list(self.known)
        self.known = {parts[i]: k for k, i in enumerate(keep.tolist())}
        for k in range(2):
            self.ids[k], length = self._gather(k, keep)
            self.bounds[k] = np.concatenate([[0], np.cumsum(length)])
        self.faithful, self.uses = self.faithful[keep], self.uses[keep] >> 1

    def _gather(self, k: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the k-th tokenizer for numbered parts in turn, and how many each has."""
        bounds = self.bounds[k]
        length = bounds[parts + 1] - bounds[parts]
        at = np.repeat(bounds[parts] - np.cumsum(length) + length, length) + np.arange(length.sum())
        return self.ids[k][at], length

    def _learn(self, parts: list[str]) -> None:
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in parts], num_threads=1)
        # An empty rest would be encoded to nothing, without the space before it.
        b = [self.b_space if p == " " else x for p, x in zip(parts, b)]
        raw = [p.encode() for p in parts]
        same = np.ones(len(parts), dtype=bool)
        for k, (made, pieces) in enumerate(((a, self.a_bytes), (b, self.b_bytes))):
            counts = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
            flat = np.fromiter(chain.from_iterable(made), np.int32, int(counts[-1]))
            said = [pieces[i] for i in flat.tolist()]
            upto = np.concatenate([[0], np.cumsum((self.a_length, self.b_length)[k][flat])])[counts]
            if b"".join(said) != b"".join(raw) or not np.array_equal(upto, np.cumsum([len(x) for x in raw])):
                ends = [0, *counts.tolist()]
                same &= [b"".join(said[i:j]) == x for i, j, x in zip(ends[:-1], ends[1:], raw)]
            self.bounds[k] = np.concatenate([self.bounds[k], self.bounds[k][-1] + counts])
            self.ids[k] = np.concatenate([self.ids[k], flat])
        self.faithful = np.concatenate([self.faithful, same])
        self.uses = np.concatenate([self.uses, np.zeros(len(parts), np.int64)])

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """[(ids, bounds by text)] of both tokenizers; a text that either one alters has no ids."""
        if len(self.known) > REMEMBERED:
            self._forget()
        parts = [_PART.findall(" " + x) if x else [] for x in texts]
        every = list(chain.from_iterable(parts))
        new = [p for p in dict.fromkeys(every) if p not in self.known]
        if new:
            begin = len(self.known)
            self._learn(new)
            self.known.update(zip(new, range(begin, begin + len(new))))
        flat = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        self.uses += np.bincount(flat, minlength=len(self.uses))
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), counts)
        altered = np.zeros(len(parts), dtype=bool)
        altered[owner[~self.faithful[flat]]] = True
        flat, owner = flat[~altered[owner]], owner[~altered[owner]]
        out = []
        for k in range(2):
            ids, length = self._gather(k, flat)
            by_text = np.bincount(owner, weights=length, minlength=len(parts)).astype(np.int64)
            out.append((ids.astype(np.int64), np.concatenate([[0], np.cumsum(by_text)])))
        return out


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(moved)}


def _piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def _links(a, b, a_bounds, b_bounds, owner) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair of ids, links) summed by text and pair, from the groups' ranges of tokens."""
    n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
    size = n_a * n_b
    listed = size <= LISTED_LINKS
    each = size[listed]
    base = np.repeat(np.cumsum(each) - each, each)
    k = np.arange(each.sum()) - base
    wide = np.repeat(n_b[listed], each)
    left = a[np.repeat(a_bounds[:-1][listed], each) + k // np.maximum(wide, 1)]
    right = b[np.repeat(b_bounds[:-1][listed], each) + k % np.maximum(wide, 1)]
    docs, pairs, times = [np.repeat(owner[listed], each)], [left << ID_BITS | right], [np.ones(len(k), np.int64)]
    for g in np.flatnonzero(~listed):
        x, x_times = np.unique(a[a_bounds[g] : a_bounds[g + 1]], return_counts=True)
        y, y_times = np.unique(b[b_bounds[g] : b_bounds[g + 1]], return_counts=True)
        pairs.append((x[:, None] << ID_BITS | y[None, :]).ravel())
        times.append((x_times[:, None] * y_times[None, :]).ravel())
        docs.append(np.full(len(pairs[-1]), owner[g]))
    docs, pairs, times = np.concatenate(docs), np.concatenate(pairs), np.concatenate(times)
    order = np.lexsort((pairs, docs))
    docs, pairs, times = docs[order], pairs[order], times[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (pairs[1:] != pairs[:-1])
    begins = np.flatnonzero(new)
    return docs[begins], pairs[begins], np.add.reduceat(times, begins) if len(begins) else times


def align(encoder: Encoder, texts: list[str | None]) -> dict[str, list | np.ndarray]:
    """Counts, digest and linked pairs of each text."""
    (a, a_of), (b, b_of) = encoder.encode(texts)
    n = len(texts)
    ends_a, ends_b = np.cumsum(encoder.a_length[a]), np.cumsum(encoder.b_length[b])
    full = np.flatnonzero(np.diff(a_of))
    cuts = shared_cuts(ends_a, ends_b, a_of[:-1][full], a_of[1:][full] - 1) if len(full) else np.zeros(0, np.int64)
    a_bounds = np.concatenate([[0], cuts + 1])
    b_bounds = np.concatenate([[0], np.searchsorted(ends_b, ends_a[cuts]) + 1]) if len(cuts) else np.zeros(1, np.int64)
    owner = np.searchsorted(a_of, cuts, "right") - 1
    n_a, n_b = np.diff(a_bounds), np.diff(b_bounds)
    # Tokens in the order of the digest: the first ids of a group, then the second ones.
    group_a, group_b = np.repeat(np.arange(len(cuts)), n_a), np.repeat(np.arange(len(cuts)), n_b)
    codes = np.empty(len(a) + len(b), dtype=np.int64)
    a_size, b_size = len(encoder.a_bytes), len(encoder.b_bytes)
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    last_a[a_bounds[1:] - 1] = True
    last_b[b_bounds[1:] - 1] = True
    codes[np.arange(len(a)) + b_bounds[group_a]] = a + last_a * a_size
    codes[np.arange(len(b)) + a_bounds[group_b + 1]] = b + last_b * b_size + 2 * a_size
    names = encoder.names
    spots = a_of + b_of
    digests = []
    for i in range(n):
        own = codes[spots[i] : spots[i + 1]]
        if len(own):
            said = "".join([names[c] for c in own.tolist()])
            digests.append(hashlib.sha256(said[:-1].encode()).hexdigest())
        else:
            digests.append("")
    docs, pairs, times = _links(a, b, a_bounds, b_bounds, owner)
    return {
        "n_a": np.diff(a_of), "n_b": np.diff(b_of),
        "n_groups": np.bincount(owner, minlength=n).astype(np.int64),
        "n_links": np.bincount(owner, weights=n_a * n_b, minlength=n).astype(np.int64) if n else np.zeros(0, np.int64),
        "groups_sha256": digests,
        "pairs": pairs, "times": times, "bounds": np.searchsorted(docs, np.arange(n + 1)),
    }


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: row, id, the counts, the digest, and the linked pairs with their links."""
    read = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = read.schema["id"].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoders.get((a_path, b_path)) or _encoders.setdefault((a_path, b_path), Encoder(a_path, b_path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in T.pieces(batch, "text", PIECE_BYTES):
                n = piece.num_rows
                made = align(encoder, piece.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), piece.column("id"),
                        *[pa.array(made[x], pa.int64()) for x in ("n_a", "n_b", "n_groups", "n_links")],
                        pa.array(made["groups_sha256"], pa.string()),
                        T.lists(made["pairs"], made["bounds"], pa.int64()),
                        T.lists(made["times"], made["bounds"], pa.int64()),
                    ],
                    ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )
                row += n

    return read.mapInArrow(step, f"row long, id {kind}, {_FIELDS}, pairs array<long>, times array<long>")


def score(
    docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", pass_pairs: int = PASS_PAIRS
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A pair's count is the number of rows that link it; n_best are the links whose count is the
    highest of their first id, count_sum adds the counts of all links.  Null and empty texts,
    and texts that a tokenizer does not give back byte for byte, have no tokens: zeros and an
    empty digest.  Repeated rows, rows without an id and tied counts count each; an empty table
    gives no rows; a text is held whole by one task, of whatever length.  Other columns are
    not read.

    Documents are tokenized once; their pairs wait in the shared folder for the corpus-wide
    counts, which go back in passes of `pass_pairs` pairs, joined where the documents lie.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    aligned(docs, a_path, b_path, id, text).write.parquet(folder)
    stored = spark.read.parquet(folder)
    links = stored.select("row", "times", F.posexplode("pairs").alias("at", "pair")).select(
        "row", "pair", F.get("times", F.col("at")).alias("links")
    )
    counts = links.groupBy("pair").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))
    counts = cut(counts.select("pair", "n", (F.col("n") == most).alias("best")))
    passes = max(-(-counts.count() // pass_pairs), 1)
    sums = None
    for k in range(passes):
        part = counts if passes == 1 else counts.filter(F.pmod(F.xxhash64("pair"), F.lit(passes)) == k)
        some = links.join(F.broadcast(part), "pair").groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("n")).alias("count_sum"),
        )
        some = some if passes == 1 else cut(some)
        sums = some if sums is None else sums.unionByName(some)
    if passes > 1:
        sums = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return stored.drop("pairs", "times").join(sums, "row", "left").select(
        "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
    )
