"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is planned on the histogram of
lengths, whatever the number of documents: pieces above a third of the capacity pair at most
twice per sequence by greedy matching (largest first, each with the largest partner that
fits); smaller ones, largest first, go to the smallest gap that holds them.  The plan is a
list of runs (length, ranks, sequences, offset) whose number is bounded by the capacity, not
by the data; every piece finds its place by its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmap.llm.text import Words, pieces, words
from voltmap.session import cut

CAPACITY = 4096
END = 1
#: Distinct parts of words whose ids a worker remembers; beyond it, it starts anew.
REMEMBERED = 1 << 20
#: Pieces that are ranked together, about.
RANKED = 20_000

_encoders: dict[str, Encoder] = {}

#: Texts that a tokenizer must encode as it encodes their parts for these to be encoded alone.
PROBES = ["", "The THE the, thE.", "Ab.Cd  e!?f\tG-h's \n x", "Été ÊTRE, naïve. Über", "a1b2 33. (word) 'tis", "one,two ;three... «four»"]


#: Bytes of letters of one kind: A-Z, a-z and the Latin letters U+00C0 to U+027F.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:0xCA] = _LETTER[0x80:0xC0] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def parts(found: Words) -> Words:
    """Cut each word of Latin letters with ASCII marks at its end into letters and marks.

    Other words stay whole.  U+00D7 and U+00F7 lie among the letters but are none; U+0130 is one,
    but its lower case ends in a combining mark, which goes with a sign that follows.
    """
    data = found.data
    other = ~_LETTER[data]
    for first, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):
        other[np.flatnonzero((data[:-1] == first) & (data[1:] == second))] = True
    last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data)))) + 1 if len(data) else data
    others = np.concatenate([[0], np.cumsum(other, dtype=np.int64)])
    stem = np.maximum(last[found.ends - 1], found.starts) if len(found.starts) else found.ends
    two = (stem > found.starts) & (stem < found.ends) & (others[stem] == others[found.starts])
    first = np.arange(len(two)) + np.concatenate([[0], np.cumsum(two)[:-1]]) if len(two) else np.zeros(0, np.int64)
    n = len(two) + int(two.sum())
    starts, ends = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    starts[first], ends[first] = found.starts, np.where(two, stem, found.ends)
    starts[first[two] + 1], ends[first[two] + 1] = stem[two], found.ends[two]
    return Words(data, starts, ends, np.append(first, n)[found.bounds])


class Encoder:
    """Token ids of texts, remembering the ids of parts of words in a table by hash.

    For a tokenizer that ignores the case of letters, splits at white space and between letters
    and marks, and never joins across a split, a text's ids are those of its parts in turn.
    Others, told by PROBES, encode every text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()
        whole, by_parts = self._whole(pa.array(PROBES)), self._by_parts(pa.array(PROBES))
        self.parted = all(np.array_equal(x, y) for x, y in zip(whole, by_parts))

    def forget(self) -> None:
        self.keys = np.zeros(2 * REMEMBERED, dtype=np.uint64)
        self.number = np.zeros(2 * REMEMBERED, dtype=np.int32)
        self.pool, self.begins = np.zeros(1 << 20, dtype="<u4"), np.zeros(REMEMBERED + 1, dtype=np.int32)
        self.known = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key in the table; -1 if it is not there."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, slot = np.arange(len(keys)), keys & mask
        while len(todo):
            there = self.keys[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.number[slot[hit]]
            on = ~hit & (there != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _insert(self, keys: np.ndarray) -> None:
        mask = np.uint64(len(self.keys) - 1)
        todo, slot = np.arange(len(keys)), keys & mask
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.number[slot[won]] = self.known + todo[won]
            todo, slot = todo[~won], (slot[~won] + np.uint64(1)) & mask

    def _learn(self, keys: np.ndarray, texts: list[str], together: int = 4096) -> None:
        end = int(self.begins[self.known])
        self._insert(keys)
        for at in range(0, len(texts), together):
            part = texts[at : at + together]
            begins = np.cumsum([0] + [len(t) + 1 for t in part])
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            firsts = np.array([a for a, _ in found.offsets], dtype=np.int64)
            while end + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[end : end + len(ids)] = ids
            self.begins[self.known : self.known + len(part) + 1] = end + np.searchsorted(firsts, begins)
            end += len(ids)
            self.known += len(part)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, without ends, and the range of each text."""
        return self._by_parts(texts) if self.parted else self._whole(texts)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
        flat = np.array([i for x in ids for i in x], dtype="<u4")
        return flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)

    def _by_parts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = parts(words(texts))
        keys = np.maximum(found.hashes(), np.uint64(1))
        # One long text may have more distinct parts than the table holds: they are encoded in turn.
        done = [self._encode(found, keys, at) for at in range(0, len(keys), REMEMBERED)]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(i for i, _ in done)])
        lengths = np.concatenate([np.zeros(0, dtype=np.int64), *(n for _, n in done)])
        return ids, np.concatenate([[0], np.cumsum(lengths)])[found.bounds]

    def _encode(self, found: Words, keys: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of at most REMEMBERED parts, from number `low` on, and how many each part has."""
        keys = keys[low : low + REMEMBERED]
        number = self._find(keys)
        if (missing := np.flatnonzero(number < 0)).size:
            new, first = np.unique(keys[missing], return_index=True)
            if self.known + len(new) > REMEMBERED:
                self.forget()
                new, missing = np.unique(keys, return_index=True)
                first = slice(None)
            raw = found.data
            at = low + missing[first]
            spans = zip(found.starts[at].tolist(), found.ends[at].tolist())
            # The key sees A-Z in lower case, so any spelling of it will do.
            self._learn(new, [raw[a:b].tobytes().decode() for a, b in spans])
            number = self._find(keys)
        begins = self.begins[number].astype(np.int64)
        lengths = self.begins[number + 1] - begins
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[np.repeat(begins - ends[:-1], lengths) + np.arange(ends[-1])], lengths


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id",
    text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """(id, key, piece, start, length, ids_crc32[, ids]) of each document's pieces.

    A document is its text's ids, then END; null and empty texts are END alone.  Only longer
    documents are cut, every `capacity` tokens.  `key` is a hash of id and text.
    """
    path = tokenizer or default_tokenizer()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        last = np.array([END], dtype="<u4").tobytes()
        for b in (p for whole in batches for p in pieces(whole, "text")):
            ids, bounds = encoder.encode(b.column("text"))
            out: list[tuple] = []
            for number in range(len(b)):
                own = ids[bounds[number] : bounds[number + 1]].tobytes() + last
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    out.append((number, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            number, piece, start, length, crc, part = zip(*out) if out else [()] * 6
            number = pa.array(number, pa.int64())
            columns = [
                b.column("id").take(number), b.column("key").take(number), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            names = ["id", "key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(part, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.lit(31), F.col(doc_id).cast("string"), F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    schema = f"id {kind}, key long, piece int, start long, length long, ids_crc32 long"
    return given.mapInArrow(rows, schema + (", ids binary" if with_ids else ""))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, offset).

    Piece number r of a run goes to sequence first + r // per and there to
    offset + (r % per) * length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, rank[length], n, first, per, offset))
        rank[length] += n
        left[length] -= n

    def keep(gap: int, first: int, many: int) -> None:
        if gap and many:
            if gap not in ranges:
                insort(gaps, gap)
                ranges[gap] = []
            ranges[gap].append((first, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            partner = next(
                (m for m in reversed(large[: bisect_left(large, min(length, capacity - length) + 1)])
                 if left[m] and (m < length or left[m] > 1)), None,
            )
            if partner is None:
                n, used = left[length], length
                put(length, n, opened, 1, 0)
            elif partner == length:
                n, used = left[length] // 2, 2 * length
                put(length, 2 * n, opened, 2, 0)
            else:
                n, used = min(left[length], left[partner]), length + partner
                put(length, n, opened, 1, 0)
                put(partner, n, opened, 1, length)
            keep(capacity - used, opened, n)
            opened += n

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                many = -(-left[length] // (capacity // length))
                keep(capacity, opened, many)
                opened += many
                continue
            gap = gaps[i]
            first, many = ranges[gap].pop()
            if not ranges[gap]:
                del ranges[gap], gaps[i]
            per = gap // length
            full = min(many, left[length] // per)
            if full:
                put(length, full * per, first, per, capacity - gap)
                keep(gap - per * length, first, full)
            first, many = first + full, many - full
            if many and left[length]:
                n = min(left[length], per)
                put(length, n, first, n, capacity - gap)
                keep(gap - n * length, first, 1)
                first, many = first + 1, many - 1
            keep(gap, first, many)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (of `tokenize`) with sequence_id and offset.

    Repeated rows are packed one by one; an empty table gives no rows.  Ranks go by hash,
    so a length that a third of all pieces share is ranked in many small groups.
    """
    held = cut(pieces)
    counts = {int(r[0]): int(r[1]) for r in held.groupBy("length").count().collect()}
    groups = sum(counts.values()) // RANKED + 64
    held = held.withColumn("_group", F.pmod(F.xxhash64(F.lit(7), "key", "piece"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.groupBy("length", "_group").agg(F.count("*").alias("_n")).withColumn(
        "_begins", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    inside = Window.partitionBy("length", "_group").orderBy("key", "piece")
    ranked = (
        held.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(begins.drop("_n"), ["length", "_group"])
        .withColumn("_rank", F.col("_rank") + F.col("_begins"))
    )
    runs = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 6)
    shared = pieces.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf(T.StructType([T.StructField("s", T.LongType()), T.StructField("o", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        table = shared.value
        wide = np.int64(1) << 45
        run = table[np.searchsorted(table[:, 0] * wide + table[:, 1], length * wide + rank, "right") - 1]
        nth = rank.to_numpy() - run[:, 1]
        return pd.DataFrame({"s": run[:, 3] + nth // run[:, 4], "o": run[:, 5] + nth % run[:, 4] * run[:, 0]})

    placed = ranked.withColumn("_at", place("length", "_rank"))
    return placed.select(
        *pieces.columns, F.col("_at.s").alias("sequence_id"), F.col("_at.o").alias("offset")
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the token ids of each sequence, from pieces packed with their ids.

    A group is one sequence, so it never holds more than the capacity.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.transform(parts, lambda p: p["ids"]).alias("parts")
    ).select("sequence_id", "length", F.expr("aggregate(parts, binary(''), (a, b) -> a || b)").alias("ids"))
