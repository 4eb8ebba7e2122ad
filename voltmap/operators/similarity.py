"""Similar-string join without comparing all pairs.

Score: 1.0 when equal, 0.93 when one contains the other, else the matching-blocks
ratio 2*M/(len a + len b).  Candidates come from three equi-joins that together
miss nothing:

* equal texts;
* containment: the shorter text starts with a gram that occurs in the longer one;
* ratio >= t: at least m = t(la + lb)/2 characters match in order, so la - m of one text
  and lb - m of the other do not.  These are k edits.  One text is cut into segments, each of which may
  hold t edits, so that the sum of all t + 1 is k + 1.  Take the first segment up to whose end there
  are fewer edits than its own and the earlier ones' t + 1 come to, T being what the earlier ones' come
  to: between T and T + t edits stand before it, and the rest of T + t at most within it.  So it
  occurs in the other text with few edits, at one of the few places to which such a number of
  edits can shift it.

Keys meet by hash, and carry a signature of how often letters occur in place of the text; most pairs
that meet by chance end there.  A candidate is at most k edits apart before its ratio is computed.  Only
distinct texts take part; the ratio is computed in Arrow batches on the surviving pairs.  Rows per text are
exploded, which Spark's size estimates do not see, so these joins are never broadcast.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltmap import constants as K

GRAM = 8
#: Segments of so many characters are cut shorter, or found without edits.
LONG = 12


@F.pandas_udf(T.DoubleType())
def matching_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b)], dtype="float64")


def _unmatched(la: Column, lb: Column, cutoff: float) -> tuple[Column, Column]:
    """Characters of either text that may stay unmatched."""
    matched = F.ceil((la + lb) * F.lit(cutoff / 2) - F.lit(1e-6)).cast("int")
    return la - matched, lb - matched


def _lengths(text: str, cutoff: float) -> Column:
    """Lengths of the possible partners of a text."""
    n = F.length(text)
    shortest = F.ceil(n * F.lit(cutoff / (2 - cutoff)) - F.lit(1e-6)).cast("int")
    longest = F.floor(n * F.lit((2 - cutoff) / cutoff) + F.lit(1e-6)).cast("int")
    return F.explode(F.sequence(F.greatest(shortest, F.lit(1)), longest))


def _partners(df: DataFrame, text: str, other: DataFrame, other_text: str, cutoff: float) -> DataFrame:
    """`df` with `partner`, every length of its block's other texts that a partner may have."""
    there = other.select("block", F.length(other_text).alias("partner")).distinct()
    return df.withColumn("partner", _lengths(text, cutoff)).join(there, ["block", "partner"], "left_semi")


def _cut_up(df: DataFrame, la: Column, lb: Column, cutoff: float) -> DataFrame:
    """A row per segment of the text of length la: its number i, begin and size, edits it may hold and T before it.

    Segments hold one edit each, and one of them two or none where k is even; two, which takes
    more keys of a longer segment, where segments are short.  Long ones hold none.
    """
    da, db = _unmatched(F.col("la"), F.col("lb"), cutoff)
    k, i = F.col("da") + F.col("db"), F.col("i")
    even, short = F.col("even"), F.col("la") <= LONG * F.shiftright(k, 1)
    exact, two = F.col("exact"), F.col("two")
    n = F.when(exact, k + 1).otherwise(F.shiftright(k + F.lit(1), 1) + (even & ~two).cast("int"))
    # Places of the cuts: segments are as long as 2, 3 or 4 for no, one or two edits.
    def weight(i):
        before = 3 * i + (two & (i > 0)).cast("int") - (even & ~two & (i == F.col("n"))).cast("int")
        return F.when(exact, i).otherwise(before)

    def place(i):
        return F.floor(weight(i) * F.col("la") / weight(F.col("n"))).cast("int")

    cut = (
        df.withColumns({"la": la, "lb": lb}).withColumns({"da": da, "db": db})
        .withColumns({"exact": (k == 0) | (F.col("la") >= LONG * (k + 1)), "even": k % 2 == 0})
        .withColumn("two", even & ~exact & short).withColumn("n", n)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    )
    last = even & ~two & (i == F.col("n") - 1)
    return cut.withColumns(
        {
            "begin": place(i), "size": place(i + 1) - place(i),
            "may": F.when(exact | last, 0).when(two & (i == 0), 2).otherwise(1),
            "before": F.when(exact, i).otherwise(2 * i + (two & (i > 0)).cast("int")),
        }
    )


def _some(low: Column, high: Column, of) -> Column:
    """`of` each number from low to high, if any."""
    return F.when(low <= high, F.transform(F.sequence(low, high), of)).otherwise(F.array())


def _without(t: Column, p: Column) -> Column:
    return F.concat(F.substr(t, F.lit(1), p - 1), F.substr(t, p + 1))


def _less(t: Column, low: Column | int, high: Column) -> Column:
    """All texts that are `t` without one character, the low-th to the high-th."""
    return _some(F.lit(low), high, lambda p: _without(t, p))


def _two_less(t: Column, low: Column | int, high: Column) -> Column:
    """All texts that are `t` without two of its characters, the low-th to the high-th."""
    return F.flatten(
        _some(F.lit(low), high - 1, lambda p: _some(p, high - 1, lambda q: _without(_without(t, p), q)))
    )


def signature(text: str) -> Column:
    """How often letters occur: for each of 21 groups of letters as many bits as letters, 3 at most.

    A bit that one text has and another lacks is a letter of the one that finds no match.
    """
    return F.expr(
        f"aggregate(transform(sequence(1, length({text})), p -> (ascii(substr({text}, p, 1)) * 40503L >> 4) % 21 * 3), 0L, "
        "(s, at) -> s | ((s >> CAST(at AS int) & 3L) * 2 + 1) << CAST(at AS int))"
    )


def _keyed(cut: DataFrame, text: str, keys: list[Column], *carried: str) -> DataFrame:
    """(id, signature, meet, carried): a hash per key by which a segment meets a place in a partner.

    Ids are hashes as well: two texts of one id share their candidates, which are checked as texts.
    """
    meet = F.transform(
        F.array_distinct(F.concat(*keys)), lambda key: F.xxhash64("block", "la", "lb", "i", key)
    )
    own = F.xxhash64("block", text).alias(f"{text}_id")
    return cut.select(own, F.col("bits").alias(f"{text}_bits"), *carried, F.explode(meet).alias("meet"))


def _segments(df: DataFrame, text: str, cutoff: float) -> DataFrame:
    """Keys of a text's segments, for every possible partner length: without as many characters as may be unmatched."""
    cut = _cut_up(df, F.length(text), F.col("partner"), cutoff)
    cut = cut.withColumn("segment", F.substr(F.col(text), F.col("begin") + 1, F.col("size")))
    segment, none, least = F.col("segment"), F.array().cast("array<string>"), F.least("may", "da")
    return _keyed(
        cut, text,
        [
            F.array("segment"),
            F.when(least >= 1, _less(segment, 1, F.col("size"))).otherwise(none),
            F.when(least >= 2, _two_less(segment, 1, F.col("size"))).otherwise(none),
        ],
        "da", "db",
    )


def _substrings(df: DataFrame, text: str, cutoff: float) -> DataFrame:
    """Keys of the places of `text` where a partner's segment may occur.

    With d characters of the segment unmatched and j of the place, the place has size - d + j.
    An unmatched character is counted to the segment of the last match before it, so that a place begins
    and ends with matches; only the first segment's may begin with others.
    """
    cut = _cut_up(df, F.col("partner"), F.length(text), cutoff)
    cut = cut.withColumn("first", F.when(F.col("i") == 0, 1).otherwise(2))
    da, db, may, size, first = (F.col(c) for c in ("da", "db", "may", "size", "first"))
    none = F.array().cast("array<string>")

    def places(before: Column, d: int, j: int) -> Column:
        """Texts of the places after `before` edits, x of them characters of this text."""
        width = size - d + j
        low, high = F.greatest(before + d - da, F.lit(0)), F.least(before, db - j)
        shift = F.col("begin") - before
        low = F.greatest(low, F.ceil(-shift / 2).cast("int"))
        high = F.least(high, F.floor((F.col("lb") - width - shift) / 2).cast("int"))
        at = _some(low, high, lambda x: F.substr(F.col(text), shift + 2 * x + 1, width))
        return F.when(width >= 0, at).otherwise(none)

    def shortened(of: Column, j: int) -> Column:
        if not j:
            return of
        less = _less if j == 1 else _two_less
        return F.flatten(F.transform(of, lambda w: less(w, first, F.length(w) - 1)))

    # After T + e edits, t - e at most are within; before the first segment there are none.
    keys = [
        F.when((may >= d + j + e) & ((F.col("i") > 0) | F.lit(e == 0)), shortened(places(F.col("before") + e, d, j), j)).otherwise(none)
        for e in (0, 1) for d in range(3 - e) for j in range(3 - e - d)
        if e == 0 or d + j == 0
    ]
    return _keyed(cut, text, keys)


def fuzzy_candidates(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs that may reach `cutoff` without being equal or one inside the other."""
    l_keys = _segments(_partners(left.withColumn("bits", signature("l")), "l", right, "r", cutoff), "l", cutoff)
    r_keys = _substrings(_partners(right.withColumn("bits", signature("r")), "r", left, "l", cutoff), "r", cutoff)
    met = (
        l_keys.hint("merge").join(r_keys, "meet")
        .filter("bit_count(l_bits & ~r_bits) <= da AND bit_count(r_bits & ~l_bits) <= db")
        .select("l_id", "r_id").distinct()
    )
    l_texts = left.select(F.xxhash64("block", "l").alias("l_id"), "block", "l")
    r_texts = right.select(F.xxhash64("block", "r").alias("r_id"), F.col("block").alias("r_block"), "r")
    pairs = (
        met.join(l_texts.hint("merge"), "l_id").join(r_texts.hint("merge"), "r_id")
        .filter("block = r_block").select("block", "l", "r")
    )
    da, db = _unmatched(F.length("l"), F.length("r"), cutoff)
    return pairs.filter("NOT contains(l, r) AND NOT contains(r, l)").filter(F.levenshtein("l", "r") <= da + db)


def _grams(df: DataFrame, text: str, heads: DataFrame) -> DataFrame:
    """All substrings as long as a head of the same block."""
    n = F.length(text)
    sizes = heads.select("block", F.length("gram").alias("size")).distinct()
    return (
        df.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(n, F.lit(GRAM)))))
        .join(sizes, ["block", "size"], "left_semi")
        .withColumn("at", F.explode(F.sequence(F.lit(1), n - F.col("size") + 1)))
        .select("block", text, F.substr(F.col(text), F.col("at"), F.col("size")).alias("gram"))
        .distinct()
    )


def similar_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """(block, l, r, score) for all pairs with the same block and score >= cutoff.

    `left` has columns block, l and `right` block, r; empty texts never match.
    """
    left = left.filter("l <> ''").select("block", "l").distinct()
    right = right.filter("r <> ''").select("block", "r").distinct()
    equal = left.join(right, (left["block"] == right["block"]) & (F.col("l") == F.col("r"))).select(
        left["block"], "l", "r"
    )
    l_head = left.withColumn("gram", F.substring("l", 1, GRAM))
    r_head = right.withColumn("gram", F.substring("r", 1, GRAM))
    inside_right = l_head.hint("merge").join(_grams(right, "r", l_head), ["block", "gram"]).filter("contains(r, l)")
    inside_left = r_head.hint("merge").join(_grams(left, "l", r_head), ["block", "gram"]).filter("contains(l, r)")
    exact = F.when(F.col("l") == F.col("r"), 1.0).otherwise(K.CONTAINMENT_SCORE)
    sure = (
        equal.unionByName(inside_right.select("block", "l", "r"))
        .unionByName(inside_left.select("block", "l", "r"))
        .distinct()
        .withColumn("score", exact)
        .filter(F.col("score") >= cutoff)
    )
    fuzzy = (
        fuzzy_candidates(left, right, cutoff)
        .withColumn("score", matching_ratio("l", "r"))
        .filter(F.col("score") >= cutoff)
    )
    return sure.unionByName(fuzzy)
