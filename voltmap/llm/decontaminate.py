"""Benchmark passages in documents, by a prefix-filtered set join.

An item is cut into windows of ten words; a window is the set of its five-word shingles.
A document holds a window only if it holds every shingle of it, so one shingle is a
sufficient prefix: the rarest, by its count in all documents.  Documents meet windows on that
shingle alone; a window without room around the place is out by its length and position,
and the words of the rest are compared.  All of it is DataFrame functions: the words of a
document are never stored, and a place that meets no window ends inside the generated loop.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltmap.session import cut

WINDOW = 10
SHINGLE = 5
#: Most bytes of windows that one pass over the documents broadcasts.
PASS_BYTES = 1 << 25
#: Rows of a text that many documents share are dealt over this many keys per part of the table.
SALTS = 32
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """The words of a text, A-Z in lower case; a null text has none."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))


def _shingle(words: str, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *[F.get(F.col(words), at + j) for j in range(width)])


def item_windows(
    items: DataFrame, id: str = "item_id", text: str = "text", size: int = WINDOW
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, classes of items that hold them, items of a class), all stored.

    windows: window_id, words, length.  Items of equal words are one class, so copies do not
    multiply windows.  An item of fewer words than `size` is one window, one without words has
    none; a null id counts as the empty one.
    """
    rows = items.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("item"), word_list(F.col(text)).alias("words")
    ).filter(F.size("words") > 0)
    members = rows.withColumn("class_id", F.sha2(F.array_join("words", " "), 256)).select("class_id", "item", "words")
    members = cut(members.distinct())
    texts = members.dropDuplicates(["class_id"]).select("class_id", "words")
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))
    places = texts.select("class_id", "words", F.explode(starts).alias("at")).select(
        "class_id", F.slice("words", F.col("at"), F.lit(size)).alias("words")
    ).distinct()
    places = cut(places)
    windows = cut(
        places.select("words").distinct().select(
            F.monotonically_increasing_id().alias("window_id"), "words", F.size("words").alias("length")
        )
    )
    held = places.join(windows, "words").select("window_id", "class_id")
    return windows, held, members.select("class_id", "item")


def _places(docs: DataFrame, id: str, text: str, widths: list[int], first: int) -> DataFrame:
    """A row per document, word from `first` on, and shingle width: doc_id, key, words, n, at, shingle.

    `first` -1 adds one row that stands for the document itself.
    """
    read = docs.select(
        F.col(id).alias("doc_id"), F.col(text).alias("said"), word_list(F.col(text)).alias("words")
    ).select("doc_id", F.unhex(F.sha2(F.coalesce("said", F.lit("")), 256)).alias("key"), "words", F.size("words").alias("n"))
    till = F.col("n") - 1
    steps = F.sequence(F.lit(first), till) if first < 0 else F.when(till >= 0, F.sequence(F.lit(first), till))
    each = read.select("doc_id", "key", "words", "n", F.explode(steps).alias("at"))

    def hashed(width):
        return F.when((F.col("at") >= 0) & (F.col("at") + width <= F.col("n")), _shingle("words", F.col("at"), width))

    if len(widths) == 1:
        return each.withColumn("shingle", hashed(widths[0]))
    # The row of the document itself goes with the first width alone.
    every = F.array(*[F.struct(F.lit(w).alias("width"), hashed(w).alias("shingle")) for w in widths])
    wide = each.select("*", F.inline(every))
    return wide.filter((F.col("at") >= 0) | (F.col("width") == widths[0])).drop("width")


def hits(docs: DataFrame, windows: DataFrame, id: str = "doc_id", text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Stored rows doc_id, key, n, window_id, start, length: every occurrence of every window.

    A row without window_id stands for its document.  Windows are broadcast in passes of about
    `pass_bytes`, as many as the benchmark needs; each pass reads the documents once.
    """
    said = F.array_join("words", " ")
    facts = windows.agg(
        F.coalesce(F.sum(F.length(said) + 64), F.lit(0)).alias("bytes"),
        F.collect_set(F.least("length", F.lit(SHINGLE))).alias("widths"),
    ).first()
    widths = sorted(facts["widths"]) or [SHINGLE]
    passes = max(-(-facts["bytes"] // pass_bytes), 1)
    own = [F.struct(F.lit(j).alias("offset"), _shingle("words", F.lit(j), SHINGLE).alias("shingle")) for j in range(WINDOW)]
    short = F.coalesce(*[F.when(F.col("length") == w, _shingle("words", F.lit(0), w)) for w in range(1, SHINGLE)])
    several = F.filter(F.array(*own), lambda s: s["offset"] + SHINGLE <= F.col("length"))
    alone = F.array(F.struct(F.lit(0).alias("offset"), short.alias("shingle")))
    parts = windows.select(
        "window_id", "length", said.alias("said"), F.inline(F.when(F.col("length") < SHINGLE, alone).otherwise(several))
    )
    shingles = parts.select("shingle").distinct()

    def share(df, key, k):
        return F.broadcast(df if passes == 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(passes)) == k))

    counts = None
    for k in range(passes):
        met = _places(docs, id, text, widths, 0).select("shingle").join(share(shingles, "shingle", k), "shingle")
        counted = cut(met.groupBy("shingle").agg(F.count("*").alias("seen")))
        counts = counted if counts is None else counts.unionByName(counted)
    # A window with a shingle that no document holds occurs nowhere.
    rarity = F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "offset", "shingle")
    prefixes = cut(
        parts.join(counts, "shingle", "left").groupBy("window_id", "length", "said").agg(F.min(rarity).alias("p"))
        .filter("p.seen > 0").select("window_id", "length", "said", "p.offset", "p.shingle")
    )
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n"))
    same = F.array_join(F.slice("words", start + 1, F.col("length")), " ") == F.col("said")
    out = None
    for k in range(passes):
        places = _places(docs, id, text, widths, 0 if k else -1).alias("d")
        part = share(prefixes, "shingle", k).alias("w")
        on = (F.col("d.shingle") == F.col("w.shingle")) & fits & same
        met = places.join(part, on, "left").filter((F.col("at") < 0) | F.col("window_id").isNotNull())
        met = cut(met.select("doc_id", "key", "n", "window_id", start.alias("start"), "length"))
        out = met if out is None else out.unionByName(met)
    return out


def decontaminate(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit.  Items count by their distinct ids (null:
    the empty one).  Results hang on the text, so repeated rows and rows without an id get their
    own row each with the figures of their text; null and empty texts have no words and no
    hits, short items are windows of their own length, an empty benchmark hits nothing and an
    empty table gives no rows.  Documents are read by the two named columns alone.

    Occurrences are told apart by text, not by row, and combine before they are shuffled, so
    copies add nothing; what a text is found to hold goes back to its rows by salted keys.
    """
    windows, held, members = item_windows(items, item, item_text)
    found = hits(docs, windows, id, text, pass_bytes)
    spots = found.filter(F.col("window_id").isNotNull()).select("key", "window_id", "start", "length").distinct()
    ends = F.col("start") + F.col("length")
    before = Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = spots.groupBy("key", "start").agg(F.max("length").alias("length"))
    fresh = ends - F.greatest(F.col("start"), F.least(F.coalesce(F.max(ends).over(before), F.lit(0)), ends))
    hit = spans.select("key", fresh.alias("fresh")).groupBy("key").agg(F.sum("fresh").cast("long").alias("n_hit"))
    classes = spots.select("key", "window_id").distinct().join(held, "window_id").select("key", "class_id").distinct()
    named = classes.join(members, "class_id").select("key", "item").distinct()
    listed = named.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items")).select(
        "key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    by_text = hit.join(listed, "key").select("*", F.explode(salts).alias("salt"))
    rows = found.filter(F.col("window_id").isNull()).select(
        "doc_id", "key", F.col("n").cast("long").alias("n_words"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt")
    )
    zero = F.lit(0).cast("long")
    return rows.join(by_text, ["key", "salt"], "left").select(
        F.col("doc_id").alias("id"), "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )
