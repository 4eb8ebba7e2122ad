"""Benchmark passages, filter orders and token alignment against plain Python."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltmap.llm import alignment, decontaminate, filter_audit

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def leaks(docs, items):
    """Brute force: every window of every item against every place of every document."""
    windows = set()
    for item, text in items:
        w = words(text)
        m = min(len(w), 10)
        windows |= {("" if item is None else str(item), tuple(w[i : i + m])) for i in range(len(w) - m + 1) if m}
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    held.add(item)
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(held), digest, bool(hit)))
    return out


def order(rows):
    return sorted(rows, key=repr)


def _leak_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "d1", "é", "ÉCOLE", "слово", "x"]

    def some(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, some(rng.choice([0, 1, 2, 3, 4, 5, 9, 10, 11, 30]))) for i in range(12)]
    items += [(100, "one two three four five six seven eight nine ten eleven twelve"), (100, "only this"), (None, "lone wolf"), (7, None)]
    items += [(200 + i, items[12][1].upper()) for i in range(5)]
    docs = [(i, some(rng.choice([0, 3, 40, 200]))) for i in range(25)]
    docs += [(50, "zz " + items[12][1].replace(" ", ", ") + " zz " + items[12][1]), (50, "zz"), (None, "Lone-Wolf!"), (None, None), (51, "")]
    docs += [(60 + i, items[12][1]) for i in range(30)] + [(60, items[12][1])] * 2
    return docs, items


@pytest.mark.parametrize("pass_bytes", [1 << 25, 700])
def test_decontaminate_equals_brute_force(spark, pass_bytes):
    docs, items = _leak_case(5)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"key": F.lit("k"), "window_id": F.lit(1), "salt": F.lit(2), "words": F.lit("w"), "n": F.lit(3)}
    )
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({"class_id": F.lit(1), "item": F.lit("x")})
    got = decontaminate.decontaminate(d, i, pass_bytes=pass_bytes)
    assert got.columns == ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert order(map(tuple, got.collect())) == order(leaks(docs, items))


def test_decontaminate_empty_tables_and_long_text(spark):
    no_docs = spark.createDataFrame([], "doc_id long, text string")
    no_items = spark.createDataFrame([], "item_id long, text string")
    item = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    assert decontaminate.decontaminate(no_docs, item).collect() == []
    docs = [(1, "w " * 60_000 + "a b c d e f g h i j" + " w" * 60_000), (2, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.decontaminate(frame, item).collect()}
    assert got == {1: (120_010, 10, 1), 2: (0, 0, 0)}
    got = decontaminate.decontaminate(frame, no_items).collect()
    assert {(r.id, r.n_hit, r.contaminated) for r in got} == {(1, 0, False), (2, 0, False)}


def test_decontaminate_runs_no_python(spark):
    docs, items = _leak_case(1)
    got = decontaminate.decontaminate(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(2),
        spark.createDataFrame(items, "item_id long, text string"),
    )
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- filter orders


def fails(text, smaller):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * smaller


def replay(docs, labels):
    """Brute force: applies the filters one after another in every order."""
    known = [x for x in labels if x[0] is not None]
    good, toxic = {d for d, q, _ in known if q == 1}, {d for d, _, t in known if t == 1}
    rows = []
    for i, text, lang in docs:
        twin = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in docs)
        rows.append((i, lang or "", fails(text, twin)))
    out = []
    for part in {lang for _, lang, _ in rows}:
        own = [(i, f) for i, lang, f in rows if lang == part]
        removed_by, made = Counter(), []
        for steps in permutations("ABCDE"):
            left = own
            for step, x in enumerate(steps, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                removed_by[x] += len(gone)
                made.append(
                    (part, "".join(steps), step, len(left), len(gone), sum(x in f for _, f in own) - len(gone),
                     sum(f == x for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), x)
                )
        out += [(*m[:-1], removed_by[m[-1]]) for m in made]
    return out


def _audit(docs, labels):
    return filter_audit.audit(filter_audit.masks(docs, labels))


def test_filter_orders_equal_a_replay(spark):
    rng = random.Random(3)
    clean = " ".join(f"word{i}" for i in range(120))
    loud, marks, same = clean.upper(), clean + " 5%", "again " * 130
    texts = [clean, loud, marks, same, same.upper(), "short", "", None, "SHORT $", clean + " x", "\t\x0b" + clean]
    docs = [(i, rng.choice(texts), rng.choice(["en", "ru", "", None])) for i in range(150)]
    docs += [(7, clean, "en"), (7, clean, "en"), (None, clean, "en"), (None, None, None), (3, "short", "de"), (999, clean, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns(
        {"mask": F.lit(9), "n": F.lit("x"), "quality": F.lit(1), "part": F.lit("y"), "rank": F.lit(1)}
    )
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("z"))
    got = _audit(frame, marked)
    assert got.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ]
    assert sorted(map(tuple, got.collect())) == sorted(replay(docs, labels))


def test_filter_orders_of_empty_and_long(spark):
    no_docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert _audit(no_docs, no_labels).collect() == []
    docs = [(1, "Word " * 200_000, "en"), (2, " ".join(f"w{i}" for i in range(100_000)), "en")]
    got = _audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), no_labels).collect()
    assert len(got) == 600 and sorted(map(tuple, got)) == sorted(replay(docs, []))


@pytest.mark.parametrize("n", [1, 3, 5])
def test_intervals_follow_lexicographic_order(n):
    intervals = list(filter_audit.removal_intervals(n))
    for rank, steps in enumerate(permutations(range(n))):
        assert filter_audit.lehmer_rank(steps, n) == rank
        for mask in range(1 << n):
            want = next((s for s, x in enumerate(steps, 1) if mask >> x & 1), None)
            got = [s for m, s, b, e in intervals if m == mask and b <= rank < e]
            assert got == ([] if want is None else [want])


# --- token alignment


def _paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(texts):
    """[(ids, byte ends)] by both tokenizers over whole texts; None where the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(_paths()[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=_paths()[1])
    signs = alignment._byte_signs()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ba = [bytes(signs[c] for c in a.id_to_token(i)) for i in ia]
        bb = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ib)]
        same = b"".join(ba) == b"".join(bb) == (" " + text).encode()
        out.append((ia, np.cumsum([len(x) for x in ba]).tolist(), ib, np.cumsum([len(x) for x in bb]).tolist()) if same else None)
    return out


def grouped(row):
    ia, ea, ib, eb = row
    groups, i, j = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        p, q = ea.index(end, i) + 1, eb.index(end, j) + 1
        groups.append((ia[i:p], ib[j:q]))
        i, j = p, q
    return groups


def alignments(docs):
    made = [grouped(row) if row else [] for row in tokens([t for _, t in docs])]
    links = [Counter((x, y) for ga, gb in groups for x in ga for y in gb) for groups in made]
    count = Counter(p for own in links for p in own)
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, _), groups, own in zip(docs, made, links):
        said = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in groups)
        out.append(
            (i, sum(len(ga) for ga, _ in groups), sum(len(gb) for _, gb in groups), len(groups), sum(own.values()),
             hashlib.sha256(said.encode()).hexdigest() if groups else "",
             sum(n for p, n in own.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in own.items()))
        )
    return out


ODD = [
    "a  b\n\nc \n  d", "tail ", "tail  ", "  head", "\n x", "x\t y \x1c z", "İ i̇ ﬁ ½ Ⅷ", "naïve café — “quoted” 日本語のテキスト と 한국어",
    "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score ▁ x", "emoji 👩‍👩‍👧 🇩🇪", "\x00 nul", "don't I'll we've", " nb  em  　 cjk",
    "aaaa" * 3000, "1234567890" * 50, "\r\n\r\n", " ", "   x", "﻿ bom", "é ́", "\x85 \x1f x", "हिन्दी العربية ไทย",
]


def test_alignment_equals_brute_force(spark, sf_dir):
    some = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    docs = [(10_000 + i, t) for i, t in enumerate(ODD)] + some + [(1, None), (None, "no id"), (2, ""), (None, "no id")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"row": F.lit(1), "id": F.lit("clash"), "pairs": F.lit("x"), "n_a": F.lit(5)}
    )
    want = order(alignments(docs))
    for pass_pairs in (1 << 21, 900):
        got = alignment.score(frame, *_paths(), pass_pairs=pass_pairs).select(
            "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"
        )
        assert order(map(tuple, got.collect())) == want


def test_parts_encode_as_whole_texts():
    rng = random.Random(8)
    signs = " \n\t\x1c 　▁abAB'sé1.,—日👩́\x85​"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ODD
    encoder = alignment.Encoder(*_paths())
    (a, a_of), (b, b_of) = encoder.encode(texts)
    for i, row in enumerate(tokens(texts)):
        got = (a[a_of[i] : a_of[i + 1]].tolist(), b[b_of[i] : b_of[i + 1]].tolist())
        assert got == ((row[0], row[2]) if row else ([], [])), repr(texts[i])


def test_shared_cuts_are_the_common_ends():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(1, 120, n))
        b = np.unique(rng.integers(1, 120, n))
        last = 120
        a, b = np.append(a[a < last], last), np.append(b[b < last], last)
        got = alignment.shared_cuts(a, b, np.array([0]), np.array([len(a) - 1]))
        assert a[got].tolist() == np.intersect1d(a, b).tolist()


def test_wide_groups_count_by_distinct_ids(monkeypatch):
    encoder = alignment.Encoder(*_paths())
    texts = [*ODD, "aaaa" * 3000]
    want = alignment.align(encoder, texts)
    monkeypatch.setattr(alignment, "LISTED_LINKS", 1)
    monkeypatch.setattr(alignment, "REMEMBERED", 5)
    got = alignment.align(encoder, texts)
    assert all(list(got[k]) == list(want[k]) for k in want)


def test_alignment_of_an_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.score(frame, *_paths()).collect() == []
