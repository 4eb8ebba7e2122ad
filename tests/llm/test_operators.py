"""Every operator on odd rows (nulls, empty and long texts, ties, repeats, clashing columns), on an
empty table, and against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voltmap.llm import components, fingerprints, html, lm, mixing, neardup, packing, quality, search, substrings
from voltmap.llm import text as X
from voltmap.llm import toxicity

DDL = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row int, value string, "
    "part string, size string, label string, tile string, piece string, score string, kept string, asks string, `end` string"
)


def frame(spark, rows):
    """rows of (doc_id, text[, source]); the further columns clash with names the operators use."""
    full = [
        (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "k", 2, *["x"] * 10) for r in rows
    ]
    return spark.createDataFrame(full, DDL)


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [f"{a}{b}" for a in ("an", "be", "cor", "du", "el", "fi", "go", "hu") for b in ("ta", "ra", "mi", "ne", "los")]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = prose(rng, 9000)
    return frame(
        spark,
        [(1, None, "a"), (2, "", "b"), (3, " \n\t ", None), (4, "one", "a"), (4, "one", "a"), (None, "no id here", "b"),
         (7, long, "a"), (8, long, "b"), (9, "ça va? été là", None), (4, "other text, same id", "a")],
    ).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "x")]).limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (1, 1, 1), (None, 1, 1), (7, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose with copies, near copies and a shared passage: (rows, frame)."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(3, 400)), f"s{i % 4}") for i in range(160)]
    passage = prose(rng, 70)
    for i in range(160, 170):
        rows.append((i, prose(rng, 40) + " " + passage + "\n" + prose(rng, 30), "s0"))
    base = prose(rng, 300).split()
    for i in range(170, 190):
        near = list(base)
        for _ in range(rng.randint(0, 8)):
            near[rng.randrange(300)] = "zzz"
        rows.append((i, " ".join(near), "s1"))
    rows += [(190 + i, rows[5][1], "s2") for i in range(6)]
    return rows, frame(spark, rows).cache()


# --- kernels -----------------------------------------------------------------------------------


def test_words_and_shingles_equal_python():
    texts = ["Hello  World hello", None, "", "\n a\tb\x0bc ", "é" * 5 + " x", "one two three four five six", "a" * (1 << 20) + " b"]
    found = X.words(pa.array(texts))
    split = [(t or "").encode().split() for t in texts]
    assert found.counts.tolist() == [len(s) for s in split]
    h = found.hashes()
    by: dict[int, bytes] = {}
    for value, word in zip(h.tolist(), [w.lower() for s in split for w in s]):
        assert by.setdefault(value, word) == word
    runs = X.shingles(found, h, 5)
    assert np.diff(runs.bounds).tolist() == [max(len(s) - 4, 1) if s else 0 for s in split]


def test_a_round_of_components_has_three_exchanges(spark):
    edges = spark.range(100).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"))
    made = components._small(components._large(edges)).distinct()
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- packing -------------------------------------------------------------------------------------


def test_packing_equals_the_tokenizer(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(packing.tokenize(odd, with_ids=True)).cache()
    got = Counter((r.id, r.piece, r.start, r.length, r.ids_crc32) for r in rows.collect())
    want = Counter()
    for doc_id, text in odd.select("doc_id", "text").collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[doc_id, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == want
    filled = defaultdict(list)
    for r in rows.collect():
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    whole = {r.sequence_id: r for r in packing.sequences(rows).collect()}
    assert all(len(r.ids) == 4 * r.length for r in whole.values()) and set(whole) == set(filled)
    assert packing.pack(packing.tokenize(empty)).collect() == []


def test_parts_of_all_latin_letters_and_marks_encode_as_the_whole():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.parted
    rng = random.Random(7)
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    letters = [chr(c) for c in range(0xC0, 0x280)]
    texts = [f"{c}{m} a{c}{m}{m} {c}b{m}{c} {m}{c}{m}" for c in letters for m in rng.sample(marks, 3)]
    texts += ["".join(rng.choice(letters + list(marks) + [" ", "a", "Z", "1"]) for _ in range(30)) for _ in range(1500)]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_another_tokenizer_encodes_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, texts = packing.Encoder(path), ["Ab, cd.  E", None, "", "x\ny"]
    assert not encoder.parted
    ids, bounds = encoder.encode(pa.array(texts))
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(4)] == want


def test_plan_pairs_large_items_and_fills_gaps():
    rng = random.Random(3)
    for _ in range(30):
        counts = {rng.randint(1, 100): rng.randint(1, 40) for _ in range(rng.randint(1, 40))}
        room, items = defaultdict(int), Counter()
        for length, first, n, sequence, per, offset in packing.plan(counts, 100):
            assert first == items[length]
            items[length] += n
            for r in range(n):
                room[sequence + r // per] += length
        assert items == Counter(counts) and max(room.values()) <= 100
        total = sum(k * v for k, v in counts.items())
        large = sum(v for k, v in counts.items() if k > 50)
        assert len(room) <= max(-(-total // 100) * 1.25 + 2, large + total / 75 + 2)
    assert packing.plan({}) == []


def test_tokenizer_parts_on_odd_words():
    encoder = packing.Encoder(packing.default_tokenizer())
    texts = ["It's DOGS' can't've _x_ --- a-b 12ab... é!!! a×. x—— <|endoftext|>, q̸ ≮x ﬁ İ ΣΑΣ a\x1cb c", "", "ab... AB..."]
    ids, bounds = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


# --- language model ---------------------------------------------------------------------------------


def test_encoder_takes_texts_of_more_parts_than_it_remembers(monkeypatch):
    texts = pa.array([" ".join(f"w{i}x," for i in range(300)), None, "w1x, again", " ".join(str(i) for i in range(200))])
    whole, bounds = packing.Encoder(packing.default_tokenizer()).encode(texts)
    monkeypatch.setattr(packing, "REMEMBERED", 64)
    ids, ends = packing.Encoder(packing.default_tokenizer()).encode(texts)
    assert ids.tolist() == whole.tolist() and ends.tolist() == bounds.tolist()


def test_lm_base_is_exact_and_pairs_help(spark, corpus, odd, empty):
    rows, docs = corpus
    got = {r.id: r for r in lm.score(docs).collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t, _ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(w in counts for w in ws), n)
        assert got[i].held_out == held[i] and got[i].score < 0
    odd_rows = lm.score(odd).collect()
    assert len(odd_rows) == 10 and [r.n_tokens for r in odd_rows if r.id == 2] == [1]
    assert lm.score(empty).collect() == []


def test_filter_counts_are_levels_and_bounded(monkeypatch):
    rng = np.random.default_rng(2)
    keys, counts = X.mix(np.arange(5000, dtype=np.uint64)), rng.integers(1, 200, 5000)
    segment = keys >> np.uint64(63)
    model = lm.Filter([lm.Segment.build(keys[segment == s], counts[segment == s], 1 << 20) for s in (0, 1)])
    got = model.counts(keys)
    assert (got >= counts / 2.9).all() and np.mean(np.abs(np.log2(got / counts)) <= 1) > 0.9
    assert np.mean(model.counts(X.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64))) > 0) < 0.1
    small, floor = lm.Segment.build(keys, counts, 1 << 12)
    assert len(small) * 64 <= 1 << 12 and floor > 1


# --- mixing ---------------------------------------------------------------------------------------------


def test_mix_meets_targets_exactly(spark, corpus, odd, empty):
    rows, docs = corpus
    got = mixing.mix(docs).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    goal = mixing.targets(list(size.items()))
    assert sum(goal.values()) == pytest.approx(sum(size.values()))
    taken = Counter()
    for r in got:
        words = sum(t.words for t in r.takes)
        assert words <= 3 * r.size and all(0 <= t.shard < 64 for t in r.takes)
        taken[r.source] += words
    assert all(abs(taken[s] - goal[s]) <= 1 for s in size)
    again = mixing.mix(docs.repartition(7)).collect()
    assert {(r.id, str(r.takes)) for r in got} == {(r.id, str(r.takes)) for r in again}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(taken.values())
    odd_rows = mixing.mix(odd).collect()
    assert len(odd_rows) == 10 and all(not r.takes for r in odd_rows if r.size == 0)
    assert mixing.mixed_documents(odd).count() > 0
    assert mixing.mix(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


def test_targets_and_splitting_tree():
    assert mixing.targets([("b", 10), ("a", 1), (None, 89)]) == {"a": 3.0, "b": 30.0, None: pytest.approx(67.0)}
    assert mixing.targets([("a", 0), (None, 0)]) == {"a": 0.0, None: 0.0}
    quotas = np.array([0, 5, 1000, 17])
    tree = mixing.split(quotas, 7, seed=1)
    assert (tree.sum(axis=1) == quotas).all() and tree.min() >= 0
    assert tree.sum(axis=0).max() - tree.sum(axis=0).min() <= 3


# --- toxicity and quality ----------------------------------------------------------------------------------


def segments_by_definition(scores):
    """All maximal scoring segments by recursion on the best segment."""

    def best(low, high):
        found = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 1e-12 and (found is None or total > found[0] + 1e-12):
                    found = (total, i, j + 1)
        return found

    def split(low, high):
        b = best(low, high)
        return [] if b is None else [*split(low, b[1]), (b[1], b[2]), *split(b[2], high)]

    return split(0, len(scores))


def test_maximal_segments_equal_the_definition():
    rng = random.Random(5)
    for _ in range(60):
        scores = np.array([rng.choice([-3.0, -1.25, -0.5, 0.75, 1.0, 2.5]) for _ in range(rng.randint(0, 14))])
        got = [(b, e) for b, e, _ in toxicity.maximal_segments(scores)]
        assert got == segments_by_definition(scores.tolist())


def test_toxicity_finds_passages_and_generalizes(spark, odd, empty, labels):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(600):
        words = prose(rng, rng.randint(20, 80)).split()
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            words.insert(rng.randrange(len(words)), f"vile{rng.choice('abcdefghijk')}{rng.randint(0, 99)}")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    docs, marks = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    score = toxicity.scorer(spark, model)
    got = docs.select("doc_id", toxicity.held_out("doc_id").alias("held"), score("text").alias("s")).collect()
    held = [r for r in got if r.held]
    assert held and all((r.s >= toxicity.THRESHOLD) == (r.doc_id % 5 == 0) for r in held)
    spans = toxicity.passages(docs, model).collect()
    texts = dict(rows)
    assert {r.id % 5 for r in spans} == {0}
    assert all(texts[r.id][r.begin : r.end] == r.passage and r.p_value < 0.05 for r in spans)
    few = toxicity.train(odd, labels)
    scores = [r[0] for r in odd.select(toxicity.scorer(spark, few)("text")).collect()]
    assert len(scores) == 10 and all(0 <= s <= 1 for s in scores)
    assert empty.select(toxicity.scorer(spark, toxicity.train(empty, labels.limit(0)))("text")).collect() == []


def test_resampling_keeps_the_share_and_the_good(spark, odd, empty, labels):
    rng = random.Random(11)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 != 0
        words = prose(rng, 60).split()
        rows.append((i, " ".join(w if good else w + "%%%" for w in words)))
        marks.append((i, int(good), 0))
    marks = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality.resample(frame(spark, rows), marks, share=0.75).collect()
    assert sum(r.kept for r in got) == 300 and all(r.kept == (r.id % 4 != 0) for r in got)
    assert min(r.draw for r in got if r.kept) >= max(r.draw for r in got if not r.kept)
    for share in (0.0, 0.3, 1.0):
        assert sum(r.kept for r in quality.resample(odd, labels, share=share).collect()) == round(share * 10)
    same = frame(spark, [(5, "same text")] * 9)
    assert sum(r.kept for r in quality.resample(same, labels, share=0.5).collect()) == 4
    assert quality.resample(empty, labels).collect() == []


# --- fingerprints ----------------------------------------------------------------------------------------------


def test_fingerprints_of_edits(spark, corpus, odd, empty):
    rows, docs = corpus
    got = {r.id: r for r in fingerprints.with_edits(docs).collect()}
    order = sorted(rows)
    near = []
    for (i, text, _), (_, follower, _) in zip(order, [*order[1:], order[0]]):
        half = len(text) // 2
        edited = text[: len(text) - half] + follower[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        near.append((got[i].near_edited, got[i].near_next))
    assert np.mean([a for a, _ in near]) > np.mean([b for _, b in near]) + 0.2
    assert len({r.fingerprint for r in got.values()}) == len({t for _, t, _ in rows})
    assert len(fingerprints.with_edits(odd).collect()) == 10
    one = fingerprints.with_edits(frame(spark, [(3, "abcd")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.with_edits(empty).collect() == []


def test_fingerprints_are_homomorphic(spark):
    texts = spark.createDataFrame([("a b\nc d e\nf", "f\na b\nc d e", "a b\nc d e", "f")], "x string, y string, z string, p string")
    f = fingerprints.fingerprint
    r = texts.select(f("x").alias("x"), f("y").alias("y"), f("z").alias("z"), f("p").alias("p")).select(
        "*", fingerprints.inserted("z", "p").alias("more"), fingerprints.deleted("x", "p").alias("less")
    ).head()
    assert r.x == r.y == r.more and r.less == r.z and r.x != r.z


# --- search ------------------------------------------------------------------------------------------------------


def test_index_takes_few_bytes_a_posting_while_it_is_built():
    import tracemalloc

    rng = np.random.default_rng(1)
    docs, each = 2000, 400
    ids, sizes = np.arange(docs), np.full(docs, each)
    term = rng.integers(0, 1 << 16, docs * each).astype(np.uint64)
    times = np.ones(docs * each, dtype=np.float32)
    tracemalloc.start()
    part = [ids, ids.copy(), term[::each].copy(), term.copy(), sizes, sizes.copy(), times.copy()]
    index = search._index([part], 400.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert index.n == docs and (index.doc.size, index.begin[-1]) == (docs * each, docs * each)
    assert peak < 36 * docs * each


def test_search_equals_brute_force(spark, corpus, odd, empty, monkeypatch):
    rows, docs = corpus
    monkeypatch.setattr(search, "SHARD_DOCS", 60)
    got = defaultdict(list)
    for r in search.search(docs, asks=F.col("doc_id") % 7 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    bags = {i: Counter(t.lower().split()) for i, t, _ in rows}
    df = Counter(w for b in bags.values() for w in b)
    length = {i: sum(b.values()) for i, b in bags.items()}
    mean = sum(length.values()) / len(bags)
    for q in (i for i in bags if i % 7 == 0):
        scores = {}
        for i, b in bags.items():
            s = 0.0
            for w, n in bags[q].items():
                if w in b:
                    idf = np.log1p((len(bags) - df[w] + 0.5) / (df[w] + 0.5))
                    s += n * idf * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * length[i] / mean))
            scores[i] = s
        want = sorted(((s, i) for i, s in scores.items() if s > 0), key=lambda x: (-round(x[0], 4), x[1]))[:10]
        assert [s for _, s in got[q]] == pytest.approx([s for s, _ in want], rel=1e-4)
    assert {r.query_id for r in search.search(odd, asks=F.lit(True)).collect()} >= {4, 7, 8}
    assert search.search(odd).collect() == [] and search.search(empty).collect() == []


def _made_index(rng, docs, languages):
    """Texts of some languages with words of very unequal frequency, a few copies among them: (index, words, counts, ids)."""
    bags = []
    for i in range(docs):
        length = int(rng.integers(1, 120)) if i % 9 else 900
        own = np.unique((rng.zipf(1.25, length) % 4000 * languages + i % languages).astype(np.uint64), return_counts=True)
        bags.append(bags[i - 50] if i % 10 == 7 and i >= 50 else own)
    sizes = np.array([len(t) for t, _ in bags])
    term, times = (np.concatenate(x) for x in zip(*bags))
    heads = np.array([t[np.argmax(n)] for t, n in bags])
    columns = [np.arange(docs), np.arange(docs), heads, term.copy(), sizes, np.array([n.sum() for _, n in bags]), times.astype(np.float32)]
    return search._index([columns], 60.0), bags


@pytest.mark.parametrize("chunk,block", ((1024, 128), (64, 8), (48, 16)))
def test_index_finds_the_best_of_all_documents_whatever_its_chunks(chunk, block, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_DOCS", chunk, raising=False)
    monkeypatch.setattr(search, "BLOCK_DOCS", block)
    rng = np.random.default_rng(chunk)
    index, bags = _made_index(rng, 1500, 3)
    for k in (1, 10, 400):
        queries = [(bags[i][0], bags[i][1] * rng.uniform(0.1, 3)) for i in (0, 1, 8, 9, 58, 77, 700, 1499)]
        queries.append((np.array([1 << 60], dtype=np.uint64), np.ones(1)))
        for (term, weight), (at, score) in zip(queries, index.tops(queries, k)):
            want = []
            own = dict(zip(term.tolist(), weight.tolist()))
            for i, (t, n) in enumerate(bags):
                norm = 1.2 * (0.25 + 0.75 * n.sum() / 60.0)
                s = sum(own[w] * c * 2.2 / (c + norm) for w, c in zip(t.tolist(), n.tolist()) if w in own)
                if s > 0:
                    want.append((-round(s, 4), i))
            want = sorted(want)[:k]
            assert score.tolist() == pytest.approx([-s for s, _ in want], rel=1e-4, abs=1e-3)
            assert sorted(zip((-score).tolist(), index.ids[at].tolist())) == list(zip((-score).tolist(), index.ids[at].tolist()))


def test_words_frequent_among_alike_documents_are_scored_by_products():
    index, bags = _made_index(np.random.default_rng(3), 6000, 4)
    held = sum(len(t) for t, _ in bags)
    assert len(index.doc) < 0.6 * held


# --- near copies and passages ------------------------------------------------------------------------------------------


def test_near_copies_equal_brute_force(spark, corpus, odd, empty, monkeypatch):
    rows, docs = corpus
    monkeypatch.setattr(neardup, "TILE", 4)
    sets = {}
    for i, t, _ in rows:
        w = t.lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4)))
    distinct = sorted(set(sets.values()), key=lambda s: min(i for i in sets if sets[i] == s))
    links = defaultdict(set)
    for a in distinct:
        for b in distinct:
            if a != b and len(a & b) / len(a | b) >= 0.8:
                links[a].add(b)

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        return min(i for i in sets if sets[i] in seen)

    got = {r.id: r for r in neardup.classes(docs).collect()}
    assert any(links.values())
    for i, s in sets.items():
        assert (got[i].class_id, got[i].n_links) == (reach(s), len(links[s])), i
    assert {i for i, r in got.items() if r.keep} == {r.class_id for r in got.values()}
    odd_rows = neardup.classes(odd).collect()
    assert len(odd_rows) == 10 and {r.class_id for r in odd_rows if r.id in (7, 8)} == {7}
    assert all(r.n_links == 0 for r in odd_rows if r.id in (1, 2, 3))
    assert neardup.classes(empty).collect() == []


def test_forest_depth_meets_the_recall():
    for similarity in (0.8, 0.9, 0.99):
        depth = neardup.forest_depth(similarity)
        assert 1 - (1 - similarity**depth) ** neardup.TREES >= neardup.RECALL
    assert neardup.forest_depth(0.99) > neardup.forest_depth(0.8)


def test_repeated_passages_are_cut_and_the_first_stays(spark, corpus, odd, empty):
    rows, docs = corpus
    texts = {i: t for i, t, _ in rows}
    found = substrings.classes(substrings.passages(docs)).collect()
    windows = defaultdict(set)
    for i, t in texts.items():
        w = t.lower().split()
        for j in range(len(w) - 49):
            windows[tuple(w[j : j + 50])].add(i)
    repeated = set().union(*(v for v in windows.values() if len(v) > 1))
    assert repeated <= {r.doc_id for r in found} <= repeated | set(range(170, 190))
    passage = [r for r in found if r.doc_id in range(160, 170)]
    assert sum(not r.removed for r in passage) == 1 and len({r.class_id for r in passage}) == 1
    assert all(len(texts[r.doc_id][r.begin : r.end].split()) >= 70 for r in passage)
    left = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    assert all(left[i] == t for i, t in texts.items() if i not in {r.doc_id for r in found if r.removed})
    counted = Counter()
    for i, t in left.items():
        w = t.lower().split()
        counted.update({tuple(w[j : j + 50]) for j in range(len(w) - 49)})
    assert max(counted.values()) == 1
    assert len(substrings.without_repeats(odd).collect()) == 9  # the copy of the long text goes
    assert substrings.without_repeats(empty).collect() == []
    assert substrings.classes(substrings.passages(empty)).collect() == []


def test_edited_passages_are_found(spark):
    rng = random.Random(23)
    vocabulary = [f"{a}{b}" for a in VOCABULARY for b in VOCABULARY]
    rows, planted = [], {}
    for n in (50, 52, 60, 70, 100):
        for _ in range(40):
            passage = [rng.choice(vocabulary) for _ in range(n)]
            edited = passage[: n // 2] + ["edited"] + passage[n // 2 + 1 :]
            for own in (passage, edited):
                around = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 60))] for _ in range(2)]
                rows.append((len(rows), " ".join([*around[0], *own, *around[1]])))
            planted[len(rows) - 1] = n
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in substrings.classes(substrings.passages(docs)).collect()}
    for n in (50, 52, 60, 70, 100):
        hit = [i for i, m in planted.items() if m == n and i in found and found[i].n_words >= n and found[i].removed]
        assert len(hit) >= 38, (n, len(hit))
        assert all(found[i].from_doc_id == i - 1 and found[i - 1].class_id == i - 1 for i in hit)
    left = {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()}
    texts = dict(rows)
    assert sum(i not in left or len(left[i]) < len(texts[i]) - 150 for i in planted) >= 190
    assert all(left[i] == texts[i] for i in texts if i not in planted)


def test_runs_inside_wider_runs_keep_their_links(spark):
    rng = random.Random(31)
    head, tail = ([f"w{rng.randrange(10**6)}" for _ in range(40)] for _ in range(2))
    around = [[f"u{rng.randrange(10**6)}" for _ in range(30)] for _ in range(6)]
    given = [head + ["one"] + tail, head[12:] + ["two"] + tail[:-12], head + ["two"] + tail]
    docs = frame(spark, [(i, " ".join([*around[2 * i], *g, *around[2 * i + 1]])) for i, g in enumerate(given)])
    found = substrings.passages(docs)
    assert {(2, 0), (2, 1)} <= {(r.x_id, r.p_id) for r in found.collect()}
    assert {r.doc_id: r.class_id for r in substrings.classes(found).collect()} == {0: 0, 1: 0, 2: 0}


def test_alignment_of_insertions_and_repeated_words():
    rng = random.Random(29)
    a = [f"w{rng.randrange(900)}" for _ in range(80)]
    b = a[:40] + [a[39]] + a[40:]
    one, two = (substrings._Side(pa.array([" ".join(w)])).of(0) for w in (a, b))
    got = list(substrings._matches(one, two, np.array([60]), np.array([61]), 25, 0.8))
    assert [x[:4] for x in got] == [(0, 80, 0, 81)]
    same = substrings._Side(pa.array(["a " * 400])).of(0)
    got = list(substrings._matches(same, same, np.array([3]), np.array([3]), 25, 0.8))
    assert (0, 400, 0, 400) in [x[:4] for x in got]


def test_words_of_two_documents_side_by_side_are_no_passage(spark):
    rng = random.Random(37)

    def fresh(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    rows = []
    for _ in range(20):
        one, two = fresh(30), fresh(30)
        texts = [fresh(40) + one + fresh(40), fresh(40) + two + fresh(40), fresh(40) + one + two + fresh(40)]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate(texts)]
    docs = frame(spark, rows)
    assert substrings.passages(docs).collect() == []
    assert {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()} == dict(rows)


# --- pages --------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, u, h, "x", "y", 3) for i, u, h in rows], "page_id long, url string, html string, text string, host string, noise int"
    )


def test_pages_lose_what_is_not_article(spark):
    source = (
        '<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="no-sidebar"><nav>menu</nav>'
        '<div id="header">top</div><div class="content"><article><header>by</header><h1>Title &amp; more</h1><p>One <b>bold</b>\n word'
        '<p>two<br>lines &lt;x&gt;<div class="cookie-notice">ok?</div><ul><li>a<li>b</ul><script>if(a<b){"</p>"}</script>'
        '<form>f</form><div class="comments"><p>hi</p></div><aside>s</aside></article></div><!-- <p>no</p> --><footer>f</footer>'
    )
    rows = [(1, "http://a.example/1", source), (2, None, None), (3, "odd", ""), (4, "http://b.example", "plain &quot;text&quot; <b>x"),
            (4, "http://b.example", "plain &quot;text&quot; <b>x"), (5, "http://c.example", "<p>cut <a href='")]
    got = sorted((r.id, r.text, r.n_chars) for r in html.extract(pages(spark, rows)).collect())
    article = "Title & more\nOne bold word\ntwo lines <x>\na\nb"
    plain = 'plain "text" x'
    assert got == [(1, article, len(article)), (2, "", 0), (3, "", 0), (4, plain, 14), (4, plain, 14), (5, "cut", 3)]
    assert html.extract(pages(spark, rows).limit(0)).collect() == []


def test_style_tree_cuts_what_a_site_repeats(spark):
    rng = random.Random(13)
    rows = []
    for i in range(30):
        rows.append((i, f"http://site.example/{i}", (
            f'<body><div class="xa">Read our terms before use</div><div class="xb"><p>{prose(rng, 30)}</p></div>'
            f'<div class="xc">{prose(rng, 12)}</div></body>'
        )))
    rows += [(100 + i, "http://copies.example/a", "<body><div><p>same page</p></div></body>") for i in range(20)]
    for r in html.extract(pages(spark, rows)).collect():
        if r.id < 100:
            assert "terms" not in r.text and len(r.text.split()) == 42
        else:
            assert r.text == "same page"
