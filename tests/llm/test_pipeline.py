"""The pipeline end to end, and the entry point without the optional subpackage."""

import os
import random
import subprocess
import sys
from collections import Counter

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SYLLABLES = [f"{a}{b}" for a in ("an", "be", "cor", "du", "el", "fi") for b in ("ta", "ra", "mi", "ne", "los", "vu", "ki")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(21)

    def prose(n):
        return " ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n))

    passage = prose(80)
    rows, labels = [], []
    for i in range(400):
        text = prose(rng.randint(20, 200))
        toxic = i % 8 == 0
        if toxic:
            words = text.split()
            for _ in range(6):
                words.insert(rng.randrange(len(words)), "scoundrel")
            text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(400, 420):
        rows.append((i, rows[i - 399][1], "en", "s1", rows[i - 399][4]))
    for i in range(420, 430):
        text = prose(30) + "\n" + passage + " " + prose(30)
        rows.append((i, text, "en", "s2", len(text)))
    rows += [(430, None, "en", None, 0), (431, "", None, "s0", 0), rows[1]]
    folder = str(tmp_path_factory.mktemp("tables"))
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, passage


def test_stages_do_their_work(spark, tables, tmp_path):
    import corpus_pipeline

    folder, rows, passage = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    toxic = {i for i, t, *_ in rows if t and "scoundrel" in t}
    ids = Counter(r.doc_id for r in kept["toxicity"])
    assert ids == Counter(r[0] for r in rows if r[0] not in toxic)
    # Copies of toxic documents went with them; of other copies the first stays, repeats once.
    assert sorted(r.doc_id for r in kept["near_duplicates"]) == sorted(set(ids) - set(range(400, 420)))
    texts = {r.doc_id: r.text for r in kept["repeated_passages"]}
    assert [i for i in range(420, 430) if passage in texts[i]] == [420]
    assert set(texts) == {r.doc_id for r in kept["near_duplicates"]}
    same = {r[0]: r[1] for r in rows if r[0] < 400}
    assert all(texts[i] == same[i] for i in texts if i < 400)
    words = Counter()
    for r in kept["repeated_passages"]:
        words[r.source] += len((r.text or "").split())
    mixed = Counter()
    for r in kept["source_mix"]:
        mixed[r.source] += len(r.text.split())
    from voltmap.llm import mixing

    goal = mixing.targets(list(words.items()))
    assert all(abs(mixed[s] - goal[s]) <= 1 for s in goal)
    filled = Counter()
    for r in kept["packing"]:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and len(filled) <= sum(filled.values()) / 4096 * 1.1 + 1
    again = corpus_pipeline.run(spark, folder)
    assert Counter(again.collect()) == Counter(kept["packing"])


def test_entry_works_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "voltmap"):
        subprocess.run(["cp", "-r", f"{ROOT}/{name}", str(tmp_path)], check=True)
    code = (
        "import sys; sys.modules['voltmap.llm'] = None\n"
        "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql()\n"
        "assert not [n for n in q if n.startswith('op') and n[2:3].isdigit()] and 'pipeline' not in q\n"
        "assert 'office_matches' in q and set(s) <= set(q)"
    )
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_all_operators_are_registered():
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    numbers = sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 11)) and "pipeline" in e.queries()
