"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import html

    return html.extract(_read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import packing

    packed = packing.pack(packing.tokenize(_read(spark, sf_dir, "documents")))
    return packed.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import lm

    return lm.score(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import substrings

    return substrings.classes(substrings.passages(_read(spark, sf_dir, "documents")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import mixing

    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda total, t: total + t["words"])
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "source", "takes"
    )


def op6_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import toxicity

    docs = _read(spark, sf_dir, "documents")
    score = toxicity.scorer(spark, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return docs.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), score("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op9_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import search

    return search.search(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import neardup

    found = neardup.classes(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_copies")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import quality

    found = quality.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op8_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import fingerprints

    return fingerprints.with_edits(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import decontaminate

    found = decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op12_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltmap.llm import filter_audit
    from voltmap.session import cut

    counts = filter_audit.masks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return filter_audit.audit(cut(counts))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voltmap.llm import alignment

    a, b = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.score(_read(spark, sf_dir, "documents"), a, b).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_style_text": op1_site_style_text,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_source_mix": op5_source_mix,
    "op6_toxic_passages": op6_toxic_passages,
    "op7_importance_resampling": op7_importance_resampling,
    "op8_multiset_fingerprints": op8_multiset_fingerprints,
    "op9_bm25_top_k": op9_bm25_top_k,
    "op10_near_copies": op10_near_copies,
    "op11_contaminated": op11_contaminated,
    "op12_filter_orders": op12_filter_orders,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op11_contaminated": r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spots AS (
  SELECT item, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM spots),
starts AS (
  SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
places AS (SELECT k, i, m, array_to_string(w[i:i + m - 1], ' ') AS t FROM starts),
hits AS (SELECT DISTINCT k, i, m, item FROM places JOIN win USING (m, t)),
words AS (SELECT DISTINCT k, unnest(range(i, i + m)) AS j FROM hits),
n AS (SELECT k, count(*) AS n_hit FROM words GROUP BY k),
named AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (k) LEFT JOIN named USING (k)
""",
    "op12_filter_orders": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
  FROM d),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
c AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
p AS (
  SELECT filter_order, step, part, substr(filter_order, step, 1) AS filter,
    c.n, c.good, c.toxic, contains(fails, substr(filter_order, step, 1)) AS hit, fails = substr(filter_order, step, 1) AS alone,
    length(translate(substr(filter_order, 1, step - 1), fails, '')) = step - 1 AS there
  FROM s, c),
r AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN there AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN there AND hit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND NOT there THEN n ELSE 0 END) AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN there AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN there AND hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM p GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM r
""",
}
