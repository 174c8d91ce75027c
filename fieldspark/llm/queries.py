"""The text operators as registered queries: production parameters, whole tables, and the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontamination, inverted_multi_index, language_id, minhash_dedup, packing, quality, substring_dedup, suffix_dedup, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1")
    return quality.classify(_table(spark, sf_dir, "documents"), trusted)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").where(_remainder(4) != 2)
    out = toxicity.classify(_table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inverted_multi_index.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(7) != 2).alias("train"))
    out = context_tree.score(docs)
    return out.select("doc_id", F.coalesce(_remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "code_length")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.identify(docs, docs.where(F.col("doc_id").isNotNull() & (_remainder(3) != 1)))
    return out.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_repeated", F.explode("spans").alias("span")).select("doc_id", "n_words", "n_repeated", "span.start", "span.length")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_packing": op7_packing,
    "op8_context_tree": op8_context_tree,
    "op9_language_id": op9_language_id,
    "op10_suffix_dedup": op10_suffix_dedup,
}
_WORDS = r"CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END"


def _windows(n: int) -> str:
    """d AS documents with their words (numbered as rows), w AS their windows of n words."""
    return f"""d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT rid, doc_id, pos, array_to_string(list_slice(words, pos, pos + {n - 1}), ' ') AS k FROM (SELECT *, unnest(range(1, len(words) - {n - 2})) AS pos FROM d))"""


SUBSTRING_SQL = f"""WITH {_windows(20)},
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + 20)) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w) WHERE n > 1),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text FROM (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d) ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM gone GROUP BY rid) USING (rid)"""

NEAR_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace("(text,", "(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, pos, pos + 4), ' ') END AS k
  FROM (SELECT *, unnest(range(1, greatest(len(words) - 3, 2))) AS pos FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id <= coalesce(b, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON a = doc_id"""

REPEATED_SQL = f"""WITH {_windows(50)},
hit AS (SELECT DISTINCT rid, unnest(range(pos, pos + 50)) - 1 AS pos FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(DISTINCT rid) > 1)),
span AS (SELECT rid, min(pos) AS start, count(*) AS length FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid ORDER BY pos) AS g FROM hit) GROUP BY rid, g)
SELECT doc_id, len(words) AS n_words, sum(length) OVER (PARTITION BY rid)::BIGINT AS n_repeated, start, length FROM span JOIN d USING (rid)"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_SQL,
    "op2_minhash_dedup": NEAR_SQL,
    "op4_decontamination": decontamination.ORACLE_SQL,
    "op10_suffix_dedup": REPEATED_SQL,
}
