"""The operators over the tables of a data directory, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hard_negatives, html_mincut, jaccard_join, langid, line_templates, merkle, mixing, pca_dedup, quality_gam, quality_rules, topk, url_filter
from .common import held_out, table

#: Rank file of op7 and the pipeline.
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
THRESHOLD = 0.7
#: DuckDB's class of word characters.
SQL_WORD = r"[^\x20\x09-\x0D]+"


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_mincut.extract_pages(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_topk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(rows.filter("vec_id % 100 = 0"), rows, 10)


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup_lines(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), with_text=False).drop("clean_text")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, docs.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), *tokenizer()))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = quality_gam.score(docs, docs.filter(~held_out()), labels.filter(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents")).drop("class_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_lemp_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = {"n_chars": F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    out = merkle.manifest(table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), changed=changed)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("witness")).alias("proof_sha256"), merkle.fold(F.coalesce("changed_leaf", "leaf"), F.col("witness")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_pca_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_dedup.classes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_mincut, op2_topk_histogram, op3_line_templates, op4_url_filter, op5_quality_rules, op6_language_id, op7_bpe, op8_quality_gam, op9_jaccard_join, op10_mixing, op11_lemp_negatives, op12_merkle_manifest, op13_pca_dedup)}


_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_histogram": _TOPK,
        "op3_line_templates": line_templates.oracle_sql(),
        "op4_url_filter": url_filter.oracle_sql(),
        "op11_lemp_negatives": hard_negatives.oracle_sql(),
        "op12_merkle_manifest": merkle.oracle_sql(),
        "op13_pca_dedup": pca_dedup.oracle_sql(),
        "op10_mixing": mixing.oracle_sql(f"len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}'))"),
    }
