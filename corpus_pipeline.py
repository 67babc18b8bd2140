"""Corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and is written as Parquet and read again
before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelens.llm import bpe, jaccard_join, line_templates, mixing, quality_rules
from lakelens.llm.common import saved, table
from lakelens.llm.queries import tokenizer

#: A class of more than one row in so many is joined by broadcast.
HEAVY = 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, without their failing lines.

    A null, empty or short text is rejected; texts of any length are judged
    whole; repeated rows, rows of one id and rows without an id are judged one
    by one; other columns than those of ``documents`` are left out; an empty table gives an empty one.
    """
    judged = quality_rules.judge(docs.select(F.struct("doc_id", "lang", "source").alias("_row"), "text"), id_col="_row").filter("kept")
    return judged.select("_row.doc_id", F.col("clean_text").alias("text"), "_row.lang", "_row.source", F.length("clean_text").cast("long").alias("n_chars"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that had lines and lost them all is held whole by others and goes.

    Every other row stays, also one with a null or empty text, without an id or
    with an id that repeats, with its own language and source; rows of one id
    count as one document; an empty table gives an empty one.
    """
    rest = line_templates.dedup_lines(docs, keep=("lang", "source")).filter("n_dropped = 0 OR n_dropped < n_lines")
    return rest.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest id, then of the smallest hash of its columns.

    Rows that repeat come down to one, and rows of one id are told apart by
    their columns. A row without words or without an id belongs to no class and stays.
    An empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS, F.xxhash64("text", "lang", "source").alias("_tag"))
    rows = jaccard_join.classes(docs, with_links=False, tag_col="_tag").filter("class_id IS NOT NULL").select("class_id", F.struct("doc_id", "_tag").alias("row"))
    first = saved(rows.groupBy("class_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1"), "pipeline-first")
    # at most HEAVY classes hold more than one row in HEAVY: their first rows go to every task, so that no key is hot
    total = first.agg(F.sum("n")).first()[0] or 0
    heavy = first.filter(F.col("n") * HEAVY > total).select("class_id", F.col("first").alias("of_heavy"))
    light = first.filter(F.col("n") * HEAVY <= total).select(F.col("class_id").alias("light_id"), F.col("first").alias("of_light"))
    rows = rows.join(F.broadcast(heavy), "class_id", "left")
    key = F.when(F.col("of_heavy").isNull(), F.col("class_id")).otherwise(F.xxhash64("row"))
    rows = rows.withColumn("light_id", key).join(light, "light_id", "left").withColumn("first", F.coalesce("of_heavy", "of_light"))
    losers = rows.filter("row != first").select("row.doc_id", "row._tag").distinct()
    # rows without a class need neither the join nor the numbering, and would be hot keys there
    classless = F.col("doc_id").isNull() | (F.coalesce(F.trim(F.translate("text", "\t\n\x0b\f\r", "     ")), F.lit("")) == "")
    again = F.row_number().over(Window.partitionBy("doc_id", "_tag").orderBy(F.lit(0)))
    left = docs.filter(~classless).join(losers, ["doc_id", "_tag"], "left_anti").withColumn("_again", again).filter("_again = 1")
    return left.select(*COLUMNS).unionByName(docs.filter(classless).select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, also one without an id or a source, with its own columns.

    A row without words is not taken; rows of one id and size are taken in one
    order, so that reruns agree; an empty table gives an empty one.
    """
    out = mixing.mix(docs, keep=("text", "lang", "n_chars")).filter("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix, encoded and decoded again.

    A null text counts as empty; every row gives a row, repeated ones alike; an empty table gives an empty one.
    """
    return bpe.digests(bpe.encode_decode(docs, *tokenizer()))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("byte-level BPE", tokens),
]
#: Token digests have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
