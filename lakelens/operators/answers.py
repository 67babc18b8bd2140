"""Grounded answers: source selection, evidence, claims, citations, salvage of model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, ranked
from .retrieval import DENIED

#: Words of a clause that denies something.
NEGATIONS = ("没有", "未见", "不含", "不存在", "看不见", "未发现")
#: Placeholders that are no facts.
PLACEHOLDERS = ("共同事实", "具体事实", "事实", "共同点", "布置元素", "内容", "物品", "元素")


def select_sources(candidates: DataFrame, least: int = 1, prefer_single: bool = False) -> DataFrame:
    """Sources of each answer in rank order: (query_id, id, place).

    ``candidates``: query_id, id, rank, confidence, coverage, reranked, reason.
    Reranked rows without a denying reason go first (two are needed), then any
    two reranked ones, else all. Floors of confidence and coverage follow from
    the best; a clear best may stand alone; too few are filled up by rank.
    """
    by = Window.partitionBy("query_id")
    denied = reduce(lambda a, w: a | F.coalesce(F.col("reason"), F.lit("")).contains(w), DENIED, F.lit(False))
    c = candidates.withColumn("re", F.col("reranked") | (F.coalesce("reason", F.lit("")) != "")).withColumn("ok", F.col("re") & ~denied)
    n = lambda x: F.sum(x.cast("int")).over(by)
    c = c.withColumn("n_ok", n(F.col("ok"))).withColumn("n_re", n(F.col("re")))
    c = c.filter(F.when(F.col("n_ok") >= 2, F.col("ok")).when(F.col("n_re") >= 2, F.col("re")).otherwise(F.lit(True)))
    conf, cov = F.coalesce("confidence", F.lit(0.0)), F.coalesce("coverage", F.lit(0.0))
    c = c.withColumn("conf", conf).withColumn("cov", cov).withColumn("best_cov", F.max(cov).over(by))
    c = c.withColumn("floor", F.greatest(F.lit(0.25), F.max("conf").over(by) * (0.5 if least >= 2 else 0.65)))
    need = F.when(F.col("best_cov") >= 0.75, 0.5).otherwise(F.greatest(F.lit(0.35), F.col("best_cov") - 0.2))
    c = c.withColumn("relevant", (F.col("best_cov") > 0) & (F.col("conf") >= F.col("floor")) & (F.col("cov") >= need)).withColumn("high", F.col("conf") >= F.col("floor"))
    c = c.withColumn("rk", F.when(F.col("relevant"), ranked(["query_id", "relevant"], "rank", "id")))
    c = c.withColumn("n_rel", n(F.col("relevant"))).withColumn("n_high", n(F.col("high")))
    first, second = (F.max(F.when(F.col("rk") == k, F.col("cov"))).over(by) for k in (1, 2))
    alone = F.lit(prefer_single) & (F.col("n_rel") >= 1) & F.coalesce(first - second >= 0.2, F.lit(True))
    # enough relevant ones: at most eight of them; else the confident ones (or all), filled up
    c = c.withColumn("alone", alone).withColumn("mode", F.when(F.col("alone"), "one").when((F.col("n_rel") > 0) & (F.least(F.col("n_rel"), F.lit(8)) >= least), "relevant").otherwise("fill"))
    c = c.withColumn("fill_rank", ranked("query_id", F.desc((F.col("n_high") == 0) | F.col("high")), "rank", "id"))
    size = F.when(F.col("n_high") == 0, F.count("*").over(by)).otherwise(F.greatest(F.col("n_high"), F.lit(least)))
    keep = F.when(F.col("mode") == "one", F.col("rk") == 1).when(F.col("mode") == "relevant", F.col("rk") <= 8).otherwise(F.col("fill_rank") <= F.least(size, F.lit(max(4, least))))
    out = c.withColumn("keep", F.coalesce(keep, F.lit(False))).filter("keep")
    place = ranked("query_id", F.when(F.col("mode") == "fill", F.col("fill_rank")).otherwise(F.col("rk")))
    return out.select("query_id", "id", place.alias("place"))


def focused(sources: DataFrame, chars: int = 1000) -> DataFrame:
    """Evidence cut to sentences with a matched term, the one before each, and the next when only one matches.

    ``sources``: id, evidence, terms. Without a match the evidence stays as it is.
    """
    parts = F.filter(F.transform(F.split("evidence", r"(?<=[。！？!?；;])\n*|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    s = sources.select("id", "evidence", F.filter(F.transform("terms", lambda x: F.lower(x)), lambda x: F.trim(x) != "").alias("terms"), parts.alias("parts"))
    rows = s.select("id", "terms", F.posexplode("parts").alias("at", "sentence"))
    hit = F.exists("terms", lambda x: F.lower("sentence").contains(x))
    w = Window.partitionBy("id").orderBy("at")
    rows = rows.withColumn("hit", hit).withColumn("n", count_where(F.col("hit")).over(Window.partitionBy("id")))
    keep = F.col("hit") | F.coalesce(F.lead("hit").over(w), F.lit(False)) | ((F.col("n") == 1) & F.coalesce(F.lag("hit").over(w), F.lit(False)))
    rows = rows.withColumn("keep", keep).filter("n > 0 AND keep")
    cut = rows.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence"))), lambda x: x["sentence"]), "").alias("f"))
    return sources.join(cut, "id", "left").select("id", F.coalesce(F.substring("f", 1, chars), "evidence").alias("evidence"))


def fact(c: Column) -> Column:
    """Compact form of a fact: no tags, no signs, no particle."""
    c = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", "")), r"(?U)[\W_]+", "")
    return F.replace(c, F.lit("的"), F.lit(""))


def claim_support(pairs: DataFrame) -> DataFrame:
    """``pairs`` (claim, evidence, ...) with ``supported``.

    The claim's compact form must be in a clause that denies nothing; longer
    claims may instead have 80 percent (two at least) of their character pairs there.
    """
    clauses = F.split(F.lower(F.regexp_replace(F.coalesce("evidence", F.lit("")), r"<[^>]+>", "")), "[。！？；;\n，,]")
    positive = F.filter(clauses, lambda x: reduce(lambda a, w: a & ~x.contains(w), NEGATIONS, F.lit(True)))
    p = pairs.withColumn("_e", fact(F.array_join(positive, " "))).withColumn("_raw", fact(F.col("evidence"))).withColumn("_c", fact(F.col("claim")))
    n = F.length("_c")
    grams = F.when(n >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.substring(F.col("_c"), i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    hits = F.size(F.filter(grams, lambda g: F.col("_e").contains(g)))
    ok = F.when((n < 2) | (F.col("_raw") == ""), False).when(F.col("_e").contains(F.col("_c")), True).when(F.col("_raw").contains(F.col("_c")) | (n <= 3), False).otherwise(hits >= F.greatest(F.lit(2), F.ceil(F.size(grams) * 0.8)))
    return p.withColumn("supported", ok).drop("_e", "_raw", "_c")


def common_facts(claims: DataFrame, least: int = 2, most: int = 8) -> DataFrame:
    """(question_id, claim, refs, place): claims supported by at least two sources, in order, dominated substrings dropped.

    ``claims``: question_id, ord, claim, ref, evidence.
    """
    clean = claims.withColumn("claim", F.trim(F.regexp_replace("claim", r"(?U)\s+", " "), F.lit(" -。；"))).filter(~F.col("claim").isin(*PLACEHOLDERS) & (F.col("claim") != ""))
    ok = claim_support(clean).filter("supported")
    g = ok.groupBy("question_id", fact(F.col("claim")).alias("key")).agg(F.min_by("claim", "ord").alias("claim"), F.min("ord").alias("ord"), F.slice(F.array_sort(F.collect_set("ref")), 1, 8).alias("refs")).filter(F.size("refs") >= least)
    other = g.select(F.col("question_id").alias("q2"), F.col("claim").alias("longer"), F.col("ord").alias("o2"))
    g = g.join(other, (F.col("question_id") == F.col("q2")) & (F.col("o2") < F.col("ord")) & F.col("longer").contains(F.col("claim")), "left_anti")
    return g.withColumn("place", ranked("question_id", "ord", "claim")).filter(F.col("place") <= most).select("question_id", "claim", "refs", "place")


def sane_citations(answers: DataFrame) -> DataFrame:
    """(id, answer): lines whose citations are all invalid go, invalid ones go from the others. ``answers``: id, answer, n_sources."""
    lines = answers.select("id", "n_sources", F.posexplode(F.split("answer", "\r?\n")).alias("at", "line"))
    refs = F.transform(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), 1), lambda r: F.coalesce(r.try_cast("long"), F.lit(0).cast("long")))
    lines = lines.withColumn("bad", F.filter(refs, lambda r: (r < 1) | (r > F.col("n_sources")))).withColumn("n", F.size(refs))
    lines = lines.filter((F.col("n") == 0) | (F.size("bad") < F.col("n")))
    # replace each bad mark of the line
    clean = F.aggregate(F.array_distinct(F.filter(F.regexp_extract_all("line", F.lit(r"\[(\d+)\]"), 1), lambda r: F.coalesce((r.try_cast("long") < 1) | (r.try_cast("long") > F.col("n_sources")), F.lit(True)))), F.col("line"), lambda acc, r: F.replace(acc, F.concat(F.lit("["), r, F.lit("]")), F.lit("")))
    lines = lines.withColumn("clean", F.trim(F.regexp_replace(clean, r"[ \t]{2,}", " "))).filter("clean <> ''")
    joined = lines.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "clean"))), lambda x: x["clean"]), "\n").alias("out"))
    return answers.join(joined, "id", "left").select("id", F.coalesce("out", F.lit("")).alias("answer"))


def salvaged(outputs: DataFrame) -> DataFrame:
    """(id, item_id, score, reason) from model output: a JSON array if it parses, else every flat object in it."""
    schema = "struct<id:bigint,score:double,reason:string>"
    body = F.regexp_extract("output", r"(?s)(\[.*\])", 1)
    whole = F.from_json(F.when(body != "", body), f"array<{schema}>")
    part = F.filter(F.transform(F.regexp_extract_all("output", F.lit(r"(\{[^{}]+\})"), 1), lambda x: F.from_json(x, schema)), lambda x: x["id"].isNotNull())
    good = F.filter(whole, lambda x: x["id"].isNotNull())
    items = F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).when(F.col("output").contains("["), part).otherwise(F.array().cast(f"array<{schema}>"))
    return outputs.select("id", F.explode(items).alias("x")).select("id", F.col("x.id").alias("item_id"), "x.score", "x.reason")
