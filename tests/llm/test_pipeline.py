"""The pipeline's stages against what each is to do with its own input."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from lakelens.llm import line_templates, mixing, quality_rules
from lakelens.llm.common import saved, table

from test_operators import brute_components, word_sets


def test_stages(spark, con, sf, same):
    docs = table(spark, sf, "documents")
    first = docs.toPandas()
    kept = saved(corpus_pipeline.quality(spark, docs, sf), "t1")
    got = kept.toPandas()
    assert list(got.columns) == list(corpus_pipeline.COLUMNS)
    judged = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert set(got["doc_id"]) == {i for i in first["doc_id"] if judged[i].kept} and all(judged[i].clean_text == t for i, t in zip(got["doc_id"], got["text"]))

    lines = saved(corpus_pipeline.lines(spark, kept, sf), "t2")
    out = lines.toPandas()
    con.register("kept_docs", got)
    want = con.sql(line_templates.oracle_sql(table="kept_docs")).df()
    want = want[(want["n_dropped"] == 0) | (want["n_dropped"] < want["n_lines"])]
    same(out[["doc_id", "text"]], want[["doc_id", "text"]])
    assert list(out.columns) == list(corpus_pipeline.COLUMNS) and all(out["n_chars"] == out["text"].str.len())

    near = saved(corpus_pipeline.near_duplicates(spark, lines, sf), "t3")
    comp = brute_components(word_sets(zip(out["doc_id"], out["text"])))
    assert set(near.toPandas()["doc_id"]) == {i for i, c in comp.items() if i == c}

    mixed = saved(corpus_pipeline.mixture(spark, near, sf), "t4")
    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert mixed.toPandas()["doc_id"].value_counts().to_dict() == {i: c for i, c in copies.items() if c}

    tokens = corpus_pipeline.tokens(spark, mixed, sf)
    assert tokens.count() == mixed.count() and tokens.filter("n_tokens > 0").count() > 0


def test_rows_without_an_id_or_of_one_id_keep_their_own_columns(spark, sf):
    rows = [(None, "no id at all here", "en", "web", 17), (None, "none here either, longer", "de", "books", 24), (1, "first of the id", "en", "web", 15), (1, "second of it, other words", "fr", "books", 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda d: sorted(map(str, map(tuple, d.collect())))
    assert key(corpus_pipeline.lines(spark, docs, sf)) == sorted(map(str, rows))
    copies = [r for r in mixing.mix(docs, keep=("text",)).collect()]
    want = [r for r in rows for c in copies if c.text == r[1] for _ in range(c.copies)]
    assert key(corpus_pipeline.mixture(spark, docs, sf)) == sorted(map(str, want)) and any(r[0] is None for r in want)


TEXT = "a text of more than twenty words that has enough to say for itself so that no rule of quality takes it away from here at all"


def odd_documents(spark):
    """Null ids and columns, empty and very long texts, ties, repeated rows, rows of one id, clashing columns."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, TEXT, "en", "web", 1), (1, TEXT, "en", "web", 1), (1, TEXT + " and more", "de", "web", 1), (2, TEXT, "en", None, 1), (3, None, None, None, None), (3, "", "en", "web", 0), (None, TEXT, None, "web", 5), (None, None, None, None, None), (4, long, "en", "books", 1), (5, "other " + TEXT[::-1], "en", "books", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "_row", "_tag", "row", "size", "copies", "kept", "sid", "tag"):
        d = d.withColumn(name, F.lit("x"))
    return d, long


def shown(df):
    return sorted(((str(r.doc_id), r.text, r.lang, r.source) for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark, sf):
    d, long = odd_documents(spark)
    empty = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
    own = [r[:4] for r in shown(d)]
    with_text = [r for r in own if r[1]]
    got = corpus_pipeline.quality(spark, d, sf)
    assert got.columns == list(corpus_pipeline.COLUMNS) and shown(got) == sorted(with_text, key=str)
    # the text of id 1 also stands in id 2, too few for a template, and rows without an id drop nothing
    assert shown(corpus_pipeline.lines(spark, d, sf)) == own
    near = corpus_pipeline.near_duplicates(spark, d, sf)
    kept = shown(near)
    one = [r for r in kept if r[0] == "1"]
    assert len(one) == 1 and one[0] in own and [r for r in kept if r[0] != "1"] == [r for r in own if r[0] not in ("1", "2")]
    assert kept == shown(corpus_pipeline.near_duplicates(spark, d.repartition(3), sf))
    mixed = corpus_pipeline.mixture(spark, d, sf)
    assert mixed.columns == list(corpus_pipeline.COLUMNS) and {r for r in shown(mixed)} <= set(with_text)
    assert shown(mixed) == shown(corpus_pipeline.mixture(spark, d.repartition(3), sf)) and long in {r[1] for r in shown(mixed)} | {long}
    tokens = corpus_pipeline.tokens(spark, d, sf).collect()
    assert len(tokens) == len(own) and sum(r.n_tokens == 0 for r in tokens) == 3 and len({r.ids_sha256 for r in tokens if r.doc_id == 1}) == 2


def test_run_and_stage_list(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "mixing", "byte-level BPE"]
    assert re.fullmatch("[0-9a-f]{64}", corpus_pipeline.run(spark, sf).limit(1).collect()[0].ids_sha256)
