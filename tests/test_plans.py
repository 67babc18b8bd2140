"""Every registered query against its SQL in DuckDB, and plan shapes."""

import pytest

from lakelens.plans.all import PLANS, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, sf, same, name):
    same(PLANS[name](spark, sf).toPandas(), con.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(PLANS) - set(SQL)))
def test_runs(spark, sf, name):
    assert PLANS[name](spark, sf).count() > 0


def explain(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_listing_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in explain(PLANS["b1_listing_largest"](spark, sf))


def test_filters_and_columns_reach_the_scan(spark, sf):
    from lakelens.plans.views import view

    plan = explain(view(spark, sf, "documents").filter("doc_id > 5").select("doc_id"))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "text" not in plan.split("ReadSchema")[1]


def test_streams_agree_with_tables(spark, sf, same):
    same(PLANS["s7_throttled"](spark, sf).toPandas(), PLANS["s7_throttled_stream"](spark, sf).toPandas())


def test_lsh_recall(spark, sf):
    exact = {(r.query_id, r.vec_id) for r in PLANS["c7_knn"](spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in PLANS["c7_knn_lsh"](spark, sf).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_bounded_threshold_is_refused(spark):
    from lakelens.operators.dedup import near_pairs

    with pytest.raises(ValueError):
        near_pairs(spark.createDataFrame([(1, 2)], "id long, fp long"), 9)
