"""Queries against their SQL on tables that the driver's smallest ones do not hold: long runs, many tags, bare references."""

import os

import duckdb
import pytest

from lakelens.operators.catalog import matches
from lakelens.plans.all import PLANS, SQL


@pytest.fixture
def with_table(spark, sf, same, tmp_path):
    """A check of queries against their SQL over the smallest tables with one of them replaced by a DuckDB query."""

    def check(table: str, rows: str, *names: str):
        con = duckdb.connect()
        con.sql("SET timezone = 'UTC'")
        for f in os.listdir(sf):
            if f != f"{table}.parquet":
                os.symlink(f"{sf}/{f}", tmp_path / f)
        con.sql(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        for f in os.listdir(tmp_path):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{tmp_path}/{f}'")
        for name in names:
            same(PLANS[name](spark, str(tmp_path)).toPandas(), con.sql(SQL[name]).df())

    return check


EVENTS = "SELECT CAST(i AS BIGINT) AS event_id, make_timestamp(CAST(@t AS BIGINT) * 1000000) AS ts, CAST(i % 2 AS BIGINT) AS user_id, 'view' AS event_type, 1.5::DOUBLE AS value, '{}' AS props FROM (SELECT unnest(range(@n)) AS i) x"


@pytest.mark.parametrize("name", ["e4_sessions", "e5_session_summary", "e6_session_names"])
def test_sessions_of_any_length(with_table, name):
    # an event every six hours for weeks: no gap, so one session a user
    with_table("events", EVENTS.replace("@t", "1704067200 + i * 21600").replace("@n", "100"), name)


def sum_of(values):
    """Plain addition one by one; ``sum`` compensates."""
    total = 0.0
    for v in values:
        total += v
    return total


def test_means_are_added_in_order_of_time(spark):
    from lakelens.operators.cluster import session_summary

    rows = [(i, 1, 0, 0, i, 0.1 * (i % 700) + 0.01, 121.0, 1, 1) for i in range(200)]
    forward = sum_of(r[5] for r in rows)
    assert forward != sum_of(r[5] for r in rows[::-1])
    df = spark.createDataFrame(rows[::-1], "id long, library_id long, run long, part long, t long, latitude double, longitude double, width int, height int")
    assert session_summary(df).collect()[0].lat == forward / 200


def test_halves_go_up_by_the_product(spark):
    from lakelens.functions.columns import rounded

    df = spark.createDataFrame([(31.2511875,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(rounded(df.x, 6)).collect()] == [31.251187 if 31.2511875 * 1e6 < 31251187.5 else 31.251188, -2.5, None]
    assert [r[0] for r in df.select(rounded(df.x, 0)).collect()] == [31.0, -3.0, None]


def test_all_tags_of_a_file(with_table):
    # twenty-five tags, one of them longer than fifty characters
    tag = "concat('Brand#', repeat('x', CASE i WHEN 3 THEN 60 ELSE 1 END), CAST(i AS VARCHAR))"
    with_table("part", f"SELECT * REPLACE (7 AS p_partkey, {tag} AS p_brand) FROM (SELECT p.*, row_number() OVER () AS i FROM '/root/testdata/sf0.001/part.parquet' p) x WHERE i <= 25", "b17_tags")


def test_bare_references_and_wide_blanks(with_table):
    html = "'a &amp b &#39; &eacute; &nbsp;c&amp;lt; ' || chr(160) || ' d &copy e<scripts>x</script> f'"
    with_table("pages", f"SELECT 1::BIGINT AS page_id, 'http://x.org/' AS url, {html} AS html UNION ALL SELECT 2, NULL, NULL", "a12_markup_text")


def test_rules_are_not_broadcast(spark, sf):
    # Spark takes the rules for as small as the file of parts
    from lakelens.operators.catalog import FEW_RULES

    names = [(f"_{i}", i) for i in range(FEW_RULES + 500)]
    rules = spark.createDataFrame([(i, [("name_contains", n), ("kind", "image")]) for n, i in names], "rule_id long, conditions array<struct<field:string,value:string>>")
    files = spark.createDataFrame([(i, "image", "jpg", 1, f"doc_{i}.jpg", 5) for i in range(30)], "id long, kind string, extension string, library_id long, name string, size long")
    out = matches(files, rules)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rule_id" in plan and "SortMergeJoin [key" in plan
    assert sorted((r.rule_id, r.file_id) for r in out.collect()) == sorted((i, f) for n, i in names for f in range(30) if n in f"doc_{f}.jpg")


def test_first_places_are_cut_before_the_shuffle(spark):
    from pyspark.sql import functions as F

    from lakelens.operators.retrieval import first_places

    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 3).alias("query_id"), "id", (F.col("id") % 7).alias("score"))
    out = first_places(df, "query_id", 5, F.desc("score"), "id")
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2  # in each task and after the shuffle
    got = sorted((r.query_id, r.pos, r.id) for r in out.collect())
    want = [(q, p, i) for q in range(3) for p, i in enumerate(sorted(range(q, 1000, 3), key=lambda i: (-(i % 7), i))[:5])]
    assert got == want


class Held:
    """A key's states and timers as a stateful processor sees them, with the most rows that one read gave."""

    def __init__(self):
        self.lists, self.maps, self.values, self.timers, self.most = {}, {}, {}, set(), 0

    def seen(self, rows):
        self.most = max(self.most, len(rows))
        return rows

    def registerTimer(self, at):
        self.timers.add(at)

    def getListState(self, name, schema):
        rows, me = self.lists.setdefault(name, []), self

        class State:
            exists = staticmethod(lambda: bool(rows))
            get = staticmethod(lambda: me.seen(list(rows)))
            put = staticmethod(lambda x: rows.__setitem__(slice(None), x))
            appendList = staticmethod(rows.extend)
            clear = staticmethod(rows.clear)

        return State

    def getMapState(self, name, key, value):
        rows, me = self.maps.setdefault(name, {}), self

        class State:
            exists = staticmethod(lambda: bool(rows))
            updateValue = staticmethod(rows.__setitem__)
            removeKey = staticmethod(rows.pop)

            @staticmethod
            def getValue(k):
                v = rows.get(k)
                if name == "held":
                    me.seen(v[0])
                return v

        return State

    def getValueState(self, name, schema):
        values = self.values

        class State:
            exists = staticmethod(lambda: name in values)
            get = staticmethod(lambda: values[name])
            update = staticmethod(lambda v: values.__setitem__(name, v))
            clear = staticmethod(lambda: values.pop(name, None))

        return State


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_held_rows_are_read_by_slices_of_time():
    import random

    import pandas as pd

    from lakelens.streaming.operators import _throttle
    from lakelens.streaming.ordered import OrderedFold

    rows = [(t, t % 50 == 0) for t in range(-100, 40_000) for _ in range(1 + t % 2)]
    want, last = [], None
    for t, empty in rows:
        last, row = _throttle(40)(last, t, empty)
        want += [("k", *row)] if row else []
    random.Random(1).shuffle(rows)
    held = Held()
    fold = OrderedFold(_throttle(40), ["job", "t"], "long", "boolean", 1_000_000)
    fold.init(held)
    frames = [pd.DataFrame(rows[i : i + 7000], columns=["t", "v"]) for i in range(0, len(rows), 7000)]
    list(fold.handleInputRows(("k",), iter(frames), At(0)))
    got = []
    for now in (5_000_500, 17_777_000, 100_000_000):  # inside a slice, then past all rows
        for ms in sorted(x for x in held.timers if x <= now):
            for out in fold.handleExpiredTimer(("k",), At(now), At(ms)):
                got += out.itertuples(index=False, name=None)
            held.timers.discard(ms)
        assert [r[1] for r in got] == [r[1] for r in want if (r[1] + 1) * 1000 <= now]
    assert got == want and held.most <= 2 * 3600  # of 60,000 rows
    for ms in sorted(held.timers):
        list(fold.handleExpiredTimer(("k",), At(10**9), At(ms)))
    assert not any(held.maps.values())


def test_a_quiet_key_goes_after_its_held_rows():
    import pandas as pd

    from lakelens.streaming.operators import _throttle
    from lakelens.streaming.ordered import OrderedFold

    held = Held()
    fold = OrderedFold(_throttle(40), ["job", "t"], "long", "boolean", 60_000)
    fold.init(held)
    list(fold.handleInputRows(("k",), iter([pd.DataFrame([(9000, False), (10, False)], columns=["t", "v"])]), At(0)))
    got = []
    while due := sorted(x for x in held.timers if x <= 9_030_000):  # past the idle time of the first row, not of the last one
        got += [tuple(r) for out in fold.handleExpiredTimer(("k",), At(9_030_000), At(due[0])) for r in out.itertuples(index=False)]
        held.timers.discard(due[0])
    assert got == [("k", 10), ("k", 9000)] and held.values["folded"][0] == 9000
    list(fold.handleExpiredTimer(("k",), At(9_060_000), At(9_060_000)))
    assert not held.values


def test_lsh_pairs_are_not_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lakelens.operators.retrieval import knn_lsh

    x = np.random.default_rng(2).standard_normal((1500, 16))
    rows = [(i, i // 4, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, None, [1.0] * 16), (2000, 500, None), (2001, 500, [1.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, file_id long, embedding array<double>").repartition(3)
    queries = vectors.filter("vec_id % 50 = 0 AND vec_id < 1500").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    out = knn_lsh(vectors, queries, 5, planes=4, tables=6, query_block=16)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    # brute force: the best of those that share a bucket of a table
    normals = np.random.default_rng(7).standard_normal((16, 24))
    signs = (x @ normals > 0).reshape(1500, 6, 4)
    want = []
    for q in range(0, 1500, 50):
        met = np.flatnonzero((signs == signs[q]).all(axis=2).any(axis=1))
        assert 0 < len(met) < 1500
        score = x[met] @ x[q]
        want += [(q, int(met[i]), int(met[i]) // 4) for i in np.lexsort((met, -score))[:5]]
    assert sorted((r.query_id, r.vec_id, r.file_id) for r in out.collect()) == sorted(want)


def test_length_of_a_vector_is_worked_out_once_a_row(spark):
    from pyspark.sql import functions as F

    from lakelens.functions.columns import unit

    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, []), (4, [0.5] * 4)], "id int, v array<double>")
    out = df.select("id", unit(F.transform("v", lambda x: x * F.lit(2.0))).alias("u"))
    # not inside the function that runs for every component
    assert "/ sqrt(aggregate(" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert {r.id: r.u for r in out.collect()} == {1: [0.6, 0.8], 2: None, 3: [], 4: [0.5] * 4}


def test_quantiser_is_in_single_precision():
    import numpy as np

    from lakelens.operators.vector_index import Quantiser

    x = np.random.default_rng(3).standard_normal((600, 8))
    q = Quantiser.learn(x, 16, 4)
    at, codes = q.encode(x)
    assert {a.dtype for a in (q.cells, *q.books)} == {np.dtype(np.float32)} and codes.shape == (600, 4)
    near = ((x[:, None] - q.cells) ** 2).sum(axis=2)
    assert np.allclose(near[np.arange(600), at], near.min(axis=1), atol=1e-4)


def test_rules_of_equal_conditions_are_looked_up_once(spark):
    from lakelens.operators.catalog import SET_RULES, rule_sets

    some = [[("name_contains", "_1")], [("kind", "image"), ("min_size", "5")], [("kind", None)], [], None]
    n = 3 * SET_RULES
    rules = spark.createDataFrame([(i, some[0] if i < n else some[i % 5]) for i in range(n + 500)], "rule_id long, conditions array<struct<field:string,value:string>>")
    sets = rule_sets(rules).collect()
    assert len(sets) <= 10 and max(len(r.rules) for r in sets) < 2 * SET_RULES and sorted(i for r in sets for i in r.rules) == list(range(n + 500))
    files = spark.createDataFrame([(i, ("image", "video")[i % 2], "jpg", 1, f"doc_{i}.jpg", i) for i in range(20)], "id long, kind string, extension string, library_id long, name string, size long")
    fits = [lambda f: str(f).startswith("1"), lambda f: f % 2 == 0 and f >= 5, lambda f: False, lambda f: True, lambda f: False]
    want = sorted((i, f) for i in range(n + 500) for f in range(20) if (fits[0] if i < n else fits[i % 5])(f))
    assert sorted((r.rule_id, r.file_id) for r in matches(files, rules).collect()) == want


def _folded(rows, size, step, waits):
    """Rows given to a fold in frames of ``size``, its output at the watermarks ``waits`` (ms), and its states."""
    import pandas as pd

    from lakelens.streaming.ordered import OrderedFold

    held, got = Held(), []
    fold = OrderedFold(step, ["key", "t", "v"], "long", "long", None)
    fold.init(held)
    for at, now in zip(range(0, len(rows), size), [*waits, *[waits[-1]] * len(rows)]):
        list(fold.handleInputRows(("k",), iter([pd.DataFrame(rows[at : at + size], columns=["t", "v"])]), At(now)))
        while due := sorted(x for x in held.timers if x <= now):
            for out in fold.handleExpiredTimer(("k",), At(now), At(due[0])):
                got += out.itertuples(index=False, name=None)
            held.timers.discard(due[0])
    return held, got


def test_a_key_of_few_rows_is_one_part_and_one_timer():
    # a row in each of 300 hours
    held, got = _folded([(i * 3600, i) for i in range(300)], 300, lambda s, t, v: (v, (t, v)), [0])
    assert len(held.maps["held"]) == 1 and len(held.timers) == 1 and not got
    held, got = _folded([(i * 3600, i) for i in range(300)], 300, lambda s, t, v: (v, (t, v)), [10**12])
    assert got == [("k", i * 3600, i) for i in range(300)] and not held.maps["held"] and list(held.values) == ["folded"]


@pytest.mark.parametrize("seed", range(6))
def test_slices_of_any_length_keep_the_order(monkeypatch, seed):
    import random

    from lakelens.streaming import ordered

    monkeypatch.setattr(ordered, "SLICE_ROWS", 64)
    monkeypatch.setattr(ordered, "TAKEN", 70)
    rng = random.Random(seed)
    hours = [rng.choice([rng.randrange(-50, 400), 7, 8, 300]) for _ in range(4000)]
    rows = [(h * 3600 + rng.randrange(3600), i) for i, h in enumerate(hours)]
    if seed % 2:  # late by fifty hours at most, so that some are folded while others come
        rows.sort(key=lambda r: r[0] + rng.randrange(50 * 3600))
    waits = [(min(t for t, _ in rows[i:]) - 1) * 1000 for i in range(90, 4000, 90)] + [10**12]
    held, got = _folded(rows, 90, lambda s, t, v: (v, (t, v)), waits)
    assert got == [("k", t, v) for t, v in sorted(rows)]
    many = max(hours.count(h) for h in hours)
    assert held.most <= max(many, 90) and not held.maps["held"] and "slices" not in held.values


def _texts(spark, n, parts):
    """Files with many hits of a few words, some texts null."""
    import random

    rng = random.Random(4)
    words = ["alpha", "alphabet", "beta", "happy birthday", "birthday", "aaaa", "of", "红色气球", "x"]
    rows = [(i, f"doc {i}", rng.choice(["p/of", "p/alpha", "p"]), None if i % 5 == 0 else rng.choice(words), None if i % 7 == 0 else " ".join(rng.choices(words, k=rng.randrange(40))), None if i % 11 == 0 else i * 7 % 50) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, name string, path string, caption string, text string, mtime_s long").repartition(parts)


def _brute_lexical(rows, asked, limit, group_limit):
    """Asked groups (query_id, batch, words) against every file."""
    import math

    weights, cells = (7.0, 3.0, 3.5, 1.0), {r[0]: [(x or "").lower() for x in r[1:5]] for r in rows}
    size = {i: sum(max(0, len(x) - 2) for x in c) for i, c in cells.items()}
    mean = sum(size.values()) / len(size)
    f = {w: {i: n for i, c in cells.items() if (n := sum(k * x.count(w) for k, x in zip(weights, c)))} for _, _, ws in asked for w in ws if len(w) >= 3}
    idf = {w: max(1e-6, math.log((len(rows) - len(x) + 0.5) / (len(x) + 0.5))) for w, x in f.items()}
    out = []
    for q, batch, ws in asked:
        scores = {i: sum(idf[w] * f[w][i] * 2.2 / (f[w][i] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w in ws if i in f.get(w, {})) for i in cells if (all if batch < 0 else any)(i in f.get(w, {}) for w in ws)}
        best = sorted(scores, key=lambda i: (-math.floor(scores[i] * 1e9 + 0.5), i))[: limit if batch < 0 else group_limit]
        out += [(q, batch, i, pos, round(scores[i], 6)) for pos, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [50_000, 3])
def test_best_files_of_each_group(spark, monkeypatch, block):
    from lakelens.operators import retrieval as r

    monkeypatch.setattr(r, "TERM_BLOCK", block)
    monkeypatch.setattr(r, "TABLE_CELLS", 40)
    rows, files = _texts(spark, 300, 3)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "lpha"), (3, "生日"), (4, "beta of"), (5, "alpha"), (6, "aaa"), (7, "absent alpha"), (8, "")], "query_id long, query string")
    birthday = ["生日", "birthday", "happy birthday", "寿星"]
    asked = [(1, -1, ["alpha", "beta"]), (1, 0, ["alpha"]), (1, 1, ["beta"]), (2, -1, ["lpha"]), (2, 0, ["lpha"]), (3, 0, birthday), (4, 0, ["beta"]), (5, -1, ["alpha"]), (5, 0, ["alpha"]), (6, -1, ["aaa"]), (6, 0, ["aaa"]), (7, 1, ["alpha"])]
    got = sorted((x.query_id, x.batch, x.id, x.pos, round(x.score, 6)) for x in r.lexical(files, queries, 30, 20).collect())
    assert got == _brute_lexical(rows, asked, 30, 20)


def test_a_task_keeps_the_best_files_of_each_group_only(spark):
    from pyspark.sql import functions as F

    from lakelens.operators.retrieval import lexical

    _, files = _texts(spark, 900, 3)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "alpha"), (3, "beta alpha")], "query_id long, query string")
    out = lexical(files, queries, 5, 4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert out.count() == 5 + 5 + 5 + 4 * 5 and out.filter((F.col("batch") == -1) & (F.col("query_id") != 2)).groupBy("pos").agg(F.count_distinct("id").alias("n")).filter("n > 1").isEmpty()


@pytest.mark.parametrize("block", [50_000, 1])
def test_fallback_keeps_the_newest_files_of_each_term(spark, monkeypatch, block):
    from lakelens.operators import retrieval as r

    monkeypatch.setattr(r, "TERM_BLOCK", block)
    rows, files = _texts(spark, 300, 3)
    queries = spark.createDataFrame([(1, "of zzz"), (2, "alpha zzz"), (3, "alpha"), (4, "zzz"), (5, "of alpha zzz")], "query_id long, query string")
    hits = spark.createDataFrame([(3, -1)], "query_id long, batch int")
    terms = {1: ["of", "zzz"], 2: ["alpha", "zzz"], 4: ["zzz"], 5: ["of", "alpha", "zzz"]}
    want = []
    for q, ts in terms.items():
        met = [x for x in rows if any(t in (c or "").lower() for t in ts for c in (x[1:5] if len(t) < 3 else x[1:3]))]
        want += [(q, x[0], pos) for pos, x in enumerate(sorted(met, key=lambda x: (x[5] is None, -(x[5] or 0), x[0]))[:12])]
    out = r.substring_fallback(files, queries, hits, 12)
    some = spark.createDataFrame([("of",), ("x",)], "term string")
    one = files.filter("text IS NOT NULL").coalesce(1).select("id", "mtime_s", "text").mapInArrow(r._newest_files(["of", "x"], 1, 12), "term string, id long, mtime_s long")
    assert one.count() == 24 and r._newest(files, some, ["text"], 12).count() == 24  # nothing else leaves a task
    assert sorted((x.query_id, x.id, x.pos) for x in out.collect()) == sorted(want) and {q for q, *_ in want} == {1, 2, 5}


def test_texts_are_not_shuffled_for_labels(spark, sf, with_table, tmp_path):
    from lakelens.plans.registry import Tables
    from lakelens.plans.search_plans import _files

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _files(Tables(spark, sf)).select("id", "text", "caption")._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # two labels of a document make two rows of its file, as in the SQL
    with_table("labels", f"SELECT * FROM '{sf}/labels.parquet' UNION ALL (SELECT * FROM '{sf}/labels.parquet' ORDER BY doc_id LIMIT 1)")
    assert _files(Tables(spark, str(tmp_path))).count() == Tables(spark, sf).files_v.count() + 1
