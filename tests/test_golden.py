"""Small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.functions.vectors import nearest_centre
from lakelens.operators import answers, catalog, cluster, dedup, retrieval, state, terms, text
from lakelens.sources.files import inventory, rescan


def test_query_terms(spark):
    cases = {
        "生日聚会照片中有哪些共同的布置元素？": ["生日", "聚会"], "这些生日聚会照片里共同出现了哪些布置和物品？": ["生日", "聚会"], "这些生日聚会有哪些共同布置？": ["生日", "聚会"],
        "有哪些照片同时拍到了灰色猫咪和花盆？": ["灰色", "猫咪", "花盆"], "猫在花盆里": ["猫", "花盆"], "中国旅行": ["中国", "旅行"], "桌面上的生日蛋糕": ["桌面", "生日", "蛋糕"],
        "南方电网充电订单的实付金额和退款金额分别是多少？": ["南方", "电网", "充电", "订单", "实付", "金额", "退款"], "木质平台上的大熊猫正在做什么？": ["木质", "平台", "大熊猫"], "鱼缸里的鱼主要有哪些颜色？": ["鱼缸", "鱼", "颜色"], "Blue IMG_12.jpg x": ["blue", "img_12.jpg"],
    }
    rows = spark.createDataFrame(list(cases), "string").select("value", terms.query_terms(F.col("value")).alias("t")).collect()
    assert {r.value: list(r.t) for r in rows} == cases
    pairs = {tuple(r) for r in terms.alias_pairs(spark).collect()}
    assert {("桌面", "桌上"), ("喵", "猫咪"), ("喵", "喵")} <= pairs and ("猫咪", "喵") not in pairs


def test_date_ranges(spark):
    q = spark.createDataFrame([(1, "去年在北京的照片"), (2, "2024年5月 生日聚会"), (3, "最近7天的合同"), (4, "猫"), (5, "2024年的合同"), (6, "本月")], "query_id int, query string")
    got = {r.query_id: (str(r.date_from), str(r.date_to), r.cleaned) for r in terms.date_range(q, F.lit("2026-08-12").cast("date")).collect()}
    assert got == {
        1: ("2025-01-01", "2025-12-31", "在北京的照片"), 2: ("2024-05-01", "2024-05-31", "生日聚会"), 3: ("2026-08-06", "2026-08-12", "合同"),
        4: ("None", "None", "猫"), 5: ("2024-01-01", "2024-12-31", "合同"), 6: ("2026-08-01", "2026-08-12", "本月"),
    }


@pytest.mark.parametrize(
    ("rows", "kw", "want"),
    [
        ([("party", 0.45, 1.0, True, ""), ("two", 0.4, 2 / 3, False, "直接相关"), ("desk", 0.8, 1 / 3, False, "")], {}, ["party", "two"]),
        ([("party", 0.8, 1.0, True, ""), ("two", 0.7, 1.0, False, ""), ("desk", 0.9, 0.25, False, "")], {}, ["party", "two"]),
        ([("party", 0.8, 0.5, False, "直接相关"), ("two", 0.7, 0.5, False, "直接相关"), ("card", 0.9, 0.5, False, "非生日聚会场景")], {}, ["party", "two"]),
        ([("exact", 0.9, 1.0, False, ""), ("partial", 0.8, 0.7, False, ""), ("weak", 0.4, 0.4, False, "")], {"prefer_single": True}, ["exact"]),
        ([("exact", 0.9, 1.0, False, ""), ("partial", 0.8, 0.7, False, ""), ("weak", 0.4, 0.4, False, "")], {"least": 2}, ["exact", "partial"]),
        ([("best", 0.95, 1.0, False, ""), ("second", 0.2, 0.4, False, "")], {"least": 2}, ["best", "second"]),
    ],
)
def test_answer_sources(spark, rows, kw, want):
    df = spark.createDataFrame([(1, n, i, c, v, r, w) for i, (n, c, v, r, w) in enumerate(rows)], "query_id int, id string, rank int, confidence double, coverage double, reranked boolean, reason string")
    assert [r.id for r in answers.select_sources(df, **kw).orderBy("place").collect()] == want


def test_focused_evidence(spark):
    df = spark.createDataFrame([
        (1, "男子坐在桌前，桌上有泰迪熊和蛋糕。身后有HAPPY BIRTHDAY气球。房间另一侧有酒瓶和玻璃杯。", ["birthday", "桌前"]),
        (2, "男女站在室内拍照。身后有HAPPY BIRTHDAY气球。桌上摆放着蛋糕和香槟。", ["birthday"]), (3, "无关。", ["x"]),
    ], "id int, evidence string, terms array<string>")
    got = {r.id: r.evidence for r in answers.focused(df).collect()}
    assert "泰迪熊" in got[1] and "BIRTHDAY" in got[1] and "酒瓶" not in got[1]
    assert "BIRTHDAY" in got[2] and "香槟" in got[2] and got[3] == "无关。"


def test_partial_caps(spark):
    rows = spark.createDataFrame([(0.5,), (2 / 3,), (0.0,)], "c double").select(retrieval.partial_cap(F.col("c")).alias("x")).collect()
    assert [r.x for r in rows] == [0.58, 0.68, 0.3]


def test_coverage_beats_vector_score(spark):
    files = spark.createDataFrame([(1, "a.jpg", "a", "", "一只灰色猫咪"), (2, "b.jpg", "b", "", "灰色猫咪在花盆旁边")], "id long, name string, path string, text string, caption string").withColumn("mtime_s", F.lit(1))
    q = spark.createDataFrame([(1, "有哪些照片同时拍到了灰色猫咪和花盆？")], "query_id long, query string")
    sem = spark.createDataFrame([(1, 1, 0.82, 0), (1, 2, 0.76, 1)], "query_id long, id long, score double, pos int")
    assert [r.id for r in retrieval.search(files, q, sem).orderBy("rank").collect()] == [2, 1]


def test_band_completeness(spark):
    other = sum(1 << k for k in range(0, 50, 7))
    assert bin(other).count("1") == 8
    groups = dedup.similar_groups(spark.createDataFrame([(1, 0), (2, other), (3, -1)], "id long, fp long")).collect()
    assert {(r.group_id, r.id, r.distance) for r in groups} == {(1, 1, 0), (1, 2, 8)}


def test_rescan(spark, tmp_path):
    (tmp_path / "lib/#recycle").mkdir(parents=True)
    for n in ("lib/a.txt", "lib/b.JPG", "lib/#recycle/c.txt", "lib/._d.txt"):
        (tmp_path / n).write_text("x" * 10)
    empty = spark.createDataFrame([], "id long, library_id long, path string, size long, mtime_s long")
    scan = inventory(spark, str(tmp_path / "lib"), 7)
    assert {(r.name, r.kind, r.size) for r in scan.collect()} == {("a.txt", "document", 10), ("b.JPG", "image", 10)}
    changes, snapshot, _ = rescan(scan, empty)
    assert changes.filter("change = 'insert'").count() == 2
    old = snapshot.withColumn("id", F.lit(1).cast("long"))
    (tmp_path / "lib/a.txt").unlink()
    changes, _, gone = rescan(inventory(spark, str(tmp_path / "lib"), 7), old)
    assert {r.change: r["count"] for r in changes.groupBy("change").count().collect()} == {"unchanged": 1, "delete": 1} and gone.count() == 1


def test_chunks_advance_and_overlap():
    t = "word. " * 1000
    s = list(text.spans(t))
    assert s[0][0] == 0 and s[-1][1] == len(t) and all(a < b and c <= b for (a, b), (c, _) in zip(s, s[1:])) and list(text.spans("")) == []
    assert all(b - a <= 1200 for a, b in s) and list(text.spans("x" * 3000))[1][0] == 1200 - 120


def test_chunks_end_where_the_last_mark_of_the_window_lets_them():
    plain = "第一段。" * 1000
    got = text.spans(plain, 300, 30)
    assert len(got) > 5 and got[0] == (0, 300) and got[1][0] == 270 and got[-1][1] == len(plain)
    # of a full stop with a blank the blank is in the next chunk; a mark must lie wholly in the window
    for body, end in (("x" * 79 + ". " + "x" * 60, 80), ("x" * 98 + ". " + "x" * 60, 99), ("x" * 99 + ". " + "x" * 60, 100), ("x" * 99 + "\n" + "x" * 60, 100), ("x" * 49 + "。" + "x" * 90, 100), ("x" * 50 + "。" + "x" * 90, 51)):
        assert text.spans(body, 100, 10)[0] == (0, end), body
    for mark in "!?;":
        assert text.spans("x" * 79 + mark + " " + "x" * 60, 100, 10)[0] == (0, 100)
    close = text.spans("ab。" * 40, 4, 10)  # an overlap beyond the chunk
    assert all(y[0] == x[0] + 1 for x, y in zip(close, close[1:])) and close[-1][1] == 120


def test_chunks_are_cut_from_trimmed_texts(spark):
    rows = [(1, "  one \n"), (2, None), (3, " \t\n"), (4, ""), (5, " " + "Words of it. " * 200)]
    got = text.chunks(spark.createDataFrame(rows, "id long, text string")).orderBy("id", "chunk_index").collect()
    assert got[0] == (1, 0, "one", 0, 3) and {r.id for r in got} == {1, 5}
    whole = rows[4][1].strip()
    assert all(r.content == whole[r.start_offset : r.end_offset] for r in got if r.id == 5) and got[-1].end_offset == len(whole)


def test_decoding():
    assert text.decoded("猫咪".encode("gb18030")) == "猫咪" and text.decoded(b"\xef\xbb\xbfabc") == "abc"


def test_long_sessions_are_cut_from_their_start(spark):
    day = 86_400
    rows = [(i, 1, i * day // 4, 31.0, 121.0, 1, 1) for i in range(60)]  # 15 days, no gap
    df = spark.createDataFrame(rows, "id long, library_id long, t long, latitude double, longitude double, width int, height int")
    got = cluster.event_sessions(df).groupBy("run", "part").count().orderBy("part").collect()
    assert [r["count"] for r in got] == [29, 29, 2]  # a session may last exactly seven days


def test_places_and_sessions(spark):
    rows = [(1, 31.2301, 121.4701, 0), (2, 31.2302, 121.4702, 600), (3, 31.2303, 121.4703, 1200), (4, 39.9001, 116.4001, 90_000), (5, 39.9002, 116.4002, 90_600), (6, 39.9003, 116.4003, 91_200), (7, 0.0, 0.0, 500_000)]
    df = spark.createDataFrame([(i, 1, t, a, o, 10, 10) for i, a, o, t in rows], "id long, library_id long, t long, latitude double, longitude double, width int, height int")
    assert sorted(r.members for r in cluster.place_clusters(df).collect()) == [3, 3]
    assert sorted(r.members for r in cluster.session_summary(cluster.event_sessions(df)).collect()) == [3, 3]


def test_throughput(spark):
    df = spark.createDataFrame([(1, "index", "completed", 0, 10, 10, 10), (2, "index", "pending", 0, 0, 0, 1)], "id long, type string, status string, started_s long, finished_s long, work_done long, work_total long")
    r = state.throughput(df, 20).collect()[0]
    assert (r.per_minute, r.remaining, r.eta_s) == (60.0, 1, 1)


def test_pruning(spark):
    df = spark.createDataFrame([(i, "completed", 1000 + i) for i in range(102)], "id long, status string, finished_s long")
    assert sorted(r.id for r in state.prunable(df, 2000, 100, 30).collect()) == [0, 1]


def test_leaders_follow_id_order(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.4359]), (3, 0, [0.0, 1.0])], "vec_id long, block long, embedding array<double>")
    assert {r.vec_id: r.cluster for r in cluster.leader_clusters(df, "block", 0.8).collect()} == {1: 1, 2: 1, 3: 3}


def test_visible_needs_grants(spark):
    files = spark.createDataFrame([(1, 1), (2, 2)], "id long, library_id long")
    users = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "user_id long, admin int")
    grants = spark.createDataFrame([(2, 2, 0)], "user_id long, library_id long, admin int")
    assert {(r.user_id, r.id) for r in catalog.visible(files, users, grants).collect()} == {(1, 1), (1, 2), (2, 2)}


def test_upsert_stream(spark, tmp_path):
    from lakelens.streaming.operators import catalog_upsert

    up = catalog_upsert(str(tmp_path / "cat"))
    schema = "path string, library_id long, size long, mtime_s long"
    up(spark.createDataFrame([("a", 1, 5, 1), ("b", 1, 5, 1), ("a", 1, 6, 2)], schema), 0)
    up(spark.createDataFrame([("b", 1, 5, 1), ("c", 1, 1, 1)], schema), 1)
    got = {r.path: r.size for r in spark.read.parquet(str(tmp_path / "cat/1")).collect()}
    assert got == {"a": 6, "b": 5, "c": 1}


def test_upserts_start_from_the_last_whole_snapshot_and_skip_replays(spark, tmp_path):
    from lakelens.streaming.operators import catalog_upsert, finished

    schema = "path string, library_id long, size long, mtime_s long"
    spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 2)], "path string, group_id long").write.parquet(str(tmp_path / "groups"))
    up = catalog_upsert(str(tmp_path / "cat"), str(tmp_path / "groups"))
    groups = lambda n: {r.path for r in spark.read.parquet(str(tmp_path / f"groups-after/{n}")).collect()}
    up(spark.createDataFrame([("a", 1, 5, 1), ("x", 1, 5, 1)], schema), 3)
    assert groups(3) == {"b", "c", "d", "e"}
    up(spark.createDataFrame([("d", 1, 5, 1), ("x", 1, 5, 1)], schema), 7)
    # what batch 3 removed stays away, the unchanged row keeps its stage, a group of one goes
    assert groups(7) == {"b", "c"} and finished(spark, str(tmp_path / "cat")) == [3, 7]
    up(spark.createDataFrame([("zzz", 1, 5, 1)], schema), 7)
    up(spark.createDataFrame([("zzz", 1, 5, 1)], schema), 5)
    assert {r.path for r in spark.read.parquet(str(tmp_path / "cat/7")).collect()} == {"a", "x", "d"} and finished(spark, str(tmp_path / "cat")) == [3, 7]


@pytest.mark.parametrize("batch", [7, 10_000])
def test_stateful_streams_sort_all_parts_of_a_key(spark, tmp_path, batch):
    """One key, rows in no order, many Arrow parts: the streams agree with the tables."""
    import random

    from lakelens.streaming import operators as st

    rows = [(t, t % 13 == 0, t * t % 7) for t in range(600)]
    random.Random(3).shuffle(rows)
    data = spark.createDataFrame([(0, *r) for r in rows], "key long, t long, flag boolean, v long").repartition(5)
    data.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        run = lambda q, where: {tuple(r) for r in st.run_available(q, str(tmp_path / where)).collect()}
        jobs = lambda d: d.select(F.col("key").alias("job"), "t", F.col("flag").alias("queue_empty"))
        assert run(st.throttled_stream(jobs(source), 40, late="0 seconds"), "a") == {tuple(r) for r in st.throttled(jobs(data), 40).collect()}
        results = lambda d: d.select("key", "t", F.col("flag").alias("ok"))
        assert run(st.retries_stream(results(source), late="0 seconds"), "b") == {tuple(r) for r in st.retries(results(data)).collect()}
        signs = lambda d: d.select(F.col("key").alias("library_id"), "t", F.col("v").alias("signature"))
        assert run(st.signature_changes_stream(signs(source), late="0 seconds"), "c") == {tuple(r) for r in st.signature_changes(signs(data)).collect()}
    finally:
        spark.conf.set(name, was)


def test_late_rows_are_folded_in_their_place_and_quiet_keys_forgotten(spark, tmp_path):
    """Files of one micro-batch each: rows up to a minute late give the table's result, later ones are dropped, and state goes after its time."""
    from lakelens.streaming import operators as st
    from lakelens.streaming.ordered import STORE

    schema = "library_id long, t long, signature long"
    was = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)

    def run(name, batches, **kw):
        q = None
        for n, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
            source = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
            q = st.signature_changes_stream(source, **kw).writeStream.format("parquet").option("path", str(tmp_path / name / "out")).option("checkpointLocation", str(tmp_path / name / "state")).trigger(availableNow=True).start()
            q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(schema).parquet(str(tmp_path / name / "out")).collect())

    try:
        end = [(9, 10_000, 1)]
        batches = [[(1, 100, 5), (1, 130, 6)], [(1, 110, 7), (2, 140, 1)], [(1, 125, 5), (2, 120, 2)], end]
        rows = [r for b in batches for r in b]
        want = sorted(tuple(r) for r in st.signature_changes(spark.createDataFrame(rows, schema)).collect())
        assert run("late", batches, late="1 minute") == want != []
        # 40 comes 160 seconds late and is not there any more
        assert run("too-late", [[(1, 100, 5), (1, 200, 6)], [(1, 40, 9)], end], late="1 minute") == [(1, 200, 6)]
        # after 500 quiet seconds the last signature is gone, so 7 is the first again; without that limit it is a change
        quiet = [[(1, 100, 5)], [(3, 2000, 1)], [(1, 2100, 7)], end]
        assert run("quiet", quiet, late="1 minute", idle_s=500) == [] and run("kept", quiet, late="1 minute") == [(1, 2100, 7)]
    finally:
        spark.conf.set(STORE[0], was) if was else spark.conf.unset(STORE[0])


def test_error_fingerprints_mask_temporary_paths_only(spark):
    from lakelens.operators.state import error_fingerprint

    # fixed rows: equal letters are equal errors
    rows = [("A", "open /var/tmp/x1 failed"), ("A", "open /srv/my-cache/y/z failed"), ("A", "open \\a\\cache\\b failed"), ("B", "error 404"), ("C", "error 500"), ("D", "open /srv/data/x failed")]
    got = spark.createDataFrame(rows, "k string, m string").select("k", error_fingerprint(F.col("m")).alias("f")).collect()
    assert len({r.f for r in got}) == 4 and all((a.k == b.k) == (a.f == b.f) for a in got for b in got)


def test_leaders_of_many_blocks_meet(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.standard_normal(16)]) for i in range(600)]
    df = spark.createDataFrame([(i, [float(x / np.linalg.norm(v)) for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(3)
    one = {r.vec_id: r.cluster for r in cluster.global_clusters(df, 0.8).collect()}
    many = {r.vec_id: r.cluster for r in cluster.global_clusters(df, 0.8, block_rows=32).collect()}
    assert len(set(one.values())) == 6 and one == many


def test_lexical_counts_against_brute_force(spark):
    from lakelens.operators import retrieval

    texts = ["aaaa banana 红色气球", "AAA and bananana", "", None, "nothing here at all"]
    files = spark.createDataFrame([(i, f"name {i}", "p/aaa", t, t) for i, t in enumerate(texts)], "id long, name string, path string, text string, caption string")
    words = ["aaa", "ana", "nan", "红色气球", "name", "zz", "absent", "and ban", "a a", "ng h"]
    want = {}
    for w in words:
        for i, t in enumerate(texts):
            f = sum(k * x.lower().count(w) for k, x in ((7, f"name {i}"), (3, "p/aaa"), (1, t or ""), (3.5, t or "")))
            if f and len(w) >= 3:
                want[w, i] = f
    terms = spark.createDataFrame([(w,) for w in words], "alias string")
    for block in (2, 100):
        assert {(r.term, r.id): r.f for r in retrieval.occurrences(files, terms, block).collect()} == want


def test_sessions_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for lib, n, span in (("a", 400, 40 * cluster.DAY), ("b", 30, 90 * cluster.DAY), ("c", 1, 1), (None, 20, 3 * cluster.DAY)):
        for t in sorted(rng.integers(0, span, n).tolist()):
            lat = float(rng.choice([0.0, 31.0, 32.0]))
            rows.append((len(rows), lib, t, lat, 121.0 if lat else 0.0))  # the origin is no place
    rows += [(1000 + r[0], *r[1:]) for r in rows[:50]]  # equal times
    metres = lambda p, q: 6_371_000 * abs(np.radians(q - p))  # of one longitude
    want = {}
    for lib in ("a", "b", "c", None):
        own = sorted((r for r in rows if r[1] == lib), key=lambda r: (r[2], r[0]))
        run = part = 0
        was = start = None
        for i, _, t, lat, _ in own:
            if was is not None:
                gap = t - was[0]
                if gap > 12 * cluster.HOUR or gap > 2 * cluster.HOUR and lat and was[1] and metres(was[1], lat) > 80_000:
                    run, part, start = run + 1, 0, None
            if start is not None and t - start > 2 * cluster.DAY:
                part, start = part + 1, None
            start = t if start is None else start
            was = (t, lat)
            want[i] = run, part
    df = spark.createDataFrame(rows, "id long, library_id string, t long, latitude double, longitude double").repartition(5)
    got = {r.id: (r.run, r.part) for r in cluster.event_sessions(df, longest_s=2 * cluster.DAY).collect()}
    assert got == want and max(p for _, p in want.values()) > 0


def test_numbers_go_on_across_parts(spark):
    rows = [(b, (i * 37) % 50, i) for b in (1, 2, None) for i in range(200)]
    got = cluster.numbered(spark.createDataFrame(rows, "block int, size int, id int").repartition(7), "block", F.desc("size"), "id").collect()
    for b in (1, 2, None):
        own = sorted((r for r in got if r.block == b), key=lambda r: (-r["size"], r.id))
        assert [r.number for r in own] == list(range(1, 201))


def test_places_beyond_the_date_line_and_at_the_pole(spark):
    names = spark.createDataFrame([("west", 0.0, -179.9), ("pole", 89.9, 10.0), ("pole b", 89.9, 10.0)], "name string, lat double, lon double")
    centre = spark.createDataFrame([(0, 0, 0.0, 179.9), (1, 0, 89.9, -170.0), (2, 0, 50.0, 10.0)], "gy long, gx long, lat double, lon double")
    got = {r.gy: r.name for r in cluster.named_places(centre, names).collect()}
    assert got == {0: "west", 1: "pole", 2: "50.000, 10.000"}
    assert {r.name for r in cluster.named_places(centre, names.limit(0)).collect()} == {"0.000, 179.900", "89.900, -170.000", "50.000, 10.000"}


@pytest.mark.parametrize("block", [1, 7, 100])
def test_nearest_rows_against_brute_force(spark, block):
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties
    rows = [(i, i // 2, v.tolist()) for i, v in enumerate(vectors)] + [(60, 0, None), (61, 0, [1.0, None, 0.0, 0.0]), (62, 0, [1.0, float("nan"), 0.0, 0.0]), (63, 0, [1.0, 1.0]), (64, 0, [])]
    v = spark.createDataFrame(rows, "vec_id long, file_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(str(i), vectors[i].tolist()) for i in range(12)], "query_id string, qv array<double>")
    want = set()
    for i in range(12):
        scores = sorted(((float(vectors[i] @ x), k) for k, x in enumerate(vectors) if vectors[i] @ x >= 1), key=lambda s: (-s[0], s[1]))
        want |= {(str(i), k, k // 2, s) for s, k in scores[:5]}
    assert {tuple(r) for r in retrieval.knn(v, q, 5, 1.0, block).collect()} == want
    assert retrieval.knn(v.limit(0), q, 5).count() == 0 and retrieval.knn(v, q.limit(0), 5).count() == 0
    centre = spark.createDataFrame([(k, vectors[k].tolist()) for k in range(9)], "identity long, c array<double>")
    got = {(r.vec_id, r.identity, r.score) for r in nearest_centre(v, centre, block).collect()}
    assert got == {(i, *max(((k, float(x @ vectors[k])) for k in range(9)), key=lambda s: (s[1], -s[0]))) for i, x in enumerate(vectors)}


def test_folder_signatures_meet_only_what_changed(spark):
    old = {f"a/{i % 5}/{'deep/' * (i % 3)}f{i}": (i, 7) for i in range(40)} | {"top": (1, 1), "/abs/x": (2, 2), "a/f": (3, 3), "b/kept": (None, 4)}
    new = dict(old) | {"a/3/new": (5, 5), "top": (1, 2)}
    del new["a/1/deep/f1"]
    table = lambda d: spark.createDataFrame([(n, 1, p, s, m) for n, (p, (s, m)) in enumerate(d.items())] + [(99, 2, "z/same", 1, 1)], "id long, library_id long, path string, size long, mtime_s long")
    a, b = catalog.folder_signatures(table(old)), catalog.folder_signatures(table(new))
    n = {r.folder: r.n for r in b.filter("library_id = 1").collect()}
    folders = {"/".join(p.split("/")[:i]) for p in new for i in range(p.count("/") + 1)}
    assert n == {f: sum(f == "" or p.startswith(f + "/") for p in new) for f in folders}
    changed = {(r.library_id, r.folder): r.deepest for r in catalog.changed_folders(a, b).collect()}
    assert changed == {(1, ""): False, (1, "a"): False, (1, "a/3"): True, (1, "a/1"): False, (1, "a/1/deep"): True}
    got = catalog.changes_below(table(new), table(old), catalog.changed_folders(a, b)).collect()
    assert sorted((r.path, r.change) for r in got) == [("a/1/deep/f1", "delete"), ("a/3/new", "insert"), ("top", "update")]
    none = table(old).limit(0)
    assert catalog.folder_signatures(none).count() == 0 and catalog.changed_folders(a, a).count() == 0
    # a kept table and the signatures of a batch of further files combine
    more = catalog.folder_signatures(spark.createDataFrame([(1, 1, "a/9/x", 3, 3)], "id long, library_id long, path string, size long, mtime_s long"))
    F = catalog.F
    joined = a.unionByName(more).groupBy("library_id", "folder").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("hash").alias("hash"))
    assert catalog.changed_folders(joined, catalog.folder_signatures(table(old | {"a/9/x": (3, 3)}))).count() == 0


@pytest.mark.parametrize("few", [1000, 2])
def test_rules_against_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(catalog, "FEW_RULES", few)
    monkeypatch.setattr(catalog, "FEW_KEYS", few)
    kinds, exts = ("image", "video", None), ("jpg", "MP4", None)
    files = [(i, kinds[i % 3], exts[i % 2 if i % 7 else 2], i % 5, None if i == 11 else f"File_{i}.x" if i % 9 else "", i * 10) for i in range(60)]
    files += [(60, None, None, None, None, None), (61, "image", "jpg", 3, "File_1_1_1", None), (62, "video", "mp4", 2, "e_", -5), (62, "video", "mp4", 2, "e_", -5)]
    rules = {
        1: [], 2: [("kind", "image")], 3: [("extension", ".Jpg"), ("library_id", "3")], 4: [("library_id", "x")], 5: [("name_contains", "FILE_1")], 6: [("min_size", "100"), ("max_size", "300")], 7: [("kind", "image"), ("kind", "video")],
        8: [("extension", "mp4"), ("min_size", "200")], 9: [("kind", None)], 10: [("other", "1")], 11: [("name_contains", "e_")], 12: [("name_contains", "")], 13: [("name_contains", "_1"), ("name_contains", "5")], 14: [("max_size", "0")],
        15: [("min_size", "300"), ("max_size", "100")], 16: [("min_size", "x")], 17: [("name_contains", "_1_1_1")], 18: [("name_contains", "e_5"), ("max_size", "530")], 19: [("name_contains", "zzz"), ("min_size", "5")],
    }

    def holds(f, field, v):
        _, kind, ext, lib, name, size = f
        if v is None:
            return False
        return {
            "kind": kind == v, "extension": ext is not None and ext.lower() == v.lstrip(".").lower(), "library_id": v.isdigit() and lib == int(v), "name_contains": name is not None and v.lower() in name.lower(),
            "min_size": v.isdigit() and size is not None and size >= int(v), "max_size": v.isdigit() and size is not None and size <= int(v),
        }.get(field, False)

    want = {(r, f[0]) for r, cs in rules.items() for f in files if all(holds(f, *c) for c in cs)}
    df = spark.createDataFrame(files, "id long, kind string, extension string, library_id long, name string, size long")
    got = catalog.matches(df, spark.createDataFrame(list(rules.items()), "rule_id long, conditions array<struct<field: string, value: string>>")).collect()
    # rows that repeat are files of their own
    assert {tuple(r) for r in got} == want and len(got) == len(want) + sum(f == 62 for _, f in want)


def test_rules_meet_files_by_their_rarest_condition(spark):
    files = spark.range(200).selectExpr("id", "'image' AS kind", "'jpg' AS extension", "1L AS library_id", "concat('n', id) AS name", "id AS size")
    conditions = "array<struct<field: string, value: string>>"
    rule = spark.createDataFrame([(1, [("kind", "image"), ("name_contains", "n137")])], f"rule_id long, conditions {conditions}")
    ways = {r.way: r["keys"] for r in catalog.rule_options(rule).collect()}
    assert sorted(ways.values()) == sorted([["kind image"], ["name n13"], ["name 137"], [*(f"size {i}" for i in range(65)), "size none"]])
    joined = catalog.matches(files, rule)
    assert [tuple(r) for r in joined.collect()] == [(1, 137)] and "CartesianProduct" not in joined._jdf.queryExecution().executedPlan().toString()
    for empty in (catalog.matches(files.limit(0), rule), catalog.matches(files, rule.limit(0))):
        assert empty.count() == 0


def plain_leaders(rows, threshold):
    """The fold in id order: the cluster (its leader's place) of each vector."""
    leaders, sums, of = [], [], []
    for i, v in enumerate(rows):
        scores = [float(s @ v) / np.linalg.norm(s) for s in sums]
        best = max(range(len(scores)), key=lambda k: (scores[k], k), default=-1)
        if best < 0 or scores[best] < threshold:
            best = len(leaders)
            leaders.append(i)
            sums.append(np.zeros(len(v)))
        sums[best] = sums[best] + v
        of.append(leaders[best])
    return of


def test_leaders_in_epochs_are_those_of_one_pass(spark):
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    centres, person = unit(rng.standard_normal((40, 64))), rng.integers(0, 40, 1500)
    x = unit(centres[person] + rng.standard_normal((1500, 64)) / 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[0].tolist()), (5000, None)], "vec_id long, embedding array<double>").repartition(3)
    want = np.array(plain_leaders(x, 0.45))
    one = {r.vec_id: r.cluster for r in cluster.global_clusters(df).collect()}
    assert one == dict(enumerate(want.tolist()))
    many = {r.vec_id: r.cluster for r in cluster.global_clusters(df, block_rows=200).collect()}
    got = np.array([many[i] for i in range(1500)])
    pairs = np.triu_indices(1500, 1)
    assert len(many) == 1500 and ((got[pairs[0]] == got[pairs[1]]) == (want[pairs[0]] == want[pairs[1]])).mean() >= 0.99
    assert all(len(set(person[got == c])) <= max(len(set(person[want == w])) for w in set(want)) for c in set(got))
    # in pairs of one cluster, too
    both = ((got[pairs[0]] == got[pairs[1]]) & (want[pairs[0]] == want[pairs[1]])).sum()
    assert 2 * both >= 0.97 * ((got[pairs[0]] == got[pairs[1]]).sum() + (want[pairs[0]] == want[pairs[1]]).sum())
    assert cluster.global_clusters(df.limit(0)).count() == 0


def test_equally_near_clusters_give_the_later_one(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2**0.5 / 2] * 2), (4, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (1, 2, 100):
        assert {r.vec_id: r.cluster for r in cluster.global_clusters(df, 0.7, block_rows=block).collect()} == {1: 1, 2: 2, 3: 2, 4: 1}, block


INDEXED = "id long, name string, path string, caption string, text string"


def catalog_rows(n, seed):
    rng = np.random.default_rng(seed)
    words = ["alpha", "alphabet", "beta", "gamma.delta", "红色气球", "气球红色气球", "aaaa", "banana", "bananana", "über", "x", "ab", "happy", "birthday"]
    some = lambda k: " ".join(rng.choice(words, k)) if k else ""
    return [(i, some(2), "p/" + some(1), None if i % 5 == 0 else some(3), None if i % 7 == 0 else some(int(rng.integers(0, 30))) + rng.choice(["", "\n", "\thappy birthday"])) for i in range(n)]


def lexical_rows(files, queries, index=None):
    return sorted((r.query_id, r.batch, r.id, r.pos, r.score) for r in retrieval.lexical(files, queries, 30, 20, index).collect())


def test_search_by_the_index_is_search_by_texts(spark, tmp_path):
    from lakelens.operators.text_index import TextIndex

    first, second = catalog_rows(60, 1), catalog_rows(60, 2)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "lphab"), (3, "红色气球 banana"), (4, "ana nan"), (5, "生日 happy"), (6, "gamma.d zzz"), (7, "über"), (8, "absent"), (9, "")], "query_id long, query string")
    files = spark.createDataFrame(first, INDEXED).repartition(3)
    index = TextIndex(spark, str(tmp_path / "index"), retrieval.FIELDS)
    index.add(files, screenshot=retrieval.is_screenshot())
    want = lexical_rows(files, queries)
    assert lexical_rows(files, queries, index) == want and {q for q, *_ in want} >= {1, 2, 3, 4, 5, 6, 7}
    # files 0 to 9 change, 60 to 69 are new, 20 to 29 go
    rows = {r[0]: r for r in first} | {r[0]: r for r in second[:10]} | {60 + r[0]: (60 + r[0], *r[1:]) for r in second[:10]}
    batch = spark.createDataFrame([rows[i] for i in (*range(10), *range(60, 70))], INDEXED)
    index.add(batch, removed=spark.createDataFrame([(i,) for i in range(20, 30)], "id long"), screenshot=retrieval.is_screenshot())
    now = spark.createDataFrame([r for i, r in rows.items() if i not in range(20, 30)], INDEXED)
    want = lexical_rows(now, queries)
    assert lexical_rows(now, queries, index) == want
    merged = index.merged(str(tmp_path / "merged"))
    assert merged.segments() == [0] and index.segments() == [0, 1] and lexical_rows(now, queries, merged) == want
    profile = lambda of: sorted((r.query_id, r.id, r.coverage, r.exact, r.name_match, r.matched) for r in retrieval.profiles(queries.select("query_id").crossJoin(now.select("id")), now, queries, of).collect())
    assert profile(None) == profile(index) == profile(merged)


def test_search_by_the_index_reads_no_text(spark, tmp_path):
    from lakelens.operators.text_index import TextIndex

    files = spark.createDataFrame(catalog_rows(30, 3), INDEXED)
    index = TextIndex(spark, str(tmp_path / "index"), retrieval.FIELDS)
    index.add(files)
    blind = files.withColumn("text", F.raise_error(F.lit("a text was read")).cast("string"))
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "红色气球")], "query_id long, query string")
    assert lexical_rows(blind, queries, index) == lexical_rows(files, queries) != []
    # a segment that was not written to its end does not count
    (tmp_path / "index/done/0").rename(tmp_path / "index/half")
    assert index.segments() == []


def test_the_index_of_a_catalog_is_built_once(spark, sf):
    from lakelens.plans.views import view

    files = view(spark, sf, "files_v")
    a, b = retrieval.catalog_index(files), retrieval.catalog_index(files)
    assert a.path == b.path and a.segments() == [0]
    few = index_plan(a, spark)
    assert "PartitionFilters" in few and "bucket" in few


def index_plan(index, spark):
    """The plan of a lookup of one term."""
    df = index.occurrences(spark.createDataFrame([("the",)], "term string"))
    return df._jdf.queryExecution().executedPlan().toString()


def test_quantised_search_finds_the_nearest_among_few_candidates(spark, sf):
    from lakelens.operators import vector_index as vi
    from lakelens.plans.search_plans import clustered

    v = clustered(spark.read.parquet(f"{sf}/embeddings.parquet")).cache()
    q = v.filter("vec_id % 400 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    quantiser = vi.learned(v, 128)
    index = vi.indexed(v.repartition(5), quantiser)
    assert index.agg(F.sum("n")).first()[0] == v.count()
    got = {(r.query_id, r.vec_id) for r in vi.search(index, v, q, quantiser, 10, 4).collect()}
    want = {(r.query_id, r.vec_id) for r in retrieval.knn(v.withColumn("file_id", F.lit(0)), q, 10).collect()}
    share = vi.candidate_share(index, q, quantiser, 4).first()
    assert len(got & want) >= 0.9 * len(want) and share.share <= 0.05 and share.pairs > 0, (len(got & want) / len(want), share)
    # all cells and all candidates: the exact result
    exact = vi.search(index, v, q, quantiser, 10, 128, v.count())
    assert {(r.query_id, r.vec_id) for r in exact.collect()} == want
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan")] * 64), (None, [0.1] * 64), (5, [0.1] * 64)], "vec_id long, embedding array<double>")
    assert vi.indexed(odd, quantiser).agg(F.sum("n")).first()[0] == 1 and vi.indexed(odd.limit(0), quantiser).count() == 0
    assert vi.search(index, v, q.limit(0), quantiser, 10, 3).count() == 0


def test_inbox_holds_what_no_version_has(spark):
    files = spark.createDataFrame([(1, "a/inbox/x.txt", "txt"), (2, "a/inbox/y.ZIP", "ZIP"), (3, "a/archive/z.txt", "txt"), (4, "a/inbox/w.txt", "txt")], "id long, path string, extension string")
    held = spark.createDataFrame([(4,), (3,)], "file_id long")
    assert [r.id for r in catalog.inbox(files, held).collect()] == [1]


def test_libraries_of_admins_and_grants(spark):
    files = spark.createDataFrame([(i, i % 4 if i < 12 else None) for i in range(13)], "id long, library_id long")
    users = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "user_id long, admin int")
    grants = spark.createDataFrame([(2, 0, 0), (2, 1, 0), (2, 1, 0), (1, 3, 0), (3, 9, 0)], "user_id long, library_id long, admin int")
    got = sorted((r.user_id, r.id) for r in catalog.visible(files, users, grants).collect())
    assert got == sorted([(1, i) for i in range(12)] + [(2, i) for i in range(12) if i % 4 in (0, 1)])
    nobody = catalog.visible(files, users.limit(0), grants).collect()
    assert {r.user_id for r in nobody} == {1, 2} and all(r.id % 4 == 3 for r in nobody if r.user_id == 1)
