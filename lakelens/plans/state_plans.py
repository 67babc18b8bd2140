"""Index state, operations and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, quality, state as s
from .registry import query

NOW = 1_706_000_000
TNOW = 820_000_000

_KEYS = " UNION ALL ".join([f"SELECT '{x}.{v}' AS key, count(*) AS n FROM files_v WHERE {x}_status = '{v}'" for x in s.STAGES for v in s.STATUSES] + ["SELECT 'repairable', count(*) FROM files_v WHERE status IN ('partial', 'error') AND terminal_error = 0", "SELECT 'waiting', count(*) FROM files_v WHERE status IN ('partial', 'error') AND next_retry_s IS NOT NULL", "SELECT 'terminal', count(*) FROM files_v WHERE terminal_error = 1"])


@query("f1_stage_summary", f"SELECT key, n FROM ({_KEYS}) x WHERE n > 0")
def _(t):
    return s.stage_summary(t.files_v)


@query("f2_dashboard", "SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'error') AS error, count(*) FILTER (embedding_status = 'ready') AS semantic_ready, count(*) FILTER (length(trim(text)) > 0) AS content_ready FROM files_v")
def _(t):
    return s.dashboard(t.files_v)


@query("f2_kinds", "SELECT kind, count(*) AS n FROM files_v GROUP BY 1")
def _(t):
    return s.kinds(t.files_v)


for _name, _order in {"newest": "mtime_s DESC, id", "smallest": "size, id", "balanced": "CASE kind WHEN 'document' THEN 0 WHEN 'image' THEN 1 WHEN 'audio' THEN 2 WHEN 'video' THEN 3 ELSE 4 END, size, id"}.items():

    @query(f"f3_pending_{_name}", f"SELECT id, kind, size FROM files_v WHERE status = 'pending' ORDER BY {_order} LIMIT 60")
    def _(t, order=_name):
        return s.pending_queue(t.files_v, order, 60).select("id", "kind", "size")


@query("f4_pending_summary", "SELECT 'all' AS scope, 'all' AS name, count(*) AS n FROM files_v WHERE status = 'pending' UNION ALL SELECT 'kind', kind, count(*) FROM files_v WHERE status = 'pending' GROUP BY kind UNION ALL SELECT 'library', CAST(l.id AS STRING), count(f.id) FROM libraries_v l LEFT JOIN files_v f ON f.library_id = l.id AND f.status = 'pending' GROUP BY l.id")
def _(t):
    return s.pending_summary(t.files_v, t.libraries_v)


@query("f5_repair_queue", f"SELECT id, kind, size FROM files_v WHERE status IN ('partial', 'error') AND terminal_error = 0 AND coalesce(next_retry_s <= {NOW}, TRUE) ORDER BY manual_caption = '', CASE kind WHEN 'document' THEN 0 WHEN 'image' THEN 1 WHEN 'audio' THEN 2 WHEN 'video' THEN 3 ELSE 4 END, size, id LIMIT 40")
def _(t):
    return s.repair_queue(t.files_v, NOW, 40).select("id", "kind", "size")


@query("f6_retry_state", f"SELECT id, CASE WHEN status = 'error' THEN retry_count + 1 ELSE 0 END AS attempts, status = 'error' AND retry_count + 1 >= 6 AS terminal, CASE WHEN status = 'error' AND retry_count + 1 < 6 THEN {NOW} + CAST(least(604800.0, 60.0 * power(2.0, retry_count)) AS BIGINT) END AS due_s FROM files_v")
def _(t):
    return s.retry_state(t.files_v, F.col("status") == "error", NOW)


@query("f7_error_fingerprints", "SELECT sha256('cannot read <temporary> of ' || kind || ' ' || CAST(id % 9 AS STRING)) AS fp, count(*) AS n FROM files_v WHERE status = 'error' GROUP BY 1")
def _(t):
    msg = F.concat(F.when(F.col("id") % 2 == 0, "cannot read /data/tmp/job-").otherwise("cannot read \\srv\\my-cache\\"), "id", F.lit("/x of "), "kind", F.lit(" "), F.col("id") % 9)
    return t.files_v.filter("status = 'error'").groupBy(s.error_fingerprint(msg).alias("fp")).agg(F.count("*").alias("n"))


BAD = " OR ".join(f"{x}_status IN ('error', 'missing', 'blocked')" for x in s.STAGES)
WAIT = " OR ".join(f"{x}_status = 'pending'" for x in s.STAGES)


@query("f8_final_status", f"SELECT f.id, CASE WHEN {BAD} THEN 'partial' WHEN {WAIT} THEN 'pending' ELSE 'ready' END AS final, coalesce(n, 0) AS chunks FROM files_v f LEFT JOIN (SELECT file_id, count(*) AS n FROM vectors_v GROUP BY 1) v ON v.file_id = f.id")
def _(t):
    return s.final_status(t.files_v, t.vectors_v.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("chunks")))


@query("f9_overview", "SELECT count(*) AS total, count(*) FILTER (status = 'ready') AS ready, CASE WHEN (SELECT count(*) FROM tasks_v WHERE status = 'running') > 0 THEN 'running' WHEN count(*) FILTER (status = 'pending') > 0 THEN 'queued' ELSE 'complete' END AS state, round(100.0 * count(*) FILTER (status = 'ready') / count(*), 3) AS ready_pct FROM files_v")
def _(t):
    return s.overview(t.files_v, t.tasks_v.filter("status = 'running'"))


@query("f10_throughput", f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY finished_s DESC, id DESC) AS k FROM tasks_v WHERE status = 'completed' AND finished_s > started_s AND work_done > 0),
h AS (SELECT type, sum(work_done) / sum(finished_s - started_s) AS past FROM d WHERE k <= 20 GROUP BY 1),
r AS (SELECT type, CASE WHEN work_done >= 10 AND {TNOW} - started_s >= 60 THEN work_done / ({TNOW} - started_s) END AS now FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY started_s DESC, id DESC) AS k FROM tasks_v WHERE status = 'running') x WHERE k = 1),
l AS (SELECT type, CAST(sum(greatest(0, work_total - work_done)) AS BIGINT) AS remaining FROM tasks_v WHERE status IN ('pending', 'running') GROUP BY 1)
SELECT l.type, remaining, round(coalesce(now, past) * 60, 6) AS per_minute, CAST(ceil(remaining / coalesce(now, past)) AS BIGINT) AS eta_s FROM l LEFT JOIN h ON h.type = l.type LEFT JOIN r ON r.type = l.type""")
def _(t):
    return s.throughput(t.tasks_v, TNOW)


@query("f11_prunable", f"""
WITH e AS (SELECT id, finished_s FROM tasks_v WHERE status IN ('completed', 'failed', 'cancelled')),
y AS (SELECT *, row_number() OVER (ORDER BY finished_s DESC, id DESC) AS k FROM e WHERE finished_s >= {TNOW} - 300 * 86400)
SELECT id FROM e WHERE finished_s < {TNOW} - 300 * 86400 UNION ALL SELECT id FROM y WHERE k > 500""")
def _(t):
    return s.prunable(t.tasks_v, TNOW, 500, 300)


PROBLEMS = "SELECT coalesce(c.file_id, v.file_id) AS file_id, CASE WHEN v.n IS NULL THEN 'missing' WHEN c.n IS NULL THEN 'stale' ELSE 'mismatch' END AS problem FROM (SELECT conv_id AS file_id, count(*) AS n FROM messages_v GROUP BY 1) c FULL OUTER JOIN (SELECT file_id, count(*) AS n FROM vectors_v WHERE file_id % 2 = 0 GROUP BY 1) v ON c.file_id = v.file_id WHERE c.n IS DISTINCT FROM v.n"


def _problems(t):
    c = t.messages_v.groupBy(F.col("conv_id").alias("file_id")).agg(F.count("*").alias("n"))
    v = t.vectors_v.filter("file_id % 2 = 0").groupBy("file_id").agg(F.count("*").alias("n"))
    return s.consistency(c, v)


@query("f12_consistency", PROBLEMS)
def _(t):
    return _problems(t).select("file_id", "problem")


@query("f12_report", f"SELECT problem, count(*) AS n, string_agg(CASE WHEN k <= 5 THEN CAST(file_id AS STRING) END, ',' ORDER BY file_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY problem ORDER BY file_id) AS k FROM ({PROBLEMS}) x) y GROUP BY 1")
def _(t):
    return s.consistency_report(_problems(t), 5).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("f13_repair_plan", f"SELECT DISTINCT file_id, CASE problem WHEN 'stale' THEN 'delete' ELSE 'rebuild' END AS action FROM ({PROBLEMS}) x")
def _(t):
    return s.repair_plan(_problems(t))


@query("f14_upgrades", f"SELECT id FROM files_v WHERE kind = 'image' AND status IN ('ready', 'partial') AND caption <> '' AND id % 6 < 4 AND coalesce(next_retry_s <= {NOW}, TRUE) ORDER BY retry_count, mtime_s DESC, id LIMIT 30")
def _(t):
    f = t.files_v.withColumn("metadata_json", F.format_string('{"caption_version": %d}', F.col("id") % 6))
    return s.upgrade_candidates(f, NOW, 4, 30).select("id")


def _index(t):
    return t.files_v.filter("id % 3 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.lit("g0")).otherwise(F.lit("g1")).alias("generation"), F.when(F.col("id") % 4 == 0, "error").otherwise("ready").alias("state"), (F.col("id") % 8 == 0).alias("terminal"), F.lit(None).cast("long").alias("due_s"), (NOW - F.col("id") * 10).alias("updated_s"))


IDX = f"SELECT id, CASE WHEN id % 5 = 0 THEN 'g0' ELSE 'g1' END AS generation, CASE WHEN id % 4 = 0 THEN 'error' ELSE 'ready' END AS state, id % 8 = 0 AS terminal, {NOW} - id * 10 AS updated_s FROM files_v WHERE id % 3 <> 0"


@query("f15_media_coverage", f"WITH i AS ({IDX}), j AS (SELECT f.id, state, updated_s FROM files_v f LEFT JOIN i ON i.id = f.id AND i.generation = 'g1'), a AS (SELECT count(*) AS total, count(*) FILTER (state = 'ready') AS ready, count(*) FILTER (state = 'error') AS errors, count(*) FILTER (state IS NULL) AS pending, count(*) FILTER (state = 'ready' AND updated_s >= {NOW} - 3600) AS n, max(updated_s) FILTER (updated_s >= {NOW} - 3600) AS hi, min(updated_s) FILTER (updated_s >= {NOW} - 3600) AS lo FROM j) SELECT total, ready, errors, pending, round((n - 1) * 3600.0 / (hi - lo), 6) AS per_hour, CAST(ceil(pending * 3600 / ((n - 1) * 3600.0 / (hi - lo))) AS BIGINT) AS eta_s FROM a")
def _(t):
    return s.media_coverage(t.files_v.withColumn("generation", F.lit("g1")), _index(t), NOW)


@query("f16_next_batch", f"WITH i AS ({IDX}) SELECT f.id, f.kind FROM files_v f LEFT JOIN i ON i.id = f.id WHERE NOT coalesce(i.state = 'ready' AND i.generation = 'g1', FALSE) AND NOT coalesce(i.terminal, FALSE) ORDER BY mtime_s DESC, f.id LIMIT 50")
def _(t):
    return s.next_batch(t.files_v.withColumn("generation", F.lit("g1")), _index(t), NOW, "newest", 50).select("id", "kind")


@query("f16_orphans", "SELECT id FROM files_v WHERE id % 3 <> 0 AND id % 10 = 4")
def _(t):
    return s.orphans(_index(t), t.files_v.filter("id % 10 <> 4")).select("id")


@query("f17_active_unique", "SELECT id, type, library_id FROM (SELECT *, row_number() OVER (PARTITION BY type, library_id, work_total % 7 ORDER BY priority DESC, id) AS k FROM tasks_v WHERE status IN ('pending', 'running')) x WHERE k = 1")
def _(t):
    ids = F.shuffle(F.array(F.col("work_total") % 7, F.lit(99).cast("long")))
    return s.active_unique(t.tasks_v.withColumn("file_ids", ids)).select("id", "type", "library_id")


@query("f18_task_stats", "SELECT status, count(*) AS n FROM tasks_v GROUP BY 1")
def _(t):
    return s.counts_by(t.tasks_v, "status")


@query("f18_feedback", "SELECT verdict, count(*) AS n FROM feedback_v GROUP BY 1")
def _(t):
    return s.counts_by(t.feedback_v, "verdict")


@query("f19_trashed", "SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM files_v WHERE id % 9 = 0")
def _(t):
    return s.trashed(t.files_v.withColumn("status", F.when(F.col("id") % 9 == 0, "trashed").otherwise("restored")))


CHECKED = "SELECT a.id AS asset_id, f.id AS file_id, f.status, f.kind, f.size, f.width, f.height, f.caption, c.n AS open_comments FROM assets_v a LEFT JOIN files_v f ON f.id = a.cover_version_id // 10 % 1000 LEFT JOIN (SELECT asset_id, count(*) AS n FROM comments_v WHERE resolved = 0 GROUP BY 1) c ON c.asset_id = a.id"


def _checks(t):
    f = t.files_v.select(F.col("id").alias("file_id"), "status", "kind", "size", "width", "height", "caption")
    c = t.comments_v.filter("resolved = 0").groupBy("asset_id").agg(F.count("*").alias("open_comments"))
    a = t.assets_v.select(F.col("id").alias("asset_id"), F.expr("cover_version_id div 10 % 1000").alias("file_id"))
    return s.asset_checks(a.join(f.withColumnRenamed("file_id", "fid"), F.col("file_id") == F.col("fid"), "left").drop("file_id").withColumnRenamed("fid", "file_id").join(c, "asset_id", "left"))


@query("f23_asset_verdicts", f"SELECT asset_id, file_id IS NOT NULL AND coalesce(status, '') = 'ready' AND (coalesce(kind <> 'video', FALSE) OR coalesce(size, 0) > 0) AS passed, CAST((NOT coalesce(kind <> 'audio', FALSE)) AS INT) + CAST((NOT coalesce(width >= 1280 AND height >= 720, FALSE)) AS INT) + CAST((NOT coalesce(caption <> '', FALSE)) AS INT) + CAST(coalesce(open_comments, 0) > 0 AS INT) AS warnings FROM ({CHECKED}) x")
def _(t):
    return s.asset_verdicts(_checks(t)).withColumn("warnings", F.col("warnings").cast("int"))


@query("f24_readiness", "SELECT CASE WHEN (SELECT count(*) FROM files_v WHERE terminal_error = 1) > 100000000 THEN 'not_ready' WHEN (SELECT count(*) FROM files_v WHERE status = 'error') > 0 OR (SELECT count(*) FROM files_v WHERE embedding_status = 'error') > 0 THEN 'degraded' ELSE 'healthy' END AS state, CAST((SELECT count(*) FROM files_v WHERE status = 'error') > 0 AS BIGINT) + CAST((SELECT count(*) FROM files_v WHERE embedding_status = 'error') > 0 AS BIGINT) AS failing")
def _(t):
    rule = lambda name, critical, cond, most: t.files_v.agg((F.count_if(cond) <= most).alias("ok")).select(F.lit(name).alias("rule"), F.lit(critical).alias("critical"), "ok")
    rules = rule("terminal", True, F.col("terminal_error") == 1, 100_000_000).union(rule("errors", False, F.col("status") == "error", 0)).union(rule("vectors", False, F.col("embedding_status") == "error", 0))
    return s.readiness(rules)


@query("f25_stale", "SELECT id, id % 5 = 4 OR id % 1000 > 180 AS stale FROM files_v")
def _(t):
    now = F.timestamp_seconds(F.lit(NOW))
    at = F.when(F.col("id") % 5 == 4, "never").otherwise(F.date_format(F.timestamp_seconds(NOW - F.col("id") % 1000), "yyyy-MM-dd HH:mm:ss"))
    return t.files_v.select("id", s.stale(at, now, 180).alias("stale"))


@query("f26_history", "SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_s DESC, id DESC) AS k FROM tasks_v) x WHERE k <= 5")
def _(t):
    return s.task_history(t.tasks_v, 5).select("user_id", "id")


@query("f26_active_for_file", "SELECT file_id, id FROM (SELECT f.id AS file_id, t.id, row_number() OVER (PARTITION BY f.id ORDER BY priority DESC, t.id) AS k FROM tasks_v t JOIN files_v f ON f.id = t.id % 500 OR f.id = t.id % 300 WHERE t.status IN ('pending', 'running')) x WHERE k = 1")
def _(t):
    tasks = t.tasks_v.withColumn("payload_json", F.to_json(F.struct(F.array(F.col("id") % 500, F.col("id") % 300).alias("file_ids"))))
    return s.active_for_file(tasks, t.files_v)


@query("f27_recovered", "SELECT id, priority, CASE status WHEN 'cancel_requested' THEN 'cancelled' WHEN 'running' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'running' THEN 0 ELSE work_done END AS work_done FROM tasks_v")
def _(t):
    return s.recovered(t.tasks_v)


TIMES = "SELECT l_orderkey % 200 AS batch, l_partkey AS item, CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'model' ELSE 'write' END AS stage, l_quantity AS seconds, l_suppkey AS bytes FROM lineitem"


@query("f28_profile", f"SELECT batch, count(DISTINCT item) AS processed, CAST(sum(bytes) AS BIGINT) AS bytes, round(avg(seconds) FILTER (stage = 'read'), 6) AS read, round(avg(seconds) FILTER (stage = 'model'), 6) AS model, round(avg(seconds) FILTER (stage = 'write'), 6) AS write, round(count(DISTINCT item) * 3600 / sum(seconds), 6) AS per_hour FROM ({TIMES}) x GROUP BY 1")
def _(t):
    k = F.col("l_linenumber") % 3
    x = t.lineitem.select((F.col("l_orderkey") % 200).alias("batch"), F.col("l_partkey").alias("item"), F.when(k == 0, "read").when(k == 1, "model").otherwise("write").alias("stage"), F.col("l_quantity").alias("seconds"), F.col("l_suppkey").alias("bytes"))
    return s.runtime_profile(x, ["read", "model", "write"])


@query("f28_percentiles", f"SELECT batch // 20 AS hour, stage, count(*) AS n, round(quantile_cont(CAST(seconds AS DOUBLE) + bytes / 1000.0, 0.5), 6) AS p50, round(quantile_cont(CAST(seconds AS DOUBLE) + bytes / 1000.0, 0.95), 6) AS p95, round(quantile_cont(CAST(seconds AS DOUBLE) + bytes / 1000.0, 0.99), 6) AS p99 FROM ({TIMES}) x GROUP BY 1, 2")
def _(t):
    """Percentiles of stages over windows of twenty batches, from the sketches kept for each batch."""
    k = F.col("l_linenumber") % 3
    batch = (F.col("l_orderkey") % 200).alias("batch")
    x = t.lineitem.select(batch, F.when(k == 0, "read").when(k == 1, "model").otherwise("write").alias("stage"), (F.col("l_quantity").cast("double") + F.col("l_suppkey") / 1000.0).alias("seconds"))
    hour = F.floor(F.col("batch") / 20).alias("hour")
    kept = quality.sketches(x, ["batch", "stage"], "seconds").select(hour, "stage", "sketch")
    out = quality.percentiles(x.select(hour, "stage", "seconds"), ["hour", "stage"], "seconds", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, kept)
    return out.select("hour", "stage", "n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


RES = "SELECT user_id AS query_id, event_type || '-' || CAST(event_id % 7 AS STRING) AS name, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, value / 1000 AS confidence FROM events"
CASES = "SELECT DISTINCT user_id AS query_id, ['click-' || CAST(user_id % 7 AS STRING), 'VIEW-1'] AS expected, ['error'] AS forbidden FROM events"
EVAL = f"""
WITH r AS (SELECT * FROM ({RES}) a WHERE rank <= 8), c AS ({CASES}),
x AS (SELECT c.query_id, expected, rank, confidence, list_filter(expected, lambda e: contains(lower(name), lower(e))) AS hit, contains(name, 'error') AND rank = 1 AS bad FROM c LEFT JOIN r ON r.query_id = c.query_id),
g AS (SELECT query_id, min(CASE WHEN len(hit) > 0 THEN rank END) AS first_rank, len(list_distinct(flatten(list(hit)))) AS found, bool_or(bad) AS forbidden_first FROM x GROUP BY 1),
e AS (SELECT query_id, first_rank, round(found / 2.0, 6) AS recall, round(coalesce(1.0 / first_rank, 0.0), 6) AS rr, forbidden_first, first_rank IS NOT NULL AND NOT forbidden_first AS passed FROM g)"""


def _eval(t):
    from pyspark.sql import Window

    r = t.events.select(F.col("user_id").alias("query_id"), F.concat("event_type", F.lit("-"), (F.col("event_id") % 7).cast("string")).alias("name"), F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"), (F.col("value") / 1000).alias("confidence"))
    c = t.events.select(F.col("user_id").alias("query_id")).distinct().select("query_id", F.array(F.concat(F.lit("click-"), (F.col("query_id") % 7).cast("string")), F.lit("VIEW-1")).alias("expected"), F.array(F.lit("error")).alias("forbidden"))
    return quality.search_evaluation(r, c, 8)


@query("f20_search_evaluation", EVAL + " SELECT query_id, CAST(first_rank AS INT) AS first_rank, recall, rr, forbidden_first, passed FROM e")
def _(t):
    return _eval(t)


@query("f21_answer_evaluation", "SELECT doc_id AS id, doc_id % 3 <> 0 AS source_hit, doc_id % 4 <> 3 AS enough, round((CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'zebra') AS INT)) / 2.0, 6) AS coverage, doc_id % 5 <> 1 AS valid_citations, doc_id % 3 <> 0 AND doc_id % 4 <> 3 AND contains(lower(text), 'the') AND doc_id % 5 <> 1 AS passed FROM documents")
def _(t):
    i = F.col("doc_id")
    a = t.documents.select(
        i.alias("id"), F.concat(F.when(i % 5 == 1, "see [9] ").otherwise("see [1] "), "text").alias("answer"), F.when(i % 4 == 3, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("sources"),
        F.when(i % 3 == 0, F.array(F.lit("z"))).otherwise(F.array(F.lit("a"))).alias("expected_sources"), F.array(F.lit("The"), F.lit("zebra")).alias("terms"), F.lit(2).alias("least_sources"),
    )
    return quality.answer_evaluation(a)


@query("f22_gate", EVAL + " SELECT round(count(*) FILTER (passed) / count(*), 6) AS pass_rate, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, (SELECT round(quantile_cont(value, 0.5), 6) FROM events) AS p50, (SELECT round(quantile_cont(value, 0.95), 6) FROM events) AS p95, count(*) FILTER (passed) / count(*) >= 0.8 AND avg(recall) >= 0.8 AND avg(rr) >= 0.6 AND (SELECT quantile_cont(value, 0.95) FROM events) <= 15 AS ok FROM e")
def _(t):
    return quality.gate(_eval(t), t.events.select(F.col("value").alias("seconds")))


@query("f24_catalog_state", "SELECT kind, status, count(*) AS total FROM files_v GROUP BY 1, 2")
def _(t):
    return catalog.listing(t.files_v).groupBy("kind", "status").agg(F.count("*").alias("total"))
