"""Streaming operators over the events table: as tables with SQL, and as streams over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.session import shared_dir
from ..streaming import operators as s
from ..streaming.ordered import closed
from .registry import SQL, query

T = "@epoch(ts)"


def _stream(t):
    """The events file as a stream of one run."""
    schema = t.events.schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/event[s].parquet")


def _run(t, stream):
    return s.run_available(stream, f"{shared_dir(t.spark)}/lakelens/stream-{uuid.uuid4().hex}")


def _ended(t, rows):
    """The stream with its end, so that its last rows come out too."""
    return closed(rows, f"{shared_dir(t.spark)}/lakelens/tick-{uuid.uuid4().hex}")


def _watch(e):
    return e.select((F.col("user_id") % 10).alias("library_id"), F.col("ts").cast("timestamp").alias("ts"))


@query("s1_debounced", f"WITH e AS (SELECT user_id % 10 AS library_id, ts, lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts) AS p FROM events), c AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 5 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY library_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT library_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first_s, CAST(floor(epoch(max(ts) + INTERVAL 5 SECOND)) AS BIGINT) AS due_s, count(*) AS n FROM c GROUP BY library_id, s")
def _(t):
    return s.debounced(_watch(t.events)).select("library_id", F.unix_timestamp("first").alias("first_s"), F.unix_timestamp("due").alias("due_s"), "n")


@query("s2_signature_changes", f"SELECT library_id, t, signature FROM (SELECT *, lag(signature) OVER (PARTITION BY library_id ORDER BY t) AS was FROM (SELECT user_id % 10 AS library_id, event_id AS t, event_id // 37 % 3 AS signature FROM events) a) b WHERE was <> signature")
def _(t):
    return s.signature_changes(t.events.selectExpr("user_id % 10 AS library_id", "event_id AS t", "event_id div 37 % 3 AS signature"))


@query("s2_signature_changes_stream", SQL["s2_signature_changes"], raw=True)
def _(t):
    rows = _stream(t).selectExpr("user_id % 10 AS library_id", "event_id AS t", "event_id div 37 % 3 AS signature")
    return _run(t, s.signature_changes_stream(_ended(t, rows)))


_RULES = [(1, 1, 1, [("kind", "image")]), (2, 2, 1, [("min_size", "3000")]), (3, 3, 0, []), (4, 4, 1, [("extension", "txt")])]


@query("s3_arrivals", "SELECT rule_id, count(*) AS n, min(id) AS first, max(id) AS last FROM (SELECT 1 AS rule_id, id, library_id FROM files_v WHERE kind = 'image' UNION ALL SELECT 2, id, library_id FROM files_v WHERE size >= 3000 UNION ALL SELECT 4, id, library_id FROM files_v WHERE extension = 'txt') x WHERE (rule_id, library_id) IN (SELECT user_id, library_id FROM grants_v WHERE user_id <> 4) GROUP BY 1")
def _(t):
    rules = t.spark.createDataFrame(_RULES, "rule_id int, owner_id long, enabled int, conditions array<struct<field:string,value:string>>")
    owners = t.grants_v.select(F.col("user_id").alias("owner_id"), "library_id", F.when(F.col("user_id") == 4, 0).otherwise(1).alias("enabled")).distinct()
    out = s.arrival_runs(t.files_v, rules, owners)
    return out.select("rule_id", F.size("file_ids").cast("long").alias("n"), F.element_at("file_ids", 1).alias("first"), F.element_at("file_ids", -1).alias("last"))


@query("s4_due", "SELECT DISTINCT r.rule_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute_key FROM events JOIN (SELECT * FROM (VALUES (1, 9, 0, NULL), (2, 10, 30, 2), (3, 23, 59, NULL)) v(rule_id, h, m, wd)) r ON hour(ts) = h AND minute(ts) = m AND (wd IS NULL OR isodow(ts) - 1 = wd)")
def _(t):
    rules = t.spark.createDataFrame([(1, 9, 0, None), (2, 10, 30, 2), (3, 23, 59, None)], "rule_id int, hour int, minute int, weekday int")
    return s.due_runs(t.events.select(F.col("ts").cast("timestamp").alias("ts")), rules)


RESULTS = "SELECT user_id AS key, event_id AS t, event_type = 'purchase' AS ok FROM events"
RETRY = f"WITH a AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY key ORDER BY t) AS run FROM ({RESULTS}) x), b AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY key, run ORDER BY t) AS INT) AS attempts FROM a) SELECT key, t, attempts, attempts >= 6 AS terminal, CASE WHEN ok OR attempts >= 6 THEN 0.0 ELSE least(604800.0, 60.0 * power(2.0, attempts - 1)) END AS wait_s FROM b"


def _results(e):
    return e.select(F.col("user_id").cast("long").alias("key"), F.col("event_id").alias("t"), (F.col("event_type") == "purchase").alias("ok"))


@query("s5_retries", RETRY)
def _(t):
    return s.retries(_results(t.events))


@query("s5_retries_stream", RETRY)
def _(t):
    return _run(t, s.retries_stream(_ended(t, _results(_stream(t)))))


@query("s6_rate_limits", f"""
WITH a AS (SELECT event_id AS id, user_id % 20 AS client, user_id % 30 AS account, {T} AS t FROM events),
b AS (SELECT *, count(*) OVER p AS n1, min(t) OVER p AS f1, count(*) OVER c AS n2, min(t) OVER c AS f2, count(*) OVER k AS n3, min(t) OVER k AS f3 FROM a WINDOW p AS (PARTITION BY client, account ORDER BY t RANGE BETWEEN 899 PRECEDING AND CURRENT ROW), c AS (PARTITION BY client ORDER BY t RANGE BETWEEN 899 PRECEDING AND CURRENT ROW), k AS (PARTITION BY account ORDER BY t RANGE BETWEEN 899 PRECEDING AND CURRENT ROW))
SELECT id, n1 > 2 OR n2 > 2 OR n3 > 3 AS blocked, CAST(greatest(0, CASE WHEN n1 > 2 THEN f1 + 900 - t ELSE 0 END, CASE WHEN n2 > 2 THEN f2 + 900 - t ELSE 0 END, CASE WHEN n3 > 3 THEN f3 + 900 - t ELSE 0 END) AS BIGINT) AS retry_after_s FROM b""")
def _(t):
    a = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("client"), (F.col("user_id") % 30).alias("account"), F.unix_timestamp("ts").alias("t"))
    return s.rate_limits(a, {"pair": (["client", "account"], 2), "client": (["client"], 2), "account": (["account"], 3)})


def _requests(e):
    return e.select((F.col("user_id") % 6).cast("long").alias("job"), F.col("event_id").alias("t"), (F.col("event_id") % 50 == 0).alias("queue_empty"))


# the next recompute after each row: the first at least 40 later or with an empty queue
THROTTLED = """
WITH RECURSIVE r AS (SELECT CAST(user_id % 6 AS BIGINT) AS job, event_id AS t, event_id % 50 = 0 AS empty FROM events),
n AS (SELECT job, t, least(min(t) OVER (PARTITION BY job ORDER BY t RANGE BETWEEN 40 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN empty THEN t END) OVER (PARTITION BY job ORDER BY t RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS next FROM r),
f(job, t) AS (SELECT job, min(t) FROM r GROUP BY 1 UNION ALL SELECT n.job, n.next FROM f JOIN n ON n.job = f.job AND n.t = f.t WHERE n.next IS NOT NULL)
SELECT job, t FROM f"""


@query("s7_throttled", THROTTLED)
def _(t):
    return s.throttled(_requests(t.events), 40)


@query("s7_throttled_stream", THROTTLED)
def _(t):
    return _run(t, s.throttled_stream(_ended(t, _requests(_stream(t))), 40))


@query("s8_liveness", f"SELECT user_id AS worker, max({T}) AS last_t, 1706500000 - max({T}) < 90000 AS alive FROM events GROUP BY 1")
def _(t):
    return s.liveness(t.events.select(F.col("user_id").alias("worker"), F.unix_timestamp("ts").alias("t")), 1_706_500_000, 90_000)


OUTBOX = "SELECT concat(event_type, '-', CAST(user_id AS STRING)) AS event_key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events) x WHERE k = 1"


def _keyed(e):
    return e.select(F.concat("event_type", F.lit("-"), F.col("user_id").cast("string")).alias("event_key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


@query("s9_outbox", OUTBOX)
def _(t):
    return s.outbox(_keyed(t.events)).select("event_key", "event_id")


@query("s9_outbox_stream", "SELECT DISTINCT concat(event_type, '-', CAST(user_id AS STRING)) AS event_key FROM events")
def _(t):
    return _run(t, s.outbox(_keyed(_stream(t)), "400 days").select("event_key"))


@query("s9_delivery", "SELECT event_id, CASE WHEN event_id % 10 >= 8 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN event_id % 10 < 8 THEN least(3600.0, 30 * power(2.0, least(event_id % 10, 7))) END AS wait_s FROM events")
def _(t):
    state, wait = s.delivery(F.col("event_id") % 10)
    return t.events.select("event_id", state.alias("state"), wait.alias("wait_s"))


@query("s10_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1")
def _(t):
    return s.latest(t.events, "user_id", "ts", "event_id").select("user_id", "event_id")


@query("s11_upsert", "SELECT f.path, f.size, CASE WHEN c.path IS NULL OR c.size <> f.size OR c.mtime_s <> f.mtime_s THEN 'pending' ELSE 'kept' END AS stage FROM files_v f LEFT JOIN catalog_v c ON c.path = f.path")
def _(t):
    groups = t.files_v.select((F.col("id") % 100).alias("group_id"), "id")
    return s.batch_upsert(t.files_v, t.catalog_v, groups)[0].select("path", "size", "stage")


@query("s11_groups", "WITH x AS (SELECT id, id % 100 AS g FROM files_v WHERE id % 10 NOT IN (1, 2) AND id % 25 <> 3) SELECT g AS group_id, id FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)")
def _(t):
    groups = t.files_v.filter("id % 25 <> 3").select((F.col("id") % 100).alias("group_id"), "id")
    return s.batch_upsert(t.files_v, t.catalog_v, groups)[1].select("group_id", "id")


@query("s11_upsert_stream", "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) x WHERE k = 1) SELECT concat('u', CAST(user_id AS STRING)) AS path, event_id AS size FROM l")
def _(t):
    """The newest scan row of each path, late rows of one micro-batch included, through snapshots."""
    at = f"{shared_dir(t.spark)}/lakelens/upsert-{uuid.uuid4().hex}"
    rows = _stream(t).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), (F.col("user_id") % 10).alias("library_id"), F.col("event_id").alias("size"), F.col("event_id").alias("mtime_s"))
    q = rows.writeStream.foreachBatch(s.catalog_upsert(f"{at}/catalog")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{at}/catalog/{s.finished(t.spark, f'{at}/catalog')[-1]}").select("path", "size")
