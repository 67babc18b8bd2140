"""Catalog views over the driver tables, written once for Spark SQL and DuckDB.

``@epoch(x)`` is seconds since 1970 of a timestamp and ``@ts(x)`` the timestamp
of such seconds; every other word means the same in both dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    # one row a file: identity, size, times, text, stage states, retry state
    "files_v": """
SELECT d.doc_id AS id, CAST(substr(d.source, 4) AS BIGINT) AS library_id,
  CASE d.doc_id % 4 WHEN 0 THEN 'document' WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE 'audio' END AS kind,
  CASE d.doc_id % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'jpg' WHEN 2 THEN 'mp4' ELSE 'mp3' END AS extension,
  concat('doc_', CAST(d.doc_id AS STRING), CASE WHEN d.doc_id % 7 = 3 THEN ' copy' ELSE '' END, CASE d.doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.jpg' WHEN 2 THEN '.mp4' ELSE '.mp3' END) AS name,
  concat(d.source, '/', CASE d.doc_id % 3 WHEN 0 THEN 'inbox/' ELSE 'archive/' END, 'doc_', CAST(d.doc_id AS STRING)) AS path,
  d.n_chars AS size, 1704067200 + d.doc_id * 3600 AS mtime_s,
  CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE 1704067200 + d.doc_id * 3600 - 86400 * (d.doc_id % 400) END AS captured_s,
  d.text AS text, split_part(d.text, chr(10), 1) AS caption, CASE WHEN d.doc_id % 9 = 0 THEN concat('note ', CAST(d.doc_id AS STRING)) ELSE '' END AS manual_caption,
  md5(concat(CAST(d.n_chars AS STRING), '|', substr(d.text, 1, 1000), '|', right(d.text, 1000))) AS quick_hash, md5(d.text) AS content_hash,
  640 + (d.doc_id * 37) % 2000 AS width, 480 + (d.doc_id * 53) % 1500 AS height,
  CASE WHEN l.quality IS NULL THEN 'pending' WHEN l.quality = 0 THEN 'error' WHEN l.toxic = 1 THEN 'partial' ELSE 'ready' END AS status,
  CASE d.doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'ready' WHEN 2 THEN 'error' WHEN 3 THEN 'blocked' ELSE 'missing' END AS vision_status,
  CASE d.doc_id % 6 WHEN 0 THEN 'not_needed' WHEN 1 THEN 'pending' WHEN 2 THEN 'error' ELSE 'ready' END AS transcription_status,
  CASE d.doc_id % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'pending' WHEN 2 THEN 'ready' ELSE 'error' END AS embedding_status,
  d.doc_id % 6 AS retry_count, CASE WHEN d.doc_id % 6 = 5 THEN 1 ELSE 0 END AS terminal_error,
  CASE WHEN d.doc_id % 6 BETWEEN 1 AND 4 THEN 1704067200 + d.doc_id * 1800 ELSE NULL END AS next_retry_s, d.lang AS lang
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    # the catalog before the scan of files_v: some files are missing, some have another size, some are gone since
    "catalog_v": """
SELECT id, library_id, path, CASE WHEN id % 10 = 1 THEN size + 1 ELSE size END AS size, CASE WHEN id % 10 = 2 THEN mtime_s - 5 ELSE mtime_s END AS mtime_s FROM files_v WHERE id % 10 <> 0
UNION ALL SELECT 1000000000 + id AS id, library_id, concat(path, '.gone') AS path, size, mtime_s FROM files_v WHERE id % 25 = 3""",
    "libraries_v": "SELECT DISTINCT library_id AS id, concat('library ', CAST(library_id AS STRING)) AS name, CASE WHEN library_id % 7 = 6 THEN 0 ELSE 1 END AS enabled FROM (SELECT CAST(substr(source, 4) AS BIGINT) AS library_id FROM documents UNION ALL SELECT 900 FROM region) x",
    # media with coordinates and times
    "media_v": """
SELECT event_id AS id, user_id % 10 AS library_id, user_id, @epoch(ts) AS t, event_type AS type,
  CASE WHEN event_type = 'error' THEN 0e0 ELSE 31e0 + (user_id % 40) * 1e-2 + (event_id % 3) * 1e-3 END AS latitude,
  CASE WHEN event_type = 'error' THEN 0e0 ELSE 121e0 + (user_id % 60) * 1e-2 + (event_id % 5) * 1e-3 END AS longitude,
  640 + event_id % 2000 AS width, 480 + event_id % 1500 AS height FROM events""",
    "vectors_v": "SELECT vec_id, vec_id // 4 AS file_id, vec_id % 4 AS chunk_index, embedding, label, 1704067200 + (vec_id // 4) * 3600 - CASE WHEN vec_id % 11 = 0 THEN 60 ELSE 0 END AS mtime_s FROM embeddings",
    "feedback_v": "SELECT event_id AS id, user_id, event_id % 1000 AS file_id, user_id % 40 AS query_id, CASE WHEN event_type = 'click' THEN 'relevant' WHEN event_type = 'error' THEN 'irrelevant' ELSE 'other' END AS verdict, @epoch(ts) AS t FROM events WHERE event_type IN ('click', 'error', 'view')",
    "tasks_v": """
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'index' WHEN 1 THEN 'scan' WHEN 2 THEN 'caption' ELSE 'dedup' END AS type,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'cancel_requested' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
  CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_custkey % 20 AS library_id, o_custkey % 50 AS user_id,
  @epoch(o_orderdate) AS created_s, @epoch(o_orderdate) + 60 AS started_s, @epoch(o_orderdate) + 60 + o_orderkey % 900 AS finished_s,
  CAST(floor(o_totalprice) AS BIGINT) % 500 AS work_total, CAST(floor(o_totalprice) AS BIGINT) % 400 AS work_done FROM orders""",
    "projects_v": "SELECT c_custkey AS id, c_name AS name, c_nationkey % 50 AS owner_id, c_mktsegment AS segment, 1600000000 + c_custkey * 60 AS updated_s FROM customer",
    "members_v": "SELECT c.c_custkey AS project_id, n.n_nationkey AS user_id, n.n_name AS user_name, CASE n.n_nationkey % 3 WHEN 0 THEN 'viewer' WHEN 1 THEN 'editor' ELSE 'manager' END AS role FROM customer c JOIN nation n ON (c.c_custkey + n.n_nationkey) % 6 = 0",
    "assets_v": "SELECT o_orderkey AS id, o_custkey AS project_id, concat('asset ', CAST(o_orderkey AS STRING)) AS title, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 7 END AS folder_id, CASE o_orderkey % 6 WHEN 0 THEN 'todo' WHEN 1 THEN 'doing' WHEN 2 THEN 'done' ELSE 'unknown' END AS status_name, o_orderkey % 25 AS assignee_id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey * 10 + 1 ELSE NULL END AS cover_version_id, @epoch(o_orderdate) AS updated_s FROM orders",
    "versions_v": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS asset_id, (l_partkey * 7 + l_suppkey) % 1000 AS file_id, @epoch(l_shipdate) AS created_s, l_returnflag AS scope FROM lineitem",
    "comments_v": "SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS asset_id, l_suppkey % 25 AS author_id, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS resolved, CASE WHEN l_returnflag = 'A' THEN 'external' ELSE 'internal' END AS visibility, l_linenumber * 15e-1 AS t, concat('note on ', CAST(l_partkey AS STRING)) AS body, @epoch(l_shipdate) AS created_s, l_suppkey % 4 AS session_id FROM lineitem",
    "queries_v": "SELECT item_id AS query_id, lower(text) AS query FROM benchmark",
    "messages_v": "SELECT conv_id, turn, role, text FROM conversations",
    "grants_v": "SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_name AS user_name, r_regionkey AS region, CAST(n_nationkey * 3 % 20 AS BIGINT) AS library_id, CASE WHEN n_nationkey % 8 = 0 THEN 1 ELSE 0 END AS admin FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, n_regionkey, CAST(n_nationkey * 7 % 20 AS BIGINT), CASE WHEN n_nationkey % 8 = 0 THEN 1 ELSE 0 END FROM nation WHERE n_nationkey % 3 <> 0",
    "spaces_v": "SELECT s_suppkey AS id, s_name AS name, s_nationkey AS owner_id, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 200 ELSE NULL END AS project_id FROM supplier",
    "space_files_v": "SELECT DISTINCT l_suppkey AS space_id, l_partkey % 1000 AS file_id FROM lineitem",
    "artifacts_v": "SELECT p_partkey AS id, p_name AS title, p_partkey % 25 AS owner_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 10 ELSE NULL END AS space_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 200 ELSE NULL END AS project_id, p_size AS size FROM part",
    "tags_v": "SELECT DISTINCT p_partkey % 1000 AS file_id, p_brand AS tag FROM part UNION SELECT l_partkey % 1000, l_returnflag FROM lineitem WHERE l_linenumber = 1",
}


def _needed(sql: str) -> list[str]:
    """Views that the text names, each after those it needs."""
    out: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql) and name not in out:
            for x in [*_needed(VIEWS[name]), name]:
                if x not in out:
                    out.append(x)
    return out


def _macro(sql: str, name: str, form: str) -> str:
    while (at := sql.find(f"@{name}(")) >= 0:
        depth, end = 0, at + len(name) + 1
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
            if not depth:
                break
        sql = sql[:at] + form.format(sql[at + len(name) + 2 : end - 1]) + sql[end:]
    return sql


def duckdb_sql(sql: str) -> str:
    """The text with its views in front, in DuckDB's dialect."""
    names = _needed(sql)
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if names:
        if body[:15].upper() == "WITH RECURSIVE ":
            body = f"WITH RECURSIVE {head}, {body[15:]}"
        else:
            body = f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
    return _macro(_macro(body, "epoch", "CAST(floor(epoch({})) AS BIGINT)"), "ts", "make_timestamp(({}) * 1000000)")


def view(spark: SparkSession, sf_dir: str, name: str, **instead: DataFrame) -> DataFrame:
    """A view or a driver table as a DataFrame, with other tables ``instead`` of those it names; nothing runs until it is used."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _macro(_macro(VIEWS[name], "epoch", "unix_timestamp({})"), "ts", "timestamp_seconds({})").replace(" // ", " div ")
    frames = {n: view(spark, sf_dir, n) for n in (*TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {n}\b", sql)} | instead
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(frames)})\b", r"\1 {\2}", sql), **frames)
