"""Duplicate and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedup as d
from .registry import query

DUPS = "SELECT * FROM files_v f WHERE size > 0 AND EXISTS (SELECT 1 FROM files_v g WHERE g.content_hash = f.content_hash AND g.size = f.size AND g.id <> f.id)"


@query("d1_exact", f"SELECT id, size, content_hash FROM ({DUPS}) x")
def _(t):
    return d.exact_groups(t.files_v).select("id", "size", "content_hash")


@query("d2_quick_hash", "SELECT id, sha256(concat(CAST(size AS STRING), '|', substr(text, 1, 1048576), '|', CASE WHEN length(text) > 2097152 THEN right(text, 1048576) ELSE '' END)) AS h FROM files_v")
def _(t):
    return t.files_v.select("id", d.quick_hash(F.col("size"), F.col("text")).alias("h"))


@query("d3_report", "SELECT content_hash, size, count(*) AS member_count, (count(*) - 1) * size AS reclaimable, string_agg(CAST(id AS STRING), ',' ORDER BY mtime_s, id) AS members FROM files_v WHERE size > 0 GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY reclaimable DESC, content_hash LIMIT 25")
def _(t):
    return d.largest_first(d.duplicate_report(t.files_v), 25).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@query("d3_total", f"SELECT count(*) AS n_groups, CAST(sum((n - 1) * size) AS BIGINT) AS reclaimable FROM (SELECT content_hash, size, count(*) AS n FROM ({DUPS}) x GROUP BY 1, 2) y")
def _(t):
    return d.duplicate_report(t.files_v).agg(F.count("*").alias("n_groups"), F.sum("reclaimable").alias("reclaimable"))


@query("d4_keepers", f"SELECT content_hash, size, id AS keep, n FROM (SELECT *, count(*) OVER (PARTITION BY content_hash, size) AS n, row_number() OVER (PARTITION BY content_hash, size ORDER BY regexp_matches(lower(name), 'copy'), captured_s IS NULL, width * height DESC, length(path), mtime_s, id) AS k FROM ({DUPS}) x) y WHERE k = 1")
def _(t):
    return d.keepers(t.files_v)


def _prints(t):
    return d.simhash(t.documents, "doc_id")


HASHED = r"""
w AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9\x{00c0}-\x{024f}]+'))) AS w FROM documents),
h AS (SELECT id, CAST('0x' || substr(md5(w), 1, 16) AS UBIGINT) AS h FROM w),
s AS (SELECT id, k, sum(CASE WHEN (h >> k) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS k) r GROUP BY 1, 2),
p AS (SELECT id, CAST(sum(CASE WHEN s > 0 THEN CAST(1 AS UBIGINT) << k ELSE 0 END) AS UBIGINT) AS fp FROM s GROUP BY 1)"""


@query("d5_near_pairs", f"WITH {HASHED}, u AS (SELECT fp, min(id) AS id FROM p GROUP BY fp) SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.fp, b.fp)) AS INT) AS distance FROM u a JOIN u b ON a.id < b.id AND bit_count(xor(a.fp, b.fp)) <= 8")
def _(t):
    return d.near_pairs(_prints(t))


GROUPS = f"""
WITH RECURSIVE {HASHED}, e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND bit_count(xor(a.fp, b.fp)) <= 8),
c(id, r) AS (SELECT id, id FROM p UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.id WHERE c.r < e.b),
m AS (SELECT id, min(r) AS g FROM c GROUP BY 1),
sg AS (SELECT m.g AS group_id, m.id, CAST(bit_count(xor(x.fp, y.fp)) AS INT) AS distance FROM m JOIN p x ON x.id = m.id JOIN p y ON y.id = m.g WHERE m.g IN (SELECT g FROM m GROUP BY g HAVING count(*) > 1))
"""


@query("d5_groups", GROUPS + "SELECT group_id, id, distance FROM sg")
def _(t):
    return d.similar_groups(_prints(t))


@query("d6_unprinted", "SELECT id FROM files_v WHERE id % 4 <> 1")
def _(t):
    return d.unprinted(t.files_v, t.files_v.filter("id % 4 = 1")).select("id")


@query("d7_sign_prints", "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS ones FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.bit_count(d.sign_print(F.col("embedding"))).alias("ones"))


@query("d8_report", GROUPS + "SELECT group_id, count(*) AS members, max(distance) AS farthest FROM sg WHERE id IN (SELECT id FROM files_v) GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return d.group_report(d.similar_groups(_prints(t)), t.files_v)


@query("d9_refreshed", f"SELECT content_hash AS group_id, id FROM (SELECT *, count(*) OVER (PARTITION BY content_hash, size) AS n FROM ({DUPS}) x WHERE id % 3 <> 0) y WHERE n > 1")
def _(t):
    groups = d.exact_groups(t.files_v).select(F.col("content_hash").alias("group_id"), "id")
    return d.refreshed(groups, t.files_v.filter("id % 3 = 0"))


@query("d10_unsafe", "SELECT id FROM files_v f WHERE id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM files_v g WHERE g.id % 3 <> 0 AND g.content_hash = f.content_hash AND g.size = f.size)")
def _(t):
    return d.unsafe_deletes(t.files_v, t.files_v.filter("id % 3 = 0"))
