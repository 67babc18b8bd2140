"""Collaboration mart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marts as m
from .registry import query


def joined(df, **cols):
    """Arrays as text, so that both engines print them alike."""
    for c, f in cols.items():
        df = df.withColumn(c, F.array_join(F.transform(c, f), ","))
    return df


PLIST = """SELECT p.id AS project_id, p.name, coalesce(a.n, 0) AS assets, coalesce(m.n, 0) AS members, coalesce(c.n, 0) AS open_comments, greatest(p.updated_s, coalesce(a.s, p.updated_s)) AS active_s FROM projects_v p
LEFT JOIN (SELECT project_id, count(*) AS n, max(updated_s) AS s FROM assets_v GROUP BY 1) a ON a.project_id = p.id LEFT JOIN (SELECT project_id, count(*) AS n FROM members_v GROUP BY 1) m ON m.project_id = p.id
LEFT JOIN (SELECT a.project_id, count(*) AS n FROM comments_v c JOIN assets_v a ON a.id = c.asset_id WHERE resolved = 0 GROUP BY 1) c ON c.project_id = p.id"""


@query("g1_projects", PLIST)
def _(t):
    return m.project_list(t.projects_v, t.members_v, t.assets_v, t.comments_v)


@query("g2_project_header", f"SELECT project_id, assets, members, open_comments FROM ({PLIST}) x WHERE project_id = 25")
def _(t):
    return m.project_list(t.projects_v, t.members_v, t.assets_v, t.comments_v).filter("project_id = 25").select("project_id", "assets", "members", "open_comments")


ROLES = "SELECT id AS project_id, CAST(owner_id AS BIGINT) AS user_id, 'owner' AS role FROM projects_v UNION ALL SELECT m.project_id, m.user_id, m.role FROM members_v m JOIN projects_v p ON p.id = m.project_id WHERE m.user_id <> p.owner_id"


@query("g3_roles", ROLES)
def _(t):
    return m.access_role(t.projects_v, t.members_v)


@query("g4_members", "SELECT project_id, user_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY CASE role WHEN 'manager' THEN 0 WHEN 'editor' THEN 1 WHEN 'viewer' THEN 2 ELSE 9 END, lower(user_name), user_id) AS INT) AS place FROM members_v")
def _(t):
    return m.member_list(t.members_v).select("project_id", "user_id", "place")


@query("g5_folders", "SELECT f.id, count(a.id) AS assets FROM (SELECT DISTINCT id FROM files_v) f LEFT JOIN assets_v a ON a.folder_id = f.id GROUP BY 1")
def _(t):
    return m.folder_counts(t.files_v.select("id").distinct(), t.assets_v)


@query("g6_subtree", "WITH RECURSIVE f AS (SELECT id, CASE WHEN id > 0 THEN id // 4 END AS parent_id FROM files_v), t(id, depth) AS (SELECT id, 0 FROM f WHERE id = 3 UNION ALL SELECT f.id, t.depth + 1 FROM f JOIN t ON f.parent_id = t.id) SELECT id, CAST(depth AS INT) AS depth FROM t")
def _(t):
    return m.folder_subtree(t.files_v.selectExpr("id", "CASE WHEN id > 0 THEN id div 4 END AS parent_id"), 3)


ALIST = """SELECT a.id AS asset_id, a.project_id, a.title, coalesce(a.cover_version_id, v.newest) AS version_id, coalesce(v.n, 0) AS versions, coalesce(c.n, 0) AS open_comments, w.user_name AS assignee FROM assets_v a
LEFT JOIN (SELECT asset_id, (array_agg(id ORDER BY created_s DESC, id DESC))[1] AS newest, count(*) AS n FROM versions_v GROUP BY 1) v ON v.asset_id = a.id
LEFT JOIN (SELECT asset_id, count(*) AS n FROM comments_v WHERE resolved = 0 GROUP BY 1) c ON c.asset_id = a.id LEFT JOIN (SELECT DISTINCT user_id, user_name FROM members_v) w ON w.user_id = a.assignee_id"""


def _alist(t):
    return m.asset_list(t.assets_v, t.versions_v, t.comments_v, t.members_v)


@query("g7_assets", ALIST)
def _(t):
    return _alist(t)


@query("g8_asset_detail", "SELECT a.id AS asset_id, title, v AS versions, c AS comments FROM assets_v a LEFT JOIN (SELECT asset_id, string_agg(CAST(id AS STRING), ',' ORDER BY created_s DESC, id DESC) AS v FROM versions_v GROUP BY 1) x ON x.asset_id = a.id LEFT JOIN (SELECT asset_id, string_agg(CAST(id AS STRING) || ':' || body, ',' ORDER BY t, id, body) AS c FROM comments_v GROUP BY 1) y ON y.asset_id = a.id")
def _(t):
    return joined(m.asset_detail(t.assets_v, t.versions_v, t.comments_v), versions=lambda s: s["id"].cast("string"), comments=lambda s: F.concat(s["id"].cast("string"), F.lit(":"), s["body"]))


@query("g9_version_numbers", "SELECT asset_id, id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY created_s, id) AS INT) AS number FROM versions_v")
def _(t):
    return m.version_numbers(t.versions_v).select("asset_id", "id", "number")


@query("g10_versions", "SELECT v.id, coalesce(nullif(manual_caption, ''), nullif(caption, ''), '') AS caption, CASE WHEN f.id % 2 = 0 THEN 24.0 + f.id % 7 END AS fps FROM versions_v v JOIN files_v f ON f.id = v.file_id")
def _(t):
    f = t.files_v.withColumn("metadata_json", F.when(F.col("id") % 2 == 0, F.to_json(F.struct((F.col("id") % 7 + 24).alias("fps")))).otherwise("{}"))
    return m.version_rows(t.versions_v, f).filter("caption IS NOT NULL").select("id", "caption", "fps")


@query("g11_statuses", "SELECT id, CASE WHEN status_name IN ('todo', 'doing', 'done') THEN status_name ELSE 'todo' END AS status_name FROM assets_v")
def _(t):
    return m.remapped_statuses(t.assets_v, ["todo", "doing", "done"]).select("id", "status_name")


@query("g12_open_tasks", "SELECT c.id, a.title, c.body, coalesce(w.user_name, 'guest') AS author, c.t FROM comments_v c JOIN assets_v a ON a.id = c.asset_id LEFT JOIN (SELECT DISTINCT user_id, user_name FROM members_v) w ON w.user_id = c.author_id WHERE resolved = 0 AND a.project_id = 25")
def _(t):
    return m.open_tasks(t.comments_v, t.assets_v, t.members_v, 25)


@query("g13_sessions", "SELECT s.session_id, count(c.id) AS comments FROM (SELECT DISTINCT id % 6 AS session_id FROM files_v) s LEFT JOIN comments_v c ON c.session_id = s.session_id GROUP BY 1")
def _(t):
    return m.session_counts(t.files_v.select((F.col("id") % 6).alias("session_id")).distinct(), t.comments_v)


@query("g14_shares", "SELECT id FROM files_v WHERE id % 5 <> 0 AND (id % 3 = 0 OR (id % 3 = 1 AND mtime_s > 1705000000))")
def _(t):
    e = F.when(F.col("id") % 3 == 1, F.date_format(F.timestamp_seconds("mtime_s"), "yyyy-MM-dd HH:mm:ss")).when(F.col("id") % 3 == 2, "soon")
    s = t.files_v.select("id", F.when(F.col("id") % 5 == 0, 0).otherwise(1).alias("enabled"), e.alias("expires"))
    return m.valid_shares(s, F.timestamp_seconds(F.lit(1705000000))).select("id")


@query("g15_spaces", "SELECT u.user_id, u.space_id, coalesce(f.n, 0) AS files FROM (SELECT CAST(owner_id AS BIGINT) AS user_id, id AS space_id FROM spaces_v UNION SELECT m.user_id, s.id FROM spaces_v s JOIN members_v m ON m.project_id = s.project_id) u LEFT JOIN (SELECT space_id, count(*) AS n FROM space_files_v GROUP BY 1) f ON f.space_id = u.space_id")
def _(t):
    return m.space_access(t.spaces_v, t.members_v, t.space_files_v)


@query("g16_artifacts", """
WITH w AS (SELECT CAST(owner_id AS BIGINT) AS user_id, id AS artifact_id FROM artifacts_v UNION SELECT s.owner_id, a.id FROM artifacts_v a JOIN spaces_v s ON s.id = a.space_id UNION SELECT m.user_id, a.id FROM artifacts_v a JOIN spaces_v s ON s.id = a.space_id JOIN members_v m ON m.project_id = s.project_id UNION SELECT m.user_id, a.id FROM artifacts_v a JOIN members_v m ON m.project_id = a.project_id),
v AS (SELECT l_partkey AS artifact_id, max(l_linenumber) AS version FROM lineitem GROUP BY 1)
SELECT user_id, w.artifact_id, coalesce(version, 0) AS version, coalesce(version, 0) AS n_sources FROM w LEFT JOIN v ON v.artifact_id = w.artifact_id""")
def _(t):
    v = t.lineitem.select(F.col("l_partkey").alias("artifact_id"), F.col("l_linenumber").alias("number"), F.to_json(F.sequence(F.lit(1), F.col("l_linenumber"))).alias("sources")).distinct()
    return m.artifact_access(t.artifacts_v, t.spaces_v, t.members_v, v)


@query("g17_sections", "SELECT section, id, CAST(k AS INT) AS place FROM (SELECT status_name AS section, id, row_number() OVER (PARTITION BY status_name ORDER BY updated_s DESC, id) AS k FROM assets_v) x WHERE k <= 6")
def _(t):
    return m.top_of_each(t.assets_v.withColumnRenamed("status_name", "section"), "section", 6, F.desc("updated_s"), "id").select("section", "id", "place")


@query("g18_tags", "SELECT tag, count(DISTINCT file_id) AS files FROM tags_v GROUP BY 1")
def _(t):
    return m.tag_counts(t.tags_v)


@query("g18_file_tags", "SELECT file_id, string_agg(tag, ',' ORDER BY lower(tag), tag) AS tags FROM (SELECT DISTINCT file_id, tag FROM tags_v) x GROUP BY 1")
def _(t):
    return joined(m.file_tags(t.tags_v), tags=lambda x: x)


@query("g18_orphan_tags", "SELECT DISTINCT tag FROM tags_v WHERE tag NOT IN (SELECT tag FROM tags_v WHERE file_id % 50 < 2)")
def _(t):
    return m.orphan_tags(t.tags_v, t.tags_v.filter("file_id % 50 < 2"))


@query("g19_favorites", "SELECT f.id, EXISTS (SELECT 1 FROM feedback_v b WHERE b.file_id = f.id AND b.verdict = 'relevant') AS favorite FROM files_v f")
def _(t):
    return m.with_favorites(t.files_v.select("id"), t.feedback_v.filter("verdict = 'relevant'"))


@query("g20_feedback", "SELECT user_id, file_id, query_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id, file_id, query_id ORDER BY t DESC, id DESC) AS k FROM feedback_v) x WHERE k = 1")
def _(t):
    return m.latest_feedback(t.feedback_v).select("user_id", "file_id", "query_id", "verdict")


@query("g21_conversations", "SELECT conv_id, count(*) AS messages, (array_agg(substr(text, 1, 60) ORDER BY turn) FILTER (role = 'user'))[1] AS title FROM messages_v GROUP BY 1")
def _(t):
    return m.conversation_list(t.messages_v)


@query("g21_messages", "SELECT conv_id, string_agg(CAST(turn AS STRING) || role, ',' ORDER BY turn, role, text) AS messages FROM messages_v GROUP BY 1")
def _(t):
    return joined(m.ordered_messages(t.messages_v), messages=lambda s: F.concat(s["turn"].cast("string"), s["role"]))


@query("g22_users", "SELECT user_id, user_name, string_agg(CAST(library_id AS STRING), ',' ORDER BY library_id) AS libraries FROM (SELECT DISTINCT user_id, user_name, library_id FROM grants_v) x GROUP BY 1, 2")
def _(t):
    return joined(m.users_with_grants(t.grants_v, t.grants_v), libraries=lambda x: x.cast("string"))


@query("g23_notifications", "SELECT user_id, id, unread FROM (SELECT user_id, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) FILTER (event_type <> 'view') OVER (PARTITION BY user_id) AS unread FROM events) x WHERE k <= 4")
def _(t):
    rows = t.events.select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("created_s"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("read"))
    return m.notifications(rows, 4).select("user_id", "id", "unread")


@query("g24_audit", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("g25_fan_out", "SELECT c.id AS comment_id, m.user_id AS to_id, coalesce(w.user_name, 'guest') || ' on ' || a.title AS title, substr(c.body, 1, 240) AS body FROM comments_v c JOIN assets_v a ON a.id = c.asset_id LEFT JOIN (SELECT DISTINCT user_id, user_name FROM members_v) w ON w.user_id = c.author_id JOIN members_v m ON m.project_id = a.project_id WHERE m.user_id IS DISTINCT FROM c.author_id")
def _(t):
    return m.comment_fan_out(t.comments_v, t.assets_v, t.members_v)


@query("g25_activity", "SELECT a.id, a.project_id, greatest(a.updated_s, coalesce(max(c.created_s), a.updated_s)) AS active_s FROM assets_v a LEFT JOIN comments_v c ON c.asset_id = a.id GROUP BY a.id, a.project_id, a.updated_s")
def _(t):
    return m.activity_bumps(t.comments_v, t.assets_v)


@query("g25_foreign_refs", "SELECT id FROM comments_v WHERE id % 3 = 0")
def _(t):
    c = t.comments_v.withColumn("version_id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")))
    return m.foreign_refs(c, t.versions_v).select("id")


@query("g26_brief", "SELECT asset_id, source, CAST(place AS INT) AS place, text FROM (SELECT asset_id, 'version' AS source, row_number() OVER (PARTITION BY asset_id ORDER BY created_s, id, scope) AS place, scope AS text FROM versions_v UNION ALL SELECT asset_id, 'comment', row_number() OVER (PARTITION BY asset_id ORDER BY created_s DESC, id DESC, body), body FROM comments_v) x WHERE place <= CASE source WHEN 'version' THEN 2 ELSE 3 END AND asset_id IN (SELECT id FROM assets_v)")
def _(t):
    return m.review_brief(t.assets_v, t.versions_v, t.comments_v, 2, 3)


@query("g26_summary", "SELECT v.asset_id, v.n AS versions, coalesce(c.n, 0) AS open, coalesce(l, '') AS listed FROM (SELECT asset_id, count(*) AS n FROM versions_v GROUP BY 1) v LEFT JOIN (SELECT asset_id, count(*) AS n, array_to_string(list_transform(list(id ORDER BY created_s, id)[1:2], lambda x: CAST(x AS STRING)), ',') AS l FROM comments_v WHERE resolved = 0 GROUP BY 1) c ON c.asset_id = v.asset_id")
def _(t):
    return joined(m.brief_summary(t.versions_v, t.comments_v, 2), listed=lambda x: x.cast("string"))


@query("g27_detail", "SELECT f.id, name, kind, md5(substr(text, 1, 200000)) AS text, EXISTS (SELECT 1 FROM feedback_v b WHERE b.file_id = f.id AND verdict = 'relevant') AS favorite, coalesce(c.n, 0) AS chunks, coalesce(g.tags, '') AS tags FROM files_v f LEFT JOIN (SELECT file_id, least(count(*), 100) AS n FROM vectors_v GROUP BY 1) c ON c.file_id = f.id LEFT JOIN (SELECT file_id, string_agg(tag, ',' ORDER BY lower(tag), tag) AS tags FROM (SELECT DISTINCT * FROM tags_v) x GROUP BY 1) g ON g.file_id = f.id")
def _(t):
    chunks = t.vectors_v.select("file_id", "chunk_index", F.col("vec_id").alias("content"))
    out = m.file_detail(t.files_v, chunks, t.feedback_v.filter("verdict = 'relevant'"), t.tags_v)
    return out.select("id", "name", "kind", F.md5("text").alias("text"), "favorite", F.coalesce(F.size("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"))


@query("g28_shared_page", f"SELECT asset_id, title, version_id, (SELECT count(*) FROM assets_v WHERE project_id = 25) AS total, (SELECT count(*) FROM assets_v WHERE project_id = 25) > 7 AS has_more FROM ({ALIST}) x WHERE project_id = 25 ORDER BY asset_id LIMIT 5 OFFSET 2")
def _(t):
    return m.shared_page(_alist(t), 25, 5, 2).select("asset_id", "title", "version_id", "total", "has_more")


@query("g29_external_versions", "SELECT asset_id, version_id FROM (SELECT v.asset_id, v.id AS version_id, row_number() OVER (PARTITION BY v.asset_id ORDER BY coalesce(v.id = a.cover_version_id, FALSE) DESC, v.created_s DESC, v.id DESC) AS k FROM versions_v v JOIN assets_v a ON a.id = v.asset_id) x WHERE k = 1")
def _(t):
    return m.external_view(t.versions_v, t.assets_v, t.comments_v)[0]


@query("g29_external_comments", "SELECT asset_id, id, t, body FROM comments_v WHERE visibility = 'external' AND asset_id IN (SELECT id FROM assets_v)")
def _(t):
    return m.external_view(t.versions_v, t.assets_v, t.comments_v)[1]


@query("g30_runs", "SELECT owner_id, run_id, actions FROM (SELECT o_custkey AS owner_id, o_orderkey AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) r LEFT JOIN (SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS actions FROM lineitem GROUP BY 1) a ON a.l_orderkey = r.run_id WHERE k <= 3")
def _(t):
    runs = t.orders.select(F.col("o_custkey").alias("owner_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_s"))
    acts = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("sequence"), F.col("l_returnflag").alias("name"))
    out = m.run_list(runs, acts, 3)
    return out.select("owner_id", "run_id", F.array_join("actions", ",").alias("actions"))


@query("g31_rejected", f"""
WITH r AS (SELECT id AS run_id, assignee_id AS owner_id, CASE WHEN id % 3 = 0 THEN project_id END AS project_id, id % 1000 AS f1, (id * 7) % 1000 AS f2 FROM assets_v), roles AS ({ROLES})
SELECT run_id, 'owner disabled' AS reason FROM r WHERE owner_id % 9 = 8 UNION ALL
SELECT run_id, 'no edit right' FROM r WHERE project_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM roles x WHERE x.project_id = r.project_id AND x.user_id = r.owner_id AND x.role <> 'viewer') UNION ALL
SELECT run_id, 'file outside libraries' FROM r WHERE NOT EXISTS (SELECT 1 FROM grants_v g JOIN files_v f ON f.library_id = g.library_id WHERE g.user_id = r.owner_id AND f.id = r.f1) OR NOT EXISTS (SELECT 1 FROM grants_v g JOIN files_v f ON f.library_id = g.library_id WHERE g.user_id = r.owner_id AND f.id = r.f2)""")
def _(t):
    i = F.col("id")
    runs = t.assets_v.select(i.alias("run_id"), F.col("assignee_id").alias("owner_id"), F.when(i % 3 == 0, F.col("project_id")).alias("project_id"), F.array(i % 1000, i * 7 % 1000).alias("file_ids"))
    users = t.assets_v.select(F.col("assignee_id").alias("user_id")).distinct().withColumn("enabled", F.when(F.col("user_id") % 9 == 8, 0).otherwise(1))
    return m.rejected_runs(runs, users, m.access_role(t.projects_v, t.members_v), t.files_v, t.grants_v)
