"""Collaboration and personal marts: projects, assets, spaces, artifacts, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, one_of, present, ranked

ROLE_RANK = {"manager": 0, "editor": 1, "viewer": 2}


def _count(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias(name))


def _zero(*names: str) -> list[Column]:
    return [F.coalesce(n, F.lit(0)).alias(n) for n in names]


def project_list(projects: DataFrame, members: DataFrame, assets: DataFrame, comments: DataFrame) -> DataFrame:
    """Projects with their assets, members and open comments; each count is made before its join, so nothing fans out."""
    a = assets.groupBy("project_id").agg(F.count("*").alias("assets"), F.max("updated_s").alias("asset_s"))
    m = _count(members, "project_id", "members")
    c = _count(comments.filter("resolved = 0").join(assets.select(F.col("id").alias("asset_id"), "project_id"), "asset_id"), "project_id", "open_comments")
    p = projects.withColumnRenamed("id", "project_id")
    for x in (a, m, c):
        p = p.join(x, "project_id", "left")
    return p.select("project_id", "name", *_zero("assets", "members", "open_comments"), F.greatest("updated_s", F.coalesce("asset_s", "updated_s")).alias("active_s"))


def access_role(projects: DataFrame, members: DataFrame) -> DataFrame:
    """(project_id, user_id, role): the owner's role overrides membership."""
    owners = projects.select(F.col("id").alias("project_id"), F.col("owner_id").cast("long").alias("user_id"), F.lit("owner").alias("role"))
    m = members.select("project_id", F.col("user_id").cast("long").alias("user_id"), "role")
    return owners.union(m.join(owners, ["project_id", "user_id"], "left_anti"))


def member_list(members: DataFrame) -> DataFrame:
    """Members with their place by role and name."""
    return members.withColumn("place", ranked("project_id", one_of(ROLE_RANK, F.col("role"), 9), F.lower("user_name"), "user_id"))


def folder_counts(folders: DataFrame, assets: DataFrame) -> DataFrame:
    a = _count(assets.filter("folder_id IS NOT NULL"), "folder_id", "assets").withColumnRenamed("folder_id", "id")
    return folders.join(a, "id", "left").select("id", *_zero("assets"))


def folder_subtree(folders: DataFrame, root: int) -> DataFrame:
    """(id, depth) of a folder and all below it, by a recursive query."""
    return folders.sparkSession.sql("WITH RECURSIVE t(id, depth) AS (SELECT id, 0 FROM {f} WHERE id = {root} UNION ALL SELECT f.id, t.depth + 1 FROM {f} f JOIN t ON f.parent_id = t.id) SELECT id, depth FROM t", f=folders.select("id", "parent_id"), root=root)


def asset_list(assets: DataFrame, versions: DataFrame, comments: DataFrame, members: DataFrame) -> DataFrame:
    """Assets with the cover or else newest version, version and open comment counts and the assignee's name."""
    v = versions.groupBy("asset_id").agg(F.max_by("id", F.struct("created_s", "id")).alias("newest"), F.count("*").alias("versions"))
    c = _count(comments.filter("resolved = 0"), "asset_id", "open_comments")
    who = members.select(F.col("user_id").alias("assignee_id"), "user_name").distinct()
    a = assets.withColumnRenamed("id", "asset_id").join(v, "asset_id", "left").join(c, "asset_id", "left").join(who, "assignee_id", "left")
    return a.select("asset_id", "project_id", "title", F.coalesce("cover_version_id", "newest").alias("version_id"), *_zero("versions", "open_comments"), F.col("user_name").alias("assignee"))


def asset_detail(assets: DataFrame, versions: DataFrame, comments: DataFrame) -> DataFrame:
    """One row an asset with its versions, newest first, and comments in time order, nested."""
    v = versions.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("created_s", "id")), False).alias("versions"))
    c = comments.groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct("t", "id", "body"))).alias("comments"))
    return assets.select(F.col("id").alias("asset_id"), "title").join(v, "asset_id", "left").join(c, "asset_id", "left")


def version_numbers(versions: DataFrame) -> DataFrame:
    return versions.withColumn("number", ranked("asset_id", "created_s", "id"))


def version_rows(versions: DataFrame, files: DataFrame) -> DataFrame:
    """Versions with the effective caption and the frame rate of the file's metadata."""
    f = files.select(F.col("id").alias("file_id"), F.coalesce(present(F.col("manual_caption")), present(F.col("caption")), F.lit("")).alias("caption"), F.get_json_object("metadata_json", "$.fps").cast("double").alias("fps"))
    return versions.join(f, "file_id", "left")


def remapped_statuses(assets: DataFrame, statuses: list[str]) -> DataFrame:
    """Assets whose status is not in the list take the list's first."""
    return assets.withColumn("status_name", F.when(F.col("status_name").isin(statuses), F.col("status_name")).otherwise(F.lit(statuses[0])))


def open_tasks(comments: DataFrame, assets: DataFrame, members: DataFrame, project_id: int) -> DataFrame:
    """Open comments of a project, with the author's name or the fallback."""
    a = assets.filter(F.col("project_id") == project_id).select(F.col("id").alias("asset_id"), "title")
    who = members.select(F.col("user_id").alias("author_id"), "user_name").distinct()
    return comments.filter("resolved = 0").join(a, "asset_id").join(who, "author_id", "left").select("id", "title", "body", F.coalesce("user_name", F.lit("guest")).alias("author"), "t")


def session_counts(sessions: DataFrame, comments: DataFrame) -> DataFrame:
    return sessions.join(_count(comments, "session_id", "comments"), "session_id", "left").select("session_id", *_zero("comments"))


def valid_shares(shares: DataFrame, now: Column) -> DataFrame:
    """Enabled shares that have not expired; an expiry that is no time makes a share invalid, none at all never ends."""
    at = F.try_to_timestamp(F.col("expires"))
    return shares.filter((F.col("enabled") == 1) & (F.col("expires").isNull() | F.coalesce(at > now, F.lit(False))))


def space_access(spaces: DataFrame, members: DataFrame, space_files: DataFrame) -> DataFrame:
    """(user_id, space_id, files): spaces a user owns or reaches by project membership."""
    own = spaces.select(F.col("owner_id").cast("long").alias("user_id"), F.col("id").alias("space_id"))
    by = spaces.join(members.select("project_id", F.col("user_id").cast("long").alias("user_id")), "project_id").select("user_id", F.col("id").alias("space_id"))
    return own.union(by).distinct().join(_count(space_files, "space_id", "files"), "space_id", "left").select("user_id", "space_id", *_zero("files"))


def artifact_access(artifacts: DataFrame, spaces: DataFrame, members: DataFrame, versions: DataFrame) -> DataFrame:
    """(user_id, artifact_id, version): visible as owner, as owner of the space, by the space's project, or by the artifact's project."""
    long = lambda c: F.col(c).cast("long").alias("user_id")
    a = artifacts.withColumnRenamed("id", "artifact_id")
    s = spaces.select(F.col("id").alias("space_id"), F.col("owner_id").alias("space_owner"), F.col("project_id").alias("space_project"))
    m = members.select(F.col("project_id").alias("pid"), long("user_id"))
    in_space = a.join(s, "space_id")
    ways = a.select(long("owner_id"), "artifact_id").union(in_space.select(long("space_owner"), "artifact_id")).union(in_space.join(m, F.col("space_project") == F.col("pid")).select("user_id", "artifact_id")).union(a.join(m, F.col("project_id") == F.col("pid")).select("user_id", "artifact_id"))
    latest = versions.groupBy("artifact_id").agg(F.max("number").alias("version"), F.max_by("sources", "number").alias("sources"))
    return ways.distinct().join(latest, "artifact_id", "left").select("user_id", "artifact_id", F.coalesce("version", F.lit(0)).alias("version"), F.coalesce(F.size(F.from_json("sources", "array<bigint>")), F.lit(0)).alias("n_sources"))


def top_of_each(rows: DataFrame, section: str, n: int, *order) -> DataFrame:
    return rows.withColumn("place", ranked(section, *order)).filter(F.col("place") <= n)


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count_distinct("file_id").alias("files"))


def file_tags(tags: DataFrame) -> DataFrame:
    """Tags of each file in one order that ignores case."""
    return tags.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("tag").alias("k"), "tag"))), lambda s: s["tag"]).alias("tags"))


def orphan_tags(tags: DataFrame, file_tag_rows: DataFrame) -> DataFrame:
    return tags.select("tag").distinct().join(file_tag_rows.select("tag"), "tag", "left_anti")


def with_favorites(page: DataFrame, favorites: DataFrame) -> DataFrame:
    """A flag a row by one join instead of a lookup a row."""
    return page.join(favorites.select(F.col("file_id").alias("id"), F.lit(True).alias("f")).distinct(), "id", "left").withColumn("favorite", F.coalesce("f", F.lit(False))).drop("f")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last verdict of each user (null is a user too), file and query."""
    return feedback.withColumn("k", ranked(["user_id", "file_id", "query_id"], F.desc("t"), F.desc("id"))).filter("k = 1").drop("k")


def conversation_list(messages: DataFrame) -> DataFrame:
    """Conversations with their message count and first user text."""
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"), F.min_by(F.when(F.col("role") == "user", F.substring("text", 1, 60)), F.when(F.col("role") == "user", F.col("turn"))).alias("title"))


def ordered_messages(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def users_with_grants(users: DataFrame, grants: DataFrame) -> DataFrame:
    g = grants.groupBy("user_id").agg(F.sort_array(F.collect_set("library_id")).alias("libraries"))
    return users.select("user_id", "user_name").distinct().join(g, "user_id", "left").select("user_id", "user_name", F.coalesce("libraries", F.array().cast("array<bigint>")).alias("libraries"))


def notifications(rows: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` of each user with the user's unread count."""
    unread = rows.groupBy("user_id").agg(count_where(F.col("read") == 0).alias("unread"))
    return top_of_each(rows, "user_id", n, F.desc("created_s"), F.desc("id")).join(unread, "user_id").drop("place")


def comment_fan_out(comments: DataFrame, assets: DataFrame, members: DataFrame) -> DataFrame:
    """One notification a member of the comment's project, but not to its author; a guest's comment goes to all."""
    a = assets.select(F.col("id").alias("asset_id"), "project_id", "title")
    who = members.select(F.col("user_id").alias("author_id"), F.col("user_name").alias("actor")).distinct()
    c = comments.join(a, "asset_id").join(who, "author_id", "left")
    to = members.select("project_id", F.col("user_id").alias("to_id"))
    out = c.join(to, "project_id").filter(~F.col("to_id").eqNullSafe(F.col("author_id")))
    return out.select(F.col("id").alias("comment_id"), "to_id", F.concat(F.coalesce("actor", F.lit("guest")), F.lit(" on "), "title").alias("title"), F.substring("body", 1, 240).alias("body"))


def activity_bumps(comments: DataFrame, assets: DataFrame) -> DataFrame:
    """Last comment time of each asset, to become its activity time."""
    c = comments.groupBy(F.col("asset_id").alias("id")).agg(F.max("created_s").alias("c"))
    return assets.join(c, "id", "left").select("id", "project_id", F.greatest("updated_s", F.coalesce("c", "updated_s")).alias("active_s"))


def foreign_refs(comments: DataFrame, versions: DataFrame) -> DataFrame:
    """Comments that name a version of another asset."""
    return comments.join(versions.select("asset_id", F.col("id").alias("version_id")), ["asset_id", "version_id"], "left_anti")


def review_brief(assets: DataFrame, versions: DataFrame, comments: DataFrame, n_versions: int = 8, n_comments: int = 30) -> DataFrame:
    """Evidence rows (asset_id, source, place, text) of the first versions and the last comments."""
    v = top_of_each(versions, "asset_id", n_versions, "created_s", "id", "scope").select("asset_id", F.lit("version").alias("source"), "place", F.col("scope").alias("text"))
    c = top_of_each(comments, "asset_id", n_comments, F.desc("created_s"), F.desc("id"), "body").select("asset_id", F.lit("comment"), "place", "body")
    return v.union(c).join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")


def brief_summary(versions: DataFrame, comments: DataFrame, n: int = 12) -> DataFrame:
    """Versions and open comments of each asset, and its first open comments."""
    v = _count(versions, "asset_id", "versions")
    c = comments.filter("resolved = 0").groupBy("asset_id").agg(F.count("*").alias("open"), F.slice(F.sort_array(F.collect_list(F.struct("created_s", "id"))), 1, n).alias("firsts"))
    return v.join(c, "asset_id", "left").select("asset_id", "versions", *_zero("open"), F.coalesce(F.transform("firsts", lambda s: s["id"]), F.array().cast("array<bigint>")).alias("listed"))


def file_detail(files: DataFrame, chunks: DataFrame, favorites: DataFrame, tags: DataFrame, cap: int = 100, chars: int = 200_000) -> DataFrame:
    """Public columns with the first chunks, the favourite flag and the tags; long text is cut for display."""
    c = top_of_each(chunks, "file_id", cap, "chunk_index").groupBy(F.col("file_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    f = with_favorites(files.select("id", "name", "kind", F.substring("text", 1, chars).alias("text")), favorites)
    return f.join(c, "id", "left").join(file_tags(tags).withColumnRenamed("file_id", "id"), "id", "left")


def shared_page(listed: DataFrame, project_id: int, limit: int, offset: int = 0) -> DataFrame:
    """One page of a project's assets with the total and whether more follow."""
    mine = listed.filter(F.col("project_id") == project_id)
    total = mine.agg(F.count("*").alias("total"))
    return mine.orderBy("asset_id").offset(offset).limit(limit).join(total).withColumn("has_more", F.col("total") > offset + limit)  # one row


def external_view(versions: DataFrame, assets: DataFrame, comments: DataFrame, all_versions: bool = False) -> tuple[DataFrame, DataFrame]:
    """What an outside viewer sees: the cover (or newest) version unless all are shared, and external comments."""
    a = assets.select(F.col("id").alias("asset_id"), "cover_version_id")
    v = versions.join(a, "asset_id").withColumn("k", ranked("asset_id", F.desc(F.coalesce(F.col("id") == F.col("cover_version_id"), F.lit(False))), F.desc("created_s"), F.desc("id")))
    shown = v if all_versions else v.filter("k = 1")
    return shown.select("asset_id", F.col("id").alias("version_id")), comments.filter("visibility = 'external'").join(a, "asset_id", "left_semi").select("asset_id", "id", "t", "body")


def run_list(runs: DataFrame, actions: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` runs of each owner with their actions in sequence."""
    a = actions.groupBy("run_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "name"))), lambda s: s["name"]).alias("actions"))
    return top_of_each(runs, "owner_id", n, F.desc("created_s"), F.desc("run_id")).join(a, "run_id", "left")


def rejected_runs(runs: DataFrame, users: DataFrame, roles: DataFrame, files: DataFrame, grants: DataFrame) -> DataFrame:
    """(run_id, reason): owner disabled, no right to edit the project, or a planned file outside the owner's libraries."""
    off = runs.join(users.filter("enabled = 1").select(F.col("user_id").alias("owner_id")), "owner_id", "left_anti").select("run_id", F.lit("owner disabled").alias("reason"))
    edit = roles.filter("role <> 'viewer'").select("project_id", F.col("user_id").alias("owner_id"))
    noedit = runs.filter("project_id IS NOT NULL").join(edit, ["project_id", "owner_id"], "left_anti").select("run_id", F.lit("no edit right"))
    planned = runs.select("run_id", "owner_id", F.explode("file_ids").alias("id")).join(files.select("id", "library_id"), "id", "left")
    outside = planned.join(grants.select(F.col("user_id").alias("owner_id"), "library_id"), ["owner_id", "library_id"], "left_anti").select("run_id", F.lit("file outside libraries")).distinct()
    return off.union(noedit).union(outside)
