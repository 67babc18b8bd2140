"""Catalog operators: change capture, rollups, scoping filters and rule matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, one_of, present, valid_point
from ..functions.session import small, written

#: Extensions of each kind of file.
KINDS = {
    "image": "jpg jpeg png gif webp bmp tif tiff heic heif avif svg psd raw dng cr2 nef arw",
    "video": "mp4 mov mkv avi webm m4v mpg mpeg wmv flv",
    "audio": "mp3 wav flac aac m4a ogg opus wma",
    "document": "txt md pdf doc docx xls xlsx ppt pptx csv json html htm xml epub rtf",
    "archive": "zip rar 7z tar gz bz2 xz",
}


def with_kind(files: DataFrame, spark) -> DataFrame:
    """Kind of each file by its extension, else ``other`` (a join to a fixed small table)."""
    kinds = spark.createDataFrame([(e, k) for k, es in KINDS.items() for e in es.split()], "ext string, kind_of string")
    joined = files.join(F.broadcast(kinds), F.lower(F.ltrim("extension", F.lit("."))) == F.col("ext"), "left")
    return joined.withColumn("kind_of", F.coalesce("kind_of", F.lit("other"))).drop("ext")


#: Recycle and snapshot folders and companion files; beginnings of hidden companions and of import folders.
IGNORED = ("#recycle", "@eaDir", "#snapshot", ".Trash", "$RECYCLE.BIN", ".DS_Store", "Thumbs.db")
IGNORED_PREFIXES = ("._", ".import-")


def not_ignored(path: Column) -> Column:
    """False if any part of the path is a recycle or snapshot folder, an import folder or a hidden companion file."""

    def bad(part: Column) -> Column:
        out = part.isin(*IGNORED)
        for prefix in IGNORED_PREFIXES:
            out = out | part.startswith(prefix)
        return out

    return ~F.exists(F.split(path, "/"), bad)


def snapshot_changes(scan: DataFrame, catalog: DataFrame) -> DataFrame:
    """Full comparison of a scan with the catalog on path: insert, update, unchanged or delete.

    An update is a change of size or time. One full outer join; paths must be unique on each side.
    """
    s, c = scan.alias("s"), catalog.alias("c")
    kind = (
        F.when(F.col("c.path").isNull(), "insert").when(F.col("s.path").isNull(), "delete")
        .when((F.col("s.size") != F.col("c.size")) | (F.col("s.mtime_s") != F.col("c.mtime_s")), "update").otherwise("unchanged")
    )
    return s.join(c, F.col("s.path") == F.col("c.path"), "full_outer").select(
        F.coalesce("s.path", "c.path").alias("path"), F.coalesce("s.library_id", "c.library_id").alias("library_id"),
        F.col("s.size").alias("size"), F.col("s.mtime_s").alias("mtime_s"), F.col("c.id").alias("catalog_id"), kind.alias("change"),
    )


def apply_changes(changes: DataFrame) -> DataFrame:
    """The next catalog: deletes gone, changed rows with all stages back to pending."""
    reset = F.col("change").isin("insert", "update")
    return changes.filter("change <> 'delete'").select("path", "library_id", "size", "mtime_s", F.when(reset, "pending").otherwise("kept").alias("stage"), reset.alias("leaves_group"))


def missing(catalog: DataFrame, scan: DataFrame) -> DataFrame:
    """Catalog rows whose path the scan did not see."""
    return catalog.join(scan.select("path"), "path", "left_anti")


def scan_summary(changes: DataFrame) -> DataFrame:
    """Scanned, changed, unchanged and removed counts a library."""
    is_ = lambda *k: count_where(F.col("change").isin(*k))
    return changes.groupBy("library_id").agg(is_("insert", "update", "unchanged").alias("scanned"), is_("insert", "update").alias("changed"), is_("unchanged").alias("unchanged"), is_("delete").alias("removed"))


def library_rollup(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """Files and bytes of every library, zero for an empty one."""
    agg = files.groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    return libraries.join(agg, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("file_count"), F.coalesce("b", F.lit(0)).alias("total_bytes"))


def signature(files: DataFrame) -> DataFrame:
    """Order-free signature of each library: count, bytes, and the xor of row hashes."""
    return files.groupBy("library_id").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("path", "size", "mtime_s")).alias("hash"))


def folder_of(path: Column) -> Column:
    """The path up to its last separator; empty for a file at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def folder_signatures(files: DataFrame) -> DataFrame:
    """Signature of every folder with all that is below it: library_id, folder, n, bytes, hash; the top is the empty folder.

    Files add up to their folder first, and only folders go up to those above
    them. Signatures of disjoint batches of files combine by sums and xor, so a kept table can be
    brought forward. Paths are unique in a library; a null path takes no part.
    """
    own = files.filter("path IS NOT NULL").groupBy("library_id", folder_of(F.col("path")).alias("own")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.bit_xor(F.xxhash64("path", "size", "mtime_s")).alias("hash"))
    parts = F.split("own", "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    up = own.select("library_id", F.explode(above).alias("folder"), "n", "bytes", "hash")
    return up.groupBy("library_id", "folder").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.bit_xor("hash").alias("hash"))


def changed_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """Folders of two signature tables that differ, with ``deepest``: no folder below it differs, so that its own files do."""
    o, n = old.alias("o"), new.alias("n")
    same = F.col("o.n").eqNullSafe(F.col("n.n")) & F.col("o.bytes").eqNullSafe(F.col("n.bytes")) & F.col("o.hash").eqNullSafe(F.col("n.hash"))
    on = F.col("o.library_id").eqNullSafe(F.col("n.library_id")) & (F.col("o.folder") == F.col("n.folder"))
    differ = o.join(n, on, "full_outer").filter(~same).select(F.coalesce("o.library_id", "n.library_id").alias("library_id"), F.coalesce("o.folder", "n.folder").alias("folder"))
    above = differ.filter("folder <> ''").select(F.col("library_id").alias("l"), folder_of(F.col("folder")).alias("f")).distinct()
    held = differ.join(above, F.col("library_id").eqNullSafe(F.col("l")) & (F.col("folder") == F.col("f")), "left")
    return held.select("library_id", "folder", F.col("f").isNull().alias("deepest"))


def changes_below(scan: DataFrame, catalog: DataFrame, folders: DataFrame) -> DataFrame:
    """The changes of a scan, looked for in the files of folders that differ only: a row a file that is not ``unchanged``.

    ``folders``: from ``changed_folders`` of the kept and the scan's signatures. Files of other folders are left out by a semi join
    before the full comparison, so that what is shuffled follows the changes; every changed file's folder differs.
    """
    some = small(folders.select(F.col("library_id").alias("l"), F.col("folder").alias("f")), 1_000_000)
    near = lambda files: files.join(some, F.col("library_id").eqNullSafe(F.col("l")) & (folder_of(F.col("path")) == F.col("f")), "left_semi")
    return snapshot_changes(near(scan), near(catalog)).filter("change <> 'unchanged'")


def fingerprint(rows: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table's whole content in one row."""
    h = F.xxhash64(*rows.columns)
    return rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def inbox(files: DataFrame, attached: DataFrame, part: str = "/inbox/") -> DataFrame:
    """Files under the inbox that no asset version holds yet; packages are left out."""
    return files.filter(F.col("path").contains(part) & ~F.lower("extension").isin("zip", "rar", "7z")).join(attached.select(F.col("file_id").alias("id")), "id", "left_anti")


def inbox_status(files: DataFrame, attached: DataFrame, part: str = "/inbox/") -> DataFrame:
    """Discovered and collected inbox files a library."""
    held = attached.select(F.col("file_id").alias("id"), F.lit(True).alias("held")).distinct()
    return files.filter(F.col("path").contains(part)).join(held, "id", "left").groupBy("library_id").agg(F.count_distinct("id").alias("discovered"), count_where(F.col("held")).alias("collected"))


def generation(files: DataFrame, model: str) -> DataFrame:
    """Signature of what a media index row was made from: model, time, size and kind-dependent settings."""
    extra = one_of({"image": "1", "video": "8x0.5", "audio": "30s"}, F.col("kind"), "-")
    return files.select("id", "kind", F.sha2(F.concat_ws("|", F.lit(model), "mtime_s", "size", extra), 256).alias("generation"))


def precedence(files: DataFrame) -> DataFrame:
    """A human caption replaces the model's, marks the stage ready and names its source."""
    manual = present(F.col("manual_caption"))
    return files.select("id", F.coalesce(manual, "caption").alias("caption"), F.when(manual.isNotNull(), "ready").otherwise(F.col("vision_status")).alias("vision_status"), F.when(manual.isNotNull(), "manual").otherwise("model").alias("caption_source"))


def keep_last_good(old: DataFrame, new: DataFrame) -> DataFrame:
    """Publish complete results; an incomplete one leaves the old content and marks the row as an error."""
    o, n = old.alias("o"), new.alias("n")
    has_old, done = F.col("o.content").isNotNull(), F.coalesce(F.col("n.complete"), F.lit(False))
    return o.join(n, "id", "full_outer").select(
        "id", F.when(done, F.col("n.content")).when(has_old, F.col("o.content")).alias("content"),
        F.when(done, "ready").when(F.col("n.complete").isNull(), "unchanged").otherwise("error").alias("state"),
    )


def stale_points(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Points of the old generation that the new one did not write again."""
    return old.join(new.select(*keys), keys, "left_anti")


def listing(files: DataFrame, kind=None, status=None, library_id=None, date_from=None, date_to=None, min_size=None, max_size=None, favorites: DataFrame | None = None, tagged: DataFrame | None = None) -> DataFrame:
    """Catalog rows under optional filters; membership filters are semi joins."""
    tests = [
        (kind, lambda v: F.col("kind") == v), (status, lambda v: F.col("status") == v), (library_id, lambda v: F.col("library_id") == v),
        (date_from, lambda v: F.coalesce("captured_s", "mtime_s") >= v), (date_to, lambda v: F.coalesce("captured_s", "mtime_s") < v),
        (min_size, lambda v: F.col("size") >= v), (max_size, lambda v: F.col("size") <= v),
    ]
    for value, test in tests:
        if value is not None:
            files = files.filter(test(value))
    for members in (favorites, tagged):
        if members is not None:
            files = files.join(members.select(F.col("file_id").alias("id")), "id", "left_semi")
    return files


SORTS = {"newest": lambda: [F.desc(F.coalesce("captured_s", "mtime_s")), F.asc("id")], "oldest": lambda: [F.asc(F.coalesce("captured_s", "mtime_s")), F.asc("id")], "largest": lambda: [F.desc("size"), F.asc("id")], "name": lambda: [F.asc(F.lower("name")), F.asc("id")]}


def page(rows: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order: a top-k, never a full sort of the table."""
    return rows.orderBy(*SORTS[sort]()).offset(offset).limit(limit)


def scoped(files: DataFrame, *members: DataFrame) -> DataFrame:
    """Files that are in every one of the given membership tables (file_id)."""
    for m in members:
        files = files.join(m.select(F.col("file_id").alias("id")), "id", "left_semi")
    return files


def visible(files: DataFrame, users: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, file id) by library grants: an admin sees all; a user without grants sees none.

    Who sees a library is gathered to one row a library, admins to one row in
    all, so that only the files of the result are multiplied.
    """
    admins = users.filter("admin = 1").agg(F.collect_set("user_id").alias("admins"))
    granted = grants.filter("admin = 0").groupBy("library_id").agg(F.collect_set("user_id").alias("granted"))
    f = files.select("id", "library_id").join(granted, "library_id", "left").join(F.broadcast(admins))  # one row
    see = F.array_union(F.coalesce("granted", F.array().cast(granted.schema["granted"].dataType)), F.when(F.col("library_id").isNotNull(), F.col("admins")).otherwise(F.array()))
    return f.select(F.explode(see).alias("user_id"), "id")


#: Most rules that are sent to every task; more are joined by key, with the files of a key dealt over parts of about so many.
FEW_RULES, PART_FILES = 1000, 20_000
#: Most keys of rules that are sent to every task with the files' counts of them.
FEW_KEYS = 500_000
#: About the most rules of the same conditions that are looked up as one.
SET_RULES = 1000
#: Longest run of characters of a name that is a key.
GRAM = 3


def _value(field: str) -> Column:
    """Value of a rule's first condition on a field, null without one."""
    return F.get(F.filter("conditions", lambda c: c["field"] == field), F.lit(0))["value"]


def _bare(extension: Column) -> Column:
    return F.lower(F.ltrim(extension, F.lit(".")))


def _grams(c: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters, as keys."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.concat(F.lit("name "), F.substring(c, i, n))))


def _size_class(size: Column) -> Column:
    """Number of binary digits of a size, 0 for none above zero."""
    return F.when(size <= 0, 0).otherwise(F.length(F.bin(size)))


def _size_keys(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.transform(F.sequence(low, high), lambda n: F.concat(F.lit("size "), n.cast("string")))).otherwise(F.array().cast("array<string>"))


def file_keys(lengths: list[int]) -> Column:
    """Keys of a file: library, extension, kind, size class, and the runs of its name of the given lengths."""
    key = lambda kind, v: F.concat(F.lit(kind), v.cast("string"))
    size = F.coalesce(key("size ", _size_class(F.col("size"))), F.lit("size none"))
    own = F.array(key("library ", F.col("library_id")), key("extension ", F.lower("extension")), key("kind ", F.col("kind")), size)
    name = F.lower("name")
    runs = [F.when(F.length(name) >= n, _grams(name, n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    return F.filter(F.concat(own, *runs), lambda k: k.isNotNull())


def rule_options(rules: DataFrame) -> DataFrame:
    """The rules' columns with (way, keys): ways to find the files of a rule, each by keys of which a matching file has exactly one.

    An equality is one way, each run of a sought part of a name is one, and so is
    the range of sizes with its classes. A rule without conditions has the range
    of all sizes; a rule that nothing can meet has no keys.
    """
    key = lambda kind, v: F.when(v.isNotNull(), F.array(F.concat(F.lit(kind), v.cast("string"))))
    part = F.lower(_value("name_contains"))
    runs = F.when(F.length(part) >= GRAM, _grams(part, GRAM)).when(F.length(part) > 0, F.array(F.concat(F.lit("name "), part)))
    least, most = _value("min_size"), _value("max_size")
    low, high = F.coalesce(_size_class(least.try_cast("long")), F.lit(0)), F.coalesce(_size_class(most.try_cast("long")), F.lit(64))
    sizes = _size_keys(low, high)
    # a file without a size fits where no size is asked for
    sizes = F.when(least.isNull() & most.isNull(), F.array_append(sizes, F.lit("size none"))).otherwise(sizes)
    equal = F.array(key("library ", _value("library_id").try_cast("long")), key("extension ", _bare(_value("extension"))), key("kind ", _value("kind")), sizes)
    ways = F.concat(equal, F.coalesce(F.transform(runs, lambda k: F.array(k)), F.array().cast("array<array<string>>")))
    return rules.select(*rules.columns, F.posexplode(F.filter(ways, lambda w: w.isNotNull())).alias("way", "keys"))


def rule_sets(rules: DataFrame) -> DataFrame:
    """(rule_id, conditions, rules): rules of equal conditions in one row, under the least of their ids; more than about ``SET_RULES`` in several rows."""
    r = rules.select("rule_id", "conditions", F.sha2(F.to_json("conditions"), 256).alias("same"))
    large = r.groupBy("same").agg(F.count("*").alias("n")).filter(F.col("n") > SET_RULES)
    # at most one row a SET_RULES rules goes to every task
    r = r.join(F.broadcast(large), "same", "left").withColumn("deal", F.pmod(F.xxhash64("rule_id"), F.coalesce(F.ceil(F.col("n") / SET_RULES), F.lit(1))))
    return r.groupBy("same", "deal").agg(F.min("rule_id").alias("rule_id"), F.first("conditions").alias("conditions"), F.collect_list("rule_id").alias("rules")).drop("same", "deal")


def matches(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, file id) where all of a rule's conditions hold; no conditions match every file.

    ``rule_id`` is unique. Conditions are structs of field and value: kind, extension, library_id, name_contains, min_size, max_size.
    Rules of equal conditions are looked up as one. Each rule is looked up by the one of its conditions that the fewest files
    meet, by a count over the files' keys; parts of names count by their runs of
    three characters, sizes by their binary digits. What a file meets there is checked in full.
    """
    r = written(rule_sets(rules), "rule-sets")
    seen = r.agg(F.count("*").alias("n"), F.collect_set(F.least(F.length(F.lower(_value("name_contains"))), F.lit(GRAM))).alias("lengths")).first()  # at most GRAM lengths
    few, lengths = seen["n"] <= FEW_RULES, sorted(n for n in seen["lengths"] if n > 0)
    keyed = files.select("id", "kind", "extension", "library_id", "name", "size", F.explode(file_keys(lengths)).alias("key"))
    options = rule_options(r)
    sought = options.select(F.explode("keys").alias("key")).distinct()
    # many rules share a key: where the keys fit in every task, so do their counts; tables of a row a rule are never
    # broadcast, though Spark takes them for as small as the file they come from
    fits = F.broadcast if sought.limit(FEW_KEYS + 1).count() <= FEW_KEYS else lambda df: df.hint("merge")
    sought = fits(sought)
    counts = fits(keyed.join(sought, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")))
    costs = options.select("rule_id", "way", F.explode_outer("keys").alias("key")).join(counts, "key", "left").groupBy("rule_id", "way").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cost"))
    best = costs.groupBy("rule_id").agg(F.min(F.struct("cost", "way")).alias("best")).select("rule_id", F.col("best.way").alias("way"))
    right = options.join(best.hint("merge"), ["rule_id", "way"]).select("rules", "conditions", F.explode("keys").alias("key"))
    if few:
        joined = keyed.join(F.broadcast(right), "key")
    else:
        # a rule is repeated for each part of its key's files only
        parts = fits(counts.select("key", (F.floor(F.col("n") / PART_FILES) + 1).alias("parts")))
        left = keyed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
        right = right.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        joined = left.join(right.hint("merge"), ["key", "part"])

    def holds(c):
        f, v = c["field"], c["value"]
        return (
            F.when(f == "kind", F.col("kind") == v).when(f == "extension", F.lower("extension") == _bare(v))
            .when(f == "library_id", F.col("library_id") == v.try_cast("long")).when(f == "name_contains", F.lower("name").contains(F.lower(v)))
            .when(f == "min_size", F.col("size") >= v.try_cast("long")).when(f == "max_size", F.col("size") <= v.try_cast("long")).otherwise(F.lit(False))
        )

    return joined.filter(F.forall("conditions", lambda c: F.coalesce(holds(c), F.lit(False)))).select(F.explode("rules").alias("rule_id"), F.col("id").alias("file_id"))


def rule_faults(rules: DataFrame) -> DataFrame:
    """Why a rule cannot be used: too many conditions, an unknown field, a blank value, a bad size."""
    known = ("kind", "extension", "library_id", "name_contains", "min_size", "max_size")
    c = F.col("conditions")
    fault = (
        F.when(F.size(c) > 20, "too many conditions").when(F.exists(c, lambda x: ~x["field"].isin(*known)), "unknown field")
        .when(F.exists(c, lambda x: F.trim(x["value"]) == ""), "blank value")
        .when(F.exists(c, lambda x: x["field"].isin("min_size", "max_size") & (F.coalesce(x["value"].try_cast("long"), F.lit(-1)) < 0)), "bad size")
    )
    return rules.select("rule_id", fault.alias("fault")).filter("fault IS NOT NULL")


def located(media: DataFrame) -> DataFrame:
    return media.filter(valid_point(F.col("latitude"), F.col("longitude")))


def current_hits(hits: DataFrame, files: DataFrame) -> DataFrame:
    """Hits whose payload still has the catalog's time (and so content)."""
    f = files.select(F.col("id").alias("file_id"), "mtime_s")
    return hits.join(f, ["file_id", "mtime_s"])


def text_filter(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows with the needle, literally and in any case, in one of the columns."""
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))
    return rows.filter(cond)


def effective_caption(manual: Column, automatic: Column) -> Column:
    return F.coalesce(present(manual), present(automatic), F.lit(""))


def in_window(hour: Column, start: Column, end: Column) -> Column:
    """Whether an hour is in a daily window; equal ends mean always, start after end wraps midnight."""
    return F.when(start == end, F.lit(True)).when(start < end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def first_ids(ids: Column, cap: int) -> Column:
    """Distinct ids in first order, at most ``cap``."""
    return F.slice(F.array_distinct(ids), 1, cap)


def scope_files(space_files: DataFrame, versions: DataFrame, assets: DataFrame, space_id: int | None = None, project_id: int | None = None) -> DataFrame:
    """Distinct files of a space, or of a project's asset versions, or of both scopes at once."""
    parts = []
    if space_id is not None:
        parts.append(space_files.filter(F.col("space_id") == space_id).select("file_id").distinct())
    if project_id is not None:
        mine = assets.filter(F.col("project_id") == project_id).select(F.col("id").alias("asset_id"))
        parts.append(versions.join(mine, "asset_id", "left_semi").select("file_id").distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.intersect(p)
    return out


def normal_time(c: Column) -> Column:
    """ISO text of a time written with colons, dashes or ISO; null if it is none."""
    forms = ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in forms]), "yyyy-MM-dd'T'HH:mm:ss")


def degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds with a hemisphere letter as a signed number."""
    return (d + m / 60.0 + s / 3600.0) * F.when(F.upper(ref).isin("S", "W"), -1.0).otherwise(1.0)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), F.lit("-"))


def normal_tags(tags: Column, longest: int | None = 50, most: int | None = 20) -> Column:
    """Trimmed tags of at most ``longest`` characters, without blanks or repeats, at most ``most``; None: no such limit."""
    cut = F.transform(tags, lambda t: F.trim(t) if longest is None else F.substring(F.trim(t), 1, longest))
    out = F.array_distinct(F.filter(cut, lambda t: t != ""))
    return out if most is None else F.slice(out, 1, most)


def public_view(rows: DataFrame, json_col: str) -> DataFrame:
    """Fixed public columns and the decoded JSON; unreadable JSON becomes an empty map."""
    return rows.withColumn("metadata", F.coalesce(F.from_json(json_col, "map<string,string>"), F.create_map().cast("map<string,string>")))


