"""Exact and near duplicates of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from ..functions.session import written

#: Bits of each band of a 64-bit fingerprint: of fingerprints up to 9 bits apart one band differs in at most one.
BANDS = (13, 13, 13, 13, 12)


def survivors(files: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their keys with another row: one aggregate, then a semi join."""
    return files.join(files.groupBy(*keys).count().filter("count > 1").select(*keys), keys, "left_semi")


def exact_groups(files: DataFrame) -> DataFrame:
    """Staged exact duplicates: same non-zero size, then same quick hash, then same content hash; later stages see survivors only."""
    by_size = survivors(files.filter("size > 0"), ["size"])
    return survivors(survivors(by_size, ["size", "quick_hash"]), ["size", "content_hash"])


def quick_hash(size: Column, text: Column, part: int = 1 << 20) -> Column:
    """Hash of the size, the head and, if there is more, the tail."""
    tail = F.when(F.length(text) > 2 * part, F.substring(text, -part, part)).otherwise(F.lit(""))
    return F.sha2(F.concat(size.cast("string"), F.lit("|"), F.substring(text, 1, part), F.lit("|"), tail), 256)


def duplicate_report(files: DataFrame) -> DataFrame:
    """One row a group of equal content: members, bytes that could go, members by time."""
    g = files.filter("size > 0").groupBy("content_hash", "size").agg(F.count("*").alias("member_count"), F.array_sort(F.collect_list(F.struct("mtime_s", "id"))).alias("m"))
    return g.filter("member_count > 1").select("content_hash", "size", "member_count", ((F.col("member_count") - 1) * F.col("size")).alias("reclaimable"), F.transform("m", lambda s: s["id"]).alias("members"))


def keepers(files: DataFrame) -> DataFrame:
    """The copy to keep of each group: not named as a copy, with a capture time, most pixels, shortest path, oldest, smallest id."""
    copy = F.lower("name").rlike(r"copy|副本|\(\d+\)")
    order = F.struct((~copy).alias("a"), F.col("captured_s").isNotNull().alias("b"), (F.col("width") * F.col("height")).alias("c"), (-F.length("path")).alias("d"), (-F.col("mtime_s")).alias("e"), (-F.col("id")).alias("f"))
    return exact_groups(files).groupBy("content_hash", "size").agg(F.max_by("id", order).alias("keep"), F.count("*").alias("n"))


def simhash(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, fp): 64-bit fingerprint of a text's set of words; bit by bit the sign of a sum over word hashes."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_col), F.lit(r"([a-z0-9À-ɏ]+)"), 1))).alias("w"))
    h = words.select("id", F.unhex(F.substring(F.md5("w"), 1, 16)).alias("b"))
    num = F.conv(F.hex("b"), 16, -10).cast("long")
    signs = [F.sum(F.when(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"s{k}") for k in range(64)]
    sums = h.select("id", num.alias("h")).groupBy("id").agg(*signs)
    fp = F.lit(0).cast("long")
    for k in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"s{k}") > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return sums.select("id", fp.alias("fp"))


def bands(fp: Column, near: bool = False) -> Column:
    """(band, key) structs of a fingerprint; with ``near`` also those of keys that differ in one bit."""
    out, at = [], 0
    for i, width in enumerate(BANDS):
        key = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        out += [F.struct(F.lit(i).alias("band"), k.alias("key")) for k in [key, *([key.bitwiseXOR(F.lit(1 << b)) for b in range(width)] if near else [])]]
        at += width
    return F.array(*out)


def near_pairs(prints: DataFrame, max_distance: int = 8) -> DataFrame:
    """(a, b, distance) of distinct fingerprints at most ``max_distance`` bits apart, a < b.

    Of five bands one differs in a bit at most if the fingerprints differ in up
    to nine; a larger distance is refused. One side is indexed by its own keys,
    the other looks up all keys one bit away. Equal fingerprints are one
    fingerprint here, so a large group of copies makes no pairs.
    """
    if max_distance >= 2 * len(BANDS) - 1:
        raise ValueError(f"{len(BANDS)} bands find distances up to {2 * len(BANDS) - 2}")
    fps = prints.groupBy("fp").agg(F.min("id").alias("id"))
    keyed = lambda near: fps.select("id", "fp", F.explode(bands(F.col("fp"), near)).alias("x")).select("id", "fp", "x.band", "x.key")
    a, b = keyed(True).alias("a"), keyed(False).alias("b")
    dist = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp")))
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (dist <= max_distance)
    return a.join(b, on).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), dist.alias("distance")).distinct()


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, root): smallest id reachable. Label propagation with pointer jumping over written tables, until no label changes."""
    both = written(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    label = written(nodes.select("id", F.col("id").alias("root")).distinct(), "labels")
    while True:
        near = both.join(label.withColumnsRenamed({"id": "b", "root": "r"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("r").alias("r"))
        step = label.join(near, "id", "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("r", "root")).alias("root"))
        up = label.select(F.col("id").alias("root"), F.col("root").alias("up"))
        step = written(step.join(up, "root", "left").select("id", "was", F.least("root", F.coalesce("up", "root")).alias("root")), "labels")
        label = step.select("id", "root")
        if step.filter("root <> was").isEmpty():
            return label


def similar_groups(prints: DataFrame, max_distance: int = 8) -> DataFrame:
    """(group_id, id, distance) of near-duplicate groups of at least two: single linkage, distance to the smallest id.

    Distances inside a group can exceed the limit, as links chain.
    """
    prints = written(prints.select("id", "fp"), "prints")
    fps = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    pairs = written(near_pairs(prints, max_distance), "near-pairs")
    # fingerprints without a pair stay alone
    tied = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    comp = components(tied, pairs)
    all_ids = prints.join(fps, "fp").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("id", "fp", F.coalesce("root", "rep").alias("group_id"))
    sizes = all_ids.groupBy("group_id").count().filter("count > 1").select("group_id")
    first = prints.select(F.col("id").alias("group_id"), F.col("fp").alias("fp0"))
    return all_ids.join(sizes, "group_id").join(first, "group_id").select("group_id", "id", F.bit_count(F.col("fp").bitwiseXOR(F.col("fp0"))).alias("distance"))


def unprinted(files: DataFrame, prints: DataFrame) -> DataFrame:
    """Files that have no fingerprint yet."""
    return files.join(prints.select("id"), "id", "left_anti")


def sign_print(v: Column) -> Column:
    """Fingerprint of a 64-part vector: one bit a sign."""
    return F.aggregate(F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def group_report(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Groups with at least two of the given files, their count and farthest distance."""
    return groups.join(files.select("id"), "id", "left_semi").groupBy("group_id").agg(F.count("*").alias("members"), F.max("distance").alias("farthest")).filter("members > 1")


def refreshed(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups after deletes: members recounted, groups below two gone."""
    left = groups.join(removed.select("id"), "id", "left_anti")
    return left.join(left.groupBy("group_id").count().filter("count > 1").select("group_id"), "group_id", "left_semi")


def unsafe_deletes(files: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected rows that may not go: no content hash, or no unselected copy of the same hash and size."""
    s = files.join(selected.select("id"), "id", "left_semi")
    rest = files.join(selected.select("id"), "id", "left_anti").filter("content_hash IS NOT NULL").select("content_hash", "size")
    return s.join(rest, ["content_hash", "size"], "left_anti").select("id")


def largest_first(groups: DataFrame, limit: int) -> DataFrame:
    return groups.orderBy(F.desc("reclaimable"), "content_hash").limit(limit)


