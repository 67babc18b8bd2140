"""Places, sessions, identities and timelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_M, haversine_m, ranked, unit, valid_point
from ..functions.session import written
from ..functions.vectors import nearest_centre

HOUR, DAY = 3600, 86_400


def place_clusters(media: DataFrame, grid: float = 0.02) -> DataFrame:
    """One row a grid cell (half-even rounding): centre, members, radius, cover, largest first by the caller."""
    m = media.filter(valid_point(F.col("latitude"), F.col("longitude")))
    m = m.withColumn("gy", F.bround(F.col("latitude") / grid).cast("long")).withColumn("gx", F.bround(F.col("longitude") / grid).cast("long"))
    cover = F.max_by("id", F.struct((F.col("width") * F.col("height")).alias("p"), "t", (-F.col("id")).alias("i")))
    centre = m.groupBy("gy", "gx").agg(F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"), F.count("*").alias("members"), cover.alias("cover"))
    # cells are far fewer than media, but not bounded: Spark chooses the join
    far = place_members(m, centre).groupBy("gy", "gx").agg(F.max("distance_m").alias("radius_m"))
    return centre.join(far, ["gy", "gx"])


def place_members(media: DataFrame, centre: DataFrame) -> DataFrame:
    """Members with their distance to the centre of their cell."""
    c = centre.select("gy", "gx", "lat", "lon")
    return media.join(c, ["gy", "gx"]).select("gy", "gx", "id", haversine_m(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")).alias("distance_m"))


def _ball_cell(lat: Column, lon: Column, side_m: float) -> list[Column]:
    """Cell of a point of the globe in a grid of cubes: two points nearer than the side lie in one cube or in two that touch."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.floor(EARTH_M * x / side_m) for x in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]


def named_places(centre: DataFrame, names: DataFrame, most_m: float = 65_000.0) -> DataFrame:
    """Name of the nearest listed place within reach, else the coordinates.

    Centres meet the places of their own cube of the globe and of the 26
    around it by an equi-join, so neither table needs to be small.
    """
    side, axes = most_m * 1.001, ("cx", "cy", "cz")
    around = names.select(F.col("name").alias("pname"), F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    for axis, cell in zip(axes, _ball_cell(F.col("plat"), F.col("plon"), side)):
        around = around.withColumn(axis, F.explode(F.sequence(cell - 1, cell + 1)))
    own = centre.select("gy", "gx", "lat", "lon", *[c.alias(a) for a, c in zip(axes, _ball_cell(F.col("lat"), F.col("lon"), side))])
    near = own.join(around, list(axes)).withColumn("d", haversine_m(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).filter(F.col("d") <= most_m)
    near = near.groupBy("gy", "gx").agg(F.min_by("pname", F.struct("d", "pname")).alias("pname"))
    out = centre.join(near, ["gy", "gx"], "left")
    return out.select("gy", "gx", F.coalesce("pname", F.format_string("%.3f, %.3f", "lat", "lon")).alias("name"))


def _length_parts(times: DataFrame, longest_s: int) -> DataFrame:
    """(_k, t, part) of the times (_k, t) of long runs: a part ends where a time lies more than ``longest_s`` beyond its first one.

    Each time points to the first one beyond its reach. The parts' first times
    are a chain of such steps from the run's first time; with every round the
    known part of the chain and the length of a step double.
    """
    run = Window.partitionBy("_k").orderBy("t")
    step = written(times.select("_k", "t", F.min("t").over(run.rangeBetween(longest_s + 1, Window.unboundedFollowing)).alias("to")).filter("to IS NOT NULL"), "steps")
    first = written(times.groupBy("_k").agg(F.min("t").alias("t")), "starts")
    while not (more := written(first.join(step, ["_k", "t"]).select("_k", F.col("to").alias("t")), "starts")).isEmpty():
        first = first.unionByName(more)
        step = written(step.join(step.select("_k", F.col("t").alias("to"), F.col("to").alias("further")), ["_k", "to"]).select("_k", "t", F.col("further").alias("to")), "steps")
    marked = times.join(first.withColumn("begins", F.lit(1)), ["_k", "t"], "left")
    return marked.select("_k", "t", (F.sum(F.coalesce("begins", F.lit(0))).over(run) - 1).alias("part"))


def event_sessions(media: DataFrame, by: str = "library_id", gap_s: int = 12 * HOUR, longest_s: int | None = 7 * DAY, near_gap_s: int = 2 * HOUR, far_m: float = 80_000.0) -> DataFrame:
    """Media with their session: ``run`` by gap and distance cuts, ``part`` by the length cut.

    A session ends after a gap of 12 hours, or of 2 hours with a move of 80 km.
    Rows are sorted inside a library's day; days are then put in a row by a
    table of one row a day, so that a hot library spreads over its days. A run
    whose whole span is within 7 days is one session; longer runs are cut by steps
    between their distinct times, which double in length. Without ``longest_s`` no run is cut by its length.
    """
    place = F.struct("t", "latitude", "longitude", valid_point(F.col("latitude"), F.col("longitude")).alias("ok"))
    m = media.withColumn("_day", F.floor(F.col("t") / DAY)).withColumn("_at", place)

    def cut(was: Column, now: Column) -> Column:
        gap = now["t"] - was["t"]
        moved = now["ok"] & was["ok"] & (haversine_m(now["latitude"], now["longitude"], was["latitude"], was["longitude"]) > far_m)
        return F.coalesce((gap > gap_s) | ((gap > near_gap_s) & F.coalesce(moved, F.lit(False))), F.lit(False)).cast("long")

    w = Window.partitionBy(by, "_day").orderBy("t", "id")
    m = m.withColumn("_cut", cut(F.lag("_at").over(w), F.col("_at"))).withColumn("_inner", F.sum("_cut").over(w))
    order = F.struct("t", "id")
    days = m.groupBy(by, "_day").agg(F.min_by("_at", order).alias("first"), F.max_by("_at", order).alias("last"), F.sum("_cut").alias("cuts"))
    row = Window.partitionBy(by).orderBy("_day")
    days = days.withColumn("start", cut(F.lag("last").over(row), F.col("first")))
    days = days.select(F.col(by).alias("_by"), F.col("_day").alias("_d"), (F.sum(F.col("start") + F.col("cuts")).over(row) - F.col("cuts")).alias("_before"))
    m = m.join(days, F.col(by).eqNullSafe(F.col("_by")) & F.col("_day").eqNullSafe(F.col("_d"))).select(*media.columns, (F.col("_before") + F.col("_inner")).alias("run"))
    if longest_s is None:
        return m.withColumn("part", F.lit(0).cast("long"))
    spans = m.groupBy(F.col(by).alias("_by"), F.col("run").alias("_run")).agg((F.max("t") - F.min("t")).alias("span"))
    long = spans.filter(F.col("span") > longest_s).select("_by", "_run")
    on = F.col(by).eqNullSafe(F.col("_by")) & (F.col("run") == F.col("_run"))
    times = m.join(long, on, "left_semi").select(F.col(by).alias("_by"), F.col("run").alias("_run"), F.col("t").alias("_t")).distinct()
    times = times.select(F.struct("_by", "_run").alias("_k"), F.col("_t").alias("t"))
    parts = _length_parts(written(times, "long-runs"), longest_s).select(F.col("_k._by").alias("_by"), F.col("_k._run").alias("_run"), F.col("t").alias("_t"), "part")
    out = m.join(parts, on & (F.col("t") == F.col("_t")), "left")
    return out.select(*media.columns, "run", F.coalesce("part", F.lit(0)).cast("long").alias("part"))


def session_summary(sessions: DataFrame, by: str = "library_id", least: int = 3, grid: float = 0.05) -> DataFrame:
    """Start, end, mean of the valid points, cell of that mean, cover and members of sessions of at least ``least``.

    A session's rows are added up in order of time and id, so its means do not depend on how rows were dealt.
    """
    ok = valid_point(F.col("latitude"), F.col("longitude"))
    s = sessions.select(by, "run", "part", "id", "t", "latitude", "longitude", "width", "height").repartition(by, "run").sortWithinPartitions(by, "run", "t", "id")
    s = s.groupBy(by, "run", "part").agg(
        F.min("t").alias("start_t"), F.max("t").alias("end_t"), F.count("*").alias("members"), F.avg(F.when(ok, F.col("latitude"))).alias("lat"), F.avg(F.when(ok, F.col("longitude"))).alias("lon"),
        F.max_by("id", F.struct((F.col("width") * F.col("height")).alias("p"), (-F.col("id")).alias("i"))).alias("cover"), F.min("id").alias("first_id"),
    )
    cell = F.concat_ws(":", F.bround(F.col("lat") / grid).cast("long"), F.bround(F.col("lon") / grid).cast("long"))
    return s.filter(F.col("members") >= least).withColumn("cell", F.when(F.col("lat").isNotNull(), cell))


def session_names(summary: DataFrame) -> DataFrame:
    """Date or date range; the time is added where names collide."""
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
    name = F.when(at("start_t") == at("end_t"), at("start_t")).otherwise(F.concat(at("start_t"), F.lit(" - "), at("end_t")))
    s = summary.withColumn("name", name)
    again = F.count("*").over(Window.partitionBy("name")) > 1
    return s.withColumn("name", F.when(again, F.concat("name", F.lit(" "), F.date_format(F.timestamp_seconds("start_t"), "HH:mm"))).otherwise(F.col("name")))


def named_preserving(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert recomputed groups by key: names given by people survive; unnamed ones not recomputed go."""
    o, n = old.alias("o"), new.alias("n")
    merged = o.join(n, "key", "full_outer").filter("n.key IS NOT NULL OR o.named")
    return merged.select("key", F.when(F.col("o.named"), F.col("o.name")).otherwise(F.coalesce("n.name", "o.name")).alias("name"), F.coalesce("n.members", "o.members").alias("members"), F.coalesce("o.named", F.lit(False)).alias("named"))


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """(label, c): unit mean of each label's vectors, part by part."""
    parts = vectors.filter(F.col(label).isNotNull()).select(label, F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("p", "x"))
    mean = parts.groupBy(label, "p").agg(F.avg("x").alias("x"))
    c = mean.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"))
    return c.select(label, unit(F.transform("c", lambda s: s["x"])).alias("c"))


def identified(vectors: DataFrame, centre: DataFrame, threshold: float = 0.45, label: str = "label") -> DataFrame:
    """Each vector's best identity and score, where the score reaches the threshold; blocks of identities meet batches of vectors."""
    best = nearest_centre(vectors, centre.withColumnRenamed(label, "identity"), 20_000)
    return best.filter(F.col("score") >= threshold)


def _lead(threshold: float):
    """The fold over a frame of (block, vec_id, embedding): each vector joins the cluster of the nearest mean that reaches the threshold, the later one of equals, or leads a new one."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        sums, units = np.zeros((0, 0)), np.zeros((0, 0))
        leader, of = [], []
        for i, v in zip(pdf["vec_id"], pdf["embedding"]):
            v = np.asarray(v, float)
            n = len(leader)
            if not n:
                sums, units = np.zeros((16, len(v))), np.zeros((16, len(v)))
            s = units[:n] @ v
            k = n - 1 - int(s[::-1].argmax()) if n else -1
            if k < 0 or s[k] < threshold:
                if n == len(sums):  # room doubles
                    sums, units = (np.concatenate([x, np.zeros_like(x)]) for x in (sums, units))
                k = n
                leader.append(i)
            sums[k] += v
            units[k] = sums[k] / max(np.linalg.norm(sums[k]), 1e-12)
            of.append(leader[k])
        return pd.DataFrame({"block": pdf["block"], "vec_id": pdf["vec_id"], "cluster": of})

    return run


def leader_clusters(vectors: DataFrame, block: str, threshold: float = 0.45) -> DataFrame:
    """Leader clustering in id order inside each block: (block, vec_id, cluster = id of its leader).

    Vectors of a block have one length; blocks must fit a task.
    """
    src = vectors.select(F.col(block).cast("long").alias("block"), "vec_id", "embedding")
    return src.groupBy("block").applyInPandas(_lead(threshold), "block long, vec_id long, cluster long")


def _sums(members: DataFrame) -> DataFrame:
    """(cluster, p, x): sum of each part of the members' vectors (cluster, embedding), added up batch by batch first."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            names, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            rows = np.vstack(b.column(1).to_numpy(zero_copy_only=False)).astype(float)
            out = np.zeros((len(names), rows.shape[1]))
            np.add.at(out, at, rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, rows.shape[1])), pa.array(np.tile(np.arange(rows.shape[1], dtype=np.int32), len(names))), pa.array(out.ravel())], names=["cluster", "p", "x"])

    return members.select("cluster", "embedding").mapInArrow(run, "cluster long, p int, x double").groupBy("cluster", "p").agg(F.sum("x").alias("x"))


def _centres(sums: DataFrame) -> DataFrame:
    """(identity, c): the direction of each cluster's sum."""
    c = sums.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c"))
    return c.select(F.col("cluster").alias("identity"), unit(F.transform("c", lambda s: s["x"])).alias("c"))


#: Clusters whose means go to every task at once.
CENTRE_BLOCK = 20_000


def global_clusters(vectors: DataFrame, threshold: float = 0.45, block_rows: int = 8192, growth: float = 1.5) -> DataFrame:
    """Leader clusters of all vectors in id order: (block = 0, vec_id, cluster = id of its leader).

    The first ``block_rows`` vectors are clustered one by one. What follows comes
    in epochs, each ``growth`` - 1 times as large as all before it. A vector of an
    epoch joins the nearest mean as it stood before the epoch, if that reaches
    the threshold. Of the others the first ``block_rows`` are clustered one by
    one, and every vector of the epoch behind a new leader moves to its cluster
    where that is nearer; so on until each has a cluster. Clusters are never
    joined, so that no chain of means forms. A vector sees the means of
    clusters led by smaller ids only; of equally near ones the later is taken.

    One pass and epochs differ where a mean moves within an epoch. Null and
    empty vectors, and rows without an id, are left out; vectors have one length; an id occurs once.
    """
    v = vectors.filter("vec_id IS NOT NULL AND size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    v = written(numbered(v.withColumn("all", F.lit(0)), "all", "vec_id").select("vec_id", "embedding", "number"), "in-order")
    total = v.count()

    def folded(rows: DataFrame, name: str) -> DataFrame:
        own = leader_clusters(rows.withColumn("block", F.lit(0)), "block", threshold).select("vec_id", "cluster")
        return written(own.join(rows, "vec_id"), name)

    first = folded(v.filter(F.col("number") <= block_rows), "leaders")
    found, sums = first.select("vec_id", "cluster"), written(_sums(first), "sums")
    at = block_rows
    while at < total:
        end = max(at + 1, int(at * growth))
        part = written(v.filter((F.col("number") > at) & (F.col("number") <= end)).repartition("vec_id"), "epoch")
        near = nearest_centre(part, _centres(sums), CENTRE_BLOCK, threshold, True).withColumnRenamed("identity", "cluster")
        part = written(part.join(near, "vec_id", "left"), "epoch")
        while not (open_ := part.filter("cluster IS NULL")).isEmpty():
            head = folded(open_.select("vec_id", "embedding", "number").orderBy("number").limit(block_rows), "leaders")
            new = nearest_centre(part, _centres(_sums(head)), CENTRE_BLOCK, threshold, True).select("vec_id", F.col("identity").alias("nearer"), F.col("score").alias("s"))
            own = head.select("vec_id", F.col("cluster").alias("own"))
            j = part.join(new, "vec_id", "left").join(own, "vec_id", "left")
            moves = F.col("nearer").isNotNull() & (F.col("score").isNull() | (F.col("s") >= F.col("score")))
            # what was clustered one by one stays in its cluster for the epoch
            part = written(j.select("vec_id", "embedding", "number", F.coalesce("own", F.when(moves, F.col("nearer")).otherwise(F.col("cluster"))).alias("cluster"), F.when(F.col("own").isNotNull(), F.lit(float("inf"))).when(moves, F.col("s")).otherwise(F.col("score")).alias("score")), "epoch")
        found = found.unionByName(part.select("vec_id", "cluster"))
        sums = written(sums.unionByName(_sums(part)).groupBy("cluster", "p").agg(F.sum("x").alias("x")), "sums")
        at = end
    return found.select(F.lit(0).cast("long").alias("block"), "vec_id", "cluster")


def identities(clusters: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of at least two, numbered by size inside their block."""
    c = clusters.groupBy("block", "cluster").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return numbered(c, "block", F.desc("size"), "cluster")


def numbered(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """Rows with their ``number`` from 1 within ``by`` in a total order: a distributed sort, then the counts of its parts are added up."""
    s = rows.orderBy(by, *order).withColumn("_at", F.monotonically_increasing_id())
    s = written(s.withColumn("_part", F.shiftright("_at", 33)), "sorted")
    # one row for each part of the sort and block in it
    parts = s.groupBy("_part", F.col(by).alias("_by")).agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.sum("n").over(Window.partitionBy("_by").orderBy("_part")) - F.col("n")
    parts = parts.select("_part", "_by", "_first", before.alias("_before"))
    s = s.withColumnRenamed("_part", "_p")
    out = s.join(parts, (F.col("_p") == F.col("_part")) & F.col(by).eqNullSafe(F.col("_by")))
    return out.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("number"))


def identity_rollup(faces: DataFrame, hidden: list[int] = ()) -> DataFrame:
    """Faces, distinct files and cover of each identity that is not hidden."""
    f = faces.filter(~F.col("identity").isin(list(hidden)) if hidden else F.lit(True))
    return f.groupBy("identity").agg(F.count("*").alias("faces"), F.count_distinct("file_id").alias("files"), F.max_by("face_id", F.struct("weight", (-F.col("face_id")).alias("i"))).alias("cover"))


def identity_members(faces: DataFrame, files: DataFrame, cap: int = 500) -> DataFrame:
    """One row a file of an identity with its smallest face, newest first, at most ``cap`` each."""
    m = faces.groupBy("identity", "file_id").agg(F.min("face_id").alias("face_id")).join(files.select(F.col("id").alias("file_id"), "mtime_s"), "file_id")
    return m.withColumn("place", ranked("identity", F.desc("mtime_s"), "file_id")).filter(F.col("place") <= cap)


def merged(members: DataFrame, relabel: DataFrame) -> DataFrame:
    """Members after groups are merged: sources take the target's number, repeats go."""
    m = members.join(relabel.select(F.col("source").alias("group_id"), "target"), "group_id", "left")
    return m.select(F.coalesce("target", "group_id").alias("group_id"), "id").distinct()


def split(members: DataFrame, group_id: int, ids: DataFrame, new_id: int) -> DataFrame:
    """Members after a subset of one group moves to a new one; ids that are not in the group are ignored."""
    moving = ids.select("id", F.lit(True).alias("moves"))
    m = members.join(moving, "id", "left")
    return m.select(F.when((F.col("group_id") == group_id) & F.col("moves"), F.lit(new_id)).otherwise(F.col("group_id")).cast("long").alias("group_id"), "id")


def group_listing(members: DataFrame, files: DataFrame) -> DataFrame:
    """Groups with a visible member: how many, and the newest as cover."""
    m = members.join(files.select("id", "mtime_s"), "id")
    return m.groupBy("group_id").agg(F.count("*").alias("visible"), F.max_by("id", F.struct("mtime_s", (-F.col("id")).alias("i"))).alias("cover"))


def effective_s():
    return F.coalesce("captured_s", "mtime_s")


def timeline(files: DataFrame, year: int | None = None, month: int | None = None, kind: str | None = None) -> DataFrame:
    """Files with their day, filtered by year, month and kind."""
    f = files.withColumn("at", F.timestamp_seconds(effective_s()))
    for value, col in ((year, F.year("at")), (month, F.month("at")), (kind, F.col("kind"))):
        if value is not None:
            f = f.filter(col == value)
    return f.withColumn("day", F.date_format("at", "yyyy-MM-dd"))


def year_histogram(files: DataFrame, kind: str | None = None) -> DataFrame:
    """Files a year; the year and month filters of the timeline do not apply."""
    return timeline(files, kind=kind).groupBy(F.year("at").alias("year")).agg(F.count("*").alias("n"))


def scan_candidates(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Images never scanned, changed since their scan, or whose scan failed."""
    s = scans.select("id", F.col("mtime_s").alias("seen_s"), F.col("failed"))
    return files.filter("kind = 'image'").join(s, "id", "left").filter("seen_s IS NULL OR seen_s <> mtime_s OR failed").select("id")
