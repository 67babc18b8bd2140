"""Mixing sources to target weights by Pareto order sampling: DataFrame functions only.

Each source gets a target of words. Inside a source the expected number of
copies of a document grows with its importance, up to a limit, so that expected
words add up to the target. Whole copies are certain. For the rest, documents
are ranked by the odds of a uniform number over the odds of their own inclusion
probability, and the smallest ranks are taken until the source's remaining
words are filled. The place in the ranking where a source is full is found by
histograms of the rank at rising resolution, so that no source is ever sorted
in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved

#: Weights of the sources in the order of their names, and the most times a source may repeat.
WEIGHTS, MAX_REPEAT = (5, 2, 1), 3
#: Most rows of the tables of sources and their grades of importance are sent to every task; beyond, Spark chooses the join.
FEW_SOURCES = 100_000
#: Bits of the rank that each histogram tells apart, and how many histograms follow one another.
STEP_BITS, STEPS = 12, 4


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in (0, 1) from the MD5 of the id: the same in every run and in SQL."""
    hex13 = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"#{seed}"))), 1, 13)
    return (F.conv(hex13, 16, 10).cast("double") + 0.5) / float(1 << 52)


def importance(size: Column) -> Column:
    """A document's importance: the number of binary digits of its size, so that longer texts are favoured mildly.

    It takes few values, which keeps the table of grades small.
    """
    return F.length(F.bin(size)).cast("long")


def filled(rows: DataFrame, part: list[str], total: Column, weight: str, limit: str, name: str, tie: str) -> DataFrame:
    """Rows with the share ``name`` of ``total``: by weight, none above its limit, the excess shared again (closed form).

    Sorted by limit over weight, a row is at its limit if the level at its place exceeds it.
    """
    window = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    by = window.orderBy(F.col(limit) / F.col(weight), F.col(tie).asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (total - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum(weight).over(after))
    # the first place where the level no longer reaches the limit sets the level of all that follow
    open_ = F.col("_level") * F.col(weight) <= F.col(limit)
    rows = rows.withColumn("_final", F.first(F.when(open_, F.col("_level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn(name, F.coalesce(F.least(F.col(limit), F.col("_final") * F.col(weight)), F.col(limit))).drop("_level", "_final")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of their names (null last) weigh ``weights``, repeating.
    All sizes are shared by weight, but none gets more than ``max_repeat`` times
    its size; what is above is shared among the rest.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    # one row a source from here on
    name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("limit", F.col("source_size") * float(max_repeat))
    return filled(per, [], F.sum("source_size").over(Window.partitionBy(F.lit(0))), "w", "limit", "target", "source").select("source", "source_size", "target")


def grades(sizes: DataFrame, goal: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, grade, source_size, target, certain, p, room): certain copies and inclusion probability of each grade.

    Expected copies are proportional to the grade and at most ``max_repeat``;
    their words add up to the source's target. ``room`` is what certain copies leave of it.
    """
    per = sizes.groupBy("source", "grade").agg(F.sum("size").cast("long").alias("grade_size")).filter("grade_size > 0")
    per = per.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    per = per.withColumn("w", F.col("grade") * F.col("grade_size").cast("double")).withColumn("limit", F.col("grade_size") * float(max_repeat))
    per = filled(per, ["source"], F.col("target"), "w", "limit", "share", "grade").withColumn("copies", F.col("share") / F.col("grade_size"))
    per = per.withColumn("certain", F.floor("copies"))
    spent = F.sum(F.col("certain") * F.col("grade_size")).over(Window.partitionBy("source"))
    return per.select("source", "grade", "source_size", "target", "certain", (F.col("copies") - F.col("certain")).alias("p"), (F.col("target") - spent).alias("room"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Copies of every document in the mix: id, source, size, source_size, target, copies, taken.

    ``copies`` is from 0 to ``max_repeat``; ``taken`` is copies times size. A
    null text has size 0; null is a source of its own, ordered last; documents
    of size 0 get no copies and belong to their source all the same. Ranks come
    from the id alone, so reruns agree; rows of one id and grade tie and are
    taken in one order of size. Each row keeps its own columns named in
    ``keep``, other extra columns are ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), *([F.struct(*keep).alias("_row")] if keep else []))
    d = saved(d.withColumn("grade", importance(F.col("size"))), "mix-sizes")
    total = saved(targets(d, weights, max_repeat), "mix-targets")
    goal = saved(grades(d, total, max_repeat), "mix-grades")
    few = max(t.limit(FEW_SOURCES + 1).count() for t in (total, goal)) <= FEW_SOURCES
    sent = lambda x: F.broadcast(x) if few else x
    # key of the ranking, folded into 48 bits: u-odds over p-odds, as q / (1 + q)
    u = uniform(F.col("id"), seed)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    bits = STEP_BITS * STEPS
    ranked = d.join(sent(total.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = goal.select(F.col("source").alias("s"), F.col("grade").alias("g"), "certain", "p")
    ranked = ranked.join(sent(own), F.col("source").eqNullSafe(F.col("s")) & (F.col("grade") == F.col("g")) & (F.col("size") > 0), "left").drop("s", "g")
    ranked = ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), F.floor(q / (1 + q) * float(1 << bits)).cast("long")))
    # histograms: at each step the bin in which the source's room ends, and what lies before it
    cut = goal.select("source", "room").distinct().select("source", "room", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for step in range(1, STEPS + 1):
        shift = bits - STEP_BITS * step
        c = cut.select(F.col("source").alias("s"), "room", "prefix", "before")
        inside = ranked.filter("rank IS NOT NULL").join(sent(c), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("rank", shift + STEP_BITS) == F.col("prefix")))
        bins = inside.groupBy("source", "room", "before", F.shiftright("rank", shift).alias("bin")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bin")
        bins = bins.withColumn("upto", F.col("before") + F.sum("words").over(run))
        # the first bin that reaches the room, else the last one there is
        full = F.min(F.when(F.col("upto") >= F.col("room"), F.col("bin"))).over(Window.partitionBy("source"))
        last = F.max("bin").over(Window.partitionBy("source"))
        found = bins.withColumn("at", F.coalesce(full, last)).filter("bin = at")
        cut = saved(found.select("source", "room", F.col("bin").alias("prefix"), (F.col("upto") - F.col("words")).cast("long").alias("before")), "mix-cut")
    # only documents of equal 48-bit rank are left to be ordered
    c = cut.select(F.col("source").alias("s"), F.col("prefix"), F.col("before"), F.col("room").alias("r"))
    edge = ranked.filter("rank IS NOT NULL").join(sent(c), F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("prefix")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, 0))
    edge = edge.withColumn("upto", upto).filter(F.col("upto") - F.col("size") / 2 <= F.col("r")).groupBy("source").agg(F.max(F.struct("id", "size")).alias("edge_last"))
    c = c.drop("before", "r").join(edge.withColumnRenamed("source", "es"), F.col("s").eqNullSafe(F.col("es")), "left").select("s", "prefix", "edge_last")
    out = ranked.join(sent(c), F.col("source").eqNullSafe(F.col("s")), "left")
    taken = F.coalesce((F.col("rank") < F.col("prefix")) | ((F.col("rank") == F.col("prefix")) & (F.struct("id", "size") <= F.col("edge_last"))), F.lit(False))
    copies = (F.coalesce("certain", F.lit(0)) + taken.cast("int")).cast("int")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[F.col("_row")[k].alias(k) for k in keep])


def oracle_sql(size: str, table: str = "documents", id_col: str = "doc_id", keep: str = "", seed: int = 0) -> str:
    """DuckDB SQL for the same result, ``size`` being the expression of a document's words."""
    n = len(WEIGHTS)
    w = " ".join(f"WHEN {i} THEN {x}.0" for i, x in enumerate(WEIGHTS))
    return f"""
WITH d AS (SELECT {keep}{id_col}, source, CAST({size} AS BIGINT) AS size FROM {table}),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} {w} END AS w, source_size * {float(MAX_REPEAT)} AS lim FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(lim) OVER b, 0.0)) / sum(w) OVER a AS level FROM w
  WINDOW b AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, first(CASE WHEN level * w <= lim THEN level END IGNORE NULLS) OVER (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fin FROM l),
t AS (SELECT source AS ts, source_size, coalesce(least(lim, fin * w), lim) AS target FROM f),
y AS (SELECT source AS gs, length(bin(size)) AS grade, CAST(sum(size) AS BIGINT) AS grade_size FROM d GROUP BY ALL HAVING sum(size) > 0),
v AS (SELECT gs, grade, grade_size, target, grade * CAST(grade_size AS DOUBLE) AS gw, grade_size * {float(MAX_REPEAT)} AS glim FROM y JOIN t ON gs IS NOT DISTINCT FROM ts),
lv AS (SELECT *, (target - coalesce(sum(glim) OVER b, 0.0)) / sum(gw) OVER a AS level FROM v
  WINDOW b AS (PARTITION BY gs ORDER BY glim / gw, grade ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         a AS (PARTITION BY gs ORDER BY glim / gw, grade ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
fv AS (SELECT *, first(CASE WHEN level * gw <= glim THEN level END IGNORE NULLS) OVER (PARTITION BY gs ORDER BY glim / gw, grade ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fin FROM lv),
ev AS (SELECT *, coalesce(least(glim, fin * gw), glim) / grade_size AS e FROM fv),
h AS (SELECT gs, grade, floor(e) AS certain, e - floor(e) AS p, target - sum(floor(e) * grade_size) OVER (PARTITION BY gs) AS room FROM ev),
u AS (SELECT d.*, source_size, target, coalesce(certain, 0) AS certain, p, room, (CAST(CAST('0x' || substr(md5(coalesce(CAST({id_col} AS VARCHAR), '') || '#{seed}'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN t ON source IS NOT DISTINCT FROM ts LEFT JOIN h ON source IS NOT DISTINCT FROM gs AND grade = length(bin(size)) AND size > 0),
q AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM u),
r AS (SELECT *, CASE WHEN q IS NOT NULL THEN CAST(floor(q / (1 + q) * {float(1 << STEP_BITS * STEPS)}) AS BIGINT) END AS rank FROM q),
c AS (SELECT *, CASE WHEN rank IS NOT NULL THEN sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, {id_col}, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM r),
x AS (SELECT *, CAST(certain + CASE WHEN rank IS NOT NULL AND upto - size / 2.0 <= room THEN 1 ELSE 0 END AS INT) AS copies FROM c)
SELECT {keep}{id_col}, source, size, source_size, target, copies, CAST(copies * size AS BIGINT) AS taken FROM x"""
