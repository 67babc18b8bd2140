"""Evaluation of retrieval and of answers against expected results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where
from ..functions.session import small, written

#: Size parameter of a quantile sketch, and the share of ranks on either side of a wanted one in which it is looked for.
SKETCH, MARGIN = 400, 0.03
#: Evenly spaced ranks at which a sketch is read.
STEPS = 400
#: Most values that are sorted in one task to find a wanted one.
MOST = 100_000


def search_evaluation(results: DataFrame, cases: DataFrame, top_k: int = 5, least_confidence: float = 0.0) -> DataFrame:
    """One row a case: first matching rank, recall at k, reciprocal rank, forbidden first hit, pass flag.

    ``results``: query_id, rank, name, confidence. ``cases``: query_id, expected array, forbidden array of name parts.
    """
    top = results.filter(F.col("rank") <= top_k)
    j = cases.join(top, "query_id", "left")
    low = F.lower("name")
    hit = lambda words: F.exists(words, lambda e: low.contains(F.lower(e)))
    found = F.filter("expected", lambda e: low.contains(F.lower(e)))
    a = j.groupBy("query_id").agg(
        F.min(F.when(hit("expected"), F.col("rank"))).alias("first_rank"), F.size(F.array_distinct(F.flatten(F.collect_list(found)))).alias("found"), F.first("expected").alias("expected"),
        F.coalesce(F.bool_or((F.col("rank") == 1) & hit("forbidden")), F.lit(False)).alias("forbidden_first"), F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("confidence"),
    )
    recall = F.col("found") / F.greatest(F.lit(1), F.size("expected"))
    ok = F.col("first_rank").isNotNull() & ~F.col("forbidden_first") & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence)
    return a.select("query_id", "first_rank", F.round(recall, 6).alias("recall"), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("rr"), "forbidden_first", ok.alias("passed"))


def answer_evaluation(answers: DataFrame) -> DataFrame:
    """One row an answer: source hit, enough sources, term coverage, valid citations, pass flag.

    ``answers``: id, answer, sources array, expected_sources array, terms array, least_sources.
    """
    low = F.lower("answer")
    hit = F.arrays_overlap("sources", "expected_sources")
    enough = F.size("sources") >= F.col("least_sources")
    cover = F.size(F.filter("terms", lambda x: low.contains(F.lower(x)))) / F.greatest(F.lit(1), F.size("terms"))
    refs = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1), lambda r: r.cast("int"))
    valid = F.forall(refs, lambda r: (r >= 1) & (r <= F.size("sources")))
    return answers.select("id", hit.alias("source_hit"), enough.alias("enough"), F.round(cover, 6).alias("coverage"), valid.alias("valid_citations"), (hit & enough & (cover >= 0.5) & valid).alias("passed"))


def _group(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(0).alias("all"))


def sketches(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """One quantile sketch a group: the columns of ``by`` and ``sketch``, of fixed size, to be kept and merged. Null and NaN values are left out."""
    v = F.col(value).cast("double")
    return rows.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*by).agg(F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias("sketch"))


def merged(kept: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of groups merged to sketches of larger groups, without the rows."""
    return kept.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(rows: DataFrame, by: list[str], value: str, at: dict[str, float], kept: DataFrame | None = None) -> DataFrame:
    """Exact interpolated percentiles of each group: the columns of ``by``, ``n`` and one column a name of ``at``.

    A sketch of the group (``kept`` holds sketches of parts of groups and saves a pass) brackets
    each wanted rank, one pass counts what lies below, at and between the two ends,
    and brackets that still hold many values are sketched again. A bracket that misses its rank
    is dropped, so that the sketches' error costs time only; no task sorts more
    than ``MOST`` values of a wanted rank. Null and NaN values are left out, and a group without others has no row.
    """
    v = F.col(value).cast("double")
    rows = rows.filter(v.isNotNull() & ~F.isnan(v)).select(_group(by).alias("g"), v.alias("v"))
    first = (sketches(rows, ["g"], "v") if kept is None else merged(kept.select(_group(by).alias("g"), "sketch"), ["g"])).withColumn("n", F.kll_sketch_get_n_double("sketch"))
    ranks = [f(F.lit(q) * (F.col("n") - 1)).cast("long") for q in at.values() for f in (F.floor, F.ceil)]
    state = first.filter("n > 0").select("g", "n", "sketch", F.posexplode(F.array(*ranks)).alias("i", "k"))
    end = F.lit(None).cast("double")
    state = written(state.select("g", "n", "i", "k", end.alias("low"), end.alias("high"), end.alias("found"), F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), "sketch"), "ranks")
    wide, margin, values = F.col("inside") > MOST, MARGIN, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(j / STEPS) for j in range(STEPS + 1)]))
    while left := state.agg(F.sum(F.when(wide, F.col("inside")))).first()[0]:
        step = F.try_divide(STEPS * (F.col("k") - F.col("below") + 0.5), F.col("inside"))
        below, above = F.floor(step - STEPS * margin).cast("int"), F.ceil(step + STEPS * margin).cast("int")
        # a share that reaches an end of the bracket keeps that end
        low = F.when(wide & (below > 0), F.get("values", below)).otherwise(F.col("low"))
        high = F.when(wide & (above < STEPS), F.get("values", above)).otherwise(F.col("high"))
        tried = state.withColumn("values", F.when(wide, values)).withColumns({"new_low": low, "new_high": high}).drop("values", "sketch")
        x = tried.join(_counted(rows, tried.filter(wide), len(ranks)), ["g", "i"], "left")
        k, c = F.col("k"), F.col("counts")
        between = (k >= c["to_low"]) & (k < c["to_high"])
        found = F.when((k >= c["under_low"]) & (k < c["to_low"]), F.col("new_low")).when((k >= c["to_high"]) & (k < c["upto_high"]), F.col("new_high")).otherwise(F.col("found"))
        new = lambda was, now: F.when(between, now).otherwise(F.col(was)).alias(was)
        inside = F.when(found.isNotNull(), 0).when(between, c["to_high"] - c["to_low"]).otherwise(F.col("inside")).alias("inside")
        then = written(x.select("g", "n", "i", "k", new("low", F.col("new_low")), new("high", F.col("new_high")), found.alias("found"), new("below", c["to_low"]), inside), "ranks")
        inner = rows.join(small(then.filter(wide).select("g", "i", "low", "high"), MOST), "g").filter(_between(F.col("low"), F.col("high")))
        state = written(then.join(inner.groupBy("g", "i").agg(F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch")), ["g", "i"], "left"), "ranks")
        if then.agg(F.sum(F.when(wide, F.col("inside")))).first()[0] == left:
            margin = min(0.25, 2 * margin)
    return _interpolated(rows, state, by, at)


def _between(low: Column, high: Column) -> Column:
    """Whether the value lies strictly between two ends, of which null is none."""
    return F.coalesce(F.col("v") > low, F.lit(True)) & F.coalesce(F.col("v") < high, F.lit(True))


def _counted(rows: DataFrame, tried: DataFrame, wanted: int) -> DataFrame:
    """(g, i, counts): values below and up to both ends of each bracket, in one pass that adds up before it shuffles."""
    brackets = tried.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("new_low", "new_high")))).alias("b"))
    brackets = brackets.select("g", *[F.col("b")[i].alias(f"b{i}") for i in range(wanted)])
    sums = []
    for i in range(wanted):
        low, high, v = F.col(f"b{i}.new_low"), F.col(f"b{i}.new_high"), F.col("v")
        # without a lower end nothing lies below it, without an upper one everything
        parts = {"under_low": v < low, "to_low": v <= low, "to_high": high.isNull() | (v < high), "upto_high": high.isNull() | (v <= high)}
        sums.append(F.struct(*[F.count_if(cond).alias(name) for name, cond in parts.items()], F.bool_or(F.col(f"b{i}").isNotNull()).alias("asked")).alias(f"c{i}"))
    x = rows.join(small(brackets, MOST), "g").groupBy("g").agg(*sums)
    x = x.select("g", F.posexplode(F.array(*[f"c{i}" for i in range(wanted)])).alias("i", "counts"))
    return x.filter("counts.asked")


def _interpolated(rows: DataFrame, state: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """The value at each wanted rank, found or among the distinct values of its bracket, then the interpolation."""
    brackets = state.filter("found IS NULL").groupBy("g").agg(F.collect_list(F.struct("i", "k", "low", "high", "below")).alias("b"))
    inside = lambda b: _between(b["low"], b["high"])
    values = rows.join(small(brackets, MOST), "g").filter(F.exists("b", inside)).groupBy("g", "v").agg(F.count("*").alias("m"), F.first("b").alias("b"))
    each = values.select("g", "v", "m", F.inline(F.filter("b", inside)))
    upto = F.col("below") + F.sum("m").over(Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    hit = each.withColumn("upto", upto).filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("m") <= F.col("k"))).select("g", "i", "v")
    spot = hit.unionByName(state.filter("found IS NOT NULL").select("g", "i", F.col("found").alias("v")))
    out = state.groupBy("g").agg(F.first("n").alias("n")).join(spot.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("at")), "g")
    cols = []
    for j, (name, q) in enumerate(at.items()):
        low, high, place = F.col("at")[2 * j], F.col("at")[2 * j + 1], F.lit(q) * (F.col("n") - 1)
        cols.append((low + F.when(low == high, 0.0).otherwise((high - low) * (place - F.floor(place)))).alias(name))
    return out.select(*[F.col("g")[c].alias(c) for c in by], "n", *cols)


def gate(cases: DataFrame, latencies: DataFrame, least_pass: float = 0.8, least_recall: float = 0.8, least_mrr: float = 0.6, most_p95: float = 15.0) -> DataFrame:
    """Pass rate, recall, mean reciprocal rank, interpolated latency percentiles and the decision, in one row."""
    a = cases.agg((count_where(F.col("passed")) / F.count("*")).alias("pass_rate"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"))
    p = percentiles(latencies, [], "seconds", {"p50": 0.5, "p95": 0.95}).drop("n")
    ok = (F.col("pass_rate") >= least_pass) & (F.col("recall") >= least_recall) & (F.col("mrr") >= least_mrr) & (F.col("p95") <= most_p95)
    return a.join(p, how="left").select(*[F.round(c, 6).alias(c) for c in ("pass_rate", "recall", "mrr", "p50", "p95")], ok.alias("ok"))  # one row each
