"""Index state, retries, throughput and consistency."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, one_of, ranked, retry_delay_s

STAGES = ("vision", "transcription", "embedding")
STATUSES = ("pending", "ready", "error", "blocked", "missing", "not_needed")


def stage_summary(files: DataFrame) -> DataFrame:
    """(key, n) of every stage and status plus repairable, waiting and terminal rows: one scan, zeros left out."""
    aggs = [count_where(F.col(f"{s}_status") == v).alias(f"{s}.{v}") for s in STAGES for v in STATUSES]
    bad = F.col("status").isin("partial", "error")
    aggs += [count_where(bad & (F.col("terminal_error") == 0)).alias("repairable"), count_where(bad & F.col("next_retry_s").isNotNull()).alias("waiting"), count_where(F.col("terminal_error") == 1).alias("terminal")]
    row = files.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("n")) for c in row.columns])
    return row.select(F.inline(pairs)).filter("n > 0")


def dashboard(files: DataFrame) -> DataFrame:
    """Totals of the catalog in one row."""
    return files.agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), *[count_where(F.col("status") == s).alias(s) for s in ("pending", "ready", "partial", "error")], count_where(F.col("embedding_status") == "ready").alias("semantic_ready"), count_where(F.length(F.trim("text")) > 0).alias("content_ready"))


def kinds(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count("*").alias("n"))


_KIND_RANK = {"document": 0, "image": 1, "audio": 2, "video": 3}
ORDERS = {
    "newest": lambda: [F.desc("mtime_s"), F.asc("id")], "oldest": lambda: [F.asc("mtime_s"), F.asc("id")], "smallest": lambda: [F.asc("size"), F.asc("id")],
    "balanced": lambda: [F.asc(one_of(_KIND_RANK, F.col("kind"), 4)), F.asc("size"), F.asc("id")],
}


def pending_queue(files: DataFrame, order: str, limit: int) -> DataFrame:
    """The next files to index: a top-k in a total order."""
    return files.filter("status = 'pending'").orderBy(*ORDERS[order]()).limit(limit)


def pending_summary(files: DataFrame, libraries: DataFrame) -> DataFrame:
    """(scope, name, n): pending files in all, by kind and by library, libraries without any kept."""
    p = files.filter("status = 'pending'")
    total = p.agg(F.lit("all").alias("scope"), F.lit("all").alias("name"), F.count("*").alias("n"))
    kind = p.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("scope"), "name", "n")
    lib = libraries.select("id").join(p.groupBy(F.col("library_id").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    return total.union(kind).union(lib.select(F.lit("library"), F.col("id").cast("string"), F.coalesce("n", F.lit(0))))


def repair_queue(files: DataFrame, now_s: int, limit: int) -> DataFrame:
    """Partial or failed rows that are due: manual captions first, then kind, size, id."""
    due = F.col("status").isin("partial", "error") & (F.col("terminal_error") == 0) & F.coalesce(F.col("next_retry_s") <= now_s, F.lit(True))
    return files.filter(due).orderBy((F.col("manual_caption") == "").cast("int"), one_of(_KIND_RANK, F.col("kind"), 4), "size", "id").limit(limit)


def retry_state(files: DataFrame, failed: Column, now_s: int, most: int = 6, base: float = 60.0) -> DataFrame:
    """Next attempts, terminal flag and due time after a run: failures back off, a success resets."""
    n = F.when(failed, F.col("retry_count") + 1).otherwise(0)
    terminal = failed & (F.col("retry_count") + 1 >= most)
    due = F.when(failed & ~terminal, F.lit(now_s) + retry_delay_s(F.col("retry_count") + 1, base).cast("long"))
    return files.select("id", n.alias("attempts"), terminal.alias("terminal"), due.alias("due_s"))


#: Fixed value: a path through a temporary folder.
TEMPORARY = r"[/\\][^\s'\"\]]*(?:cache|tmp)[/\\][^\s'\"\]]+"


def error_fingerprint(message: Column) -> Column:
    """Hash of a message without paths through a folder whose name ends in cache or tmp; all else tells errors apart."""
    return F.sha2(F.regexp_replace(message, TEMPORARY, "<temporary>"), 256)


def final_status(files: DataFrame, chunk_counts: DataFrame) -> DataFrame:
    """Partial if a stage failed, is missing or blocked, else ready; pending stages keep the row pending; with its chunk count."""
    s = [F.col(f"{x}_status") for x in STAGES]
    bad = reduce(lambda a, b: a | b, [c.isin("error", "missing", "blocked") for c in s])
    wait = reduce(lambda a, b: a | b, [c == "pending" for c in s])
    return files.join(chunk_counts, "id", "left").select("id", F.when(bad, "partial").when(wait, "pending").otherwise("ready").alias("final"), F.coalesce("chunks", F.lit(0)).alias("chunks"))


def overview(files: DataFrame, running: DataFrame) -> DataFrame:
    """State of the index and percentages in one row."""
    a = files.agg(F.count("*").alias("total"), count_where(F.col("status") == "ready").alias("ready"), count_where(F.col("status") == "pending").alias("queued"), count_where(F.col("status").isin("partial", "error") & F.col("next_retry_s").isNotNull()).alias("backoff"), count_where(F.col("terminal_error") == 1).alias("terminal"))
    r = running.agg(F.count("*").alias("running"))
    state = F.when(F.col("running") > 0, "running").when(F.col("queued") > 0, "queued").when(F.col("backoff") > 0, "backoff").when(F.col("terminal") > 0, "degraded").otherwise("complete")
    return a.join(r).select("total", "ready", state.alias("state"), F.round(100.0 * F.col("ready") / F.col("total"), 3).alias("ready_pct"))  # one row each


def throughput(tasks: DataFrame, now_s: int, last: int = 20) -> DataFrame:
    """Items a minute, what remains and the seconds left of each task type.

    The rate is that of the last completed batches; a running one with at least
    ten items in a minute overrides it.
    """
    done = tasks.filter("status = 'completed' AND finished_s > started_s AND work_done > 0").withColumn("k", ranked("type", F.desc("finished_s"), F.desc("id"))).filter(F.col("k") <= last)
    hist = done.groupBy("type").agg((F.sum("work_done") / F.sum(F.col("finished_s") - F.col("started_s"))).alias("past"))
    run = tasks.filter(F.col("status") == "running").withColumn("k", ranked("type", F.desc("started_s"), F.desc("id"))).filter("k = 1")
    age = F.lit(now_s) - F.col("started_s")
    run = run.select("type", F.when((F.col("work_done") >= 10) & (age >= 60), F.col("work_done") / age).alias("now"))
    left = tasks.filter("status IN ('pending', 'running')").groupBy("type").agg(F.sum(F.greatest(F.lit(0), F.col("work_total") - F.col("work_done"))).alias("remaining"))
    rate = F.coalesce("now", "past")
    return left.join(hist, "type", "left").join(run, "type", "left").select("type", "remaining", F.round(rate * 60, 6).alias("per_minute"), F.ceil(F.col("remaining") / rate).alias("eta_s"))


TERMINAL = ("completed", "failed", "cancelled")


def prunable(tasks: DataFrame, now_s: int, keep: int, days: int) -> DataFrame:
    """Finished tasks older than ``days``, and beyond the newest ``keep``; active ones stay.

    The newest are found by an exact cutoff from a top-k, not by numbering the whole table in one task.
    """
    ended = tasks.filter(F.col("status").isin(*TERMINAL))
    old = F.col("finished_s") < now_s - days * 86_400
    young = ended.filter(~old)
    edge = young.select("finished_s", "id").orderBy(F.desc("finished_s"), F.desc("id")).limit(keep).agg(F.min(F.struct("finished_s", "id")).alias("edge"), F.count("*").alias("n"))
    out = young.join(F.broadcast(edge), (F.col("n") >= keep) & (F.struct("finished_s", "id") < F.col("edge"))).select("id")  # one row
    return ended.filter(old).select("id").union(out)


def consistency(chunk_counts: DataFrame, vector_counts: DataFrame) -> DataFrame:
    """(file_id, problem): chunks without vectors, vectors without chunks, different numbers."""
    c, v = chunk_counts.alias("c"), vector_counts.alias("v")
    j = c.join(v, "file_id", "full_outer").select("file_id", F.col("c.n").alias("chunks"), F.col("v.n").alias("vectors"))
    kind = F.when(F.col("vectors").isNull(), "missing").when(F.col("chunks").isNull(), "stale").when(F.col("chunks") != F.col("vectors"), "mismatch")
    return j.withColumn("problem", kind).filter("problem IS NOT NULL")


def consistency_report(problems: DataFrame, cap: int = 500) -> DataFrame:
    """Counts and the first ids of each problem (the cap is the report's)."""
    k = problems.withColumn("k", ranked("problem", "file_id"))
    return k.groupBy("problem").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("k") <= cap, F.col("file_id")))).alias("ids"))


def repair_plan(problems: DataFrame) -> DataFrame:
    """What to do: delete stale vectors, rebuild missing and mismatched files."""
    return problems.select("file_id", F.when(F.col("problem") == "stale", "delete").otherwise("rebuild").alias("action")).distinct()


def upgrade_candidates(files: DataFrame, now_s: int, version: int, limit: int) -> DataFrame:
    """Images with a caption of an older version whose retry is due: fewest attempts, newest first."""
    v = F.coalesce(F.get_json_object("metadata_json", "$.caption_version").try_cast("int"), F.lit(0))
    due = F.coalesce(F.col("next_retry_s") <= now_s, F.lit(True))
    return files.filter((F.col("kind") == "image") & F.col("status").isin("ready", "partial") & (F.col("caption") != "") & (v < version) & due).orderBy("retry_count", F.desc("mtime_s"), "id").limit(limit)


def media_coverage(files: DataFrame, index: DataFrame, now_s: int) -> DataFrame:
    """Ready, failed and pending media of the current generation, the last hour's rate and the time left."""
    j = files.select("id", "generation").join(index, ["id", "generation"], "left")
    hour = F.col("updated_s") >= now_s - 3600
    a = j.agg(F.count("*").alias("total"), count_where(F.col("state") == "ready").alias("ready"), count_where(F.col("state") == "error").alias("errors"), count_where(F.col("state").isNull()).alias("pending"), count_where(hour & (F.col("state") == "ready")).alias("n"), F.max(F.when(hour, F.col("updated_s"))).alias("hi"), F.min(F.when(hour, F.col("updated_s"))).alias("lo"))
    rate = F.when((F.col("n") > 1) & (F.col("hi") > F.col("lo")), (F.col("n") - 1) * 3600.0 / (F.col("hi") - F.col("lo")))
    return a.select("total", "ready", "errors", "pending", F.round(rate, 6).alias("per_hour"), F.ceil(F.col("pending") * 3600 / rate).alias("eta_s"))


def next_batch(files: DataFrame, index: DataFrame, now_s: int, order: str, limit: int) -> DataFrame:
    """Files whose index row is not ready for their generation, not terminal and due."""
    i = index.select("id", F.col("generation").alias("made"), "state", "terminal", "due_s")
    j = files.join(i, "id", "left").filter(~F.coalesce((F.col("state") == "ready") & (F.col("made") == F.col("generation")), F.lit(False)) & ~F.coalesce("terminal", F.lit(False)) & F.coalesce(F.col("due_s") <= now_s, F.lit(True)))
    return j.orderBy(*ORDERS[order]()).limit(limit)


def orphans(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("id"), "id", "left_anti")


def active_unique(tasks: DataFrame) -> DataFrame:
    """One active task a scope (type, library, sorted ids): highest priority, then oldest."""
    scope = F.concat_ws("|", "type", F.col("library_id").cast("string"), F.array_join(F.array_sort("file_ids"), ","))
    return tasks.filter("status IN ('pending', 'running')").withColumn("scope", scope).withColumn("k", ranked("scope", F.desc("priority"), "id")).filter("k = 1").drop("k")


def counts_by(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def trashed(items: DataFrame) -> DataFrame:
    return items.filter("status = 'trashed'").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def asset_checks(assets: DataFrame) -> DataFrame:
    """One row an asset and rule with its level; assets have the columns the rules name."""
    rules = {
        "online": ("error", F.col("file_id").isNotNull()), "indexed": ("error", F.col("status") == "ready"), "proxy": ("warning", F.col("kind") != "audio"), "duration": ("error", (F.col("kind") != "video") | (F.col("size") > 0)),
        "resolution": ("warning", (F.col("width") >= 1280) & (F.col("height") >= 720)), "caption": ("warning", F.col("caption") != ""), "comments": ("warning", F.coalesce("open_comments", F.lit(0)) == 0),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(level).alias("level"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, (level, ok) in rules.items()])
    return assets.select("asset_id", F.inline(rows))


def asset_verdicts(checks: DataFrame) -> DataFrame:
    """Passed if no error rule fails; with the number of warnings."""
    return checks.groupBy("asset_id").agg(F.bool_and((F.col("level") != "error") | F.col("ok")).alias("passed"), count_where((F.col("level") == "warning") & ~F.col("ok")).alias("warnings"))


def readiness(rules: DataFrame) -> DataFrame:
    """not_ready if a critical rule fails, degraded on any warning, else healthy."""
    return rules.agg(F.when(F.bool_or(F.col("critical") & ~F.col("ok")), "not_ready").when(F.bool_or(~F.col("ok")), "degraded").otherwise("healthy").alias("state"), count_where(~F.col("ok")).alias("failing"))


def stale(at: Column, now: Column, most_s: int) -> Column:
    """Whether a reported time text is older than the limit; a text that is no time is stale."""
    ts = F.try_to_timestamp(at)
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(ts) > most_s, F.lit(True))


def task_history(tasks: DataFrame, per_user: int) -> DataFrame:
    return tasks.withColumn("k", ranked("user_id", F.desc("created_s"), F.desc("id"))).filter(F.col("k") <= per_user)


def active_for_file(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, id): the active task of highest priority whose payload names the file."""
    p = tasks.filter("status IN ('pending', 'running')").select("id", "priority", F.explode(F.from_json("payload_json", "file_ids array<bigint>")["file_ids"]).alias("file_id"))
    return p.join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").withColumn("k", ranked("file_id", F.desc("priority"), "id")).filter("k = 1").select("file_id", "id")


def recovered(tasks: DataFrame) -> DataFrame:
    """Task states after a restart: cancel requests end, running ones start again from zero."""
    s = F.when(F.col("status") == "cancel_requested", "cancelled").when(F.col("status") == "running", "pending").otherwise(F.col("status"))
    return tasks.select("id", "priority", s.alias("status"), F.when(F.col("status") == "running", 0).otherwise(F.col("work_done")).alias("work_done"))


def runtime_profile(timings: DataFrame, stages: list[str]) -> DataFrame:
    """Items, items an hour and mean seconds of each stage of a batch."""
    a = timings.groupBy("batch").agg(F.count_distinct("item").alias("processed"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("total"))
    p = timings.groupBy("batch").pivot("stage", stages).agg(F.round(F.avg("seconds"), 6))
    return a.join(p, "batch").withColumn("per_hour", F.round(F.col("processed") * 3600 / F.col("total"), 6)).drop("total")


def newest(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def changed_before(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before in their key's order."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("was", F.lag(value).over(w)).filter(F.col("was").isNotNull() & (F.col("was") != F.col(value))).drop("was")
