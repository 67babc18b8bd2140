"""Streaming operators; each works on a stream, and all but the stateful ones on a table too."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ranked, retry_delay_s
from ..functions.session import small, written
from ..operators.catalog import apply_changes, matches, snapshot_changes
from ..operators.dedup import refreshed
from .ordered import STORE, ordered


def debounced(events: DataFrame, quiet: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """One scan request a library and burst: events merge until it has been quiet. ``events``: library_id, ts."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy("library_id", F.session_window("ts", quiet)).agg(F.count("*").alias("n")).select("library_id", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("due"), "n")


def signature_changes(signatures: DataFrame) -> DataFrame:
    """Rows whose signature differs from the one before of the same library (table form)."""
    w = Window.partitionBy("library_id").orderBy("t")
    return signatures.withColumn("was", F.lag("signature").over(w)).filter(F.col("was").isNotNull() & (F.col("was") != F.col("signature"))).drop("was")


def signature_changes_stream(signatures: DataFrame, late: str = "1 minute", idle_s: int | None = None) -> DataFrame:
    """The same on a stream: the last signature of a library is its state. See ``ordered`` for rows out of order and ``idle_s``."""

    def step(was, t, s):
        return s, (t, s) if was is not None and s != was else None

    return ordered(signatures, "library_id", "signature", step, "library_id long, t long, signature long", late, idle_s)


def arrival_runs(files: DataFrame, rules: DataFrame, owners: DataFrame, output_part: str = "/outputs/") -> DataFrame:
    """One run a rule with all its matched files: enabled rules of enabled owners who may read the file's library.

    ``rules``: rule_id, owner_id, enabled, conditions; ``owners``: owner_id, library_id, enabled. For foreachBatch or a table.
    """
    ok = rules.filter("enabled = 1")
    hit = matches(files.filter(~F.col("path").contains(output_part)), ok).join(ok.select("rule_id", "owner_id"), "rule_id")
    lib = files.select(F.col("id").alias("file_id"), "library_id")
    hit = hit.join(lib, "file_id").join(owners.filter("enabled = 1").select("owner_id", "library_id"), ["owner_id", "library_id"], "left_semi")
    return hit.groupBy("rule_id").agg(F.array_sort(F.collect_set("file_id")).alias("file_ids"))


def due_runs(clock: DataFrame, rules: DataFrame, late: str = "5 minutes") -> DataFrame:
    """(rule_id, minute_key): schedules due at a clock tick, once a minute. ``clock``: ts; ``rules``: rule_id, hour, minute, weekday (null: daily)."""
    on = (F.hour("ts") == F.col("hour")) & (F.minute("ts") == F.col("minute")) & (F.col("weekday").isNull() | (F.weekday("ts") == F.col("weekday")))
    hit = clock.join(small(rules, 10_000), on).select("rule_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute_key"), "ts")
    if clock.isStreaming:
        return hit.withWatermark("ts", late).dropDuplicatesWithinWatermark(["rule_id", "minute_key"]).select("rule_id", "minute_key")
    return hit.select("rule_id", "minute_key").distinct()


def retries_stream(results: DataFrame, most: int = 6, base: float = 60.0, late: str = "1 minute", idle_s: int | None = None) -> DataFrame:
    """Attempts, terminal flag and wait of each key after each result of a stream (key, t, ok)."""

    def step(n, t, ok):
        n = 0 if ok else (n or 0) + 1
        stop = n >= most
        return n, (t, n, stop, 0.0 if ok or stop else min(604_800.0, max(30.0, base) * 2.0 ** (n - 1)))

    return ordered(results, "key", "ok", step, "key long, t long, attempts int, terminal boolean, wait_s double", late, idle_s)


def retries(results: DataFrame, most: int = 6, base: float = 60.0) -> DataFrame:
    """The same on a table, by windows: attempts count failures since the last success."""
    w = Window.partitionBy("key").orderBy("t")
    r = results.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    n = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("key", "run").orderBy("t")).cast("int")
    r = r.withColumn("attempts", n)
    stop = F.col("attempts") >= most
    return r.select("key", "t", "attempts", stop.alias("terminal"), F.when(F.col("ok") | stop, 0.0).otherwise(retry_delay_s(F.col("attempts"), base)).alias("wait_s"))


def rate_limits(attempts: DataFrame, limits: dict[str, tuple[list[str], int]], window_s: int = 900) -> DataFrame:
    """Attempts with the limits they hit and the seconds to wait. ``attempts``: id, t and the key columns; a limit is (keys, most)."""
    a = attempts
    blocked, wait = F.lit(False), F.lit(0)
    for name, (keys, most) in limits.items():
        w = Window.partitionBy(*keys).orderBy("t").rangeBetween(-(window_s - 1), 0)
        a = a.withColumn(f"{name}_n", F.count("*").over(w)).withColumn(f"{name}_first", F.min("t").over(w))
        over = F.col(f"{name}_n") > most
        blocked, wait = blocked | over, F.greatest(wait, F.when(over, F.col(f"{name}_first") + window_s - F.col("t")).otherwise(0))
    return a.select("id", blocked.alias("blocked"), wait.cast("long").alias("retry_after_s"))


def _throttle(interval: int) -> Callable:
    def step(last, t, empty):
        runs = last is None or t - last >= interval or empty
        return t if runs else last, (t,) if runs else None

    return step


def throttled_stream(requests: DataFrame, interval_s: int, late: str = "1 minute", idle_s: int | None = None) -> DataFrame:
    """At most one recompute of a job an interval, unless its queue is empty. ``requests``: job, t, queue_empty."""
    return ordered(requests, "job", "queue_empty", _throttle(interval_s), "job long, t long", late, idle_s)


def throttled(requests: DataFrame, interval_s: int) -> DataFrame:
    """The same on a table: the running last time makes it a fold inside each job."""
    step = _throttle(interval_s)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        last, out = None, []
        for t, empty in pdf.sort_values(["t", "queue_empty"], kind="stable")[["t", "queue_empty"]].itertuples(index=False):
            last, row = step(last, t, empty)
            out += [row] if row else []
        return pd.DataFrame({"job": pdf["job"].iloc[0], "t": [t for (t,) in out]}, columns=["job", "t"])

    return requests.groupBy("job").applyInPandas(run, "job long, t long")


def liveness(beats: DataFrame, now_s: int | Column, most_s: int = 900) -> DataFrame:
    """Whether each worker's last beat is recent. ``beats``: worker, t."""
    now = F.lit(now_s) if isinstance(now_s, int) else now_s
    return beats.groupBy("worker").agg(F.max("t").alias("last_t")).withColumn("alive", now - F.col("last_t") < most_s)


def outbox(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events without repeats of their key. On a stream the watermark bounds the state."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_key"])
    return events.withColumn("k", ranked("event_key", "ts", "event_id")).filter("k = 1").drop("k")


def delivery(attempts: Column) -> tuple[Column, Column]:
    """State and wait after so many failed deliveries: failed at eight, else a capped doubling wait."""
    return F.when(attempts >= 8, "failed").otherwise("pending"), F.when(attempts >= 8, F.lit(None)).otherwise(F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.least(attempts, F.lit(7)))))


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The last version of each key, whatever order rows came in."""
    return rows.withColumn("k", ranked(key, *[F.desc(c) for c in order])).filter("k = 1").drop("k")


def finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the tables below ``path`` that were written to their end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [x.getPath() for x in fs.listStatus(at)]
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def catalog_upsert(catalog_path: str, groups_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: merge a micro-batch of scan rows into the catalog snapshots below a path.

    Rows of the batch win by path; changed or removed members leave the
    similarity groups, whose first table (path, group_id) is at ``groups_path`` and
    whose later ones are beside it. Snapshot N is written beside the
    old ones, the groups first and the catalog last, and counts once it is
    whole: each batch starts from the last whole snapshot, and a batch whose
    number is not above it (a replay) is skipped.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = finished(spark, catalog_path)
        if done and number <= done[-1]:
            return
        scan = latest(batch, "path", "mtime_s", "size")
        old = spark.read.parquet(f"{catalog_path}/{done[-1]}") if done else None
        rows = scan.select("path", "library_id", "size", "mtime_s", F.lit("pending").alias("stage"))
        changed = rows.select("path")
        if old is not None:
            same = old.withColumnsRenamed({"size": "s0", "mtime_s": "m0", "stage": "g0", "library_id": "l0"})
            keep = (F.col("size") == F.col("s0")) & (F.col("mtime_s") == F.col("m0"))
            both = rows.join(same, "path", "full_outer")
            changed = both.filter(F.col("size").isNotNull() & ~F.coalesce(keep, F.lit(False))).select("path")
            rows = both.select(
                "path", F.coalesce("library_id", "l0").alias("library_id"), F.coalesce("size", "s0").alias("size"), F.coalesce("mtime_s", "m0").alias("mtime_s"),
                F.when(F.col("size").isNull() | F.coalesce(keep, F.lit(False)), F.col("g0")).otherwise("pending").alias("stage"),
            )
        if groups_path:
            before = [n for n in finished(spark, f"{groups_path}-after") if n < number]
            groups = spark.read.parquet(f"{groups_path}-after/{before[-1]}" if before else groups_path)
            left = refreshed(groups.withColumnRenamed("path", "id"), changed.withColumnRenamed("path", "id"))
            left.withColumnRenamed("id", "path").write.mode("overwrite").parquet(f"{groups_path}-after/{number}")
        rows.write.mode("overwrite").parquet(f"{catalog_path}/{number}")

    return run


def batch_upsert(scan: DataFrame, catalog: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One batch on tables: the next catalog, and the similarity groups without changed or removed rows."""
    changes = written(snapshot_changes(scan, catalog), "changes")
    out = changes.filter("change IN ('update', 'delete') AND catalog_id IS NOT NULL").select(F.col("catalog_id").alias("id"))
    return apply_changes(changes), refreshed(groups, out)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now into Parquet below ``path`` and return the result as a table."""
    conf = stream.sparkSession.conf
    was = conf.get(STORE[0], None)
    conf.set(*STORE)  # a query keeps the store that it began with
    try:
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    finally:
        conf.set(STORE[0], was) if was else conf.unset(STORE[0])
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
