"""Line dedup by a log-template tree: DataFrame functions only.

Every line goes down a tree of fixed depth: number of tokens, then its leading
tokens, in which runs of digits are one variable field. At the leaf the rest of
the line is cut into four runs of tokens, and each run in turn is left free (of
a short line the last one), so that lines that differ in one field fall under
one template. A template found in several documents is recurring: its lines are
dropped everywhere but in the document of the smallest id. The fewer tokens a
template with a free field has, the more documents it takes. A long line that
exactly two documents have goes too, unless the two share most of a document:
whole copies are left to near-duplicate detection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Leading tokens of the tree; tokens from which each of four fields is left free; documents of a recurring template.
DEPTH, FREE_FROM, MIN_DOCS = 2, 12, 3
#: Tokens of a long line, which recurs from two documents.
LONG = 40


def _upto(line: Column, k: Column) -> Column:
    """The first ``k`` blank-separated tokens (k a column)."""
    return F.call_function("substring_index", line, F.lit(" "), k.cast("int"))


def template_keys(n: Column, line: Column, depth: int = DEPTH, free_from: int = FREE_FROM) -> Column:
    """Hashes of a line's templates: the whole masked line (even), and the line with one of four fields free (odd)."""
    lead, rest = _upto(line, F.lit(depth)), n - depth
    cut = [F.lit(depth) + F.floor(rest * i / 4) for i in range(5)]
    pre = [_upto(line, c) for c in cut[:4]] + [line]
    path = [n, lead]
    free = [
        F.xxhash64(F.lit(i + 1), *path, F.substring(pre[i], 1, 1 << 30), F.substring(line, F.length(pre[i + 1]) + 1, F.length(line))).bitwiseOR(F.lit(1))
        for i in range(4)
    ]
    whole = F.shiftleft(F.xxhash64(F.lit(0), *path, line), 1)
    return F.when(n >= free_from, F.array(whole, *free)).when(n > depth, F.array(whole, free[3])).otherwise(F.array(whole))


def masked(line: Column) -> Column:
    """Trimmed line with every run of digits as one variable field."""
    return F.regexp_replace(F.trim(line), "[0-9]+", "0")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, free_from: int = FREE_FROM, long: int = LONG, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines of recurring templates: id, ``text`` (what is left), ``n_lines`` and ``n_dropped``.

    Lines end at ``\\n``; a line of blanks alone is never dropped or counted. A
    template recurs if at least ``min_docs`` documents have it, one with a free
    field and fewer than ``free_from`` tokens if as many times more have it as
    the square of what it lacks; the document with the smallest id among them
    keeps its lines. A line of ``long`` tokens that two documents have recurs
    too, where lines common to several documents are less than half of the text.
    A null text stays null with zero lines; rows of one id count as one document
    and rows without an id drop nothing; one row comes out for each row that
    goes in, with its own columns named in ``keep``; other extra columns are
    ignored. Lines of any length are hashed whole.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*keep).alias("_row")] if keep else []))
    # keys of all lines, written once: the count and the join back both read them
    lines = base.filter("id IS NOT NULL AND text IS NOT NULL").select("id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    lines = lines.select("id", F.xxhash64("line").alias("h"), F.length("line").alias("size"), masked(F.col("line")).alias("m")).filter(F.length("m") > 0)
    lines = lines.withColumn("n", F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1)
    lines = saved(lines.select("id", "h", "size", "n", template_keys(F.col("n"), F.col("m"), depth, free_from).alias("keys")), "line-keys")
    keyed = lines.select("id", "h", "size", "n", F.explode("keys").alias("key"))
    # one row a document and key, then documents a key: both aggregate before they shuffle
    counts = keyed.select("id", "key").groupBy("key", "id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("docs"), F.min("id").alias("first"))
    whole = F.col("key") % 2 == 0
    recurring = counts.filter((F.col("docs") >= min_docs) | (F.col("docs") == 2) & whole).select("key", "docs", "first")
    need = F.when(whole | (F.col("n") >= free_from), F.lit(min_docs)).otherwise(F.ceil(F.lit(min_docs * free_from**2) / (F.col("n") * F.col("n"))))
    hit = keyed.join(recurring, "key")
    later = F.col("id") != F.col("first")
    dropped = hit.groupBy("id").agg(
        F.collect_set(F.when(later & (F.col("docs") >= need), F.col("h"))).alias("gone"),
        F.collect_set(F.when(later & whole & (F.col("n") >= long) & (F.col("docs") < min_docs), F.col("h"))).alias("twice"),
        F.sum(F.when(whole, F.col("size")).otherwise(0)).alias("common"),
    )
    # the length is counted before the join, not once a line
    rows = base.withColumn("chars", F.length("text")).join(dropped, "id", "left")
    all_lines = F.split("text", "\n")
    blank = lambda x: F.length(F.trim(x)) == 0
    own = 2 * F.col("common") < F.col("chars")
    hit = F.col("gone").isNotNull() & ((F.size("gone") > 0) | own & (F.size("twice") > 0))
    goes = lambda x: F.array_contains("gone", F.xxhash64(x)) | own & F.array_contains("twice", F.xxhash64(x))
    left = F.when(hit, F.filter(all_lines, lambda x: blank(x) | ~goes(x))).otherwise(all_lines)
    rows = rows.select(
        F.col("id").alias(id_col),
        F.when(hit, F.array_join(left, "\n")).otherwise(F.col("text")).alias(text_col),
        F.coalesce(F.size(F.filter(all_lines, lambda x: ~blank(x))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(hit, F.size(all_lines) - F.size(left)).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col("_row")[k].alias(k) for k in keep],
    )
    return rows.withColumn("n_lines", F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))


def oracle_sql(text: str = "text", table: str = "documents", depth: int = DEPTH, free_from: int = FREE_FROM, min_docs: int = MIN_DOCS, keep: str = "", long: int = LONG) -> str:
    """DuckDB SQL for the same result: doc_id, text, n_lines, n_dropped (and columns named in ``keep``)."""
    seg = lambda i: f"CAST(floor((len(t) - {depth}) * {i} / 4.0) AS BIGINT)"
    free = []
    for i in range(4):
        free.append(f"'{i + 1}|' || array_to_string(t[1:{depth} + {seg(i)}], ' ') || '|' || array_to_string(t[{depth} + {seg(i + 1)} + 1:], ' ') || '|' || len(t)")
    whole = "'0|' || array_to_string(t, ' ')"
    return f"""
WITH l AS (SELECT DISTINCT doc_id, unnest(string_split({text}, chr(10))) AS line FROM {table} WHERE doc_id IS NOT NULL AND {text} IS NOT NULL),
m AS (SELECT doc_id, line, string_split(regexp_replace(trim(line, ' '), '[0-9]+', '0', 'g'), ' ') AS t FROM l WHERE length(trim(line, ' ')) > 0),
k AS (SELECT doc_id, line, len(t) AS n, unnest(CASE WHEN len(t) >= {free_from} THEN [{whole}, {', '.join(free)}] WHEN len(t) > {depth} THEN [{whole}, {free[3]}] ELSE [{whole}] END) AS key FROM m),
r AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM k GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
x AS (SELECT *, key LIKE '0|%' AS whole, CASE WHEN key LIKE '0|%' OR n >= {free_from} THEN {min_docs} ELSE ceil({min_docs * free_from**2} / (n * n)) END AS need FROM k JOIN r USING (key)),
g AS (SELECT doc_id AS gid, coalesce(list(DISTINCT line) FILTER (doc_id <> first AND docs >= need), []) AS gone,
  coalesce(list(DISTINCT line) FILTER (doc_id <> first AND whole AND n >= {long} AND docs < {min_docs}), []) AS twice, coalesce(sum(length(line)) FILTER (whole), 0) AS common FROM x GROUP BY 1),
w AS (SELECT d.*, string_split({text}, chr(10)) AS ls, CASE WHEN 2 * common < length({text}) THEN list_concat(gone, twice) ELSE gone END AS gone FROM {table} d LEFT JOIN g ON doc_id = gid),
j AS (SELECT * REPLACE (CASE WHEN len(gone) > 0 THEN gone END AS gone) FROM w),
f AS (SELECT *, CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x: length(trim(x, ' ')) = 0 OR NOT list_contains(gone, x)) END AS kept FROM j)
SELECT doc_id, {keep}CASE WHEN gone IS NULL THEN {text} ELSE array_to_string(kept, chr(10)) END AS text,
  CAST(coalesce(len(list_filter(ls, lambda x: length(trim(x, ' ')) > 0)), 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN gone IS NULL THEN 0 ELSE len(ls) - len(kept) END AS BIGINT) AS n_dropped FROM f"""
