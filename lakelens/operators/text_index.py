"""A persistent full-text index of a catalog: built once, extended by batches, searched without its texts.

A term without blanks lies inside one token of a text, so the index keeps, for
each token, the files that have it and how often (weighted by field), and for
each trigram the tokens that hold it. A term is looked up by its rarest
trigram; of the tokens found those that contain it count as often as they do.
Each batch of files is a segment of all tables; of a file the newest segment counts.

Tables below the index's path, each with a folder a segment:

``postings``  bucket, token, id, f       sorted by token, a folder a bucket of the token's hash
``grams``     gram, token                sorted by trigram
``sizes``     gram, n                    tokens that hold a trigram
``files``     id, len, whole, in_name, screenshot    trigram length; compacted texts; a removed file has no length
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import compact
from ..functions.session import shared_dir, small, written

#: Folders that postings are dealt to; a search of few terms reads few of them.
BUCKETS = 32
#: Most pairs of terms and tokens that are sent to every task; beyond, Spark chooses the join.
FEW_MATCHES = 200_000
BLANK = r"[\x20\x09-\x0D]+"


def bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def grams(token: Column) -> Column:
    """Distinct trigrams of a text of three characters or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) - 2), lambda i: F.substring(token, i, F.lit(3))))


class TextIndex:
    """The index below a path that all executors see. ``fields``: weights of the text columns of a file."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float]):
        self.spark, self.path, self.fields = spark, path.rstrip("/"), dict(fields)

    def _marks(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/done")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[int]:
        """Numbers of the segments that were written to their end."""
        at, fs = self._marks()
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []

    def add(self, files: DataFrame, removed: DataFrame | None = None, screenshot: Column | None = None) -> int:
        """Write a segment of new and changed files (id and the fields) and of removed ids; its number."""
        number = (self.segments() or [-1])[-1] + 1
        low = files.select("id", *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in self.fields))
        parts = F.array(*(F.struct(F.lit(w).alias("w"), F.split(c, BLANK).alias("tokens")) for c, w in self.fields.items()))
        tokens = low.select("id", F.explode(F.flatten(F.transform(parts, lambda p: F.transform(p["tokens"], lambda t: F.struct(t.alias("token"), p["w"].alias("w")))))).alias("x"))
        postings = tokens.filter(F.length("x.token") >= 3).groupBy("x.token", "id").agg(F.sum("x.w").cast("double").alias("f"))
        postings = postings.select(bucket(F.col("token")).alias("bucket"), "token", "id", "f").repartition("bucket", F.pmod(F.xxhash64("token", "id"), F.lit(4))).sortWithinPartitions("bucket", "token")
        whole = compact(F.concat_ws("\n", *self.fields))
        texts = files.select("id", self._length().alias("len"), whole.alias("whole"), compact(F.col(next(iter(self.fields)))).alias("in_name"), (F.lit(False) if screenshot is None else screenshot).alias("screenshot"))
        if removed is not None:
            gone = removed.select("id", F.lit(None).cast("int").alias("len"), F.lit(None).cast("string").alias("whole"), F.lit(None).cast("string").alias("in_name"), F.lit(None).cast("boolean").alias("screenshot"))
            texts = texts.unionByName(gone)
        self._finish(number, postings, texts)
        return number

    def _length(self) -> Column:
        return sum((F.greatest(F.lit(0), F.length(F.coalesce(c, F.lit(""))) - 2) for c in self.fields), F.lit(0))

    def _finish(self, number: int, postings: DataFrame, texts: DataFrame) -> None:
        postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        own = self.spark.read.parquet(f"{self.path}/postings/segment={number}").select("token").distinct()
        pairs = own.select(F.explode(grams(F.col("token"))).alias("gram"), "token").repartition("gram").sortWithinPartitions("gram")
        pairs.write.mode("overwrite").parquet(f"{self.path}/grams/segment={number}")
        sizes = self.spark.read.parquet(f"{self.path}/grams/segment={number}").groupBy("gram").agg(F.count("*").alias("n"))
        sizes.write.mode("overwrite").parquet(f"{self.path}/sizes/segment={number}")
        texts.write.mode("overwrite").parquet(f"{self.path}/files/segment={number}")
        at, fs = self._marks()
        fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(at, str(number)), True).close()  # the segment counts from here on

    def table(self, name: str) -> DataFrame:
        """A table over all whole segments, with their numbers."""
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/segment={n}" for n in self.segments()))

    def live(self) -> DataFrame:
        """(id, segment, len) of every file that is there, from its newest segment."""
        f = self.table("files").select("id", "segment", "len")
        if len(self.segments()) > 1:
            f = f.groupBy("id").agg(F.max_by(F.struct("segment", "len"), "segment").alias("x")).select("id", "x.segment", "x.len")
        return f.filter("len IS NOT NULL")

    def texts(self) -> DataFrame:
        """(id, whole, in_name, screenshot) of every file that is there."""
        t = self.table("files")
        return (t.join(self.live().select("id", "segment"), ["id", "segment"], "left_semi") if len(self.segments()) > 1 else t.filter("len IS NOT NULL")).select("id", "whole", "in_name", "screenshot")

    def occurrences(self, terms: DataFrame) -> DataFrame:
        """(term, id, f): weighted number of times each term of three characters or more and without blanks occurs in a file; no text is read."""
        t = terms.filter((F.length("term") >= 3) & ~F.col("term").rlike(BLANK)).select("term").distinct()
        asked = written(t.select("term", F.explode(grams(F.col("term"))).alias("gram")), "asked")
        sizes = self.table("sizes").groupBy("gram").agg(F.sum("n").alias("n"))
        rare = asked.join(sizes, "gram", "left").groupBy("term").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
        held = self.table("grams").select("gram", "token").join(small(rare, FEW_MATCHES), "gram").filter(F.col("token").contains(F.col("term"))).select("term", "token").distinct()
        times = (F.length("token") - F.length(F.replace("token", F.col("term"), F.lit("")))) / F.length("term")
        matched = written(held.select("term", "token", times.alias("times"), bucket(F.col("token")).alias("bucket")), "matched")
        hits = self.table("postings").join(small(matched, FEW_MATCHES), ["bucket", "token"])
        if len(self.segments()) > 1:
            hits = hits.join(self.live().select("id", "segment"), ["id", "segment"], "left_semi")
        return hits.groupBy("term", "id").agg(F.sum(F.col("f") * F.col("times")).alias("f"))

    def merged(self, path: str) -> TextIndex:
        """The same index as one segment below another path: what newer segments replaced is gone."""
        out = TextIndex(self.spark, path, self.fields)
        live = self.live().select("id", "segment")
        postings = self.table("postings").join(live, ["id", "segment"], "left_semi").select("bucket", "token", "id", "f")
        texts = self.table("files").join(live, ["id", "segment"], "left_semi").select("id", "len", "whole", "in_name", "screenshot")
        out._finish(0, postings.repartition("bucket").sortWithinPartitions("bucket", "token"), texts)
        return out


def of_catalog(files: DataFrame, fields: dict[str, float], screenshot: Column | None = None) -> TextIndex:
    """The index of a catalog whose files on disk are as they are now; built where it is not there yet."""
    spark = files.sparkSession
    names = []
    for name in sorted(files.inputFiles()):
        at = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        names.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    key = hashlib.sha256("\n".join([*names, repr(sorted(fields.items()))]).encode()).hexdigest()[:24]
    index = TextIndex(spark, f"{shared_dir(spark)}/lakelens/text-index-{key}", fields)
    if not index.segments():
        index.add(files, screenshot=screenshot)
    return index
