"""The index of an incident table: which years an id may be stored in.

A table of (id, year) of its own, in folders by bucket: runs of neighbouring ids share a
bucket, so that recent ids meet in few of them, and the number of buckets is fixed when the
index is built. A lookup reads the buckets of its ids and nothing of the incidents.

The index may name a year that an id has left, never miss one that it is in: a merge adds
the years its ids go to before it writes rows, and takes off those they left afterwards. So
a merge that breaks off leaves a right index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.sources.storage import index_of, kept, listed, new_folder

#: Neighbouring ids that share a bucket, as a power of two, and ids of a bucket when it is built.
RUN_BITS, IDS_PER_BUCKET = 16, 8_000_000
SCHEMA = "id long, year int, buckets int, bucket int"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.shiftright("id", RUN_BITS), F.lit(buckets)).cast("int")


def _write(pairs: DataFrame, path: str, buckets: int, mode: str) -> None:
    rows = pairs.select("id", F.col("year").cast("int").alias("year"), F.lit(buckets).alias("buckets"), _bucket(buckets).alias("bucket"))
    writer = rows.repartition("bucket").sortWithinPartitions("bucket", "id").write.partitionBy("buckets", "bucket")
    writer.mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def build(stored: DataFrame, path: str) -> None:
    """From id and year of all stored rows."""
    pairs = stored.where("id IS NOT NULL").select("id", "year")
    _write(pairs, path, 1 + pairs.count() // IDS_PER_BUCKET, "overwrite")


class Index:
    """The index of the table at root, which is built if there is none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, index_of(root)
        if not self._found():
            build(spark.read.parquet(root), self.path)
        self.buckets = int(self._found()[0].removeprefix("buckets="))

    def _found(self) -> list[str]:
        return [n for n in listed(self.spark, self.path) if n.startswith("buckets=")]

    def _touched(self, ids: DataFrame) -> list[int]:
        return [r[0] for r in ids.select(_bucket(self.buckets)).distinct().collect()]  # as many as there are buckets at most

    def _rows(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("bucket").isin(buckets)).select("id", "year")

    def years_of(self, ids: DataFrame) -> DataFrame:
        """id and year of every place that the ids may be stored in. Only their buckets are read,
        and within them the files whose range of ids meets theirs."""
        ids = ids.where("id IS NOT NULL").select("id").distinct()
        ends = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
        return self._rows(self._touched(ids)).where(F.col("id").between(ends.low, ends.high)).join(ids, "id", "left_semi")

    def add(self, pairs: DataFrame, known: DataFrame) -> None:
        """Adds the pairs of id and year that `known` lacks."""
        new = pairs.where("id IS NOT NULL").select("id", F.col("year").cast("int").alias("year")).distinct().join(known, ["id", "year"], "left_anti")
        _write(new, self.path, self.buckets, "append")

    def forget(self, pairs: DataFrame) -> None:
        """Takes pairs off: their buckets are written anew, from a staging folder that is complete before."""
        pairs = kept(pairs)
        touched = self._touched(pairs)
        if not touched:
            return
        staging = new_folder(self.spark, "ids")
        self._rows(touched).join(pairs, ["id", "year"], "left_anti").distinct().write.parquet(staging)
        _write(self.spark.read.parquet(staging), self.path, self.buckets, "overwrite")
