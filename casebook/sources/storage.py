"""Where jobs keep data between steps, and reads and writes of the incident table."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.functions.curve import place
from casebook.operators.findings import checked
from casebook.sources.schema import CODES, RAW

#: Rows of a file and of a row group in it, so that scans can be split and skipped.
ROWS_PER_FILE, ROWS_PER_GROUP = 5_000_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary
    folder if all runs on this machine, and an error on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = f"file://{tempfile.mkdtemp(prefix='casebook-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    files, own = _files(spark, sc.getCheckpointDir())  # a folder of this application alone
    files.deleteOnExit(own)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for this application's data, which is removed when the driver ends."""
    own = f"{shared_dir(spark)}/casebook-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, in order; none if it does not exist."""
    files, found = _files(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(found)) if files.exists(found) else []


def remove(spark: SparkSession, path: str) -> None:
    files, found = _files(spark, path)
    files.delete(found, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, read by the driver."""
    files, found = _files(spark, path)
    stream = files.open(found)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all; an error if it exists."""
    files, found = _files(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{found.getParent()}/_{uuid.uuid4().hex}")
    stream = files.create(draft)
    stream.write(text.encode())
    stream.close()
    if files.exists(found) or not files.rename(draft, found):
        files.delete(draft, False)
        raise ValueError(f"{path} exists")


def stamp(spark: SparkSession, df: DataFrame) -> str:
    """Tells the files that a frame reads from others, and from what they were before a change."""
    told = []
    for file in sorted(df.inputFiles()):
        files, found = _files(spark, file)
        status = files.getFileStatus(found)
        told.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """Like `cut`, for tables with few rows a partition: in four files a core, or a sixteenth of the
    shuffle partitions where these are more. For each file an executor starts processes that set its
    mode, and while one starts, the executor's memory counts twice."""
    spark = df.sparkSession
    most = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    return cut(df.coalesce(most))


def kept(df: DataFrame) -> DataFrame:
    """Write the rows by columns to the shared folder and go on from there. They are computed
    once, reads take the columns that they use, and Spark knows the size for its joins."""
    folder = new_folder(df.sparkSession, "kept")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The feed: JSON lines, every value text, only the named columns."""
    return spark.read.schema(RAW).json(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """The code table: CSV with a header, every value text."""
    return spark.read.schema(CODES).option("header", True).csv(path)


def read_incidents(spark: SparkSession, root: str) -> DataFrame:
    """The partitioned table with `year` from the path; an error if it has no partition."""
    df = spark.read.parquet(root)  # fails by itself when there is no file
    if "year" not in df.columns:
        raise ValueError(f"{root} has no year partitions")
    return df


def stored_years(spark: SparkSession, root: str) -> list[int]:
    """The years that have a partition, by a listing of the table's folder."""
    names = (n.removeprefix("year=") for n in listed(spark, root) if n.startswith("year="))
    return sorted(int(n) for n in names if n.lstrip("-").isdigit())


def index_of(root: str) -> str:
    """Where the table of ids and years is kept that belongs to an incident table."""
    return f"{root.rstrip('/')}-ids"


def select_years(df: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Rows of some years (all if None); years that do not exist add nothing."""
    return df if years is None else df.where(F.col("year").isin([int(y) for y in years]))


def stored_order(df: DataFrame) -> DataFrame:
    """`year` from `date`, rows ranged by year, date and id and sorted so within files,
    so that files can be skipped by date; a stored `year` column is replaced."""
    rows = df.withColumn("year", F.year("date"))
    return rows.repartitionByRange("year", "date", "id").sortWithinPartitions("year", "date", "id")


def write_incidents(df: DataFrame, root: str, keep_index: bool = False) -> None:
    """Overwrites the years that the rows have, and no other. The table's index of ids is
    dropped unless the writer keeps it right; the next merge builds it anew."""
    if not keep_index:
        remove(df.sparkSession, index_of(root))
    writer = stored_order(df).write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).option("parquet.block.row.count.limit", ROWS_PER_GROUP).parquet(root)


def write_by_place(df: DataFrame, root: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Overwrites the years that the rows have, laid out by place and not by date: a column
    `place` is added, and rows are ranged by it within the year and sorted so within files."""
    rows = df.withColumns({"year": F.year("date"), "place": place(F.col("latitude"), F.col("longitude"))})
    rows = rows.repartitionByRange("year", "place", "id").sortWithinPartitions("year", "place", "id")
    writer = rows.write.partitionBy("year").mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("maxRecordsPerFile", rows_per_file).option("parquet.block.row.count.limit", ROWS_PER_GROUP).parquet(root)


def full_refresh(df: DataFrame, table: str) -> DataFrame:
    """Replaces a table by all partitions, if they meet its constraints; returns one row (partitions, rows)."""
    checked(df).write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table).agg(F.count_distinct("year").alias("partitions"), F.count("*").alias("n_rows"))


def drop_stored_year(spark: SparkSession, root: str, dry_run: bool = False) -> DataFrame:
    """Rewrites the partitions whose files hold a `year` column of their own, which the path
    already tells. Returns year and carried, by one file's schema for each partition.
    Repeating it changes nothing; a dry run only reports."""
    years = sorted(r.year for r in read_incidents(spark, root).select("year").distinct().collect() if r.year is not None)
    carried = [y for y in years if "year" in spark.read.parquet(f"{root}/year={y}").columns]
    if carried and not dry_run:
        staging = new_folder(spark, "without-year")
        select_years(read_incidents(spark, root), carried).drop("year").write.parquet(staging)
        write_incidents(spark.read.parquet(staging), root, keep_index=True)
    return spark.createDataFrame([(y, y in carried) for y in years], "year int, carried boolean")
