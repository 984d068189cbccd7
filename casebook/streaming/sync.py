"""The incremental merge as a stream over a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casebook.operators.merge import latest, merge_into, status_of
from casebook.operators.taxonomy import prepare
from casebook.sources.schema import RAW
from casebook.sources.storage import kept, listed, stored_years


def sync_stream(spark: SparkSession, landing: str, root: str, codes: DataFrame, checkpoint: str, files_per_batch: int = 1000, report: str | None = None):
    """Merges all files that have landed since the last run and stops. The stream's
    checkpoint is the state.

    What is not merged is kept beside it, at `report` (by default the checkpoint's path with
    `-report`): `unmerged` has the rows that were skipped or rejected, `batches` the counts by
    year and status. Both have a folder a batch; that of `batches` is written last and marks
    the batch as done, so a batch that runs again adds nothing to either, and one that broke
    off is merged again, which changes nothing, since the merge keeps the latest row of each id."""
    report = report or f"{checkpoint.rstrip('/')}-report"
    codes = kept(codes)  # derived once and not in every batch

    def merge(batch: DataFrame, batch_id: int) -> None:
        if "_SUCCESS" in listed(spark, f"{report}/batches/batch_id={batch_id}"):
            return
        rows = kept(latest(prepare(batch, codes)))
        years = stored_years(spark, root)
        told = merge_into(spark, root, rows)
        left = status_of(rows, years).where("status <> 'applied'").drop("year")
        left.write.mode("overwrite").parquet(f"{report}/unmerged/batch_id={batch_id}")
        told.write.mode("overwrite").parquet(f"{report}/batches/batch_id={batch_id}")

    rows = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).json(landing)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batches(spark: SparkSession, report: str) -> DataFrame:
    """batch_id, year, status and n_rows of all batches."""
    return spark.read.parquet(f"{report}/batches")


def unmerged(spark: SparkSession, report: str) -> DataFrame:
    """The rows that were not merged, with their status and batch_id."""
    return spark.read.parquet(f"{report}/unmerged")
