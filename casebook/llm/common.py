"""What the operators of this folder share: shared storage, lineage cuts, batches.

Every operator selects the few columns it needs first, so extra columns of the
input, whatever their names, neither reach a shuffle nor clash with its own.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.sources.storage import cut, new_folder, packed, shared_dir

#: Bytes of text that a Python step holds as numpy arrays at a time.
CHUNK_BYTES = 1 << 20

__all__ = ["chunks", "cut", "flat", "new_folder", "packed", "prepare", "read", "row_key", "shared_dir"]


@lru_cache(4)
def _ship(application: str) -> None:
    sc = SparkContext.getOrCreate()
    root = Path(__file__).parents[2]
    archive = Path(tempfile.mkdtemp(prefix="casebook-")) / "casebook.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "casebook").rglob("*.py")):
            z.write(file, file.relative_to(root))
    sc.addPyFile(str(archive))


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python finds it
    wherever they run; and bounds the rows and bytes of an Arrow batch, since texts can be long."""
    _ship(spark.sparkContext.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(row_id: str, text: str) -> tuple:
    """Two columns that are equal for rows of equal id and text only; a null text is an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.xxhash64(F.col(row_id), whole), F.xxhash64(F.lit(1), whole, F.col(row_id))


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most` bytes of text, one row at least."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return
    group = np.cumsum(sizes, dtype=np.int64) // most
    edges = np.flatnonzero(np.diff(group)) + 1
    starts = np.concatenate(([0], edges, [len(sizes)]))
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and where each begins and ends."""
    whole = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])  # drops a slice's offset
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    if not len(ends):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]
