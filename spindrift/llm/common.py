"""What the corpus operators share: reading tables, the shared folder, cutting lineage, texts in Python."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are runs of anything else.
SPACE_CLASS = r"\x20\x09-\x0D"
#: Rows and bytes of an Arrow batch of texts at most, and bytes of text that a Python worker takes up
#: at once (a longer text is taken up alone).
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 1024, 8 << 20, 1 << 20

_KEPT: dict[Any, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset
    (a local session), a temporary folder that is then set for the session's context."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spindrift-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lineage ends there, and lost
    executors don't cost the work before it. The shuffle files behind it are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside has its shuffle files removed when it ends, not when the driver next collects
    its garbage. Executions don't share them, so that no later one misses any."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` returned, once nothing that is still to run reads them."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Makes the session's Arrow batches small enough that a batch of long texts takes little memory
    on either side. They stay so, as what is planned now runs later."""
    conf = spark.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def map_texts(df: DataFrame, over: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, keeps: bool = False) -> DataFrame:
    """mapInArrow over rows that hold texts, in small batches. Tasks of a call that keeps nothing by
    `kept` drop what other operators kept in their worker; each task ends by giving back freed memory."""
    small_batches(df.sparkSession)

    def tidy(batches):
        if not keeps:
            forget()
        try:
            yield from over(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def slices(batch: pa.RecordBatch, text_at: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch with so many bytes of text each, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """make(), kept in this Python worker until another key is asked for, or a task begins that keeps
    nothing. Workers outlive tasks and operators; so what one operator learned doesn't stay while the
    next one runs."""
    if key not in _KEPT:
        forget()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Drops what this Python worker keeps."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def give_back() -> None:
    """Returns freed memory, which the allocators would hold, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
