"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by its own quantiles, the cell's index on the curve orders the rows,
and runs of equal length are cut from that order. Rows of a shard so lie close together in every
dimension at once, and the ranges that each file keeps of its columns let readers skip files. The
law is `rows`: the row counts of any two shards differ by one at most.

A null in a dimension counts as its least value; a null text has no bytes. Repeated rows are placed
each. An empty table gives no rows. Columns other than those named are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written

#: Bits of each dimension; a curve over d dimensions has 2 ** (BITS * d) cells.
BITS = 4


def text_key(column: str) -> Column:
    """The first seven bytes of a string as an integer, which keeps the order of strings."""
    first = F.rpad(F.hex(F.substring(F.encode(F.col(column), "utf-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(first, 16, 10).cast("long"), F.lit(-1).cast("long"))


def number_key(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(-1)).cast("long")


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points, given as integer coordinates of that many bits, one
    row for each point. From the highest bit down, each coordinate undoes the reflection (or the
    exchange with the first one) that the curve applies to its cell; a Gray code remains."""
    x = points.astype(np.int64).T.copy()
    dimensions = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for d in range(dimensions):
            set_here = (x[d] >> bit & 1).astype(bool)
            exchange = np.where(set_here, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ exchange)
            x[d] ^= exchange
    for d in range(1, dimensions):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for d in range(dimensions):
            out = out << 1 | x[d] >> bit & 1
    return out


def on_curve(df: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """Adds `cell`, the curve index of integer columns, each cut at its own quantiles."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*(F.percentile_approx(k, shares, 10_000).alias(k) for k in keys)).first()
    bounds = [np.unique(np.array(found[k] or [], dtype=np.int64)) for k in keys]

    @F.pandas_udf("long")
    def index(columns: pd.DataFrame) -> pd.Series:
        cells = [np.searchsorted(b, columns.iloc[:, i].to_numpy(), "right") for i, b in enumerate(bounds)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return df.withColumn("cell", index(F.struct(*keys)))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds `rank`, each row's place from 0 in the whole order, without ordering it in one task:
    ranges are sorted each, written with the place in the range, and shifted by the earlier ones."""
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    laid = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("place", place)
    laid = written(laid, "ranked")
    counts = laid.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count(F.lit(1)).alias("n")).collect()  # one for each partition
    first, starts = 0, {}
    for r in sorted(counts, key=lambda r: r["range"]):
        starts[r["range"]] = first
        first += r["n"]
    spark = df.sparkSession
    offsets = spark.createDataFrame(list(starts.items()), "range long, first long")
    own = F.shiftright("place", 33)
    return laid.join(F.broadcast(offsets), own == F.col("range")).withColumn("rank", F.col("first") + F.col("place").bitwiseAND((1 << 33) - 1)).drop("range", "first", "place")


def shard(df: DataFrame, keys: list[str], tie: list[str], shards: int = 8, bits: int = BITS) -> DataFrame:
    """Adds shard and slot: runs of the order by curve index, then tie, whose lengths differ by one
    at most; slot is the place in the shard. keys are integer columns."""
    laid = ranked(on_curve(df, keys, bits), ["cell", *tie])
    n = laid.count()
    if not n:
        return laid.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    at = F.floor(F.col("rank").cast("decimal(20,0)") * shards / n).cast("int")
    # the first rank of shard s is the least r with r * shards // n == s
    first = F.floor((F.col("shard").cast("decimal(20,0)") * n + (shards - 1)) / shards).cast("long")
    return laid.withColumn("shard", at).withColumn("slot", F.col("rank") - first).drop("rank")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder for each shard, rows in the order of their slots."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents by language, source, size and age (the id): doc_id, size, text_crc32, law, shard,
    slot, grown_shard, and the curve's cell. The text is read once, for its size and checksum."""
    meta = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        text_key("lang").alias("lang_key"),
        text_key("source").alias("source_key"),
        number_key("doc_id").alias("age_key"),
    )
    laid = shard(written(meta, "shard-meta"), ["lang_key", "source_key", "size", "age_key"], ["doc_id", "text_crc32", "size"], shards)
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "cell")


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_shards(table(spark, sf_dir, "documents"))
