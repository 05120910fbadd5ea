"""Exact token-length histogram and what its suffix sums answer.

Documents are counted by encoded length, which leaves one row for each distinct length. Sums over
the longer (or shorter) lengths then answer, for every context limit, how many documents fit, how
many tokens survive truncation and how many whole contexts the corpus fills, all exactly.

Null and empty texts have length 0. Repeated rows count as often as they occur. An empty table
gives an empty histogram. Columns other than the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import lengths
from .common import table, written

#: Lengths in one part of the two-level sums: no task orders more than these, or one row for each part.
PART = 1024


def histogram(encoded: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(length, n_docs) of a table with one encoded length in each row."""
    return encoded.groupBy(F.col(column).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Adds to each length, taken as the context limit: documents and tokens at most so long,
    documents and tokens beyond, and tokens left if longer documents are truncated to it. The
    counts are written first, as they are read twice."""
    parts = written(counts, "histogram").withColumn("part", F.floor(F.col("length") / PART))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("part")
        .agg(F.sum("n_docs").alias("d"), F.sum(F.col("length") * F.col("n_docs")).alias("t"))
        .select(
            "part",
            F.coalesce(F.sum("d").over(before), F.lit(0)).alias("docs_before"),
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tokens_before"),
            F.sum("d").over(Window.partitionBy()).alias("docs"),
            F.sum("t").over(Window.partitionBy()).alias("tokens"),
        )
    )
    inside = Window.partitionBy("part").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    at_most = parts.join(offsets, "part").select(
        "length",
        "n_docs",
        "docs",
        "tokens",
        (F.col("docs_before") + F.sum("n_docs").over(inside)).alias("docs_at_most"),
        (F.col("tokens_before") + F.sum(F.col("length") * F.col("n_docs")).over(inside)).alias("tokens_at_most"),
    )
    beyond = F.col("docs") - F.col("docs_at_most")
    return at_most.select(
        "length",
        "n_docs",
        "docs_at_most",
        beyond.alias("docs_longer"),
        "tokens_at_most",
        (F.col("tokens") - F.col("tokens_at_most")).alias("tokens_longer"),
        (F.col("tokens_at_most") + F.col("length") * beyond).alias("tokens_truncated"),
        (F.col("docs_at_most") / F.col("docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_at_most, tokens_truncated, docs_longer) for any limits, also such as no
    document has: the sums of the largest length at most so long, carried on to the limit."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context long")
    total = sums.agg(F.max(F.col("docs_at_most") + F.col("docs_longer")).alias("docs"))
    # the limits are given, so that the histogram meets a few rows only
    found = F.broadcast(asked).join(sums, F.col("length") <= F.col("context"), "left").groupBy("context").agg(F.max_by(F.struct("docs_at_most", "tokens_at_most"), "length").alias("s"))
    held = found.crossJoin(F.broadcast(total))
    docs_at_most, beyond = F.coalesce("s.docs_at_most", F.lit(0)), F.coalesce("docs", F.lit(0)) - F.coalesce("s.docs_at_most", F.lit(0))
    return held.select("context", docs_at_most.alias("docs_at_most"), (F.coalesce("s.tokens_at_most", F.lit(0)) + F.col("context") * beyond).alias("tokens_truncated"), beyond.alias("docs_longer"))


def length_at(sums: DataFrame, q: float) -> DataFrame:
    """The least length that a share q of the documents doesn't exceed, as one row."""
    return sums.where(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    encoded = lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return suffix_sums(histogram(encoded))
