"""Columns: profiles, validity bitmaps, runs, and records taken apart and put together again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column, from one pass: values, nulls, distinct values, range, and the
    encoding that these recommend."""
    integer = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}
    text = {c for c, kind in df.dtypes if kind == "string"}
    structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), (F.col(c) if c in integer else F.lit(None)).cast("long").alias("i"), F.lit(c in text).alias("t")) for c in columns]
    stacked = df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")
    found = stacked.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("v").isNull()).alias("n_nulls"),
        F.count_distinct("v").alias("n_distinct"),
        F.min("v").alias("least"),
        F.max("v").alias("greatest"),
        (F.max("i") - F.min("i")).alias("__range"),
        F.bool_or("t").alias("__text"),
    )
    values = F.col("n_rows") - F.col("n_nulls")
    encoding = F.when(F.col("__range").isNotNull() & (F.col("__range") < 256) & (values >= 4), "bitpacked").when(F.col("__range").isNotNull(), "varint")
    encoding = encoding.when(F.col("__text") & (F.col("n_distinct") < F.floor(values / 2)), "dictionary").otherwise("raw")
    return found.withColumn("encoding", encoding).drop("__range", "__text")


def bitmap(df: DataFrame, value: str, position: str, by: list[str]) -> DataFrame:
    """(by, byte, bits): eight rows a byte, lowest bit first; 1 is present."""
    present = F.expr(f"case when `{value}` is not null then shiftleft(1, cast(pmod(`{position}`, 8) as int)) else 0 end")
    return df.groupBy(*by, F.expr(f"{position} div 8").alias("byte")).agg(F.bit_or(present).cast("long").alias("bits"))


def to_columns(df: DataFrame, columns: list[str], position: str, by: list[str]) -> DataFrame:
    """One row for each block and column: its values as text, in the order of the rows. Rows of one
    position are ordered by their values, all columns alike, so that records stay whole."""
    held = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), *(F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)))))
    blocks = df.groupBy(*by).agg(held.alias("__held"))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"__held.v{i}").alias("values")) for i, c in enumerate(columns)))
    return blocks.select(*by, F.explode(each).alias("x")).select(*by, "x.column", "x.values")


def to_rows(blocks: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """The inverse: one row for each place in a block."""
    each = blocks.select(*by, "column", F.posexplode("values").alias("place", "v"))
    return each.groupBy(*by, "place").pivot("column", columns).agg(F.first("v"))


def runs(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """(by, run, value, length): stretches of equal values in turn."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    numbered = df.withColumn("__new", F.when(first, 1).otherwise(changed)).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("length"))
