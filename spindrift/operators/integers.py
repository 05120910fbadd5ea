"""Integer columns: zigzag and varint sizes, deltas, frames of reference, and the choice of encoding.

All are Column expressions, windows or grouped aggregates; sizes in bytes are computed, not encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    n = n.cast("long")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def bit_width(u: Column) -> Column:
    """Bits of a non-negative integer; 0 takes one, as in a packed column."""
    return F.length(F.bin(u)).cast("long")


def varint_size(u: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(bit_width(u) / 7)).cast("long")


def int_width(n: Column) -> Column:
    """int8, int16, int32 or int64, by magnitude."""
    return F.when(n.between(-128, 127), "int8").when(n.between(-32768, 32767), "int16").when(n.between(-2147483648, 2147483647), "int32").otherwise("int64")


def with_delta(df: DataFrame, value: str, by: list[str], order: list[str], out: str = "delta") -> DataFrame:
    """Each value's difference to the one before it in its series; the first one's to 0."""
    return df.withColumn(out, F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy(*by).orderBy(*order)))


def from_delta(df: DataFrame, delta: str, by: list[str], order: list[str], out: str = "value") -> DataFrame:
    running = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(delta).over(running).cast("long"))


def with_delta_of_delta(df: DataFrame, value: str, by: list[str], order: list[str], out: str = "delta2") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("__d", F.col(value) - F.lag(value, 1, 0).over(w))
    return df.withColumn(out, F.col("__d") - F.lag("__d", 1, 0).over(w)).drop("__d")


def with_slot_delta(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Adds delta and form: literal (the first), same (the delta before it again) or delta."""
    w = Window.partitionBy(*by).orderBy(*order)
    df = df.withColumn("delta", F.col(value) - F.lag(value).over(w))
    form = F.when(F.col("delta").isNull(), "literal").when(F.col("delta") == F.lag("delta").over(w), "same").otherwise("delta")
    return df.withColumn("form", form)


def slot_pattern(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """For each slot: constant, linear (one delta) or varying."""
    found = with_slot_delta(df, value, by, order).groupBy(*by).agg(F.count_distinct("delta").alias("d"), F.max(F.abs("delta")).alias("m"), F.count(value).alias("n_values"))
    pattern = F.when((F.col("d") == 0) | (F.col("m") == 0), "constant").when(F.col("d") == 1, "linear").otherwise("varying")
    return found.select(*by, "n_values", pattern.alias("pattern"))


def frame_of_reference(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    low, high = F.min(value), F.max(value)
    return df.groupBy(*by).agg(low.alias("reference"), (high - low).alias("range"), bit_width(high - low).alias("width"), F.count(value).alias("n_values"))


def encoding_choice(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """For each series, the bytes of plain and of delta varints, the width of packed offsets, and
    the encoding that these and the average step recommend (by_size, by_average)."""
    df = with_delta(df, value, by, order)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    df = df.withColumn("__step", F.when(~first, F.abs("delta")))
    low, high, n = F.min(value), F.max(value), F.count(value)
    found = df.groupBy(*by).agg(
        n.alias("n_values"),
        F.sum(varint_size(zigzag(F.col(value)))).alias("plain_size"),
        F.sum(varint_size(zigzag(F.col("delta")))).alias("delta_size"),
        bit_width(high - low).alias("width"),
        F.sum("__step").alias("__steps"),
        F.sum(value).alias("__sum"),
    )
    packed = (F.col("width") <= 8) & (F.col("n_values") >= 4)
    by_size = F.when((F.col("delta_size") < F.col("plain_size")) & (F.col("delta_size") < F.expr("width * n_values div 8 + 10")), "delta").when(packed, "bitpacked").otherwise("varint")
    small_steps = F.expr("__steps div (n_values - 1) < abs(__sum div n_values) div 10")
    by_average = F.when(F.col("n_values") == 1, "varint").when(packed, "bitpacked").when(small_steps, "delta").otherwise("varint")
    return found.withColumn("by_size", by_size).withColumn("by_average", by_average).drop("__steps", "__sum")
