"""Successive JSON states of keyed streams: differences, patches and what they save, in batch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import diff as D
from ..functions import jsonbytes as J


@F.pandas_udf(T.StringType())
def json_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """The operation that turns one JSON text into another; null before is no state."""
    return pd.Series([None if b is None else J.canonical(D.diff(None if a is None else J.parse(a), J.parse(b), a is None)) for a, b in zip(before, after, strict=True)], dtype=object)


@F.pandas_udf(T.LongType())
def delta_bytes(before: pd.Series, after: pd.Series) -> pd.Series:
    """Bytes of the serialised operation that turns one JSON text into another, without keeping it."""
    op = lambda a, b: D.SAME if a == b else D.diff(None if a is None else J.parse(a), J.parse(b), a is None)
    return pd.Series([None if b is None else len(D.serialise(op(a, b))) for a, b in zip(before, after, strict=True)], dtype="Int64")


@F.pandas_udf(T.StringType())
def json_patch(before: pd.Series, op: pd.Series) -> pd.Series:
    return pd.Series([None if o is None else J.canonical(D.patch(None if a is None else J.parse(a), J.parse(o), a is None)) for a, o in zip(before, op, strict=True)], dtype=object)


@F.pandas_udf(T.BinaryType())
def delta_serialise(op: pd.Series) -> pd.Series:
    return pd.Series([None if o is None else D.serialise(J.parse(o)) for o in op], dtype=object)


@F.pandas_udf(T.StringType())
def delta_deserialise(data: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else J.canonical(D.deserialise(bytes(b))[0]) for b in data], dtype=object)


def with_previous(df: DataFrame, doc: str, key: list[str], order: list[str], out: str = "previous") -> DataFrame:
    return df.withColumn(out, F.lag(doc).over(Window.partitionBy(*key).orderBy(*order)))


def state_ops(df: DataFrame, doc: str, key: list[str], order: list[str]) -> DataFrame:
    """Adds previous and op: add (no state yet), unchanged or modify."""
    df = with_previous(df, doc, key, order)
    op = F.when(F.col("previous").isNull(), "add").when(F.col("previous") == F.col(doc), "unchanged").otherwise("modify")
    return df.withColumn("op", op)


def diffs(df: DataFrame, doc: str, key: list[str], order: list[str]) -> DataFrame:
    """Adds the operation of each state. Equal states are branched off before the kernel, which a
    CASE around it wouldn't do."""
    df = state_ops(df, doc, key, order)
    changed = df.where("op <> 'unchanged'").withColumn("diff", json_diff("previous", doc))
    return changed.unionByName(df.where("op = 'unchanged'").withColumn("diff", F.lit('["="]')))


def object_changes(before: Column, after: Column) -> Column:
    """Array of (field, op, before, after) of two map<string,string>: add, remove, modify or keep."""
    keys = F.array_sort(F.array_union(F.coalesce(F.map_keys(before), F.array()), F.coalesce(F.map_keys(after), F.array())))

    def change(k):
        b, a = F.try_element_at(before, k), F.try_element_at(after, k)
        op = F.when(~F.array_contains(F.map_keys(before), k), "add").when(~F.array_contains(F.map_keys(after), k), "remove").when(b.eqNullSafe(a), "keep").otherwise("modify")
        return F.struct(k.alias("field"), op.alias("op"), b.alias("before"), a.alias("after"))

    return F.transform(keys, change)


def array_changes(before: Column, after: Column) -> Column:
    """Array of ops by position: keep, replace, then insert or delete for what one side lacks."""
    places = F.greatest(F.size(before), F.size(after))
    op = lambda i: F.when(i >= F.size(before), "insert").when(i >= F.size(after), "delete").when(F.get(before, i).eqNullSafe(F.get(after, i)), "keep").otherwise("replace")
    return F.when(places > 0, F.transform(F.sequence(F.lit(0), places - 1), op)).otherwise(F.array().cast("array<string>"))


def stream_stats(df: DataFrame, doc: str, key: list[str], order: list[str]) -> DataFrame:
    """For each stream: updates, full sends, unchanged ones, bytes of both kinds as serialised, and the
    share of bytes that deltas save against sending each state in full. A null state sends nothing, and a
    stream of such states alone saves 0."""
    df = state_ops(df, doc, key, order).select(*key, "op", delta_bytes("previous", doc).alias("__bytes"))
    full = F.col("op") == "add"
    found = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("updates"),
        F.count_if(full).alias("full_sends"),
        F.count_if(F.col("op") == "unchanged").alias("unchanged"),
        F.coalesce(F.sum(F.when(full, F.col("__bytes"))), F.lit(0)).alias("bytes_full"),
        F.coalesce(F.sum(F.when(~full, F.col("__bytes"))), F.lit(0)).alias("bytes_delta"),
    )
    mean_full = F.col("bytes_full") / F.col("full_sends")
    saved = 1 - (F.col("bytes_full") + F.col("bytes_delta")) / (mean_full * F.col("updates"))
    return found.withColumn("efficiency", F.round(F.when(F.col("bytes_full") > 0, saved).otherwise(0.0), 6))


def receive(df: DataFrame, op: str, key: list[str], order: list[str]) -> DataFrame:
    """The states that a receiver comes to, from the operations of each stream in turn. Streams are
    independent; one stream is folded in order, a batch of rows at a time."""
    import pyarrow as pa

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in dict.fromkeys([*key, *order])), "state string"])
    columns = list(dict.fromkeys([*key, *order]))

    def fold(batches):
        states: dict = {}
        current = None
        for batch in batches:
            out = []
            for *k, o in zip(*(batch.column(c).to_pylist() for c in [*key, op]), strict=True):
                if (k := tuple(k)) != current:
                    current, states = k, {}
                states["s"] = D.patch(states.get("s"), J.parse(o), "s" not in states)
                out.append(J.canonical(states["s"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "state"])

    laid = df.select(*columns, op).repartition(*key).sortWithinPartitions(*key, *order)
    return laid.mapInArrow(fold, schema)
