"""Schemas of JSON records: inferred, merged over all records, registered and compared."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frames
from ..types import NOTHING, JsonType, infer

TIMESTAMP = "(?s)^[0-9].{3}-.{2}-"
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def looks_like_timestamp(s: Column) -> Column:
    return F.octet_length(s).between(10, 30) & s.rlike(TIMESTAMP)


def looks_like_uuid(s: Column) -> Column:
    return s.rlike(UUID)


def infer_schema(df: DataFrame, column: str) -> JsonType:
    """The merged type of all records. Each task merges its own records, and a tree of merges
    follows; what reaches the driver is one type. A root array counts as its elements; texts that
    aren't JSON are passed over."""

    def records(text):
        try:
            value = json.loads(text)
        except ValueError:
            return []
        return value if isinstance(value, list) else [value]

    def of_records(batches):
        merged = NOTHING
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for value in records(text) if text is not None else ():
                    merged = merged.merge(infer(value))
        yield pa.RecordBatch.from_pydict({"t": [merged.to_json()]})

    def of_types(batches):
        merged = NOTHING
        for batch in batches:
            for t in batch.column(0).to_pylist():
                merged = merged.merge(JsonType.from_json(t))
        yield pa.RecordBatch.from_pydict({"t": [merged.to_json()]})

    partial = df.select(column).mapInArrow(of_records, "t string")
    partial = partial.distinct().repartition(8).mapInArrow(of_types, "t string")
    merged = NOTHING
    for r in partial.collect():  # eight rows
        merged = merged.merge(JsonType.from_json(r.t))
    return merged


def field_presence(df: DataFrame, column: str) -> DataFrame:
    """(field, present, kinds, nullable) of the top level, without leaving the JVM."""
    parsed = df.select(F.try_parse_json(column).alias("v")).where("v is not null")
    total = parsed.agg(F.count(F.lit(1)).alias("n_records"))
    each = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kinds = F.array_join(F.array_sort(F.collect_set(F.schema_of_variant("value"))), "|")
    found = each.groupBy(F.col("key").alias("field")).agg(F.count(F.lit(1)).alias("present"), kinds.alias("kinds"), F.max(F.schema_of_variant("value") == "VOID").alias("__null"))
    return found.join(F.broadcast(total)).select("field", "present", "kinds", (F.col("__null") | (F.col("present") < F.col("n_records"))).alias("nullable"))


def fingerprint(t: JsonType) -> int:
    """64 bits over the whole tree, with widths, presence and nested fields."""
    return frames.fnv1a64(t.name().encode())


def shape(column: str) -> Column:
    """The sorted top-level keys of a record: the cheap identity of its schema."""
    return F.md5(F.concat_ws("|", F.array_sort(F.json_object_keys(column))))


def register(df: DataFrame, column: str, order: str) -> DataFrame:
    """(schema_id, shape, messages, hits, first_seen): a schema is included with its first message
    and known from then on. Ids follow the first occurrence; the shapes, not the records, are ranked."""
    found = df.select(shape(column).alias("shape"), order).groupBy("shape").agg(F.count(F.lit(1)).alias("messages"), F.min(order).alias("first_seen"))
    return found.withColumn("schema_id", F.dense_rank().over(Window.orderBy("first_seen", "shape")).cast("long")).withColumn("hits", F.col("messages") - 1)


def extend_registry(registry: DataFrame, more: DataFrame) -> DataFrame:
    """A registry with the shapes that only a later one has, numbered on."""
    new = more.join(registry, "shape", "left_anti")
    last = registry.agg(F.coalesce(F.max("schema_id"), F.lit(0)).alias("__last"))
    numbered = new.withColumn("__nth", F.row_number().over(Window.orderBy("first_seen", "shape"))).join(F.broadcast(last))
    return registry.unionByName(numbered.withColumn("schema_id", (F.col("__last") + F.col("__nth")).cast("long")).select(*registry.columns))
