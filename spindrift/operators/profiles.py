"""Bytes and shapes of documents: histograms, entropy, coded sizes, templates, recommendations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import entropy, templates

JSON_START = r"^[ \t\n\r]*[\{\[]"


def is_json_start(text: Column) -> Column:
    return text.rlike(JSON_START)


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value: the parser alone passes over what follows it, which
    can't be right both as an element and as a field."""
    element, field = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"x":'), text, F.lit("}"))
    return F.try_parse_json(element).isNotNull() & F.try_parse_json(field).isNotNull()


def byte_histogram(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """(by, byte, n). Each task counts its bytes; 256 rows for each group and batch are shuffled."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def count(batches):
        for batch in batches:
            held: dict = {}
            for *k, t in zip(*(batch.column(c).to_pylist() for c in [*by, text]), strict=True):
                if t:
                    own = entropy.byte_counts(t.encode())
                    held[tuple(k)] = held[tuple(k)] + own if tuple(k) in held else own
            rows = [(*k, int(b), int(c[b])) for k, c in held.items() for b in np.flatnonzero(c)]
            if rows:
                columns = list(zip(*rows, strict=True))
                types = [batch.schema.field(c).type for c in by]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*types, pa.int32(), pa.int64()], strict=True)], names=[*by, "byte", "n"])

    return df.select(*by, text).mapInArrow(count, f"{kinds}, byte int, n bigint").groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def entropy_of(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by, input_size, unique_symbols, entropy_bits, entropy_size) of byte histograms."""
    total = F.sum("n").over(Window.partitionBy(*by))
    p = F.col("n") / F.col("__total")
    found = histogram.withColumn("__total", total).groupBy(*by).agg(F.sum("n").alias("input_size"), F.count(F.lit(1)).alias("unique_symbols"), (-F.sum(p * F.log2(p))).alias("__h"))
    return found.select(*by, "input_size", "unique_symbols", F.round(F.abs("__h"), 6).alias("entropy_bits"), F.ceil(F.round(F.abs("__h"), 9) * F.col("input_size") / 8).alias("entropy_size"))


def nibble_size(histogram: DataFrame, by: list[str]) -> DataFrame:
    """(by, nibbles): what the nibble code takes: one for each of the 15 most frequent bytes, three
    for others."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "byte"))
    return histogram.withColumn("__rank", rank).groupBy(*by).agg(F.sum(F.when(F.col("__rank") <= 15, F.col("n")).otherwise(3 * F.col("n"))).alias("nibbles"))


def recommend(text: Column) -> Column:
    """template for JSON of more than 1000 bytes, else blocks."""
    return F.when(is_json_start(text) & (F.octet_length(text) > 1000), "template").otherwise("blocks")


def advise(text: Column) -> Column:
    """session for JSON of more than 500 bytes, one_shot for shorter JSON, else blocks."""
    return F.when(is_json(text), F.when(F.octet_length(text) > 500, "session").otherwise("one_shot")).otherwise("blocks")


#: Values of flat JSON: what follows a colon, a bracket or a comma and isn't a key.
_VALUE = r'(?<=[:\[,])(\s*)(?:"(?:[^"\\]|\\.)*"(?!\s*:)|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)'


def masked(text: Column) -> Column:
    """A document's template: its keys and punctuation, each value a question mark."""
    return F.regexp_replace(text, _VALUE, "$1?")


def template_counts(df: DataFrame, text: str, id_col: str) -> DataFrame:
    return df.select(masked(F.col(text)).alias("template"), id_col).groupBy("template").agg(F.count(F.lit(1)).alias("documents"), F.min(id_col).alias("first_id"))


@F.pandas_udf(T.StructType([T.StructField("template", T.StringType()), T.StructField("slots", T.ArrayType(T.StringType()))]))
def template_of(text: pd.Series) -> pd.DataFrame:
    rows = [templates.extract(t) if t is not None else (None, None) for t in text]
    return pd.DataFrame([(p, v) for p, v in rows], columns=["template", "slots"])


@F.pandas_udf(T.StringType())
def from_template(template: pd.Series, slots: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else templates.reconstruct(p, list(s)) for p, s in zip(template, slots, strict=True)], dtype=object)


def token_rows(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep, place, kind, start, length) of each JSON token."""

    @F.pandas_udf("array<struct<kind:string,start:int,length:int>>")
    def each(t: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": s, "length": n} for k, s, n in templates.tokens(x)] if x is not None else None for x in t], dtype=object)

    return df.select(*keep, F.posexplode(each(text)).alias("place", "t")).select(*keep, "place", "t.*")


def token_transitions(tokens: DataFrame, key: list[str]) -> DataFrame:
    """(kind, following, n): how often one kind of token follows another."""
    after = F.lead("kind").over(Window.partitionBy(*key).orderBy("place"))
    return tokens.withColumn("following", after).where("following is not null").groupBy("kind", "following").agg(F.count(F.lit(1)).alias("n"))
