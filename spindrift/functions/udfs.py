"""The byte kernels as SQL functions: register_all(spark) makes them callable by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import diff, entropy, frames, integers, jsonbytes, lz, templates, varint


def _each(f, kind: str):
    """An Arrow-batched function of one column; null stays null."""

    def over(x: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or v is pd.NA else f(v) for v in x], dtype=object)

    return F.pandas_udf(over, kind)


def _longs(values) -> list[int]:
    return [int(v) for v in values]


SCALARS = {
    "varint_encode": (lambda n: varint.varint(int(n)), "binary"),
    "varint_decode": (lambda b: varint.read_varint(bytes(b))[0], "bigint"),
    "signed_varint_encode": (lambda n: varint.signed_varint(int(n)), "binary"),
    "signed_varint_decode": (lambda b: varint.read_signed_varint(bytes(b))[0], "bigint"),
    "delta_encode": (lambda v: integers.encode_delta(_longs(v)), "binary"),
    "delta_decode": (lambda b: integers.decode_delta(bytes(b)), "array<bigint>"),
    "for_encode": (lambda v: integers.encode_frame_of_reference(_longs(v)), "binary"),
    "for_decode": (lambda b: integers.decode_frame_of_reference(bytes(b)), "array<bigint>"),
    "slots_encode": (lambda v: integers.encode_slots(_longs(v)), "binary"),
    "slots_decode": (lambda b: integers.decode_slots(bytes(b)), "array<bigint>"),
    "entropy_compress": (lambda b: entropy.compress(bytes(b)), "binary"),
    "entropy_decompress": (lambda b: entropy.decompress(bytes(b)), "binary"),
    "shannon_entropy": (lambda b: entropy.shannon(bytes(b)), "double"),
    "lz_compress": (lambda b: lz.compress(bytes(b)), "binary"),
    "lz_decompress": (lambda b: lz.decompress(bytes(b)), "binary"),
    "block_encode": (lambda b: frames.write_blocks(bytes(b)), "binary"),
    "block_decode": (lambda b: frames.read_blocks(bytes(b)), "binary"),
    "frame_encode": (lambda b: frames.write(bytes(b)), "binary"),
    "frame_decode": (lambda b: frames.read(bytes(b))[0].payload, "binary"),
    "crc32c": (lambda b: frames.crc32c(bytes(b)), "bigint"),
    "fnv1a64": (lambda b: (h := frames.fnv1a64(bytes(b))) - (1 << 64 if h >> 63 else 0), "bigint"),
    "json_canonical": (lambda t: jsonbytes.canonical(jsonbytes.parse(t)), "string"),
    "json_to_bytes": (lambda t: jsonbytes.encode(jsonbytes.parse(t)), "binary"),
    "json_from_bytes": (lambda b: jsonbytes.canonical(jsonbytes.decode(bytes(b))[0]), "string"),
    "delta_serialise": (lambda t: diff.serialise(jsonbytes.parse(t)), "binary"),
    "delta_deserialise": (lambda b: jsonbytes.canonical(diff.deserialise(bytes(b))[0]), "string"),
    "template_encode": (lambda b: templates.encode(bytes(b)), "binary"),
    "template_decode": (lambda b: templates.decode(bytes(b)), "binary"),
    "template_of": (lambda t: templates.extract(t)[0], "string"),
    "template_values": (lambda t: templates.extract(t)[1], "array<string>"),
}


def scalar(name: str):
    return _each(*SCALARS[name])


@F.udtf(returnType="kind string, start int, length int")
class JsonTokens:
    """json_tokens(text): the tokens of a JSON text."""

    def eval(self, text: str):
        if text is not None:
            yield from templates.tokens(text)


@F.udtf(returnType="path string, type string, value string")
class JsonFlatten:
    """json_flatten(text): path, type and JSON of every leaf and container."""

    def eval(self, text: str):
        from ..types import infer

        def walk(path, value):
            yield path, infer(value).name() if not isinstance(value, (dict, list)) else "object" if isinstance(value, dict) else "array", jsonbytes.canonical(value)
            items = sorted(value.items()) if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
            for k, v in items:
                yield from walk(f"{path}.{k}" if isinstance(value, dict) else f"{path}[{k}]", v)

        if text is not None:
            yield from walk("$", jsonbytes.parse(text))


@F.udtf(returnType="path string, op string, value string")
class JsonDiffRows:
    """json_diff_rows(before, after): path, operation and new value of every change."""

    def eval(self, before: str, after: str):
        if after is not None:
            yield from diff.rows(diff.diff(None if before is None else jsonbytes.parse(before), jsonbytes.parse(after), before is None))


@F.udtf(returnType="gram string, at int")
class Ngrams:
    """ngrams(text, shortest, longest): every substring of those lengths."""

    def eval(self, text: str, shortest: int, longest: int):
        for at in range(len(text or "")):
            for n in range(shortest, min(longest, len(text) - at) + 1):
                yield text[at : at + n], at


TABLES = {"json_tokens": JsonTokens, "json_flatten": JsonFlatten, "json_diff_rows": JsonDiffRows, "ngrams": Ngrams}


def register_all(spark: SparkSession) -> None:
    from ..operators.states import json_diff, json_patch

    for name in SCALARS:
        spark.udf.register(name, scalar(name))
    spark.udf.register("json_diff", json_diff)
    spark.udf.register("json_patch", json_patch)
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
