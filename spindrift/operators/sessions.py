"""Sessions over DataFrames: records framed by their schemas, and what that costs and saves."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff, frames, jsonbytes, rows, templates
from ..functions.varint import CodecError
from ..types import JsonType
from .schemas import fingerprint, infer_schema


def compress(df: DataFrame, column: str, schema: JsonType | None = None, options: frames.Options = frames.Options(), include_schema: bool = False) -> DataFrame:
    """Adds frame (binary) and error. All records share the schema, which is inferred if not given;
    it goes into the frames only if asked for, as the registry holds it by its id. What isn't JSON
    has a null frame and an error."""
    schema = schema or infer_schema(df, column)
    schema_id, packed = fingerprint(schema), schema.to_json().encode() if include_schema else b""
    plain = schema.to_json()

    def over(batches):
        own = JsonType.from_json(plain)
        for batch in batches:
            out, errors = [], []
            for text in batch.column(column).to_pylist():
                try:
                    value = None if text is None else jsonbytes.parse(text)
                    out.append(None if text is None else frames.write(rows.encode(value, own), schema_id, packed, options))
                    errors.append(None)
                except (ValueError, CodecError) as e:
                    out.append(None)
                    errors.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(errors, pa.string())], names=[*batch.schema.names, "frame", "error"])

    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInArrow(over, f"{fields}, frame binary, error string")


def decompress(df: DataFrame, column: str = "frame", schema: JsonType | None = None) -> DataFrame:
    """Adds decoded: the record of each frame as canonical JSON, by the schema given or held in it.
    A frame that is damaged or has another schema fails the job."""
    plain = schema.to_json() if schema else None
    wanted = fingerprint(schema) if schema else None

    def over(batches):
        known = JsonType.from_json(plain) if plain else None
        for batch in batches:
            out = []
            for data in batch.column(column).to_pylist():
                if data is None:
                    out.append(None)
                    continue
                frame, _ = frames.read(data)
                if not frame.schema and frame.schema_id != wanted:
                    raise CodecError(f"schema {frame.schema_id} isn't at hand")
                own = JsonType.from_json(frame.schema.decode()) if frame.schema else known
                out.append(jsonbytes.canonical(rows.decode(frame.payload, own)[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return df.mapInArrow(over, f"{fields}, decoded string")


def stats(framed: DataFrame, text: str, frame: str = "frame") -> DataFrame:
    """Messages, bytes in and out, and their ratio (1 for none)."""
    size_in, size_out = F.sum(F.octet_length(text)), F.sum(F.octet_length(frame))
    return framed.agg(F.count(frame).alias("messages"), F.coalesce(size_in, F.lit(0)).alias("bytes_in"), F.coalesce(size_out, F.lit(0)).alias("bytes_out"), F.coalesce(size_out / F.nullif(size_in, F.lit(0)), F.lit(1.0)).alias("ratio"))


def compress_auto(data: bytes) -> bytes:
    """Template form for JSON of more than 1000 bytes, else LZ blocks; a byte tells which."""
    if templates.is_json(data) and len(data) > 1000:
        return b"T" + templates.encode(data)
    return b"B" + frames.write_blocks(data)


def decompress_auto(data: bytes) -> bytes:
    if data[:1] == b"T":
        return templates.decode(data[1:])
    if data[:1] == b"B":
        return frames.read_blocks(data[1:])
    raise CodecError("unknown form")


class Stream:
    """Both ends of one state stream outside Spark, for applications and tests: the sender's
    updates are numbered and carry hashes of the states that they join, so that a receiver notices
    a lost message."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.sent = self.received = None
        self.seq_out = self.seq_in = 0
        self.started = self.joined = False

    def update(self, text: str) -> dict:
        value = jsonbytes.parse(text)
        op = diff.diff(self.sent, value, not self.started)
        out = {"seq": self.seq_out, "base_hash": _hash(self.sent) if self.started else 0, "new_hash": _hash(value), "delta": diff.serialise(op)}
        self.sent, self.started, self.seq_out = value, True, self.seq_out + 1
        return out

    def receive(self, message: dict) -> str:
        op, _ = diff.deserialise(message["delta"])
        if op[0] != "add" and (not self.joined or message["base_hash"] != _hash(self.received)):
            raise diff.Desync(f"message {message['seq']} starts from another state")
        value = diff.patch(self.received, op, not self.joined)
        if _hash(value) != message["new_hash"]:
            raise diff.Desync(f"message {message['seq']} leads to another state")
        self.received, self.joined, self.seq_in = value, True, message["seq"] + 1
        return jsonbytes.canonical(value)


def _hash(value) -> int:
    return frames.fnv1a64(json.dumps(value, sort_keys=True).encode()) >> 1
