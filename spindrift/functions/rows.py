"""Records as bytes by their schema: values in the order of the fields, without the keys.

Fields that may lack have a byte that says whether they are there. Types of one kind are written
bare, others as tagged JSON values; timestamps and uuids are packed where their text comes back.
"""

from __future__ import annotations

import datetime
import re
import struct

from ..types import JsonType, looks_like_uuid
from . import jsonbytes as J
from .varint import CodecError, read_signed_varint, read_sized, read_varint, signed_varint, sized, varint

_ISO = re.compile(r"(\d{4})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d)(?:\.(\d{1,3}))?Z|(\d{4})-(\d\d)-(\d\d)")
_EPOCH = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
ABSENT, NULL, PACKED, PLAIN = range(4)


def iso_to_millis(text: str) -> int | None:
    """Milliseconds of a UTC time or a date; None for other texts and for times that don't exist."""
    if not (m := _ISO.fullmatch(text)):
        return None
    y, mo, d, h, mi, s, f, dy, dm, dd = m.groups()
    try:
        at = datetime.datetime(int(y), int(mo), int(d), int(h), int(mi), int(s), tzinfo=datetime.UTC) if y else datetime.datetime(int(dy), int(dm), int(dd), tzinfo=datetime.UTC)
    except ValueError:
        return None
    return (at - _EPOCH) // datetime.timedelta(seconds=1) * 1000 + int((f or "0").ljust(3, "0"))


def millis_to_iso(millis: int) -> str:
    seconds, rest = divmod(millis, 1000)
    at = _EPOCH + datetime.timedelta(seconds=seconds)
    return f"{at.year:04}-{at:%m-%dT%H:%M:%S}" + (f".{rest:03}" if rest else "") + "Z"


def encode(value, of: JsonType) -> bytes:
    kinds = of.kinds
    if len(kinds) != 1 or of.null:
        return J.encode(value)
    kind = kinds[0]
    if kind == "boolean" and isinstance(value, bool):
        return bytes([value])
    if kind.startswith("int") and isinstance(value, int) and not isinstance(value, bool):
        return struct.pack(f"<{ {8: 'b', 16: 'h', 32: 'i'}[of.width]}", value) if of.width < 64 else signed_varint(value)
    if kind in ("string", "timestamp", "uuid") and isinstance(value, str):
        if kind == "timestamp" and (ms := iso_to_millis(value)) is not None and millis_to_iso(ms) == value:
            return bytes([PACKED]) + signed_varint(ms)
        if kind == "uuid" and value == value.lower() and looks_like_uuid(value):
            return bytes([PACKED]) + bytes.fromhex(value.replace("-", ""))
        return (b"" if kind == "string" else bytes([PLAIN])) + sized(value.encode())
    if kind == "array" and isinstance(value, list):
        return varint(len(value)) + b"".join(encode(v, of.element) for v in value)
    if kind == "object" and isinstance(value, dict):
        if extra := value.keys() - {n for n, _, _ in of.fields}:
            raise CodecError(f"fields that the schema lacks: {sorted(extra)}")
        out = []
        for n, t, optional in of.fields:
            if n not in value and not optional:
                raise CodecError(f"required field {n} is missing")
            out.append((bytes([n in value]) if optional else b"") + (encode(value[n], t) if n in value else b""))
        return b"".join(out)
    if kind == "real":
        return J.encode(value)
    raise CodecError(f"{value!r} is no {of.name()}")


def decode(data: bytes, of: JsonType, at: int = 0):
    """The value at a place, and the place after it."""
    kinds = of.kinds
    if len(kinds) != 1 or of.null or kinds[0] == "real":
        return J.decode(data, at)
    kind = kinds[0]
    if kind in ("boolean", "timestamp", "uuid") and at >= len(data):
        raise CodecError("truncated record")
    if kind == "boolean":
        return bool(data[at]), at + 1
    if kind.startswith("int"):
        if of.width == 64:
            return read_signed_varint(data, at)
        n = of.width // 8
        if at + n > len(data):
            raise CodecError("truncated record")
        return int.from_bytes(data[at : at + n], "little", signed=True), at + n
    if kind == "timestamp" and data[at] == PACKED:
        ms, at = read_signed_varint(data, at + 1)
        return millis_to_iso(ms), at
    if kind == "uuid" and data[at] == PACKED:
        if at + 17 > len(data):
            raise CodecError("truncated record")
        h = data[at + 1 : at + 17].hex()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:])), at + 17
    if kind in ("string", "timestamp", "uuid"):
        raw, at = read_sized(data, at + (kind != "string"))
        return raw.decode(), at
    if kind == "array":
        n, at = read_varint(data, at)
        out = []
        for _ in range(n):
            value, at = decode(data, of.element, at)
            out.append(value)
        return out, at
    held = {}
    for n, t, optional in of.fields:
        if optional:
            if at >= len(data):
                raise CodecError("truncated record")
            there, at = data[at], at + 1
            if not there:
                continue
        held[n], at = decode(data, t, at)
    return held, at
