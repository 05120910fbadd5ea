"""JSON values as bytes: a tag, then what it needs."""

from __future__ import annotations

import json
import struct

from .varint import CodecError, read_signed_varint, read_sized, read_varint, signed_varint, sized, varint

NULL, FALSE, TRUE, INTEGER, REAL, TEXT, LIST, OBJECT, BIG = range(9)
MAX_DEPTH = 200
_TAGS = [bytes([tag]) for tag in range(9)]
_SHORT_TEXT = [bytes([TEXT, n]) for n in range(128)]


def parse(text: str):
    """The value of a JSON text; of repeated keys the last wins."""
    return _DECODER.decode(text) if isinstance(text, str) and not text.startswith("\ufeff") else json.loads(text, parse_constant=_refuse)


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def canonical(value) -> str:
    """Compact JSON with sorted keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def same(a, b) -> bool:
    """Equality of JSON values: true is not 1, and 1 is not 1.0."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all([same(v, b[k]) for k, v in a.items()])
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def encode(value) -> bytes:
    if isinstance(value, str):
        raw = value.encode()
        return (_SHORT_TEXT[len(raw)] if len(raw) < 128 else _TAGS[TEXT] + varint(len(raw))) + raw
    if value is None:
        return _TAGS[NULL]
    if isinstance(value, bool):
        return _TAGS[TRUE if value else FALSE]
    if isinstance(value, int):
        if -(1 << 63) <= value < 1 << 63:
            return _TAGS[INTEGER] + signed_varint(value)
        return _TAGS[BIG] + sized(str(value).encode())
    if isinstance(value, float):
        return _TAGS[REAL] + struct.pack("<d", value)
    if isinstance(value, list):
        return _TAGS[LIST] + varint(len(value)) + b"".join(map(encode, value))
    return _TAGS[OBJECT] + varint(len(value)) + b"".join(sized(k.encode()) + encode(v) for k, v in sorted(value.items()))


def decode(data: bytes, at: int = 0, depth: int = 0):
    """The value at a place, and the place after it."""
    if at >= len(data):
        raise CodecError("truncated value")
    if depth > MAX_DEPTH:
        raise CodecError("nested too deeply")
    tag, at = data[at], at + 1
    if tag == TEXT or tag == BIG:
        raw, at = read_sized(data, at)
        return (raw.decode() if tag == TEXT else int(raw)), at
    if tag == INTEGER:
        return read_signed_varint(data, at)
    if tag == REAL:
        if at + 8 > len(data):
            raise CodecError("truncated number")
        return struct.unpack_from("<d", data, at)[0], at + 8
    if tag <= TRUE:
        return (None, False, True)[tag], at
    n, at = read_varint(data, at)
    if tag == LIST:
        out = []
        for _ in range(n):
            value, at = decode(data, at, depth + 1)
            out.append(value)
        return out, at
    if tag == OBJECT:
        held = {}
        for _ in range(n):
            key, at = read_sized(data, at)
            held[key.decode()], at = decode(data, at, depth + 1)
        return held, at
    raise CodecError(f"unknown tag {tag}")
