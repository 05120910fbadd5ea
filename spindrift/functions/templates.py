"""JSON tokens, and templates: the shape of a document apart from its values."""

from __future__ import annotations

import json
import re

from . import entropy, frames, lz
from .varint import CodecError, read_sized, read_varint, sized, varint

_TOKEN = re.compile(r'[ \t\n\r]*(?:(?P<string>"(?:[^"\\]|\\.)*")|(?P<number>-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<literal>true|false|null)|(?P<punctuation>[{}\[\],:]))', re.S)
#: A value, or else keys' lexemes and punctuation.
_PART = re.compile(r'[ \t\n\r]*(?:(?P<kept>"(?:[^"\\]|\\.)*+"(?=[ \t\n\r]*:)|[{}\[\],:]+)|(?P<value>"(?:[^"\\]|\\.)*+"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))', re.S)
_PUNCTUATION = {"{": "object_start", "}": "object_end", "[": "array_start", "]": "array_end", ",": "comma", ":": "colon"}
SLOT = "\x00"
TEMPLATED, BLOCKS = 1, 0
LEAST_TEMPLATED = 50


def is_json(data: bytes) -> bool:
    """Whether the first byte that isn't white space opens an object or an array."""
    return data.lstrip(b" \t\n\r")[:1] in (b"{", b"[")


def tokens(text: str):
    """(kind, start, length) of each token; what no token fits ends them with an error token."""
    at = 0
    while m := _TOKEN.match(text, at):
        kind = m.lastgroup
        start = m.start(kind)
        yield _PUNCTUATION[m[kind]] if kind == "punctuation" else m[kind] if kind == "literal" else kind, start, m.end() - start
        at = m.end()
    rest = text[at:]
    if rest.strip(" \t\n\r"):
        start = at + len(rest) - len(rest.lstrip(" \t\n\r"))
        yield "error", start, len(text) - start


def extract(text: str) -> tuple[str, list[str]]:
    """(pattern, values): keys and punctuation, with a slot for each value; the values' lexemes."""
    pattern, values, at, end = [], [], 0, len(text)
    while at < end and (m := _PART.match(text, at)):
        if m.lastgroup == "value":
            pattern.append(SLOT)
            values.append(m["value"])
        else:
            pattern.append(m["kept"])
        at = m.end()
    if text[at:].strip(" \t\n\r"):
        raise CodecError("no JSON")
    return "".join(pattern), values


def reconstruct(pattern: str, values: list[str]) -> str:
    parts = pattern.split(SLOT)
    if len(parts) != len(values) + 1:
        raise CodecError("as many values as slots are needed")
    return "".join(x for pair in zip(parts, [*values, ""], strict=True) for x in pair)


def pattern_hash(pattern: str) -> int:
    return frames.fnv1a64(pattern.encode())


def encode(data: bytes) -> bytes:
    """Template and values where the input is JSON and that is shorter, else LZ blocks. The white
    space between tokens isn't kept: what comes back is the same JSON, in compact form."""
    if len(data) > LEAST_TEMPLATED and is_json(data):
        try:
            text = data.decode()
            json.loads(text)
            pattern, values = extract(text)
            if SLOT not in text:
                body = sized(pattern.encode()) + varint(len(values)) + b"".join(sized(v.encode()) for v in values)
                matched = lz.compress(body)
                how = min(range(4), key=[len(body), entropy.compressed_size(body), len(matched), entropy.compressed_size(matched)].__getitem__)
                body = matched if how & 2 else body
                coded = bytes([TEMPLATED, how]) + (entropy.compress(body) if how & 1 else body)
                if len(coded) < len(data):
                    return coded
        except ValueError:
            pass
    return bytes([BLOCKS]) + frames.write_blocks(data)


def decode(data: bytes) -> bytes:
    if not data or data[0] > TEMPLATED:
        raise CodecError("unknown form")
    if data[0] == BLOCKS:
        return frames.read_blocks(data[1:])
    how, body = data[1] if len(data) > 1 else 9, data[2:]
    if how > 3:
        raise CodecError("unknown form")
    if how & 1:
        body = entropy.decompress(body)
    if how & 2:
        body = lz.decompress(body)
    pattern, at = read_sized(body)
    n, at = read_varint(body, at)
    values = []
    for _ in range(n):
        raw, at = read_sized(body, at)
        values.append(raw.decode())
    return reconstruct(pattern.decode(), values).encode()
