"""Nibble entropy coding: the 15 most frequent bytes take half a byte each, the others three halves.

Modes: empty, one repeated byte, nibbles, or raw where nibbles wouldn't be shorter.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

from .varint import CodecError, read_varint, varint, varint_size

EMPTY, REPEATED, NIBBLES, RAW = range(4)
#: The nibble that says that two more nibbles name the byte.
ESCAPE = 15
#: Declared sizes beyond this are refused.
MAX_SIZE = 1 << 30
#: Up to so many bytes, texts of digits are faster than arrays.
FEW = 512
_OWN, _ESCAPED = "0123456789abcde", [f"f{b:02x}" for b in range(256)]


def byte_counts(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def shannon(data: bytes) -> float:
    """Bits for each byte."""
    if not data:
        return 0.0
    p = byte_counts(data) / len(data)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum()) + 0.0


def statistics(data: bytes) -> dict:
    """Input size, the size that the entropy allows, and how many bytes are distinct."""
    return {"input_size": len(data), "entropy_size": math.ceil(shannon(data) * len(data) / 8), "unique_symbols": int((byte_counts(data) > 0).sum())}


def _counted(data: bytes) -> dict[int, int]:
    return Counter(data) if len(data) <= FEW else {b: n for b, n in enumerate(byte_counts(data).tolist()) if n}


def _nibbles(counts: dict[int, int], n: int) -> tuple[int, int]:
    """Nibbles that so many bytes take, and the size of all in nibble mode."""
    found = 3 * n - 2 * sum(sorted(counts.values(), reverse=True)[:ESCAPE])
    return found, 2 + varint_size(n) + min(len(counts), ESCAPE) + (found + 1) // 2


def compressed_size(data: bytes) -> int:
    """The size of what compress gives, without making it."""
    if not data:
        return 1
    counts = _counted(data)
    return 2 + varint_size(len(data)) if len(counts) == 1 else min(_nibbles(counts, len(data))[1], len(data) + 1)


def compress(data: bytes) -> bytes:
    if not data:
        return bytes([EMPTY])
    counts = _counted(data)
    if len(counts) == 1:
        return bytes([REPEATED]) + varint(len(data)) + bytes(counts)
    size, whole = _nibbles(counts, len(data))
    if whole > len(data):
        return bytes([RAW]) + data
    # most frequent first, then by value
    top = sorted(sorted(counts), key=counts.__getitem__, reverse=True)[:ESCAPE]
    head = bytes([NIBBLES]) + varint(len(data)) + bytes([len(top) - 1]) + bytes(top)
    if len(data) <= FEW:
        digits = dict(zip(top, _OWN, strict=False))
        text = "".join([digits.get(b) or _ESCAPED[b] for b in data])
        return head + bytes.fromhex(text + "0" * (size % 2))
    code = np.full(256, ESCAPE, dtype=np.uint8)
    code[top] = np.arange(len(top), dtype=np.uint8)
    flat = np.frombuffer(data, np.uint8)
    own = code[flat]
    lengths = np.where(own == ESCAPE, 3, 1)
    at = np.cumsum(lengths) - lengths
    nibbles = np.zeros(size + size % 2, dtype=np.uint8)
    nibbles[at] = own
    rare = own == ESCAPE
    nibbles[at[rare] + 1] = flat[rare] >> 4
    nibbles[at[rare] + 2] = flat[rare] & 15
    return head + (nibbles[0::2] << 4 | nibbles[1::2]).tobytes()


def decompress(data: bytes) -> bytes:
    if not data:
        raise CodecError("no mode")
    mode = data[0]
    if mode == EMPTY:
        return b""
    if mode == RAW:
        return data[1:]
    n, at = read_varint(data, 1)
    if n > MAX_SIZE or mode > RAW:
        raise CodecError("unknown mode or declared size beyond the limit")
    if mode == REPEATED:
        if at >= len(data):
            raise CodecError("truncated")
        return data[at : at + 1] * n
    if at >= len(data):
        raise CodecError("truncated")
    top = data[at + 1 : at + 2 + data[at]]
    packed = data[at + 2 + data[at] :]
    if n > 2 * len(packed):
        raise CodecError("truncated")
    nibbles = np.empty(2 * len(packed), dtype=np.uint8)
    flat = np.frombuffer(packed, np.uint8)
    nibbles[0::2], nibbles[1::2] = flat >> 4, flat & 15
    # escapes are found one after another, as the two nibbles that follow may look like one
    text, escapes = nibbles.tobytes(), []
    found = text.find(ESCAPE)
    while found >= 0:
        escapes.append(found)
        found = text.find(ESCAPE, found + 3)
    if escapes and escapes[-1] + 2 >= len(text):
        nibbles = nibbles[: escapes.pop()]
    at, own = np.array(escapes, dtype=np.intp), np.ones(len(nibbles), dtype=bool)
    value = np.frombuffer(bytes(top[:ESCAPE]).ljust(16, b"\0"), np.uint8)[nibbles]
    known = nibbles < len(top)
    value[at], known[at] = nibbles[at + 1] << 4 | nibbles[at + 2], True
    own[at + 1] = own[at + 2] = False
    if not known[own][:n].all() or int(own.sum()) < n:
        raise CodecError("truncated")
    return value[own][:n].tobytes()
