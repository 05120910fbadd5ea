"""Integer columns as bytes: delta, frame of reference with bit packing, and slot deltas."""

from __future__ import annotations

import numpy as np

from .varint import CodecError, read_signed_varint, read_varint, signed_varint, varint


#: Up to so many bits, plain integers are faster than arrays.
FEW = 32


def pack_bits(offsets, width: int) -> bytes:
    """Non-negative integers of so many bits each, lowest bit first."""
    if not width or not len(offsets):
        return b""
    values = np.asarray(offsets, dtype=np.uint64)
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, count: int) -> list[int]:
    if not width or not count:
        return [0] * count
    if len(data) * 8 < width * count:
        raise CodecError("truncated packed integers")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=width * count, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).tolist()


def encode_delta(values) -> bytes:
    """Count, then each value's difference to the one before it (the first to 0)."""
    out, before = [varint(len(values))], 0
    for v in values:
        out.append(signed_varint(v - before) if -(1 << 63) <= v - before < 1 << 63 else _wide(v - before))
        before = v
    return b"".join(out)


def _wide(difference: int) -> bytes:
    """Differences of 64-bit integers may need 65 bits; they wrap around, as the sums do."""
    return signed_varint((difference + (1 << 63)) % (1 << 64) - (1 << 63))


def decode_delta(data: bytes) -> list[int]:
    n, at = read_varint(data)
    if n > len(data):
        raise CodecError("more values than bytes")
    out, value = [], 0
    for _ in range(n):
        d, at = read_signed_varint(data, at)
        value = (value + d + (1 << 63)) % (1 << 64) - (1 << 63)
        out.append(value)
    return out


def encode_frame_of_reference(values) -> bytes:
    """Count, least value, width, and the packed offsets from the least."""
    if not len(values):
        return varint(0)
    low = min(values)
    width = (max(values) - low).bit_length()
    return varint(len(values)) + signed_varint(low) + varint(width) + pack_bits([v - low for v in values], width)


def decode_frame_of_reference(data: bytes) -> list[int]:
    n, at = read_varint(data)
    if not n:
        return []
    low, at = read_signed_varint(data, at)
    width, at = read_varint(data, at)
    if width > 64 or n * width > 8 * (len(data) - at):
        raise CodecError("truncated packed integers")
    return [low + v for v in unpack_bits(data[at:], width, n)]


def null_bitmap(present) -> bytes:
    """A bit for each value, lowest first; 1 is present."""
    if len(present) <= FEW:
        bits = (1 << len(present)) - 1 if all(present) else sum([1 << i for i, p in enumerate(present) if p])
        return bits.to_bytes((len(present) + 7) // 8, "little")
    return np.packbits(np.asarray(present, dtype=np.uint8), bitorder="little").tobytes()


def read_bitmap(data: bytes, count: int) -> list[bool]:
    if count <= FEW:
        bits = int.from_bytes(data, "little")
        return [True] * count if bits == (1 << count) - 1 else [bool(bits >> i & 1) for i in range(count)]
    return np.unpackbits(np.frombuffer(data, np.uint8), count=count, bitorder="little").astype(bool).tolist()


LITERAL, DELTA, SAME_DELTA = 0, 1, 2


def encode_slots(values) -> bytes:
    """Numbers of one slot in turn: the first as it is, then deltas; a delta equal to the one
    before it is one byte."""
    out, before, delta = [], None, None
    for v in values:
        if before is None:
            out.append(bytes([LITERAL]) + signed_varint(v))
        elif v - before == delta:
            out.append(bytes([SAME_DELTA]))
        else:
            delta = v - before
            out.append(bytes([DELTA]) + signed_varint(delta))
        before = v
    return varint(len(out)) + b"".join(out)


def decode_slots(data: bytes) -> list[int]:
    n, at = read_varint(data)
    out, delta = [], None
    for _ in range(n):
        if at >= len(data):
            raise CodecError("truncated slot")
        tag, at = data[at], at + 1
        if tag == LITERAL:
            value, at = read_signed_varint(data, at)
            out.append(value)
            continue
        if tag == DELTA:
            delta, at = read_signed_varint(data, at)
        if not out or delta is None or tag > SAME_DELTA:
            raise CodecError("a delta without a value before it")
        out.append(out[-1] + delta)
    return out
