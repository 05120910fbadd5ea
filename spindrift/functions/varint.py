"""Variable-length and zigzag integers."""

from __future__ import annotations

MAX_BYTES = 10
_ONE_BYTE = [bytes([u]) for u in range(128)]


class CodecError(ValueError):
    """Bytes that no encoder of this package writes."""


def zigzag(n: int) -> int:
    """Signed to unsigned, small magnitudes first: 0, -1, 1, -2, ... become 0, 1, 2, 3, ..."""
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(u: int) -> int:
    return -(u + 1) // 2 if u & 1 else u // 2


def varint(u: int) -> bytes:
    """Seven bits a byte, lowest first; the high bit says that more follow."""
    if 0 <= u < 128:
        return _ONE_BYTE[u]
    if not 0 <= u < 1 << 64:
        raise CodecError(f"{u} is no unsigned 64-bit integer")
    out = bytearray()
    while True:
        u, low = u >> 7, u & 0x7F
        out.append(low | (0x80 if u else 0))
        if not u:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """The integer at a place, and the place after it."""
    if at < len(data) and data[at] < 128:
        return data[at], at + 1
    value = 0
    for i in range(MAX_BYTES):
        if at + i >= len(data):
            raise CodecError("truncated variable-length integer")
        byte = data[at + i]
        value |= (byte & 0x7F) << 7 * i
        if byte < 0x80:
            if value >= 1 << 64:
                break
            return value, at + i + 1
    raise CodecError("variable-length integer of more than 64 bits")


def signed_varint(n: int) -> bytes:
    return varint(2 * n if n >= 0 else -2 * n - 1)


def read_signed_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    u, at = read_varint(data, at)
    return -(u + 1) // 2 if u & 1 else u // 2, at


def varint_size(u: int) -> int:
    return (u.bit_length() + 6) // 7 or 1


def sized(data: bytes) -> bytes:
    n = len(data)
    return (_ONE_BYTE[n] if n < 128 else varint(n)) + data


def read_sized(data: bytes, at: int = 0) -> tuple[bytes, int]:
    n, at = read_varint(data, at)
    end = at + n
    if end > len(data):
        raise CodecError("truncated value")
    return data[at:end], end
