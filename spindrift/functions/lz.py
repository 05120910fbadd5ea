"""Byte LZ coding in sequences of literals and one earlier match, and blocks of it."""

from __future__ import annotations

from .varint import CodecError, read_varint, varint

LEAST_MATCH, WINDOW, LEAST_INPUT = 4, 65_535, 8
#: Declared sizes beyond this are refused.
MAX_SIZE = 1 << 30
STORED, CODED = 0, 1
BLOCK = 65_536


def compress(data: bytes) -> bytes:
    """A stored or coded body after its size. Coded: (literals, their bytes, match length, distance)
    again and again; the last has no match."""
    coded = _coded(data) if len(data) >= LEAST_INPUT else None
    if coded is None or len(coded) >= len(data):
        return bytes([STORED]) + varint(len(data)) + data
    return bytes([CODED]) + varint(len(data)) + coded


def _coded(data: bytes) -> bytes:
    out, last, at, start = bytearray(), {}, 0, 0
    seen, put, size = last.get, out.append, len(data)
    end = size - LEAST_MATCH
    while at <= end:
        head = data[at : at + LEAST_MATCH]
        found = seen(head, -1)
        last[head] = at
        if found < 0 or at - found > WINDOW:
            at += 1
            continue
        here, there = at + LEAST_MATCH, found + LEAST_MATCH
        # byte by byte, then in steps; a match may run into what it produces
        few = min(here + 16, size)
        while here < few and data[there] == data[here]:
            here += 1
            there += 1
        if here == few:
            step = 16
            while here + step <= size and data[there : there + step] == data[here : here + step]:
                here += step
                there += step
                step = min(2 * step, 4096)
            while here < size and data[there] == data[here]:
                here += 1
                there += 1
        run, n, distance = at - start, here - at - LEAST_MATCH + 1, at - found
        if run < 128 and n < 128 and distance < 1 << 14:
            put(run)
            out += data[start:at]
            put(n)
            if distance < 128:
                put(distance)
            else:
                put(distance & 127 | 128)
                put(distance >> 7)
        else:
            out += varint(run) + data[start:at] + varint(n) + varint(distance)
        at = start = here
    return bytes(out + varint(size - start) + data[start:] + varint(0))


def decompress(data: bytes) -> bytes:
    if not data or data[0] > CODED:
        raise CodecError("unknown kind of body")
    size, at = read_varint(data, 1)
    if size > MAX_SIZE:
        raise CodecError("declared size beyond the limit")
    if data[0] == STORED:
        if len(data) - at != size:
            raise CodecError("stored size differs")
        return data[at:]
    try:
        return _decoded(data, at, size)
    except IndexError:
        raise CodecError("truncated") from None


def _decoded(data: bytes, at: int, size: int) -> bytes:
    out, given, done = bytearray(), len(data), 0
    while True:
        n = data[at]
        if n < 128:
            at += 1
        else:
            n, at = read_varint(data, at)
        if at + n > given:
            raise CodecError("truncated literals")
        if n:
            out += data[at : at + n]
            at += n
            done += n
        n = data[at]
        if n < 128:
            at += 1
        else:
            n, at = read_varint(data, at)
        if not n:
            break
        distance = data[at]
        if distance < 128:
            at += 1
        else:
            distance, at = read_varint(data, at)
        n += LEAST_MATCH - 1
        if not 0 < distance <= done or done + n > size:
            raise CodecError("match outside the data")
        start = done - distance
        out += out[start : start + n] if n <= distance else (out[start:] * (n // distance + 1))[:n]
        done += n
    if done != size:
        raise CodecError("decoded size differs")
    return bytes(out)


def compress_blocks(data: bytes, block: int = BLOCK) -> list[bytes]:
    """Blocks that can be decoded each by itself."""
    return [compress(data[i : i + block]) for i in range(0, len(data), block)]
