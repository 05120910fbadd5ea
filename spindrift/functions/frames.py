"""Frames: what is stored or sent, with its codecs, schema and checksum said in front.

    magic 4 | version 1 | flags 1 | schema id 8 | payload size 4 | CRC-32C 4 | payload

The checksum covers the header before it and the payload. Frames can be written one after another.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from . import entropy, lz
from .varint import CodecError, read_sized, read_varint, sized, varint

MAGIC, VERSION = b"SPDF", 1
LZ, ENTROPY, SCHEMA, DELTA, COLUMNAR, BLOCKS = 1, 2, 4, 8, 16, 32
_HEAD = struct.Struct("<4sBBQII")
HEADER_SIZE = _HEAD.size
MAX_PAYLOAD = 1 << 30


#: Bytes that a CRC takes at once, and those that it takes one by one.
SPAN, FEW = 1024, 64


def _crc_tables() -> np.ndarray:
    """For each place before the end of a span, farthest first, what each byte there adds to the CRC
    (Castagnoli polynomial)."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = first >> 1 ^ np.where(first & 1, np.uint32(0x82F63B78), np.uint32(0))
    tables = np.empty((SPAN, 256), np.uint32)
    tables[-1] = first
    for place in range(SPAN - 2, -1, -1):
        tables[place] = first[tables[place + 1] & 255] ^ tables[place + 1] >> 8
    return tables


_TABLES = _crc_tables()
_CRC, _FLAT, _PLACES = _TABLES[-1].tolist(), _TABLES.ravel(), np.arange(SPAN) * 256


def crc32c(data: bytes, crc: int = 0) -> int:
    crc ^= 0xFFFFFFFF
    at = 0
    while len(data) - at >= FEW:
        n = min(SPAN, len(data) - at)
        head = (int.from_bytes(data[at : at + 4], "little") ^ crc).to_bytes(4, "little")
        crc = int(np.bitwise_xor.reduce(_FLAT[_PLACES[SPAN - n :] + np.frombuffer(head + data[at + 4 : at + n], np.uint8)]))
        at += n
    for b in data[at:]:
        crc = _CRC[(crc ^ b) & 255] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def fnv1a64(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


@dataclass(frozen=True)
class Options:
    """What a frame may use: LZ and entropy coding are kept only where they make it shorter."""

    lz: bool = True
    entropy: bool = True


@dataclass(frozen=True)
class Frame:
    flags: int
    schema_id: int
    payload: bytes
    schema: bytes = b""


def write(payload: bytes, schema_id: int = 0, schema: bytes = b"", options: Options = Options(), flags: int = 0) -> bytes:
    body = payload
    if options.lz and len(coded := lz.compress(body)) < len(body):
        body, flags = coded, flags | LZ
    if options.entropy and len(coded := entropy.compress(body)) < len(body):
        body, flags = coded, flags | ENTROPY
    if schema:
        body, flags = sized(schema) + body, flags | SCHEMA
    head = _HEAD.pack(MAGIC, VERSION, flags, schema_id, len(body), 0)[:-4]
    return head + struct.pack("<I", crc32c(head + body)) + body


def read(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The frame at a place and the place after it."""
    if len(data) - at < HEADER_SIZE:
        raise CodecError("truncated header")
    magic, version, flags, schema_id, size, crc = _HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise CodecError("no frame")
    if version != VERSION:
        raise CodecError(f"frame version {version}")
    end = at + HEADER_SIZE + size
    if size > MAX_PAYLOAD or end > len(data):
        raise CodecError("truncated payload")
    body = data[at + HEADER_SIZE : end]
    if crc32c(data[at : at + HEADER_SIZE - 4] + body) != crc:
        raise CodecError("checksum differs")
    schema = b""
    if flags & SCHEMA:
        schema, start = read_sized(body)
        body = body[start:]
    if flags & ENTROPY:
        body = entropy.decompress(body)
    if flags & LZ:
        body = lz.decompress(body)
    return Frame(flags, schema_id, body, schema), end


def read_all(data: bytes):
    at = 0
    while at < len(data):
        frame, at = read(data, at)
        yield frame


def write_blocks(data: bytes, block: int = lz.BLOCK) -> bytes:
    """A frame of LZ blocks, each after its size, ended by a size of 0."""
    body = b"".join(map(sized, lz.compress_blocks(data, block))) + varint(0)
    return write(body, options=Options(False, False), flags=BLOCKS)


def read_blocks(data: bytes) -> bytes:
    frame, _ = read(data)
    if not frame.flags & BLOCKS:
        raise CodecError("no block frame")
    out, at = [], 0
    while True:
        n, start = read_varint(frame.payload, at)
        if not n:
            return b"".join(out)
        if start + n > len(frame.payload):
            raise CodecError("truncated block")
        out.append(lz.decompress(frame.payload[start : start + n]))
        at = start + n
