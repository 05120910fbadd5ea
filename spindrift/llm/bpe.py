"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

Every byte is written as one printable character, so that each entry of the rank file becomes one
piece of the model, scored by its negative rank; the normaliser is the identity. Merging the best
scored pair first is then merging the lowest rank first. Texts are cut into pre-tokens, each is
encoded by itself, and decoding maps ids to bytes through the inverse of the byte table.

Null texts are empty and have no ids. Repeated rows give repeated results. A text is never cut.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import kept, map_texts, slices, table

#: Bytes of chunks and pre-tokens and their ids that one Python worker keeps, about (the caches are
#: emptied beyond that, between two slices of texts), and bytes of an entry beside its own.
CACHE_BYTES, ENTRY_BYTES = 64 << 20, 180


def byte_characters() -> list[str]:
    """The character of each byte: itself if it is printable in Latin-1, else one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file: base64, a space and the rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol buffer field: a varint, a 32-bit float or a length-delimited value."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece i is the token of the i-th lowest rank."""
    characters = byte_characters()
    tokens = sorted(ranks, key=ranks.__getitem__)
    pieces = [_field(1, "".join(characters[b] for b in t).encode()) + _field(2, -float(ranks[t])) + _field(3, 1) for t in tokens]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class ByteBpe:
    """Encodes and decodes texts by a rank file; made once in each Python worker."""

    def __init__(self, rank_file: bytes, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(rank_file)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.pattern = regex.compile(pattern)
        tokens = sorted(self.ranks, key=self.ranks.__getitem__)
        self.rank_of_piece = np.array([self.ranks[t] for t in tokens], dtype="<u4")
        self.to_characters = dict(enumerate(byte_characters()))
        # decoding: piece characters back to bytes, all tokens in one buffer
        back = {c: b for b, c in self.to_characters.items()}
        held = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        top = int(self.rank_of_piece.max(initial=0)) + 1
        self.lengths = np.zeros(top, dtype=np.int64)
        self.lengths[self.rank_of_piece] = [len(t) for t in held]
        self.starts = np.zeros(top, dtype=np.int64)
        self.starts[self.rank_of_piece] = np.cumsum([0, *map(len, held)])[:-1]
        self.flat = np.frombuffer(b"".join(held), dtype=np.uint8)
        self.pretokens: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}
        self.size = 0

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of a text; the usual shapes without the pattern."""
        word = text[1:] if text[:1] == " " else text
        if word.isalpha():
            return [text]
        if word[:-1].isalpha() and word[-1:] in (",", "."):
            return [text[:-1], text[-1]]
        return self.pattern.findall(text)

    def learn(self, pretokens) -> None:
        """Puts the ids of all given pre-tokens into the cache; the model gets new ones in one call."""
        new = []
        for pretoken in {*pretokens}:
            if pretoken in self.pretokens:
                continue
            self.size += ENTRY_BYTES + 5 * len(pretoken)
            if (rank := self.ranks.get(pretoken.encode())) is not None:
                self.pretokens[pretoken] = struct.pack("<I", rank)
            else:
                new.append(pretoken)
        written = [p.encode().decode("latin-1").translate(self.to_characters) for p in new]
        for pretoken, pieces in zip(new, self.model.encode(written, num_threads=1) if new else (), strict=True):
            self.pretokens[pretoken] = self.rank_of_piece[pieces].tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        A single space between two other characters always begins a pre-token, so what lies
        between such spaces can be encoded by itself and kept; a text with longer white space
        next to a space is matched as a whole.
        """
        if self.size > CACHE_BYTES:
            self.chunks.clear()
            self.pretokens.clear()
            self.size = 0
        cut = [text.split(" ") for text in texts]
        missing = [c for c in set().union(*(c[1:] for c in cut)) if c not in self.chunks]
        # a chunk with white space at an end belongs to a longer run
        own = {c: None if not c or c[0].isspace() or c[-1].isspace() else self.cut(" " + c) for c in missing}
        self.learn(p for pretokens in own.values() if pretokens for p in pretokens)
        for chunk, pretokens in own.items():
            self.chunks[chunk] = pretokens and b"".join(map(self.pretokens.__getitem__, pretokens))
            self.size += ENTRY_BYTES + 5 * len(chunk)
        out: list[bytes | None] = []
        whole: dict[int, list[str]] = {}
        for i, (first, *rest) in enumerate(cut):
            ids = list(map(self.chunks.__getitem__, rest))
            if None in ids or rest and (not first or first[-1].isspace()):
                whole[i] = self.pattern.findall(texts[i])
                out.append(None)
            else:
                whole[i] = self.pattern.findall(first)
                out.append(b"".join(ids))
        self.learn(p for pretokens in whole.values() for p in pretokens)
        for i, pretokens in whole.items():
            out[i] = b"".join(map(self.pretokens.__getitem__, pretokens)) + (out[i] or b"")
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        ranks = np.frombuffer(ids, dtype="<u4")
        lengths = self.lengths[ranks]
        ends = np.cumsum(lengths)
        if not len(ends) or not ends[-1]:
            return b""
        at = np.repeat(self.starts[ranks] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


def rank_file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def coder(rank_file: bytes, pattern: str) -> ByteBpe:
    return kept(("bytes", hashlib.sha256(rank_file).digest(), pattern), lambda: ByteBpe(rank_file, pattern))


def _over(df: DataFrame, schema: str, rank_path: str, pattern: str, rows) -> DataFrame:
    """Keeps the first column and maps the second (the text) through rows(coder, its ids). The rank
    file is read on the driver and broadcast: executors need no copy, and its size is fixed."""
    held = df.sparkSession.sparkContext.broadcast(rank_file_bytes(rank_path))
    names = [c.split()[0] for c in schema.split(", ")]

    def over(batches):
        bpe = coder(held.value, pattern)
        for batch in batches:
            for part in slices(batch, 1):
                found = [rows(bpe, ids) for ids in bpe.encode_many([text or "" for text in part.column(1).to_pylist()])]
                if found:
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in zip(*found, strict=True))], names=names)

    return map_texts(df, over, schema, keeps=True)


def encode_decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded binary): each text's ids and the bytes that they decode to."""

    def rows(bpe, ids):
        return ids, bpe.decode(ids)

    kind = df.schema[id_col].dataType.simpleString()
    return _over(df.select(id_col, text_col), f"{id_col} {kind}, ids binary, decoded binary", rank_path, pattern, rows)


def digests(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_decode, but the digests of both, so that ids needn't leave the worker."""

    def rows(bpe, ids):
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    kind = df.schema[id_col].dataType.simpleString()
    return _over(df.select(id_col, text_col), f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", rank_path, pattern, rows)


def lengths(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = df.schema[id_col].dataType.simpleString()
    return _over(df.select(id_col, text_col), f"{id_col} {kind}, n_tokens bigint", rank_path, pattern, lambda bpe, ids: (len(ids) // 4,))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
