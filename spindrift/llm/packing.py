"""Packing of documents into sequences by minimum bin slack.

Texts become token ids with an end id; only documents longer than a sequence are cut. What is
packed are pieces, of which at most `capacity` lengths differ. So the plan is made from the count
of each length alone, on the driver: each sequence takes the longest piece left, and a subset-sum
dynamic program over the lengths left (one big integer as a bit set of reachable fills) finds the
fullest combination for the rest. A combination is removed as often as the counts allow before the
next one is sought, so that the number of steps is bounded by the lengths, not by the documents.
Pieces then find their place by their rank among the pieces of their length.

Null texts are empty and take one id. Repeated rows are packed each. An empty table packs into
nothing. Columns other than the id and the text are ignored.
"""

import hashlib
import os
import string
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import kept, map_texts, slices, table, written

CAPACITY = 4096
#: Bytes of words and their ids that one Python worker keeps, about, and bytes of an entry beside its
#: characters and ids.
CACHE_BYTES, ENTRY_BYTES = 128 << 20, 110


#: Fixed value: what the tokenizer's file calls a pre-token.
PRETOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class WordEncoder(dict):
    """Encodes by a tokenizer whose pre-tokens never hold white space, word by word and once for
    each word: what lies between blanks and line ends is encoded by itself. The words met so far
    are the entries. Words of characters that composing and lower-casing leave in place are cut
    into pre-tokens here; all others pass through the whole tokenizer."""

    def __init__(self, tokenizer_json: bytes):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer_json)
        self.model = self.tokenizer.model
        self.to_characters = dict(enumerate(byte_characters()))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = 0
        self.older: dict[str, bytes] = {}
        self.marks = {p: self.pretoken(p) for p in string.punctuation + string.digits}

    def whole(self, text: str) -> bytes:
        found = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def pretoken(self, text: str) -> bytes:
        """Ids of one pre-token of characters below U+0250, in lower case."""
        found = self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.to_characters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def cut(self, word: str) -> bytes:
        if word[-1:] in (",", ".") and word[:-1].isalpha():
            pieces = [word[:-1], word[-1]]
        else:
            pieces = PRETOKENS.findall(word)
        return b"".join([self.get(p) or self.marks.get(p) or self.pretoken(p) for p in pieces])

    def __missing__(self, word: str) -> bytes:
        if (ids := self.older.get(word)) is None:
            if not word.isprintable() or max(word, default="") >= "\u0250" or "\u0130" in word:
                ids = self.whole(word)
            else:  # composed already, and each letter has one lower-case form, a letter again
                ids = self.pretoken(word.lower()) if word.isalpha() else self.cut(word.lower())
        self.size += ENTRY_BYTES + len(word) + len(ids)
        self[word] = ids
        return ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. Texts that may hold the string
        of a special token are encoded whole, as such strings are cut out first."""
        if self.size > CACHE_BYTES // 2:  # words that are met again move on, the others go with the next turn
            self.older = dict(self)
            self.clear()
            self.size = 0
        # lower case only saves words: the tokenizer, too, makes ASCII lower case
        return [self.whole(text) if any(map(text.__contains__, self.special)) else b"".join(map(self.__getitem__, (text.lower() if text.isascii() else text).replace("\n", " ").split(" "))) for text in texts]


def word_encoder(tokenizer_json: bytes) -> WordEncoder:
    return kept(("words", hashlib.sha256(tokenizer_json).digest()), lambda: WordEncoder(tokenizer_json))


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over a histogram of lengths: (times, [(length, copies), ...]) for each
    combination, in the order of removal."""
    left = {l: n for l, n in counts.items() if n > 0}
    lengths = sorted(left, reverse=True)
    plan = []
    while lengths:
        seed = lengths[0]
        room = capacity - seed
        left[seed] -= 1
        mask, reach, steps = (1 << room + 1) - 1, 1, []
        for l in lengths:
            if l > room or not left[l]:
                continue
            steps.append((l, reach))
            copies, step = min(left[l], room // l), 1
            while copies:  # 1, 2, 4, ... copies, then the rest
                take = min(step, copies)
                reach |= reach << take * l & mask
                copies -= take
                step *= 2
            if reach >> room & 1:
                break
        fill, used = reach.bit_length() - 1, {seed: 1}
        for l, before in reversed(steps):
            copies = 0
            while not before >> fill & 1:
                fill -= l
                copies += 1
            if copies:
                used[l] = used.get(l, 0) + copies
        left[seed] += 1
        times = min(left[l] // k for l, k in used.items())
        for l, k in used.items():
            left[l] -= times * k
        plan.append((times, sorted(used.items(), reverse=True)))
        if any(not left[l] for l in used):
            lengths = [l for l in lengths if left[l]]
    return plan


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted: pieces of a length, from
    that rank on, fill the sequences from the first one on, so many copies in each."""
    rows, taken, sequence = [], {}, 0
    for times, used in plan:
        offset = 0
        for length, copies in used:
            rows.append((length, taken.get(length, 0), sequence, copies, offset))
            taken[length] = taken.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def cut_pieces(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32 (and ids), and its place among
    its task's pieces of that length. The tokenizer file is read on the driver and broadcast."""
    with open(tokenizer_path, "rb") as f:
        held = df.sparkSession.sparkContext.broadcast(f.read())
    kind = df.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint" + ", ids binary" * with_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def over(batches):
        encoder, task, seen = word_encoder(held.value), TaskContext.get().partitionId(), {}
        for batch in batches:
            for part in slices(batch, 1):
                ids = [x + end for x in encoder.encode_many([t or "" for t in part.column(1).to_pylist()])]
                rows, of = [], []
                for i, x in enumerate(ids):
                    for piece, at in enumerate(range(0, len(x), 4 * capacity)):
                        own = x[at : at + 4 * capacity]
                        n = len(own) // 4
                        seen[n] = nth = seen.get(n, -1) + 1
                        of.append(i)
                        rows.append((piece, at // 4, n, zlib.crc32(own), task, nth, *([own] if with_ids else [])))
                if rows:
                    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *columns], names=[c.split()[0] for c in schema.split(", ")])

    return map_texts(df.select(id_col, text_col), over, schema, keeps=True)


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset. What reaches the driver is one count for each length;
    what goes to the executors is the plan, bounded by the lengths too."""
    pieces = written(cut_pieces(df, tokenizer_path, end_id, capacity, id_col, text_col, with_ids), "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan_bins(counts, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "task"])
    held = df.sparkSession.sparkContext.broadcast(where)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        rows = held.value
        at = np.searchsorted(rows[:, 0] << 44 | rows[:, 1], length.to_numpy() << 44 | rank.to_numpy(), "right") - 1
        own = rows[at]
        nth = rank.to_numpy() - own[:, 1]
        return pd.DataFrame({"sequence_id": own[:, 2] + nth // own[:, 3], "offset": own[:, 4] + nth % own[:, 3] * own[:, 0]})

    columns = [id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    return ranked.withColumn("at", place("length", F.col("first") + F.col("nth"))).select(*columns, "at.sequence_id", "at.offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
