"""State streams in Structured Streaming: the sender turns states into numbered deltas, the receiver
turns these back. Keys are kept in the state store, one value each.

Rows of a key are taken in the order of their sequence numbers within a micro-batch; a number that
isn't above the last one seen is a late or repeated row and is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import diff as D
from ..functions import frames
from ..functions import jsonbytes as J

_STATE = "seq long, doc string"


def _hash(text: str) -> int:
    return frames.fnv1a64(text.encode()) >> 1


def send(df: DataFrame, key: str, seq: str, doc: str) -> DataFrame:
    """(key, seq, op, base_hash, new_hash, delta): what each state needs beyond the one before."""
    kind = df.schema[key].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        last, held = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        out = []
        for s, text in zip(rows[seq], rows[doc], strict=True):
            if last is not None and s <= last:
                continue
            value = J.parse(text)
            op = D.diff(None if held is None else J.parse(held), value, held is None)
            now = J.canonical(value)
            out.append((k[0], int(s), {"=": "unchanged", "add": "add"}.get(op[0], "modify"), _hash(held) if held is not None else 0, _hash(now), D.serialise(op)))
            last, held = int(s), now
        if last is not None:
            state.update((last, held))
        yield pd.DataFrame(out, columns=["key", "seq", "op", "base_hash", "new_hash", "delta"])

    laid = df.select(key, seq, doc)
    return laid.groupBy(key).applyInPandasWithState(step, f"key {kind}, seq long, op string, base_hash long, new_hash long, delta binary", _STATE, "append", GroupStateTimeout.NoTimeout)


def receive(df: DataFrame) -> DataFrame:
    """(key, seq, doc, error): the state after each delta of send(). A delta that starts from or
    leads to another state than its hashes say gives an error row and leaves the state alone; the
    next full state mends the stream."""
    kind = df.schema["key"].dataType.simpleString()

    def step(k, batches: Iterator[pd.DataFrame], state: GroupState):
        last, held = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for r in rows.itertuples():
            if last is not None and r.seq <= last:
                continue
            try:
                op, _ = D.deserialise(bytes(r.delta))
                if op[0] != "add" and (held is None or _hash(held) != r.base_hash):
                    raise D.Desync("starts from another state")
                now = J.canonical(D.patch(None if held is None else J.parse(held), op, held is None))
                if _hash(now) != r.new_hash:
                    raise D.Desync("leads to another state")
                held = now
                out.append((k[0], int(r.seq), held, None))
            except ValueError as e:
                out.append((k[0], int(r.seq), None, str(e)))
            last = int(r.seq)
        if last is not None and held is not None:
            state.update((last, held))
        yield pd.DataFrame(out, columns=["key", "seq", "doc", "error"])

    return df.groupBy("key").applyInPandasWithState(step, f"key {kind}, seq long, doc string, error string", _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_stats(sent: DataFrame, event_time: str, width: str, late: str) -> DataFrame:
    """Per window of event time: updates by operation and their bytes; rows later than the
    watermark are dropped by the engine."""
    from pyspark.sql import functions as F

    return sent.withWatermark(event_time, late).groupBy(F.window(event_time, width), "op").agg(F.count(F.lit(1)).alias("updates"), F.sum(F.octet_length("delta")).alias("bytes"))
