"""Self-join of documents by the Jaccard likeness of their word shingles, and its components.

A document's set holds its distinct shingles of five words (of A-Z lower-cased text), hashed to 64
bits. Two documents link if the likeness of their sets is at least the threshold; the join returns
each document's component under these links, exactly, without writing out the links of a group.
Documents with equal sets are one class; classes are what is compared.

Two sets x and y that link share, in any one order of all shingles, at least l shingles within their
first |x| - ceil(t |x|) + l and |y| - ceil(t |y|) + l (the prefixes for l matches). This serves twice:

1. Open classes. In the order of the hashes, which needs no statistics, each class is dealt by a
   prefix for some 5 % of its size in matches, about a quarter of its shingles. A class goes on only
   if it shares that many of them with any others. So passages that many documents share open few
   classes, and texts are read again only for these.
2. Contraction of the open classes. Those that share minimum hashes are verified against one hub
   each, in a few rounds with other hubs, and then those that can still link against the most
   central of the sets that share their shingles. This takes no decision but links, and it makes
   large groups of near copies one component, so that only pairs of different components matter.
3. Exact join of the open classes by adaptive multi-match prefixes. A shingle matters if it occurs in
   two components. Shingles are ordered by frequency (those that don't matter first). Each set's l
   grows as far as the estimated cost of its candidates falls, and a pair must share the lesser l of
   the two before its sets are compared.

Null and empty texts, and texts without words, have an empty set and link with nothing; with fewer
words than a shingle, all words are one. Rows that repeat a text are one class. Rows that share an
id are each taken by their text. An empty table gives no rows. Only the id and the text are read,
so that other columns can't clash. Texts are whole. Hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, map_texts, slices, table, written

WORDS, THRESHOLD = 5, 0.8
#: Matches that the first prefix asks for: one for so many shingles of a set.
FIRST_MATCH = 20
#: Minimum hashes of a set, how many must lead to the same hub, and rounds with other hubs.
KEYS, SAME_HUB, ROUNDS = 8, 2, 2
#: Rounds of links to central sets among those that can still link, at most, and the share of pairs
#: that must link for another round to be worth its while.
CENTRAL_ROUNDS, WORTH = 3, 0.03
#: Shingles of prefixes that a task deals at once.
FLUSH = 1 << 19
#: Rows of (id, class) that are broadcast at most (16 MB); beyond, the texts are shuffled to them.
BROADCAST_ROWS = 1 << 20
#: Most shared shingles that a document may ask of a candidate, and the cost of comparing two sets
#: in terms of one entry of a posting list.
MAX_MATCHES, VERIFY_COST = 8, 16
#: Sizes of one band differ by this factor at most.
BAND = 1.05

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text whose shingles are made at once (a longer text is taken alone): numpy holds some 55 bytes for each.
SHINGLE_BYTES = 1 << 18
#: Powers that are kept between calls; those for longer texts are made each time.
_KEPT_POWERS = 2 * SHINGLE_BYTES
_POWERS = {base: np.ones(1, dtype=np.uint64) for base in (_BASE, _INVERSE)}
_STEPS = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]
_SALTS = _RANDOM.integers(1, 1 << 63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS[base]
    while len(held) < n:
        held = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
    if len(held) <= _KEPT_POWERS:
        _POWERS[base] = held
    return held[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Words are hashed in one pass over the bytes of
    all texts, as differences of a running polynomial."""
    data = [t.encode() for t in texts]
    flat = np.frombuffer(b"\n".join([*data, b""]) or b"\n", dtype=np.uint8)
    blank = _SPACE[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]  # the last byte is blank
    running = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[flat] * _powers(_BASE, len(flat)))])
    words = _mix((running[ends] - running[starts]) * _powers(_INVERSE, len(flat))[starts])
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(d) + 1 for d in data)]))
    chained = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
    for k in range(WORDS):
        chained += words[k : k + len(chained)] * _STEPS[WORDS - 1 - k]
    chained = _mix(chained)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(chained[a : b - WORDS + 1]))
        elif b > a:
            own = words[a:b] * np.array(_STEPS[: b - a]) + np.uint64(b - a)
            out.append(_mix(np.array([own.sum(dtype=np.uint64)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _missing(n, threshold: float):
    """Shingles that a set of n may lack in one that it links with."""
    return n - -(-n * round(100 * threshold) // 100)


def _owner(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _described(docs: DataFrame, threshold: float) -> DataFrame:
    """(id, n, owner, prefix): size of each document's set, the hash that stands for the set (its
    class), and its first prefix, the least of its hashes."""

    def over(batches):
        for batch in batches:
            for part in slices(batch, 1, SHINGLE_BYTES):
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
                n = [len(s) for s in sets]
                owners = [_owner(hashlib.md5(s.tobytes()).digest()) if len(s) else None for s in sets]
                prefixes = [s[: _missing(len(s), threshold) + max(1, len(s) // FIRST_MATCH)].tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(owners, pa.int64()), pa.array(prefixes, pa.binary())], names=["id", "n", "owner", "prefix"])

    return map_texts(docs, over, "id bigint, n bigint, owner bigint, prefix binary")


def _packed(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of packed hashes in one array, and how many each row has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    return flat.view("<u8"), np.diff(ends) // 8


def _open_classes(described: DataFrame, threshold: float) -> DataFrame:
    """(owner, n), written: the classes that share enough of their first prefix with others.

    A task deals many documents at once: each shingle once, with its only class, or with none if
    several of the classes at hand hold it, for which it is then counted here. So a shingle that
    is everywhere is dealt once a flush and can't fill a partition."""

    def deal(batches):
        held, size = [], 0

        def flush():
            owners, n, lengths, x = (np.concatenate(c) for c in zip(*held, strict=True))
            distinct, first = np.unique(owners, return_index=True)
            once = np.zeros(len(owners), dtype=bool)
            once[first] = True  # copies of a set at hand are dealt once
            x, owner = x[np.repeat(once, lengths)], np.repeat(owners[once], lengths[once])
            order = np.argsort(x, kind="stable")
            x, owner = x[order], owner[order]
            cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)
            times = np.diff([*cuts, len(x)])
            here = np.bincount(np.searchsorted(distinct, owner[np.repeat(times > 1, times)]), minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(x[cuts].view(np.int64)), pa.array(owner[cuts], mask=times > 1), pa.nulls(len(cuts), pa.int64())], names=["x", "owner", "held"])
            yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(distinct), pa.array(here << 32 | n[first])], names=["x", "owner", "held"])

        for batch in batches:
            x, lengths = _packed(batch.column(2))
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), lengths, x.copy()))
            size += len(x)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    # rows with `held` are classes (shingles counted already, and n), the others shingles
    dealt = map_texts(described.where("n > 0").select("owner", "n", "prefix"), deal, "x bigint, owner bigint, held bigint")
    same = Window.partitionBy("x", F.col("held").isNull())
    shared = (F.min("owner").over(same) != F.max("owner").over(same)) | F.max(F.col("owner").isNull()).over(same)
    counted = dealt.withColumn("shared", shared).where("owner is not null and (held is not null or shared)")
    of_class = counted.groupBy("owner").agg(
        F.sum(F.when(F.col("held").isNull(), 1).otherwise(F.shiftright("held", 32))).alias("s"),
        F.count("held").alias("dealt"),  # as often as flushes have met the class
        F.max(F.col("held").bitwiseAND(0xFFFFFFFF)).alias("n"),
    )
    shortest = F.ceil(F.col("n") * threshold - 1e-9)  # a shorter set that links asks for fewer matches
    asked = F.greatest(F.floor(shortest / FIRST_MATCH), F.lit(1))
    return written(of_class.where(F.col("s") >= F.col("dealt") * asked).select("owner", "n"), "open")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, n, s, keys), written: set and minimum hashes of the classes in wanted (id of a document,
    owner), by their owner. The texts are shuffled to them if they are too many to be broadcast."""

    def over(batches):
        for batch in batches:
            for part in slices(batch, 1, SHINGLE_BYTES):
                sets = shingle_sets([t or "" for t in part.column(1).to_pylist()])
                # a row that shares the id may have another text
                own = [(o, s) for o, s in zip(part.column(0).to_pylist(), sets, strict=True) if len(s) and _owner(hashlib.md5(s.tobytes()).digest()) == o]
                keys = [[int((s * m).min().view(np.int64)) for m in _SALTS] for _, s in own]
                yield pa.RecordBatch.from_arrays([pa.array([o for o, _ in own], pa.int64()), pa.array([len(s) for _, s in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "n", "s", "keys"])

    found = docs.join(bounded(wanted), "id").select("owner", "text")
    sets = written(map_texts(found, over, "id bigint, n bigint, s binary, keys array<bigint>"), "sets")
    rows, ids = sets.agg(F.count("id"), F.countDistinct("id")).first()
    if rows == ids:
        return sets
    once = written(sets.dropDuplicates(["id"]), "sets")  # a row may be there twice
    discard(sets)
    return once


def bounded(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it was counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> tuple[int, DataFrame]:
    """The number of pairs (a, b), and those whose sets link, written. Only the sets of these pairs are shuffled, if the
    pairs are few enough to be broadcast; else all are."""
    pairs = written(pairs.select("a", "b"), "pairs")
    asked = pairs.count()
    others = written(pairs.select("b").distinct(), "others")
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).join(bounded(pairs), "a")
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).join(bounded(others), "b")
    both = left.join(right, "b")
    percent = round(threshold * 100)

    def linked(batches):
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), np.uint64), np.frombuffer(sb.as_buffer(), np.uint64)
                shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = written(map_texts(both.select("a", "b", "sa", "sb"), linked, "a bigint, b bigint"), "links")
    discard(pairs, others)
    return asked, links


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ids that links (a, b) touch, written; the component is its least id.
    Labels fall to the least among neighbours and are then followed to their own label."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        heard = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("heard"))
        told = labels.join(heard, labels["id"] == heard["a"]).select("id", F.col("component").alias("was"), F.least("component", "heard").alias("label"))
        own = labels.select(F.col("id").alias("label"), F.col("component").alias("next"))
        after = written(told.join(own, "label").select("id", "was", F.least("label", "next").alias("component")), "labels")
        discard(labels)
        labels = after
        if not after.where("component <> was").limit(1).count():
            discard(both)
            return labels


def _labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes, written, with the component that the links give them, their own id without one."""
    found = components(links)
    labels = found.select(F.col("id").alias("__id"), F.col("component").alias("__label"))
    labelled = nodes.drop("component").join(bounded(labels), F.col("id") == F.col("__id"), "left")
    out = written(labelled.withColumn("component", F.coalesce("__label", "id")).drop("__id", "__label"), "nodes")
    discard(nodes, found)
    return out


def _hub_pairs(reps: DataFrame, seed: int, threshold: float) -> DataFrame:
    """For each representative, one other of a different component that shares most of its minimum
    hashes, among those that are the hub of such a hash in this round."""
    each = reps.select("id", "n", "component", F.posexplode("keys").alias("pos", "key"))
    hub = F.min(F.struct(F.xxhash64(F.col("id"), F.lit(seed)).alias("h"), "id", "n", "component")).alias("hub")
    hubs = each.groupBy("pos", "key").agg(hub, F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    met = each.join(hubs.select("pos", "key", F.col("hub.id").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.component").alias("cb")), ["pos", "key"])
    near = (F.col("cb") != F.col("component")) & (F.least("n", "nb") >= threshold * F.greatest("n", "nb"))
    shared = met.where(near).groupBy("id", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= SAME_HUB)
    return shared.groupBy(F.col("id").alias("a")).agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _shingles(sets: DataFrame) -> DataFrame:
    """(id, x), written: one row for each shingle of the sets."""

    def over(batches):
        for batch in batches:
            x, n = _packed(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(x.view(np.int64))], names=["id", "x"])

    return written(map_texts(sets.select("id", "s"), over, "id bigint, x bigint"), "shingles")


def _still_open(shingles: DataFrame, nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, n, s, component) of the sets that can still link with another component, since of their n
    shingles enough (s) occur in one, and (id, x, f) of these shingles with the number f of sets that
    hold each; both written. The table of shingles that is given is deleted."""
    held = shingles.select("id", "x").join(bounded(nodes.select("id", "n", "component")), "id")
    ends = F.count(F.lit(1)).alias("f"), F.min("component").alias("low"), F.max("component").alias("high")
    crossing = written(held.groupBy("x").agg(*ends).where("low <> high").select("x", "f"), "crossing")
    met = written(held.join(crossing, "x"), "met")
    discard(shingles, crossing)
    sets = met.groupBy("id", "n", "component").agg(F.count(F.lit(1)).alias("s"))
    # shingles of its own come first in the order; with more of them than a linked set can miss, none links
    sets = written(sets.where(F.col("s") >= F.ceil(F.col("n") * threshold - 1e-9)), "still-open")
    shared = written(met.select("id", "x", "f").join(bounded(sets.select("id")), "id", "left_semi"), "shared")
    discard(met)
    return sets, shared


def _central_pairs(shared: DataFrame, sets: DataFrame, seed: int) -> DataFrame:
    """For each open set the central one that most of its shingles lead to: of the sets that hold a
    shingle, the one with the least share of shingles of its own. What was copied from one text lies
    around it, so that these pairs join most of a group of near copies."""
    each = shared.join(bounded(sets), "id")
    noise = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0 * 0.02 * seed
    own = (F.col("n") - F.col("s")) / F.col("n") + noise
    hubs = each.groupBy("x").agg(F.min(F.struct(own.alias("own"), "id", "component")).alias("hub"))
    met = each.select("x", "id", "component").join(hubs, "x").where("component <> hub.component")
    counted = met.groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))


def _prefix_pairs(shared: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components that share enough of their prefixes.

    A set that links misses at most n - ceil(t n) of its shingles in the other one, and the shorter
    of two at most n - ceil(2 t / (1 + t) n): each set is dealt in both parts, by the prefix that the
    part needs. Sets only meet in the bands of sizes where those of their shingles that matter can
    suffice, and where what follows their first shared one in either order leaves enough."""
    long_part, short_part, needed = threshold, 2 * threshold / (1 + threshold), threshold / (1 + threshold)
    most_missing = lambda part: F.col("n") - F.ceil(F.col("n") * part - 1e-9)
    missing = most_missing(long_part)
    ranked = shared.join(bounded(sets), "id").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("f", "x")) + F.col("n") - F.col("s"))
    ranked = ranked.where(F.col("k") <= missing + MAX_MATCHES)
    # l matches cost the posting lists of l - 1 further shingles, and at most their share of comparisons
    so_far = F.sum("f").over(Window.partitionBy("id").orderBy("k"))
    matches = F.greatest(F.col("k") - missing, F.lit(1))
    cost = so_far * (1 + F.lit(float(VERIFY_COST)) / matches)
    chosen = ranked.withColumn("cost", cost).withColumn("l", matches).where(F.col("k") > missing).groupBy("id").agg(F.min_by("l", F.struct("cost", "l")).alias("l"))
    prefix = written(ranked.join(chosen, "id").where(F.col("k") <= missing + F.col("l")).select("x", "id", "n", "s", "k", "component", "l"), "prefix")
    band = lambda n: F.floor(F.log(n.cast("double")) / math.log(BAND) + 1e-9)
    longest = F.least(F.col("n"), F.floor(F.col("s") / needed - F.col("n") + 1e-6))
    bands = F.explode(F.sequence(band(F.ceil(F.col("n") * threshold - 1e-9)), band(longest)))
    of = lambda e: [F.col(c).alias(f"{c}{e}") for c in ("id", "n", "s", "k", "component", "l")]
    # the first shared shingle lies in both prefixes for one match, and what follows it must be enough
    a = prefix.where((longest >= F.ceil(F.col("n") * threshold - 1e-9)) & (F.col("k") <= missing + 1)).select("x", bands.alias("band"), *of("_a"))
    short = (F.col("s") >= F.ceil(F.col("n") * short_part - 1e-9)) & (F.col("k") <= most_missing(short_part) + 1)
    b = prefix.where(short).select("x", band(F.col("n")).alias("band"), *of("_b"))
    enough = F.ceil((F.col("n_a") + F.col("n_b")) * needed - 1e-9)
    longer = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("id_a") > F.col("id_b")))
    fits = (F.col("component_a") != F.col("component_b")) & (F.least("s_a", "s_b") >= enough) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)
    room = F.least(F.col("n_a") - F.col("k_a"), F.col("n_b") - F.col("k_b")) + 1 >= enough
    met = a.join(b, ["x", "band"]).where(longer & fits & room).select("id_a", "id_b").distinct()
    # and then as many matches as the prefixes were lengthened for
    whole = prefix.groupBy("id").agg(F.collect_list("x").alias("p"), F.first("l").alias("l"))
    both = met.join(whole.select(*(F.col(c).alias(f"{c}_a") for c in ("id", "p", "l"))), "id_a").join(whole.select(*(F.col(c).alias(f"{c}_b") for c in ("id", "p", "l"))), "id_b")
    enough_matches = F.size(F.array_intersect("p_a", "p_b")) >= F.least("l_a", "l_b")
    return both.where(enough_matches).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _contracted(sets: DataFrame, threshold: float) -> DataFrame:
    """(id, component), written: the components of classes, given with their sets."""
    nodes = written(sets.select("id", "n", "keys", F.col("id").alias("component")), "nodes")
    links: list[DataFrame] = []

    def joined(pairs: DataFrame) -> bool:
        """Makes the classes' components anew with the pairs that link; whether many do."""
        nonlocal nodes
        asked, more = _verified(sets, pairs, threshold)
        found = more.count()
        if not found:
            discard(more)
            return False
        links.append(more)
        both = links[0]
        for other in links[1:]:
            both = both.union(other)
        nodes = _labelled(nodes, both)
        return found >= WORTH * asked

    for seed in range(ROUNDS):
        if not joined(_hub_pairs(nodes, seed, threshold)):
            break
    shared = _shingles(sets)
    for seed in range(CENTRAL_ROUNDS + 1):
        still_open, shared = _still_open(shared, nodes, threshold)
        if not still_open.limit(1).count():
            break
        if seed == CENTRAL_ROUNDS or not joined(_central_pairs(shared, still_open, seed)):
            joined(_prefix_pairs(shared, still_open, threshold))
            break
        discard(still_open)
    discard(shared, *links)
    return nodes.select("id", "component")


def join_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_shingles, component_id) of every row; component_id is the least id reachable by links."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = written(_described(docs, threshold), "described")
    open_ = _open_classes(described, threshold)
    classes = described.where("n > 0 and id is not null").groupBy("owner").agg(F.min("id").alias("least"))
    if open_.limit(1).count():
        reps = written(classes.join(open_.select("owner"), "owner"), "reps")
        sets = _sets(docs, reps.select(F.col("least").alias("id"), "owner"))
        found = _contracted(sets, threshold)
        discard(sets)
        of_component = written(found.join(reps, found["id"] == reps["owner"]).groupBy("component").agg(F.min("least").alias("of_component")), "least")
        of_open = found.join(of_component, "component").select(F.col("id").alias("owner"), "of_component")
        classes = classes.join(of_open, "owner", "left").select("owner", F.coalesce("of_component", "least").alias("least"))
    out = described.select("id", "n", "owner").join(classes, "owner", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))
