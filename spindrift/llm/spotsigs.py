"""Spot signatures: fingerprints of documents from the content words that follow common words.

An anchor is a very common word; its signature is the anchor with the next CHAIN content words
after it, skipping further anchors. Navigation, tables and the like hold few common words and so
leave few signatures, while prose leaves many. A fingerprint is the set of hashed signatures.
Fingerprints are compared by Jaccard likeness; near ones are sought in partitions by set length,
since sets whose lengths differ by more than the threshold allows can't be alike, and a pair is
given up as soon as a bound shows that it falls short.

Only DataFrame functions are used. A text without anchors has one signature, of all its words (of
the text itself, if it has none); null and empty texts have none. Two empty fingerprints have
likeness 1, an empty and another one 0. Repeated rows have fingerprints each. An empty table gives
no rows. Columns of the input but the id and the text are not read by the query; the functions add
columns under names that are given to them or stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, table, written
from .jaccard import bounded, components

#: Content words in a signature.
CHAIN = 2
#: Very common words of the languages at hand.
ANCHORS = (
    "the of and to in is that it for was on are as with be by this from at or an has have not but "
    "de la le les et des en un une du que qui dans pour pas sur au par est avec "
    "der die und das den von zu mit sich dem ein auf nicht ist im als auch es "
    "el los y las del se con por una su para no lo"
).split()
#: Rounds in which classes are compared with hubs only.
HUB_ROUNDS = 3
#: Documents that a bucket of neighbouring ids holds, and buckets at most (their first ids are broadcast).
BUCKET_ROWS, MAX_BUCKETS = 2048, 65_536
_MARK = "\x01"


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "signatures") -> DataFrame:
    """Adds the sorted array of distinct signature hashes of a text column."""
    w, s, c = f"__{out}_w", f"__{out}_s", f"__{out}_c"
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(w, F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda x: x != ""))
    # each content word begins a stretch: the word, then the anchors up to the next one
    marked = F.array_join(F.transform(w, lambda x: F.concat(F.when(x.isin(ANCHORS), F.lit(" ")).otherwise(F.lit(_MARK)), x)), "")
    df = df.withColumn(s, F.split(marked, _MARK))
    df = df.withColumn(c, F.transform(s, lambda x: F.substring_index(x, " ", 1)))
    # all anchors of a stretch have the words that begin the next ones; stretch 0 has no word of its own
    anchors = lambda x: F.filter(F.split(x, " "), lambda a, k: k > 0)
    chain = lambda a, i: F.hash(F.concat_ws(" ", a, *(F.get(c, i + k) for k in range(1, CHAIN + 1))))
    none = F.array().cast("array<int>")
    chains = F.transform(s, lambda x, i: F.when((F.instr(x, " ") > 0) & (i + 1 < F.size(s)), F.transform(anchors(x), lambda a: chain(a, i))).otherwise(none))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.flatten(chains))))
    whole = F.when(F.size(w) > 0, F.hash(F.array_join(w, " "))).otherwise(F.hash(text))
    found = F.when(F.size(out) > 0, F.col(out)).when(F.length(text) > 0, F.array(whole)).otherwise(none)
    return df.withColumn(out, found).drop(w, s, c)


def as_text(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: str, b: str, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two arrays of distinct values; 0, without comparing, where the lengths
    alone keep it below at_least."""
    m, n = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    out = F.when((m == 0) & (n == 0), 1.0).when((m == 0) | (n == 0), 0.0)
    if at_least:
        out = out.when(F.least(m, n) < at_least * F.greatest(m, n), 0.0)
    return out.otherwise(shared / (m + n - shared))


def classes(df: DataFrame, id_col: str = "doc_id", signatures: str = "signatures") -> DataFrame:
    """(s, id, n), written: the distinct sets, the least id with each, their lengths. Empty sets have none."""
    held = df.select(F.col(id_col).alias("id"), F.col(signatures).alias("s")).where(F.size(signatures) > 0)
    return written(held.groupBy("s").agg(F.min("id").alias("id")).withColumn("n", F.size("s")), "classes")


def near(df: DataFrame, id_col: str = "doc_id", signatures: str = "signatures", threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, components): each document's representative (the least id with the same set), and
    (id, component) of the representatives that have others with a likeness of at least threshold:
    the least id that such likenesses lead to. Empty sets are alike with none."""
    # written first: a filter on the sets would else be pushed into what computes them
    held = written(df.select(id_col, signatures), "fingerprints")
    reps = classes(held, id_col, signatures)
    of_class = reps.select(F.col("s").alias(signatures), F.col("id").alias("representative"))
    members = held.join(of_class, signatures).select(F.col(id_col).alias("id"), "representative").distinct()
    return members, near_components(reps, threshold)


def _alike(reps: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of classes with a likeness of at least threshold, written."""
    sets = reps.select("id", "s")
    pairs = written(pairs, "pairs")
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    alike = written(full.where(likeness("sa", "sb", threshold) >= threshold).select("a", "b"), "alike")
    discard(pairs)
    return alike


def near_components(reps: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(id, component) of the classes that are alike with others, exactly, by their ids.

    Classes are dealt by their rarest signatures (as many as a near set can't all miss)
    and by their length's partition; a set also probes the partition of longer ones next to its
    own. Frequent signatures come last, so that what many documents share opens no comparison;
    those that one class alone has come first and are only counted. In the first rounds each class
    is compared only with the one that most of its signatures have as their hub, which makes a group
    of near copies one component; then only classes of different components are compared."""
    reps = reps.where("id is not null")
    each = reps.select("id", "n", F.explode("s").alias("x"))
    frequency = each.groupBy("x").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    by_id = Window.partitionBy("id")
    shared = F.count(F.lit(1)).over(by_id)
    rank = F.row_number().over(by_id.orderBy("f", "x")) + F.col("n") - shared
    prefix = each.join(frequency, "x").withColumn("own", (F.col("n") - shared) / F.col("n")).withColumn("k", rank).where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9) if threshold < 1 else F.col("n")
    prefix = written(prefix.withColumn("part", part).select("x", "part", "id", "n", "k", "own"), "prefix")
    near_size = F.least("n", "nb") >= threshold * F.greatest("n", "nb") - 1e-9
    links, labels = None, prefix.sparkSession.createDataFrame([], "id long, component long")
    for seed in range(HUB_ROUNDS + 1):
        held = prefix.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        probes = held.withColumn("part", F.explode(F.array("part", F.col("part") + 1)))
        if seed < HUB_ROUNDS:
            # what was copied from one text lies around the class with the fewest signatures of its own
            drawn = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 1000.0
            order = F.struct((F.col("own") + 0.1 * seed * drawn).alias("own"), drawn.alias("drawn"), "id", "n", "component")
            hubs = held.groupBy("x", "part").agg(F.min(order).alias("hub")).select("x", "part", F.col("hub.id").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.component").alias("cb"))
            met = probes.join(hubs, ["x", "part"]).where((F.col("component") != F.col("cb")) & near_size)
            counted = met.groupBy("id", "b").agg(F.count(F.lit(1)).alias("c"))
            pairs = counted.groupBy(F.col("id").alias("a")).agg(F.max_by("b", F.struct("c", "b")).alias("b"))
        else:
            others = held.select("x", "part", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("k").alias("kb"), F.col("component").alias("cb"))
            # what follows the first shared signature in either order must be enough
            room = F.least(F.col("n") - F.col("k"), F.col("nb") - F.col("kb")) + 1 >= F.ceil((F.col("n") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
            ordered = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("id") < F.col("b")))
            pairs = probes.join(others, ["x", "part"]).where((F.col("component") != F.col("cb")) & near_size & ordered & room).select(F.col("id").alias("a"), "b").distinct()
        more = _alike(reps, pairs, threshold)
        links = more if links is None else links.union(more)
        if more.limit(1).count():
            labels = components(links)
    discard(prefix)
    return labels


def with_near(df: DataFrame, id_col: str, signatures: str, threshold: float = 0.8) -> DataFrame:
    """Adds class_id, the least id with the same set (null for empty sets and those of null ids
    only), and near_id, the least id that likenesses of at least threshold lead to. Columns of df of
    these names give way. df is read twice."""
    reps = classes(df, id_col, signatures)
    near_id = near_components(reps, threshold).select("id", F.col("component").alias("near_id"))
    digests = lambda column: [F.xxhash64(column), F.hash(column)]  # noqa: E731  96 bits stand for a set
    of_class = reps.join(near_id, "id", "left").select(*(d.alias(f"__set{i}") for i, d in enumerate(digests("s"))), F.col("id").alias("class_id"), F.coalesce("near_id", "id").alias("near_id"))
    of_class = bounded(written(of_class, "of-class"))
    same = [d == F.col(f"__set{i}") for i, d in enumerate(digests(signatures))]
    return df.drop("class_id", "near_id").join(of_class, same, "left").drop("__set0", "__set1")


def with_next(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> of the row with the next id (after the last, the first); a null id comes
    first, and rows of one id are ordered by the first of columns.

    Ids are dealt into buckets of neighbours, and the first row of each bucket also goes, marked,
    to the end of the bucket before it, so that each text is shuffled once and no task orders more
    than a bucket."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    range_ = df.agg(F.min(id_col).cast("long"), F.max(id_col).cast("long"), F.count(F.lit(1))).first()
    low, high, rows = range_[0] or 0, range_[1] or 0, range_[2]
    buckets = max(1, min(MAX_BUCKETS, -(-rows // BUCKET_ROWS)))
    width = -(-(high - low + 1) // buckets)
    bucket = F.floor((F.greatest(key, F.lit(low)).cast("decimal(38,0)") - low) / width).cast("long")
    keyed = df.withColumn("__key", key).withColumn("__bucket", bucket)
    order = Window.orderBy("__bucket")
    firsts = keyed.groupBy("__bucket").agg(F.min("__key").alias("__key"))
    firsts = firsts.withColumn("__before", F.coalesce(F.lag("__bucket").over(order), F.max("__bucket").over(Window.partitionBy())))
    twice = F.when(F.col("__before").isNull(), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("end"))))
    twice = twice.otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("end")), F.struct(F.col("__before").alias("b"), F.lit(1).alias("end"))))
    laid = keyed.join(F.broadcast(firsts), ["__bucket", "__key"], "left").withColumn("__at", F.explode(twice))
    laid = laid.withColumn("__b", F.col("__at.b")).withColumn("__end", F.col("__at.end"))
    following = Window.partitionBy("__b").orderBy("__end", "__key", columns[0])
    found = laid.withColumns({f"next_{c}": F.lead(c).over(following) for c in columns})
    return found.where("__end = 0").drop("__key", "__bucket", "__before", "__at", "__b", "__end")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_fingerprint(docs), "doc_id", ["text", "signatures"])
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    docs = docs.withColumn("edited", edited).withColumn("n_chars", n.cast("long"))
    docs = with_fingerprint(docs.drop("text", "next_text"), "edited", "edited_signatures")
    found = docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        "signatures",
        "edited_signatures",
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"),
    )
    found = written(found, "fingerprints")
    found = with_near(found, "doc_id", "signatures")
    return found.select("doc_id", "n_chars", "edited_sha256", as_text("signatures").alias("fingerprint"), as_text("edited_signatures").alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "near_id")
