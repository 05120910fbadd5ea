"""Dictionaries: built by frequency or first occurrence, applied by join, learned from n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Dictionaries up to this many entries are broadcast when applied.
BROADCAST_ENTRIES = 100_000


def by_frequency(df: DataFrame, value: str, most: int) -> DataFrame:
    """(id, word, n): the most frequent values that occur twice or more, ties by value."""
    top = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long") - 1)


def by_first_seen(df: DataFrame, value: str, order: str, by: list[str]) -> DataFrame:
    """(by, word, id): ids in the order in which values first occur, in each block."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("word")).agg(F.min(order).alias("first"))
    return firsts.withColumn("id", F.dense_rank().over(Window.partitionBy(*by).orderBy("first")).cast("long") - 1).select(*by, "word", "id")


def pays(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column whether its distinct values are fewer than half its values."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x"))
    found = stacked.groupBy("x.column").agg(F.count("x.v").alias("n_values"), F.count_distinct("x.v").alias("n_distinct"))
    return found.select("column", "n_values", "n_distinct", (F.col("n_distinct") < F.floor(F.col("n_values") / 2)).alias("use_dictionary"))


def encode(df: DataFrame, value: str, dictionary: DataFrame, small: bool, out: str = "code") -> DataFrame:
    """Adds `out`: the id of a value that the dictionary holds, else null (the value itself is the
    literal). small: the dictionary is known to have BROADCAST_ENTRIES at most."""
    d = dictionary.select(F.col("word").alias(value), F.col("id").alias(out))
    return df.join(F.broadcast(d) if small else d, value, "left")


def decode(df: DataFrame, code: str, dictionary: DataFrame, small: bool, literal: str, out: str = "decoded") -> DataFrame:
    d = dictionary.select(F.col("id").alias(code), F.col("word").alias("__word"))
    return df.join(F.broadcast(d) if small else d, code, "left").withColumn(out, F.coalesce("__word", literal)).drop("__word")


def merge(base: DataFrame, more: DataFrame) -> DataFrame:
    """base with the words that only more has, numbered on after base's."""
    new = more.join(base, "word", "left_anti")
    after = base.agg(F.coalesce(F.max("id") + 1, F.lit(0)).alias("__from"))
    numbered = new.select("word", (F.row_number().over(Window.orderBy("word")) - 1).alias("__nth")).join(F.broadcast(after)).select("word", (F.col("__from") + F.col("__nth")).cast("long").alias("id"), F.lit("session").alias("level"))
    return base.select("word", "id", F.lit("base").alias("level")).unionByName(numbered)


def longest_prefix(df: DataFrame, value: str, dictionary: DataFrame, longest: int = 64) -> DataFrame:
    """Adds the longest entry that a value begins with; rows that repeat stay. Values are looked up by each of their
    prefixes that has the length of an entry, so that the join stays an equality."""
    entries = dictionary.select(F.col("word").alias("__entry")).where(F.length("word").between(2, longest)).distinct()
    lengths = entries.select(F.length("__entry").alias("n")).distinct()
    sizes = sorted(r.n for r in lengths.collect())  # at most `longest` numbers
    probes = F.filter(F.transform(F.lit(sizes).cast("array<int>"), lambda n: F.when(F.length("__value") >= n, F.substring("__value", F.lit(1), n))), lambda p: p.isNotNull())
    # each distinct value is looked up once; all rows that have it then get what was found
    values = df.select(F.col(value).alias("__value")).where(F.col(value).isNotNull()).distinct()
    met = values.select("__value", F.explode(probes).alias("__entry")).join(entries, "__entry")
    best = met.groupBy("__value").agg(F.max_by("__entry", F.length("__entry")).alias("__best"))
    return df.drop("entry").join(best, F.col(value) == F.col("__value"), "left").withColumn("entry", F.col("__best")).drop("__value", "__best")


def ngrams(df: DataFrame, value: str, shortest: int, longest: int, least: int = 2) -> DataFrame:
    """(gram, n): all substrings of those lengths that occur at least so often. Equal texts are cut once and
    count as often as they occur; null texts have none."""
    starts = F.explode(F.sequence(F.lit(1), F.length(value) - shortest + 1))
    texts = df.where(F.length(value) >= shortest).groupBy(value).agg(F.count(F.lit(1)).alias("__times"))
    each = texts.select(value, "__times", starts.alias("at"))
    lengths = F.explode(F.sequence(F.lit(shortest), F.least(F.lit(longest), F.length(value) - F.col("at") + 1)))
    each = each.select(value, "__times", "at", lengths.alias("k")).select(F.substring(value, F.col("at"), F.col("k")).alias("gram"), "__times")
    return each.groupBy("gram").agg(F.sum("__times").alias("n")).where(F.col("n") >= least)


def front_coded(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, shared, suffix): sorted values as the length of the prefix shared with the one
    before and what follows it."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*by).orderBy(value)), F.lit(""))
    df = df.select(*by, value).distinct().withColumn("__before", before)
    most = F.least(F.length(value), F.length("__before"))
    # the prefix grows until the first letter that differs
    differs = F.filter(F.sequence(F.lit(1), most + 1), lambda i: (i > most) | (F.substring(value, i, F.lit(1)) != F.substring("__before", i, F.lit(1))))
    df = df.withColumn("shared", (F.element_at(differs, 1) - 1).cast("long"))
    return df.withColumn("suffix", F.substring(value, F.col("shared").cast("int") + 1, F.length(value))).drop("__before")
