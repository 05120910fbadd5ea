"""URL filters: rules by host and path, and gradient-boosted trees for what no rule decides.

The trees see lexical features only: lengths, depth, digit ratio, character entropy, parameter
counts and how often URLs of the same host suffix are blocked. They learn from labelled URLs, here
those that a rule decides, at most `max_train` of each label (those of the lowest hashes); every
URL is then judged.

Only DataFrame functions and the library's tree learner (which runs in the JVM) are used. A null
URL, or one without "://", has an empty host and path, and no rule fits it. Repeated rows are judged
alike. Without URLs of both labels the trees give way to the only label, or to allow.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Rows of each label that the trees learn from, at most.
MAX_TRAIN = 10_000
#: Fixed values: (verdict, host, path) of the query's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length", "dashes", "suffix_rate", "suffix_count"]

#: Names of the columns that judging makes.
MADE = [*FEATURES, "suffix", "host", "path", "rule", "verdict", "label", "features", "rawPrediction", "probability", "prediction", "block_probability"]


def parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(`__url`, instr(`__url`, '://') + 3)")).otherwise("")
    df = df.withColumn("__url", url).withColumn("__rest", rest)
    host = F.regexp_extract("__rest", "^[^/?#]*", 0)
    df = df.withColumn("host", F.translate(host, string.ascii_uppercase, string.ascii_lowercase))
    path = F.regexp_extract(F.expr("substring(__rest, length(host) + 1)"), "^[^?#]*", 0)
    return df.withColumn("path", path).drop("__rest", "__url")


def rule_columns(rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, action).otherwise(verdict)
    return name, verdict


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds the features that need no corpus, and the host's suffix (its last two labels)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    without = lambda text, chars: F.length(F.translate(text, chars, ""))
    n = F.length(url)
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    df = df.withColumn("__chars", chars)
    shares = F.transform(F.array_distinct("__chars"), lambda c: F.size(F.filter("__chars", lambda d: d == c)) / F.size("__chars"))
    entropy = F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_length": n.cast("double"),
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": (F.length("path") - without(F.col("path"), "/")).cast("double"),
            "labels": (F.length("host") - without(F.col("host"), ".")).cast("double"),
            "digit_ratio": (n - without(url, string.digits)) / F.greatest(n, F.lit(1)),
            "entropy": entropy,
            "parameters": (F.length(query) - without(query, "=")).cast("double"),
            "query_length": F.length(query).cast("double"),
            "dashes": (n - without(url, "-_")).cast("double"),
            "suffix": F.substring_index("host", ".", -2),
        }
    ).drop("__chars")


def train(labelled: DataFrame, max_train: int = MAX_TRAIN):
    """(trees or None, the suffixes' statistics, the verdict without trees) from rows with FEATURES
    but for the suffix's, suffix and verdict. The statistics have a row for each suffix of the
    sample, max_train of each label at most."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    lowest = [labelled.where(F.col("verdict") == v).orderBy(F.xxhash64("host", "path", "url_length"), "host", "path").limit(max_train) for v in ("allow", "block")]
    sample = lowest[0].unionByName(lowest[1]).withColumn("label", (F.col("verdict") == "block").cast("double")).cache()
    by_label = {r["verdict"]: r["n"] for r in sample.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocked, all_rows = by_label.get("block", 0), sum(by_label.values())
    share = blocked / all_rows if all_rows else 0.0
    # four imagined rows of the overall share, so that a rare suffix says little
    suffixes = sample.groupBy("suffix").agg(((F.sum("label") + 4 * share) / (F.count(F.lit(1)) + 4)).alias("suffix_rate"), F.count(F.lit(1)).cast("double").alias("suffix_count"))
    model = None
    if len(by_label) == 2:
        steps = [VectorAssembler(inputCols=FEATURES, outputCol="features"), GBTClassifier(labelCol="label", maxIter=10, maxDepth=3, seed=7)]
        model = Pipeline(stages=steps).fit(sample.join(F.broadcast(suffixes), "suffix"))
    return model, suffixes, share, "block" if share == 1 and all_rows else "allow"


def judge(df: DataFrame, rules=RULES, url_col: str = "url", max_train: int = MAX_TRAIN) -> DataFrame:
    """Adds host, path, rule, verdict and, where the trees judged, their probability of block, beside
    FEATURES. Columns of df with the name of one that is made give way."""
    name, verdict = rule_columns(rules)
    df = df.drop(*MADE)
    seen = lexical(parts(df, url_col), url_col).withColumn("rule", name).withColumn("verdict", verdict)
    model, suffixes, share, otherwise = train(seen.where(F.col("rule").isNotNull()), max_train)
    seen = seen.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_rate": share, "suffix_count": 0.0})
    if model is None:
        return seen.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise))).withColumn("block_probability", F.lit(None).cast("double"))
    from pyspark.ml.functions import vector_to_array

    out = model.transform(seen).withColumn("block_probability", vector_to_array("probability")[1])
    by_trees = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", by_trees))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "block_probability")
