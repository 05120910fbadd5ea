"""Quality rules under weak supervision.

Each rule looks at one property of a text and votes good, bad or abstains. How far a rule can be
trusted is not set by hand: expectation-maximisation over the votes of all documents estimates how
often each rule votes right on good and on bad documents, and the posterior probability of a good
document replaces the demand that all rules pass. The votes of a corpus collapse to counts of at
most 3 ** len(RULES) patterns, so that the estimation runs over a table of bounded size.

Only DataFrame functions are used. A null text has no words; every rule abstains on it. Texts are
read whole. Repeated rows vote each. An empty table keeps the starting accuracies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, table, written

#: Words of the windows whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
#: Frequent function words of the languages that the rule on common words knows.
COMMON_WORDS = (
    "the of and to in is that it for was on are as with be by this from at or "
    "de la le les et des en un une du que qui dans pour pas sur au par est avec "
    "der die und das den von zu mit sich dem ein auf nicht ist im als auch es an "
    "el los y las del se con por una su para no lo"
).split()

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_WORK = ["__words", "__lines", "__windows", "__sorted", "__starts"]


def _share(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _rules() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes good and when it votes bad; otherwise it abstains."""
    words = F.col("n_words")
    per_word = _share(F.col("n_symbols"), words)
    upper, ending = _share(F.col("__n_upper"), words), _share(F.col("__n_ending"), words)
    same_lines, repeated = _share(F.col("n_dup_lines"), F.col("__n_lines")), _share(F.col("n_repeat_words"), words)
    distinct, common = _share(F.col("__n_distinct"), words), _share(F.col("__n_common"), words)
    mean = _share(F.col("word_chars"), words)
    return {
        "symbols": (per_word < 0.02, per_word > 0.1),
        "capitals": (upper < 0.1, upper > 0.3),
        "lines": ((same_lines < 0.2) & (F.col("__n_lines") > 1), same_lines > 0.5),
        "repetition": (repeated < 0.1, repeated > 0.3),
        "variety": (distinct > 0.4, distinct < 0.2),
        "word_length": ((mean > 3.5) & (mean < 6.5), (mean < 2) | (mean > 12)),
        "common_words": (common > 0.1, (common < 0.03) & (words >= 50)),
        "sentences": ((ending > 0.02) & (ending < 0.3), ending > 0.6),
    }


RULES = ["symbols", "capitals", "lines", "repetition", "variety", "word_length", "common_words", "sentences"]


def _count(array: str, test) -> Column:
    return F.size(F.filter(array, test)).cast("long")


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds COUNTS and what else the rules look at.

    Repeated windows are found by their hashes: where some hash occurs twice, windows are ordered
    by hash, those with an equal neighbour keep their first word's place, and the words that such
    windows cover are counted from the gaps between these places."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__words", F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != ""))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE_CLASS}]")))
    n = F.size("__words")
    df = df.withColumn("__windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__words", i, WINDOW)))))
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    df = df.withColumn("__sorted", F.when(twice, F.array_sort(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    alike = lambda x, i: F.coalesce(F.get("__sorted", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__sorted", i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("__starts", F.array_sort(F.transform(F.filter("__sorted", alike), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__starts", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("__starts", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    length = F.length(text)
    df = df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "__n_lines": F.size("__lines").cast("long"),
            "__n_distinct": F.size(F.array_distinct("__words")).cast("long"),
            "__n_upper": _count("__words", lambda w: w.rlike("^[^\\p{Ll}]*\\p{Lu}{2}[^\\p{Ll}]*$")),
            "__n_ending": _count("__words", lambda w: w.substr(F.lit(-1), F.lit(1)).isin(".", "!", "?")),
            "__n_common": _count("__words", lambda w: F.lower(w).isin(COMMON_WORDS)),
        }
    )
    return df.drop(*_WORK)


def with_votes(counted: DataFrame) -> DataFrame:
    """Adds vote_<rule>: 1 good, -1 bad, 0 abstains; a document without words gets no vote."""
    some = F.col("n_words") > 0
    votes = {f"vote_{r}": F.when(some & bad, -1).when(some & good, 1).otherwise(0) for r, (good, bad) in _rules().items()}
    return counted.withColumns(votes).drop(*(c for c in counted.columns if c.startswith("__n_")))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.8) -> tuple[float, list[tuple[float, float, float, float]]]:
    """Expectation-maximisation over (votes, documents): the share of good documents and for each
    rule the probabilities of a good vote and of a bad vote, on good and then on bad documents,
    given that it votes. Begins with rules that seldom blame a good document but each see one
    defect only, so that most rules find a bad document good: good votes say little, bad ones much."""
    rules = len(patterns[0][0]) if patterns else len(RULES)
    right = [(0.98, 0.02, 0.7, 0.3)] * rules
    for _ in range(rounds if patterns else 0):
        mass = [[1.0, 1.0, 1.0, 1.0] for _ in range(rules)]  # one imagined vote of each kind
        good_docs = docs = 0.0
        for votes, n in patterns:
            p = posterior(votes, prior, right)
            good_docs += n * p
            docs += n
            for j, v in enumerate(votes):
                if v:
                    mass[j][0 if v > 0 else 1] += n * p
                    mass[j][2 if v > 0 else 3] += n * (1 - p)
        prior = min(max(good_docs / docs, 0.01), 0.99)
        right = [(a / (a + b), b / (a + b), c / (c + d), d / (c + d)) for a, b, c, d in mass]
    return prior, right


def posterior(votes, prior: float, right) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(r[0] / r[2]) if v > 0 else math.log(r[1] / r[3]) for v, r in zip(votes, right, strict=True) if v)
    return 1 / (1 + math.exp(-min(max(odds, -700), 700)))


def judged(df: DataFrame, text_col: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """df with COUNTS, base_failed, quality (the posterior) and kept. The counted rows are written
    to the shared folder, so that the texts are split once for both passes. Columns of df that
    have the name of one that is added give way to it."""
    votes = [f"vote_{r}" for r in RULES]
    counted = with_votes(with_counts(df, text_col))
    voted = written(counted if keep_text else counted.drop(text_col), "quality")
    found = voted.groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** len(RULES) rows at most
    prior, right = estimate(sorted((tuple(r[v] for v in votes), r["n"]) for r in found))
    odds = F.lit(math.log(prior / (1 - prior)))
    for v, r in zip(votes, right, strict=True):
        odds = odds + F.when(F.col(v) > 0, math.log(r[0] / r[2])).when(F.col(v) < 0, math.log(r[1] / r[3])).otherwise(0.0)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    out = voted.withColumn("base_failed", base).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "quality", *(f"vote_{r}" for r in RULES))
