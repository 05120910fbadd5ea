"""The corpus pipeline: language, quality, near duplicates, personal data, packing.

Each stage takes all that the one before it kept. All but the last return the columns of documents;
other columns of the input, whatever their names, are left out by the first stage.

* language: a document without a letter (so a null or empty text) goes, and one in which no language
  has a fair share. If nothing can be learned, as no row has a language, all go.
* quality: a document goes if it fails the base rules or is likely bad. Repeated rows vote each.
* near_duplicates: see there for ids that are null or repeat. Empty texts have no duplicates.
* personal_data: texts lose their entities to surrogates; n_chars follows. Null texts stay null.
* packing: one row for each piece; a null text packs as its end token.

Ties need no rule but in near_duplicates. An empty table gives an empty one at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.llm import jaccard, langid, packing, pii, quality
from spindrift.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language takes this share of it, or if it has no letter.
MIN_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.where(~langid.is_held_out()))
    found = langid.predict(docs, model, COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judged(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each component stays; so do all documents without an id. Rows that share an id
    are told apart by their texts, and of rows that share both one stays (the least in all columns)."""
    docs = docs.select(*COLUMNS)
    rows, ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    if rows == ids:
        return _without(docs, written(jaccard.join_components(docs).where("doc_id <> component_id").select("doc_id"), "gone"))
    alone, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    first = F.min(F.struct(*COLUMNS)).alias("row")
    docs = written(docs.groupBy("doc_id", "text").agg(first).select("row.*", F.xxhash64("doc_id", "text").alias("key")), "told-apart")
    found = jaccard.join_components(docs, "key").join(docs.select("key", "doc_id"), "key")
    least = F.min(F.struct("doc_id", "key")).over(Window.partitionBy("component_id"))
    gone = written(found.withColumn("least", least).where("key <> least.key").select("key"), "gone")
    return _without(docs, gone).select(*COLUMNS).unionByName(alone)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows of a one-column table, which is broadcast if it was counted to be small."""
    small = gone.count() <= jaccard.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, gone.columns[0], "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.replace_entities(docs.select(*COLUMNS))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL can express none of the learned stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
