"""What tasks leave and take in a Python worker, by calling them here as a worker does."""

import random
import tracemalloc
import types

import pyarrow as pa
import pytest

from spindrift.llm import common, jaccard, langid


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(("river", "stone", "the", "of", "cloud")) for _ in range(n))


def task(spark, made, *args):
    """The function that a call would run in the workers."""
    rows = types.SimpleNamespace(sparkSession=spark, mapInArrow=lambda over, schema: over)
    return made(rows, *args)


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])


@pytest.fixture(autouse=True)
def kept_nothing():
    common._KEPT.clear()
    yield
    common._KEPT.clear()


def test_near_duplicates_drop_what_the_language_model_kept(spark):
    common.kept(("languages", "of an earlier stage"), lambda: bytearray(1 << 20))
    found = list(task(spark, jaccard._described, 0.8)(iter([batch([prose(1, 50), None, ""])])))
    assert sum(b.num_rows for b in found) == 3
    assert not common._KEPT


def test_language_model_stays_between_its_own_tasks(spark, docs):
    model = langid.learn(docs)
    held = []
    docs_like = types.SimpleNamespace(sparkSession=spark, schema=docs.schema, mapInArrow=lambda over, schema: over)
    docs_like.select = lambda *columns: docs_like
    over = langid.predict(docs_like, model, ["doc_id"])
    for _ in range(2):
        list(over(iter([batch([prose(2, 50)])])))
        held.append(next(iter(common._KEPT.values())))
    assert len(common._KEPT) == 1 and held[0] is held[1]


def test_shingles_of_a_large_batch_take_little_memory(spark):
    texts = [prose(i, 600) for i in range(1000)]  # some 3 MB
    over = task(spark, jaccard._described, 0.8)
    rows = batch(texts)
    tracemalloc.start()
    n = sum(b.num_rows for b in over(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(texts)
    assert peak < 32 << 20
