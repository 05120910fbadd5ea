"""Every query of the catalogue against its SQL in DuckDB."""

import json
import math
import os

import duckdb
import pytest

from spindrift import queries
from spindrift.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{SF}/{t}.parquet"):
            c.sql(f"create view {t} as select * from read_parquet('{path}')")
    return c


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == names
    at = [list(found.columns).index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_conversation_states_hold_whole_texts(spark):
    texts = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{SF}/conversations.parquet").where("conv_id is not null and turn is not null").collect()}
    states = {(r.conv_id, r.turn): json.loads(r.doc)["words"] for r in queries._conversation_states(spark, SF).collect()}
    assert states == {k: t.split(" ") for k, t in texts.items()} and max(map(len, states.values())) > 5


def test_front_coding_gives_the_words_back(spark):
    for rows in _by(QUERIES["front_coding"](spark, SF).collect(), "p_brand"):
        before = ""
        for r in sorted(rows, key=lambda r: r.p_name):
            assert before[: r.shared] + r.suffix == r.p_name
            assert before[: r.shared + 1] != r.p_name[: r.shared + 1] or len(before) == r.shared
            before = r.p_name


def _by(rows, key):
    held = {}
    for r in rows:
        held.setdefault(r[key], []).append(r)
    return held.values()
