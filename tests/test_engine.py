"""Streams, sources, sessions and SQL functions, end to end."""

import json

import pytest
from pyspark.sql import functions as F

from spindrift.functions import diff, udfs
from spindrift.operators import columnar, dictionaries, schemas, sessions, states
from spindrift.sources import documents, frames
from spindrift.streaming import states as streaming


def test_schema_of_records(spark):
    df = spark.createDataFrame([('{"id":1,"v":null}',), ('{"id":300,"v":"x"}',), ("not json",), (None,), ('[{"id":2,"e":[]},{"id":70000}]',)], "j string")
    t = schemas.infer_schema(df, "j")
    assert t.name() == 'object<"e"?:array<null>,"id":int32,"v"?:string|null>'
    assert schemas.infer_schema(df.where("false"), "j").name() == "null"


def test_sessions(spark):
    docs = [{"id": i, "name": f"user{i}", "tags": ["a"] * (i % 3)} for i in range(50)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(99, "{"), (100, None)], "i long, j string")
    framed = sessions.compress(df, "j", include_schema=True)
    got = {r.i: r for r in sessions.decompress(framed).collect()}
    assert all(json.loads(got[i].decoded) == d for i, d in enumerate(docs))
    assert got[99].decoded is None and got[99].error and got[100].decoded is None and not got[100].error
    assert sessions.stats(framed.where("false"), "j").first().ratio == 1.0


def test_stream_gives_the_batch_differences(spark, tmp_path):
    rows = [(k, s, json.dumps({"n": s // 2, "k": k, "l": list(range(s % 4))})) for s in range(6) for k in ("a", "b")]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for s in range(0, 6, 2):  # a file for each batch; the later row of a key comes first
        spark.createDataFrame([r for r in reversed(rows) if r[1] in (s, s + 1)], "key string, seq long, doc string").coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("key string, seq long, doc string").option("maxFilesPerTrigger", 1).parquet(source)
    run = streaming.send(stream, "key", "seq", "doc").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    sent = spark.read.parquet(out)
    batch = states.diffs(spark.createDataFrame(rows, "key string, seq long, doc string"), "doc", ["key"], ["seq"])
    same = sent.join(batch.select("key", "seq", "diff", F.col("op").alias("batch_op")), ["key", "seq"])
    back = same.withColumn("streamed", states.delta_deserialise("delta")).collect()
    assert len(back) == len(rows)
    assert all(json.loads(r.streamed) == json.loads(r.diff) and r.op == r.batch_op for r in back)

    received = streaming.receive(spark.readStream.schema(sent.schema).parquet(out))
    run = received.writeStream.format("parquet").option("path", out + "2").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r.key, r.seq): r for r in spark.read.parquet(out + "2").collect()}
    assert all(json.loads(got[k, s].doc) == json.loads(d) and got[k, s].error is None for k, s, d in rows)

    sent.where("seq <> 2").write.parquet(out + "3")
    lossy = streaming.receive(spark.readStream.schema(sent.schema).parquet(out + "3"))
    run = lossy.writeStream.format("parquet").option("path", out + "4").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    errors = {(r.key, r.seq): r.error for r in spark.read.parquet(out + "4").collect()}
    assert errors["a", 3] and errors["a", 1] is None


def test_windowed_stats(spark, tmp_path):
    spark.createDataFrame([("add", "2024-01-01 00:00:01", b"abc"), ("modify", "2024-01-01 00:00:02", b"a")], "op string, at string, delta binary").select("op", F.col("at").cast("timestamp").alias("at"), "delta").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("op string, at timestamp, delta binary").parquet(str(tmp_path / "in"))
    run = streaming.windowed_stats(stream, "at", "1 minute", "1 minute").writeStream.format("memory").queryName("spindrift_windows").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r.op, r.updates, r.bytes) for r in spark.table("spindrift_windows").collect()} == {("add", 1, 3), ("modify", 1, 1)}


def test_frame_files(spark, tmp_path):
    frames.register(spark)
    path = str(tmp_path / "frames")
    df = spark.createDataFrame([(f"payload {i} " * i,) for i in range(20)], "t string").select(F.encode("t", "utf-8").alias("payload"))
    df.repartition(3).write.format("spindrift_frames").mode("append").save(path)
    got = spark.read.format("spindrift_frames").load(path)
    assert sorted(r.t for r in got.select(F.decode("payload", "utf-8").alias("t")).collect()) == sorted(f"payload {i} " * i for i in range(20))


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1}\n[{"a":2},{"a":3}]\n')
    got = documents.elements(documents.read_lines(spark, str(tmp_path)), "value")
    assert sorted(r.value for r in got.collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
    t = schemas.infer_schema(got, "value")
    assert sorted(r.a for r in documents.typed(got, "value", t).select("record.a").collect()) == [1, 2, 3]
    assert documents.read_whole(spark, str(tmp_path)).count() == 1


def test_sql_functions(spark):
    udfs.register_all(spark)
    r = spark.sql("select lz_decompress(lz_compress(cast('abcabcabc' as binary))) as a, json_patch('{\"a\":1}', json_diff('{\"a\":1}', '{\"a\":2,\"b\":[]}')) as b, crc32c(cast('123456789' as binary)) as c, varint_decode(varint_encode(300)) as d, fnv1a64(cast('a' as binary)) as e").first()
    assert bytes(r.a) == b"abcabcabc" and r.b == '{"a":2,"b":[]}' and r.c == 0xE3069283 and r.d == 300 and r.e == 0xAF63DC4C8601EC8C - (1 << 64)
    assert spark.sql("select * from json_tokens('{\"a\":[1,true]}')").count() == 9
    assert {x.path for x in spark.sql("select * from json_flatten('{\"a\":[1,{\"b\":null}]}')").collect()} == {"$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b"}
    assert [tuple(x) for x in spark.sql("select * from json_diff_rows('{\"a\":1}', '{\"a\":2}')").collect()] == [("$.a", "set", "2")]
    assert spark.sql("select * from ngrams('abcd', 3, 4)").count() == 3


def test_longest_prefix(spark):
    words = spark.createDataFrame([("hel",), ("hello",), ("hello world",)], "word string")
    df = spark.createDataFrame([("hello world!",), ("help",), ("x",)], "v string")
    assert {r.v: r.entry for r in dictionaries.longest_prefix(df, "v", words).collect()} == {"hello world!": "hello world", "help": "hel", "x": None}
    twice = spark.createDataFrame([("help", 1), ("help", 1), (None, 2), (None, 2), ("x", 3)], "v string, entry int")
    assert sorted((r.v or "", r.entry or "") for r in dictionaries.longest_prefix(twice, "v", words).collect()) == [("", ""), ("", ""), ("help", "hel"), ("help", "hel"), ("x", "")]


def test_columns_keep_records_whole_on_ties(spark):
    records = [("a", "z"), ("b", "y"), ("a", "z"), (None, "x")]
    df = spark.createDataFrame([(1, 7, *r) for r in records], "block int, at int, c string, d string")
    blocks = columnar.to_columns(df, ["c", "d"], "at", ["block"])
    back = columnar.to_rows(blocks, ["c", "d"], ["block"])
    assert sorted(((r.c, r.d) for r in back.collect()), key=str) == sorted(records, key=str)
    assert columnar.to_columns(df.where("false"), ["c", "d"], "at", ["block"]).count() == 0


def test_registry_grows(spark):
    a = schemas.register(spark.createDataFrame([('{"a":1}', 1), ('{"b":1}', 2), ('{"a":2}', 3)], "j string, i long"), "j", "i")
    b = schemas.register(spark.createDataFrame([('{"c":1}', 5), ('{"b":1}', 6)], "j string, i long"), "j", "i")
    assert sorted(r.schema_id for r in schemas.extend_registry(a, b).collect()) == [1, 2, 3]


def test_plans_reach_the_scan(spark):
    from spindrift.queries import QUERIES

    plan = QUERIES["pricing_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in plan
    assert "l_orderkey" not in plan.partition("ReadSchema")[2]


@pytest.mark.parametrize("text", ['{"a":1}', "[]", "", None])
def test_states_of_empty_streams(spark, text):
    df = spark.createDataFrame([("k", 1, text)], "k string, s long, d string")
    assert states.state_ops(df, "d", ["k"], ["s"]).first().op == "add"


def test_ngrams_count_repeated_rows(spark):
    df = spark.createDataFrame([("abcd",), ("abcd",), ("abc",), ("ab",), (None,)], "v string")
    assert {r.gram: r.n for r in dictionaries.ngrams(df, "v", 3, 16).collect()} == {"abc": 3, "bcd": 2, "abcd": 2}
    assert dictionaries.ngrams(df.where("false"), "v", 3, 16).count() == 0


def test_stream_stats_count_serialised_bytes(spark):
    rows = [(1, 1, '{"a":1,"b":"xx"}'), (1, 2, '{"a":1,"b":"xx"}'), (1, 3, '{"a":2,"b":"xx"}'), (2, 1, None)]
    found = {r.k: r for r in states.stream_stats(spark.createDataFrame(rows, "k int, t int, doc string"), "doc", ["k"], ["t"]).collect()}
    size = lambda before, after: len(diff.serialise(diff.diff(before, after, before is None)))
    first, last = {"a": 1, "b": "xx"}, {"a": 2, "b": "xx"}
    assert (found[1].bytes_full, found[1].bytes_delta) == (size(None, first), 1 + size(first, last))
    assert (found[2].bytes_full, found[2].bytes_delta) == (0, 0)
