"""Catalogue of the engine's queries: each with its Spark form and, where SQL can express it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as column_bytes
from .functions import diff, entropy, frames, integers, jsonbytes, lz, rows, templates, udfs, varint
from .operators import columnar, dictionaries, profiles, schemas, sessions, states
from .operators import integers as ints
from .plans import relational
from .types import evolution, infer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(relational.QUERIES)
ORACLE_SQL: dict[str, str] = dict(relational.ORACLE_SQL)

ORDER = ["ts", "event_id"]


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def registered(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return registered


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.from_json("props", "k bigint")["k"]


_EVENTS_K = "(select *, cast(json_extract(props, '$.k') as bigint) as k from events)"

# --- integers ---------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey - 500 as n from orders")
def zigzag_inverse(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") - 500).alias("n"))
    return o.select("o_orderkey", ints.unzigzag(ints.zigzag(F.col("n"))).alias("n"))


@query("select event_id, z, cast(greatest(1, ceil(length(bin(z)) / 7.0)) as bigint) as size from (select event_id, case when d >= 0 then 2 * d else -2 * d - 1 end as z from (select event_id, (k - 50) * 40 as d from " + _EVENTS_K + "))")
def zigzag_varint_size(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", ints.zigzag((_k() - 50) * 40).alias("z"))
    return e.select("event_id", "z", ints.varint_size(F.col("z")).alias("size"))


@query("select o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) over (partition by o_custkey order by o_orderkey) as delta from orders")
def delta_encode(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return ints.with_delta(o, "o_orderkey", ["o_custkey"], ["o_orderkey"])


@query("select o_custkey, o_orderkey, o_orderkey as value from orders")
def delta_decode(spark, sf_dir):
    return ints.from_delta(delta_encode(spark, sf_dir), "delta", ["o_custkey"], ["o_orderkey"]).drop("delta")


@query("select o_custkey, o_orderkey, d - lag(d, 1, 0) over (partition by o_custkey order by o_orderkey) as delta2 from (select o_custkey, o_orderkey, o_orderkey - lag(o_orderkey, 1, 0) over (partition by o_custkey order by o_orderkey) as d from orders)")
def delta_of_delta(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return ints.with_delta_of_delta(o, "o_orderkey", ["o_custkey"], ["o_orderkey"])


@query("with a as (select user_id, event_id, ts, k, k - lag(k) over (partition by user_id order by ts, event_id) as delta from " + _EVENTS_K + ") select user_id, event_id, k, delta, case when delta is null then 'literal' when delta = lag(delta) over (partition by user_id order by ts, event_id) then 'same' else 'delta' end as form from a")
def slot_delta(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", _k().alias("k"))
    return ints.with_slot_delta(e, "k", ["user_id"], ORDER).drop("ts")


@query("with a as (select l_orderkey, l_linenumber, l_linenumber - lag(l_linenumber) over (partition by l_orderkey order by l_linenumber, l_partkey) as d from lineitem) select l_orderkey, count(l_linenumber) as n_values, case when count(distinct d) = 0 or max(abs(d)) = 0 then 'constant' when count(distinct d) = 1 then 'linear' else 'varying' end as pattern from a group by 1")
def slot_pattern(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ints.slot_pattern(l, "l_linenumber", ["l_orderkey"], ["l_linenumber", "l_partkey"])


@query("select l_returnflag, min(l_partkey) as reference, max(l_partkey) - min(l_partkey) as range, cast(length(bin(max(l_partkey) - min(l_partkey))) as bigint) as width, count(l_partkey) as n_values from lineitem group by 1")
def frame_of_reference(spark, sf_dir):
    return ints.frame_of_reference(_t(spark, sf_dir, "lineitem"), "l_partkey", ["l_returnflag"])


@query(
    "with a as (select o_custkey, o_orderkey as v, o_orderkey - lag(o_orderkey, 1, 0) over w as d, case when row_number() over w > 1 then abs(o_orderkey - lag(o_orderkey, 1, 0) over w) end as s from orders window w as (partition by o_custkey order by o_orderkey)),"
    " z as (select *, case when v >= 0 then 2 * v else -2 * v - 1 end as zv, case when d >= 0 then 2 * d else -2 * d - 1 end as zd from a),"
    " g as (select o_custkey, count(v) as n_values, cast(sum(greatest(1, ceil(length(bin(zv)) / 7.0))) as bigint) as plain_size, cast(sum(greatest(1, ceil(length(bin(zd)) / 7.0))) as bigint) as delta_size, cast(length(bin(max(v) - min(v))) as bigint) as width, cast(sum(s) as bigint) as steps, cast(sum(v) as bigint) as total from z group by 1)"
    " select o_custkey, n_values, plain_size, delta_size, width, case when delta_size < plain_size and delta_size < width * n_values // 8 + 10 then 'delta' when width <= 8 and n_values >= 4 then 'bitpacked' else 'varint' end as by_size,"
    " case when n_values = 1 then 'varint' when width <= 8 and n_values >= 4 then 'bitpacked' when steps // (n_values - 1) < abs(total // n_values) // 10 then 'delta' else 'varint' end as by_average from g"
)
def int_encoding_choice(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return ints.encoding_choice(o, "o_orderkey", ["o_custkey"], ["o_orderkey"])


@query("select width, count(*) as n from (select case when v between -128 and 127 then 'int8' when v between -32768 and 32767 then 'int16' when v between -2147483648 and 2147483647 then 'int32' else 'int64' end as width from (select l_partkey as v from lineitem union all select l_orderkey * 1000000 from lineitem)) group by 1")
def int_width(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    v = l.select(F.col("l_partkey").alias("v")).unionByName(l.select((F.col("l_orderkey") * 1000000).alias("v")))
    return v.groupBy(ints.int_width(F.col("v")).alias("width")).agg(F.count(F.lit(1)).alias("n"))


# --- schemas and records ------------------------------------------------------------------------

_ORDER_JSON = "case when o_custkey % 3 = 0 then json_object('id', o_orderkey, 'status', o_orderstatus) when o_custkey % 3 = 1 then json_object('id', o_orderkey, 'status', o_orderstatus, 'prio', o_orderpriority) else json_object('id', o_orderkey, 'prio', o_orderpriority) end"


def _order_json(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    key = F.col("o_custkey") % 3
    id_, status, prio = F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("prio")
    text = F.when(key == 0, F.to_json(F.struct(id_, status))).when(key == 1, F.to_json(F.struct(id_, status, prio))).otherwise(F.to_json(F.struct(id_, prio)))
    return o.select("o_orderkey", "o_custkey", text.alias("j"))


@query(f"with d as (select {_ORDER_JSON} as j from orders), e as (select unnest(json_keys(j)) as field from d) select field, count(*) as present, count(*) < (select count(*) from d) as nullable from e group by 1")
def schema_infer(spark, sf_dir):
    return schemas.field_presence(_order_json(spark, sf_dir), "j").drop("kinds")


@query(f"with d as (select o_orderkey, md5(array_to_string(list_sort(json_keys({_ORDER_JSON})), '|')) as shape from orders) select shape, count(*) as messages, count(*) - 1 as hits, min(o_orderkey) as first_seen, dense_rank() over (order by min(o_orderkey), shape) as schema_id from d group by shape")
def schema_registry(spark, sf_dir):
    return schemas.register(_order_json(spark, sf_dir), "j", "o_orderkey")


@query()
def schema_merge(spark, sf_dir):
    """The merged type of all records, by the lattice."""
    found = schemas.infer_schema(_order_json(spark, sf_dir), "j")
    return spark.createDataFrame([(n, t.name(), o, schemas.fingerprint(t) >> 1) for n, t, o in found.fields], "field string, type string, optional boolean, fingerprint long")


@query("select field, verdict from (values ('a', 'widened'), ('b', 'removed'), ('c', 'same'), ('d', 'added_required'), ('e', 'changed')) t(field, verdict)")
def schema_evolution(spark, sf_dir):
    old, new = infer({"a": 1, "b": "x", "c": True, "e": 1}), infer({"a": 300, "c": False, "d": 1.5, "e": "x"})
    return spark.createDataFrame(evolution(old, new), "field string, verdict string")


@query("select event_id, strlen(s) between 10 and 30 and regexp_matches(s, '(?s)^[0-9].{3}-.{2}-') as is_timestamp, regexp_matches(u, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') as is_uuid from (select event_id, case when event_id % 2 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') else event_type end as s, case when event_id % 3 = 0 then md5(props) else substr(md5(props), 1, 8) || '-' || substr(md5(props), 9, 4) || '-' || substr(md5(props), 13, 4) || '-' || substr(md5(props), 17, 4) || '-' || substr(md5(props), 21, 12) end as u from events)")
def timestamp_uuid_sniff(spark, sf_dir):
    h = F.md5("props")
    s = F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col("event_type"))
    u = F.when(F.col("event_id") % 3 == 0, h).otherwise(_dashed(h))
    e = _t(spark, sf_dir, "events").select("event_id", s.alias("s"), u.alias("u"))
    return e.select("event_id", schemas.looks_like_timestamp(F.col("s")).alias("is_timestamp"), schemas.looks_like_uuid(F.col("u")).alias("is_uuid"))


def _dashed(h):
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


@query("select event_id, md5(props) as hex, substr(md5(props), 1, 8) || '-' || substr(md5(props), 9, 4) || '-' || substr(md5(props), 13, 4) || '-' || substr(md5(props), 17, 4) || '-' || substr(md5(props), 21, 12) as uuid, 16::bigint as size from events")
def uuid_pack(spark, sf_dir):
    packed = F.unhex(F.replace(_dashed(F.md5("props")), F.lit("-"), F.lit("")))
    e = _t(spark, sf_dir, "events").select("event_id", packed.alias("p"))
    hexed = F.lower(F.hex("p"))
    return e.select("event_id", hexed.alias("hex"), _dashed(hexed).alias("uuid"), F.octet_length("p").cast("bigint").alias("size"))


@query("select event_id, epoch_us(ts) // 1000 as millis, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as iso from events")
def iso_millis(spark, sf_dir):
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return _t(spark, sf_dir, "events").select("event_id", millis.alias("millis"), F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"))


@query("select o_orderkey, cast(date_diff('day', date '1970-01-01', cast(o_orderdate as date)) as bigint) as days, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, cast(day(o_orderdate) as bigint) as d from orders")
def civil_days(spark, sf_dir):
    day = F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.unix_date(day).alias("n"))
    back = F.date_from_unix_date("n")
    return o.select("o_orderkey", F.col("n").cast("bigint").alias("days"), F.year(back).cast("bigint").alias("y"), F.month(back).cast("bigint").alias("m"), F.dayofmonth(back).cast("bigint").alias("d"))


@query("select event_id, json_object('k', cast(json_extract(props, '$.k') as bigint))::varchar as j from events")
def json_roundtrip(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.to_json(F.from_json("props", "k bigint")).alias("j"))


@query("select event_id, json_valid(t) as is_json, regexp_matches(t, '^[ \\t\\n\\r]*[\\{\\[]') as starts_like_json from (select event_id, case event_id % 4 when 0 then props when 1 then event_type when 2 then substr(props, 2) else '[' || props || ']' end as t from events)")
def json_sniff(spark, sf_dir):
    e, way = _t(spark, sf_dir, "events"), F.col("event_id") % 4
    text = F.when(way == 0, F.col("props")).when(way == 1, F.col("event_type")).when(way == 2, F.expr("substring(props, 2)")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    e = e.select("event_id", text.alias("t"))
    return e.select("event_id", profiles.is_json(F.col("t")).alias("is_json"), profiles.is_json_start(F.col("t")).alias("starts_like_json"))


# --- dictionaries ---------------------------------------------------------------------------------


@query("select word, n, row_number() over (order by n desc, word) - 1 as id from (select p_type as word, count(*) as n from part group by 1 having count(*) > 1 order by n desc, word limit 50)")
def dictionary_topk(spark, sf_dir):
    return dictionaries.by_frequency(_t(spark, sf_dir, "part"), "p_type", 50)


@query(" union all ".join(f"select '{c}' as \"column\", count({c}) as n_values, count(distinct {c}) as n_distinct, count(distinct {c}) < floor(count({c}) / 2) as use_dictionary from part" for c in ("p_name", "p_brand", "p_type")))
def dictionary_rule(spark, sf_dir):
    return dictionaries.pays(_t(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


@query("select block, word, dense_rank() over (partition by block order by first) - 1 as id from (select o_orderkey // 1000 as block, o_orderpriority as word, min(o_orderkey) as first from orders group by 1, 2)")
def first_seen_dictionary(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("block", F.expr("o_orderkey div 1000"))
    return dictionaries.by_first_seen(o, "o_orderpriority", "o_orderkey", ["block"])


@query("with d as (select p_brand as w, row_number() over (order by count(*) desc, p_brand) - 1 as id from part group by 1 having count(*) > 1 order by count(*) desc, w limit 10) select p_partkey, id as code, case when id is null then p_brand end as literal from part left join d on p_brand = w")
def dictionary_encode(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    coded = dictionaries.encode(p, "p_brand", dictionaries.by_frequency(p, "p_brand", 10), small=True)
    return coded.select("p_partkey", "code", F.when(F.col("code").isNull(), F.col("p_brand")).alias("literal"))


@query("select p_partkey, p_brand as decoded from part")
def dictionary_decode(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_brand")
    d = dictionaries.by_frequency(p, "p_brand", 10)
    return dictionaries.decode(dictionary_encode(spark, sf_dir), "code", d, True, "literal").select("p_partkey", "decoded")


@query("with b as (select n_name as word, row_number() over (order by n_name) - 1 as id from nation where n_nationkey < 10), m as (select distinct n_name as word from nation where n_nationkey >= 5) select word, id, 'base' as level from b union all select word, (select count(*) from b) + row_number() over (order by word) - 1, 'session' from m where word not in (select word from b)")
def dictionary_merge(spark, sf_dir):
    from pyspark.sql import Window

    n = _t(spark, sf_dir, "nation")
    base = n.where("n_nationkey < 10").select(F.col("n_name").alias("word"), (F.row_number().over(Window.orderBy("n_name")) - 1).cast("long").alias("id"))
    return dictionaries.merge(base, n.where("n_nationkey >= 5").select(F.col("n_name").alias("word")).distinct())


@query("with w as (select string_split(p_name, ' ') as ws from part), e as (select distinct unnest(ws) as w from w union select distinct array_to_string(ws[1:2], ' ') from w) select p_partkey, p_name, arg_max(w, length(w)) as entry from part left join e on starts_with(p_name, w) and length(w) between 2 and 64 group by 1, 2")
def longest_match(spark, sf_dir):
    """The dictionary: all words of all names, and the first two words of each."""
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    names = p.select(F.split("p_name", " ").alias("ws")).distinct()
    words = names.select(F.explode("ws").alias("word")).union(names.select(F.array_join(F.slice("ws", 1, 2), " "))).distinct()
    return dictionaries.longest_prefix(p, "p_name", words)


@query("with a as (select p_name as t, unnest(range(1, length(p_name) - 1)) as i from part where length(p_name) >= 3), k as (select t, i, unnest(range(3, least(16, length(t) - i + 1) + 1)) as n from a) select substr(t, i, n) as gram, count(*) as n from k group by 1 having count(*) >= 2")
def ngram_learn(spark, sf_dir):
    return dictionaries.ngrams(_t(spark, sf_dir, "part").select("p_name"), "p_name", 3, 16)


@query()
def front_coding(spark, sf_dir):
    return dictionaries.front_coded(_t(spark, sf_dir, "part").select("p_brand", "p_name"), "p_name", ["p_brand"])


# --- columns ----------------------------------------------------------------------------------------


@query("select event_id // 64 as block, (event_id // 8) as byte, cast(bit_or(case when k >= 50 then (1 << cast(event_id % 8 as int)) else 0 end) as bigint) as bits from " + _EVENTS_K + " group by 1, 2")
def null_bitmap(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.expr("event_id div 64").alias("block"), F.when(_k() >= 50, 1).alias("v"))
    return columnar.bitmap(e, "v", "event_id", ["block"])


_PROFILED = {"o_custkey": "bitpack", "o_orderstatus": "text", "o_orderpriority": "text", "o_totalprice": "other"}


@query(
    " union all ".join(
        f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as n_nulls, count(distinct {c}) as n_distinct, min({c}::varchar) as least, max({c}::varchar) as greatest, "
        + ("case when max(o_custkey) - min(o_custkey) < 256 and count(o_custkey) >= 4 then 'bitpacked' else 'varint' end" if kind == "bitpack" else f"case when count(distinct {c}) < floor(count({c}) / 2) then 'dictionary' else 'raw' end")
        + " as encoding from orders"
        for c, kind in _PROFILED.items()
        if kind != "other"
    )
)
def column_profile(spark, sf_dir):
    return columnar.profile(_t(spark, sf_dir, "orders"), [c for c, kind in _PROFILED.items() if kind != "other"])


@query("select o_orderkey // 100 as block, c as \"column\", array_to_string(list(v order by o_orderkey), ',') as \"values\" from (select o_orderkey, 'o_custkey' as c, o_custkey::varchar as v from orders union all select o_orderkey, 'o_orderstatus', o_orderstatus from orders) group by 1, 2")
def rows_to_columns(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("block", F.expr("o_orderkey div 100"))
    blocks = columnar.to_columns(o, ["o_custkey", "o_orderstatus"], "o_orderkey", ["block"])
    return blocks.withColumn("values", F.array_join("values", ","))


@query("select o_orderkey // 100 as block, row_number() over (partition by o_orderkey // 100 order by o_orderkey) - 1 as place, o_custkey::varchar as o_custkey, o_orderstatus from orders")
def columns_to_rows(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").withColumn("block", F.expr("o_orderkey div 100"))
    names = ["o_custkey", "o_orderstatus"]
    back = columnar.to_rows(columnar.to_columns(o, names, "o_orderkey", ["block"]), names, ["block"])
    return back.withColumn("place", F.col("place").cast("bigint"))


@query("with a as (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as c from events), b as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from a) select user_id, cast(run as bigint) as run, event_type, count(*) as length from b group by 1, 2, 3")
def run_length(spark, sf_dir):
    return columnar.runs(_t(spark, sf_dir, "events").select("user_id", "event_type", *ORDER), "event_type", ["user_id"], ORDER)


# --- states -----------------------------------------------------------------------------------------


@query("select user_id, event_id, case when p is null then 'add' when p = props then 'unchanged' else 'modify' end as op from (select *, lag(props) over (partition by user_id order by ts, event_id) as p from events)")
def state_diff(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "props")
    return states.state_ops(e, "props", ["user_id"], ORDER).select("user_id", "event_id", "op")


def _objects(spark, sf_dir):
    """Successive objects of each customer; the third field comes and goes."""
    o = _t(spark, sf_dir, "orders")
    fields = [F.lit("status"), F.col("o_orderstatus"), F.lit("prio"), F.col("o_orderpriority")]
    m = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(*fields, F.lit("even"), F.lit("1"))).otherwise(F.create_map(*fields))
    return states.with_previous(o.select("o_custkey", "o_orderkey", m.alias("m")), "m", ["o_custkey"], ["o_orderkey"])


@query("with s as (select o_custkey, o_orderkey, unnest([{'f': 'status', 'v': o_orderstatus}, {'f': 'prio', 'v': o_orderpriority}, {'f': 'even', 'v': case when o_orderkey % 2 = 0 then '1' end}]) as x from orders), r as (select o_orderkey, x.f as f, x.v as v from s where x.v is not null), p as (select o_orderkey, lag(o_orderkey) over (partition by o_custkey order by o_orderkey) as before from orders), b as (select p.o_orderkey, r.f, r.v from p join r on r.o_orderkey = p.before) select coalesce(r.o_orderkey, b.o_orderkey) as o_orderkey, coalesce(r.f, b.f) as field, case when b.f is null then 'add' when r.f is null then 'remove' when r.v = b.v then 'keep' else 'modify' end as op from r full join b on r.o_orderkey = b.o_orderkey and r.f = b.f")
def object_diff(spark, sf_dir):
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    changes = states.object_changes(F.coalesce("previous", empty), F.col("m"))
    return _objects(spark, sf_dir).select("o_orderkey", F.explode(changes).alias("x")).select("o_orderkey", "x.field", "x.op")


@query("with w as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as i from lineitem), p as (select l_orderkey, lag(l_orderkey) over (order by l_orderkey) as before from (select distinct l_orderkey from lineitem)), q as (select l_orderkey, l_orderkey // 8 as g, before, before // 8 as gb from p), b as (select q.l_orderkey, w.i, w.l_partkey from q join w on w.l_orderkey = q.before and q.g = q.gb), c as (select w.* from w join q on q.l_orderkey = w.l_orderkey where q.g = q.gb) select coalesce(c.l_orderkey, b.l_orderkey) as l_orderkey, coalesce(c.i, b.i) as place, case when b.i is null then 'insert' when c.i is null then 'delete' when b.l_partkey = c.l_partkey then 'keep' else 'replace' end as op from c full join b on c.l_orderkey = b.l_orderkey and c.i = b.i")
def array_diff(spark, sf_dir):
    """Each order's list of parts against that of the order before it in its group of eight keys."""
    l = _t(spark, sf_dir, "lineitem")
    lists = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("parts"))
    lists = states.with_previous(lists.withColumn("g", F.expr("l_orderkey div 8")), "parts", ["g"], ["l_orderkey"]).where("previous is not null")
    ops = lists.select("l_orderkey", F.posexplode(states.array_changes(F.col("previous"), F.col("parts"))).alias("place", "op"))
    return ops.withColumn("place", F.col("place").cast("bigint"))


def _conversation_states(spark, sf_dir):
    """Growing states of conversations: the turn, its role, and all words of its text as a list."""
    c = _t(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    doc = F.to_json(F.struct("turn", "role", words.alias("words"), F.struct((F.col("turn") % 2).alias("side")).alias("meta")))
    return c.select("conv_id", "turn", doc.alias("doc"))


@query("select conv_id, turn, true as ok from conversations where conv_id is not null and turn is not null")
def patch_roundtrip(spark, sf_dir):
    """Applying each difference to the state before it gives the state, also through its bytes."""
    found = states.diffs(_conversation_states(spark, sf_dir), "doc", ["conv_id"], ["turn"])
    found = found.withColumn("back", states.json_patch("previous", states.delta_deserialise(states.delta_serialise("diff"))))
    return found.select("conv_id", "turn", F.to_json(F.parse_json("back")).eqNullSafe(F.to_json(F.parse_json("doc"))).alias("ok"))


@query("select conv_id, turn, true as ok from conversations where conv_id is not null and turn is not null")
def stream_receive(spark, sf_dir):
    """Folding the differences of a stream in order gives all its states."""
    found = states.diffs(_conversation_states(spark, sf_dir), "doc", ["conv_id"], ["turn"])
    got = states.receive(found, "diff", ["conv_id"], ["turn"])
    both = got.join(found.select("conv_id", "turn", "doc"), ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.to_json(F.parse_json("state")).eqNullSafe(F.to_json(F.parse_json("doc"))).alias("ok"))


@query("with a as (select user_id, event_id, cast(json_extract(props, '$.k') as varchar) as v, lag(cast(json_extract(props, '$.k') as varchar)) over (partition by user_id order by ts, event_id) as p from events) select user_id, event_id, case when p is null then '$' else '$.k' end as path, case when p is null then 'add' else 'set' end as op, case when p is null then '{\"k\":' || v || '}' else v end as \"value\" from a where p is null or p <> v")
def path_diff(spark, sf_dir):
    """Changes as rows of path, operation and value."""
    udfs.register_all(spark)
    e = states.with_previous(_t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "props"), "props", ["user_id"], ORDER)
    e.where("previous is null or previous <> props").createOrReplaceTempView("spindrift_states")
    return spark.sql("select user_id, event_id, d.path, d.op, d.value from spindrift_states, lateral json_diff_rows(previous, props) d")


# a state {"k": n} takes 6 bytes and a zigzag varint, whole or as a change of its field; an unchanged one takes its tag
@query("with x as (select *, lag(props) over (partition by user_id order by ts, event_id) as p, 2 * cast(json_extract(props, '$.k') as bigint) as z from events), a as (select user_id, case when p is null then 'add' when p = props then 'unchanged' else 'modify' end as op, 6 + case when z < 128 then 1 when z < 16384 then 2 else 3 end as b from x), g as (select user_id, count(*) as updates, count(*) filter (op = 'add') as full_sends, count(*) filter (op = 'unchanged') as unchanged, cast(sum(case when op = 'add' then b else 0 end) as bigint) as bytes_full, cast(sum(case op when 'modify' then b when 'unchanged' then 1 else 0 end) as bigint) as bytes_delta from a group by 1) select *, round(case when full_sends > 0 then 1 - (bytes_full + bytes_delta) / ((bytes_full / full_sends) * updates) else 0 end, 6) as efficiency from g")
def stream_stats(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts", "props")
    return states.stream_stats(e, "props", ["user_id"], ORDER)


# --- bytes, entropy, templates ------------------------------------------------------------------------

_BYTES = "(select event_type, substr(h, i, 2) as x from (select event_type, h, unnest(range(1, length(h), 2)) as i from (select event_type, hex(encode(props)) as h from events)))"


@query(f"select event_type, cast(('0x' || x) as int) as byte, count(*) as n from {_BYTES} group by 1, 2")
def byte_histogram(spark, sf_dir):
    return profiles.byte_histogram(_t(spark, sf_dir, "events"), "props", ["event_type"])


@query(f"with h as (select event_type, x, count(*) as n from {_BYTES} group by 1, 2), t as (select event_type, sum(n) as s, count(*) as u from h group by 1), e as (select event_type, -sum(n / s * log2(n / s)) as h from h join t using (event_type) group by 1) select event_type, cast(s as bigint) as input_size, u as unique_symbols, round(abs(h), 6) as entropy_bits, cast(ceil(round(abs(h), 9) * s / 8) as bigint) as entropy_size from t join e using (event_type)")
def byte_entropy(spark, sf_dir):
    return profiles.entropy_of(byte_histogram(spark, sf_dir), ["event_type"])


@query(f"with h as (select event_type, x, count(*) as n from {_BYTES} group by 1, 2), r as (select *, row_number() over (partition by event_type order by n desc, x) as k from h) select event_type, cast(sum(case when k <= 15 then n else 3 * n end) as bigint) as nibbles from r group by 1")
def nibble_size(spark, sf_dir):
    return profiles.nibble_size(byte_histogram(spark, sf_dir), ["event_type"])


@query("select page_id, case when regexp_matches(t, '^[ \\t\\n\\r]*[\\{\\[]') and strlen(t) > 1000 then 'template' else 'blocks' end as codec, case when json_valid(t) then case when strlen(t) > 500 then 'session' else 'one_shot' end else 'blocks' end as advice from (select page_id, case when page_id % 2 = 0 then '{\"id\":' || page_id || ',\"pad\":\"' || repeat('x', cast(page_id % 17 as int) * 100) || '\"}' else coalesce(html, '') end as t from pages)")
def recommend(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    made = F.concat(F.lit('{"id":'), F.col("page_id").cast("string"), F.lit(',"pad":"'), F.repeat(F.lit("x"), (F.col("page_id") % 17 * 100).cast("int")), F.lit('"}'))
    p = p.select("page_id", F.when(F.col("page_id") % 2 == 0, made).otherwise(F.coalesce("html", F.lit(""))).alias("t"))
    return p.select("page_id", profiles.recommend(F.col("t")).alias("codec"), profiles.advise(F.col("t")).alias("advice"))


@query(f"select regexp_replace(regexp_replace({_ORDER_JSON}::varchar, ':\"[^\"]*\"', ':?', 'g'), ':[0-9]+', ':?', 'g') as template, count(*) as documents, min(o_orderkey) as first_id from orders group by 1")
def template_fingerprint(spark, sf_dir):
    return profiles.template_counts(_order_json(spark, sf_dir), "j", "o_orderkey")


@query("select o_orderkey, true as ok, case when o_custkey % 3 = 1 then 3 else 2 end::bigint as slots from orders")
def template_slots(spark, sf_dir):
    """Templates and values by the token scan, and documents put together from them again."""
    o = _order_json(spark, sf_dir).withColumn("x", profiles.template_of("j"))
    return o.select("o_orderkey", profiles.from_template("x.template", "x.slots").eqNullSafe(F.col("j")).alias("ok"), F.size("x.slots").cast("bigint").alias("slots"))


@query("select kind, cast(sum(n) as bigint) as n from (select unnest([{'kind': 'object_start', 'n': 1}, {'kind': 'string', 'n': case when o_custkey % 3 = 0 then 3 when o_custkey % 3 = 1 then 5 else 3 end}, {'kind': 'number', 'n': 1}, {'kind': 'colon', 'n': case when o_custkey % 3 = 1 then 3 else 2 end}, {'kind': 'comma', 'n': case when o_custkey % 3 = 1 then 2 else 1 end}, {'kind': 'object_end', 'n': 1}]) as x from orders) t(x), lateral (select x.kind as kind, x.n as n) group by 1")
def json_tokens(spark, sf_dir):
    found = profiles.token_rows(_order_json(spark, sf_dir), "j", ["o_orderkey"])
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def token_transitions(spark, sf_dir):
    return profiles.token_transitions(profiles.token_rows(_order_json(spark, sf_dir), "j", ["o_orderkey"]), ["o_orderkey"])


# --- sessions and codecs --------------------------------------------------------------------------------


@query("select o_orderkey, true as ok from orders")
def session_roundtrip(spark, sf_dir):
    o = _order_json(spark, sf_dir).select("o_orderkey", "j")
    schema = schemas.infer_schema(o, "j")
    back = sessions.decompress(sessions.compress(o, "j", schema), "frame", schema)
    return back.select("o_orderkey", F.to_json(F.parse_json("decoded")).eqNullSafe(F.to_json(F.parse_json("j"))).alias("ok"))


@query("select count(*) as messages, cast(sum(strlen(" + _ORDER_JSON + "::varchar)) as bigint) as bytes_in from orders")
def session_stats(spark, sf_dir):
    framed = sessions.compress(_order_json(spark, sf_dir).select("o_orderkey", "j"), "j")
    return sessions.stats(framed, "j").select("messages", "bytes_in")


def _roundtrip(name: str, table: str, key: str, text: str, check) -> None:
    """Registers codec_roundtrip_<name>: whether check holds for a text, for each row."""

    def over(x: pd.Series) -> pd.Series:
        return pd.Series([bool(check(t if t is not None else "")) for t in x])

    def run(spark, sf_dir):
        return _t(spark, sf_dir, table).select(key, F.pandas_udf(over, "boolean")(F.expr(text)).alias("ok"))

    run.__name__ = f"codec_roundtrip_{name}"
    query(f"select {key}, true as ok from {table}")(run)


def _numbers(t: str) -> list[int]:
    return [int(x) for x in t.split(",")] if t else []


_NUMBERS = "concat_ws(',', l_orderkey * 1000 - 500000, l_partkey, l_partkey + 1, -l_suppkey, l_suppkey * l_suppkey, l_linenumber, l_linenumber)"
_RECORD = "to_json(named_struct('id', event_id, 'user', user_id, 'type', event_type, 'value', value, 'at', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'tags', array(event_type, props), 'inner', named_struct('k', props, 'even', event_id % 2 = 0)))"
_roundtrip("varint", "lineitem", "l_orderkey", _NUMBERS, lambda t: all(varint.read_signed_varint(varint.signed_varint(n))[0] == n for n in _numbers(t)))
_roundtrip("delta", "lineitem", "l_orderkey", _NUMBERS, lambda t: integers.decode_delta(integers.encode_delta(_numbers(t))) == _numbers(t))
_roundtrip("frame_of_reference", "lineitem", "l_orderkey", _NUMBERS, lambda t: integers.decode_frame_of_reference(integers.encode_frame_of_reference(_numbers(t))) == _numbers(t))
_roundtrip("slots", "lineitem", "l_orderkey", _NUMBERS, lambda t: integers.decode_slots(integers.encode_slots(_numbers(t))) == _numbers(t))
_roundtrip("entropy", "documents", "doc_id", "text", lambda t: entropy.decompress(entropy.compress(t.encode())) == t.encode())
_roundtrip("lz", "documents", "doc_id", "text", lambda t: lz.decompress(lz.compress(t.encode())) == t.encode())
_roundtrip("blocks", "documents", "doc_id", "text", lambda t: frames.read_blocks(frames.write_blocks(t.encode(), 4096)) == t.encode())
_roundtrip("frame", "pages", "page_id", "html", lambda t: frames.read(frames.write(t.encode()))[0].payload == t.encode())
_roundtrip("auto", "pages", "page_id", "html", lambda t: sessions.decompress_auto(sessions.compress_auto(t.encode())) == t.encode())
_roundtrip("json_bytes", "events", "event_id", _RECORD, lambda t: jsonbytes.same(jsonbytes.decode(jsonbytes.encode(v := jsonbytes.parse(t)))[0], v))
_roundtrip("row", "events", "event_id", _RECORD, lambda t: jsonbytes.same(rows.decode(rows.encode(v := jsonbytes.parse(t), s := infer(v)), s)[0], v))
_roundtrip("column_block", "events", "event_id", _RECORD, lambda t: all(map(jsonbytes.same, column_bytes.from_block(column_bytes.to_block(v := [jsonbytes.parse(t)] * 3)), v)))
_roundtrip("dictionary", "documents", "doc_id", "text", lambda t: column_bytes.decode_with_dictionary(column_bytes.encode_with_dictionary(w := t.split(" "))) == w)
_roundtrip("template", "events", "event_id", _RECORD, lambda t: jsonbytes.same(jsonbytes.parse(templates.decode(templates.encode(t.encode())).decode()), jsonbytes.parse(t)))
_roundtrip("delta_bytes", "events", "event_id", _RECORD, lambda t: diff.deserialise(diff.serialise(o := diff.diff({"id": 0, "gone": [1, 2]}, jsonbytes.parse(t))))[0] == o)
