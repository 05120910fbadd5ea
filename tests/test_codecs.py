"""Round trips, fixed vectors and refusals of the byte kernels."""

import json
import math
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift import types as Y
from spindrift.functions import columns, diff, entropy, frames, integers, jsonbytes, lz, rows, templates, varint
from spindrift.functions.varint import CodecError
from spindrift.operators.sessions import Stream, compress_auto, decompress_auto

I64 = st.integers(-(1 << 63), (1 << 63) - 1)
LEAF = st.none() | st.booleans() | I64 | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8)
VALUE = st.recursive(LEAF, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=3), x, max_size=4), max_leaves=12)
BYTES = st.binary(max_size=400) | st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=12), st.integers(1, 200))


@pytest.mark.parametrize(("n", "size"), [(0, 1), (127, 1), (128, 2), (16383, 2), (16384, 3), (2097151, 3), (2097152, 4), ((1 << 64) - 1, 10)])
def test_varint_vectors(n, size):
    assert len(varint.varint(n)) == size == varint.varint_size(n)
    assert varint.read_varint(varint.varint(n)) == (n, size)


def test_zigzag_vectors():
    assert [varint.zigzag(n) for n in (0, -1, 1, -2, 2, -64, 64)] == [0, 1, 2, 3, 4, 127, 128]


@pytest.mark.parametrize("data", [b"", b"\x80", b"\xff" * 10 + b"\x01"])
def test_varint_refuses(data):
    with pytest.raises(CodecError):
        varint.read_varint(data)


@given(st.lists(I64, max_size=40))
def test_integer_columns(values):
    assert integers.decode_delta(integers.encode_delta(values)) == values
    assert integers.decode_frame_of_reference(integers.encode_frame_of_reference(values)) == values
    for v in values:
        assert varint.read_signed_varint(varint.signed_varint(v))[0] == v


@given(st.lists(st.integers(-1000, 1000), max_size=40))
def test_slots(values):
    assert integers.decode_slots(integers.encode_slots(values)) == values


def test_slot_delta_of_zero_after_varying():
    assert integers.decode_slots(integers.encode_slots([1, 5, 7, 7, 7, 9])) == [1, 5, 7, 7, 7, 9]


@given(st.lists(st.booleans(), max_size=30))
def test_bitmap(present):
    assert integers.read_bitmap(integers.null_bitmap(present), len(present)) == present


@given(BYTES)
@settings(max_examples=200)
def test_byte_codecs(data):
    assert entropy.decompress(entropy.compress(data)) == data
    assert lz.decompress(lz.compress(data)) == data
    assert frames.read(frames.write(data))[0].payload == data
    assert frames.read_blocks(frames.write_blocks(data, 64)) == data
    assert decompress_auto(compress_auto(data)) == data


@pytest.mark.parametrize("data", [bytes(range(256)) * 4, bytes(range(256)) + b"a" * 2000, b"L", b"Lorem", b"test" * 1000, b"aaaaaabbbbbbccccccdddddd" * 100])
def test_byte_codecs_on_odd_alphabets(data):
    assert entropy.decompress(entropy.compress(data)) == data
    assert frames.read(frames.write(data))[0].payload == data


def test_repetition_shrinks():
    assert len(lz.compress(b"test" * 1000)) < 40
    assert len(entropy.compress(b"a" * 1000)) < 8


def test_entropy_value():
    assert math.isclose(entropy.shannon(b"aaabbc"), 1.459, abs_tol=0.001)
    assert entropy.statistics(b"") == {"input_size": 0, "entropy_size": 0, "unique_symbols": 0}


def test_checksums():
    assert frames.crc32c(b"123456789") == 0xE3069283
    assert frames.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_frames_refuse_damage():
    data = frames.write(b"hello world" * 20)
    for i in range(len(data)):
        with pytest.raises(CodecError):
            frames.read(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])
    for cut in (0, 3, len(data) - 1):
        with pytest.raises(CodecError):
            frames.read(data[:cut])


def test_frames_one_after_another():
    data = frames.write(b"one") + frames.write(b"two" * 50) + frames.write(b"")
    assert [f.payload for f in frames.read_all(data)] == [b"one", b"two" * 50, b""]


def test_declared_sizes_are_capped():
    with pytest.raises(CodecError):
        entropy.decompress(bytes([entropy.REPEATED]) + varint.varint(1 << 40) + b"a")
    with pytest.raises(CodecError):
        lz.decompress(bytes([lz.CODED]) + varint.varint(1 << 40) + b"\0\0")


@given(VALUE)
def test_json_bytes(value):
    assert jsonbytes.same(jsonbytes.decode(jsonbytes.encode(value))[0], value)


@given(VALUE, VALUE)
@settings(max_examples=300)
def test_diff_and_patch(a, b):
    op = diff.diff(a, b)
    assert jsonbytes.same(diff.patch(a, op), b)
    assert jsonbytes.same(diff.patch(a, diff.deserialise(diff.serialise(op))[0]), b)
    assert (op == diff.SAME) == jsonbytes.same(a, b)


def test_diff_examples():
    assert diff.diff({"a": 1, "b": 2}, {"a": 1, "c": 3}) == ["obj", {"c": ["add", 3], "b": ["del"]}]
    assert diff.diff([1, 2, 3, 4, 5], [1, 2, 99, 4, 5, 6]) == ["arr", [["keep", 2], ["to", ["set", 99]], ["keep", 2], ["put", [6]]]]
    assert diff.diff({"a": None}, {}) == ["obj", {"a": ["del"]}]
    assert diff.diff({"a": 1}, {"a": 1.0}) != diff.SAME
    assert list(diff.rows(diff.diff({"x": [1, 2]}, {"x": [1, 3, 4]}))) == [("$.x[1]", "set", "3"), ("$.x[2]", "add", "4")]


def test_patch_notices_desync():
    with pytest.raises(diff.Desync):
        diff.patch({}, ["obj", {"a": ["set", 1]}])
    with pytest.raises(diff.Desync):
        diff.patch([1], ["arr", [["keep", 2]]])


def test_stream_ends():
    stream = Stream()
    docs = ['{"count":0,"name":"x"}', '{"count":1,"name":"x"}', '{"count":1,"name":"x"}', '{"count":2}', "[1]"]
    messages = [stream.update(d) for d in docs]
    assert [stream.receive(m) for m in messages] == [json.dumps(json.loads(d), separators=(",", ":")) for d in docs]
    lost = Stream()
    lost.receive(messages[0])
    with pytest.raises(diff.Desync):
        lost.receive(messages[3])


@given(VALUE, VALUE, VALUE)
@settings(max_examples=300)
def test_lattice_laws(a, b, c):
    x, y, z = (Y.infer(v) for v in (a, b, c))
    merged = x.merge(y).merge(z)
    assert merged == z.merge(x.merge(y)) == y.merge(z).merge(x)
    assert merged.merge(merged) == merged and Y.JsonType.from_json(merged.to_json()) == merged
    for v in (a, b, c):
        coded = rows.encode(v, merged)
        back, end = rows.decode(coded, merged)
        assert end == len(coded) and jsonbytes.same(back, v)


def test_inference():
    t = Y.infer({"id": 123, "name": "test", "active": True, "score": 95.5, "tags": ["a", "b"]})
    assert t.to_spark().simpleString() == "struct<active:boolean,id:tinyint,name:string,score:double,tags:array<string>>"
    merged = Y.infer({"id": 1, "name": "a"}).merge(Y.infer({"id": 300, "name": "b", "email": "x"}))
    assert merged.name() == 'object<"email"?:string,"id":int16,"name":string>'
    assert Y.infer([1, 300]).element.width == 16  # all elements count
    assert Y.infer("2024-01-15T10:30:00Z").text == "timestamp" and Y.infer("hello world").text == "string"
    assert Y.infer("550e8400-e29b-41d4-a716-446655440000").text == "uuid"
    assert Y.infer({"a": {"b": 1}}) != Y.infer({"a": {"c": 1}})


@pytest.mark.parametrize("text", ["2024-01-15T10:30:00Z", "2024-01-15T10:30:00.123Z", "2024-01-15", "2024-01-15T10:30:00.1Z", "1969-12-31T23:59:59.500Z", "2024-13-45", "550E8400-E29B-41D4-A716-446655440000", "550e8400-e29b-41d4-a716-446655440000"])
def test_times_and_uuids_come_back(text):
    t = Y.infer(text)
    assert rows.decode(rows.encode(text, t), t)[0] == text


def test_times():
    assert rows.iso_to_millis("1970-01-01T00:00:00.1Z") == 100 and rows.iso_to_millis("1969-12-31T23:59:59.500Z") == -500
    assert rows.iso_to_millis("2024-02-30") is None and rows.millis_to_iso(-500) == "1969-12-31T23:59:59.500Z"


def test_rows_refuse():
    t = Y.infer({"a": 1})
    for value in ({}, {"a": 1, "b": 2}, {"a": "x"}):
        with pytest.raises(CodecError):
            rows.encode(value, t)


@given(st.lists(st.dictionaries(st.sampled_from("abc"), LEAF, max_size=3), max_size=12))
def test_column_blocks(records):
    back = columns.from_block(columns.to_block(records))
    assert len(back) == len(records) and all(map(jsonbytes.same, back, records))


def test_encoding_choice():
    ids, status = list(range(1000, 1100)), ["active", "pending", "inactive"] * 34
    assert columns.choose(ids, Y.infer(1000)) in (columns.DELTA, columns.BITPACKED)
    assert columns.choose(status, Y.infer("x")) == columns.DICTIONARY
    assert columns.choose_by_average([]) == columns.RAW and columns.choose_by_average([7]) == columns.VARINT


def test_dictionary():
    words = ["apple"] * 2 + ["banana"] * 3 + ["cherry"]
    assert columns.frequent(words, 10) == ["banana", "apple"]
    assert columns.decode_with_dictionary(columns.encode_with_dictionary(words)) == words


@given(VALUE)
def test_templates(value):
    text = json.dumps(value)
    pattern, values = templates.extract(text)
    assert jsonbytes.same(json.loads(templates.reconstruct(pattern, values)), value)
    data = json.dumps([value] * 3).encode()
    assert jsonbytes.same(json.loads(templates.decode(templates.encode(data))), [value] * 3)


def test_template_shapes():
    a, b, c = (templates.extract(t)[0] for t in ('{"id":1,"name":"a"}', '{"id": 2, "name": "b"}', '{"id":1,"nom":"a"}'))
    assert a == b != c and templates.pattern_hash(a) == templates.pattern_hash(b)
    many = json.dumps({f"k{i}": i for i in range(400)}).encode()
    assert json.loads(templates.decode(templates.encode(many))) == json.loads(many)


def test_tokens():
    assert len(list(templates.tokens('{"name":"test","value":123}'))) == 9
    assert [k for k, _, _ in templates.tokens("[1, tru")] == ["array_start", "number", "comma", "error"]
    assert [templates.is_json(x) for x in (b"{}", b" [1]", b"hello", b"123", b"")] == [True, True, False, False, False]


def test_rows_pack_only_whole_uuids():
    t = Y.infer("123e4567-e89b-12d3-a456-426614174000")
    for text in ("abcd", "123e4567e89b12d3a456426614174000", "123e4567-e89b-12d3-a456-426614174000", "123E4567-e89b-12d3-a456-426614174000", ""):
        assert rows.decode(rows.encode(text, t), t)[0] == text
    with pytest.raises(CodecError):
        rows.decode(rows.encode("123e4567-e89b-12d3-a456-426614174000", t)[:-1], t)


def steps(f) -> int:
    """Python instructions that a call takes, the same on every machine."""
    n = 0

    def trace(frame, event, _):
        nonlocal n
        frame.f_trace_opcodes = True
        n += event == "opcode"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        f()
    finally:
        sys.settrace(before)
    return n


EVENT = '{"id":7,"user":235,"type":"error","value":29.27,"at":"2024-01-01T00:00:11Z","tags":["error","{\\"k\\": 76}"],"inner":{"k":"{\\"k\\": 76}","even":true}}'


def test_column_blocks_take_few_steps():
    records = [jsonbytes.parse(EVENT)] * 3
    assert columns.from_block(columns.to_block(records)) == records
    assert steps(lambda: columns.from_block(columns.to_block(records))) < 13_000


def test_templates_take_few_steps():
    data = EVENT.encode()
    assert templates.decode(templates.encode(data)) == data
    assert steps(lambda: templates.decode(templates.encode(data))) < 11_000


def test_odd_nibbles_are_packed():
    for n in (100, 101):
        coded = entropy.compress(b"abcabd" * n + b"x")
        assert len(coded) == entropy.compressed_size(b"abcabd" * n + b"x") < 4 * n and entropy.decompress(coded) == b"abcabd" * n + b"x"


@given(BYTES)
def test_entropy_size(data):
    assert entropy.compressed_size(data) == len(entropy.compress(data))


def test_blocks_take_few_steps():
    data = ("The quick brown fox jumps over the lazy dog, and so on. " * 3 + "".join(f"{i * i} and {i * 7} words, " for i in range(300))).encode()[:4096]
    assert frames.read_blocks(frames.write_blocks(data, 4096)) == data
    assert steps(lambda: frames.read_blocks(frames.write_blocks(data, 4096))) < 210_000


@given(st.binary(max_size=5000), st.integers(0, (1 << 32) - 1))
def test_checksums_of_parts(data, crc):
    def plain(data, crc):
        crc ^= 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    assert frames.crc32c(data, crc) == plain(data, crc)
    assert frames.crc32c(data[100:], frames.crc32c(data[:100])) == frames.crc32c(data)
