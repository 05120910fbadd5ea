"""The lattice of JSON types: what single values are, and what a set of records is together.

A type says which kinds of value occur. Merging takes the union kind by kind, so it is commutative,
associative and idempotent, and inference may run in any order over any partitions.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import types as T

_TIMESTAMP = re.compile(r"[0-9].{3}-.{2}-", re.S)
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Type ids as they stand in stored schemas.
TYPE_IDS = {"null": 0, "boolean": 1, "int8": 2, "int16": 3, "int32": 4, "int64": 5, "real": 8, "string": 9, "array": 11, "object": 12, "union": 13, "timestamp": 16, "uuid": 17}


def looks_like_timestamp(s: str) -> bool:
    return 10 <= len(s.encode()) <= 30 and bool(_TIMESTAMP.match(s))


def looks_like_uuid(s: str) -> bool:
    return bool(_UUID.fullmatch(s))


def int_width(n: int) -> int:
    """Bits of the least of 8, 16, 32 and 64 that holds n; 0 beyond."""
    return next((w for w in (8, 16, 32, 64) if -(1 << w - 1) <= n < 1 << w - 1), 0)


@dataclass(frozen=True)
class JsonType:
    null: bool = False
    boolean: bool = False
    width: int = 0
    real: bool = False
    text: str = ""
    element: JsonType | None = None
    array: bool = False
    fields: tuple[tuple[str, JsonType, bool], ...] | None = None

    def merge(self, other: JsonType) -> JsonType:
        element = self.element.merge(other.element) if self.element and other.element else self.element or other.element
        text = self.text if self.text == other.text or not other.text else other.text if not self.text else "string"
        return JsonType(self.null or other.null, self.boolean or other.boolean, max(self.width, other.width), self.real or other.real, text, element, self.array or other.array, _merge_fields(self.fields, other.fields))

    @cached_property
    def kinds(self) -> list[str]:
        number = "real" if self.real else f"int{self.width}" if self.width else ""
        found = [self.boolean and "boolean", number, self.text, self.array and "array", self.fields is not None and "object"]
        return [k for k in found if k]

    @property
    def nullable(self) -> bool:
        return self.null

    @property
    def type_id(self) -> int:
        kinds = self.kinds
        return TYPE_IDS["null" if not kinds else kinds[0] if len(kinds) == 1 else "union"]

    def name(self) -> str:
        """A short text of the whole tree; equal types have equal names."""
        out = []
        for kind in self.kinds:
            if kind == "array":
                kind = f"array<{self.element.name() if self.element else 'null'}>"
            elif kind == "object":
                kind = "object<" + ",".join(f"{json.dumps(n)}{'?' if optional else ''}:{t.name()}" for n, t, optional in self.fields) + ">"
            out.append(kind)
        return "|".join([*out, *(["null"] if self.null or not out else [])])

    def to_spark(self) -> T.DataType:
        kinds = self.kinds
        if not kinds:
            return T.NullType()
        if len(kinds) > 1:
            return T.VariantType()
        if kinds[0] == "array":
            inner = self.element.to_spark() if self.element else T.StringType()
            return T.ArrayType(T.StringType() if isinstance(inner, T.NullType) else inner)
        if kinds[0] == "object":
            return T.StructType([T.StructField(n, T.StringType() if isinstance(s := t.to_spark(), T.NullType) else s, optional or t.null) for n, t, optional in self.fields])
        simple = {"boolean": T.BooleanType, "int8": T.ByteType, "int16": T.ShortType, "int32": T.IntegerType, "int64": T.LongType, "real": T.DoubleType}
        return simple.get(kinds[0], T.StringType)()

    def to_json(self) -> str:
        return json.dumps(self._plain(), sort_keys=True)

    def _plain(self) -> dict:
        out = {k: v for k, v in (("null", self.null), ("boolean", self.boolean), ("width", self.width), ("real", self.real), ("text", self.text), ("array", self.array)) if v}
        if self.element:
            out["element"] = self.element._plain()
        if self.fields is not None:
            out["fields"] = [[n, t._plain(), optional] for n, t, optional in self.fields]
        return out

    @staticmethod
    def from_json(text: str) -> JsonType:
        return _from_plain(json.loads(text))


def _from_plain(x: dict) -> JsonType:
    fields = tuple((n, _from_plain(t), optional) for n, t, optional in x["fields"]) if "fields" in x else None
    return JsonType(x.get("null", False), x.get("boolean", False), x.get("width", 0), x.get("real", False), x.get("text", ""), _from_plain(x["element"]) if "element" in x else None, x.get("array", False), fields)


def _merge_fields(a, b):
    if a is None or b is None:
        return a if b is None else b
    left, right = {n: (t, o) for n, t, o in a}, {n: (t, o) for n, t, o in b}
    out = []
    for n in sorted(left.keys() | right.keys()):
        if n in left and n in right:
            out.append((n, left[n][0].merge(right[n][0]), left[n][1] or right[n][1]))
        else:
            out.append((n, left.get(n, right.get(n))[0], True))
    return tuple(out)


NOTHING = JsonType()


def infer(value, refine: bool = True) -> JsonType:
    """The type of one parsed JSON value. refine: tell timestamps and uuids from other strings."""
    if value is None:
        return JsonType(null=True)
    if isinstance(value, bool):
        return JsonType(boolean=True)
    if isinstance(value, int):
        return JsonType(width=w) if (w := int_width(value)) else JsonType(real=True)
    if isinstance(value, float):
        return JsonType(real=True)
    if isinstance(value, str):
        return JsonType(text="timestamp" if refine and looks_like_timestamp(value) else "uuid" if refine and looks_like_uuid(value) else "string")
    if isinstance(value, list):
        element = None
        for v in value:
            own = infer(v, refine)
            element = element.merge(own) if element else own
        return JsonType(array=True, element=element)
    return JsonType(fields=tuple((n, infer(v, refine), False) for n, v in sorted(value.items())))


def evolution(old: JsonType, new: JsonType) -> list[tuple[str, str]]:
    """(field, verdict) for two object types: same, added, added_required, removed, widened,
    narrowed or changed."""
    left, right = {n: (t, o) for n, t, o in old.fields or ()}, {n: (t, o) for n, t, o in new.fields or ()}
    out = []
    for n in sorted(left.keys() | right.keys()):
        if n not in left:
            verdict = "added" if right[n][1] or right[n][0].null else "added_required"
        elif n not in right:
            verdict = "removed"
        else:
            (a, ao), (b, bo) = left[n], right[n]
            merged = a.merge(b)
            verdict = "same" if (a, ao) == (b, bo) else "widened" if merged == b and bo >= ao else "narrowed" if merged == a and ao >= bo else "changed"
        out.append((n, verdict))
    return out


def required(t: JsonType) -> JsonType:
    return replace(t, null=False)
