"""Logical types and values.

Relations are sets of facts without nulls.  Intervals are half-open and
non-empty; an end at the top of the element domain means unbounded (a ray).
An interval field is two flat columns ``x_start`` and ``x_end``.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

from relspark.errors import SchemaError

I64_MIN, I64_MAX, U64_MAX = -(2**63), 2**63 - 1, 2**64 - 1


@dataclass(frozen=True)
class Bool:
    name = "bool"


@dataclass(frozen=True)
class I64:
    name = "i64"


@dataclass(frozen=True)
class U64:
    """``wide`` columns use decimal(20,0) and the whole unsigned range; others stay below 2**63."""

    wide: bool = False
    name = "u64"


@dataclass(frozen=True)
class Str:
    name = "str"


@dataclass(frozen=True)
class Bytes:
    width: int
    name = "bytes"


@dataclass(frozen=True)
class Interval:
    element: object = I64()
    width: int | None = None
    name = "interval"


ORDERED = (Bool, I64, U64)
NUMERIC = (I64, U64)


def domain(t) -> tuple[int, int]:
    if isinstance(t, I64):
        return I64_MIN, I64_MAX
    return 0, U64_MAX if t.wide else I64_MAX


def ray_end(t: Interval) -> int:
    return domain(t.element)[1]


def same_type(a, b) -> bool:
    """Types of one logical kind; physical width of u64 and fixed interval width are no difference for typing of elements."""
    if isinstance(a, Interval) and isinstance(b, Interval):
        return same_type(a.element, b.element) and a.width == b.width
    if isinstance(a, Bytes) or isinstance(b, Bytes):
        return a == b
    return type(a) is type(b)


def comparable(a, b) -> bool:
    if isinstance(a, Interval) and isinstance(b, Interval):
        return same_type(a.element, b.element)
    return same_type(a, b)


def spark_type(t) -> T.DataType:
    if isinstance(t, Bool):
        return T.BooleanType()
    if isinstance(t, I64):
        return T.LongType()
    if isinstance(t, U64):
        return T.DecimalType(20, 0) if t.wide else T.LongType()
    if isinstance(t, Str):
        return T.StringType()
    if isinstance(t, Bytes):
        return T.BinaryType()
    raise SchemaError("NotScalar", f"{t} has no single column")


def to_physical(value, t):
    """The Python value that Spark stores; intervals are (start, end)."""
    if isinstance(t, U64) and t.wide:
        return Decimal(value)
    return bytes(value) if isinstance(t, Bytes) else value


def fits(value, t) -> bool:
    """Whether the Python value is of the type and in its domain."""
    if isinstance(t, Bool):
        return isinstance(value, bool)
    if isinstance(t, (I64, U64)):
        lo, hi = domain(t)
        return isinstance(value, int) and not isinstance(value, bool) and lo <= value <= hi
    if isinstance(t, Str):
        return isinstance(value, str)
    if isinstance(t, Bytes):
        return isinstance(value, (bytes, bytearray)) and len(value) == t.width
    if not (isinstance(value, tuple) and len(value) == 2 and all(fits(x, t.element) for x in value)):
        return False
    s, e = value
    return s < e and (t.width is None or e - s == t.width and e < ray_end(t))


def type_to_json(t):
    if isinstance(t, Interval):
        return {"kind": "interval", "element": type_to_json(t.element), "width": t.width}
    out = {"kind": t.name}
    if isinstance(t, Bytes):
        out["width"] = t.width
    if isinstance(t, U64) and t.wide:
        out["wide"] = True
    return out


def type_from_json(x):
    kind = x["kind"]
    if kind == "interval":
        return Interval(type_from_json(x["element"]), x.get("width"))
    return {"bool": Bool, "i64": I64, "str": Str}[kind]() if kind in ("bool", "i64", "str") else Bytes(x["width"]) if kind == "bytes" else U64(x.get("wide", False))
