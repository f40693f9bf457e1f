"""Schemas: relations, closed vocabularies and constraint statements, validated once."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import types as T

from relspark.errors import SchemaError
from relspark.types import I64, U64, Bytes, Interval, Str, fits, ray_end, same_type, spark_type, type_from_json, type_to_json

MAX_EXTENSION = 256


@dataclass(frozen=True)
class Field:
    name: str
    type: object
    fresh: bool = False


@dataclass(frozen=True)
class Relation:
    """``rows`` makes it closed: a vocabulary whose handles are positions, with payload rows."""

    name: str
    fields: tuple[Field, ...]
    rows: tuple[tuple, ...] | None = None
    handles: tuple[str, ...] | None = None

    @property
    def closed(self) -> bool:
        return self.rows is not None

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise SchemaError("UnknownField", f"{self.name}.{name}")

    def has(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    def columns(self) -> list[str]:
        out = []
        for f in self.fields:
            out += [f"{f.name}_start", f"{f.name}_end"] if isinstance(f.type, Interval) else [f.name]
        return out

    def struct(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields:
            meta = {"logical": json.dumps(type_to_json(f.type))}
            if isinstance(f.type, Interval):
                for end in ("start", "end"):
                    out.add(T.StructField(f"{f.name}_{end}", spark_type(f.type.element), False, meta))
            else:
                out.add(T.StructField(f.name, spark_type(f.type), False, meta))
        return out


def relation(name: str, /, **types) -> Relation:
    """``relation("Order", id=U64(), ...)``; a ``(type, "fresh")`` pair marks a minted id."""
    return Relation(name, tuple(Field(k, *((v[0], True) if isinstance(v, tuple) else (v,))) for k, v in types.items()))


def closed(name: str, handles: dict[str, tuple], /, **payload) -> Relation:
    """A closed vocabulary: ``id`` is the position of the handle, then the payload fields."""
    fields = (Field("id", U64()), *(Field(k, v) for k, v in payload.items()))
    return Relation(name, fields, tuple((i, *row) for i, row in enumerate(handles.values())), tuple(handles))


@dataclass(frozen=True)
class Side:
    """Projected fields of a relation under a selection: field -> literal or frozenset of literals."""

    relation: str
    fields: tuple[str, ...]
    where: tuple[tuple[str, object], ...] = ()


def side(name: str, /, *fields: str, **where) -> Side:
    return Side(name, fields, tuple((k, frozenset(v) if isinstance(v, (set, frozenset, list)) else v) for k, v in where.items()))


@dataclass(frozen=True)
class Key:
    relation: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Contained:
    """Every selected source tuple is matched by a selected target tuple; an interval in last place is covered by the union."""

    source: Side
    target: Side


@dataclass(frozen=True)
class Capacity:
    """For each target tuple, the weights of its source tuples add up to lo..hi.

    ``weight``: None counts, a field name sums it, ``("duration", field)`` sums lengths.
    ``hi``: a number, None (no limit), a target field, or ``("duration", field)`` of the target.
    """

    target: Side
    source: Side
    lo: int = 0
    hi: object = None
    weight: object = None


def mirrors(a: Side, b: Side) -> list[Contained]:
    return [Contained(a, b), Contained(b, a)]


@dataclass(frozen=True)
class Schema:
    relations: tuple[Relation, ...]
    statements: tuple = ()
    _by_name: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self):
        keys = [Key(r.name, (f.name,)) for r in self.relations for f in r.fields if f.fresh]
        keys += [Key(r.name, ("id",)) for r in self.relations if r.closed]
        object.__setattr__(self, "statements", (*(k for k in keys if k not in self.statements), *self.statements))
        self._by_name.update({r.name: r for r in self.relations})
        _validate(self)

    def __getitem__(self, name: str) -> Relation:
        if name not in self._by_name:
            raise SchemaError("UnknownRelation", name)
        return self._by_name[name]

    def has(self, name: str) -> bool:
        return name in self._by_name

    def keys(self, name: str) -> list[Key]:
        return [s for s in self.statements if isinstance(s, Key) and s.relation == name]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.to_json(), sort_keys=True).encode()).hexdigest()

    def manifest(self) -> dict:
        """Names and the positions that identify them."""
        return {r.name: {"id": i, "closed": r.closed, "fields": {f.name: j for j, f in enumerate(r.fields)}, "handles": {h: j for j, h in enumerate(r.handles or ())}} for i, r in enumerate(self.relations)}

    def to_json(self) -> dict:
        return {
            "relations": [{"name": r.name, "fields": [{"name": f.name, "type": type_to_json(f.type), "fresh": f.fresh} for f in r.fields], "rows": r.rows and [[_json(v) for v in row] for row in r.rows], "handles": r.handles and list(r.handles)} for r in self.relations],
            "statements": [_statement_json(s) for s in self.statements],
        }

    @staticmethod
    def from_json(x: dict) -> Schema:
        rels = tuple(Relation(r["name"], tuple(Field(f["name"], type_from_json(f["type"]), f["fresh"]) for f in r["fields"]), r["rows"] and tuple(tuple(_unjson(v) for v in row) for row in r["rows"]), r["handles"] and tuple(r["handles"])) for r in x["relations"])
        return Schema(rels, tuple(_statement_from(s) for s in x["statements"]))


def _json(v):
    if isinstance(v, (bytes, bytearray)):
        return {"bytes": v.hex()}
    if isinstance(v, frozenset):
        return {"set": sorted((_json(x) for x in v), key=json.dumps)}
    return {"interval": list(v)} if isinstance(v, tuple) else v


def _unjson(v):
    if isinstance(v, dict):
        return bytes.fromhex(v["bytes"]) if "bytes" in v else tuple(v["interval"]) if "interval" in v else frozenset(_unjson(x) for x in v["set"])
    return v


def _side_json(s: Side):
    return {"relation": s.relation, "fields": list(s.fields), "where": [[k, _json(v)] for k, v in s.where]}


def _statement_json(s):
    if isinstance(s, Key):
        return {"key": s.relation, "fields": list(s.fields)}
    if isinstance(s, Contained):
        return {"contained": [_side_json(s.source), _side_json(s.target)]}
    return {"capacity": [_side_json(s.target), _side_json(s.source)], "lo": s.lo, "hi": list(s.hi) if isinstance(s.hi, tuple) else s.hi, "weight": list(s.weight) if isinstance(s.weight, tuple) else s.weight}


def _statement_from(x):
    def sd(y):
        return Side(y["relation"], tuple(y["fields"]), tuple((k, _unjson(v)) for k, v in y["where"]))

    if "key" in x:
        return Key(x["key"], tuple(x["fields"]))
    if "contained" in x:
        return Contained(*map(sd, x["contained"]))
    pair = lambda v: tuple(v) if isinstance(v, list) else v
    return Capacity(sd(x["capacity"][0]), sd(x["capacity"][1]), x["lo"], pair(x["hi"]), pair(x["weight"]))


def _validate(s: Schema) -> None:
    if len(s._by_name) != len(s.relations):
        raise SchemaError("DuplicateRelation")
    for r in s.relations:
        names = [f.name for f in r.fields]
        if len(set(names)) != len(names):
            raise SchemaError("DuplicateField", r.name)
        for f in r.fields:
            if isinstance(f.type, Bytes) and not 1 <= f.type.width <= 64:
                raise SchemaError("BytesWidth", f"{r.name}.{f.name}")
            if isinstance(f.type, Interval) and f.type.width is not None and f.type.width < 1:
                raise SchemaError("IntervalWidth", f"{r.name}.{f.name}")
            if f.fresh and not isinstance(f.type, U64):
                raise SchemaError("FreshType", f"{r.name}.{f.name}")
            if r.closed and (f.fresh or isinstance(f.type, Str)):
                raise SchemaError("FreshOnClosed" if f.fresh else "StrOnClosed", f"{r.name}.{f.name}")
        if r.closed:
            if not r.rows:
                raise SchemaError("EmptyExtension", r.name)
            if len(r.rows) > MAX_EXTENSION:
                raise SchemaError("ExtensionTooLarge", r.name)
            if len(set(r.handles)) != len(r.handles):
                raise SchemaError("DuplicateHandle", r.name)
            for row in r.rows:
                if len(row) != len(r.fields):
                    raise SchemaError("ExtensionArity", r.name)
                for v, f in zip(row, r.fields, strict=True):
                    if not fits(v, f.type):
                        raise SchemaError("ExtensionType", f"{r.name}.{f.name}")
                    if isinstance(f.type, Interval) and v[1] == ray_end(f.type):
                        raise SchemaError("ExtensionRay", f"{r.name}.{f.name}")
    seen = set()
    for st in s.statements:
        mark = json.dumps(_statement_json(st), sort_keys=True)
        if mark in seen:
            raise SchemaError("DuplicateStatement", mark)
        seen.add(mark)
        if isinstance(st, Key):
            _projection(s, Side(st.relation, st.fields))
        else:
            a, b = (st.source, st.target)
            ta, tb = _projection(s, a), _projection(s, b)
            if len(ta) != len(tb):
                raise SchemaError("Arity", mark)
            for x, y in zip(ta, tb, strict=True):
                ok = same_type(x, y) or isinstance(x, Interval) and isinstance(y, Interval) and same_type(x.element, y.element)
                if not ok:
                    raise SchemaError("TypeMismatch", mark)
            target_key = any(set(k.fields) == set(b.fields) or not b.where and set(k.fields) <= set(b.fields) for k in s.keys(b.relation))
            if not target_key:
                raise SchemaError("NoMatchingKey", mark)
            if isinstance(st, Capacity):
                _capacity(s, st, mark)
        if _constant(s, st) and not _holds(s, st):
            raise SchemaError("FalseOfConstants", mark)


def _projection(s: Schema, sd: Side) -> list:
    r = s[sd.relation]
    if not sd.fields:
        raise SchemaError("EmptyProjection", sd.relation)
    if len(set(sd.fields)) != len(sd.fields):
        raise SchemaError("DuplicateProjection", sd.relation)
    types = [r.field(f).type for f in sd.fields]
    spans = [i for i, t in enumerate(types) if isinstance(t, Interval)]
    if len(spans) > 1:
        raise SchemaError("TwoIntervals", sd.relation)
    if spans and spans[0] != len(types) - 1:
        raise SchemaError("IntervalNotLast", sd.relation)
    names = [k for k, _ in sd.where]
    if len(set(names)) != len(names):
        raise SchemaError("DuplicateSelection", sd.relation)
    for k, v in sd.where:
        if k in sd.fields:
            raise SchemaError("SelectedAndProjected", f"{sd.relation}.{k}")
        values = v if isinstance(v, frozenset) else [v]
        if isinstance(v, frozenset) and len(v) < 2:
            raise SchemaError("DegenerateSet", f"{sd.relation}.{k}")
        if not all(fits(x, r.field(k).type) for x in values):
            raise SchemaError("SelectionType", f"{sd.relation}.{k}")
    return types


def _capacity(s: Schema, st: Capacity, mark: str) -> None:
    src, dst = s[st.source.relation], s[st.target.relation]
    if any(isinstance(src.field(f).type, Interval) for f in st.source.fields):
        raise SchemaError("CapacityIntervalPosition", mark)
    if isinstance(st.hi, int) and st.hi < st.lo:
        raise SchemaError("CapacityInverted", mark)
    if st.lo == 0 and st.hi is None:
        raise SchemaError("CapacityVacuous", mark)
    if isinstance(st.weight, tuple) and not isinstance(src.field(st.weight[1]).type, Interval):
        raise SchemaError("DurationWeight", mark)
    if isinstance(st.weight, str) and not isinstance(src.field(st.weight).type, (U64, I64)):
        raise SchemaError("WeightType", mark)
    if isinstance(st.hi, tuple) and not isinstance(dst.field(st.hi[1]).type, Interval):
        raise SchemaError("DurationBound", mark)
    if isinstance(st.hi, str) and not isinstance(dst.field(st.hi).type, (U64, I64)):
        raise SchemaError("BoundType", mark)
    if isinstance(st.hi, tuple) != isinstance(st.weight, tuple) and isinstance(st.hi, tuple):
        raise SchemaError("DimensionMixing", mark)


def _constant(s: Schema, st) -> bool:
    """Whether the statement speaks of closed relations only, so that it is decided here."""
    return all(s[name].closed for name in ([st.relation] if isinstance(st, Key) else [st.source.relation, st.target.relation]))


def _facts(s: Schema, sd: Side) -> list[dict]:
    r = s[sd.relation]
    facts = [dict(zip((f.name for f in r.fields), row, strict=True)) for row in r.rows]
    return [f for f in facts if all(f[k] in v if isinstance(v, frozenset) else f[k] == v for k, v in sd.where)]


def _holds(s: Schema, st) -> bool:
    if isinstance(st, Key):
        r = s[st.relation]
        spans = [f for f in st.fields if isinstance(r.field(f).type, Interval)]
        seen: dict[tuple, list] = {}
        for f in _facts(s, Side(st.relation, st.fields)):
            seen.setdefault(tuple(f[k] for k in st.fields if k not in spans), []).append(f[spans[0]] if spans else None)
        if not spans:
            return all(len(x) == 1 for x in seen.values())
        return all(a[1] <= b[0] for x in seen.values() for a, b in zip(sorted(x), sorted(x)[1:]))
    source, target = _facts(s, st.source), _facts(s, st.target)
    if isinstance(st, Capacity):
        for t in target:
            mine = [f for f in source if all(f[a] == t[b] for a, b in zip(st.source.fields, st.target.fields, strict=True))]
            n = sum(_length(f[st.weight[1]]) if isinstance(st.weight, tuple) else f[st.weight] if st.weight else 1 for f in mine)
            hi = _length(t[st.hi[1]]) if isinstance(st.hi, tuple) else t[st.hi] if isinstance(st.hi, str) else st.hi
            if n < st.lo or hi is not None and n > hi:
                return False
        return True
    last = s[st.source.relation].field(st.source.fields[-1])
    if not isinstance(last.type, Interval):
        there = {tuple(t[k] for k in st.target.fields) for t in target}
        return all(tuple(f[k] for k in st.source.fields) in there for f in source)
    for f in source:
        at, end = f[last.name]
        parts = sorted(t[st.target.fields[-1]] for t in target if all(t[b] == f[a] for a, b in zip(st.source.fields[:-1], st.target.fields[:-1], strict=True)))
        for lo, hi in parts:
            if lo <= at:
                at = max(at, hi)
        if at < end:
            return False
    return True


def _length(span: tuple) -> int:
    return span[1] - span[0]
