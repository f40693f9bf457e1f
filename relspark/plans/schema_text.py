"""Schemas as text: ``parse_schema`` reads what ``render_schema`` writes.

    relation Order { id: u64 fresh, cust: i64, open: interval<i64>, slot: interval<i64, 7200>, tag: bytes<4> }
    closed Kind { weight: i64, hot: bool } = { low: (1, false), mid: (5, true) }
    Order(id, open) -> Order
    Order(cust | status == "F") <= Customer(id)
    Order(id) == Paid(order)
    Room(id) <=[duration(during)]{0..duration(open)} Booking(room)
"""

from __future__ import annotations

import re

from relspark.errors import SchemaError
from relspark.plans.render import _value, render_statement
from relspark.schema import Capacity, Contained, Field, Key, Relation, Schema, Side, mirrors
from relspark.types import I64, U64, Bool, Bytes, Interval, Str

_TOKEN = re.compile(r"""\s*(?:(?P<str>"(?:[^"\\]|\\.)*")|(?P<hex>0x(?:[0-9a-fA-F]{2})+)|(?P<num>-?\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|->|<=|\.\.|[<>()\[\]{},:|=*]))""")


class _Reader:
    def __init__(self, text: str):
        text = re.sub(r"(?m)^\s*//.*$", "", text)
        self.tokens, at = [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise SchemaError("Syntax", f"at {text[at : at + 20].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.i = 0

    def at(self, text):
        return self.tokens[self.i][1] == text and self.tokens[self.i][0] != "str"

    def take(self, text=None):
        kind, x = self.tokens[self.i]
        if text is not None and x != text:
            raise SchemaError("Syntax", f"expected {text!r}, found {x!r}")
        self.i += 1
        return kind, x

    def listed(self, end, one):
        out = []
        while not self.at(end):
            out.append(one())
            if not self.at(end):
                self.take(",")
        self.take(end)
        return out

    def type(self):
        name = self.take()[1]
        plain = {"i64": I64(), "u64": U64(), "u64wide": U64(True), "bool": Bool(), "str": Str()}
        if name in plain:
            return plain[name]
        if name not in ("interval", "bytes"):
            raise SchemaError("Syntax", f"no type {name!r}")
        self.take("<")
        if name == "bytes":
            out = Bytes(int(self.take()[1]))
        else:
            element, width = self.type(), None
            if self.at(","):
                self.take()
                width = int(self.take()[1])
            out = Interval(element, width)
        self.take(">")
        return out

    def field(self):
        name = self.take()[1]
        self.take(":")
        kind = self.type()
        fresh = self.at("fresh")
        if fresh:
            self.take()
        return Field(name, kind, fresh)

    def value(self):
        kind, x = self.take()
        if kind == "str":
            return re.sub(r"\\(.)", r"\1", x[1:-1])
        if kind == "hex":
            return bytes.fromhex(x[2:])
        if x in ("true", "false"):
            return x == "true"
        if x == "[":
            s = int(self.take()[1])
            self.take(",")
            e = int(self.take()[1])
            self.take(")")
            return (s, e)
        if x == "{":
            return frozenset(self.listed("}", self.value))
        if kind != "num":
            raise SchemaError("Syntax", f"unexpected {x!r}")
        return int(x)

    def row(self):
        handle = self.take()[1]
        self.take(":")
        self.take("(")
        return handle, self.listed(")", self.value)

    def side(self) -> Side:
        name = self.take()[1]
        self.take("(")
        fields, where = [self.take()[1]], []
        while self.at(","):
            self.take()
            fields.append(self.take()[1])
        if self.at("|"):
            self.take()
            while True:
                f = self.take()[1]
                self.take("==")
                where.append((f, self.value()))
                if not self.at(","):
                    break
                self.take()
        self.take(")")
        return Side(name, tuple(fields), tuple(where))

    def amount(self):
        kind, x = self.take()
        if x == "*":
            return None
        if x == "duration":
            self.take("(")
            f = self.take()[1]
            self.take(")")
            return ("duration", f)
        return int(x) if kind == "num" else x

    def statement(self) -> list:
        a = self.side()
        op = self.take()[1]
        if op == "->":
            self.take(a.relation)
            return [Key(a.relation, a.fields)]
        if op == "==":
            return mirrors(a, self.side())
        if op != "<=":
            raise SchemaError("Syntax", f"no statement {op!r}")
        weight = None
        if self.at("["):
            self.take()
            weight = self.amount()
            self.take("]")
        if not self.at("{"):
            return [Contained(a, self.side())]
        self.take("{")
        lo = int(self.take()[1])
        self.take("..")
        hi = self.amount()
        self.take("}")
        return [Capacity(a, self.side(), lo, hi, weight)]


def parse_schema(text: str) -> Schema:
    p, relations, statements = _Reader(text), [], []
    while p.tokens[p.i][0] != "end":
        if p.at("relation") or p.at("closed"):
            kind, name = p.take()[1], p.take()[1]
            p.take("{")
            fields = p.listed("}", p.field)
            if kind == "relation":
                relations.append(Relation(name, tuple(fields)))
                continue
            p.take("=")
            p.take("{")
            rows = p.listed("}", p.row)
            relations.append(Relation(name, (Field("id", U64()), *fields), tuple((i, *r) for i, (_, r) in enumerate(rows)), tuple(h for h, _ in rows)))
        else:
            statements += p.statement()
    return Schema(tuple(relations), tuple(statements))


def _type(t) -> str:
    if isinstance(t, Interval):
        return f"interval<{_type(t.element)}{'' if t.width is None else f', {t.width}'}>"
    return f"bytes<{t.width}>" if isinstance(t, Bytes) else "u64wide" if isinstance(t, U64) and t.wide else t.name


def render_schema(s: Schema) -> str:
    out = []
    for r in s.relations:
        fields = ", ".join(f"{f.name}: {_type(f.type)}{' fresh' if f.fresh else ''}" for f in r.fields[1 if r.closed else 0 :])
        if r.closed:
            rows = ", ".join(f"{h}: ({', '.join(map(_value, row[1:]))})" for h, row in zip(r.handles, r.rows, strict=True))
            out.append(f"closed {r.name} {{ {fields} }} = {{ {rows} }}")
        else:
            out.append(f"relation {r.name} {{ {fields} }}")
    return "\n".join(out + [render_statement(x) for x in s.statements])


def render_violation(s: Schema, row: dict) -> str:
    """One line on a violation row: the statement, the side and the fact."""
    st = s.statements[row["statement"]]
    what = {"Key": "shares its key", "Contained": "has no target" if row["direction"] == "source" else "lost its target", "Capacity": "is outside its capacity"}[type(st).__name__]
    return f"{row['relation']} {row['fact']} {what}: {render_statement(st)}"
