"""Writing queries in Python: ``rule(find, ..., atoms..., conditions...)`` with ``V.x``, ``P.x`` and ``S.x``."""

from __future__ import annotations

from relspark.functions.allen import NAMED
from relspark.ir import Agg, Allen, And, Atom, Compare, Duration, Interior, Lit, Or, Param, ParamSet, PointIn, Query, Rec, Rule, Var


class _Names:
    def __init__(self, kind):
        self._kind = kind

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return self._kind(name)


V, P, S = _Names(Var), _Names(Param), _Names(ParamSet)
TERMS = (Var, Lit, Param, ParamSet, Duration)


def term(x):
    return x if isinstance(x, TERMS) else Lit(x)


def atom(source: str, /, *columns, **fields) -> Atom:
    """Fields by name, or the columns of a derived table by position (None skips one)."""
    return Atom(source, (*((i, term(c)) for i, c in enumerate(columns) if c is not None), *((k, term(v)) for k, v in fields.items())))


class Not:
    def __init__(self, a: Atom):
        self.atom = a


def compare(op: str, a, b) -> Compare:
    return Compare(op, term(a), term(b))


def eq(a, b):
    return compare("==", a, b)


def ne(a, b):
    return compare("!=", a, b)


def lt(a, b):
    return compare("<", a, b)


def le(a, b):
    return compare("<=", a, b)


def gt(a, b):
    return compare(">", a, b)


def ge(a, b):
    return compare(">=", a, b)


def allen(mask, a, b) -> Allen:
    """``mask``: bits, or names of relations joined by ``|``."""
    if isinstance(mask, str):
        bits = 0
        for name in mask.split("|"):
            bits |= NAMED[name.strip()]
        mask = bits
    return Allen(mask, term(a), term(b))


def point_in(interval, point) -> PointIn:
    return PointIn(term(interval), term(point))


def all_of(*parts) -> And:
    return And(parts)


def any_of(*parts) -> Or:
    return Or(parts)


def duration(v: Var) -> Duration:
    return Duration(v.name)


def count() -> Agg:
    return Agg("count")


def sum_(x) -> Agg:
    return Agg("sum", x)


def min_(x) -> Agg:
    return Agg("min", x)


def max_(x) -> Agg:
    return Agg("max", x)


def pack(x) -> Agg:
    return Agg("pack", x)


def rule(finds, *body) -> Rule:
    finds = tuple(finds) if isinstance(finds, (list, tuple)) else (finds,)
    return Rule(finds, tuple(b for b in body if isinstance(b, Atom)), tuple(b.atom for b in body if isinstance(b, Not)), tuple(b for b in body if not isinstance(b, (Atom, Not))))


def query(*rules: Rule, interiors: dict | None = None, rec: tuple | None = None) -> Query:
    """``interiors``: name -> rules; ``rec``: (name, base rules, step rules)."""
    made = tuple(Interior(k, tuple(v) if isinstance(v, (list, tuple)) else (v,)) for k, v in (interiors or {}).items())
    return Query(tuple(rules), made, rec and Rec(rec[0], tuple(rec[1]), tuple(rec[2])))
