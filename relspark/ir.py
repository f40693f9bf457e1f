"""Queries as plain data: unions of conjunctive rules, named intermediates, one linear recursion."""

from __future__ import annotations

from dataclasses import dataclass, replace

from relspark.schema import _json, _unjson


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class ParamSet:
    name: str


@dataclass(frozen=True)
class Duration:
    """The length of an interval variable."""

    var: str


@dataclass(frozen=True)
class Atom:
    """``source`` is a relation, or an intermediate or recursive table, whose fields are the positions 0, 1, ..."""

    source: str
    bindings: tuple[tuple[object, object], ...] = ()


@dataclass(frozen=True)
class Compare:
    op: str  # == != < <= > >=
    left: object
    right: object


@dataclass(frozen=True)
class Allen:
    mask: int
    left: object
    right: object


@dataclass(frozen=True)
class PointIn:
    interval: object
    point: object


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Agg:
    """op: count, sum, min, max, pack; ``over`` is a Var, a Duration, or None for count."""

    op: str
    over: object = None


@dataclass(frozen=True)
class Rule:
    finds: tuple
    atoms: tuple[Atom, ...]
    negated: tuple[Atom, ...] = ()
    conditions: tuple = ()


@dataclass(frozen=True)
class Interior:
    name: str
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Rec:
    name: str
    base: tuple[Rule, ...]
    step: tuple[Rule, ...]


@dataclass(frozen=True)
class Query:
    rules: tuple[Rule, ...]
    interiors: tuple[Interior, ...] = ()
    rec: Rec | None = None

    def to_json(self) -> dict:
        return {"rules": [_rule(r) for r in self.rules], "interiors": [{"name": i.name, "rules": [_rule(r) for r in i.rules]} for i in self.interiors], "rec": self.rec and {"name": self.rec.name, "base": [_rule(r) for r in self.rec.base], "step": [_rule(r) for r in self.rec.step]}}

    @staticmethod
    def from_json(x: dict) -> Query:
        rec = x.get("rec")
        rules = lambda y: tuple(_unrule(r) for r in y)
        return Query(rules(x["rules"]), tuple(Interior(i["name"], rules(i["rules"])) for i in x.get("interiors", [])), rec and Rec(rec["name"], rules(rec["base"]), rules(rec["step"])))


def _term(t):
    if isinstance(t, Lit):
        return {"lit": _json(t.value)}
    return {type(t).__name__.lower(): getattr(t, "name", getattr(t, "var", None))}


def _unterm(x):
    (kind, v), = x.items()
    return Lit(_unjson(v)) if kind == "lit" else {"var": Var, "param": Param, "paramset": ParamSet, "duration": Duration}[kind](v)


def _cond(c):
    if isinstance(c, (And, Or)):
        return {type(c).__name__.lower(): [_cond(p) for p in c.parts]}
    if isinstance(c, Compare):
        return {"compare": c.op, "left": _term(c.left), "right": _term(c.right)}
    if isinstance(c, Allen):
        return {"allen": c.mask, "left": _term(c.left), "right": _term(c.right)}
    return {"point_in": [_term(c.interval), _term(c.point)]}


def _uncond(x):
    if "and" in x or "or" in x:
        return (And if "and" in x else Or)(tuple(_uncond(p) for p in x["and" if "and" in x else "or"]))
    if "compare" in x:
        return Compare(x["compare"], _unterm(x["left"]), _unterm(x["right"]))
    if "allen" in x:
        return Allen(x["allen"], _unterm(x["left"]), _unterm(x["right"]))
    return PointIn(*map(_unterm, x["point_in"]))


def _atom(a):
    return {"source": a.source, "bindings": [[f, _term(t)] for f, t in a.bindings]}


def _unatom(x):
    return Atom(x["source"], tuple((f, _unterm(t)) for f, t in x["bindings"]))


def _find(f):
    return {"agg": f.op, "over": f.over and _term(f.over)} if isinstance(f, Agg) else _term(f)


def _unfind(x):
    return Agg(x["agg"], x["over"] and _unterm(x["over"])) if "agg" in x else _unterm(x)


def _rule(r):
    return {"finds": [_find(f) for f in r.finds], "atoms": [_atom(a) for a in r.atoms], "negated": [_atom(a) for a in r.negated], "conditions": [_cond(c) for c in r.conditions]}


def _unrule(x):
    return Rule(tuple(map(_unfind, x["finds"])), tuple(map(_unatom, x["atoms"])), tuple(map(_unatom, x["negated"])), tuple(map(_uncond, x["conditions"])))


def condition_vars(c) -> set[str]:
    if isinstance(c, (And, Or)):
        return set().union(*map(condition_vars, c.parts)) if c.parts else set()
    sides = (c.interval, c.point) if isinstance(c, PointIn) else (c.left, c.right)
    return {x.name if isinstance(x, Var) else x.var for x in sides if isinstance(x, (Var, Duration))}


def has_measure(c) -> bool:
    if isinstance(c, (And, Or)):
        return any(map(has_measure, c.parts))
    return isinstance(c, Compare) and (isinstance(c.left, Duration) or isinstance(c.right, Duration))


__all__ = ["Agg", "Allen", "And", "Atom", "Compare", "Duration", "Interior", "Lit", "Or", "Param", "ParamSet", "PointIn", "Query", "Rec", "Rule", "Var", "condition_vars", "has_measure", "replace"]
