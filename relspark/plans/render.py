"""Queries and statements as text."""

from __future__ import annotations

from relspark.functions.allen import BASICS, NAMED
from relspark.ir import Agg, Allen, And, Compare, Duration, Lit, Or, Param, ParamSet, PointIn, Query, Rule, Var
from relspark.schema import Capacity, Contained, Key, Side


def _value(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (bytes, bytearray)):
        return f"0x{v.hex()}"
    if isinstance(v, tuple):
        return f"[{v[0]}, {v[1]})"
    if isinstance(v, frozenset):
        return "{" + ", ".join(sorted(map(_value, v))) + "}"
    return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v)


def _term(t) -> str:
    if isinstance(t, Lit):
        return _value(t.value)
    if isinstance(t, Param):
        return f"${t.name}"
    if isinstance(t, ParamSet):
        return f"${t.name}*"
    return f"duration({t.var})" if isinstance(t, Duration) else t.name


def mask_text(mask: int) -> str:
    for name, bits in NAMED.items():
        if bits == mask:
            return name
    return "|".join(b for i, b in enumerate(BASICS) if mask >> i & 1)


def _condition(c, top=False) -> str:
    if isinstance(c, (And, Or)):
        if not c.parts:
            return "true" if isinstance(c, And) else "false"
        text = (" and " if isinstance(c, And) else " or ").join(map(_condition, c.parts))
        return f"({text})"
    if isinstance(c, Allen):
        return f"{_term(c.left)} {{{mask_text(c.mask)}}} {_term(c.right)}"
    if isinstance(c, PointIn):
        return f"{_term(c.point)} in {_term(c.interval)}"
    return f"{_term(c.left)} {c.op} {_term(c.right)}"


def _find(f) -> str:
    if isinstance(f, Agg):
        return f"{f.op}({'' if f.over is None else _term(f.over)})"
    return _term(f)


def _atom(a) -> str:
    return f"{a.source}({', '.join(f'{f}: {_term(t)}' for f, t in a.bindings)})"


def render_rule(r: Rule) -> str:
    body = [_atom(a) for a in r.atoms] + [f"not {_atom(a)}" for a in r.negated] + [_condition(c) for c in r.conditions]
    return f"{', '.join(map(_find, r.finds))} | {', '.join(body)};"


def render(q: Query) -> str:
    lines = [f"let {i.name} = {render_rule(r)}" for i in q.interiors for r in i.rules]
    if q.rec:
        lines += [f"rec {q.rec.name} = {render_rule(r)}" for r in q.rec.base] + [f"step {q.rec.name} = {render_rule(r)}" for r in q.rec.step]
    return "\n".join(lines + [render_rule(r) for r in q.rules])


def _side(s: Side) -> str:
    where = " | " + ", ".join(f"{k} == {_value(v)}" for k, v in s.where) if s.where else ""
    return f"{s.relation}({', '.join(s.fields)}{where})"


def render_statement(s) -> str:
    if isinstance(s, Key):
        return f"{s.relation}({', '.join(s.fields)}) -> {s.relation}"
    if isinstance(s, Contained):
        return f"{_side(s.source)} <= {_side(s.target)}"
    assert isinstance(s, Capacity)
    show = lambda x: "*" if x is None else f"duration({x[1]})" if isinstance(x, tuple) else str(x)
    weight = "" if s.weight is None else f"[{show(s.weight)}]"
    return f"{_side(s.target)} <={weight}{{{s.lo}..{show(s.hi)}}} {_side(s.source)}"


__all__ = ["Var", "mask_text", "render", "render_rule", "render_statement"]
