"""Rewrites of typed rules that Catalyst can't make, each with a switch."""

from __future__ import annotations

from dataclasses import dataclass, replace

from relspark.ir import Agg, And, Atom, Compare, Duration, Lit, Or, Param, ParamSet, Rule, Var, condition_vars
from relspark.plans.validate import TypedRule
from relspark.schema import Contained, Key, Schema
from relspark.types import Bool, Interval, domain


@dataclass(frozen=True)
class Options:
    fold_ranges: bool = True
    fold_closed: bool = True
    drop_references: bool = True
    collapse_rules: bool = True
    skip_distinct: bool = True
    semi_joins: bool = True
    #: Intervals are merged inside stretches of this length first, so that a hot group reaches its window as few segments.
    pack_width: int | None = None
    #: Which joins of spans that share a point go by buckets: "keyless" ones, "all" (also those with a key, for hot keys), or "off".
    bucket_spans: str = "keyless"


def conjuncts(rule: Rule) -> list:
    out = []

    def walk(c):
        if isinstance(c, And):
            for p in c.parts:
                walk(p)
        else:
            out.append(c)

    for c in rule.conditions:
        walk(c)
    return out


def dead_by_ranges(r: TypedRule) -> bool:
    """Whether the constant comparisons of one variable leave no value."""
    lo, hi, never, only = {}, {}, {}, {}
    flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}
    for c in conjuncts(r.rule):
        if isinstance(c, Or) and not c.parts:
            return True
        if not isinstance(c, Compare):
            continue
        a, op, b = c.left, c.op, c.right
        if isinstance(a, Lit):
            a, op, b = b, flip[op], a
        if not (isinstance(a, Var) and isinstance(b, Lit)):
            continue
        v, x = a.name, b.value
        if op == "==":
            only.setdefault(v, set()).add(x)
        elif op == "!=":
            never.setdefault(v, set()).add(x)
        elif isinstance(x, int):
            if op in (">", ">="):
                lo[v] = max(lo.get(v, x - 1), x + (op == ">"))
            else:
                hi[v] = min(hi.get(v, x + 1), x - (op == "<"))
    for v, xs in only.items():
        x = next(iter(xs))
        if len(xs) > 1 or x in never.get(v, ()) or isinstance(x, int) and not lo.get(v, x) <= x <= hi.get(v, x):
            return True
    for v in {*lo, *hi}:
        t = r.types[v]
        least, most = (0, 1) if isinstance(t, Bool) else domain(t)
        if max(lo.get(v, least), least) > min(hi.get(v, most), most):
            return True
    return False


def _uses(rule: Rule, skip: Atom) -> dict[str, int]:
    """How often variables occur outside one atom."""
    out: dict[str, int] = {}

    def add(v):
        out[v] = out.get(v, 0) + 1

    for f in rule.finds:
        over = f.over if isinstance(f, Agg) else f
        if isinstance(over, (Var, Duration)):
            add(over.name if isinstance(over, Var) else over.var)
    for a in (*rule.atoms, *rule.negated):
        if a is not skip:
            for _, t in a.bindings:
                if isinstance(t, Var):
                    add(t.name)
    for c in rule.conditions:
        for v in condition_vars(c):
            add(v)
    return out


def drop_references(r: TypedRule, schema: Schema, done: list) -> TypedRule:
    """Drop an atom that a containment and a key make certain: source(x..) is there, so target(x..) is, once.

    Sound on admitted states only.  The atom may bind nothing but the key, by
    variables that the source atom binds at the contained fields.
    """
    atoms = list(r.rule.atoms)
    for target in list(atoms):
        if not schema.has(target.source) or any(not isinstance(t, Var) for _, t in target.bindings) or not target.bindings:
            continue
        bound = {f: t.name for f, t in target.bindings}
        for s in schema.statements:
            if not isinstance(s, Contained) or s.target.relation != target.source or s.target.where or set(s.target.fields) != set(bound):
                continue
            if any(isinstance(schema[target.source].field(f).type, Interval) for f in s.target.fields):
                continue
            if not any(isinstance(k, Key) and set(k.fields) <= set(s.target.fields) for k in schema.keys(target.source)):
                continue
            pairs = dict(zip(s.target.fields, s.source.fields, strict=True))
            where = dict(s.source.where)

            def holds(a, where=where, pairs=pairs, bound=bound, target=target, s=s):
                b = dict(a.bindings)
                return a is not target and a.source == s.source.relation and all(b.get(pairs[f]) == Var(v) for f, v in bound.items()) and all(isinstance(b.get(k), Lit) and (b[k].value == v or isinstance(v, frozenset) and b[k].value in v) for k, v in where.items())

            if any(holds(a) for a in atoms):
                atoms.remove(target)
                done.append(f"drop {target.source}")
                break
    return replace(r, rule=replace(r.rule, atoms=tuple(atoms))) if len(atoms) < len(r.rule.atoms) else r


@dataclass(frozen=True)
class InSet:
    """A condition that rewrites make: the variable is one of the ids."""

    var: str
    ids: frozenset
    negated: bool = False


def fold_closed(r: TypedRule, schema: Schema, done: list) -> tuple[TypedRule, list[InSet]]:
    """A vocabulary atom whose payload is only filtered by constants becomes a set of ids."""
    sets: list[InSet] = []
    atoms, negated = list(r.rule.atoms), list(r.rule.negated)

    def ids(atom):
        if not schema.has(atom.source) or not schema[atom.source].closed:
            return None
        b = dict(atom.bindings)
        if not isinstance(b.get("id"), Var) or any(isinstance(t, (Var, Param, ParamSet)) for f, t in b.items() if f != "id"):
            return None
        rel = schema[atom.source]
        at = {f.name: i for i, f in enumerate(rel.fields)}
        if any(isinstance(rel.field(f).type, Interval) for f in b):
            return None
        return frozenset(row[0] for row in rel.rows if all(row[at[f]] == t.value for f, t in b.items() if f != "id"))

    for a in list(atoms):
        found = ids(a)
        if found is not None and len(atoms) > 1:
            v = dict(a.bindings)["id"].name
            if any(x is not a and any(t == Var(v) and not _is_span(schema, x, f) for f, t in x.bindings) for x in atoms):
                atoms.remove(a)
                sets.append(InSet(v, found))
                done.append(f"fold {a.source}")
    for a in list(negated):
        found = ids(a)
        if found is not None:
            negated.remove(a)
            sets.append(InSet(dict(a.bindings)["id"].name, found, True))
            done.append(f"fold not {a.source}")
    return replace(r, rule=replace(r.rule, atoms=tuple(atoms), negated=tuple(negated))), sets


def _is_span(schema, atom, f) -> bool:
    return schema.has(atom.source) and isinstance(schema[atom.source].field(f).type, Interval)


def distinct_proven(r: TypedRule, schema: Schema, loose: set[str] = frozenset(), admitted: bool = False) -> bool:
    """Whether bindings can't repeat: each atom binds a key of its relation, or all of its fields, by value.

    Frames of ``loose`` relations may hold a row twice and prove nothing; keys
    count only in an ``admitted`` state.
    """
    for a in r.rule.atoms:
        if not schema.has(a.source) or a.source in loose:
            return False
        rel = schema[a.source]
        by_value = {f for f, t in a.bindings if isinstance(t, (Var, Lit, Param)) and not (isinstance(rel.field(f).type, Interval) and not (isinstance(t, Var) and isinstance(r.types.get(t.name), Interval)))}
        keys = [set(k.fields) for k in schema.keys(a.source) if admitted or rel.closed] + [{f.name for f in rel.fields}]
        if not any(k <= by_value for k in keys):
            return False
    return True


def collapse(rules: list[TypedRule]) -> list[TypedRule]:
    """Of equal rules one stays, and of rules that differ by more conditions or atoms the wider one (fold-free heads only)."""
    plain = not any(isinstance(f, Agg) for f in rules[0].rule.finds)
    out: list[TypedRule] = []
    for r in rules:
        if any(x.rule == r.rule for x in out):
            continue
        if plain and any(_subsumes(x.rule, r.rule) for x in rules if x is not r and not (_subsumes(r.rule, x.rule) and rules.index(r) < rules.index(x))):
            continue
        out.append(r)
    return out or rules[:1]


def _subsumes(wide: Rule, narrow: Rule) -> bool:
    return wide != narrow and wide.finds == narrow.finds and set(wide.atoms) <= set(narrow.atoms) and set(wide.negated) <= set(narrow.negated) and set(wide.conditions) <= set(narrow.conditions)
