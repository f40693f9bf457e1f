"""Typing and refusal of malformed queries.

A variable that is bound at an interval field is a point of it where the
variable also has a scalar binding, and the whole interval otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from relspark.errors import QueryError
from relspark.functions.allen import check_mask
from relspark.ir import Agg, Allen, And, Compare, Duration, Lit, Or, Param, ParamSet, PointIn, Query, Rule, Var, condition_vars, has_measure
from relspark.schema import Schema
from relspark.types import I64, ORDERED, U64, Bool, Bytes, Interval, Str, comparable, fits, ray_end, same_type

MAX_RULES, MAX_ATOMS, MAX_VARS, MAX_DEPTH = 16, 20, 128, 64
ORDER_OPS = {"<", "<=", ">", ">="}
CLOSED_REF = "closed"


@dataclass
class TypedRule:
    rule: Rule
    types: dict = field(default_factory=dict)  # variable -> type
    closed: set = field(default_factory=set)  # variables that hold handles of a vocabulary


@dataclass
class TypedQuery:
    query: Query
    rules: list
    interiors: dict  # name -> list of TypedRule
    rec: tuple | None  # (base, step)
    tables: dict  # derived name -> column types
    params: dict  # name -> ("scalar" | "set", type)
    signature: list  # types of the head


class _Context:
    def __init__(self, schema: Schema):
        self.schema, self.tables, self.params = schema, {}, {}

    def field_type(self, atom, name):
        if atom.source in self.tables:
            cols = self.tables[atom.source]
            if not isinstance(name, int) or not 0 <= name < len(cols):
                raise QueryError("InteriorColumnOutOfRange", f"{atom.source}.{name}")
            return cols[name]
        if not self.schema.has(atom.source):
            raise QueryError("UnknownRelation", str(atom.source))
        r = self.schema[atom.source]
        if not r.has(name):
            raise QueryError("UnknownField", f"{atom.source}.{name}")
        return r.field(name).type

    def closed_field(self, atom, name) -> bool:
        if atom.source in self.tables:
            return False
        r = self.schema[atom.source]
        if r.closed and name == "id":
            return True
        from relspark.schema import Contained

        return any(isinstance(s, Contained) and s.source.relation == r.name and s.source.fields == (name,) and s.target.fields == ("id",) and self.schema[s.target.relation].closed for s in self.schema.statements)

    def param(self, name, kind, t):
        seen = self.params.get(name)
        if seen is None:
            self.params[name] = (kind, t)
        elif seen[0] != kind:
            raise QueryError("ParamScalarAndSet", name)
        elif not comparable(seen[1], t):
            raise QueryError("ParamTypeConflict", name)


def _check_literal(value, t):
    if isinstance(t, Interval):
        if isinstance(value, tuple):
            if not (len(value) == 2 and fits(value, Interval(t.element))):
                raise QueryError("LiteralTypeMismatch", repr(value))
        elif not fits(value, t.element):
            raise QueryError("LiteralTypeMismatch", repr(value))
        elif value == ray_end(t):
            raise QueryError("PointLiteralAtCeiling", repr(value))
    elif not fits(value, t):
        raise QueryError("LiteralTypeMismatch", repr(value))


def _leaves(c, depth=0):
    if depth > MAX_DEPTH:
        raise QueryError("ConditionNestingTooDeep")
    if isinstance(c, (And, Or)):
        for p in c.parts:
            yield from _leaves(p, depth + 1)
    elif isinstance(c, (Compare, Allen, PointIn)):
        yield c
    else:
        raise QueryError("IllegalComparison", repr(c))


def dnf_width(c) -> int:
    if isinstance(c, And):
        out = 1
        for p in c.parts:
            out *= dnf_width(p)
        return out
    return sum(map(dnf_width, c.parts)) if isinstance(c, Or) else 1


def _rule(ctx: _Context, rule: Rule, allow_agg=True, allow_measure=True) -> TypedRule:
    if not rule.finds:
        raise QueryError("EmptyFinds")
    if not rule.atoms:
        raise QueryError("NoPositiveAtoms")
    if len(rule.atoms) + len(rule.negated) > MAX_ATOMS:
        raise QueryError("TooManyAtoms")
    width = 1
    for c in rule.conditions:
        list(_leaves(c))
        width *= dnf_width(c)
    if width > MAX_RULES:
        raise QueryError("DnfExceedsRules")
    out = TypedRule(rule)
    scalar, spans = {}, {}
    for atom in (*rule.atoms, *rule.negated):
        names = [f for f, _ in atom.bindings]
        if len(set(names)) != len(names):
            raise QueryError("DuplicateFieldBinding", str(atom.source))
        for f, t in atom.bindings:
            ft = ctx.field_type(atom, f)
            positive = atom in rule.atoms
            if isinstance(t, Duration):
                raise QueryError("DurationInBinding")
            if isinstance(t, Var):
                if isinstance(ft, Interval):
                    spans.setdefault(t.name, []).append((ft, positive))
                elif t.name in scalar and not same_type(scalar[t.name][0], ft):
                    raise QueryError("VariableTypeConflict", t.name)
                else:
                    scalar[t.name] = (ft, scalar.get(t.name, (ft, False))[1] or positive)
                    if ctx.closed_field(atom, f):
                        out.closed.add(t.name)
            elif isinstance(t, Lit):
                _check_literal(t.value, ft)
    for v, (t, _) in scalar.items():
        out.types[v] = t
        for ft, _ in spans.get(v, []):
            if not same_type(ft.element, t):
                raise QueryError("VariableTypeConflict", v)
    for v, found in spans.items():
        if v in scalar:
            if not scalar[v][1]:
                raise QueryError("MembershipOnlyVariable", v)
            continue
        first = found[0][0]
        if any(not comparable(ft, first) for ft, _ in found):
            raise QueryError("VariableTypeConflict", v)
        out.types[v] = next((ft for ft, _ in found if ft.width is None), first)
    if len(out.types) > MAX_VARS:
        raise QueryError("TooManyVariables")
    bound = {t.name for a in rule.atoms for _, t in a.bindings if isinstance(t, Var) and (t.name not in scalar or scalar[t.name][1])}
    for atom in rule.negated:
        for _, t in atom.bindings:
            if isinstance(t, Var) and t.name not in bound:
                raise QueryError("NegatedVariableUnbound", t.name)
    for atom in (*rule.atoms, *rule.negated):
        for f, t in atom.bindings:
            ft = ctx.field_type(atom, f)
            if isinstance(t, Param):
                ctx.param(t.name, "scalar", ft)
            elif isinstance(t, ParamSet):
                ctx.param(t.name, "set", ft.element if isinstance(ft, Interval) else ft)
    for c in rule.conditions:
        for leaf in _leaves(c):
            _leaf(ctx, out, leaf, bound)
            if has_measure(leaf) and not allow_measure:
                raise QueryError("MeasureInInterior")
    _finds(out, bound, allow_agg, allow_measure)
    return out


def _leaf(ctx, out: TypedRule, c, bound):
    for v in condition_vars(c):
        if v not in bound:
            raise QueryError("ComparisonOnlyVariable", v)
    typed = lambda t: out.types[t.name] if isinstance(t, Var) else None
    if isinstance(c, (Allen, PointIn)):
        sides = (c.left, c.right) if isinstance(c, Allen) else (c.interval, c.point)
        if any(isinstance(x, Duration) for x in sides) or any(isinstance(x, ParamSet) for x in (sides if isinstance(c, Allen) else sides[:1])):
            raise QueryError("IllegalComparison", repr(c))
    if isinstance(c, Allen):
        check_mask(c.mask)
        a, b = typed(c.left), typed(c.right)
        known = a or b
        if known is None:
            raise QueryError("ConstantComparison")
        if c.left == c.right:
            raise QueryError("SelfComparison")
        for t, x in ((a, c.left), (b, c.right)):
            if t is not None and not isinstance(t, Interval) or t is not None and not comparable(t, known):
                raise QueryError("IllegalComparison", "Allen needs intervals of one element type")
            _other(ctx, x, Interval(known.element) if isinstance(known, Interval) else known, pointlike=False)
        return
    if isinstance(c, PointIn):
        t, p = typed(c.interval), typed(c.point)
        if t is None and p is None:
            raise QueryError("ConstantComparison")
        if t is not None and not isinstance(t, Interval):
            raise QueryError("IllegalComparison", "PointIn needs an interval")
        element = t.element if t is not None else p
        if p is not None and not same_type(p, element):
            raise QueryError("IllegalComparison", "PointIn needs a point of the element type")
        _other(ctx, c.interval, Interval(element), pointlike=False)
        if isinstance(c.point, ParamSet):
            ctx.param(c.point.name, "set", element)
        else:
            _other(ctx, c.point, element, pointlike=Interval(element))
        return
    if c.op not in ORDER_OPS | {"==", "!="}:
        raise QueryError("IllegalComparison", str(c.op))
    sides = (c.left, c.right)
    if sum(isinstance(x, Duration) for x in sides) == 2:
        raise QueryError("DurationBothSides")
    if not any(isinstance(x, (Var, Duration)) for x in sides):
        raise QueryError("ConstantComparison")
    if c.left == c.right:
        raise QueryError("SelfComparison")
    types = []
    for x in sides:
        if isinstance(x, Duration):
            if not isinstance(out.types[x.var], Interval):
                raise QueryError("DurationOverNonInterval", x.var)
            if c.op not in ORDER_OPS:
                raise QueryError("DurationComparisonOperator", c.op)
            types.append(U64())
        else:
            types.append(typed(x))
    known = next(t for t in types if t is not None)
    for t in types:
        if t is not None and not comparable(t, known):
            raise QueryError("IllegalComparison", f"{known} and {t}")
    if c.op in ORDER_OPS:
        kind = "OrderOnInterval" if isinstance(known, Interval) else "OrderOnBytes" if isinstance(known, Bytes) else "OrderOnString" if isinstance(known, Str) else None
        if kind:
            raise QueryError(kind)
        if any(isinstance(x, Var) and x.name in out.closed for x in sides):
            raise QueryError("OrderOnClosedReference")
        assert isinstance(known, ORDERED)
    for x in sides:
        if isinstance(x, ParamSet):
            if c.op != "==":
                raise QueryError("ParamSetComparison", c.op)
            if isinstance(known, Interval):
                raise QueryError("IntervalParamSet", x.name)
            ctx.param(x.name, "set", known)
        else:
            _other(ctx, x, known, pointlike=False)


def _other(ctx, x, t, pointlike):
    if isinstance(x, Lit):
        if isinstance(t, Interval) and not isinstance(x.value, tuple):
            raise QueryError("LiteralTypeMismatch", repr(x.value))
        _check_literal(x.value, t)
        if pointlike and x.value == ray_end(pointlike):
            raise QueryError("ComparisonPointLiteralAtCeiling", repr(x.value))
    elif isinstance(x, Param):
        ctx.param(x.name, "scalar", t)


def _finds(out: TypedRule, bound, allow_agg, allow_measure):
    finds = out.rule.finds
    if len(set(finds)) != len(finds):
        raise QueryError("DuplicateFindTerm")
    group = {f.name for f in finds if isinstance(f, Var)}
    packs = sum(isinstance(f, Agg) and f.op == "pack" for f in finds)
    aggs = [f for f in finds if isinstance(f, Agg)]
    if packs > 1:
        raise QueryError("MultiplePackTerms")
    if packs and len(aggs) > 1:
        raise QueryError("MixedPackAndFold")
    for f in finds:
        over = f.over if isinstance(f, Agg) else f
        name = over.name if isinstance(over, Var) else over.var if isinstance(over, Duration) else None
        if name is not None and name not in bound:
            raise QueryError("UnboundFindVariable", name)
        if isinstance(over, Duration):
            if not allow_measure:
                raise QueryError("MeasureInInterior")
            if not isinstance(out.types[name], Interval):
                raise QueryError("DurationOverNonInterval", name)
        if not isinstance(f, Agg):
            if not isinstance(f, (Var, Duration)):
                raise QueryError("UnboundFindVariable", repr(f))
            continue
        if not allow_agg:
            raise QueryError("AggregateInInterior")
        if f.op == "count":
            if f.over is not None:
                raise QueryError("CountWithVariable")
            continue
        if f.op not in ("sum", "min", "max", "pack"):
            raise QueryError("AggregateInputType", f.op)
        if f.over is None:
            raise QueryError("AggregateWithoutVariable")
        if name is None:
            raise QueryError("AggregateInputType", repr(f.over))
        t = out.types[name]
        if isinstance(over, Duration):
            if f.op == "pack":
                raise QueryError("DurationAggregateOp")
            continue
        if name in group:
            raise QueryError("AggregateOverGroupKey", name)
        if name in out.closed:
            raise QueryError("AggregateOverClosedReference", name)
        if f.op == "pack":
            if not isinstance(t, Interval):
                raise QueryError("PackInputType")
        elif not isinstance(t, (I64, U64)) and not (f.op in ("min", "max") and isinstance(t, Bool)):
            raise QueryError("AggregateInputType", f"{f.op} over {t}")


def head_types(r: TypedRule) -> list:
    out = []
    for f in r.rule.finds:
        over = f.over if isinstance(f, Agg) else f
        if isinstance(f, Agg) and f.op == "count" or isinstance(over, Duration):
            out.append(U64(wide=isinstance(over, Duration)))
        elif isinstance(f, Agg) and f.op == "pack":
            out.append(Interval(r.types[over.name].element))
        elif isinstance(f, Agg) and f.op == "sum" and isinstance(r.types[over.name], U64):
            out.append(U64(wide=True))
        else:
            out.append(r.types[over.name])
    return out


def _union(rules: list[TypedRule]) -> list:
    first = head_types(rules[0])
    shape = [(f.op, type(f.over)) if isinstance(f, Agg) else None for f in rules[0].rule.finds]
    for r in rules[1:]:
        types = head_types(r)
        if len(types) != len(first):
            raise QueryError("HeadArityMismatch")
        if [(f.op, type(f.over)) if isinstance(f, Agg) else None for f in r.rule.finds] != shape:
            raise QueryError("HeadAggregateMismatch")
        if any(not comparable(a, b) for a, b in zip(first, types, strict=True)):
            raise QueryError("HeadTypeMismatch")
    if len(rules) > 1 and any(s == ("count", type(None)) for s in shape) and not any(isinstance(f, Agg) and f.op != "count" for f in rules[0].rule.finds):
        raise QueryError("CountAcrossRules")
    return first


def validate(schema: Schema, q: Query) -> TypedQuery:
    ctx = _Context(schema)
    if not q.rules:
        raise QueryError("EmptyRuleSet")
    if len(q.rules) > MAX_RULES:
        raise QueryError("TooManyRules")
    names = [i.name for i in q.interiors] + ([q.rec.name] if q.rec else [])
    if len(set(names)) != len(names) or any(schema.has(n) for n in names):
        raise QueryError("InteriorIdOverflow", "names of tables must be distinct")
    interiors = {}
    for n, i in enumerate(q.interiors):
        if not i.rules:
            raise QueryError("EmptyInterior", i.name)
        for r in i.rules:
            for a in (*r.atoms, *r.negated):
                if a.source in names[n:]:
                    raise QueryError("InteriorNotPrior", str(a.source))
        interiors[i.name] = [_rule(ctx, r, allow_agg=False, allow_measure=False) for r in i.rules]
        ctx.tables[i.name] = _union(interiors[i.name])
    rec = None
    if q.rec:
        if not q.rec.base:
            raise QueryError("EmptyRecursiveBase")
        if not q.rec.step:
            raise QueryError("EmptyRecursiveStep")
        for r in (*q.rec.base, *q.rec.step):
            if r.negated:
                raise QueryError("NegationInRec")
            selves = sum(a.source == q.rec.name for a in r.atoms)
            if r in q.rec.base and selves:
                raise QueryError("SelfInBase")
            if r in q.rec.step and selves != 1:
                raise QueryError("RecArmMissingSelf" if not selves else "NonlinearRecArm")
        try:
            base = [_rule(ctx, r, False, False) for r in q.rec.base]
            ctx.tables[q.rec.name] = _union(base)
            step = [_rule(ctx, r, False, False) for r in q.rec.step]
        except QueryError as e:
            if e.code == "MeasureInInterior":
                raise QueryError("MeasureInRec") from None
            raise
        _union([base[0], *step])
        rec = (base, step)
    rules = [_rule(ctx, r) for r in q.rules]
    return TypedQuery(q, rules, interiors, rec, ctx.tables, ctx.params, _union(rules))
