"""From a typed rule to the DataFrame of its bindings."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspark.functions.allen import AFTER, BEFORE, MEETS, MET_BY, allen, point_in, terms
from relspark.functions.measure import measure
from relspark.ir import Agg, Allen, And, Compare, Duration, Lit, Or, Param, ParamSet, PointIn, Var, condition_vars, has_measure
from relspark.operators.overlap import Side, overlap_join
from relspark.plans.rewrite import InSet, Options, conjuncts, distinct_proven, dead_by_ranges, drop_references, fold_closed
from relspark.plans.validate import TypedRule
from relspark.types import Interval, U64, ray_end, spark_type, to_physical


#: Parameter sets of more values are joined rather than listed in the plan.
LARGE_SET = 1_000


def columns_of(v: str, t) -> list[str]:
    return [f"v_{v}_s", f"v_{v}_e"] if isinstance(t, Interval) else [f"v_{v}"]


def lit(value, t) -> Column:
    return F.lit(to_physical(value, t)).cast(spark_type(t))


class Bound:
    """Parameters of one execution."""

    def __init__(self, values: dict):
        self.values = values

    def scalar(self, term):
        return term.value if isinstance(term, Lit) else self.values[term.name]


def _ends(name, t, fixed=False):
    return F.col(f"{name}_start"), F.col(f"{name}_end")


class RuleCompiler:
    """Compiles rules over frames: relation columns by field name, derived columns ``c0``, ``c1``, ... (``_start``/``_end`` for intervals)."""

    def __init__(self, schema, frames: dict[str, DataFrame], tables: dict[str, list], bound: Bound, options: Options, counts: dict[str, int] | None = None, loose: set[str] = frozenset(), admitted: bool = False):
        self.schema, self.frames, self.tables, self.bound, self.options = schema, frames, tables, bound, options
        self.counts, self.loose, self.admitted = counts or {}, loose, admitted
        self.applied: list[str] = []
        self.probes: list[DataFrame] = []
        #: (unit, step, frame) of each step, if they are asked for.
        self.steps: list[tuple[str, str, DataFrame]] | None = None
        self.unit = "main"

    def step(self, label: str, df: DataFrame) -> None:
        if self.steps is not None:
            self.steps.append((self.unit, label, df))

    # Frames of single atoms

    def _field(self, source, f):
        if source in self.tables:
            return f"c{f}", self.tables[source][f]
        return f, self.schema[source].field(f).type

    def atom(self, a, types) -> tuple[DataFrame, list[str], list[tuple[str, str, str]]]:
        """(frame, variables bound by value, memberships): the last are (variable, start column, end column) still to be checked."""
        df = self.frames[a.source]
        first: dict[str, list[Column]] = {}
        outs, members, conds = [], [], []
        for n, (f, t) in enumerate(a.bindings):
            name, ft = self._field(a.source, f)
            if isinstance(ft, Interval):
                s, e = _ends(name, ft)
                if isinstance(t, Var) and isinstance(types[t.name], Interval):
                    if t.name in first:
                        conds += [first[t.name][0] == s, first[t.name][1] == e]
                    else:
                        first[t.name] = [s, e]
                        outs += [s.alias(f"v_{t.name}_s"), e.alias(f"v_{t.name}_e")]
                elif isinstance(t, Var):
                    cols = (f"m_{n}_s", f"m_{n}_e")
                    outs += [s.alias(cols[0]), e.alias(cols[1])]
                    members.append((t.name, *cols))
                elif isinstance(t, ParamSet):
                    points = sorted(self.bound.values[t.name])
                    conds.append(reduce(lambda x, y: x | y, [point_in(lit(p, ft.element), s, e) for p in points]) if points else F.lit(False))
                else:
                    x = self.bound.scalar(t)
                    conds += [s == lit(x[0], ft.element), e == lit(x[1], ft.element)] if isinstance(x, tuple) else [point_in(lit(x, ft.element), s, e)]
                continue
            c = F.col(name)
            if isinstance(t, Var):
                if t.name in first:
                    conds.append(first[t.name][0] == c)
                else:
                    first[t.name] = [c]
                    outs.append(c.alias(f"v_{t.name}"))
            elif isinstance(t, ParamSet):
                values = [to_physical(x, ft) for x in self.bound.values[t.name]]
                if len(values) > LARGE_SET:
                    listed = df.sparkSession.createDataFrame([(x,) for x in values], T.StructType([T.StructField("listed_", spark_type(ft))]))
                    df = df.join(listed, F.col(name) == F.col("listed_"), "left_semi")
                else:
                    conds.append(c.isin(values) if values else F.lit(False))
            else:
                conds.append(c == lit(self.bound.scalar(t), ft))
        # A point variable that the same atom binds is a filter here.
        own = [m for m in members if m[0] in first]
        for c in conds:
            df = df.where(c)
        df = df.select(*outs) if outs else df.select(F.lit(1).alias("gate"))
        for v, s, e in own:
            df = df.where(point_in(F.col(f"v_{v}"), F.col(s), F.col(e)))
        if own:
            df = df.drop(*(x for _, s, e in own for x in (s, e)))
        return df, list(first), [m for m in members if m not in own]

    # Conditions

    def value(self, t, types, like):
        if isinstance(t, Duration):
            it = types[t.var]
            return measure(F.col(f"v_{t.var}_s"), F.col(f"v_{t.var}_e"), it)
        if isinstance(t, Var):
            return F.col(f"v_{t.name}")
        return lit(self.bound.scalar(t), like)

    def span(self, t, types, element):
        if isinstance(t, Var):
            return F.col(f"v_{t.name}_s"), F.col(f"v_{t.name}_e")
        s, e = self.bound.scalar(t)
        return lit(s, element), lit(e, element)

    def condition(self, c, types) -> Column:
        if isinstance(c, And):
            return reduce(lambda a, b: a & b, [self.condition(p, types) for p in c.parts], F.lit(True))
        if isinstance(c, Or):
            return reduce(lambda a, b: a | b, [self.condition(p, types) for p in c.parts]) if c.parts else F.lit(False)
        if isinstance(c, InSet):
            got = F.col(f"v_{c.var}").isin([to_physical(x, types[c.var]) for x in sorted(c.ids)]) if c.ids else F.lit(False)
            return ~got if c.negated else got
        if isinstance(c, Allen):
            element = next(types[x.name].element for x in (c.left, c.right) if isinstance(x, Var))
            return allen(c.mask, *self.span(c.left, types, element), *self.span(c.right, types, element))
        if isinstance(c, PointIn):
            element = types[c.interval.name].element if isinstance(c.interval, Var) else types[c.point.name]
            s, e = self.span(c.interval, types, element)
            if isinstance(c.point, ParamSet):
                points = sorted(self.bound.values[c.point.name])
                return reduce(lambda a, b: a | b, [point_in(lit(p, element), s, e) for p in points]) if points else F.lit(False)
            return point_in(self.value(c.point, types, element), s, e)
        known = next((types[x.name] for x in (c.left, c.right) if isinstance(x, Var)), U64(wide=True))
        if isinstance(known, Interval):
            (s, e), (S, E) = self.span(c.left, types, known.element), self.span(c.right, types, known.element)
            same = (s == S) & (e == E)
            return same if c.op == "==" else ~same
        if isinstance(c.left, ParamSet) or isinstance(c.right, ParamSet):
            var, ps = (c.left, c.right) if isinstance(c.right, ParamSet) else (c.right, c.left)
            values = [to_physical(x, known) for x in self.bound.values[ps.name]]
            return self.value(var, types, known).isin(values) if values else F.lit(False)
        a, b = self.value(c.left, types, known), self.value(c.right, types, known)
        return {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[c.op]()

    # Rules

    def _order(self, atoms, types):
        """Most constants first, then connected atoms, those whose key is bound before others; products last."""
        left, out, have = list(atoms), [], set()

        def names(a):
            return {t.name for _, t in a.bindings if isinstance(t, Var)}

        def rank(a):
            constants = sum(not isinstance(t, Var) for _, t in a.bindings)
            keyed = self.schema.has(a.source) and any({f for f, t in a.bindings if not isinstance(t, Var) or t.name in have} >= set(k.fields) for k in self.schema.keys(a.source))
            return (bool(out) and not names(a) & have, not keyed if out else False, -constants, self.counts.get(a.source, 1 << 60), atoms.index(a))

        while left:
            a = min(left, key=rank)
            left.remove(a)
            out.append(a)
            have |= names(a)
        return out

    def _sides(self, conds, members, have, own, left, right, origins) -> tuple[Side, Side] | None:
        """Spans of both sides that the conditions want to share a point, if there are any."""

        def side(v, t, closed=False):
            if not isinstance(t, Interval):
                return Side(F.col(f"v_{v}"), F.col(f"v_{v}"), origins[f"v_{v}"])
            return span(f"v_{v}_s", f"v_{v}_e", closed)

        def span(s, e, closed=False):
            return Side(F.col(s), F.col(e) if closed else F.col(e) - 1, origins[s])

        new = own - have
        for v, s, e in members:
            if v in have and s in right.columns:
                return side(v, None), span(s, e)
            if v in new and s in left.columns:
                return span(s, e), side(v, None)
        for c, types in conds:
            if isinstance(c, Allen) and not c.mask & (BEFORE | AFTER):
                pair, closed = (c.left, c.right), bool(c.mask & (MEETS | MET_BY))
                any_of = terms(c.mask)[1]
                if len(any_of) == 1 and any(t[1] == "=" for t in any_of[0]):
                    continue  # an equi-join already
            elif isinstance(c, PointIn):
                pair, closed = (c.interval, c.point), False
            else:
                continue
            if all(isinstance(x, Var) for x in pair):
                a, b = sorted((x.name for x in pair), key=lambda v: v in new)
                if a in have and b in new:
                    return side(a, types[a], closed), side(b, types[b], closed)
        return None

    def _without_hits(self, df, frame, members, types, origins) -> DataFrame:
        """Rows of which no span of ``frame`` holds the point; no other column is shared."""
        v, s, e = members[0]
        points = df.select(f"v_{v}").distinct()
        on = point_in(F.col(f"v_{v}"), F.col(s), F.col(e))
        hits = overlap_join(points, frame, Side(F.col(f"v_{v}"), F.col(f"v_{v}"), origins[f"v_{v}"]), Side(F.col(s), F.col(e) - 1, frame), on)
        hits = hits.select(F.col(f"v_{v}").alias("hit_")).distinct()
        return df.join(hits, F.col(f"v_{v}") == F.col("hit_"), "left_anti")

    def bindings(self, r: TypedRule) -> DataFrame | None:
        """One row a binding of the rule's variables, without repeats; None for a rule that can't hold."""
        o = self.options
        if o.fold_ranges and dead_by_ranges(r):
            self.applied.append("dead rule")
            return None
        sets: list[InSet] = []
        keep = set(r.types) if any(isinstance(f, Agg) for f in r.rule.finds) else set()
        if o.fold_closed:
            r, sets = fold_closed(r, self.schema, self.applied)
        if o.drop_references and self.admitted:
            r = drop_references(r, self.schema, self.applied)
        types, rule = r.types, r.rule
        heads = {(f.over if isinstance(f, Agg) else f) for f in rule.finds} - {None}
        needed = {x.name if isinstance(x, Var) else x.var for x in heads} | keep
        conds = [(condition_vars(c), c) for c in conjuncts(rule) if not has_measure(c)] + [({s.var}, s) for s in sets]
        late = [c for c in conjuncts(rule) if has_measure(c)]
        for c in late:
            needed |= condition_vars(c)
        for a in rule.negated:
            needed |= {t.name for _, t in a.bindings if isinstance(t, Var)}
        atoms = self._order(list(rule.atoms), types)
        df, have, waiting = None, set(), []
        origins: dict[str, DataFrame] = {}
        proven = o.skip_distinct and distinct_proven(r, self.schema, self.loose, self.admitted)
        early = None if proven else self._early(r, atoms, sets)
        whole = o.skip_distinct and not proven and early is None and self._whole(r)
        single = False  # whether the bindings so far hold nothing twice, since a join by buckets
        loose = {a for a, one in self._alone(r, atoms) if not distinct_proven(one, self.schema, self.loose, self.admitted)} if whole else set()
        for n, a in enumerate(atoms):
            frame, own, members = self.atom(a, types)
            members = [(v, f"k{n}_{s}", f"k{n}_{e}") for v, s, e in members]
            frame = frame.select(*(F.col(c).alias(f"k{n}_{c}") if c.startswith("m_") else F.col(c) for c in frame.columns))
            origins = {c: frame for c in frame.columns} | origins
            if not a.bindings or not own and not members:
                frame = frame.limit(1).select(F.lit(1).alias(f"gate_{n}"))
                df = frame if df is None else df.join(F.broadcast(frame), F.lit(True), "left_semi")
                self.step(f"gate {a.source}", df)
                continue
            new = set(own) - have
            waiting += members
            ready_m = [m for m in waiting if m[0] in have | set(own)]
            waiting = [m for m in waiting if m not in ready_m]
            ready = [c for vs, c in conds if vs <= have | set(own)]
            conds = [(vs, c) for vs, c in conds if not vs <= have | set(own)]
            extra = [self.condition(c, types) for c in ready] + [point_in(F.col(f"v_{v}"), F.col(s), F.col(e)) for v, s, e in ready_m]
            if df is None:
                df = reduce(lambda d, c: d.where(c), extra, frame)
                df = df.distinct() if a is early else df
                have |= set(own)
                self.step(f"read {a.source}", df)
                continue
            later = needed | {v for vs, _ in conds for v in vs} | {v for v, _, _ in waiting} | {t.name for x in atoms[n + 1 :] for _, t in x.bindings if isinstance(t, Var)}
            semi = o.semi_joins and not new & later and all(m in ready_m for m in members)
            shared = [c for v in own if v in have for c in columns_of(v, types[v])]
            right = frame.select(*(F.col(c).alias(f"r_{c}") if c in shared else F.col(c) for c in frame.columns))
            right = right.distinct() if a is early else right
            on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"r_{c}") for c in shared] + extra, F.lit(True))
            keyed = bool(shared) or any(isinstance(c, Compare) and c.op == "==" for c in ready)
            sides = self._sides([(c, types) for c in ready], ready_m, have, set(own), df, right, origins) if o.bucket_spans == "all" or o.bucket_spans == "keyless" and not keyed else None
            if sides and whole and not single:
                single, before = True, [x for x in atoms[:n] if x in loose]
                df = df.distinct() if before else df
                self.applied += [f"distinct before joins {x.source}" for x in before]
            if single and a in loose and (sides or not semi):
                right = right.distinct()
                self.applied.append(f"distinct before joins {a.source}")
            if sides:
                semi = False
                df = overlap_join(df, right, *sides, on)
                self.applied.append(f"buckets {a.source}")
            else:
                df = df.join(right, on, "left_semi" if semi else "inner")
            if semi:
                self.applied.append(f"semi join {a.source}")
            else:
                df = df.drop(*(f"r_{c}" for c in shared))
                have |= set(own)
            df = df.drop(*(c for _, s, e in ready_m for c in (s, e) if c in df.columns))
            self.step(f"{'semi join' if semi else 'join'} {a.source}", df)
        for a in rule.negated:
            frame, own, members = self.atom(a, types)
            if not a.bindings or not own and not members:
                df = df.join(F.broadcast(frame.limit(1)), F.lit(True), "left_anti")
                self.step(f"gate not {a.source}", df)
                continue
            shared = [c for v in own for c in columns_of(v, types[v])]
            if not shared and len(members) == 1 and o.bucket_spans != "off":
                df = self._without_hits(df, frame, members, types, origins)
                self.applied.append(f"buckets not {a.source}")
                self.step(f"without {a.source}", df)
                continue
            right = frame.select(*(F.col(c).alias(f"r_{c}") for c in frame.columns))
            on = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"r_{c}") for c in shared] + [point_in(F.col(f"v_{v}"), F.col(f"r_{s}"), F.col(f"r_{e}")) for v, s, e in members], F.lit(True))
            df = df.join(right, on, "left_anti")
            self.step(f"without {a.source}", df)
        cols = [c for v in types if v in have for c in columns_of(v, types[v])]
        df = df.select(*cols) if cols else df.select(F.lit(1).alias("gate"))
        for c in late:
            pred = self.condition(c, types)
            self.probes.append(df.where(pred.isNull()))
            df = df.where(pred)
        if proven or single:
            self.applied.append("distinct skipped")
            return df
        if early is not None:
            self.applied.append(f"distinct before joins {early.source}")
            return df
        aggregated = any(isinstance(f, Agg) for f in rule.finds)
        return df.distinct() if aggregated else df

    def _alone(self, r: TypedRule, atoms) -> list:
        """Atoms that bind something, each with the rule that has it alone."""
        return [(a, replace(r, rule=replace(r.rule, atoms=(a,)))) for a in atoms if a.bindings]

    def _points(self, r: TypedRule, atoms) -> bool:
        """Whether a point is looked up in an interval that no variable holds."""
        return any(isinstance(t, Var) and not isinstance(r.types[t.name], Interval) and isinstance(self._field(x.source, f)[1], Interval) for x in atoms for f, t in x.bindings)

    def _whole(self, r: TypedRule) -> bool:
        """Whether answers hold all that the atoms bind: joins of frames without repeats then make no repeats, and answers, that may be far more rows, need not be made distinct."""
        return not any(isinstance(f, Agg) for f in r.rule.finds) and set(r.types) <= {f.name for f in r.rule.finds if isinstance(f, Var)} and not self._points(r, r.rule.atoms)

    def _early(self, r: TypedRule, atoms, sets):
        """The atom whose repeats alone can make a fold's bindings repeat, if nothing outside it thins its rows before they are made distinct."""
        if not self.options.skip_distinct or not any(isinstance(f, Agg) for f in r.rule.finds) or r.rule.negated or len(atoms) < 2:
            return None
        open_ = [a for a, one in self._alone(r, atoms) if not distinct_proven(one, self.schema, self.loose, self.admitted)]
        if len(open_) != 1:
            return None
        (a,) = open_
        names = {t.name for _, t in a.bindings if isinstance(t, Var)}
        outside = any(not isinstance(t, Var) for x in atoms if x is not a for _, t in x.bindings)
        filtered = any(not condition_vars(c) <= names for c in conjuncts(r.rule)) or any(s.var not in names for s in sets)
        return None if outside or filtered or self._points(r, atoms) else a

    def may_be_ray(self, t) -> bool:
        return t.width is None

    def probe_measure(self, df: DataFrame, var: str, t) -> None:
        """A measure in a head is demanded of every binding that is left."""
        if self.may_be_ray(t):
            self.probes.append(df.where(F.col(f"v_{var}_e") == lit(ray_end(t), t.element)))
