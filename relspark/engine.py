"""Instances (admitted states) and prepared queries."""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.errors import BindError, ExecutionError, QueryError
from relspark.ir import Query
from relspark.operators.aggregates import evaluate, find_columns
from relspark.operators.reach import MAX_ROUNDS, MAX_TUPLES, fixpoint
from relspark.operators.rules import Bound, RuleCompiler, lit
from relspark.plans.rewrite import Options, collapse
from relspark.plans.validate import TypedQuery, validate
from relspark.schema import Schema
from relspark.sources.scratch import materialize
from relspark.types import Interval, fits, ray_end, spark_type, to_physical


class Frames(dict):
    """DataFrames by name, made when first asked for: a query opens only the tables that it reads."""

    def __getitem__(self, name):
        v = super().__getitem__(name)
        if not isinstance(v, DataFrame):
            v = v()
            self[name] = v
        return v

    def get(self, name, default=None):
        return self[name] if name in self else default

    def copy(self):
        return Frames(self)


class Instance:
    """A state: one DataFrame a relation.

    Relations are sets.  Frames named in ``sets`` (all if None) hold no row
    twice; of others repeats are dropped where they would show, in bindings and
    scans, rather than by a shuffle of every relation that a query reads.
    ``counts`` (optional) helps to order joins.  ``admitted`` says that the
    frames were judged and keep the schema's statements, as a store's do; only
    then do rewrites rely on keys and references.
    """

    def __init__(self, spark: SparkSession, schema: Schema, frames: dict, counts: dict[str, int] | None = None, sets: set[str] | None = frozenset(), generation: int = 0, admitted: bool = False):
        self.spark, self.schema, self.counts, self.generation, self.admitted = spark, schema, counts or {}, generation, admitted
        self.id = uuid.uuid4().hex
        self.loose = set() if sets is None else {r.name for r in schema.relations if not r.closed} - set(sets)
        self.frames = Frames()
        for r in schema.relations:
            if r.closed:
                self.frames[r.name] = lambda r=r: F.broadcast(closed_frame(spark, r))  # at most 256 rows
            elif r.name in frames:
                self.frames[r.name] = lambda r=r: conform(frames[r.name], r)
            else:
                self.frames[r.name] = lambda r=r: spark.createDataFrame([], r.struct())

    def scan(self, name: str) -> DataFrame:
        self.schema[name]
        return self.frames[name].distinct() if name in self.loose else self.frames[name]

    @property
    def facts(self) -> Frames:
        """Every relation as a set."""
        return Frames({r.name: lambda r=r: self.scan(r.name) for r in self.schema.relations})

    def count(self, name: str) -> int:
        return self.scan(name).count()

    def get(self, name: str, /, **key) -> DataFrame:
        """The at most one fact of a declared key."""
        r = self.schema[name]
        if not any(set(k.fields) == set(key) for k in self.schema.keys(name)):
            raise QueryError("NoSuchKey", f"{name}({', '.join(key)})")
        return self._match(r, key).limit(1)

    def contains(self, name: str, /, **fact) -> bool:
        r = self.schema[name]
        if set(fact) != {f.name for f in r.fields}:
            raise QueryError("FactShape", name)
        return not self._match(r, fact).isEmpty()

    def _match(self, r, values) -> DataFrame:
        df = self.frames[r.name]
        for k, v in values.items():
            t = r.field(k).type
            if not fits(v, t):
                raise BindError("ParamTypeMismatch", f"{r.name}.{k}")
            if isinstance(t, Interval):
                df = df.where((F.col(f"{k}_start") == lit(v[0], t.element)) & (F.col(f"{k}_end") == lit(v[1], t.element)))
            else:
                df = df.where(F.col(k) == lit(v, t))
        return df

    def prepare(self, query: Query, options: Options = Options(), max_rounds: int = MAX_ROUNDS, max_tuples: int = MAX_TUPLES) -> Prepared:
        return Prepared(self, validate(self.schema, query), options, max_rounds, max_tuples)

    def run(self, query: Query, names: list[str] | None = None, options: Options = Options(), **params) -> DataFrame:
        return self.prepare(query, options).execute(names=names, **params)


@dataclass(frozen=True)
class Step:
    """What a step made: rows that Catalyst expects (by size, where it keeps no count) and rows that came."""

    unit: str
    step: str
    estimate: int
    rows: int


@dataclass(frozen=True)
class Analysis:
    rewrites: list[str]
    steps: list[Step]
    plan: str

    def __str__(self) -> str:
        return "\n".join([*(f"rewrite: {x}" for x in self.rewrites), *(f"{s.unit}: {s.step}: {s.rows} rows (estimate {s.estimate})" for s in self.steps), self.plan])


def _estimate(df: DataFrame) -> int:
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    if stats.rowCount().isDefined():
        return int(str(stats.rowCount().get()))
    return int(str(stats.sizeInBytes())) // (8 + df._jdf.schema().defaultSize())


class Prepared:
    def __init__(self, instance: Instance, typed: TypedQuery, options: Options, max_rounds: int, max_tuples: int):
        self.instance, self.typed, self.options = instance, typed, options
        self.max_rounds, self.max_tuples = max_rounds, max_tuples
        self.applied: list[str] = []

    @property
    def signature(self) -> list:
        return self.typed.signature

    def bind(self, params: dict) -> Bound:
        want = self.typed.params
        if set(want) != set(params):
            raise BindError("ParamCountMismatch", f"wants {sorted(want)}, has {sorted(params)}")
        for k, (kind, t) in want.items():
            v = params[k]
            if kind == "set":
                if not isinstance(v, (set, frozenset, list)):
                    raise BindError("ParamSetExpected", k)
                if not all(fits(x, t) for x in v):
                    raise BindError("ParamElementTypeMismatch", k)
            elif isinstance(v, (set, frozenset, list)):
                raise BindError("ParamScalarExpected", k)
            elif isinstance(t, Interval) and not isinstance(v, tuple):
                if not fits(v, t.element):
                    raise BindError("ParamTypeMismatch", k)
                if v == ray_end(t):
                    raise BindError("PointParamAtCeiling", k)
            elif not fits(v, Interval(t.element) if isinstance(t, Interval) else t):
                raise BindError("ParamTypeMismatch", k)
        return Bound({k: frozenset(v) if isinstance(v, list) else v for k, v in params.items()})

    def execute(self, instance: Instance | None = None, names: list[str] | None = None, **params) -> DataFrame:
        """The answers, distinct.  ``names`` rename the columns c0, c1, ... (an interval's get ``_start`` and ``_end``)."""
        return self._execute(instance, names, params)[0]

    def analyze(self, instance: Instance | None = None, **params) -> Analysis:
        """Runs the query step by step, one count a step, and tells what the steps made: for study, at several times the cost of the answers."""
        out, rc = self._execute(instance, None, params, steps=True)
        rows = [Step(unit, label, _estimate(df), df.count()) for unit, label, df in rc.steps]
        return Analysis(list(rc.applied), rows, out._jdf.queryExecution().toString())

    def _execute(self, instance, names, params, steps: bool = False) -> tuple[DataFrame, RuleCompiler]:
        at = instance or self.instance
        if at.schema is not self.instance.schema:
            raise BindError("ForeignPreparedQuery")
        t = self.typed
        rc = RuleCompiler(at.schema, at.frames.copy(), t.tables, self.bind(params), self.options, at.counts, at.loose, at.admitted)
        rc.steps = [] if steps else None

        def trim(rules):
            left = collapse(rules) if self.options.collapse_rules else list(rules)
            rc.applied.extend(f"{rc.unit}: rule {k} subsumed" for k, r in enumerate(rules) if not any(r is x for x in left))
            return left

        uses, tuples = self._uses(), 0
        for i in t.query.interiors:
            rc.unit = i.name
            out = evaluate(rc, trim(t.interiors[i.name]), t.tables[i.name])
            if t.rec or uses[i.name] > 1:  # evaluated once, whatever reads it and in whichever round
                out = materialize(out, "interior")
                tuples += out.count() if t.rec else 0
            rc.frames[i.name] = out
        if t.rec:
            rec = t.query.rec
            rc.frames[rec.name] = fixpoint(rc, rec.name, *t.rec, t.tables[rec.name], self.max_rounds, self.max_tuples, tuples)
        rc.unit = "main"
        out = evaluate(rc, trim(t.rules), t.signature)
        self.applied = rc.applied
        # A measure of a ray is an error of the whole query, found before any answer is given out.
        for probe in rc.probes:
            if not probe.isEmpty():
                raise ExecutionError("MeasureOfRay")
        if names:
            out = out.toDF(*(c for n, ty in zip(names, t.signature, strict=True) for c in ([f"{n}_start", f"{n}_end"] if isinstance(ty, Interval) else [n])))
        return out, rc

    def _uses(self) -> Counter:
        """How many atoms read each source."""
        q, out = self.typed.query, Counter()
        arms = [r for i in q.interiors for r in i.rules] + ([*q.rec.base, *q.rec.step] if q.rec else []) + list(q.rules)
        for r in arms:
            out.update(a.source for a in (*r.atoms, *r.negated))
        return out

    def collect(self, **params) -> set[tuple]:
        """Answers as Python tuples, intervals as pairs."""
        from pyspark.errors import ArithmeticException

        df = self.execute(**params)
        try:
            rows = df.collect()
        except ArithmeticException as e:
            raise ExecutionError("Overflow") from e
        out = set()
        for row in rows:
            fact = []
            for i, t in enumerate(self.signature):
                v = [_python(row[c]) for c in find_columns(i, t)]
                fact.append(tuple(v) if len(v) == 2 else v[0])
            out.add(tuple(fact))
        return out

    def explain(self) -> list[str]:
        """Rewrites that the last execution applied."""
        return list(self.applied)


def _python(v):
    from decimal import Decimal

    return int(v) if isinstance(v, Decimal) else bytes(v) if isinstance(v, bytearray) else v


def closed_frame(spark: SparkSession, r) -> DataFrame:
    rows = []
    for row in r.rows:
        flat = []
        for v, f in zip(row, r.fields, strict=True):
            flat += [to_physical(x, f.type.element) for x in v] if isinstance(f.type, Interval) else [to_physical(v, f.type)]
        rows.append(tuple(flat))
    return spark.createDataFrame(rows, r.struct())


def facts_frame(spark: SparkSession, r, facts) -> DataFrame:
    """A frame of Python facts (dicts by field)."""
    rows = []
    for fact in facts:
        if set(fact) != {f.name for f in r.fields}:
            raise QueryError("FactShape", r.name)
        flat = []
        for f in r.fields:
            v = fact[f.name]
            if not fits(v, f.type):
                raise BindError("ParamTypeMismatch", f"{r.name}.{f.name}: {v!r}")
            flat += [to_physical(x, f.type.element) for x in v] if isinstance(f.type, Interval) else [to_physical(v, f.type)]
        rows.append(tuple(flat))
    return spark.createDataFrame(rows, r.struct())


def conform(df: DataFrame, r) -> DataFrame:
    """The relation's columns in its types; a fixed-width interval may come with its start alone."""
    cols = []
    for f in r.fields:
        if isinstance(f.type, Interval):
            kind = spark_type(f.type.element)
            start = F.col(f"{f.name}_start").cast(kind)
            end = F.col(f"{f.name}_end") if f"{f.name}_end" in df.columns else start + F.lit(f.type.width)
            cols += [start.alias(f"{f.name}_start"), end.cast(kind).alias(f"{f.name}_end")]
        else:
            cols.append(F.col(f.name).cast(spark_type(f.type)).alias(f.name))
    return df.select(*cols)


__all__ = ["Analysis", "Frames", "Instance", "Step", "Prepared", "closed_frame", "conform", "facts_frame"]
