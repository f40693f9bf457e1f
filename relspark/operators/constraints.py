"""Judging constraint statements: complete on a state, or incremental for a change set.

A violation row is (statement, direction, relation, fact): the statement's
position, ``source`` or ``target``, and the offending fact as JSON.  The result
is complete.  Key violations preempt the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.errors import ExecutionError
from relspark.functions.measure import WIDE, measure
from relspark.operators.aggregates import pack
from relspark.operators.rules import lit
from relspark.sources.scratch import materialize
from relspark.schema import Capacity, Contained, Key, Relation, Schema, Side
from relspark.types import Interval, ray_end, spark_type, to_physical

COLUMNS = ["statement", "direction", "relation", "fact"]


def select_side(df: DataFrame, r: Relation, sd: Side) -> DataFrame:
    """The rows of the side's selection."""
    for k, v in sd.where:
        t = r.field(k).type
        if isinstance(v, frozenset):
            if isinstance(t, Interval):
                df = df.where(reduce(lambda a, b: a | b, [(F.col(f"{k}_start") == lit(x[0], t.element)) & (F.col(f"{k}_end") == lit(x[1], t.element)) for x in sorted(v)]))
            else:
                df = df.where(F.col(k).isin([to_physical(x, t) for x in v]))
        elif isinstance(t, Interval):
            df = df.where((F.col(f"{k}_start") == lit(v[0], t.element)) & (F.col(f"{k}_end") == lit(v[1], t.element)))
        else:
            df = df.where(F.col(k) == lit(v, t))
    return df


def split_interval(r: Relation, fields) -> tuple[list[str], str | None]:
    """Scalar fields and the interval field, if any."""
    spans = [f for f in fields if isinstance(r.field(f).type, Interval)]
    return [f for f in fields if f not in spans], (spans[0] if spans else None)


def _row(df: DataFrame, r: Relation, statement: int, direction: str) -> DataFrame:
    return df.select(F.lit(statement).alias("statement"), F.lit(direction).alias("direction"), F.lit(r.name).alias("relation"), F.to_json(F.struct(*(_shown(c, df) for c in r.columns()))).alias("fact"))


def _shown(c: str, df: DataFrame) -> Column:
    kind = df.schema[c].dataType.typeName()
    return (F.hex(c) if kind == "binary" else F.col(c).cast("string") if kind == "decimal" else F.col(c)).alias(c)


def key_offenders(df: DataFrame, r: Relation, key: Key, loose: bool = False) -> DataFrame:
    """Facts that share a key; with an interval, facts that overlap another of their group.

    The whole facts are compared through running maxima, so every fact of an
    overlap is listed, not only neighbours.  A ``loose`` frame may hold a fact
    twice: rows are counted by key first, and only those of repeated keys are
    made distinct, so a valid relation is shuffled by its keys alone.
    """
    scalars, span = split_interval(r, key.fields)

    def sharing(d):
        twice = d.groupBy(*scalars).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
        return d.join(twice, scalars, "left_semi")

    if span is None:
        return sharing(sharing(df).distinct()) if loose else sharing(df)
    df = df.distinct() if loose else df
    s, e = f"{span}_start", f"{span}_end"
    w = Window.partitionBy(*scalars).orderBy(s, e)
    back = Window.partitionBy(*scalars).orderBy(F.col(s).desc(), F.col(e).desc())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("reach_", F.max(e).over(before)).withColumn("next_", F.min(s).over(after))
    return out.where((F.col("reach_") > F.col(s)) | (F.col("next_") < F.col(e))).drop("reach_", "next_")


def uncovered(source: DataFrame, sr: Relation, target: DataFrame, tr: Relation, st: Contained) -> DataFrame:
    """Source facts without a target; an interval must be covered by the union of the target's."""
    s_scalar, s_span = split_interval(sr, st.source.fields)
    t_scalar, t_span = split_interval(tr, st.target.fields)
    if s_span is None:
        right = target.select(*(F.col(t).alias(f"t_{i}") for i, t in enumerate(t_scalar))).distinct()
        on = reduce(lambda a, b: a & b, [F.col(s) == F.col(f"t_{i}") for i, s in enumerate(s_scalar)])
        return source.join(right, on, "left_anti")
    cols = [F.col(t).alias(f"t_{i}") for i, t in enumerate(t_scalar)]
    right = pack(target.select(*cols, F.col(f"{t_span}_start").alias("t_start"), F.col(f"{t_span}_end").alias("t_end")).distinct(), [f"t_{i}" for i in range(len(t_scalar))], "t_start", "t_end")
    on = reduce(lambda a, b: a & b, [F.col(s) == F.col(f"t_{i}") for i, s in enumerate(s_scalar)] + [F.col("t_start") <= F.col(f"{s_span}_start"), F.col(f"{s_span}_end") <= F.col("t_end")])
    return source.join(right, on, "left_anti")


def _weight(r: Relation, st: Capacity) -> Column:
    if st.weight is None:
        return F.lit(1).cast(WIDE)
    if isinstance(st.weight, tuple):
        f = st.weight[1]
        return measure(F.col(f"{f}_start"), F.col(f"{f}_end"), r.field(f).type)
    return F.col(st.weight).cast(WIDE)


def overfull(target: DataFrame, tr: Relation, source: DataFrame, sr: Relation, st: Capacity) -> DataFrame:
    """Target facts whose sources weigh less than lo or more than hi; facts without sources weigh 0."""
    names = [f"t_{i}" for i in range(len(st.source.fields))]
    sums = source.select(*(F.col(f).alias(n) for f, n in zip(st.source.fields, names, strict=True)), _weight(sr, st).alias("w_")).groupBy(*names).agg(F.sum("w_").alias("w_"))
    on = reduce(lambda a, b: a & b, [F.col(f) == F.col(n) for f, n in zip(st.target.fields, names, strict=True)])
    out = target.join(sums, on, "left").withColumn("w_", F.coalesce("w_", F.lit(0)))
    bad = F.col("w_") < F.lit(st.lo)
    if isinstance(st.hi, tuple):
        f = st.hi[1]
        bad = bad | (F.col("w_") > measure(F.col(f"{f}_start"), F.col(f"{f}_end"), tr.field(f).type))
    elif isinstance(st.hi, str):
        bad = bad | (F.col("w_") > F.col(st.hi))
    elif st.hi is not None:
        bad = bad | (F.col("w_") > F.lit(st.hi))
    return out.where(bad).drop("w_", *names)


def refuse_ray_weights(frames: dict[str, DataFrame], schema: Schema) -> None:
    """A length that weighs must be finite, whatever its parent."""
    for st in schema.statements:
        if isinstance(st, Capacity) and isinstance(st.weight, tuple):
            r = schema[st.source.relation]
            t = r.field(st.weight[1]).type
            rows = select_side(frames[r.name], r, st.source)
            if t.width is None and not rows.where(F.col(f"{st.weight[1]}_end") == lit(ray_end(t), t.element)).isEmpty():
                raise ExecutionError("CapacityRayMeasure", r.name)


def violations(frames: dict[str, DataFrame], schema: Schema, keys_first: bool = True, loose: set[str] = frozenset()) -> DataFrame:
    """All violations of a state, sorted by nothing; an empty DataFrame accepts it.

    Frames of ``loose`` relations may hold a fact twice: where repeats don't
    show in the verdict, only the offenders are made distinct.
    """

    def once(df, name):
        return df.distinct() if name in loose else df

    keys = [_row(key_offenders(frames[st.relation], schema[st.relation], st, st.relation in loose), schema[st.relation], i, "source") for i, st in enumerate(schema.statements) if isinstance(st, Key) and not schema[st.relation].closed]
    if keys_first:
        found = materialize(_union(keys, frames), "key-violations")  # found once, not once to see whether there are any and once more
        if not found.isEmpty():
            return found
    refuse_ray_weights(frames, schema)
    rest = []
    for i, st in enumerate(schema.statements):
        if isinstance(st, Contained):
            sr, tr = schema[st.source.relation], schema[st.target.relation]
            rest.append(_row(once(uncovered(select_side(frames[sr.name], sr, st.source), sr, select_side(frames[tr.name], tr, st.target), tr, st), sr.name), sr, i, "source"))
        elif isinstance(st, Capacity):
            sr, tr = schema[st.source.relation], schema[st.target.relation]
            rest.append(_row(once(overfull(select_side(frames[tr.name], tr, st.target), tr, once(select_side(frames[sr.name], sr, st.source), sr.name), sr, st), tr.name), tr, i, "target"))
    return _union(rest if keys_first else keys + rest, frames)


def _union(parts: list[DataFrame], frames) -> DataFrame:
    if parts:
        return reduce(lambda a, b: a.unionByName(b), parts)
    spark = frames[next(iter(frames))].sparkSession
    return spark.createDataFrame([], "statement int, direction string, relation string, fact string")


def _touched(df: DataFrame, fields, changed: DataFrame, changed_fields) -> DataFrame:
    """Rows of ``df`` whose ``fields`` meet those of a changed fact."""
    right = changed.select(*(F.col(c).alias(f"d_{i}") for i, c in enumerate(changed_fields))).distinct()
    if not fields:
        return df
    return df.join(right, reduce(lambda a, b: a & b, [F.col(f) == F.col(f"d_{i}") for i, f in enumerate(fields)]), "left_semi")


def change_violations(base: dict[str, DataFrame], inserts: dict[str, DataFrame], deletes: dict[str, DataFrame], schema: Schema) -> DataFrame:
    """Violations of ``(base - deletes) + inserts`` where ``base`` has none.

    Only groups that the change touches are looked at: keys of inserted facts;
    containments of inserted sources (direction source) and of surviving sources
    whose target went (direction target); capacities of parents that changed or
    whose children did.
    """
    final = apply_change(base, inserts, deletes, schema)

    def rows(d, name):
        return d.get(name) if d.get(name) is not None else base[name].limit(0)

    keys = []
    for i, st in enumerate(schema.statements):
        if isinstance(st, Key) and not schema[st.relation].closed and st.relation in inserts:
            r = schema[st.relation]
            scalars, _ = split_interval(r, st.fields)
            keys.append(_row(key_offenders(_touched(final[r.name], scalars, inserts[r.name], scalars), r, st), r, i, "source"))
    if keys:
        found = materialize(_union(keys, final), "key-violations")
        if not found.isEmpty():
            return found
    refuse_ray_weights(final, schema)
    rest = []
    for i, st in enumerate(schema.statements):
        if isinstance(st, Key):
            continue
        sr, tr = schema[st.source.relation], schema[st.target.relation]
        source, target = select_side(final[sr.name], sr, st.source), select_side(final[tr.name], tr, st.target)
        if isinstance(st, Contained):
            if sr.name in inserts:
                new = select_side(inserts[sr.name], sr, st.source)
                rest.append(_row(uncovered(new, sr, target, tr, st), sr, i, "source"))
            if tr.name in deletes:
                s_scalar, _ = split_interval(sr, st.source.fields)
                t_scalar, _ = split_interval(tr, st.target.fields)
                gone = select_side(deletes[tr.name], tr, st.target)
                old = source.join(rows(inserts, sr.name), sr.columns(), "left_anti") if sr.name in inserts else source
                rest.append(_row(uncovered(_touched(old, s_scalar, gone, t_scalar), sr, target, tr, st), sr, i, "target"))
        else:
            parts = [_touched(target, st.target.fields, select_side(d[sr.name], sr, st.source), st.source.fields) for d in (inserts, deletes) if sr.name in d]
            if tr.name in inserts:
                parts.append(select_side(inserts[tr.name], tr, st.target))
            if parts:
                judged = reduce(lambda a, b: a.unionByName(b), parts).distinct()
                rest.append(_row(overfull(judged, tr, source, sr, st), tr, i, "target"))
    return _union(rest, final)


def apply_change(base: dict[str, DataFrame], inserts: dict[str, DataFrame], deletes: dict[str, DataFrame], schema: Schema) -> dict[str, DataFrame]:
    """The final state; a fact that is deleted and inserted stays."""
    out = base.copy()
    for r in schema.relations:
        if r.name not in deletes and r.name not in inserts:
            continue
        df = base[r.name]
        if r.name in deletes:
            df = df.join(deletes[r.name], r.columns(), "left_anti")
        if r.name in inserts:
            df = df.unionByName(inserts[r.name]).distinct()
        out[r.name] = df
    return out


__all__ = ["COLUMNS", "apply_change", "change_violations", "key_offenders", "overfull", "spark_type", "uncovered", "violations"]
