"""Heads: projections, folds over distinct bindings, and coalescing of intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.functions.measure import checked_sum, measure
from relspark.ir import Agg, Duration, Var
from relspark.operators.rules import RuleCompiler
from relspark.plans.validate import TypedRule
from relspark.types import I64, Interval, spark_type


def find_columns(i: int, t) -> list[str]:
    return [f"c{i}_start", f"c{i}_end"] if isinstance(t, Interval) else [f"c{i}"]


def head_inputs(rc: RuleCompiler, r: TypedRule, df: DataFrame, signature: list) -> DataFrame:
    """Columns c0.. of the finds; a fold's column holds what it folds."""
    out = []
    for i, f in enumerate(r.rule.finds):
        over = f.over if isinstance(f, Agg) else f
        if over is None:
            continue
        if isinstance(over, Duration):
            t = r.types[over.var]
            rc.probe_measure(df, over.var, t)
            out.append(measure(F.col(f"v_{over.var}_s"), F.col(f"v_{over.var}_e"), t).alias(f"c{i}"))
            continue
        t = r.types[over.name]
        if isinstance(t, Interval):
            out += [F.col(f"v_{over.name}_s").alias(f"c{i}_start"), F.col(f"v_{over.name}_e").alias(f"c{i}_end")]
        else:
            out.append(F.col(f"v_{over.name}").alias(f"c{i}"))
    return df.select(*out) if out else df


def pack(df: DataFrame, keys: list[str], start: str, end: str, pre_width: int | None = None) -> DataFrame:
    """Maximal disjoint segments of each group; adjacent intervals merge.

    ``pre_width``: merge within stretches of that length first, so that a
    group with very many intervals reaches its one window as few segments.
    """

    def islands(d, by):
        w = Window.partitionBy(*by).orderBy(start, end)
        d = d.withColumn("reach_", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        d = d.withColumn("island_", F.sum(F.when(F.col(start) <= F.col("reach_"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.groupBy(*by, "island_").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island_")

    if pre_width:
        df = islands(df.withColumn("stretch_", F.floor(F.col(start) / pre_width)), [*keys, "stretch_"]).drop("stretch_")
    return islands(df, keys)


def evaluate(rc: RuleCompiler, rules: list[TypedRule], signature: list) -> DataFrame:
    """Answers of a union of rules as columns c0, c1, ...

    One rule folds over its bindings; several fold over the union of their
    heads' inputs.  A fold without group over nothing has no answer.
    """
    finds = rules[0].rule.finds
    folds = [(i, f) for i, f in enumerate(finds) if isinstance(f, Agg)]
    parts, proven = [], []
    for r in rules:
        before = len(rc.applied)
        df = rc.bindings(r)
        if df is not None:
            # Lone rules fold over whole bindings; the variables stay apart from the inputs.
            parts.append(head_inputs(rc, r, df, signature))
            rc.step(f"rule {len(parts) - 1}: emitted", parts[-1])
            proven.append("distinct skipped" in rc.applied[before:] and _keeps_all(r))
    group = [c for i, f in enumerate(finds) if not isinstance(f, Agg) for c in find_columns(i, signature[i])]
    if not parts:
        return empty(rc, signature)
    df = reduce(lambda a, b: a.unionByName(b), parts)
    if not folds:
        df = df if proven == [True] else df.distinct()
        rc.step("answers", df)
        return df
    if len(parts) > 1 or len(rules) > 1:
        df = df.distinct()
        rc.step("without repeats", df)
    i, f = folds[0]
    if f.op == "pack":
        out = pack(df.distinct(), group, f"c{i}_start", f"c{i}_end", rc.options.pack_width).select(*(c for k in range(len(finds)) for c in find_columns(k, signature[k])))
        rc.step("answers", out)
        return out
    aggs = []
    for i, f in folds:
        if f.op == "count":
            aggs.append(F.count(F.lit(1)).alias(f"c{i}"))
        elif f.op == "sum":
            signed = isinstance(f.over, Var) and isinstance(rules[0].types[f.over.name], I64)
            aggs.append(checked_sum(F.col(f"c{i}"), signed).cast(spark_type(signature[i])).alias(f"c{i}"))
        else:
            aggs.append((F.min if f.op == "min" else F.max)(f"c{i}").alias(f"c{i}"))
    if group:
        out = df.groupBy(*group).agg(*aggs)
    else:
        out = df.agg(*aggs, F.count(F.lit(1)).alias("rows_")).where("rows_ > 0").drop("rows_")
    out = out.select(*(c for k in range(len(finds)) for c in find_columns(k, signature[k])))
    rc.step("answers", out)
    return out


def _keeps_all(r: TypedRule) -> bool:
    kept = {f.name for f in r.rule.finds if isinstance(f, Var)}
    return set(r.types) <= kept


def empty(rc: RuleCompiler, signature: list) -> DataFrame:
    spark = rc.frames[next(iter(rc.frames))].sparkSession
    cols = ", ".join(f"{c} {(spark_type(t.element if isinstance(t, Interval) else t)).simpleString()}" for i, t in enumerate(signature) for c in find_columns(i, t))
    return spark.createDataFrame([], cols)
