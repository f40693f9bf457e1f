import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relspark.builder import Not, P, S, V, all_of, allen, any_of, atom, count, duration, eq, ge, gt, le, lt, max_, min_, ne, pack, point_in, query, rule, sum_
from relspark.engine import Instance, facts_frame
from relspark.errors import BindError, ExecutionError, QueryError
from relspark.functions.allen import BASICS, BIT, FULL, classify, converse, terms
from relspark.ir import Agg, Allen, Atom, Compare, Duration, Lit, Query, Rule, Var
from relspark.operators.overlap import Side, overlap_join
from relspark.plans.parse import parse
from relspark.plans.render import render
from relspark.plans.rewrite import Options
from relspark.schema import Contained, Key, Schema, closed, relation, side
from relspark.types import I64, U64, Bool, Interval, Str
from tests import naive

RAY = 2**63 - 1
SCHEMA = Schema(
    (
        relation("A", id=I64(), grp=I64(), name=Str(), flag=Bool(), kind=U64()),
        relation("B", a=I64(), val=I64()),
        relation("Sp", grp=I64(), during=Interval(I64())),
        relation("E", src=I64(), dst=I64()),
        closed("Kind", {"low": (1, False), "mid": (5, True), "top": (9, True)}, weight=I64(), hot=Bool()),
    ),
    (Key("A", ("id",)), Contained(side("B", "a"), side("A", "id")), Contained(side("A", "kind"), side("Kind", "id"))),
)


def world(seed, rays=True):
    r = random.Random(seed)
    a = [{"id": i, "grp": r.randrange(4), "name": r.choice("xyz"), "flag": r.random() < 0.5, "kind": r.randrange(3)} for i in range(12)]
    b = [{"a": r.randrange(12), "val": r.randrange(-5, 6)} for _ in range(18)]
    spans = []
    for _ in range(14):
        s = r.randrange(0, 12)
        spans.append({"grp": r.randrange(4), "during": (s, RAY if rays and r.random() < 0.1 else s + r.randrange(1, 6))})
    e = [{"src": r.randrange(7), "dst": r.randrange(7)} for _ in range(9)]
    kind = [{"id": i, "weight": w, "hot": h} for i, (w, h) in enumerate(((1, False), (5, True), (9, True)))]
    uniq = lambda xs: [dict(t) for t in {tuple(sorted(x.items())) for x in xs}]
    return {"A": uniq(a), "B": uniq(b), "Sp": uniq(spans), "E": uniq(e), "Kind": kind}


@pytest.fixture(scope="module")
def worlds(spark):
    made = {}

    def get(seed, rays=True):
        if (seed, rays) not in made:
            state = world(seed, rays)
            made[seed, rays] = state, Instance(spark, SCHEMA, {k: facts_frame(spark, SCHEMA[k], v).cache() for k, v in state.items() if k != "Kind"}, admitted=True)
        return made[seed, rays]

    return get


CASES = {
    "selection": query(rule([V.i, V.n], atom("A", id=V.i, name=V.n, grp=2))),
    "join": query(rule([V.i, V.v], atom("A", id=V.i, flag=True), atom("B", a=V.i, val=V.v), gt(V.v, 0))),
    "self_join": query(rule([V.i, V.j], atom("A", id=V.i, grp=V.g), atom("A", id=V.j, grp=V.g), lt(V.i, V.j))),
    "triangle": query(rule([V.x, V.y, V.z], atom("E", src=V.x, dst=V.y), atom("E", src=V.y, dst=V.z), atom("E", src=V.z, dst=V.x))),
    "repeated": query(rule([V.x], atom("E", src=V.x, dst=V.x))),
    "negation": query(rule([V.i], atom("A", id=V.i), Not(atom("B", a=V.i)))),
    "negated_point": query(rule([V.g, V.v], atom("A", id=V.i, grp=V.g), atom("B", a=V.i, val=V.v), Not(atom("Sp", grp=V.g, during=V.v)))),
    "tree": query(rule([V.i], atom("A", id=V.i, flag=V.f, name=V.n, grp=V.g), any_of(all_of(eq(V.f, True), ne(V.n, "x")), all_of(ge(V.g, 2), le(V.i, 6))))),
    "bool_order": query(rule([V.i], atom("A", id=V.i, flag=V.f), lt(V.f, True))),
    "membership": query(rule([V.g, V.v], atom("Sp", grp=V.g, during=V.v), atom("B", val=V.v))),
    "point_in": query(rule([V.g, V.d], atom("Sp", grp=V.g, during=V.d), point_in(V.d, 4))),
    "allen_join": query(rule([V.g, V.a, V.b], atom("Sp", grp=V.g, during=V.a), atom("Sp", grp=V.g, during=V.b), allen("intersects", V.a, V.b), ne(V.a, V.b))),
    "allen_mixed": query(rule([V.a, V.b], atom("Sp", grp=V.g, during=V.a), atom("Sp", grp=V.g, during=V.b), allen("meets|starts|contains", V.a, V.b))),
    "keyless_overlap": query(rule([V.a, V.b], atom("Sp", grp=1, during=V.a), atom("Sp", grp=2, during=V.b), allen("intersects", V.a, V.b))),
    "keyless_touch": query(rule([V.g, V.h, V.a], atom("Sp", grp=V.g, during=V.a), atom("Sp", grp=V.h, during=V.b), allen("meets|overlaps|during", V.a, V.b))),
    "keyless_membership": query(rule([V.i, V.v], atom("B", a=V.i, val=V.v), atom("Sp", during=V.v))),
    "keyless_membership_count": query(rule([V.v, count()], atom("B", a=V.i, val=V.v), atom("Sp", grp=V.g, during=V.v))),
    "keyless_point_in": query(rule([V.g, V.d, V.v], atom("Sp", grp=V.g, during=V.d), atom("B", val=V.v), point_in(V.d, V.v))),
    "keyless_not_covered": query(rule([V.v], atom("B", val=V.v), Not(atom("Sp", during=V.v)))),
    "span_equal": query(rule([V.g, V.h], atom("Sp", grp=V.g, during=V.d), atom("Sp", grp=V.h, during=V.d), lt(V.g, V.h))),
    "count": query(rule([V.g, count()], atom("A", id=V.i, grp=V.g))),
    "sum_domain": query(rule([V.g, sum_(V.v)], atom("A", id=V.i, grp=V.g), atom("B", a=V.i, val=V.v))),
    "sum_without_id": query(rule([sum_(V.v), count()], atom("B", val=V.v))),
    "min_max_bool": query(rule([V.g, min_(V.f), max_(V.f)], atom("A", grp=V.g, flag=V.f))),
    "global_empty": query(rule([sum_(V.v), count()], atom("B", val=V.v), gt(V.v, 100))),
    "two_rules_fold": query(rule([V.g, sum_(V.v)], atom("A", id=V.i, grp=V.g, flag=True), atom("B", a=V.i, val=V.v)), rule([V.g, sum_(V.v)], atom("A", id=V.i, grp=V.g, name="x"), atom("B", a=V.i, val=V.v))),
    "or_fold": query(rule([V.g, sum_(V.v)], atom("A", id=V.i, grp=V.g, flag=V.f, name=V.n), atom("B", a=V.i, val=V.v), any_of(eq(V.f, True), eq(V.n, "x")))),
    "union": query(rule([V.i], atom("A", id=V.i, flag=True)), rule([V.i], atom("B", a=V.i, val=V.v), gt(V.v, 2))),
    "pack": query(rule([V.g, pack(V.d)], atom("Sp", grp=V.g, during=V.d))),
    "pack_all": query(rule([pack(V.d)], atom("Sp", during=V.d))),
    "closed": query(rule([V.i], atom("A", id=V.i, kind=V.k), atom("Kind", id=V.k, hot=True))),
    "closed_payload": query(rule([V.i, V.w], atom("A", id=V.i, kind=V.k), atom("Kind", id=V.k, weight=V.w))),
    "closed_negated": query(rule([V.i], atom("A", id=V.i, kind=V.k), Not(atom("Kind", id=V.k, hot=True)))),
    "closed_alone": query(rule([V.k], atom("Kind", id=V.k, hot=True))),
    "reference": query(rule([V.b, V.v], atom("B", a=V.b, val=V.v), atom("A", id=V.b))),
    "gate": query(rule([V.i], atom("A", id=V.i), atom("B", val=5))),
    "negated_gate": query(rule([V.i], atom("A", id=V.i), Not(atom("B", val=5)))),
    "product": query(rule([V.n, V.x], atom("A", name=V.n), atom("E", src=V.x))),
    "dead": query(rule([V.i], atom("A", id=V.i, grp=V.g), lt(V.g, 1), gt(V.g, 2))),
    "subsumed": query(rule([V.i], atom("A", id=V.i)), rule([V.i], atom("A", id=V.i), atom("B", a=V.i))),
}


@pytest.mark.parametrize("name", CASES)
def test_against_model(worlds, name):
    state, at = worlds(3)
    q = CASES[name]
    assert at.prepare(q).collect() == naive.answers(q.rules, state)


ALL_OFF = Options(False, False, False, False, False, False, bucket_spans="off")


@pytest.mark.parametrize("name", [n for n, q in CASES.items() if "during" in repr(q)])
def test_spans_by_buckets(worlds, name):
    state, at = worlds(5)
    q = CASES[name]
    want = naive.answers(q.rules, state)
    for how in ("keyless", "all", "off"):
        p = at.prepare(q, Options(bucket_spans=how))
        assert p.collect() == want
        assert any(x.startswith("buckets") for x in p.explain()) == (how != "off" and ("keyless" in name or name == "membership") or how == "all" and name in ("allen_join", "allen_mixed"))


@pytest.mark.parametrize("kind", ["long", "decimal(20,0)"])
def test_overlap_join(spark, kind):
    """Bags against all pairs: lengths of one to a whole domain, ties, repeats, negative starts, an empty side."""
    r = random.Random(11)
    low, top = (-(2**63), RAY) if kind == "long" else (0, 2**64 - 1)

    def spans(n):
        out = [(low, top), (top - 1, top), (low, low + 1), (5, 6), (5, 6), (4, 8), (0, top)]
        for _ in range(n):
            s = r.choice([r.randrange(0, 60), r.randrange(0, 10**6), max(low, -r.randrange(1, 10**4)), r.randrange(0, 2**62)])
            out.append((s, min(top, s + r.choice([1, 1, 4, 16, 17, r.randrange(1, 10**5), 2**r.randrange(1, 62)]))))
        return out

    xs, ys = spans(120), spans(150)
    frame = lambda rows, a, b: spark.createDataFrame([(str(s), str(e)) for s, e in rows], "s string, e string").selectExpr(f"cast(s as {kind}) {a}", f"cast(e as {kind}) {b}")
    x, y = frame(xs, "s", "e"), frame(ys, "S_", "E_")
    on = (F.col("s") < F.col("E_")) & (F.col("S_") < F.col("e"))
    sides = Side(F.col("s"), F.col("e") - 1, x), Side(F.col("S_"), F.col("E_") - 1, y)
    got = Counter(tuple(map(int, row)) for row in overlap_join(x, y, *sides, on).collect())
    assert got == Counter((s, e, S, E) for s, e in xs for S, E in ys if s < E and S < e)
    none = y.where("false")
    assert overlap_join(x, none, sides[0], Side(F.col("S_"), F.col("E_") - 1, none), on).isEmpty()


def test_repeats_go_before_joins(spark):
    """A fold over a relation whose frame holds rows twice; its repeats alone are dropped, before the join."""
    rows = [{"a": i % 5, "val": i % 3} for i in range(60)]
    a = [{"id": i, "grp": i % 2, "name": "x", "flag": True, "kind": 0} for i in range(5)]
    at = Instance(spark, SCHEMA, {"A": facts_frame(spark, SCHEMA["A"], a), "B": facts_frame(spark, SCHEMA["B"], rows)}, sets={"A"}, admitted=True)
    state = {"A": a, "B": [dict(t) for t in {tuple(sorted(x.items())) for x in rows}]}
    q = query(rule([V.g, sum_(V.v), count()], atom("A", id=V.i, grp=V.g), atom("B", a=V.i, val=V.v)))
    p = at.prepare(q)
    assert p.collect() == naive.answers(q.rules, state)
    assert "distinct before joins B" in p.explain()
    q = query(rule([V.g, sum_(V.v)], atom("A", id=V.i, grp=V.g, name="x"), atom("B", a=V.i, val=V.v)))
    p = at.prepare(q)
    assert p.collect() == naive.answers(q.rules, state) and "distinct before joins B" not in p.explain()


PAIRS = {
    "pairs": CASES["keyless_overlap"],
    "key_after": query(rule([V.g, V.a, V.h, V.b, V.v], atom("Sp", grp=V.g, during=V.a), atom("Sp", grp=V.h, during=V.b), atom("B", a=V.h, val=V.v), allen("intersects", V.a, V.b))),
    "key_before": query(rule([V.g, V.a, V.v, V.h, V.b], atom("Sp", grp=V.g, during=V.a), atom("B", a=V.g, val=V.v), atom("Sp", grp=V.h, during=V.b), allen("intersects", V.a, V.b), Not(atom("E", src=V.v)))),
    "gate": query(rule([V.a, V.b], atom("E", src=1), atom("Sp", grp=1, during=V.a), atom("Sp", grp=2, during=V.b), allen("intersects", V.a, V.b), Not(atom("E", src=99)))),
    "point": query(rule([V.g, V.a, V.i, V.v], atom("Sp", grp=V.g, during=V.a), atom("B", a=V.i, val=V.v), point_in(V.a, V.v))),
    "narrow": query(rule([V.a], atom("Sp", grp=1, during=V.a), atom("Sp", grp=2, during=V.b), allen("intersects", V.a, V.b))),
    "membership": query(rule([V.i, V.v], atom("B", a=V.i, val=V.v), atom("Sp", during=V.v))),
}


@pytest.mark.parametrize("name", PAIRS)
def test_repeats_go_before_joins_by_buckets(spark, name):
    """Of answers that hold all that is bound, the sides are made distinct rather than the pairs; of others still the answers."""
    state, q = world(5), PAIRS[name]
    at = Instance(spark, SCHEMA, {k: facts_frame(spark, SCHEMA[k], v * 3) for k, v in state.items() if k != "Kind"}, sets=set())
    p = at.prepare(q)
    want, df = naive.answers(q.rules, state), p.execute()
    assert p.collect() == want and df.count() == len(want) > 0
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.index("Join") < plan.index("Aggregate")) == ("distinct skipped" in p.explain()) == (name not in ("narrow", "membership"))


@pytest.mark.parametrize("name", ["closed", "closed_negated", "reference", "dead", "subsumed", "join", "self_join", "union"])
def test_rewrites_off(worlds, name):
    state, at = worlds(4)
    q = CASES[name]
    on, off = at.prepare(q), at.prepare(q, ALL_OFF)
    assert on.collect() == off.collect() == naive.answers(q.rules, state)


def test_rewrites_apply(worlds):
    _, at = worlds(4)
    p = at.prepare(CASES["reference"])
    p.execute()
    assert "drop A" in p.explain()
    p = at.prepare(CASES["closed"])
    p.execute()
    assert "fold Kind" in p.explain()


def test_unjudged_state_is_not_trusted(spark):
    """A frame that breaks a key and a reference: no rewrite may rely on either."""
    a = [{"id": 1, "grp": g, "name": "x", "flag": True, "kind": 0} for g in (1, 2)]
    b = [{"a": 1, "val": 3}, {"a": 7, "val": 4}]
    at = Instance(spark, SCHEMA, {"A": facts_frame(spark, SCHEMA["A"], a), "B": facts_frame(spark, SCHEMA["B"], b)}, sets=None)
    state = {"A": a, "B": b}
    for q in (CASES["reference"], query(rule([V.n, sum_(V.i), count()], atom("A", id=V.i, name=V.n))), query(rule([V.i, V.n], atom("A", id=V.i, name=V.n)))):
        rows = at.run(q).collect()
        assert len(rows) == len(set(rows)) and at.prepare(q).collect() == naive.answers(q.rules, state)


def test_analysis(worlds):
    """Rows of every step, by unit and round; rewrites, subsumed rules and the plan."""
    state, at = worlds(3)
    found = at.prepare(CASES["join"]).analyze()
    assert [s.unit for s in found.steps] == ["main"] * len(found.steps) and found.steps[-1].step == "answers"
    assert found.steps[-1].rows == len(naive.answers(CASES["join"].rules, state)) and all(s.estimate >= 0 for s in found.steps)
    assert "Physical Plan" in found.plan and "main: read" in str(found)
    found = at.prepare(CASES["union"]).analyze()
    emitted = [s.rows for s in found.steps if "emitted" in s.step]
    assert emitted == [len(naive.answers([r], state)) if k == 0 else emitted[k] for k, r in enumerate(CASES["union"].rules)] and found.steps[-1].rows == len(naive.answers(CASES["union"].rules, state)) <= sum(emitted)
    assert "main: rule 1 subsumed" in at.prepare(CASES["subsumed"]).analyze().rewrites
    state, at = worlds(6)
    found = at.prepare(query(rule([V.a, V.b], atom("R", V.a, V.b)), rec=REACH)).analyze()
    rounds = [s for s in found.steps if s.unit.startswith("R, round") and s.step == "new"]
    base = next(s.rows for s in found.steps if s.unit == "R, round 0" and s.step == "answers")
    assert base + sum(s.rows for s in rounds) == found.steps[-1].rows == len(naive.fixpoint(REACH[0], REACH[1], REACH[2], state))


def test_large_param_set(worlds):
    state, at = worlds(3)
    q = query(rule([V.i, V.v], atom("A", id=S.ids, grp=V.i), atom("B", a=S.ids, val=V.v)))
    for ids in (set(range(3)), set(range(3, 3000))):
        assert at.prepare(q).collect(ids=ids) == naive.answers(q.rules, state, {"ids": ids})


def test_measures(worlds, spark):
    state, at = worlds(5, rays=False)
    for q in (
        query(rule([V.g, V.d], atom("Sp", grp=V.g, during=V.d), gt(duration(V.d), 2))),
        query(rule([V.g, sum_(duration(V.d))], atom("Sp", grp=V.g, during=V.d))),
        query(rule([duration(V.d), count()], atom("Sp", grp=V.g, during=V.d))),
    ):
        assert at.prepare(q).collect() == naive.answers(q.rules, state)
    ray = Instance(spark, SCHEMA, {"Sp": facts_frame(spark, SCHEMA["Sp"], [{"grp": 1, "during": (0, RAY)}, {"grp": 2, "during": (0, 3)}])})
    with pytest.raises(ExecutionError, match="MeasureOfRay"):
        ray.run(query(rule([V.g], atom("Sp", grp=V.g, during=V.d), gt(duration(V.d), 2))))
    with pytest.raises(ExecutionError, match="MeasureOfRay"):
        ray.run(query(rule([V.g, sum_(duration(V.d))], atom("Sp", grp=V.g, during=V.d))))
    # A decided condition needs no measure.
    guarded = query(rule([V.g], atom("Sp", grp=V.g, during=V.d), any_of(eq(V.g, 1), gt(duration(V.d), 2))))
    assert ray.prepare(guarded).collect() == {(1,), (2,)}


def test_pack_in_stretches(worlds):
    state, at = worlds(3)
    for name in ("pack", "pack_all"):
        assert at.prepare(CASES[name], Options(pack_width=4)).collect() == naive.answers(CASES[name].rules, state)


def test_params(worlds):
    state, at = worlds(3)
    q = query(rule([V.i], atom("A", id=V.i, grp=P.g, name=S.ns)))
    assert at.prepare(q).collect(g=1, ns={"x", "y"}) == naive.answers(q.rules, state, {"g": 1, "ns": {"x", "y"}})
    assert at.prepare(q).collect(g=1, ns=set()) == set()
    for params, code in (({"g": 1}, "ParamCountMismatch"), ({"g": "1", "ns": set()}, "ParamTypeMismatch"), ({"g": 1, "ns": "x"}, "ParamSetExpected"), ({"g": {1}, "ns": set()}, "ParamScalarExpected"), ({"g": 1, "ns": {3}}, "ParamElementTypeMismatch")):
        with pytest.raises(BindError, match=code):
            at.run(q, **params)
    spans = query(rule([V.g], atom("Sp", grp=V.g, during=P.at)))
    with pytest.raises(BindError, match="PointParamAtCeiling"):
        at.run(spans, at=RAY)
    assert at.prepare(spans).collect(at=4) == naive.answers(spans.rules, state, {"at": 4})


def test_overflow(spark):
    at = Instance(spark, SCHEMA, {"B": facts_frame(spark, SCHEMA["B"], [{"a": 1, "val": 2**63 - 1}, {"a": 2, "val": 2**63 - 1}, {"a": 3, "val": -5}])})
    with pytest.raises(ExecutionError, match="Overflow"):
        at.prepare(query(rule([sum_(V.v)], atom("B", a=V.a, val=V.v)))).collect()
    ok = query(rule([sum_(V.v)], atom("B", a=V.a, val=V.v), ne(V.a, 2)))
    assert at.prepare(ok).collect() == {(2**63 - 6,)}


REACH = ("R", [rule([V.a, V.b], atom("E", src=V.a, dst=V.b))], [rule([V.a, V.c], atom("R", V.a, V.b), atom("E", src=V.b, dst=V.c))])


def test_recursion(worlds):
    state, at = worlds(6)
    want = naive.fixpoint(REACH[0], REACH[1], REACH[2], state)
    assert at.prepare(query(rule([V.a, V.b], atom("R", V.a, V.b)), rec=REACH)).collect() == want
    unreached = query(rule([V.a], atom("E", src=V.a), Not(atom("R", 0, V.a))), rec=REACH)
    assert at.prepare(unreached).collect() == {(e["src"],) for e in state["E"]} - {(b,) for a, b in want if a == 0}
    with pytest.raises(ExecutionError, match="DerivedBudgetExceeded"):
        at.prepare(query(rule([V.a, V.b], atom("R", V.a, V.b)), rec=REACH), max_tuples=3).execute()


def test_interiors(worlds):
    state, at = worlds(3)
    q = query(rule([V.g, count()], atom("G", V.g, V.v)), interiors={"G": rule([V.g, V.v], atom("A", id=V.i, grp=V.g), atom("B", a=V.i, val=V.v))})
    inner = naive.answers(q.interiors[0].rules, state)
    assert at.prepare(q).collect() == naive.answers(q.rules, state | {"G": [dict(enumerate(x)) for x in inner]})


def random_query(r):
    """A random legal rule: joins, negation, comparisons, masks, a fold or none."""
    atoms, conds, negs = [], [], []
    scalars = [V.i]
    atoms.append(atom("A", id=V.i, grp=V.g, **({"flag": r.random() < 0.5} if r.random() < 0.3 else {})))
    scalars.append(V.g)
    if r.random() < 0.6:
        atoms.append(atom("B", a=V.i, val=V.v))
        scalars.append(V.v)
        if r.random() < 0.5:
            conds.append(r.choice([gt, lt, ge, le, ne, eq])(V.v, r.randrange(-3, 4)))
    span = r.random() < 0.6
    if span:
        atoms.append(atom("Sp", grp=V.g, during=V.d))
        if r.random() < 0.5:
            conds.append(Allen(r.randrange(1, FULL), V.d, Lit((3, 7))))
        if r.random() < 0.3:
            atoms.append(atom("Sp", during=V.i))
    if r.random() < 0.4:
        negs.append(Not(r.choice([atom("B", a=V.i, val=r.randrange(-5, 6)), atom("E", src=V.i), atom("Sp", grp=V.g, during=V.i)])))
    if r.random() < 0.4:
        conds.append(any_of(r.choice([gt, lt])(V.g, 1), eq(V.i, r.randrange(12))))
    heads = r.sample(scalars, r.randrange(1, len(scalars) + 1))
    if span and r.random() < 0.4:
        heads = [h for h in heads if h is not V.d] + [pack(V.d)]
    elif r.random() < 0.5:
        over = r.choice(scalars)
        heads = [h for h in heads if h != over] + [Agg(r.choice(["sum", "min", "max"]), over), count()]
    return query(rule(heads, *atoms, *negs, *conds))


@pytest.mark.parametrize("seed", range(16))
def test_random_queries(worlds, seed):
    r = random.Random(seed)
    state, at = worlds(seed % 3 + 10)
    q = random_query(r)
    assert at.prepare(q).collect() == naive.answers(q.rules, state), render(q)
    assert parse(render(q)) == q
    assert Query.from_json(q.to_json()) == q


def test_empty_state(spark):
    at = Instance(spark, SCHEMA, {})
    for name in ("join", "count", "global_empty", "pack", "union"):
        assert at.prepare(CASES[name]).collect() == set()


def test_allen_table():
    spans = [(s, e) for s in range(5) for e in range(s + 1, 6)]
    ops = {"<": lambda a, b: a < b, "=": lambda a, b: a == b, "<=": lambda a, b: a <= b}
    for a in spans:
        for b in spans:
            basic = classify(a, b)
            assert converse(basic) == classify(b, a)
            name = {"s": a[0], "e": a[1], "S": b[0], "E": b[1]}
            for mask in [*range(1, FULL, 37), *BIT.values(), *(FULL & ~x for x in BIT.values())]:
                always, any_of_ = terms(mask)
                one = lambda t: ops[t[1]](name[t[0]], name[t[2]])
                assert (all(map(one, always)) and any(all(map(one, t)) for t in any_of_)) == bool(mask & basic)
    assert len(BASICS) == 13


REFUSED = [
    ("EmptyRuleSet", Query(())),
    ("EmptyFinds", Query((Rule((), (atom("A", id=V.i),)),))),
    ("NoPositiveAtoms", Query((Rule((V.i,), ()),))),
    ("TooManyRules", Query((rule([V.i], atom("A", id=V.i)),) * 17)),
    ("HeadArityMismatch", query(rule([V.i], atom("A", id=V.i)), rule([V.i, V.g], atom("A", id=V.i, grp=V.g)))),
    ("HeadTypeMismatch", query(rule([V.i], atom("A", id=V.i)), rule([V.n], atom("A", name=V.n)))),
    ("CountAcrossRules", query(rule([V.g, count()], atom("A", grp=V.g)), rule([V.g, count()], atom("A", grp=V.g, flag=True)))),
    ("UnknownRelation", query(rule([V.i], atom("Nope", id=V.i)))),
    ("UnknownField", query(rule([V.i], atom("A", nope=V.i)))),
    ("DuplicateFieldBinding", query(rule([V.i], Atom("A", (("id", V.i), ("id", V.i)))))),
    ("VariableTypeConflict", query(rule([V.i], atom("A", id=V.i, name=V.i)))),
    ("LiteralTypeMismatch", query(rule([V.i], atom("A", id=V.i, grp="x")))),
    ("PointLiteralAtCeiling", query(rule([V.g], atom("Sp", grp=V.g, during=RAY)))),
    ("ParamScalarAndSet", query(rule([V.i], atom("A", id=V.i, grp=P.x), eq(V.i, S.x)))),
    ("IllegalComparison", query(rule([V.i], atom("A", id=V.i, name=V.n), eq(V.i, V.n)))),
    ("OrderOnString", query(rule([V.i], atom("A", id=V.i, name=V.n), lt(V.n, "x")))),
    ("OrderOnInterval", query(rule([V.g], atom("Sp", grp=V.g, during=V.d), lt(V.d, (1, 2))))),
    ("OrderOnClosedReference", query(rule([V.i], atom("A", id=V.i, kind=V.k), lt(V.k, 2)))),
    ("ConstantComparison", query(rule([V.i], atom("A", id=V.i), eq(1, 1)))),
    ("SelfComparison", query(rule([V.i], atom("A", id=V.i), eq(V.i, V.i)))),
    ("EmptyAllenMask", query(rule([V.g], atom("Sp", grp=V.g, during=V.d), Allen(0, V.d, Lit((1, 2)))))),
    ("FullAllenMask", query(rule([V.g], atom("Sp", grp=V.g, during=V.d), Allen(FULL, V.d, Lit((1, 2)))))),
    ("NegatedVariableUnbound", query(rule([V.i], atom("A", id=V.i), Not(atom("B", a=V.z))))),
    ("UnboundFindVariable", query(rule([V.z], atom("A", id=V.i)))),
    ("ComparisonOnlyVariable", query(rule([V.i], atom("A", id=V.i), gt(V.z, 1)))),
    ("DuplicateFindTerm", query(rule([V.i, V.i], atom("A", id=V.i)))),
    ("AggregateInputType", query(rule([sum_(V.n)], atom("A", name=V.n)))),
    ("AggregateOverClosedReference", query(rule([max_(V.k)], atom("A", kind=V.k)))),
    ("CountWithVariable", query(rule([Agg("count", V.i)], atom("A", id=V.i)))),
    ("AggregateWithoutVariable", query(rule([Agg("sum")], atom("A", id=V.i)))),
    ("AggregateOverGroupKey", query(rule([V.g, sum_(V.g)], atom("A", grp=V.g)))),
    ("MultiplePackTerms", query(rule([pack(V.d), pack(V.e)], atom("Sp", during=V.d), atom("Sp", during=V.e)))),
    ("MixedPackAndFold", query(rule([pack(V.d), count()], atom("Sp", during=V.d)))),
    ("PackInputType", query(rule([pack(V.i)], atom("A", id=V.i)))),
    ("DurationOverNonInterval", query(rule([V.i], atom("A", id=V.i), gt(Duration("i"), 1)))),
    ("DurationComparisonOperator", query(rule([V.g], atom("Sp", grp=V.g, during=V.d), eq(duration(V.d), 1)))),
    ("DurationBothSides", query(rule([V.g], atom("Sp", grp=V.g, during=V.d), atom("Sp", during=V.e), lt(duration(V.d), duration(V.e))))),
    ("DurationInBinding", query(rule([V.g], Atom("Sp", (("grp", V.g), ("during", Duration("d"))))))),
    ("TooManyAtoms", query(rule([V.i], *(atom("A", id=V.i) for _ in range(21))))),
    ("AggregateInInterior", query(rule([V.i], atom("X", V.i)), interiors={"X": rule([count()], atom("A", id=V.i))})),
    ("InteriorNotPrior", query(rule([V.i], atom("X", V.i)), interiors={"X": rule([V.i], atom("Y", V.i)), "Y": rule([V.i], atom("A", id=V.i))})),
    ("InteriorColumnOutOfRange", query(rule([V.i], atom("X", None, V.i)), interiors={"X": rule([V.i], atom("A", id=V.i))})),
    ("NonlinearRecArm", query(rule([V.a], atom("R", V.a)), rec=("R", [rule([V.a], atom("E", src=V.a))], [rule([V.a], atom("R", V.a), atom("R", V.a))]))),
    ("RecArmMissingSelf", query(rule([V.a], atom("R", V.a)), rec=("R", [rule([V.a], atom("E", src=V.a))], [rule([V.a], atom("E", src=V.a))]))),
    ("SelfInBase", query(rule([V.a], atom("R", V.a)), rec=("R", [rule([V.a], atom("R", V.a))], [rule([V.a], atom("R", V.a))]))),
    ("NegationInRec", query(rule([V.a], atom("R", V.a)), rec=("R", [rule([V.a], atom("E", src=V.a))], [rule([V.a], atom("R", V.a), Not(atom("E", dst=V.a)))]))),
    ("MeasureInInterior", query(rule([V.i], atom("X", V.i)), interiors={"X": rule([V.g], atom("Sp", grp=V.g, during=V.d), gt(duration(V.d), 1))})),
    ("DnfExceedsRules", query(rule([V.i], atom("A", id=V.i), *(any_of(eq(V.i, 1), eq(V.i, 2)) for _ in range(5))))),
]


@pytest.mark.parametrize(("code", "q"), REFUSED, ids=[c for c, _ in REFUSED])
def test_refusals(spark, code, q):
    from relspark.plans.validate import validate

    with pytest.raises(QueryError, match=code):
        validate(SCHEMA, q)


def test_hostile_queries():
    """Random malformed queries raise typed errors only."""
    from relspark.plans.validate import validate

    r = random.Random(1)
    terms_ = [V.i, V.d, V.g, Var("zz"), P.p, S.s, Lit(3), Lit("x"), Lit((1, 4)), Lit(RAY), Duration("d"), Duration("i")]
    for _ in range(4000):
        atoms = tuple(Atom(r.choice(["A", "B", "Sp", "E", "Kind", "X"]), tuple((r.choice(["id", "grp", "name", "during", "val", "a", 0]), r.choice(terms_)) for _ in range(r.randrange(3)))) for _ in range(r.randrange(4)))
        conds = tuple(r.choice([Compare(r.choice(["==", "<", "~"]), r.choice(terms_), r.choice(terms_)), Allen(r.randrange(FULL + 1), r.choice(terms_), r.choice(terms_)), point_in(r.choice(terms_), r.choice(terms_))]) for _ in range(r.randrange(3)))
        finds = tuple(r.choice([*terms_, Agg(r.choice(["sum", "pack", "count", "zip"]), r.choice([*terms_, None]))]) for _ in range(r.randrange(3)))
        q = Query((Rule(finds, atoms[:2], atoms[2:], conds),))
        try:
            validate(SCHEMA, q)
        except QueryError:
            pass


def test_parse_text(worlds):
    state, at = worlds(3)
    q = parse('g, count() | A(id: i, grp: g, name: "x"), not B(a: i, val: 5), (i > 2 or g == 1);')
    assert at.prepare(q).collect() == naive.answers(q.rules, state)
    rec = parse("rec R = a, b | E(src: a, dst: b);\nstep R = a, c | R(0: a, 1: b), E(src: b, dst: c);\na | R(0: a, 1: a);")
    want = naive.fixpoint(REACH[0], REACH[1], REACH[2], state)
    assert at.prepare(rec).collect() == {(a,) for a, b in want if a == b}
    with pytest.raises(QueryError, match="Syntax"):
        parse("a | E(src a);")


def test_reads(worlds):
    state, at = worlds(3)
    assert at.count("A") == 12
    assert at.get("A", id=3).count() == 1
    assert at.contains("A", **state["A"][0])
    assert not at.contains("A", **(state["A"][0] | {"id": 99}))
    assert at.scan("Kind").count() == 3
    with pytest.raises(QueryError, match="NoSuchKey"):
        at.get("A", grp=1)


def test_unions_hold_no_answer_twice(spark):
    """Whichever of a union's rules are dead, folded away or proven distinct by themselves."""
    import itertools

    from relspark.schema import Key, Schema, relation
    from relspark.types import I64

    one = Schema((relation("A", id=I64(), v=I64()), relation("B", id=I64(), a=I64())), (Key("A", ("id",)), Key("B", ("id",))))
    at = Instance(spark, one, {"A": spark.range(6).selectExpr("id", "id % 2 AS v"), "B": spark.range(9).selectExpr("id", "id % 3 AS a")}, sets=None)
    rules = [
        rule([V.x], atom("A", id=V.x), lt(V.x, 1), gt(V.x, 5)),
        rule([V.x], atom("B", id=V.b, a=V.x)),
        rule([V.x], atom("A", id=V.x)),
        rule([V.x], atom("A", id=V.i, v=V.x)),
        rule([V.x], atom("A", id=V.x, v=V.w), gt(V.w, 0)),
    ]
    means = [set(), {0, 1, 2}, set(range(6)), {0, 1}, {1, 3, 5}]
    for n in (1, 2, 3):
        for picked in itertools.permutations(range(5), n):
            got = [r[0] for r in at.run(query(*(rules[k] for k in picked))).collect()]
            assert sorted(got) == sorted(set().union(*(means[k] for k in picked))), picked
