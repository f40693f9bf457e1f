"""A pure-Python model of queries: nested loops over sets, no shared code with the engine's compiler."""

from __future__ import annotations

from relspark.functions.allen import classify
from relspark.ir import Agg, Allen, And, Compare, Duration, Lit, Or, Param, ParamSet, PointIn, Var

RAY = 2**63 - 1


class Ray(Exception):
    pass


def term(t, env, params):
    if isinstance(t, Var):
        return env[t.name]
    if isinstance(t, Lit):
        return t.value
    if isinstance(t, (Param, ParamSet)):
        return params[t.name]
    s, e = env[t.var]
    return None if e == RAY else e - s


def holds(c, env, params):
    """True, False or None (the measure of a ray decides)."""
    if isinstance(c, And):
        vs = [holds(p, env, params) for p in c.parts]
        return False if False in vs else None if None in vs else True
    if isinstance(c, Or):
        vs = [holds(p, env, params) for p in c.parts]
        return True if True in vs else None if None in vs else False
    if isinstance(c, Allen):
        return bool(classify(term(c.left, env, params), term(c.right, env, params)) & c.mask)
    if isinstance(c, PointIn):
        s, e = term(c.interval, env, params)
        p = term(c.point, env, params)
        return any(s <= x < e for x in p) if isinstance(p, (set, frozenset)) else s <= p < e
    a, b = term(c.left, env, params), term(c.right, env, params)
    if a is None or b is None:
        return None
    if isinstance(c.right, ParamSet):
        return a in b
    if isinstance(c.left, ParamSet):
        return b in a
    return {"==": a == b, "!=": a != b}[c.op] if c.op in ("==", "!=") else {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]


def match(atom, fact, env, params, spans):
    """Environments that the fact extends ``env`` to, or None; points are checked when they have a value."""
    env = dict(env)
    for f, t in atom.bindings:
        v = fact[f]
        if isinstance(t, Var):
            point = isinstance(v, tuple) and not spans.get(t.name, False)
            if point:
                env.setdefault("?", []).append((t.name, v))
            elif t.name in env:
                if env[t.name] != v:
                    return None
            else:
                env[t.name] = v
        elif isinstance(t, ParamSet):
            xs = params[t.name]
            if not (any(v[0] <= x < v[1] for x in xs) if isinstance(v, tuple) else v in xs):
                return None
        else:
            x = term(t, env, params)
            if not (v[0] <= x < v[1] if isinstance(v, tuple) and not isinstance(x, tuple) else v == x):
                return None
    return env


def bindings(rule, state, params):
    scalar = {t.name for a in (*rule.atoms, *rule.negated) for f, t in a.bindings if isinstance(t, Var) and state[a.source] and not isinstance(next(iter(state[a.source]))[f], tuple)}
    names = {t.name for a in rule.atoms for _, t in a.bindings if isinstance(t, Var)}
    spans = {n: n not in scalar for n in names}
    envs = [{}]
    for a in rule.atoms:
        envs = [m for e in envs for f in state[a.source] if (m := match(a, f, {k: (list(v) if k == "?" else v) for k, v in e.items()}, params, spans)) is not None]
    out = set()
    ray = False
    for e in envs:
        points = e.pop("?", [])
        if any(not s <= e[n] < x for n, (s, x) in points):
            continue

        def hit(a, f, e=e):
            m = match(a, f, e, params, spans)
            return m is not None and all(s <= m[n] < x for n, (s, x) in m.get("?", []))

        if any(hit(a, f) for a in rule.negated for f in state[a.source]):
            continue
        v = holds(And(rule.conditions), e, params)
        if v is None:
            ray = True
        elif v:
            out.add(tuple(sorted(e.items())))
    if ray:
        raise Ray
    return [dict(x) for x in out]


def pack(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def answers(rules, state, params=()):
    params = dict(params)
    finds = rules[0].finds
    rows = []
    for r in rules:
        for e in bindings(r, state, params):
            row = []
            for f in r.finds:
                over = f.over if isinstance(f, Agg) else f
                v = None if over is None else term(over, e, params)
                if v is None and isinstance(over, Duration):
                    raise Ray
                row.append(v)
            rows.append(tuple(row))
    if len(rules) > 1:
        rows = list(set(rows))
    if not any(isinstance(f, Agg) for f in finds):
        return set(rows)
    groups = {}
    for row in rows:
        groups.setdefault(tuple(v for v, f in zip(row, finds, strict=True) if not isinstance(f, Agg)), []).append(row)
    out = set()
    for rows in groups.values():
        cols = list(zip(*rows, strict=True))
        packs = [i for i, f in enumerate(finds) if isinstance(f, Agg) and f.op == "pack"]
        if packs:
            for seg in pack(set(cols[packs[0]])):
                out.add(tuple(seg if i in packs else rows[0][i] for i in range(len(finds))))
            continue
        out.add(tuple(rows[0][i] if not isinstance(f, Agg) else {"count": len, "sum": sum, "min": min, "max": max}[f.op](cols[i]) for i, f in enumerate(finds)))
    return out


def fixpoint(name, base, step, state, params=()):
    known = answers(base, state, params)
    while True:
        state = state | {name: [dict(enumerate(x)) for x in known]}
        more = answers(step, state, params) if known else set()
        if more <= known:
            return known
        known |= more
