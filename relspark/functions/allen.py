"""The 13 basic relations of two half-open intervals, as bits of a mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relspark.errors import QueryError

#: The bit order, under which the converse is the reversed mask.
BASICS = ["before", "meets", "overlaps", "starts", "during", "finishes", "equals", "finished_by", "contains", "started_by", "overlapped_by", "met_by", "after"]
BIT = {name: 1 << i for i, name in enumerate(BASICS)}
FULL = (1 << 13) - 1
BEFORE, MEETS, OVERLAPS, STARTS, DURING, FINISHES, EQUALS, FINISHED_BY, CONTAINS, STARTED_BY, OVERLAPPED_BY, MET_BY, AFTER = (BIT[x] for x in BASICS)
DISJOINT = BEFORE | MEETS | MET_BY | AFTER
INTERSECTS = FULL & ~DISJOINT
COVERS = EQUALS | FINISHED_BY | CONTAINS | STARTED_BY
COVERED_BY = EQUALS | FINISHES | DURING | STARTS
NAMED = {"intersects": INTERSECTS, "disjoint": DISJOINT, "covers": COVERS, "covered_by": COVERED_BY} | BIT


def converse(mask: int) -> int:
    return int(f"{mask:013b}"[::-1], 2)


def check_mask(mask: int) -> None:
    if mask == 0:
        raise QueryError("EmptyAllenMask")
    if mask == FULL or not 0 < mask < FULL:
        raise QueryError("FullAllenMask")


def classify(a: tuple[int, int], b: tuple[int, int]) -> int:
    """The one basic relation of two intervals."""
    (s, e), (S, E) = a, b
    if e < S:
        return BEFORE
    if e == S:
        return MEETS
    if E < s:
        return AFTER
    if E == s:
        return MET_BY
    if s == S:
        return EQUALS if e == E else STARTS if e < E else STARTED_BY
    if e == E:
        return FINISHES if S < s else FINISHED_BY
    if s < S:
        return CONTAINS if E < e else OVERLAPS
    return DURING if e < E else OVERLAPPED_BY


#: How the endpoints of a = [s, e) and b = [S, E) compare in each basic relation; `sep` gives the text of either dialect.
_TERMS = {
    BEFORE: [("e", "<", "S")], MEETS: [("e", "=", "S")], AFTER: [("E", "<", "s")], MET_BY: [("E", "=", "s")],
    OVERLAPS: [("s", "<", "S"), ("S", "<", "e"), ("e", "<", "E")], OVERLAPPED_BY: [("S", "<", "s"), ("s", "<", "E"), ("E", "<", "e")],
    STARTS: [("s", "=", "S"), ("e", "<", "E")], STARTED_BY: [("s", "=", "S"), ("E", "<", "e")],
    DURING: [("S", "<", "s"), ("e", "<", "E")], CONTAINS: [("s", "<", "S"), ("E", "<", "e")],
    FINISHES: [("S", "<", "s"), ("e", "=", "E")], FINISHED_BY: [("s", "<", "S"), ("e", "=", "E")],
    EQUALS: [("s", "=", "S"), ("e", "=", "E")],
}
_SHORT = {
    INTERSECTS: [[("s", "<", "E"), ("S", "<", "e")]],
    DISJOINT: [[("e", "<=", "S")], [("E", "<=", "s")]],
    COVERS: [[("s", "<=", "S"), ("E", "<=", "e")]],
    COVERED_BY: [[("S", "<=", "s"), ("e", "<=", "E")]],
}


def terms(mask: int) -> tuple[list, list]:
    """(conjuncts that always hold, alternatives): an endpoint predicate for the mask.

    Masks whose relations all touch get the touching window as conjuncts, so
    that a join sees two plain range conditions before any disjunction.
    """
    if mask in _SHORT:
        return [], _SHORT[mask]
    any_of = [_TERMS[bit] for bit in _TERMS if mask & bit]
    touching = mask & (BEFORE | AFTER) == 0
    if len(any_of) == 1:
        return [], any_of
    return [("s", "<=", "E"), ("S", "<=", "e")] if touching else [], any_of


def allen_sql(mask: int, s: str, e: str, S: str, E: str) -> str:
    name = {"s": s, "e": e, "S": S, "E": E}
    always, any_of = terms(mask)
    one = lambda t: f"{name[t[0]]} {t[1]} {name[t[2]]}"
    alternatives = " OR ".join("(" + " AND ".join(map(one, t)) + ")" for t in any_of)
    return " AND ".join([*map(one, always), f"({alternatives})"])


def allen(mask: int, s: Column, e: Column, S: Column, E: Column) -> Column:
    name = {"s": s, "e": e, "S": S, "E": E}
    ops = {"<": lambda a, b: a < b, "=": lambda a, b: a == b, "<=": lambda a, b: a <= b}
    always, any_of = terms(mask)

    def every(ts):
        out = None
        for a, op, b in ts:
            c = ops[op](name[a], name[b])
            out = c if out is None else out & c
        return out

    out = None
    for t in any_of:
        out = every(t) if out is None else out | every(t)
    window = every(always)
    return out if window is None else window & out


def point_in(point: Column, start: Column, end: Column) -> Column:
    return (start <= point) & (point < end)


__all__ = ["BASICS", "COVERED_BY", "COVERS", "DISJOINT", "FULL", "INTERSECTS", "NAMED", "F", "allen", "allen_sql", "check_mask", "classify", "converse", "point_in"]
