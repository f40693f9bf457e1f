"""One linear recursion by semi-naive rounds; each round is written to the shared folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from relspark.errors import ExecutionError
from relspark.operators.aggregates import evaluate
from relspark.operators.rules import RuleCompiler
from relspark.sources.scratch import materialize

MAX_ROUNDS, MAX_TUPLES = 1 << 16, 10**7


def fixpoint(rc: RuleCompiler, name: str, base: list, step: list, signature: list, max_rounds: int = MAX_ROUNDS, max_tuples: int = MAX_TUPLES, tuples: int = 0) -> DataFrame:
    """The least table that holds the base and is closed under the steps.

    Round 0 is the base; a later round joins the steps with what the round
    before added, and keeps what is new.  The driver sees one count a round.
    ``tuples`` of the interiors count towards the budget.
    """
    rc.unit = f"{name}, round 0"
    delta = materialize(evaluate(rc, base, signature), "reach")
    known, total, rounds = [delta], tuples + delta.count(), 0
    while True:
        if total > max_tuples or rounds > max_rounds:
            raise ExecutionError("DerivedBudgetExceeded", name, rounds=rounds, tuples=total)
        rc.frames[name], rc.unit = delta, f"{name}, round {rounds + 1}"
        seen = reduce(lambda a, b: a.unionByName(b), known)
        if len(known) > 8:  # many small rounds: one table again
            seen = materialize(seen, "reach")
            known = [seen]
        delta = materialize(evaluate(rc, step, signature).join(seen, seen.columns, "left_anti"), "reach")
        new = delta.count()
        rc.step("new", delta)
        if not new:
            rc.frames[name] = seen
            return seen
        known.append(delta)
        total, rounds = total + new, rounds + 1
