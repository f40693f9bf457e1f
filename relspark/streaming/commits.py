"""Streams of changes: every micro-batch is judged and committed to a store as one write."""

from __future__ import annotations

from pyspark.sql import DataFrame

from relspark.errors import StoreError
from relspark.sources.store import Store


def commit_batches(stream: DataFrame, store: Store, relation: str, checkpoint: str, rejected: list | None = None):
    """A streaming query that inserts the stream's rows (the relation's columns) into the store.

    A batch that breaks a statement is not written; its violations go to
    ``rejected`` as (batch, ``Found``, whose table has all of them), or end the
    stream where that is None.  A batch
    that runs twice after a failure changes nothing the second time, because
    relations are sets.
    """

    def commit(batch: DataFrame, number: int) -> None:
        done = store.write(lambda delta: delta.insert(relation, batch))
        if done.status == "rejected":
            if rejected is None:
                raise StoreError("Rejected", relation, violations=done.violations)
            rejected.append((number, done.violations))

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)


def maintain(store: Store, derived: str, compute) -> object:
    """Bring a derived relation up to date: run ``compute(instance)`` and write the difference under the generation it was computed from."""
    at = store.snapshot()
    want = compute(at)
    have = at.frames[derived]
    columns = store.schema[derived].columns()
    want = want.select(*columns).distinct().cache()
    def change(delta):
        delta.insert(derived, want.join(have, columns, "left_anti"))
        delta.delete(derived, have.join(want, columns, "left_anti"))

    try:
        return store.write(change, witness=at.generation)
    finally:
        want.unpersist()


__all__ = ["commit_batches", "maintain"]
