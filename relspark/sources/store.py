"""A durable store: Parquet folders of inserted and deleted facts, and numbered manifests that name them.

A write judges the final state of its change set, writes what it inserts and
deletes to new folders, and then creates the manifest with the next number.
Creating fails if that number is taken, so of two writers that start from one
state one is told and starts again; no manifest is ever replaced or deleted, and
readers hold a generation and never see half of a write.  A relation with more
than ``MAX_DELTAS`` folders is written whole by the next change to it.  Paths go
through Hadoop's file systems, which must rename atomically.
"""

from __future__ import annotations

import json
import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.engine import Instance, conform, facts_frame
from relspark.errors import StoreError
from relspark.operators.constraints import change_violations, violations
from relspark.schema import Schema
from relspark.sources.scratch import drop_scratch, materialize

FORMAT = 2

#: Folders of changes on top of a relation's first one, before it is written whole again.
MAX_DELTAS = 16

#: Local file systems look before they rename; inside one process this keeps both steps together.
_RENAMES = threading.Lock()

#: Violations that the driver gets to show, dealt evenly to the broken statements; ``Found.table`` has all of them.
SHOWN = 10_000


class _Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name) if name else self._path(self.root))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")  # noqa: SLF001
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file, whole or not at all; False if there is one of that name."""
        temp = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.path(temp), True)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop  # noqa: SLF001
        never = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)  # noqa: SLF001
        never[0] = hadoop.fs.Options.Rename.NONE
        context = hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())  # noqa: SLF001
        with _RENAMES:
            if not self.exists(name):
                try:
                    context.rename(self.fs.makeQualified(self.path(temp)), self.fs.makeQualified(self.path(name)), never)
                    return True
                except Exception:
                    if not self.exists(name):
                        raise
        self.fs.delete(self.path(temp), False)
        return False

    def newest(self) -> int | None:
        """The number of the newest manifest."""
        if not self.exists():
            return None
        found = [re.fullmatch(r"manifest-(\d+)\.json", x.getPath().getName()) for x in self.fs.listStatus(self._path(self.root))]
        return max((int(m[1]) for m in found if m), default=None)

    def size(self) -> int:
        return self.fs.getContentSummary(self._path(self.root)).getLength()


class Found(list):
    """Violations: the list holds rows to show, the rest is complete.

    ``table`` is a DataFrame of every violation, written to the shared scratch
    folder (``drop_scratch(found.table)`` deletes it), or None if there is none;
    ``counts`` is the number of violations by (statement, direction), ``total``
    their sum.  ``cut``: the list holds fewer than ``total``.
    """

    def __init__(self, rows=(), table: DataFrame | None = None, counts: dict[tuple[int, str], int] | None = None):
        super().__init__(rows)
        self.table, self.counts = table, counts or {}
        self.total = sum(self.counts.values())
        self.cut = len(self) < self.total

    @staticmethod
    def of(rows: DataFrame, **more) -> Found:
        table = materialize(rows, "violations")
        counts = {(r.statement, r.direction): r.n for r in table.groupBy("statement", "direction").agg(F.count(F.lit(1)).alias("n")).orderBy("statement", "direction").collect()}
        if not counts:
            drop_scratch(table)
            return Found()
        share = max(1, SHOWN // len(counts))
        shown = [{**more, **r.asDict()} for k, d in counts for r in table.where((F.col("statement") == k) & (F.col("direction") == d)).orderBy("relation", "fact").limit(share).collect()]
        return Found(shown, table, counts)


class Write:
    """The outcome of a write: accepted with the new generation, or rejected with its violations, or moved."""

    def __init__(self, status: str, generation: int, found: Found | None = None, changed: int = 0):
        self.status, self.generation, self.violations, self.changed = status, generation, Found() if found is None else found, changed

    def __bool__(self):
        return self.status == "accepted"


class Delta:
    """A change set: of an insertion and a deletion of one fact the later counts, whether they come as facts or as DataFrames."""

    def __init__(self, store: Store, at: Instance):
        self.store, self.at = store, at
        #: By relation, in order: a dict from facts to whether they are inserted, or a pair of a DataFrame and that.
        self.steps: dict[str, list] = {}

    def _put(self, name: str, facts, insert: bool) -> None:
        if self.store.schema[name].closed:
            raise StoreError("ClosedRelationWrite", name)
        steps = self.steps.setdefault(name, [])
        if isinstance(facts, DataFrame):
            steps.append((facts, insert))
            return
        if not steps or not isinstance(steps[-1], dict):
            steps.append({})
        for f in facts:
            f = tuple(sorted(f.items(), key=lambda x: x[0]))
            steps[-1].pop(f, None)
            steps[-1][f] = insert

    def insert(self, name: str, facts) -> None:
        """Facts as dicts by field, or a DataFrame with the relation's columns."""
        self._put(name, facts, True)

    def delete(self, name: str, facts) -> None:
        self._put(name, facts, False)

    def contains(self, name: str, /, **fact) -> bool:
        """Of the state with the change laid over it."""
        f = tuple(sorted(fact.items()))
        for step in reversed(self.steps.get(name, [])):
            if isinstance(step, dict):
                if f in step:
                    return step[f]
            elif Instance(self.at.spark, self.at.schema, {name: step[0]}).contains(name, **fact):
                return step[1]
        return self.at.contains(name, **fact)

    def reserve(self, name: str, n: int = 1) -> range:
        return self.store.reserve(name, n)

    def resolved(self, spark) -> tuple[dict, dict]:
        """What is inserted and what is deleted in the end; no fact is in both."""
        ins, dels = {}, {}
        for name, steps in self.steps.items():
            r = self.store.schema[name]
            for step in steps:
                if isinstance(step, dict):
                    pairs = [(facts_frame(spark, r, map(dict, x)), k) for k in (True, False) if (x := [f for f, put in step.items() if put == k])]
                else:
                    pairs = [(conform(step[0], r).distinct(), step[1])]
                for df, insert in pairs:
                    to, other = (ins, dels) if insert else (dels, ins)
                    if name in other:
                        other[name] = other[name].join(df, r.columns(), "left_anti")
                    to[name] = to[name].unionByName(df).distinct() if name in to else df
        return ins, dels


def _manifest(number: int) -> str:
    return f"manifest-{number:012d}.json"


class Store:
    """A handle on a store; it sees the generation that it last read, wrote or refreshed to."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema, meta: dict):
        self.spark, self.schema, self.files, self.meta = spark, schema, _Files(spark, root), meta

    @staticmethod
    def create(spark: SparkSession, root: str, schema: Schema, instance: Instance | None = None) -> Store:
        files = _Files(spark, root)
        if files.newest() is not None:
            raise StoreError("DestinationExists", root)
        files.fs.mkdirs(files._path(files.root))  # noqa: SLF001
        meta = {"format": FORMAT, "fingerprint": schema.fingerprint(), "schema": schema.to_json(), "number": -1, "generation": 0, "folders": {}, "next": {}}
        store = Store(spark, root, schema, meta)
        if instance is not None:
            found = Found.of(violations(instance.frames, schema, loose=instance.loose))
            if found:
                raise StoreError("NotAdmitted", root, violations=found)
            meta["folders"] = {r.name: [["insert", store._put(r.name, instance.scan(r.name))]] for r in schema.relations if not r.closed}
            meta["next"] = store._marks(instance.frames)
        if not store._save(meta):
            raise StoreError("DestinationExists", root)
        return store

    @staticmethod
    def open(spark: SparkSession, root: str, schema: Schema | None = None) -> Store:
        files = _Files(spark, root)
        newest = files.newest()
        if newest is None:
            raise StoreError("NoStore", root)
        meta = json.loads(files.read(_manifest(newest)))
        if meta["format"] != FORMAT:
            raise StoreError("FormatMismatch", str(meta["format"]))
        own = Schema.from_json(meta["schema"])
        if schema is not None and schema.fingerprint() != meta["fingerprint"]:
            raise StoreError("SchemaMismatch", root)
        return Store(spark, root, schema or own, meta)

    def refresh(self) -> Store:
        """See what other handles have committed."""
        newest = self.files.newest()
        if newest != self.meta["number"]:
            self.meta = json.loads(self.files.read(_manifest(newest)))
        return self

    def _save(self, meta: dict) -> bool:
        """Commit ``meta``, which was made from this handle's, as the next manifest; False if another writer was first."""
        meta = meta | {"number": self.meta["number"] + 1}
        if not self.files.create(_manifest(meta["number"]), json.dumps(meta)):
            return False
        self.meta = meta
        return True

    def _put(self, name: str, df: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.files.root}/{folder}")
        return folder

    def _frame(self, name: str, steps: list) -> DataFrame:
        out = None
        for kind, folder in steps:
            df = self.spark.read.schema(self.schema[name].struct()).parquet(f"{self.files.root}/{folder}")
            out = df if out is None else out.unionByName(df) if kind == "insert" else out.join(df, self.schema[name].columns(), "left_anti")
        return out

    def snapshot(self) -> Instance:
        """This handle's generation; later writes don't change it."""
        return Instance(self.spark, self.schema, {n: self._frame(n, steps) for n, steps in self.meta["folders"].items()}, sets=None, generation=self.meta["generation"], admitted=True)

    def reserve(self, name: str, n: int = 1) -> range:
        """Fresh ids; the mark is saved at once, so that no id is given out again even if the write is dropped."""
        if not any(f.fresh for f in self.schema[name].fields):
            raise StoreError("NoFreshField", name)
        while True:
            self.refresh()
            start = self.meta["next"].get(name, 0)
            if start + n > 2**63 - 1:
                raise StoreError("FreshExhausted", name)
            if self._save(self.meta | {"next": self.meta["next"] | {name: start + n}}):
                return range(start, start + n)

    def _marks(self, frames: dict[str, DataFrame]) -> dict[str, int]:
        """For relations with a minted field the number after the largest."""
        out = {}
        for r in self.schema.relations:
            for f in r.fields:
                if f.fresh and r.name in frames:
                    top = frames[r.name].agg(F.max(f.name)).first()[0]
                    if top is not None:
                        out[r.name] = max(out.get(r.name, 0), int(top) + 1)
        return out

    def write(self, change, witness: int | None = None) -> Write:
        """``change(delta)`` fills a change set, which is judged against the final state and committed whole or not at all.

        ``witness``: a generation; if the store has moved past it, nothing is
        written.  Without it a write that another one overtakes starts again on
        the new state, and ``change`` is called again.
        """
        while True:
            self.refresh()
            if witness is not None and witness != self.meta["generation"]:
                return Write("moved", self.meta["generation"])
            done = self._try(change)
            if done is not None:
                return done

    def _try(self, change) -> Write | None:
        base, generation = self.snapshot(), self.meta["generation"]
        delta = Delta(self, base)
        change(delta)
        ins, dels = delta.resolved(self.spark)
        ins = {n: df.join(base.frames[n], self.schema[n].columns(), "left_anti") for n, df in ins.items()}
        dels = {n: df.join(base.frames[n], self.schema[n].columns(), "left_semi") for n, df in dels.items()}
        ins = {n: df.cache() for n, df in ins.items() if not df.isEmpty()}
        dels = {n: df.cache() for n, df in dels.items() if not df.isEmpty()}
        if not ins and not dels:
            return Write("accepted", generation)
        try:
            found = Found.of(change_violations(base.frames, ins, dels, self.schema))
            if found:
                return Write("rejected", generation, found)
            folders, changed = dict(self.meta["folders"]), sum(df.count() for df in (*ins.values(), *dels.values()))
            for n in {*ins, *dels}:
                steps = list(folders.get(n, []))
                if not steps and n in ins or len(steps) > MAX_DELTAS:
                    df = base.frames[n].join(dels[n], self.schema[n].columns(), "left_anti") if n in dels else base.frames[n]
                    steps = [["insert", self._put(n, df.unionByName(ins[n]) if n in ins else df)]]
                else:
                    steps += [[kind, self._put(n, d[n])] for kind, d in (("delete", dels), ("insert", ins)) if n in d]
                folders[n] = steps
            marks = self._marks(ins)
            while True:
                now = self.meta["next"]
                meta = self.meta | {"folders": folders, "generation": generation + 1, "next": now | {n: max(now.get(n, 0), k) for n, k in marks.items()}}
                if self._save(meta):
                    return Write("accepted", generation + 1, changed=changed)
                if self.refresh().meta["generation"] != generation:  # ids that others reserved are no reason to judge again
                    return None
        finally:
            for df in (*ins.values(), *dels.values()):
                df.unpersist()

    def verify(self) -> Found:
        """Findings of a sweep over the current state: violations and missing folders."""
        out = Found({"finding": "missing folder", "relation": n} for n, steps in self.meta["folders"].items() for _, f in steps if not self.files.exists(f))
        return out or Found.of(violations(self.snapshot().frames, self.schema), finding="violation")

    def compact(self, dest: str, files_per_relation: int = 1) -> Store:
        at = self.snapshot()
        small = {r.name: at.frames[r.name].coalesce(files_per_relation) for r in self.schema.relations if not r.closed}
        made = Store.create(self.spark, dest, self.schema)
        folders = {n: [["insert", made._put(n, df)]] for n, df in small.items()}
        if not made._save(made.meta | {"folders": folders, "generation": self.meta["generation"], "next": dict(self.meta["next"])}):
            raise StoreError("CommitFailed", dest)
        return made

    def disk_size(self) -> int:
        return self.files.size()
