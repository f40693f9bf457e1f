import pytest

from relspark.builder import P, V, atom, query, rule
from relspark.engine import Instance, facts_frame
from relspark.errors import ExecutionError, SchemaError, StoreError
from relspark.operators.constraints import violations
from relspark.plans.render import render_statement
from relspark.schema import Capacity, Contained, Key, Schema, closed, mirrors, relation, side
from relspark.sources.store import Store
from relspark.streaming.commits import commit_batches, maintain
from relspark.types import I64, U64, Bytes, Interval, Str

RAY = 2**63 - 1
ROOM = relation("Room", id=(U64(), "fresh"), open=Interval(I64()))
BOOKING = relation("Booking", room=U64(), during=Interval(I64()), weight=I64())
SCHEMA = Schema(
    (ROOM, BOOKING, relation("Busy", room=U64())),
    (
        Key("Booking", ("room", "during")),
        Key("Room", ("id", "open")),
        Contained(side("Booking", "room"), side("Room", "id")),
        Contained(side("Booking", "room", "during"), side("Room", "id", "open")),
        Capacity(side("Room", "id"), side("Booking", "room"), 0, 2),
        Capacity(side("Room", "id"), side("Booking", "room"), 0, ("duration", "open"), weight=("duration", "during")),
    ),
)


def frames(spark, rooms, bookings):
    return {"Room": facts_frame(spark, ROOM, [{"id": i, "open": o} for i, o in rooms]), "Booking": facts_frame(spark, BOOKING, [{"room": r, "during": d, "weight": 1} for r, d in bookings]), "Busy": facts_frame(spark, SCHEMA["Busy"], [])}


def judged(spark, rooms, bookings, **kw):
    got = violations(frames(spark, rooms, bookings), SCHEMA, **kw).collect()
    return sorted((type(SCHEMA.statements[r.statement]).__name__, r.direction, r.fact) for r in got)


def test_accepts(spark):
    assert judged(spark, [(1, (0, 10)), (2, (0, RAY))], [(1, (0, 3)), (1, (3, 5)), (2, (100, 200))]) == []


def test_pointwise_key_lists_every_overlap(spark):
    got = judged(spark, [(1, (0, 99))], [(1, (0, 50)), (1, (10, 20)), (1, (30, 40)), (1, (50, 60))])
    assert {k for k, _, _ in got} == {"Key"}
    assert len(got) == 3  # keys come first: nothing else is told


def test_coverage_and_reference(spark):
    got = judged(spark, [(1, (0, 10))], [(1, (5, 12)), (7, (0, 1))])
    assert [k for k, _, _ in got] == ["Contained"] * 3  # two by coverage, one by reference


def test_coverage_by_union(spark):
    two = Schema((relation("Open", room=U64(), part=Interval(I64())), BOOKING), (Key("Open", ("room", "part")), Contained(side("Booking", "room", "during"), side("Open", "room", "part"))))
    for parts, bad in (([(0, 5), (5, 10)], 0), ([(0, 5), (6, 10)], 1), ([(0, RAY)], 0)):
        at = {"Open": facts_frame(spark, two["Open"], [{"room": 1, "part": p} for p in parts]), "Booking": facts_frame(spark, BOOKING, [{"room": 1, "during": (3, 8), "weight": 1}])}
        assert violations(at, two).count() == bad


def test_capacity(spark):
    got = judged(spark, [(1, (0, 10))], [(1, (0, 1)), (1, (1, 2)), (1, (2, 3))])
    assert [(k, d) for k, d, _ in got] == [("Capacity", "target")]
    with pytest.raises(ExecutionError, match="CapacityRayMeasure"):
        judged(spark, [(1, (0, RAY))], [(1, (0, RAY))])
    floor = Schema((ROOM, BOOKING), (Capacity(side("Room", "id"), side("Booking", "room", weight=3), 1, None, weight="weight"),))
    at = frames(spark, [(1, (0, 9)), (2, (0, 9))], [(1, (0, 1))])
    assert violations(at, floor).count() == 2  # parents without selected children break a floor


def test_repeated_rows_break_nothing(spark):
    """Frames that hold facts twice are judged as the sets that they stand for."""
    rel = relation("P", id=I64(), at=Interval(I64()), w=I64()), relation("C", p=I64(), w=I64())
    schema = Schema(rel, (Key("P", ("id",)), Contained(side("C", "p"), side("P", "id")), Capacity(side("P", "id"), side("C", "p"), 1, 5, weight="w"), Key("P", ("w", "at"))))
    ps = [{"id": i, "at": (k, k + 2), "w": 1} for i, k in ((1, 0), (2, 2), (3, 9), (3, 12), (4, 3))]
    cs = [{"p": p, "w": w} for p, w in ((1, 2), (1, 3), (2, 5), (2, 1), (9, 1), (4, 4))]
    once = {"P": facts_frame(spark, rel[0], ps), "C": facts_frame(spark, rel[1], cs)}
    twice = {n: f.union(f) for n, f in once.items()}
    for first in (True, False):
        want = sorted(violations(once, schema, keys_first=first).collect())
        assert want and want == sorted(violations(twice, schema, keys_first=first, loose={"P", "C"}).collect())
    assert {r.statement for r in violations(once, schema, keys_first=False).collect()} == {0, 1, 2, 3}


def test_store_writes(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    with pytest.raises(StoreError, match="DestinationExists"):
        Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    ids = store.reserve("Room", 2)
    assert list(ids) == [0, 1]

    def fill(delta):
        delta.insert("Room", [{"id": i, "open": (0, 100)} for i in ids])
        delta.insert("Booking", [{"room": 0, "during": (0, 10), "weight": 1}])
        assert delta.contains("Room", id=0, open=(0, 100))

    done = store.write(fill)
    assert done and done.generation == 1 and done.changed == 3
    before = store.snapshot()
    assert store.write(fill).generation == 1  # nothing changes, no new generation
    bad = store.write(lambda d: d.insert("Booking", [{"room": 0, "during": (5, 15), "weight": 1}, {"room": 9, "during": (0, 1), "weight": 1}]))
    assert bad.status == "rejected" and store.meta["generation"] == 1
    assert {v["relation"] for v in bad.violations} == {"Booking"} and len(bad.violations) == 2  # both sides of the overlap; keys preempt
    orphan = store.write(lambda d: d.delete("Room", [{"id": 0, "open": (0, 100)}]))
    assert orphan.status == "rejected" and {v["direction"] for v in orphan.violations} == {"target"}

    def swap(delta):
        delta.delete("Booking", [{"room": 0, "during": (0, 10), "weight": 1}])
        delta.insert("Booking", [{"room": 0, "during": (5, 15), "weight": 1}])

    assert store.write(swap, witness=0).status == "moved"
    assert store.write(swap, witness=1).generation == 2
    assert before.count("Booking") == 1 and before.contains("Booking", room=0, during=(0, 10), weight=1)
    again = Store.open(spark, f"file://{tmp_path}/s")
    assert again.snapshot().contains("Booking", room=0, during=(5, 15), weight=1)
    assert again.verify() == []
    assert list(again.reserve("Room")) == [2]
    small = again.compact(f"file://{tmp_path}/small")
    assert small.snapshot().count("Room") == 2 and small.disk_size() > 0
    with pytest.raises(StoreError, match="SchemaMismatch"):
        Store.open(spark, f"file://{tmp_path}/s", Schema((ROOM,)))
    with pytest.raises(StoreError, match="NoStore"):
        Store.open(spark, f"file://{tmp_path}/none")


def test_incremental_agrees_with_complete(spark, tmp_path):
    """Each single change is accepted exactly if the whole final state is."""
    base = frames(spark, [(1, (0, 10)), (2, (0, 20))], [(1, (0, 3)), (2, (4, 8)), (2, (8, 9))])
    changes = [
        ("Booking", "insert", {"room": 1, "during": (3, 6), "weight": 1}), ("Booking", "insert", {"room": 2, "during": (0, 2), "weight": 1}), ("Booking", "insert", {"room": 1, "during": (2, 4), "weight": 1}),
        ("Booking", "insert", {"room": 1, "during": (8, 12), "weight": 1}), ("Booking", "delete", {"room": 2, "during": (4, 8), "weight": 1}), ("Room", "delete", {"id": 1, "open": (0, 10)}), ("Room", "insert", {"id": 3, "open": (0, 1)}),
    ]
    for n, (name, op, fact) in enumerate(changes):
        store = Store.create(spark, f"file://{tmp_path}/{n}", SCHEMA, Instance(spark, SCHEMA, base))
        done = store.write(lambda d, name=name, op=op, fact=fact: getattr(d, op)(name, [fact]))
        final = dict(base)
        one = facts_frame(spark, SCHEMA[name], [fact])
        final[name] = final[name].unionByName(one).distinct() if op == "insert" else final[name].join(one, SCHEMA[name].columns(), "left_anti")
        assert bool(done) == violations(final, SCHEMA).isEmpty(), (name, op, fact)


def test_stream_and_derived(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    assert store.write(lambda d: d.insert("Room", [{"id": 1, "open": (0, 100)}]))
    rows = facts_frame(spark, BOOKING, [{"room": 1, "during": (0, 5), "weight": 1}, {"room": 1, "during": (5, 9), "weight": 1}])
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    rejected = []
    stream = spark.readStream.schema(BOOKING.struct()).parquet(f"{tmp_path}/in")
    q = commit_batches(stream, store, "Booking", f"{tmp_path}/check", rejected).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rejected == [] and store.snapshot().count("Booking") == 2
    compute = lambda at: at.run(query(rule([V.r], atom("Booking", room=V.r))), names=["room"])
    assert maintain(store, "Busy", compute).changed == 1
    assert store.write(lambda d: d.delete("Booking", rows))
    assert maintain(store, "Busy", compute).changed == 1 and store.snapshot().count("Busy") == 0


def test_two_handles(spark, tmp_path):
    """Reserves and writes of two handles, taken in turns, lose nothing and give no id twice."""
    path = f"file://{tmp_path}/s"
    a = Store.create(spark, path, SCHEMA)
    b = Store.open(spark, path)
    put = lambda i: lambda d: d.insert("Room", [{"id": i, "open": (0, 100)}])
    assert a.write(put(5)).generation == 1
    assert list(b.reserve("Room", 2)) == [6, 7]  # the stale handle sees the write
    assert list(a.reserve("Room")) == [8] and b.write(put(6)).generation == 2
    assert b.write(put(7), witness=1).status == "moved"

    def overtaken(delta):
        if not seen:
            assert b.write(put(9)).generation == 3
        seen.append(1)
        put(10)(delta)

    seen = []
    assert a.write(overtaken).generation == 4 and len(seen) == 2

    def reserving(delta):  # an id reserved meanwhile is no reason to start again
        more.append(b.reserve("Room", 1)[0])
        put(20)(delta)

    more = []
    assert a.write(reserving).generation == 5 and more == [11]
    at = Store.open(spark, path).snapshot()
    assert {r.id for r in at.scan("Room").collect()} == {5, 6, 9, 10, 20} and at.generation == 5
    assert list(a.reserve("Room")) == [21]
    assert not a.files.create("manifest-000000000000.json", "{}")  # manifests are never replaced
    assert a.write(lambda d: put(30)(d), witness=5).generation == 6


def test_one_order_of_facts_and_frames(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    fact = {"id": 1, "open": (0, 9)}
    one = facts_frame(spark, ROOM, [fact])

    def change(*steps):
        def of(delta):
            for kind, what in steps:
                getattr(delta, kind)("Room", what)
                assert delta.contains("Room", **fact) == (kind == "insert")

        return of

    for steps in ([("insert", one), ("delete", one)], [("insert", one), ("delete", [fact])], [("insert", [fact]), ("delete", one)], [("delete", one), ("insert", [fact]), ("delete", [fact])]):
        assert store.write(change(*steps)).generation == store.meta["generation"] and store.snapshot().count("Room") == 0
    assert store.write(change(("delete", one), ("insert", one))).changed == 1
    assert store.write(change(("insert", [fact]), ("delete", one), ("insert", one))).changed == 0
    assert store.write(change(("insert", one), ("delete", one))).changed == 1 and store.snapshot().count("Room") == 0


def test_changes_are_written_as_deltas(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("relspark.sources.store.MAX_DELTAS", 4)
    store = Store.create(spark, f"file://{tmp_path}/s", SCHEMA)
    want = set()
    for i in range(8):
        def change(delta, i=i):
            delta.insert("Room", [{"id": i, "open": (0, 9)}])
            if i % 3 == 2:
                delta.delete("Room", [{"id": i - 1, "open": (0, 9)}])

        assert store.write(change)
        want = want - {i - 1} | {i} if i % 3 == 2 else want | {i}
        assert {r.id for r in store.snapshot().scan("Room").collect()} == want
        assert len(store.meta["folders"]["Room"]) <= 6
    assert len(store.compact(f"file://{tmp_path}/c").meta["folders"]["Room"]) == 1


def test_every_violation_is_kept(spark, tmp_path):
    """More violations than are shown, and a hot statement before another: all of them, from write, stream, verify and create."""
    n = 12_000
    rows = spark.range(n).selectExpr("id AS room", "0L AS during_start", "5L AS during_end", "1L AS weight")
    store = Store.create(spark, f"file://{tmp_path}/store", SCHEMA)
    want = {(i, "source"): n for i, st in enumerate(SCHEMA.statements) if isinstance(st, Contained)}

    def whole(found, counts):
        assert found.counts == counts and found.total == sum(counts.values()) and found.cut == (len(found) < found.total)
        assert found.table.select("statement", "direction", "fact").distinct().count() == found.total
        assert {(v["statement"], v["direction"]) for v in found} == set(counts)

    done = store.write(lambda d: d.insert("Booking", rows))
    assert done.status == "rejected" and done.violations.cut
    whole(done.violations, want)
    rejected = []
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    commit_batches(stream, store, "Booking", f"{tmp_path}/check", rejected).trigger(availableNow=True).start().awaitTermination(120)
    whole(rejected[0][1], want)
    store.meta["folders"]["Booking"] = [["insert", store._put("Booking", rows)]]
    assert {v["finding"] for v in store.verify()} == {"violation"}
    whole(store.verify(), want)
    with pytest.raises(StoreError) as e:
        Store.create(spark, f"file://{tmp_path}/other", SCHEMA, Instance(spark, SCHEMA, frames(spark, [], []) | {"Booking": rows.limit(150)}))
    whole(e.value.details["violations"], {k: 150 for k in want})


def test_wide_u64(spark):
    wide = Schema((relation("N", id=U64(wide=True), at=Interval(U64(wide=True))),), (Key("N", ("id",)),))
    top = 2**64 - 1
    at = Instance(spark, wide, {"N": facts_frame(spark, wide["N"], [{"id": top, "at": (5, top)}, {"id": 3, "at": (0, 9)}])})
    assert at.prepare(query(rule([V.i], atom("N", id=V.i, at=P.t)))).collect(t=2**63) == {(top,)}


def test_schema_refusals():
    a = relation("A", id=I64(), s=Interval(I64()), b=Bytes(4), n=Str())
    key = Key("A", ("id",))
    cases = {
        "DuplicateRelation": lambda: Schema((a, a)),
        "BytesWidth": lambda: Schema((relation("A", b=Bytes(65)),)),
        "IntervalWidth": lambda: Schema((relation("A", b=Interval(I64(), 0)),)),
        "EmptyExtension": lambda: Schema((closed("C", {}, w=I64()),)),
        "ExtensionTooLarge": lambda: Schema((closed("C", {f"h{i}": (i,) for i in range(257)}, w=I64()),)),
        "ExtensionType": lambda: Schema((closed("C", {"x": ("y",)}, w=I64()),)),
        "StrOnClosed": lambda: Schema((closed("C", {"x": ("y",)}, w=Str()),)),
        "UnknownRelation": lambda: Schema((a,), (Key("Z", ("id",)),)),
        "UnknownField": lambda: Schema((a,), (Key("A", ("zz",)),)),
        "EmptyProjection": lambda: Schema((a,), (Key("A", ()),)),
        "IntervalNotLast": lambda: Schema((a,), (Key("A", ("s", "id")),)),
        "DuplicateStatement": lambda: Schema((a,), (key, key)),
        "NoMatchingKey": lambda: Schema((a,), (Contained(side("A", "n"), side("A", "n")),)),
        "TypeMismatch": lambda: Schema((a,), (key, Contained(side("A", "n"), side("A", "id")))),
        "SelectedAndProjected": lambda: Schema((a,), (key, Contained(side("A", "id", id=3), side("A", "id")))),
        "DegenerateSet": lambda: Schema((a,), (key, Contained(side("A", "id", n={"x"}), side("A", "id")))),
        "SelectionType": lambda: Schema((a,), (key, Contained(side("A", "id", n=4), side("A", "id")))),
        "CapacityInverted": lambda: Schema((a,), (key, Capacity(side("A", "id"), side("A", "id"), 4, 2))),
        "CapacityVacuous": lambda: Schema((a,), (key, Capacity(side("A", "id"), side("A", "id")))),
        "DurationWeight": lambda: Schema((a,), (key, Capacity(side("A", "id"), side("A", "id"), 0, 3, weight=("duration", "n")))),
    }
    for code, make in cases.items():
        with pytest.raises(SchemaError, match=code):
            make()


def test_statements_between_constants():
    """Decided when the schema is made."""
    kind = closed("Kind", {"a": (1, (0, 5)), "b": (2, (5, 9)), "c": (2, (20, 30))}, size=I64(), part=Interval(I64()))
    need = closed("Need", {"x": (2, (6, 8)), "y": (1, (0, 5))}, size=I64(), part=Interval(I64()))
    wide = closed("Wide", {"x": (2, (8, 22))}, size=I64(), part=Interval(I64()))
    pointwise = Key("Kind", ("size", "part"))
    good = [
        pointwise,
        Contained(side("Need", "size", "part"), side("Kind", "size", "part")),
        Contained(side("Need", "id"), side("Kind", "id")),
        Capacity(side("Kind", "id"), side("Need", "id"), 0, 1),
        Capacity(side("Need", "id"), side("Kind", "id"), 0, 9, weight=("duration", "part")),
    ]
    assert Schema((kind, need, wide), tuple(good))
    bad = [
        Key("Kind", ("size",)),
        Contained(side("Wide", "size", "part"), side("Kind", "size", "part")),
        Contained(side("Kind", "id"), side("Need", "id")),
        Capacity(side("Kind", "id"), side("Need", "id"), 1, 1),
        Capacity(side("Need", "id"), side("Kind", "id"), 0, 4, weight=("duration", "part")),
        Capacity(side("Need", "id"), side("Kind", "id"), 0, 1, weight="size"),
    ]
    for st in bad:
        with pytest.raises(SchemaError, match="FalseOfConstants"):
            Schema((kind, need, wide), (pointwise, st))
    overlap = closed("Kind", {"a": (1, (0, 5)), "b": (1, (4, 9))}, size=I64(), part=Interval(I64()))
    with pytest.raises(SchemaError, match="FalseOfConstants"):
        Schema((overlap,), (pointwise,))


def test_schema_round_trip():
    again = Schema.from_json(SCHEMA.to_json())
    assert again == SCHEMA and again.fingerprint() == SCHEMA.fingerprint()
    assert SCHEMA.manifest()["Room"]["fields"] == {"id": 0, "open": 1}
    assert render_statement(SCHEMA.statements[-1]) == "Room(id) <=[duration(during)]{0..duration(open)} Booking(room)"
    assert len(mirrors(side("Room", "id"), side("Busy", "room"))) == 2


def test_schema_text():
    from relspark.plans.schema_text import parse_schema, render_schema, render_violation
    from relspark.queries import JUDGED
    from relspark.sources.tables import SCHEMA as TABLES
    from tests.test_engine import SCHEMA as OTHER

    for s in (SCHEMA, OTHER, TABLES, JUDGED):
        assert parse_schema(render_schema(s)) == s
    s = parse_schema("""
        // rooms and what is booked in them
        relation Room { id: u64 fresh, open: interval<i64>, tag: bytes<2> }
        relation Slot { room: u64, part: interval<i64, 30>, kind: u64 }
        closed Kind { hot: bool } = { low: (false), top: (true) }
        Slot(room, part) -> Slot
        Slot(room | kind == {0, 1}) <= Room(id)
        Slot(kind) <= Kind(id)
        Room(id | tag == 0x0a0b) <=[duration(part)]{1..*} Slot(room)
    """)
    assert s.statements[-1] == Capacity(side("Room", "id", tag=b"\x0a\x0b"), side("Slot", "room"), 1, None, ("duration", "part"))
    assert parse_schema(render_schema(s)) == s
    text = render_violation(s, {"statement": 2, "direction": "source", "relation": "Slot", "fact": "{}"})
    assert text == "Slot {} shares its key: Slot(room, part) -> Slot"
    for bad in ("relation R { a: float }", "R(a) => R", "relation R { a: i64"):
        with pytest.raises(SchemaError, match="Syntax"):
            parse_schema(bad)
