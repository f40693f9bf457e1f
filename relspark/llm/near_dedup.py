"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A document's set is its distinct word shingles.  Documents of one set (128-bit
fingerprints) form a class of exact copies, and classes are joined:

* Signature: ``HASHES`` MinHash values cut to 16 bits.  Two sets of similarity J
  differ in about ``(1 - J) * HASHES`` places; for J >= 0.8 they differ in more
  than ``MAX_ERRORS`` with a chance of about 1e-4.
* Multi-index: the signature is split into ``CHUNKS`` chunks.  By pigeonhole two
  signatures with at most ``MAX_ERRORS`` errors have a chunk with at most
  ``MAX_ERRORS // CHUNKS`` = 1, and every chunk is indexed once for each place
  that may be wrong.  So all pairs within the distance share a key.  (Keys are
  made twice, for the counts and for the members: that is cheaper than 64 stored
  keys a class.)

Candidates are confirmed on full sets in stages; what is joined after one stage
is not looked at by the next, and buckets of one component are left out:

* Home: each class with the smallest class of its buckets, one pair a class.
* Stars: each class with one class of the smallest and one of the largest other
  component in each of its buckets.
* Groups: a class's group is the smallest class that its buckets, and theirs,
  lead to.  Groups that still hold several components are compared on full sets
  inside blocks of members; only links that join components leave a block.  In
  a group of several blocks, a set whose shingles that others of the group have
  are too few for any link stays out (``(100 + p) k < 2 p n`` as the smaller set,
  ``100 k < p n`` as the larger), which is exact.
* Rest: buckets that still hold several components and groups are compared member
  by member, in blocks; pairs of different components and groups within the
  signature distance, each in the first bucket that it shares, are confirmed on
  full sets.  Nothing is capped.

Components are joined as stages find links: links are contracted to links of
components, reduced to local stars inside each task, and closed by repeated
minimum labels with pointer jumps, each round written to the shared folder.

Edge cases: null and blank texts have an empty set and are linked with nothing.
A text of fewer words than a shingle is one shingle of all its words.  Rows that
share id and text are one document with equal results.  Rows that share an id
but not a text are documents of their own.  A null id stands for itself alone
where its text is unique, never names a component (its component_id is null
then) and comes after all ids.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import bounded_batches, drop_scratch, materialize, row_key
from relspark.llm.textops import WORDS_BY_SPACE, hashed_words, mix, slices

HASHES, MAX_ERRORS, CHUNKS = 64, 25, 13
BLOCK = 256
#: Shingles of a block of full sets.
BLOCK_ITEMS = 2_000_000
#: Groups of so many blocks or more are first rid of sets that can't have a link.
THIN_FROM = 4
#: Edges that one task contracts at once.
LOCAL_EDGES = 500_000
#: Id tables up to this many rows (32 bytes each) are broadcast, larger ones shuffled.
MAX_BROADCAST_ROWS = 1_000_000
#: Stand-ins for null ids lie above all real ones.
NO_ID = 1 << 62

_SEEDS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULT = mix(_SEEDS) | np.uint64(1)
_BOUNDS = np.linspace(0, HASHES, CHUNKS + 1).round().astype(int)
_P = np.uint64(0x9DDFEA08EB382D69)
_Q = np.uint64(0xC3A5C85C97CB3127)


def _shingles(col: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and text numbers of all shingles, repeats included."""
    words, owner = hashed_words(col, WORDS_BY_SPACE)
    if not len(words):
        return words, owner
    n = np.bincount(owner, minlength=len(col))
    acc = words.copy()
    k = np.minimum(n, size)
    at = np.arange(len(words)) - np.concatenate([[0], np.cumsum(n)[:-1]])[owner]
    first = at + k[owner] <= n[owner]
    for j in range(1, size):
        nxt = np.zeros_like(words)
        nxt[: len(words) - j] = words[j:]
        acc = np.where(j < k[owner], acc * _P + nxt, acc)
    return mix(acc + k[owner].astype(np.uint64))[first], owner[first]


def _sets(col: pa.Array, size: int):
    """For each text with words: its number and the sorted distinct shingle hashes."""
    hashes, owner = _shingles(col, size)
    cuts = np.flatnonzero(np.diff(owner)) + 1 if len(owner) else []
    for part, lo in zip(np.split(hashes, cuts), [0, *cuts], strict=True) if len(owner) else ():
        yield int(owner[lo]), np.unique(part)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` 16-bit values a set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint16)
    for k in range(HASHES):
        out[:, k] = (mix(np.minimum.reduceat((flat ^ _SEEDS[k]) * _MULT[k], starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def index_keys(sigs: np.ndarray) -> np.ndarray:
    """For each signature a key for every chunk and place that may be wrong."""
    out = np.empty(sigs.shape, np.uint64)
    wide = sigs.astype(np.uint64)
    for c in range(CHUNKS):
        lo, hi = _BOUNDS[c], _BOUNDS[c + 1]
        for skip in range(lo, hi):
            h = np.full(len(sigs), skip + 1, np.uint64)
            for j in range(lo, hi):
                if j != skip:
                    h = mix(h * _P + wide[:, j])
            out[:, skip] = h
    return out


def _fingerprint(items: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of the set."""
    n = np.full(1, len(items), np.uint64)
    return tuple(int(mix(np.add.reduce(mix(items * p ^ p), keepdims=True) + n * p).view(np.int64)[0]) for p in (_P, _Q))


def _features(size: int):
    def run(batches):
        for part in slices(batches, "text"):
            n = part.num_rows
            found = list(_sets(part.column(2), size))
            count, f1, f2, sig = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
            if found:
                rows = signatures([x for _, x in found])
                for (i, x), s in zip(found, rows, strict=True):
                    count[i], sig[i] = len(x), s.tobytes()
                    f1[i], f2[i] = _fingerprint(x)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(3), pa.array(count), pa.array(f1, mask=count == 0), pa.array(f2, mask=count == 0), pa.array(sig, pa.binary())],
                ["doc_id", "id", "row_key", "n_shingles", "f1", "f2", "sig"],
            )

    return run


def _class_sets(size: int):
    def run(batches):
        for part in slices(batches, "text"):
            want = [x.to_pylist() for x in part.columns[:3]]
            found = [(want[0][i], x) for i, x in _sets(part.column(3), size) if _fingerprint(x) == (want[1][i], want[2][i])]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["c", "items"])

    return run


def _keyed(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, HASHES)
            keys = index_keys(sigs)
            slots = np.tile(np.arange(HASHES, dtype=np.int32), len(sigs))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(part.column(0), np.int64), HASHES)), pa.array(slots)], ["key", "c", "slot"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["x", "y"])

    return run


def local_stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components in fewer links: each node with the smallest one that it reaches through these links."""
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    lab = np.arange(len(nodes))
    while True:
        old = lab.copy()
        np.minimum.at(lab, a, old[b])
        np.minimum.at(lab, b, old[a])
        lab = np.minimum(lab, lab[lab])
        if (lab == old).all():
            break
    far = lab != np.arange(len(nodes))
    return nodes[lab[far]], nodes[far]


def _contract(batches):
    held, n = [], 0

    def flush():
        x, y = local_stars(*(np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= LOCAL_EDGES:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def _groups(batches, marks: tuple[str, ...]):
    """Tables of the rows that agree in ``marks``, from batches sorted by them."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        if not table.num_rows:
            continue
        at = np.stack([np.asarray(table.column(k)) for k in marks], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), table.num_rows]
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield table.slice(lo, hi - lo)
        held = table.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield held


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = np.asarray(rows.column("block"))
    return np.flatnonzero(side == rows.column("bi")[0].as_py()), np.flatnonzero(side == rows.column("bj")[0].as_py())


def first_slots(same: np.ndarray) -> np.ndarray:
    """The first index slot that each pair shares, from the equal places of their signatures (pairs, ``HASHES``)."""
    out = np.full(len(same), -1)
    for c in range(CHUNKS - 1, -1, -1):
        lo, hi = _BOUNDS[c], _BOUNDS[c + 1]
        wrong = ~same[:, lo:hi]
        n = wrong.sum(axis=1)
        out = np.where(n == 0, lo, np.where(n == 1, lo + wrong.argmax(axis=1), out))
    return out


def _block_pairs(batches):
    """Of sorted rows (key, bi, bj): pairs of different labels and homes within the signature distance, in their first slot."""
    for rows in _groups(batches, ("key", "bi", "bj")):
        c, lab, home = (np.asarray(rows.column(k)) for k in ("c", "lab", "home"))
        slot = rows.column("slot")[0].as_py()
        sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, HASHES)
        left, right = _sides(rows)
        for lo in range(0, len(left), 64):
            part = left[lo : lo + 64]
            i, j = np.nonzero((lab[part, None] != lab[None, right]) & (home[part, None] != home[None, right]))
            i, j = part[i], right[j]
            same = sigs[i] == sigs[j]
            use = (HASHES - same.sum(axis=1) <= MAX_ERRORS) & (first_slots(same) == slot)
            if use.any():
                x, y = c[i[use]], c[j[use]]
                u = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], ["x", "y"])


def _block_links(percent: int):
    """Of sorted rows (home, bi, bj) with full sets: links between components, no more than join them."""

    def find(parent, i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def run(batches):
        for rows in _groups(batches, ("home", "bi", "bj")):
            c, lab = np.asarray(rows.column("c")), np.asarray(rows.column("lab"))
            left, right = _sides(rows)
            if not len(left) or not len(right) or (lab == lab[0]).all():
                continue
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("items")]
            size = np.array([len(x) for x in sets])
            starts = np.concatenate([[0], np.cumsum(size[right])[:-1]])
            names, at = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
            _, parent = np.unique(lab, return_inverse=True)
            parent, label = list(range(int(parent.max()) + 1)), parent
            mark, x, y = np.zeros(len(names), np.int32), [], []
            for i in left:
                k = np.searchsorted(names, sets[i])
                k = k[(k < len(names)) & (names[np.minimum(k, len(names) - 1)] == sets[i])]
                mark[k] = 1
                both = np.add.reduceat(mark[at], starts)
                mark[k] = 0
                for j in right[100 * both >= percent * (size[right] + size[i] - both)]:
                    a, b = find(parent, label[i]), find(parent, label[j])
                    if a != b:
                        parent[a] = b
                        x.append(c[i])
                        y.append(c[j])
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def class_sets(docs: DataFrame, need: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(c, items): the full sets of the classes in ``need``, from the texts of their representatives."""
    ids = materialize(need.join(classes.select("c", F.col("rep.id").alias("id"), "f1", "f2"), "c"), "near-ids")
    texts = docs.select("id", "text").join(_small(ids, ids.count()), "id").select("c", "f1", "f2", "text")
    return materialize(texts.mapInArrow(_class_sets(size), "c long, items binary").dropDuplicates(["c"]), "near-sets")


def confirm_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of classes whose full sets are similar enough."""
    rows = pairs.join(sets.select(F.col("c").alias("x"), F.col("items").alias("a")), "x")
    rows = rows.join(sets.select(F.col("c").alias("y"), F.col("items").alias("b")), "y")
    return materialize(rows.select("x", "y", "a", "b").mapInArrow(_confirm(percent), "x long, y long"), "near-links")


def _deal(rows: DataFrame, group: str) -> DataFrame:
    """Block pairs dealt out in turn from a place that their group's hash gives, so that those of one large group spread evenly."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.col("bj") * (F.col("bj") + 1) / 2 + F.col("bi")
    return rows.repartitionById(n, F.pmod(F.pmod(F.xxhash64(group), F.lit(n)) + turn.cast("long"), F.lit(n)).cast("int")).sortWithinPartitions(group, "bi", "bj")


def _blocks(rows: DataFrame, blocks: str, more: str | None = None) -> DataFrame:
    """Rows once for each pair of blocks (bi, bj) of their group that theirs is in; blocks come from hashes.

    There are ``blocks`` blocks, each of which meets all; with ``more`` the rows
    that aren't ``short`` are in as many further blocks, which meet only the former.
    """
    mine, first, upto = F.col(blocks), F.lit(0).cast("long"), F.col(blocks)
    if more:
        mine = F.when(F.col("short"), F.col(blocks)).otherwise(F.col(more))
        first = F.when(F.col("short"), 0).otherwise(F.col(blocks)).cast("long")
        upto = F.when(F.col("short"), F.col(blocks) + F.col(more)).otherwise(F.col(blocks))
    rows = rows.withColumn("block", first + F.pmod(F.xxhash64("c"), F.greatest(mine, F.lit(1)))).withColumn("upto", upto).where("upto > 0")
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("upto") - 1)))
    return rows.withColumn("bi", F.least("block", "o")).withColumn("bj", F.greatest("block", "o")).drop("o", "upto")


def _in_blocks(n, s):
    return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_ITEMS)).cast("long")


def thinned(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (home, c, lab, n) that may have a link inside their home, and whether as the smaller set (``short``)."""
    items = rows.select("home", "c").join(sets, "c").mapInArrow(_spread_items, "home long, c long, item long")
    own = items.groupBy("home", "item").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("k")).where("k = 1").groupBy("home", "c").agg(F.count(F.lit(1)).alias("alone"))
    rows = rows.join(own, ["home", "c"], "left").withColumn("k", F.col("n") - F.coalesce("alone", F.lit(0)))
    rows = rows.where(F.expr(f"100 * k >= {percent} * n")).withColumn("short", F.expr(f"{100 + percent} * k >= {2 * percent} * n"))
    return rows.select("home", "c", "lab", "n", "short")


def _spread_items(batches):
    for batch in batches:
        homes, cs = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for home, c, items in zip(homes, cs, batch.column(2), strict=True):
            at = np.frombuffer(items.as_buffer(), np.int64)
            for lo in range(0, len(at), 1 << 16):
                part = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), home)), pa.array(np.full(len(part), c)), pa.array(part)], ["home", "c", "item"])


def home_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of one home; rows (home, c, lab, n)."""
    sizes = rows.groupBy("home").agg(F.min("lab").alias("l0"), F.max("lab").alias("l1"), _in_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")).where("l0 <> l1")
    rows = materialize(rows.join(sizes.select("home", "blocks"), "home"), "near-homed")
    few = rows.where(F.col("blocks") < THIN_FROM).withColumn("more", F.lit(0).cast("long")).withColumn("short", F.lit(True)).select("home", "c", "lab", "short", "blocks", "more")
    many = materialize(thinned(rows.where(F.col("blocks") >= THIN_FROM).drop("blocks"), sets, percent), "near-thinned")
    short, n, one = F.col("short"), F.col("n"), F.lit(1)
    by = many.groupBy("home").agg(*(_in_blocks(F.coalesce(F.sum(F.when(x, one)), F.lit(0)), F.coalesce(F.sum(F.when(x, n)), F.lit(0))).alias(k) for k, x in (("blocks", short), ("more", ~short))))
    spread = few.unionByName(many.join(by, "home").select(*few.columns))
    spread = materialize(_blocks(spread, "blocks", "more").select("home", "c", "lab", "block", "bi", "bj"), "near-spread")
    links = materialize(_deal(spread.join(sets, "c"), "home").mapInArrow(_block_links(percent), "x long, y long"), "near-links")
    for x in (rows, many, spread):
        drop_scratch(x)
    return links


def connect(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(c, lab) for the classes in links and in ``labels``: lab is the smallest class of the component."""
    if labels is not None and links.isEmpty():
        return labels
    edges = links.select("x", "y")
    if labels is not None:
        for side in ("x", "y"):
            known = labels.select(F.col("c").alias(side), F.col("lab").alias("known"))
            edges = edges.join(known, side, "left").withColumn(side, F.coalesce("known", side)).drop("known")
        edges = edges.where("x <> y")
    edges = materialize(edges.distinct().mapInArrow(_contract, "x long, y long").distinct(), "near-edges")
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    nodes = materialize(both.groupBy(F.col("x").alias("c")).agg(F.least(F.min("y"), F.first("x")).alias("lab")), "near-labels")
    while True:
        near = both.join(nodes.select(F.col("c").alias("y"), "lab"), "y").groupBy("x").agg(F.min("lab").alias("near"))
        step = materialize(nodes.join(near.withColumnRenamed("x", "c"), "c").select("c", F.least("lab", "near").alias("new"), "lab"), "near-step")
        jump = step.select(F.col("c").alias("new"), F.col("new").alias("jump"))
        after = materialize(step.join(jump, "new").select("c", F.least("new", "jump").alias("lab"), F.col("lab").alias("old")), "near-labels")
        changed = after.where(F.col("lab") != F.col("old")).limit(1).count()
        drop_scratch(step)
        drop_scratch(nodes)
        nodes = after
        if not changed:
            break
    if labels is None:
        return nodes.select("c", "lab")
    moved = labels.join(nodes.select(F.col("c").alias("lab"), F.col("lab").alias("to")), "lab", "left").select("c", F.coalesce("to", "lab").alias("lab"))
    out = materialize(moved.unionByName(nodes.select("c", "lab").join(labels, "c", "left_anti")), "near-labels")
    drop_scratch(nodes)
    return out


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, slot, c, lab) of the buckets that hold several components."""
    marked = members.select("key", "slot", "c").join(labels, "c", "left").withColumn("lab", F.coalesce("lab", "c"))
    keys = marked.groupBy("key").agg(F.min("lab").alias("l0"), F.max("lab").alias("l1")).where("l0 <> l1").select("key")
    return materialize(marked.join(keys, "key").select("key", "slot", "c", "lab"), "near-mixed")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, id (doc_id or its stand-in), row_key (of id and text), n_shingles, component_id, kept (the id names its component), stays (the one document of its component that stays)."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.expr(f"(xxhash64(text) & {NO_ID - 1}) + {NO_ID}")).alias("id"), "text", row_key("doc_id", "text").alias("row_key"))
    feats = materialize(docs.mapInArrow(_features(shingle), "doc_id long, id long, row_key binary, n_shingles long, f1 long, f2 long, sig binary"), "near-features")
    classes = feats.where("f1 IS NOT NULL").groupBy("f1", "f2").agg(F.min(F.struct("id", "row_key")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # Classes are numbered once, as they are written.
    classes = materialize(classes.sortWithinPartitions("f1", "f2").withColumn("c", F.monotonically_increasing_id()), "near-classes")
    keyed = classes.select("c", "sig").mapInArrow(_keyed, "key long, c long, slot int")
    shared = materialize(keyed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key", "lo"), "near-shared")
    members = materialize(keyed.join(shared, "key"), "near-members")
    home = materialize(members.groupBy("c").agg(F.min("lo").alias("home")), "near-home")
    sets = class_sets(docs, home.select("c"), classes, shingle)
    # Home: one pair a class.
    first = confirm_pairs(home.where("home <> c").select(F.col("home").alias("x"), F.col("c").alias("y")), sets, percent)
    labels = connect(first)
    left = mixed(members, labels)
    drop_scratch(members)
    # Stars: with a class of the smallest and of the largest other component of each bucket.
    ends = left.groupBy("key").agg(F.min(F.struct("lab", "c")).alias("lo"), F.max(F.struct("lab", "c")).alias("hi"))
    stars = left.join(ends, "key").select("c", "lab", F.explode(F.array("lo", "hi")).alias("o")).where("lab <> o.lab")
    stars = materialize(stars.select(F.least("c", "o.c").alias("x"), F.greatest("c", "o.c").alias("y")).distinct(), "near-stars")
    labels = connect(confirm_pairs(stars, sets, percent), labels)
    left, old = mixed(left, labels), left
    drop_scratch(old)
    # Groups: the smallest class of a class's buckets, and once more the smallest home of its buckets' members.
    near = left.groupBy("key").agg(F.min("c").alias("home"))
    home = materialize(left.select("key", "c").join(near, "key").groupBy("c").agg(F.min("home").alias("home")), "near-home")
    near = left.select("key", "c").join(home, "c").groupBy("key").agg(F.min("home").alias("home"))
    home = materialize(left.select("key", "c", "lab").join(near, "key").groupBy("c", "lab").agg(F.min("home").alias("home")), "near-home")
    labels = connect(home_links(home.join(classes.select("c", "n"), "c").select("home", "c", "lab", "n"), sets, percent), labels)
    # Rest: buckets with members of several components and groups.
    left, old = mixed(left, labels), left
    drop_scratch(old)
    marked = materialize(left.join(home.select("c", "home"), "c"), "near-marked")
    sizes = marked.groupBy("key").agg(F.min("home").alias("h0"), F.max("home").alias("h1"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("h0 <> h1")
    rest = _blocks(marked.join(sizes.select("key", "blocks"), "key"), "blocks").select("key", "slot", "c", "lab", "home", "block", "bi", "bj")
    rest = _deal(rest.join(classes.select("c", "sig"), "c"), "key")
    pairs = rest.mapInArrow(_block_pairs, "x long, y long").distinct()
    pairs = materialize(pairs.join(stars, ["x", "y"], "left_anti"), "near-rest")
    labels = connect(confirm_pairs(pairs, sets, percent), labels)
    named = materialize(classes.select("c", "f1", "f2", "rep").join(labels, "c", "left").withColumn("lab", F.coalesce("lab", "c")), "near-names")
    named = named.join(named.groupBy("lab").agg(F.min("rep").alias("top")), "lab").select("f1", "f2", "top")
    for x in (left, marked, stars, sets, shared):
        drop_scratch(x)
    own = ["doc_id", "id", "row_key", "n_shingles"]
    empty = feats.where("f1 IS NULL").select(*own, F.struct("id", "row_key").alias("top"))
    out = feats.where("f1 IS NOT NULL").join(named, ["f1", "f2"]).select(*own, "top").unionByName(empty)
    top = F.col("top.id")
    return out.select(*own, F.when(top < NO_ID, top).alias("component_id"), (top == F.col("id")).alias("kept"), (F.col("top") == F.struct("id", "row_key")).alias("stays"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
comp AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
