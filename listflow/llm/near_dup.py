"""Near duplicates: b-bit MinHash signatures met by a multi-index Hamming join.

A signature has ``CHUNKS * CHUNK`` components of 16 bits. Two signatures that
differ in at most ``2 * CHUNKS - 1`` components differ in at most one component
of some chunk (pigeonhole), so each chunk is indexed once per component left
out, which covers every value an error can take there. All pairs of signatures
within that distance therefore share a key. At the similarity limit of 0.8 a
component differs with probability 0.2, and more than 23 of 48 differ with
probability 3e-6.

Only links between different shingle sets are sought: rows with the same set are
one class, and classes are what is indexed and linked, whatever their ids. Under a
key every class meets a pivot. Tasks find a pivot for each key among the classes
they hold, so a key that a third of all classes share sends one row per task and
group on, and of these the smallest is the key's pivot. Where classes under a key are too far from a pivot,
and nothing else near puts them in one family of candidates, the signatures of
those outside the key's largest family are compared with all others under the key,
block by block; within a block, a near pair is a candidate where it joins two
families. So classes within the distance always end in one family. Where that
leaves a family in several components, the members outside its largest component
are compared with the whole family, block by block; within a block, only those not
yet connected. So no key emits all its pairs, and none is dropped. A link counts
only when the full sets confirm it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from listflow.llm.common import Words, chunks, drop_staged, factor, hidden, mixed, small_batches, staged, staged_so_far, text_bytes
from listflow.llm.components import components

CHUNKS, CHUNK = 12, 4
SIZE = CHUNKS * CHUNK
#: Largest number of differing components for which a common key is certain.
DISTANCE = 2 * CHUNKS - 1
#: Members of a family that one comparing task holds from each side.
BLOCK = 256
#: Members of a key, without their texts, that are compared at a time from each side.
KEY_BLOCK = 1024
#: Classes among which a task looks for pivots at a time.
PIVOT_GROUP = 16_384

_rng = np.random.Generator(np.random.PCG64(20240501))
_XOR = _rng.integers(0, 1 << 64, SIZE, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 64, SIZE, dtype=np.uint64) | np.uint64(1)
_TWO = np.uint64(0xA0761D6478BD642F)


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than a shingle: one for all; none: empty."""
    for begin, end in chunks(texts):
        w = Words(texts[begin:end], lower=True)
        all_shingles = w.shingles(words)
        for first, count in zip(w.first, w.count):
            if count >= words:
                yield np.unique(all_shingles[first : first + count - words + 1])
            elif count:
                by = np.array([factor(j) for j in range(count)], np.uint64)
                yield mixed((w.hash[first : first + count] * by).sum(keepdims=True) + np.uint64(count))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    low = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 4096):
        low = np.minimum(low, ((shingles[None, i : i + 4096] ^ _XOR[:, None]) * _MUL[:, None]).min(axis=1))
    return (mixed(low) >> np.uint64(48)).astype("<u2").tobytes()


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sig = [], [], []
            for s in shingle_sets(text_bytes(batch.column(1)), words):
                n.append(len(s))
                digest.append(mixed(s).sum(dtype=np.uint64).tobytes() + mixed(s ^ _TWO).sum(dtype=np.uint64).tobytes())
                sig.append(signature(s) if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "h", "n", "digest", "sig"])

    return run


def keys(sig: np.ndarray) -> np.ndarray:
    """One key per chunk and left-out component: its number and the three components that stay."""
    wide = sig.astype(np.int64)
    out = np.empty((len(sig), SIZE), np.int64)
    for c in range(CHUNKS):
        for e in range(CHUNK):
            k = c * CHUNK + e
            x, y, z = (wide[:, c * CHUNK + i] for i in range(CHUNK) if i != e)
            out[:, k] = k << 48 | x << 32 | y << 16 | z
    return out


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, SIZE)


_PAIRS = "key long, a long, b long, near boolean"


def _local_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group of classes: every key with its pivot (b is null), pairs with a pivot that are near (once, without a key) and far."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_())])

    def run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by("node")
        node, sig = t.column("node").to_numpy(), _signatures(t.column("sig"))
        key = keys(sig).ravel()
        row = np.repeat(np.arange(len(node)), SIZE)
        order = np.argsort(key, kind="stable")
        key, row = key[order], row[order]
        new = np.diff(key, prepend=-1) != 0
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        rest = np.flatnonzero(~new)
        a, b = row[first[rest]], row[rest]
        pair, which = np.unique(a * len(node) + b, return_inverse=True)
        x, y = pair // len(node), pair % len(node)
        near = np.concatenate([np.zeros(0, bool), *((sig[x[i : i + 4096]] != sig[y[i : i + 4096]]).sum(axis=1) <= DISTANCE for i in range(0, len(x), 4096))])
        far = np.flatnonzero(~near[which])
        x, y, at = x[near], y[near], np.flatnonzero(new)
        n, m, f = len(at), len(x), len(far)
        columns = [
            pa.array(np.concatenate((key[at], np.zeros(m, np.int64), key[rest][far])), mask=np.repeat([False, True, False], [n, m, f])),
            pa.array(np.concatenate((node[row[at]], node[x], node[a[far]]))),
            pa.array(np.concatenate((np.zeros(n, np.int64), node[y], node[b[far]])), mask=np.repeat([True, False, False], [n, m, f])),
            pa.array(np.repeat([False, True, False], [n, m, f]), mask=np.repeat([True, False, False], [n, m, f])),
        ]
        return pa.record_batch(columns, schema=schema)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= PIVOT_GROUP:
            yield run(held)
            held, size = [], 0
    if size:
        yield run(held)


def _all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key = keys(_signatures(batch.column(1)))
            yield pa.record_batch([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), SIZE))], names=["key", "node"])


def _distance(a: str, b: str):
    differing = [(F.substring(a, 2 * i + 1, 2) != F.substring(b, 2 * i + 1, 2)).cast("int") for i in range(SIZE)]
    return sum(differing[1:], differing[0])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) < len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted = {k: i for i, k in enumerate(a) if k not in held}
            held = {k: held[k] for k in set(a) if k in held}
            held.update(zip(wanted, shingle_sets(text_bytes(batch.column(2).take(pa.array(wanted.values(), pa.int64()))), words)))
            ok = [similar(held[k], s, percent) for k, s in zip(a, shingle_sets(text_bytes(batch.column(3)), words))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _joining(node: np.ndarray, sig: np.ndarray, family: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs within the distance, one of them on the left, that join two families."""
    label = np.unique(family, return_inverse=True)[1]
    right = np.flatnonzero(~left)
    for i in np.flatnonzero(left):
        others = right[label[right] != label[i]]
        for begin in range(0, len(others), 256):
            some = others[begin : begin + 256]
            some = some[label[some] != label[i]]
            for j in some[(sig[some] != sig[i]).sum(axis=1) <= DISTANCE]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    yield int(node[i]), int(node[j])


def _join_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_joining`` over runs of rows with equal ``key``, ``outer`` and ``block``."""

    def run(t: pa.Table, starts: list[int]) -> pa.RecordBatch:
        node, family, left = (t.column(c).to_numpy() for c in ("node", "family", "left"))
        sig = _signatures(t.column("sig"))
        found = [pair for x, y in zip(starts, starts[1:]) for pair in _joining(node[x:y], sig[x:y], family[x:y], left[x:y])]
        return pa.record_batch([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], names=["a", "b"])

    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
        if held.num_rows:
            at = np.stack([held.column(c).to_numpy() for c in ("key", "outer", "block")])
            starts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist()]
            # the last run may go on in the next batch
            if len(starts) > 1:
                yield run(held.slice(0, starts[-1]), starts)
                held = held.slice(starts[-1])
    if held is not None and held.num_rows:
        yield run(held, [0, held.num_rows])


def _compare_blocks(words: int, percent: int):
    """Links that join different components between one block of outsiders and one block of the family."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if left.num_rows and right.num_rows:
            sig = _signatures(right.column("sig"))
            right_sets = list(shingle_sets(text_bytes(right.column("text").combine_chunks()), words))
            right_id, right_root = right.column("node").to_pylist(), right.column("root").to_pylist()
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while x in up:
                    x = up[x]
                return x

            for u, c, s, own in zip(left.column("node").to_pylist(), left.column("root").to_pylist(), left.column("sig").to_pylist(), shingle_sets(text_bytes(left.column("text").combine_chunks()), words)):
                apart = (sig != np.frombuffer(s, "<u2")[None, :]).sum(axis=1)
                for i in np.argsort(apart, kind="stable"):
                    if apart[i] > DISTANCE:
                        break
                    mine, other = root(c), root(right_root[i])
                    if mine != other and similar(own, right_sets[i], percent):
                        up[max(mine, other)] = min(mine, other)
                        out_a.append(u)
                        out_b.append(right_id[i])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def numbered() -> Column:
    """What tells classes apart and orders them under a key."""
    return F.monotonically_increasing_id()


def _linked(docs: DataFrame, id_column: str, text: str, words: int, percent: int) -> DataFrame:
    """Per row: ``id``, ``h`` (a hash of its text), ``n`` shingles, and its group's ``root`` and smallest id, ``component``, null where it links nothing."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = staged(plain.mapInArrow(_sketches(words), "id long, h long, n long, digest binary, sig binary"), "sketches")
    since = staged_so_far()
    classes = rows.where("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "h")).alias("least"), F.min("sig").alias("sig"))
    # numbered where they are written, so a number stands for one class from here on
    classes = staged(classes.select("digest", "least.id", "least.h", "sig", numbered().alias("node")), "classes")

    met = classes.select("node", "sig").mapInArrow(_local_pivots, _PAIRS)
    lowest = F.min("a").over(W.partitionBy("key").orderBy("a").rowsBetween(W.unboundedPreceding, 0))
    pivots = met.where("b is null").select("key", lowest.alias("pivot"), "a").where("a <> pivot").select("key", F.col("pivot").alias("a"), F.col("a").alias("b"))
    pivots = staged(pivots, "pivots")
    sigs = classes.select("node", "sig")
    apart = pivots.select("a", "b").distinct()
    for end in ("a", "b"):
        apart = apart.join(sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}")), end)
    apart = staged(apart.select("a", "b", (_distance("sig_a", "sig_b") <= DISTANCE).alias("near")), "apart")
    far = apart.where("not near").select("a", "b").join(pivots, ["a", "b"]).select("key", "a", "b", F.lit(False).alias("near"))
    apart = staged(apart.where("near").select(F.lit(None).cast("long").alias("key"), "a", "b", "near").union(far).union(met.where("b is not null")), "edges")
    edges = apart.where("near").select("a", "b").union(_bridges(apart, pivots, classes)).distinct()

    wanted = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "id", "h"), "node")
    # one plan at every size: texts meet their classes by a shuffle even while the classes are few
    texts = staged(plain.where("id is not null").join(wanted.hint("merge"), ["id", "h"]).groupBy("node").agg(F.min("text").alias("text")), "texts")
    pairs = edges.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    checked = staged(pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(words, percent), "a long, b long, linked boolean"), "checked")
    roots = _settled(components(checked.where("linked")), checked, classes, texts, words, percent)

    labels = classes.join(roots, "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    names = labels.groupBy("root").agg(F.min("id").alias("component"))
    labels = staged(labels.join(names, "root").select("digest", "root", "component"), "labels")
    drop_staged(spark, since)
    own = [F.when(F.col("id").isNotNull(), F.col(c)).alias(c) for c in ("root", "component")]
    return rows.join(labels, "digest", "left").select("id", "h", "n", *own)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the smallest id that links of at least ``percent``
    reach, the row's own included; ``kept`` marks the rows that have it.
    A-Z count as a-z. A text of fewer than ``words`` words is one shingle. A null
    or wordless text has none, is linked with nothing and is kept. Rows are linked
    by their own texts, also where an id is repeated. A row without an id links
    nothing: its component is null and it is kept. An empty table gives no rows.
    """
    linked = _linked(docs, id_column, text, words, percent)
    component = F.coalesce("component", "id")
    return linked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the smallest id.

    Of rows with that id in the group, one stays: the one whose text, and then
    whose other values, hash lowest. Rows without an id or without words stay. All
    columns pass through. An empty table gives no rows.
    """
    since = staged_so_far()
    linked = _linked(docs, id_column, text, words, percent).where("root is not null")
    counted = staged(linked.groupBy("root", "id", "h").agg(F.count("*").alias("copies")), "copies")
    chosen = counted.groupBy("root").agg(F.min(F.struct("id", "h")).alias("first"))
    told = counted.join(chosen, "root").select("id", "h", (F.struct("id", "h") == F.col("first")).alias("first"), "copies")
    # only rows that go, or stay once of several, need to be told
    told = staged(told.where("not first or copies > 1").select("id", "h", "first"), "told")
    drop_staged(docs.sparkSession, since)
    name, number, at, of = (hidden(docs, stem) for stem in ("told", "number", "at", "of"))
    own, h = F.col(id_column).cast("long"), F.xxhash64(F.col(text).cast("string"))
    told = told.select(F.col("id").alias(at), F.col("h").alias(of), F.col("first").alias(name))
    met = docs.join(told, (own == F.col(at)) & (h == F.col(of)), "left")
    by = [F.col(f.name) for f in docs.schema if isinstance(f.dataType, T.AtomicType)]
    several = met.where(F.col(name)).withColumn(number, F.row_number().over(W.partitionBy(at, of).orderBy(F.xxhash64(*by))))
    return met.where(F.col(name).isNull()).select(*docs.columns).union(several.where(F.col(number) == 1).select(*docs.columns))


def _bridges(apart: DataFrame, pivots: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates that join families which share a key with a pivot too far from one of them."""
    nothing = apart.limit(0).select("a", "b")
    if not apart.where("not near").take(1):
        return nothing
    families = components(apart.where("near"))
    far = apart.where("not near")
    for end in ("a", "b"):
        far = far.join(families.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    torn = staged(far.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("key").distinct(), "torn")
    if not torn.take(1):
        return nothing
    nodes = apart.select(F.explode(F.array("a", "b")).alias("node")).union(pivots.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    under = classes.select("node", "sig").join(nodes, "node", "left_semi").mapInArrow(_all_keys, "key long, node long").join(torn, "key", "left_semi")
    members = staged(under.join(families, "node", "left").select("key", "node", F.coalesce("root", "node").alias("family")), "keyed")
    counts = members.groupBy("key", "family").agg(F.count("*").alias("n"))
    largest = counts.groupBy("key").agg(F.max_by("family", F.struct("n", -F.col("family"))).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    largest = largest.where("n > 2 and n > most").select("key", "largest", F.ceil(F.col("n") / KEY_BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / KEY_BLOCK).alias("outer_blocks"))
    full = members.join(largest, "key").join(classes.select("node", "sig"), "node")
    mine, outer = F.pmod(F.xxhash64("node"), "blocks"), F.pmod(F.xxhash64("node"), "outer_blocks")
    left = full.where("family <> largest").select("key", outer.alias("outer"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", "sig", "family", F.lit(True).alias("left"))
    right = full.select("key", F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("outer"), mine.alias("block"), "node", "sig", "family", F.lit(False).alias("left"))
    by = ("key", "outer", "block")
    return staged(left.union(right).repartition(*by).sortWithinPartitions(*by).mapInArrow(_join_families, "a long, b long").distinct(), "bridges")


def _settled(roots: DataFrame, checked: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Roots after comparing, within each family of candidates, what the pivots left unconnected."""
    ends = checked.where("not linked")
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    open_links = staged(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b").distinct(), "open")
    if not open_links.take(1):
        return roots
    families = components(open_links).select(F.col("node").alias("root"), F.col("root").alias("family"))
    nodes = classes.select("node", "sig").join(roots, "node", "left").select("node", "sig", F.coalesce("root", "node").alias("root"))
    members = staged(nodes.join(families, "root"), "members")
    counts = members.groupBy("family", "root").agg(F.count("*").alias("n"))
    largest = counts.groupBy("family").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most"))
    # two members that a pivot kept apart have been compared already
    largest = largest.where("n > 2").select("family", "largest", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("most")) / BLOCK).alias("outer_blocks"))
    full = members.join(largest, "family").join(texts, "node")
    own, outer = F.pmod(F.xxhash64("node"), "blocks"), F.pmod(F.xxhash64("node"), "outer_blocks")
    values = [F.col(c).alias(c) for c in ("node", "root", "sig", "text")]
    family = F.col("family").alias("family")
    left = full.where("root <> largest").select(family, outer.alias("outer"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *values)
    right = full.select(family, F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("outer"), own.alias("block"), *values)
    by = ("family", "outer", "block")
    found = staged(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_compare_blocks(words, percent), "a long, b long"), "found")
    if not found.take(1):
        return roots
    merged = found
    for end in ("a", "b"):
        merged = merged.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left")
    joined = components(merged.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    singles = found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.union(singles).join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
