"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by three rounds of random signs and a fast Hadamard
transform; its hash is the axis it then lies closest to, with the sign. A table
joins three such hashes and the label into a bucket. Every vector is stored in
its own bucket of each table and also looks into the buckets of the runner-up
axes (multiprobe). Pairs that meet are verified by cosine in double precision.

Vectors with equal label and components are one entry with a count, so copies
never meet pair by pair. Bucket keys travel without vectors; axes and vector
join only the keys of buckets where someone is met. A bucket with many entries
is cut into blocks, and pairs of blocks are compared apart. A pair that meets in
several tables counts in the first of them only, which both entries' axes
tell, so no list of pairs is kept to find repeats: a task returns link counts
and spanning forests of what it linked.

Vectors that are null, empty, zero or hold a null or non-finite component, or
whose label is null, link with nothing. Labels may be of any type that can be
grouped. Vectors of different lengths under one label don't compare. Repeated
rows count as vectors of their own; a null vec_id takes part but is never a
component's id unless all are null. An empty table gives an empty result, and
other columns of the input are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfline.llm.common import components
from shelfline.session import stored

#: A random pair at the threshold itself misses all tables with a probability of some 6e-9 at 64 dimensions, 4e-7 at 384.
THRESHOLD, TABLES, HASHES, PROBES, SEED = 0.98, 12, 3, 3, 11
#: Entries of a bucket that are compared in one block, and rows of a block whose cosines are held at a time.
BLOCK, STRIP = 4096, 64
#: Rows a task gathers before it compares them, and components of the pairs that are verified at a time.
GATHERED, VERIFIED = 8192, 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def hashes(unit: np.ndarray, table: int) -> np.ndarray:
    """For each row and each hash of a table, the PROBES closest axes (signed axis as 2 * axis + sign)."""
    width = padded_width(unit.shape[1])
    padded = np.pad(unit, ((0, 0), (0, width - unit.shape[1])))
    found = []
    for k in range(HASHES):
        turned = padded
        signs = np.random.default_rng([SEED, table, k, width]).choice([-1.0, 1.0], (3, width))
        for s in signs:
            turned = hadamard(turned * s)
        near = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :PROBES]
        found.append(2 * near + (np.take_along_axis(turned, near, 1) < 0))
    return np.stack(found, 1)


def padded_width(n: int) -> int:
    """A power of two, at least 16: the few sign patterns of narrower vectors don't make independent rotations."""
    return 1 << max(4, (n - 1).bit_length())


def probes(axes: np.ndarray, width: int) -> np.ndarray:
    """Bucket keys (row, table, probe) of axes (row, table, hash, probe): the own key first, then one hash replaced by a runner-up."""
    base = np.int64(2 * padded_width(width))
    places = base ** np.arange(HASHES, dtype=np.int64)
    axes = axes.astype(np.int64)
    own = (axes[..., 0] * places).sum(-1)
    keys = [own]
    for k in range(HASHES):
        keys += [own + (axes[..., k, p] - axes[..., k, 0]) * places[k] for p in range(1, PROBES)]
    return np.stack(keys, -1)


def _axes_type(width: int) -> type:
    return np.uint16 if padded_width(width) <= 1 << 15 else np.int32


def _vectors(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Unit vectors in double precision of lists that all have `width` components."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    unit = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    # The largest component is taken out first, so squares neither overflow nor vanish.
    unit = unit / np.abs(unit).max(axis=1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def _axes(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _axes_type(width)).reshape(-1, TABLES, HASHES, PROBES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batch with each entry's number of components and its axes in all tables."""
    for batch in batches:
        v = batch.column(batch.schema.get_field_index("v"))
        widths = v.value_lengths().to_numpy(zero_copy_only=False)
        packed = np.empty(len(v), object)
        for width in np.unique(widths).tolist():
            some = np.flatnonzero(widths == width)
            unit = _vectors(v.take(pa.array(some)), width)
            axes = np.stack([hashes(unit, t) for t in range(TABLES)], 1).astype(_axes_type(width))
            for i, row in zip(some.tolist(), axes):
                packed[i] = row.tobytes()
        added = [pa.array(widths, pa.int32()), pa.array(packed.tolist(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "width", "axes"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each entry and bucket key: label, entry, width, tab, key, own."""
    for batch in batches:
        label, entry, widths, axes = (batch.column(batch.schema.get_field_index(c)) for c in ("label", "entry", "width", "axes"))
        widths = widths.to_numpy()
        for width in np.unique(widths).tolist():
            some = np.flatnonzero(widths == width)
            keys = probes(_axes(axes.take(pa.array(some)), width), width)
            probe = np.tile(np.arange(keys.shape[2]), len(some) * TABLES)
            rows = pa.array(np.repeat(some, keys[0].size))
            yield pa.RecordBatch.from_arrays(
                [label.take(rows), entry.take(rows), pa.array(np.full(len(rows), width, np.int32)),
                 pa.array(np.tile(np.repeat(np.arange(TABLES, dtype=np.int32), keys.shape[2]), len(some))),
                 pa.array(keys.ravel()), pa.array(probe == 0)],
                names=["label", "entry", "width", "tab", "key", "own"])


LINKS = pa.schema([("entry", pa.int64()), ("to", pa.int64()), ("links", pa.int64())])
BUCKET = ("label", "width", "tab", "key")


def _met(keys: np.ndarray, a: np.ndarray, b: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether pairs (a, b) meet in a table before their `table`: the own key of one is among the keys of the other."""
    met = np.zeros(len(a), bool)
    for t in range(int(table.max(initial=0))):
        ask = np.flatnonzero(~met & (table > t))
        x, y = a[ask], b[ask]
        met[ask] = (keys[x, t, 0][:, None] == keys[y, t]).any(1) | (keys[y, t, 0][:, None] == keys[x, t]).any(1)
    return met


class _Forest:
    """Union-find over the rows at hand."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Places of the links that join parts which no earlier link joined."""
        kept = []
        for at in range(0, len(a), 4096):
            flat = self.parent[self.parent]
            while not np.array_equal(flat, self.parent):
                self.parent, flat = flat, flat[flat]
            new = at + np.flatnonzero(flat[a[at:at + 4096]] != flat[b[at:at + 4096]])
            parent = self.parent
            for k in new.tolist():
                x, y = a[k], b[k]
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    kept.append(k)
        return kept


def _near(unit: np.ndarray, own: np.ndarray, block: np.ndarray, low: int, high: int, start: int, end: int) -> Iterator[tuple]:
    """Pairs of rows of one bucket, or of two blocks of it, that are near and of which one at least is at home there.

    Rows are sorted by block, then those at home first.
    """
    if low == high:
        first, upto, right = start, start + int(own[start:end].sum()), start
    else:
        right = start + int(np.searchsorted(block[start:end], high)) if low < high else start
        first, upto = start, right
    for at in range(first, upto, STRIP):
        x, y = np.nonzero(unit[at:min(upto, at + STRIP)] @ unit[right:end].T >= THRESHOLD - 1e-9)
        a, b = x + at, y + right
        fine = a < b if low == high else own[a] | own[b]
        if fine.any():
            yield a[fine], b[fine]


def _links(rows: pa.Table, width: int) -> pa.RecordBatch:
    """Links of whole buckets or pairs of blocks, all of one width, that no earlier table has."""
    entry, copies, table, key, own, block, low, high = (
        rows.column(c).to_numpy() for c in ("entry", "copies", "tab", "key", "own", "block", "low", "high"))
    unit, keys = _vectors(rows.column("v"), width), probes(_axes(rows.column("axes"), width), width)
    n = len(entry)
    starts = _starts(rows)
    links, forest, tree = np.zeros(n, np.int64), _Forest(n), []

    def verify(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), max(1, VERIFIED // width)):
            x, y = (side[at:at + max(1, VERIFIED // width)] for side in (a, b))
            fine = np.einsum("ij,ij->i", unit[x], unit[y]) >= THRESHOLD
            x, y = x[fine], y[fine]
            fine = ~_met(keys, x, y, table[x])
            x, y = x[fine], y[fine]
            # A pair may meet twice in one table, once in each one's own bucket: it counts where the smaller entry is at home.
            less, more = np.where(entry[x] < entry[y], x, y), np.where(entry[x] < entry[y], y, x)
            t = table[x]
            twice = (keys[more, t, 0][:, None] == keys[less, t]).any(1) & (keys[less, t, 0][:, None] == keys[more, t]).any(1) \
                & (keys[more, t, 0] != keys[less, t, 0])
            fine = ~twice | own[less]
            x, y = x[fine], y[fine]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            tree.extend((entry[x[k]], entry[y[k]]) for k in forest.add(x, y))

    waiting, held = [], 0
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        if end - start > 1:
            for pair in _near(unit, own, block, low[start], high[start], start, end):
                waiting.append(pair)
                held += len(pair[0])
                if held * width >= VERIFIED:
                    verify(*map(np.concatenate, zip(*waiting)))
                    waiting, held = [], 0
    if waiting:
        verify(*map(np.concatenate, zip(*waiting)))
    some = np.flatnonzero(links)
    tree = np.array(tree, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([entry[some], tree[:, 0]])), pa.array(np.concatenate([entry[some], tree[:, 1]])),
        pa.array(np.concatenate([links[some], np.zeros(len(tree), np.int64)]))], schema=LINKS)


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new bucket or pair of blocks begins."""
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
    other = np.zeros(max(0, len(label) - 1), bool)
    for column in (label, *(rows.column(c).to_numpy() for c in ("width", "tab", "key", "low", "high"))):
        other |= column[1:] != column[:-1]
    return np.concatenate([np.zeros(min(1, len(label)), np.int64), 1 + np.flatnonzero(other)])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted rows; the last bucket at hand waits until the next one begins."""

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        widths = rows.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            yield _links(rows.filter(pa.array(widths == width)), width)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= GATHERED:
            rows = pa.Table.from_batches(held)
            last = int(_starts(rows)[-1])
            if last:
                yield from whole(rows.slice(0, last))
                held = rows.slice(last).to_batches()
            n = min(n - last, GATHERED - 1)
    if held and sum(b.num_rows for b in held):
        yield from whole(pa.Table.from_batches(held))


def _schema(df: DataFrame, **added: str) -> StructType:
    schema = StructType(list(df.schema.fields))
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return schema


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    usable = F.col("label").isNotNull() & F.coalesce(
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select("vec_id", "label", usable.alias("usable"), F.when(usable, F.col("embedding")).alias("v"))
    # An entry's number is its place; numbers are made once and stored.
    entries = rows.where("usable").groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first_id"))
    entries = entries.select("label", "v", "copies", "first_id", F.monotonically_increasing_id().alias("entry"))
    entries = stored(entries.mapInArrow(_hashed, _schema(entries, width="integer", axes="binary")), "vector-entries")
    keyed = entries.select("label", "entry", "width", "axes").mapInArrow(
        _keyed, _schema(entries.select("label"), entry="long", width="integer", tab="integer", key="long", own="boolean"))
    sizes = keyed.groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own") \
        .select(*BUCKET, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, list(BUCKET)) \
        .withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(*BUCKET, "entry", "own", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    carried = dealt.join(entries.select("entry", "copies", "axes", "v"), "entry")
    found = carried.repartition(*BUCKET, "low", "high") \
        .sortWithinPartitions(*BUCKET, "low", "high", "block", F.desc("own")) \
        .mapInArrow(_compared, "entry long, to long, links long")
    found = stored(found, "vector-links")
    linked = found.where("links > 0").groupBy("entry").agg(F.sum("links").alias("others"))
    roots = components(found.where("links = 0").select(F.col("entry").alias("a"), F.col("to").alias("b")))
    placed = entries.join(roots.select(F.col("node").alias("entry"), "root"), "entry", "left") \
        .join(linked, "entry", "left").withColumn("root", F.coalesce("root", "entry"))
    placed = stored(placed.select("label", "v", "copies", "first_id", "root", F.coalesce("others", F.lit(0)).alias("others")), "vector-classes")
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = placed.join(least, "root").select("label", "v", (F.col("copies") - 1 + F.col("others")).alias("n_links"), "component_id")
    joined = rows.where("usable").join(classes, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = joined.unionByName(alone)
    return both.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
