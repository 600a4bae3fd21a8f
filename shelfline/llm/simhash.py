"""SimHash near-duplicates by meeting in the middle.

Two fingerprints that differ in at most four bits have a common variant within
two bits of each. So every distinct fingerprint emits all its variants within
two flipped bits (1 + 64 + 2016 of them), variants are shuffled, and
fingerprints that meet on a variant are linked and verified.

All variants at once would take some 20 kB a fingerprint. The variant space is
therefore cut into eight slices (more for very many fingerprints) by a linear
colour: bit i has colour i mod 8, and a variant's slice is the exclusive-or of
the colours of its set bits. A
fingerprint knows which flips lead into a slice, so slices are made one after
another without generating the rest, and the shuffle files of one slice are
gone before the next. Variants travel packed: eight bytes for the variant and
two for the flip that led to it.

Fingerprints that share a variant are all within four bits of one another.
Hence a bucket is linked as a chain, and of the chains of all buckets in a group of the
shuffle only a spanning forest is kept: k near copies cost at most k - 1 links a
group, however many variants they share, and the components stay exact.

Copies meet as one fingerprint before any variant is made. Null and empty texts
have fingerprint zero. Rows with a null doc_id take part; a component's id is
the smallest non-null doc_id in it. Repeated rows give repeated result rows.
The bits of a very long text are counted STEP_HASHES shingles at a time. An
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import components, kept_path, per_batch
from shelfline.session import remove_path, stored

BITS, RADIUS, SEED = 64, 4, 42
#: Slices; doubled up to BITS while the groups of a slice would be more than GROUPS.
COLOURS = 8
#: Variants in one group of the shuffle (ten bytes each), and the most groups that rows are packed for.
GROUP_VARIANTS, GROUPS = 500_000, 1 << 16
#: Hashes whose bits are counted in one step.
STEP_HASHES = 1 << 16


def _flips() -> np.ndarray:
    """All masks of up to RADIUS / 2 = 2 set bits."""
    ones = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    i, j = np.triu_indices(BITS, 1)
    return np.concatenate([np.zeros(1, np.uint64), ones, ones[i] | ones[j]])


FLIPS = _flips()


def colour(values: np.ndarray, colours: int) -> np.ndarray:
    """Exclusive-or of (i mod colours) over the set bits i."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    weights = np.arange(BITS) % colours
    return sum(((bits[:, weights & (1 << k) > 0].sum(1) & 1) << k) for k in range(colours.bit_length() - 1))


def shingle_hashes(words: list[bytes], size: int = 4) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    ahead = zip(*(words[k:] for k in range(size)))
    return np.fromiter((digest(b" ".join(s), SEED) for s in ahead), np.uint64, len(words) - size + 1)


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit fingerprint. bytes.split() parts at exactly the six blanks, bytes.lower() changes A-Z only."""
    hashes = shingle_hashes((text or b"").lower().split())
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), STEP_HASHES):
        part = hashes[at:at + STEP_HASHES]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long) for every row."""
    return per_batch(docs.select("doc_id", "text"),
                     lambda c: {"doc_id": c["doc_id"], "fp": [fingerprint(t) for t in c["text"]]},
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _emit(part: int, colours: int, groups: int):
    """The variants of one slice, packed by group."""
    of_flip = colour(FLIPS, colours)
    flips_of = [np.flatnonzero(of_flip == c).astype(np.uint16) for c in range(colours)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            found, flips = [], []
            own = colour(values, colours)
            for c in range(colours):
                mine, kind = values[own == c], flips_of[c ^ part]
                found.append((mine[:, None] ^ FLIPS[kind]).ravel())
                flips.append(np.tile(kind, len(mine)))
            found, flips = np.concatenate(found), np.concatenate(flips)
            group = ((found * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
            order = np.argsort(group.astype(np.uint16), kind="stable")
            found, flips = found[order], flips[order]
            ends = np.cumsum(np.bincount(group.astype(np.int64), minlength=groups))
            rows = [(g, s, e) for g, s, e in zip(range(groups), [0, *ends[:-1]], ends) if e > s]
            yield pa.RecordBatch.from_pydict({
                "grp": pa.array([g for g, _, _ in rows], pa.int32()),
                "variants": pa.array([found[s:e].tobytes() for _, s, e in rows], pa.binary()),
                "flips": pa.array([flips[s:e].tobytes() for _, s, e in rows], pa.binary())})

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of the links (a, b) that span their components without a cycle.

    In each round every root that has a link to a smaller one takes the first such
    link, so no cycle can close, and paths are shortened.
    """
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    ends = ends.reshape(2, -1)
    root, left, taken = np.arange(len(nodes)), np.arange(len(a)), []
    while len(left):
        low, high = np.sort(root[ends[:, left]], axis=0)
        left, low, high = (x[low != high] for x in (left, low, high))
        hooked, first = np.unique(high, return_index=True)
        root[hooked] = low[first]
        taken.append(left[first])
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate([np.zeros(0, np.int64), *taken])


def _meet(packed: pa.Table) -> pa.Table:
    """Links that span the groups of fingerprints that share a variant: fewer than there are fingerprints."""
    variants = np.frombuffer(b"".join(packed.column("variants").to_pylist()), np.uint64)
    flips = np.frombuffer(b"".join(packed.column("flips").to_pylist()), np.uint16)
    order = np.argsort(variants)
    variants = variants[order]
    same = np.flatnonzero(variants[1:] == variants[:-1])
    a, b = (variants[same + k] ^ FLIPS[flips[order[same + k]]] for k in (0, 1))
    kept = _forest(a, b)
    return pa.table({"a": a[kept].view(np.int64), "b": b[kept].view(np.int64)})


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct values of `fp` within RADIUS bits; stored in the shared folder."""
    spark, paths = fps.sparkSession, []
    own = kept_path(fps.select("fp").where("fp is not null").distinct(), "fingerprints")
    values = spark.read.parquet(own)
    count = values.count()
    colours = COLOURS
    while colours < BITS and count * len(FLIPS) > colours * GROUPS * GROUP_VARIANTS:
        colours *= 2
    groups = min(GROUPS, 1 + count * len(FLIPS) // colours // GROUP_VARIANTS)
    for part in range(colours):
        packed = values.mapInArrow(_emit(part, colours, groups), "grp int, variants binary, flips binary")
        paths.append(kept_path(packed.groupBy("grp").applyInArrow(_meet, "a long, b long"), f"slice{part}"))
    found = spark.read.parquet(*paths).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    path = kept_path(found, "fingerprint-links")
    for old in (own, *paths):
        remove_path(spark, old)
    return spark.read.parquet(path)


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id for every row."""
    fps = stored(fingerprints(docs), "simhash")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = components(ball_links(fps))
    placed = first.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    placed = stored(placed, "simhash-roots")
    linked = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    where = stored(placed.join(linked, "root").select("fp", "component_id"), "simhash-classes")
    return fps.join(where, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One row of each group, the one with the smallest (doc_id, text, row number); columns as given.

    Rows are judged by a stored row number, so rows that repeat a doc_id are
    judged each for itself. A row without a doc_id gives way to the first such
    row of its group only.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    numbered = stored(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    rows = numbered.select(F.struct("doc_id", F.col(number).alias("row")).alias("doc_id"), "text")
    fps = stored(fingerprints(rows).select("doc_id.doc_id", "doc_id.row", "fp"), "simhash")
    none = F.col("doc_id").isNull().alias("none")
    # The smallest id of a fingerprint, then of a group: combining aggregates. n rows share it, `row` is the first.
    per_id = fps.groupBy("fp", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    per_fp = per_id.groupBy("fp", none).agg(F.min(F.struct("doc_id", "n", "row")).alias("k"))
    roots = components(ball_links(fps)).select(F.col("node").alias("fp"), "root")
    rooted = stored(per_fp.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "none", "k.*"), "simhash-roots")
    per_root = rooted.groupBy("root", "doc_id").agg(F.sum("n").alias("n"), F.min("row").alias("row"))
    led = stored(per_root.groupBy("root", none).agg(F.min(F.struct("doc_id", "n", "row")).alias("k")).select("root", "k.*"), "simhash-led")
    # Only where several rows share the smallest id their texts decide.
    tied = rooted.join(led.where("n > 1").select("root", F.col("doc_id").alias("least")), "root").where("doc_id <=> least") \
        .select("root", "fp", F.col("doc_id").alias("least"))
    tied = fps.join(tied, "fp").where("doc_id <=> least").select("root", "least", "row")
    texts = numbered.select(F.col(number).alias("row"), "text")
    first = tied.join(texts, "row").groupBy("root", "least").agg(F.min(F.struct("text", "row")).alias("k")).select("k.row")
    kept = led.where("n = 1").select("row").unionByName(first)
    lost = stored(fps.select("row").join(kept, "row", "left_anti"), "simhash-lost")
    return numbered.join(lost.withColumnRenamed("row", number), number, "left_anti").select(*docs.columns)
