"""Phrase collocation mining with double-array tries.

Texts are parsed once: each task joins them by language into rows of about ROW_BYTES,
stores a row's words as local codes (0 where a piece ends) and lists its distinct
words with their counts. Those lists, not the texts, are shuffled: they give every
word's frequency. Each row then gets the global numbers of its frequent words, from a broadcast
if there are at most SHARD_PHRASES of them, else by a join.

Then phrases grow by one word a round. The frequent phrases of a round are cut into shards of
at most SHARD_PHRASES, and a task builds each shard's double-array trie (`Trie`),
whose size is bounded by that number. A shard is broadcast, and a pass over the stored codes
advances the states of all text positions of a row together, one trie level after
another. Accepting states are counted by bincount, summed within the task, then over the tasks:
these sums are the phrases' frequencies. The same pass names the candidates
of the next round: an accepting position and the word behind it, where (with a
single shard) the next position accepts as well, so both shorter parts of a candidate
are frequent. The candidates' own support, summed over all texts, must reach
`least`; nothing that is frequent can be missed, and no pairs are made that no text holds.
Pairs of (phrase, word) are merged within a task and shuffled as sorted, compressed numbers by hash group.

Passes follow the number of shards. Cuts are looked up by joins on word numbers, and
products are decimals of 38 digits.

A null lang is `und`; null and empty texts hold no word. Repeated rows count again, doc_id is not read.
A piece (text between two boundary characters) is never cut, so a row is as long as its
longest piece at least. Ties are ranked by the phrase's bytes. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import arrow_schema, kept_path
from shelfline.llm.places import placed
from shelfline.session import stored

LONGEST, LEAST, TOP = 5, 100, 2000
ROW_BYTES = 32 << 20
SHARD_PHRASES = 1 << 18
#: Pairs that a task holds before it sends them; words of all texts for each group in which pairs are summed.
HELD_PAIRS, GROUP_WORDS = 4_000_000, 2_000_000
#: Places tried at once and how often, before a node's children go behind all others; from how many children on they are many.
TRIED, TRIALS, MANY = 4096, 64, 8

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BOUNDARY = re.compile(rb"[.,;:!?\n-\r]")
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
ROW_SCHEMA = "row long, lang string, codes binary, words array<binary>, counts array<long>"


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ROW_BYTES that end at a boundary."""
    at = 0
    while at < len(text):
        cut = _BOUNDARY.search(text, at + ROW_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def codes_of(text: bytes) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Codes (1 and up in order of appearance, 0 between pieces), distinct words, their counts."""
    raw = np.frombuffer(text.translate(_LOWER), np.uint8)
    kind = _KIND[raw]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int32) + 1
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    counts = np.bincount(codes, minlength=1)[1:]
    return np.insert(codes, np.flatnonzero(np.diff(piece)) + 1, 0), coded.dictionary, counts


def parse(docs: DataFrame) -> DataFrame:
    """Rows of joined texts of one language; see ROW_SCHEMA."""
    target = arrow_schema(ROW_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, parts in held.items():
                codes, words, counts = codes_of(b"\n".join(parts))
                parts.clear()
                if len(codes):
                    made += 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array([task << 32 | made], pa.int64()), pa.array([lang], pa.string()),
                        pa.array([zstandard.ZstdCompressor(1).compress(codes.tobytes())], pa.binary()),
                        pa.array([words.cast(pa.binary())], target.field("words").type),
                        pa.array([counts.astype(np.int64)], target.field("counts").type)], schema=target)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                for part in pieces(text.as_py() or b""):
                    held.setdefault(lang, []).append(part)
                    size += len(part)
                    if size >= ROW_BYTES:
                        yield from flush()
                        held, size = {}, 0
        yield from flush()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string")).mapInArrow(run, ROW_SCHEMA)


class Trie:
    """Double-array trie of phrases of equal length: a child of state s by code c is t = base[s] + c where check[t] = s.

    State 1 is the root, 0 is dead. Codes 1 and up number the words of the shard, the
    most frequent first; `alphabet` holds their global numbers ascending, `rank` their codes.
    """

    def __init__(self, alphabet: np.ndarray, rank: np.ndarray, base: np.ndarray, check: np.ndarray, phrase: np.ndarray):
        self.alphabet, self.rank, self.base, self.check, self.phrase = alphabet, rank, base, check, phrase

    FIELDS = {"alphabet": np.int64, "rank": np.int32, "base": np.int32, "check": np.int32, "phrase": np.int64}

    @classmethod
    def build(cls, ids: np.ndarray, phrase: np.ndarray) -> Trie:
        """ids: one phrase a row, as global word numbers; phrase: what its accepting state stands for."""
        alphabet, seen = np.unique(ids, return_inverse=True)
        seen = seen.reshape(ids.shape)
        rank = np.empty(len(alphabet), np.int32)
        rank[np.argsort(-np.bincount(seen.ravel(), minlength=len(alphabet)), kind="stable")] = np.arange(1, len(alphabet) + 1)
        codes = rank[seen]
        order = np.lexsort(codes.T[::-1])
        codes, phrase = codes[order], phrase[order]
        places = _Places(len(alphabet))
        state = np.ones(len(codes), np.int64)
        for level in codes.T:
            new = np.ones(len(state), bool)
            new[1:] = (state[1:] != state[:-1]) | (level[1:] != level[:-1])
            edges = np.flatnonzero(new)
            state = places.add(state[edges], level[edges].astype(np.int64))[np.cumsum(new) - 1]
        base, check = places.arrays()
        accepts = np.full(len(base), -1, np.int64)
        accepts[state] = phrase
        return cls(alphabet, rank, base, check, accepts)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Codes of global word numbers, 0 for others."""
        at = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == words, self.rank[at], 0)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        there = self.base[states] + codes
        return np.where(self.check[there] == states, there, 0)

    def states(self, codes: np.ndarray, length: int) -> np.ndarray:
        """The state behind the `length` words that start at each position."""
        states = np.ones(len(codes), np.int32)
        for k in range(length):
            states = self.step(states[:len(codes) - k], codes[k:])
        return states

    def to_bytes(self) -> dict[str, bytes]:
        return {name: getattr(self, name).astype(kind).tobytes() for name, kind in self.FIELDS.items()}

    @classmethod
    def from_bytes(cls, parts: dict[str, bytes]) -> Trie:
        return cls(**{name: np.frombuffer(parts[name], kind) for name, kind in cls.FIELDS.items()})


class _Places:
    """First-fit places of children; the places up to the largest code stay free of children of the dead state."""

    def __init__(self, codes: int):
        self.codes = codes
        self.used = np.zeros(4 * codes + 1024, bool)
        self.used[:codes + 2] = True
        self.low = self.top = self.hint = codes + 2
        self.base: list[np.ndarray] = []
        self.check: list[np.ndarray] = []

    def _reach(self, end: int) -> None:
        if end >= len(self.used):
            self.used = np.concatenate([self.used, np.zeros(end + len(self.used), bool)])

    def _fit(self, offsets: np.ndarray) -> int:
        """First place from which all `offsets` are free; many children look behind where the last many went."""
        many = len(offsets) >= MANY
        at = self.hint if many else self.low
        for _ in range(TRIALS):
            self._reach(self.top + self.codes + TRIED)
            if at >= self.top:
                break
            free = np.flatnonzero(~self.used[at:at + TRIED]) + at
            for offset in offsets[1:]:
                free = free[~self.used[free + offset]]
                if not len(free):
                    break
            if len(free):
                at = int(free[0])
                break
            at += TRIED
        else:
            at = self.top
        if many:
            self.hint = at
        return at

    def add(self, parents: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Places for the edges (parent, code), given parent by parent; returns them and keeps base and check."""
        firsts = np.flatnonzero(np.diff(parents, prepend=-1))
        sizes = np.diff(firsts, append=len(parents))
        out = np.empty(len(parents), np.int64)
        for k in np.argsort(-sizes, kind="stable")[:int((sizes > 1).sum())]:
            mine = slice(firsts[k], firsts[k] + sizes[k])
            offsets = codes[mine] - codes[firsts[k]]
            place = self._fit(offsets)
            self._reach(place + int(offsets[-1]) + 1)
            out[mine] = place + offsets
            self.used[out[mine]] = True
            self.top = max(self.top, int(out[mine][-1]) + 1)
            while self.low < self.top and self.used[self.low]:
                gap = np.flatnonzero(~self.used[self.low:self.low + TRIED])
                self.low += int(gap[0]) if len(gap) else min(TRIED, len(self.used) - self.low)
        single = firsts[sizes == 1]
        self._reach(self.top + len(single) + 1)
        free = np.flatnonzero(~self.used[:self.top + len(single) + 1])[:len(single)]
        out[single] = free
        self.used[free] = True
        if len(free):
            self.top = max(self.top, int(free[-1]) + 1)
        self.base.append(np.stack([parents[firsts], out[firsts] - codes[firsts]]))
        self.check.append(np.stack([out, parents]))
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        size = self.top + self.codes + 2
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        for states, values in self.base:
            base[states] = values
        for places, parents in self.check:
            check[places] = parents
        return base, check


def _pack(keys: np.ndarray, n: np.ndarray, groups: int) -> pa.RecordBatch:
    """Sorted pairs and their counts, cut by a hash of the pair into groups; sorted numbers compress to a few bits each."""
    group = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
    order = np.argsort(group, kind="stable")
    keys, n, group = keys[order], n[order], group[order]
    starts = np.flatnonzero(np.diff(group, prepend=np.uint64(groups)))
    squeeze = zstandard.ZstdCompressor(1).compress
    # Differences byte by byte: the high bytes are runs of zeros.
    parts = [np.diff(k, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() for k in np.split(keys, starts[1:])]
    return pa.RecordBatch.from_arrays([
        pa.array(group[starts].astype(np.int64), pa.int64()), pa.array(map(squeeze, parts), pa.binary()),
        pa.array([squeeze(np.minimum(c, 255).astype(np.uint8).tobytes()) for c in np.split(n, starts[1:])], pa.binary()),
        pa.array([c[c >= 255].tobytes() for c in np.split(n, starts[1:])], pa.binary())], names=["grp", "pairs", "counts", "large"])


def _sum_pairs(rows: pa.Table) -> pa.Table:
    """Counts of every pair of a group over all tasks."""
    loose = zstandard.ZstdDecompressor().decompress
    keys, counts = [], []
    for pairs, few, large in zip(*(rows.column(c).to_pylist() for c in ("pairs", "counts", "large"))):
        raw = np.frombuffer(loose(pairs), np.uint8)
        keys.append(np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel()))
        n = np.frombuffer(loose(few), np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(large, np.int64)
        counts.append(n)
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return pa.table({"phrase": keys >> 32, "word": keys & 0xFFFFFFFF, "n": total})


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    each, at = np.unique(np.concatenate(keys), return_inverse=True)
    return each, np.bincount(at, np.concatenate(counts), len(each)).astype(np.int64)


def scan(texts: DataFrame, shard: dict[str, bytes] | None, length: int, whole: bool, grow: bool, groups: int = 1) -> DataFrame:
    """What follows, and how often, the phrases of `length` words: packed pairs of (phrase, word) by group.

    A phrase's own count is a pair with word 0. Without a shard, phrases
    are the single words themselves and only followers are counted. Phrase and word numbers must fit 31 and 32 bits.
    """
    sent = None if shard is None else texts.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None if sent is None else Trie.from_bytes(sent.value)
        total = None if trie is None else np.zeros(len(trie.base), np.int64)
        keys, counts, held = [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                codes = np.frombuffer(zstandard.ZstdDecompressor().decompress(batch.column(0)[k].as_py()), np.int32)
                at, number = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in (1, 2))
                known = np.zeros(max(int(codes.max()), int(at.max(initial=0))) + 1, np.int64)
                known[at] = number
                if trie is None:
                    states = np.where(known[codes] > 0, codes, 0)
                else:
                    states = trie.states(trie.codes(known)[codes], length)
                    total += np.bincount(states, minlength=len(total))
                if grow and len(states) > 1:
                    here = states[:-1] > 0
                    if whole:
                        here &= states[1:] > 0
                    here = np.flatnonzero(here)
                    behind = known[codes[here + length]]
                    fit = behind > 0
                    phrase = known[states[here[fit]]] if trie is None else trie.phrase[states[here[fit]]]
                    pairs, n = np.unique(phrase << 32 | behind[fit], return_counts=True)
                    keys.append(pairs)
                    counts.append(n)
                    held += len(pairs)
                    if held > HELD_PAIRS:
                        keys, counts = ([x] for x in _merged(keys, counts))
                        held = len(keys[0])
                        if held > HELD_PAIRS // 2:
                            yield _pack(keys[0], counts[0], groups)
                            keys, counts, held = [], [], 0
        if held:
            yield _pack(*_merged(keys, counts), groups)
        if trie is not None:
            hit = np.flatnonzero(total[1:]) + 1
            hit = hit[trie.phrase[hit] >= 0]
            hit = hit[np.argsort(trie.phrase[hit])]
            if len(hit):
                yield _pack(trie.phrase[hit] << 32, total[hit], groups)

    return texts.select("codes", "at", "number").mapInArrow(run, "grp long, pairs binary, counts binary, large binary")


def tries(phrases: DataFrame, name: str) -> DataFrame:
    """One row per shard of `phrases` (shard, phrase, ids) with the parts of its trie."""

    def run(rows: pa.Table) -> pa.Table:
        ids = np.stack([np.asarray(x, np.int64) for x in rows.column("ids").to_pylist()])
        made = Trie.build(ids, rows.column("phrase").to_numpy()).to_bytes()
        return pa.table({"shard": rows.column("shard")[:1].cast(pa.int64()), **{k: pa.array([v], pa.binary()) for k, v in made.items()}})

    return stored(phrases.select("shard", "phrase", "ids").groupBy("shard").applyInArrow(
        run, "shard long, " + ", ".join(f"{k} binary" for k in Trie.FIELDS)), name)


def _numbered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """codes, at, number of each row with a broadcast of at most SHARD_PHRASES words."""
    held = words.select("lang", "word", "number").toArrow()
    of = {lang: held.filter(pc.equal(held["lang"], lang)) for lang in held["lang"].unique().to_pylist()}
    sent = rows.sparkSession.sparkContext.broadcast(
        {lang: (t["word"].combine_chunks().cast(pa.binary()), t["number"].to_numpy().astype(np.int64)) for lang, t in of.items()})
    target = arrow_schema("codes binary, at array<int>, number array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                known, number = sent.value.get(batch.column(0)[k].as_py(), (None, None))
                if known is not None:
                    found = pc.index_in(batch.column(2)[k].values.cast(pa.binary()), value_set=known)
                    at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
                    if len(at):
                        number = number[found.drop_null().to_numpy()]
                        yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1).cast(pa.binary()), pa.array([(at + 1).astype(np.int32)], target.field("at").type),
                                                          pa.array([number], target.field("number").type)], schema=target)

    return rows.select("lang", "codes", "words").mapInArrow(run, "codes binary, at array<int>, number array<long>")


def texts_and_words(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored texts (codes, at, number), words (lang, word, f, number) and totals (lang, n)."""
    rows = stored(parse(docs), "phrase-rows")
    totals = rows.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    each = rows.select("row", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")) \
        .select("row", "lang", (F.col("at") + 1).alias("at"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    often = stored(each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrase-words")
    words = placed(often.withColumn("all", F.lit(0)), "all", ["lang", "word"], "phrase-order") \
        .select("lang", "word", "f", (F.col("pos") + 1).alias("number"))
    words = stored(words, "phrase-vocabulary")
    if words.count() <= SHARD_PHRASES:
        texts = _numbered(rows, words)
    else:
        numbers = each.select("row", "lang", "at", "word").join(words.select("lang", "word", "number"), ["lang", "word"]) \
            .groupBy("row").agg(F.collect_list(F.struct("at", "number")).alias("known"))
        texts = rows.select("row", "codes").join(numbers, "row").select("codes", F.col("known.at").alias("at"), F.col("known.number").alias("number"))
    return stored(texts, "phrase-texts"), words, stored(totals, "phrase-totals")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to `longest` words that occur `least` times (lang, ids, phrase, f), and words of each language (lang, n)."""
    texts, words, totals = texts_and_words(docs, least)
    singles = words.select("lang", F.array("number").alias("ids"), F.col("word").alias("phrase"), "f")
    found, counted = [singles], None
    spark = docs.sparkSession
    groups = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // GROUP_WORDS
    known = words.select(F.col("number").alias("nr"), "lang", F.array("number").alias("ids"), F.col("word").alias("phrase"))
    for length in range(1, longest + 1):
        grow = length < longest
        if length > 1:
            made = tries(known.select("shard", F.col("nr").alias("phrase"), "ids"), f"phrase-trie{length}")
            n_shards = made.count()
        else:
            made, n_shards = None, 1
        paths = []
        for k in range(n_shards):
            shard = None if made is None else {f: bytes(v) for f, v in made.where(F.col("shard") == k).drop("shard").first().asDict().items()}
            sums = scan(texts, shard, length, n_shards == 1, grow, groups).groupBy("grp").applyInArrow(
                _sum_pairs, "phrase long, word long, n long").where(F.col("n") >= least)
            paths.append(kept_path(sums, f"phrase-pass{length}"))
        if not paths:
            break
        sums = spark.read.parquet(*paths)
        if length > 1:
            counts = sums.where("word = 0").select(F.col("phrase").alias("nr"), F.col("n").alias("f"))
            found.append(stored(known.join(counts, "nr").select("lang", "ids", "phrase", "f"), f"phrase-found{length}"))
        if grow:
            after = words.select(F.col("number").alias("word"), F.col("word").alias("last"))
            next_ = sums.where("word > 0").select(F.col("phrase").alias("nr"), "word").join(known, "nr").join(after, "word") \
                .select("lang", F.concat("ids", F.array("word")).alias("ids"), F.concat("phrase", F.lit(b" "), "last").alias("phrase"), F.lit(0).alias("all"))
            next_ = placed(stored(next_, f"phrase-candidates{length + 1}"), "all", ["ids"], f"phrase-order{length + 1}")
            known = stored(next_.select(F.col("pos").alias("nr"), (F.expr(f"pos div {SHARD_PHRASES}")).alias("shard"), "lang", "ids", "phrase"),
                           f"phrase-known{length + 1}")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every, totals


def _part(start: Column | int, length: Column) -> Column:
    return F.slice("ids", start if isinstance(start, Column) else F.lit(start), length)


def product(x: str, y: str, factor: int = 1000) -> Column:
    """factor * x * y as an exact integer of up to 38 digits."""
    pair = (F.col(x).cast("decimal(19,0)") * F.col(y).cast("decimal(19,0)")).cast("decimal(34,0)")
    return (pair * F.lit(factor).cast("decimal(4,0)")).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `top` phrases by their weakest cut."""
    every, totals = frequent(docs, least, longest)
    size = F.size("ids")
    phrases = every.where(size > 1)
    f = every.select(F.col("ids").alias("part"), F.col("f").alias("of_part"))
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "lang", "phrase")
    cuts = cuts.withColumn("part", _part(1, F.col("k"))).join(f, "part").withColumnRenamed("of_part", "l").drop("part")
    cuts = cuts.withColumn("part", _part(F.col("k") + 1, size - F.col("k"))).join(f, "part").withColumnRenamed("of_part", "r").drop("part")
    cuts = cuts.join(totals, "lang").withColumn("_up", product("a", "n")).withColumn("_down", product("l", "r", 1)) \
        .withColumn("score", F.expr("_up div _down"))
    weakest = cuts.groupBy("ids", "lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.where(size > 2).select("ids", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), size - 1)).alias("len")) \
        .select("ids", "longer", "len", F.explode(F.sequence(F.lit(1), size - F.col("len") + 1)).alias("at")) \
        .select(_part(F.col("at"), F.col("len")).alias("ids"), "longer").groupBy("ids").agg(F.max("longer").alias("longer"))
    kept = weakest.join(inner, "ids", "left").where("longer is null or longer < a")
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase"))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top) \
        .select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


PHRASES_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[\x20\x09]+') IF x <> ''] AS words FROM p),
s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS ph, k AS size, count(*) AS f
    FROM s, range(1, {LONGEST + 1}) AS r(k) WHERE i + k - 1 <= len(words) GROUP BY ALL HAVING count(*) >= {LEAST} OR k = 1),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT *, string_split(ph, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (SELECT *, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:], ' ') AS rp FROM k),
t AS (SELECT x.lang, x.ph AS phrase, x.f AS a, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * x.f * n.n) // (l.f::HUGEINT * r.f) AS score, k
    FROM x JOIN f l ON l.lang = x.lang AND l.ph = x.lp JOIN f r ON r.lang = x.lang AND r.ph = x.rp JOIN n ON n.lang = x.lang),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT *, unnest(range(2, size)) AS g FROM c),
j AS (SELECT *, unnest(range(1, size - g + 2)) AS j FROM g),
i AS (SELECT lang, array_to_string(ws[j:j + g - 1], ' ') AS phrase, max(f) AS longer FROM j GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * b.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM e)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= {TOP}"""
