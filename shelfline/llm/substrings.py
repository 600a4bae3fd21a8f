"""Repeated passages by suffix automata of reference shards.

A window of 50 words goes if its words also start in a document with a smaller
doc_id. Automata over all words of a corpus would cost some microseconds a word
for each shard that reads it, so the corpus is first cut down, exactly:

1. Every window contains a winnowed anchor, the smallest hash of its 25-word
   runs. Anchors that only one document holds rule out their windows.
2. What is left are candidate windows. Their 64-bit hashes are grouped (a
   combining aggregate, so a common passage is one row per task) to find the
   first holder of each window that several documents hold.
3. A first holder's runs of such windows are reference passages. They are dealt
   into shards of bounded size; a suffix automaton is built for each shard and
   handed to every group of documents that hold one of its passages (a shard
   with many readers is copied to several groups). Documents stream through for
   matching statistics: where the longest match ending at a word is 50 or more
   and lies in a smaller document, the window is covered. The automaton compares
   words, so a collision of hashes removes nothing.

Words are runs of characters other than the six blanks, unchanged. Null texts
have no words. A null doc_id is not smaller or larger than any: nothing of that
row goes, and it holds nothing for others. Rows that repeat a doc_id are
documents of their own, judged alike. Windows are judged on the input. A very
long text is judged whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import per_batch
from shelfline.session import stored

WINDOW, RUN = 50, 25
#: Words of reference in one automaton, and words that stream through one group.
SHARD_WORDS, GROUP_WORDS = 100_000, 2_000_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(words: list[bytes], *sizes: int) -> list[np.ndarray]:
    """For each size, the hash of every run of so many words."""
    digest = xxhash.xxh3_64_intdigest
    ids = np.fromiter(map(digest, words), np.uint64, len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * _powers(BASE, len(ids)), dtype=np.uint64)])
    back = _powers(INVERSE, len(ids))
    return [_mixed((sums[k:] - sums[:-k]) * back[:len(sums) - k]) if len(words) >= k else np.empty(0, np.uint64) for k in sizes]


def anchors_of_windows(runs: np.ndarray) -> np.ndarray:
    """For each window, the smallest hash of its runs."""
    span, low, width = WINDOW - RUN + 1, runs, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _anchors(text: bytes | None) -> list[int]:
    words = (text or b"").split()
    if len(words) < WINDOW:
        return []
    return np.unique(anchors_of_windows(run_hashes(words, RUN)[0])).view(np.int64).tolist()


def _candidates(text: bytes, shared: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows whose anchor other documents hold too."""
    runs, windows = run_hashes(text.split(), RUN, WINDOW)
    at = np.flatnonzero(np.isin(anchors_of_windows(runs).view(np.int64), np.array(shared, np.int64)))
    return at, windows[at].view(np.int64)


class Automaton:
    """Suffix automaton of word sequences; each state knows the smallest document in which its words end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def add(self, words: list[bytes], document: int) -> None:
        """One passage. Matches don't run across passages."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for word in words:
            q = nxt[last].get(word)
            if q is not None and length[q] == length[last] + 1:
                last = q
            else:
                if q is None:
                    cur = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    least.append(None)
                    p = last
                    while p >= 0 and word not in nxt[p]:
                        nxt[p][word] = cur
                        p = link[p]
                    if p >= 0:
                        q = nxt[p][word]
                        link[cur] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
                    last = cur
                else:
                    last = self._clone(last, word, q)
            if least[last] is None or document < least[last]:
                least[last] = document

    def _clone(self, p: int, word: bytes, q: int) -> int:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        least.append(None)
        link[q] = new
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = new
            p = link[p]
        return new

    def finish(self) -> None:
        """A state's words end wherever those of the longer states below it end."""
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up > 0 and self.least[state] is not None and (self.least[up] is None or self.least[state] < self.least[up]):
                self.least[up] = self.least[state]

    def covered(self, words: list[bytes], document: int) -> list[tuple[int, int]]:
        """Maximal spans of words under windows that a smaller document holds."""
        nxt, link, length, least = self.next, self.link, self.length, self.least
        state = size = 0
        spans: list[list[int]] = []
        for end, word in enumerate(words, 1):
            while state and word not in nxt[state]:
                state = link[state]
                size = length[state]
            if word in nxt[state]:
                state = nxt[state][word]
                size += 1
            if size >= WINDOW:
                holder = state
                while length[link[holder]] >= WINDOW:
                    holder = link[holder]
                if least[holder] < document:
                    if spans and end - WINDOW <= spans[-1][1]:
                        spans[-1][1] = end
                    else:
                        spans.append([end - WINDOW, end])
        return [tuple(s) for s in spans]


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> tuple[int, str]:
    """Words removed, hash of the words that stay."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, end in spans:
        gone[start] += 1
        gone[end] -= 1
    covered = np.cumsum(gone)[:-1] > 0
    stay = words if not spans else [w for w, c in zip(words, covered.tolist()) if not c]
    return int(covered.sum()), hashlib.sha256(b" ".join(stay)).hexdigest()


def _passages(columns: dict) -> dict:
    """Runs of windows with one first holder, as texts: the holder's own are reference, the others stream."""
    out = {k: [] for k in ("holder", "doc_id", "row", "start", "n_words", "passage")}
    for doc, row, text, at, first in zip(columns["doc_id"], columns["row"], columns["text"], columns["at"], columns["first"]):
        words = text.split()
        at, first = np.array(at, np.int64), np.array(first, np.int64)
        order = np.argsort(at, kind="stable")
        at, first = at[order], first[order]
        cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(first) != 0)) + 1
        for low, high in zip([0, *cuts], [*cuts, len(at)]):
            start, end = int(at[low]), int(at[high - 1]) + WINDOW
            for name, value in zip(out, (int(first[low]), doc, row, start, end - start, b" ".join(words[start:end]).decode())):
                out[name].append(value)
    return out


def _stream(group: pa.Table) -> pa.Table:
    """Spans (row, start, end) that one shard's automaton finds in the passages streamed through it."""
    columns = {name: group.column(name).to_pylist() for name in ("holder", "doc_id", "row", "start", "passage")}
    automaton = Automaton()
    reference = {(h, p) for h, d, p in zip(columns["holder"], columns["doc_id"], columns["passage"]) if h == d}
    for holder, passage in sorted(reference):
        automaton.add(passage.encode().split(), holder)
    automaton.finish()
    rows, starts, ends = [], [], []
    for holder, doc, row, at, passage in zip(*columns.values()):
        if holder != doc:
            for start, end in automaton.covered(passage.encode().split(), doc):
                rows.append(row)
                starts.append(at + start)
                ends.append(at + end)
    return pa.table({"row": pa.array(rows, pa.int64()), "start": pa.array(starts, pa.int64()), "stop": pa.array(ends, pa.int64())})


def repeated_spans(candidates: DataFrame) -> DataFrame:
    """row, spans (array of start, stop) for the candidate documents that lose words."""

    def windows(columns: dict) -> dict:
        out = {"doc_id": [], "row": [], "at": [], "w": []}
        for doc, row, text, shared in zip(columns["doc_id"], columns["row"], columns["text"], columns["shared"]):
            at, w = _candidates(text, shared)
            out["doc_id"] += [doc] * len(at)
            out["row"] += [row] * len(at)
            out["at"] += at.tolist()
            out["w"] += w.tolist()
        return out

    found = per_batch(candidates, windows, "doc_id long, row long, at int, w long")
    first = found.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("w", "first")
    first = stored(first, "repeated-windows")
    pairs = found.join(first, "w").groupBy("row").agg(F.collect_list(F.struct("at", "first")).alias("pairs"))
    # Two arrays of numbers: of structs, Python would make a dict for each window.
    apart = candidates.select("doc_id", "row", "text").join(pairs, "row").select("doc_id", "row", "text", "pairs.at", "pairs.first")
    passages = per_batch(apart, _passages,
                         "holder long, doc_id long, row long, start long, n_words long, passage string")
    passages = stored(passages, "passages")
    total = passages.agg(F.coalesce(F.sum(F.when(F.col("holder") == F.col("doc_id"), F.col("n_words"))), F.lit(0))).first()[0]
    # Passages of one holder may lie in several shards: window and reference go by the holder, which has them all.
    shard = F.pmod(F.xxhash64("holder"), F.lit(1 + total // SHARD_WORDS))
    dealt = passages.withColumn("shard", shard)
    groups = dealt.groupBy("shard").agg((1 + F.floor(F.sum("n_words") / GROUP_WORDS)).cast("int").alias("groups"))
    own = F.pmod(F.xxhash64("row", "start"), F.col("groups")).cast("int")
    every = F.sequence(F.lit(0), F.col("groups") - 1)
    sent = dealt.join(groups, "shard").withColumn(
        "grp", F.explode(F.when(F.col("holder") == F.col("doc_id"), every).otherwise(F.array(own))))
    spans = sent.drop("groups", "n_words").groupBy("shard", "grp").applyInArrow(_stream, "row long, start long, stop long")
    return spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def remove_repeated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
    named = rows.where("doc_id is not null")
    anchors = stored(per_batch(named, lambda c: {"doc_id": c["doc_id"], "tid": c["tid"], "anchors": [_anchors(t) for t in c["text"]]},
                               "doc_id long, tid long, anchors array<long>").where(F.size("anchors") > 0), "anchors")
    each = anchors.select("doc_id", "tid", F.explode("anchors").alias("anchor"))
    shared = each.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    holders = each.join(shared, "anchor").groupBy("doc_id", "tid").agg(F.collect_set("anchor").alias("shared"))

    def first_look(columns: dict) -> dict:
        words = [(t or b"").split() for t in columns["text"]]
        plain = [None if s else _kept(w, [])[1] for w, s in zip(words, columns["shared"])]
        texts = [t.decode() if s else None for t, s in zip(columns["text"], columns["shared"])]
        return {"doc_id": columns["doc_id"], "n_words": [len(w) for w in words], "kept_sha256": plain, "text": texts, "shared": columns["shared"]}

    looked = per_batch(rows.join(holders, ["doc_id", "tid"], "left").select("doc_id", "text", "shared"), first_look,
                       "doc_id long, n_words long, kept_sha256 string, text string, shared array<long>")
    looked = stored(looked.withColumn("row", F.monotonically_increasing_id()), "first-look")
    candidates = looked.where("shared is not null").select("doc_id", "row", "text", "shared")
    spans = stored(repeated_spans(candidates), "repeated-spans")

    def last_look(columns: dict) -> dict:
        found = [_kept(t.split(), [(s["start"], s["stop"]) for s in spans or []]) for t, spans in zip(columns["text"], columns["spans"])]
        return {"doc_id": columns["doc_id"], "n_words": columns["n_words"], "n_removed": [f[0] for f in found],
                "kept_sha256": [f[1] for f in found]}

    result = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    cut = per_batch(looked.where("shared is not null").select("row", "doc_id", "n_words", "text").join(spans, "row", "left")
                    .select("doc_id", "n_words", "text", "spans"), last_look, result)
    whole = looked.where("shared is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return whole.unionByName(cut)
