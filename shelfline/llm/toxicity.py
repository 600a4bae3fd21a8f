"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text. The ordinary one is
trained on windows of ordinary documents. The toxic one shares that base, and
its tail, which matches cheapest, holds the words that toxic text uses and
ordinary text doesn't. A word counts once for each pair of neighbours it has, so
copies of one document add nothing. Whether a word joins depends on how unlikely
its counts would be if both classes used it alike, given how much text of each
class there is, so it holds for any corpus size, and every such word joins. If no
word stands out, the tail is a dictionary trained on windows of the toxic
documents. The ordinary dictionary's tail has as many bytes: ordinary words that
share a piece with the toxic ones, then further ordinary text. So a window's two
compressed lengths differ by what the toxic words save, not by pieces of them.

A text is compressed in overlapping windows at a fast level. Windows that gain
are compressed again at a thorough level, and the smaller gain counts. The
score is a logistic function of the largest gains, of the numbers of windows
that gain much, and of the text's length; it is fitted on labelled documents,
and 0.5 lies where it separates them best.

Labels are learned from a sample of at most about TOXIC_SAMPLE + ORDINARY_SAMPLE
rows, drawn by a hash of doc_id; scoring reads every window of every text.
Null and empty texts have one empty window. Only without both labels among the
training rows every score is 0. A document with contradicting labels counts as toxic. Repeated
rows are scored each for itself. A null doc_id is not held out and not learned.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import per_batch
from shelfline.session import stored

#: Bounds of the labelled sample (expected rows).
TOXIC_SAMPLE, ORDINARY_SAMPLE = 4000, 8000
WINDOW, STEP = 48, 32
#: Size of the shared base, windows a document gives to dictionary training.
BASE_BYTES, TRAIN_WINDOWS = 8192, 24
#: Words expected to join the toxic tail by chance, of all words; least log-odds of a word that joins.
CHANCE_WORDS, MIN_LOG_ODDS = 0.05, 3.5
#: Characters that an ordinary word shares with a toxic one to count as near it.
PIECE = 5
#: Compression level and shortest match of the two passes.
FAST, THOROUGH = (3, 5), (13, 4)
WORTH_A_SECOND, LARGE, VERY_LARGE = 3, 5, 7
WORDS = re.compile(rb"[a-z\x80-\xff]+").findall
SPREAD = 1_000_000


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class ToxicModel:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def _compressor(content: bytes, level: int, min_match: int):
    params = zstandard.ZstdCompressionParameters.from_level(
        level, min_match=min_match, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress


@lru_cache(maxsize=2)
def _compressors(ordinary: bytes, toxic: bytes):
    return tuple(_compressor(d, *s) for s in (FAST, THOROUGH) for d in (ordinary, toxic))


def features(text: bytes | None, ordinary: bytes, toxic: bytes) -> list[float]:
    """The three largest gains, windows with a large and with a very large gain, and the text's length."""
    plain, other, plain_again, other_again = _compressors(ordinary, toxic)
    low = (text or b"").decode("utf-8", "replace").lower().encode()
    gains = []
    count = 0
    for at in range(0, max(1, len(low) - WINDOW + STEP), STEP):
        window = low[at:at + WINDOW]
        gain = len(plain(window)) - len(other(window))
        count += 1
        if gain >= WORTH_A_SECOND:
            gains.append(min(gain, len(plain_again(window)) - len(other_again(window))))
    gains.sort(reverse=True)
    return [*map(float, [*gains, 0, 0, 0][:3]), *(math.log1p(sum(g >= least for g in gains)) for least in (LARGE, VERY_LARGE)),
            math.log1p(count)]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the training rows, about the bounded number of each class."""
    known = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD))
    sizes = known.groupBy("toxic").count().withColumn("upto", F.least(F.lit(float(SPREAD)), F.floor(
        F.when(F.col("toxic") == 1, TOXIC_SAMPLE).otherwise(ORDINARY_SAMPLE) * F.lit(float(SPREAD)) / F.col("count"))))
    drawn = known.join(F.broadcast(sizes.select("toxic", "upto")), "toxic").where(place < F.col("upto")).select("doc_id", "toxic")
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")


def _contexts(sample: DataFrame) -> DataFrame:
    """word, toxic, n: how many different pairs of neighbours a word has in texts of a class."""

    def run(columns: dict) -> dict:
        seen = set()
        for text, toxic in zip(columns["text"], columns["toxic"]):
            words = [b"", *WORDS((text or b"").decode("utf-8", "replace").lower().encode()), b""]
            seen.update((w, toxic, p + b" " + n) for p, w, n in zip(words, words[1:], words[2:]))
        word, toxic, context = zip(*seen) if seen else ((), (), ())
        return {"word": [w.decode("utf-8", "replace") for w in word], "toxic": list(toxic),
                "context": [c.decode("utf-8", "replace") for c in context]}

    found = per_batch(sample.select("text", F.col("toxic").cast("int").alias("toxic")), run, "word string, toxic int, context string")
    return found.select("word", "toxic", F.xxhash64("context").alias("context")).distinct().groupBy("word", "toxic").agg(F.count("*").alias("n"))


def _toxic_words(sample: DataFrame) -> tuple[list[str], list[str]]:
    """All words that toxic text has far more often than chance explains, the most frequent first, and ordinary words near them.

    With t of a word's n contexts in toxic text, which has the share q of all
    contexts, Chernoff's bound of chance is exp(-n KL(t / n, q)).
    """
    wide = stored(_contexts(sample).groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"),
                                                        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("o")),
                  "toxic-contexts")
    nt, no, kinds = wide.agg(F.sum("t"), F.sum("o"), F.count("*")).first()
    if not nt or not no:
        return [], []
    t, o, q = F.col("t"), F.col("o"), nt / (nt + no)
    unlikely = t * F.log(t / ((t + o) * q)) + F.when(o > 0, o * F.log(o / ((t + o) * (1 - q)))).otherwise(0)
    best = wide.where("t > 0").where(F.log((t / nt) / ((o + 0.5) / no)) > MIN_LOG_ODDS) \
        .where(unlikely >= math.log(kinds / CHANCE_WORDS)).orderBy(F.desc("t"), "word")
    words = [r.word for r in best.collect()]
    pieces = {w[i:i + PIECE] for w in words for i in range(len(w) - PIECE + 1)}
    own = set(words)

    def near(columns: dict) -> dict:
        found = [(w, n) for w, n in zip((w.decode() for w in columns["word"]), columns["o"])
                 if w not in own and any(w[i:i + PIECE] in pieces for i in range(len(w) - PIECE + 1))]
        return {"word": [w for w, _ in found], "o": [n for _, n in found]}

    # The ordinary tail has no more room than the toxic one.
    close = per_batch(wide.where("o > 1").select("word", "o"), near, "word string, o long").orderBy(F.desc("o"), "word").limit(3 * len(words))
    return words, [r.word for r in close.collect()] if pieces else []


def _windows(sample: DataFrame) -> list[bytes]:
    """TRAIN_WINDOWS windows, evenly spread, of each text."""

    def run(columns: dict) -> dict:
        found = []
        for text in columns["text"]:
            low = (text or b"").decode("utf-8", "replace").lower().encode()
            step = max(WINDOW, len(low) // TRAIN_WINDOWS)
            found += [low[at:at + WINDOW] for at in range(0, len(low) - 7, step)][:TRAIN_WINDOWS]
        return {"w": found}

    return sorted({bytes(r.w) for r in per_batch(sample.select("text"), run, "w binary").collect()})


def _trained(windows: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, windows).as_bytes()[-size:]
    except zstandard.ZstdError:  # too little text to choose from: take it as it is
        return b" ".join(windows)[-size:] or b" "


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge; the intercept then moves to the threshold with the best F1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - 1e-3 * w)
    z = x @ w
    order = np.argsort(-z, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[order][:-1] == z[order][1:]] = 0  # equal scores stay together
    at = int(f1.argmax())
    low = z[order][at + 1] if at + 1 < len(y) else z[order][at] - 1
    w[-1] -= (z[order][at] + low) / 2
    return w


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel | None:
    sample = stored(_sample(docs, labels), "toxic-sample")
    if sample.select(F.col("toxic") == 1).distinct().count() < 2:
        return None
    words, near = _toxic_words(sample)
    windows = _windows(sample.where("toxic <> 1"))
    tail = (" " + " ".join(reversed(words)) + " ").encode() if words else _trained(_windows(sample.where("toxic = 1")), BASE_BYTES)
    base, fill = _trained(windows[::2], BASE_BYTES), _trained(windows[1::2], BASE_BYTES)
    alike = (" " + " ".join(reversed(near)) + " ").encode()[-len(tail):] if near else b""
    left = len(tail) - len(alike)
    ordinary, toxic = base + (fill * (1 + left // len(fill)))[:left] + alike, base + tail

    def run(columns: dict) -> dict:
        return {"x": [features(t, ordinary, toxic) for t in columns["text"]], "toxic": columns["toxic"]}

    rows = per_batch(sample.select("text", F.col("toxic").cast("int").alias("toxic")), run, "x array<double>, toxic int").collect()
    x, y = np.array([r.x for r in rows]), np.array([float(r.toxic == 1) for r in rows])
    return ToxicModel(ordinary, toxic, tuple(float(v) for v in _logistic(x, y)))


def score(docs: DataFrame, model: ToxicModel | None) -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(columns: dict) -> dict:
        if model is None:
            scores = [0.0] * len(columns["text"])
        else:
            x = np.array([features(t, model.ordinary, model.toxic) for t in columns["text"]])
            z = np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)
            scores = (1 / (1 + np.exp(-z))).tolist()
        return {"doc_id": columns["doc_id"], "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return per_batch(docs.select("doc_id", "text"), run,
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
