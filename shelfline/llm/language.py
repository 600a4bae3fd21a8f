"""Language by mixture inference.

Training counts hashed byte trigrams for each language over all training rows.
A text is cut into units of four words. Each unit has a likelihood under each
language, and expectation-maximisation finds the proportions of the languages
in the text. The set of languages is chosen by penalised likelihood: the
languages in order of their proportions are taken one more at a time while the
log-likelihood grows by more than half the logarithm of the number of units.
The prediction is the language with the largest proportion; the score is that
proportion.

Null texts and texts without a letter give `und` and score 0. If nothing can be
learned from, every text gives `und`. Only `text` is an input of a prediction;
equal proportions go to the language that sorts first. Repeated rows count in
training and give repeated results. A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import per_batch

#: Trigram buckets, words in a unit, EM rounds, bytes of text scored together, pseudo-count.
BUCKETS, UNIT_WORDS, ROUNDS, STEP_BYTES, PSEUDO = 1 << 16, 4, 12, 1 << 20, 0.5
HAS_LETTER = regex.compile(r"\p{L}").search
#: Bytes that stay: a to z and all of a non-ASCII character. The rest is blank.
KEPT = np.full(256, 32, np.uint8)
KEPT[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
KEPT[128:] = np.arange(128, 256)


def letters(text: str) -> np.ndarray:
    return KEPT[np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)]


def trigrams(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram around each letter, and the letters' places."""
    at = np.flatnonzero(kept[1:-1] != 32) + 1
    wide = kept.astype(np.uint32)
    return ((wide[at - 1] << 16 | wide[at] << 8 | wide[at + 1]) * np.uint32(2654435761)) >> np.uint32(16), at


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    log_p: np.ndarray  # buckets x languages


def train(rows: DataFrame) -> LanguageModel:
    """From all rows (text, lang) with neither null. The driver gets one count per language and bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total += np.bincount(trigrams(letters(text))[0], minlength=BUCKETS)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(total[some])],
                                             ["lang", "bucket", "n"])

    counts = rows.where("text is not null and lang is not null").select("text", "lang") \
        .mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(langs)), PSEUDO)
    place = {lang: k for k, lang in enumerate(langs)}
    table[counts.column("bucket").to_numpy(), [place[x] for x in counts.column("lang").to_pylist()]] += counts.column("n").to_numpy()
    return LanguageModel(tuple(langs), (np.log(table) - np.log(table.sum(0))).astype(np.float32))


def unit_likelihoods(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each unit under each language, and the number of units of each text."""
    kept = [letters(t) for t in texts]
    whole = np.concatenate(kept)
    bounds = np.cumsum([0, *map(len, kept)])
    buckets, at = trigrams(whole)
    first = whole[at - 1] == 32  # each text begins and ends with a blank, so no word spans two
    word = np.cumsum(first) - 1
    text_of = np.searchsorted(bounds, at, "right") - 1
    starts = np.flatnonzero(first)
    words_before = np.searchsorted(text_of[starts], np.arange(len(texts)))
    opens = first & ((word - words_before[text_of]) % UNIT_WORDS == 0)
    unit_at = np.flatnonzero(opens)
    likes = np.add.reduceat(model.log_p[buckets], unit_at, axis=0)
    return likes, np.bincount(text_of[unit_at], minlength=len(texts))


def _fit(likes: np.ndarray, sizes: np.ndarray, active: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of every text over its active languages."""
    text_of, starts = np.repeat(np.arange(len(sizes)), sizes), np.cumsum([0, *sizes[:-1]])
    share = active / active.sum(1, keepdims=True)
    for _ in range(rounds):
        part = likes * share[text_of]
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, starts, axis=0) / sizes[:, None]
    return share, np.add.reduceat(np.log((likes * share[text_of]).sum(1)), starts)


def proportions(likes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Language proportions of texts with one unit or more, over the set that penalised likelihood selects."""
    like = np.exp((likes - likes.max(1, keepdims=True)).astype(np.float64)) + 1e-30
    full, _ = _fit(like, sizes, np.ones((len(sizes), like.shape[1])), ROUNDS)
    order = np.argsort(-full, axis=1, kind="stable")
    place = np.argsort(order, axis=1, kind="stable")
    best, gained = _fit(like, sizes, (place < 1).astype(float), 0)
    open_ = np.arange(len(sizes))
    for size in range(2, like.shape[1] + 1):
        mask = np.zeros(len(sizes), bool)
        mask[open_] = True
        share, found = _fit(like[np.repeat(mask, sizes)], sizes[open_], (place[open_] < size).astype(float), ROUNDS)
        better = found - gained[open_] > 0.5 * np.log(sizes[open_]) + 1e-9
        open_ = open_[better]
        best[open_], gained[open_] = share[better], found[better]
        if not len(open_):
            break
    return best


def predict(texts: list[bytes | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return langs, scores
    step: list[tuple[int, str]] = []

    def flush() -> None:
        likes, sizes = unit_likelihoods([t for _, t in step], model)
        some = np.flatnonzero(sizes)
        share = proportions(likes, sizes[some]) if len(some) else np.empty((0, 1))
        for row, k in enumerate(some):
            top = int(share[row].argmax())
            langs[step[k][0]], scores[step[k][0]] = model.langs[top], float(min(1.0, share[row, top]))
        step.clear()

    size = 0
    for i, raw in enumerate(texts):
        text = raw.decode("utf-8", "replace") if raw else ""
        if HAS_LETTER(text):
            step.append((i, text))
            size += len(raw)
            if size > STEP_BYTES:
                flush()
                size = 0
    if step:
        flush()
    return langs, scores


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def run(columns: dict) -> dict:
        langs, scores = predict(columns["text"], model)
        return {"doc_id": columns["doc_id"], "lang_pred": langs, "score": scores}

    return per_batch(docs.select("doc_id", "text"), run,
                     f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
