"""Phrases against brute force, tries against dictionaries, odd rows."""

import re
from collections import Counter

import numpy as np
import pytest

from shelfline.llm import phrases
from shelfline.llm.common import prepared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, phrase string"


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    prepared(spark)


def brute(rows, least, longest=5, top=2000):
    """rows: (lang, text)."""
    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            f.update((lang or "und", *words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    often = {p: c for p, c in f.items() if len(p) > 2 and c >= least}
    for (lang, *words), a in often.items():
        size = len(words)
        cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, size)]
        score, k = min(cuts)
        inside = any(len(q) > size + 1 and q[0] == lang and c >= a and any(list(q[1 + j:1 + j + size]) == words for j in range(len(q) - size))
                     for q, c in often.items())
        if not inside:
            out.append((lang, -score, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    ranks = Counter()
    for lang, score, a, phrase, l, r in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            yield lang, ranks[lang], phrase.decode(), -a, l, r, n[lang], -score


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    words = ["Uno", "dos", "tres", "x", "ÉÈ", "e.g", "a\tb", "stop;", "\n", "\x0b", "q!", "rare"]
    made = [(["en", "de", None, "und"][int(rng.integers(4))], " ".join(rng.choice(words, int(rng.integers(1, 40)), p=[.2, .15, .1, .1, .1, .05, .05, .05, .05, .05, .05, .05])))
            for _ in range(300)]
    return made + [("en", "ha " * 500), ("en", None), ("en", ""), ("fr", " \t\n"), ("de", "one two three four five six " * 40), ("de", "one two three four five six. " * 5)]


def frame(spark, rows):
    return spark.createDataFrame([(None if i % 3 else 1, t, lang, None, None, "extra", "extra") for i, (lang, t) in enumerate(rows)], SCHEMA)


def test_equals_brute_force(spark, rows):
    docs = frame(spark, rows)
    assert found(phrases.collocations(docs, least=12)) == sorted(brute(rows, 12))
    assert found(phrases.collocations(docs, least=12, longest=3, top=4)) == sorted(brute(rows, 12, 3, 4))


def test_many_shards_and_short_rows_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_PHRASES", 60)
    monkeypatch.setattr(phrases, "ROW_BYTES", 200)
    monkeypatch.setattr(phrases, "TRIALS", 1)
    assert found(phrases.collocations(frame(spark, rows), least=12)) == sorted(brute(rows, 12))


def test_without_frequent_phrases_and_without_rows(spark):
    docs = frame(spark, [("en", "a b c"), (None, None)])
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(docs.where("false")).count() == 0


def test_products_beyond_64_bits(spark):
    wide = spark.sql("SELECT CAST(9000000000000 AS LONG) a, CAST(90000000000000 AS LONG) n, CAST(9000000000000 AS LONG) l, CAST(9000000000001 AS LONG) r")
    up, down = phrases.product("a", "n") , phrases.product("l", "r", 1)
    assert wide.select(up.alias("u"), down.alias("d")).selectExpr("u div d").first()[0] == 1000 * 9000000000000 * 90000000000000 // (9000000000000 * 9000000000001)


@pytest.mark.parametrize("length", [1, 2, 4])
def test_trie_finds_exactly_its_phrases(length):
    rng = np.random.default_rng(length)
    ids = np.unique(rng.zipf(1.3, (20_000, length)) % 3_000 + 7, axis=0).astype(np.int64)
    held = ids[rng.random(len(ids)) < 0.5]
    trie = phrases.Trie.from_bytes(phrases.Trie.build(held, np.arange(len(held)) + 100).to_bytes())
    text = np.concatenate([ids[rng.permutation(len(ids))].ravel(), [0, 1, 99_999]])
    states = trie.states(trie.codes(text), length)
    want = {tuple(p): i + 100 for i, p in enumerate(held.tolist())}
    got = np.where(states > 0, trie.phrase[states], -1)
    assert got.tolist() == [want.get(tuple(text[i:i + length].tolist()), -1) for i in range(len(text) - length + 1)]
