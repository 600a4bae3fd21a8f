"""Packing and the manifest against brute force, with odd rows."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfline.llm import merkle, packing
from shelfline.llm.common import prepared, table
from shelfline.llm.queries import PACKING_TOKENIZER, op11_packing, op12_merkle, tokenizer_path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, h string"


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    prepared(spark)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(PACKING_TOKENIZER))
    t.no_truncation()
    t.no_padding()
    return t


def test_lengths_are_the_binary_digits():
    assert packing.lengths(1) == [1] and packing.lengths(2048) == [2048]
    assert packing.lengths(2725) == [2048, 512, 128, 32, 4, 1]
    for n in range(1, 5000):
        assert sum(packing.lengths(n)) == n and sorted(packing.lengths(n), reverse=True) == packing.lengths(n)


def test_slices_join_to_the_text_and_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 5)
    text = b"ab  cdefghijkl m\n\nno p"
    assert b"".join(packing.slices(text)) == text
    assert [w for s in packing.slices(text) for w in s.split()] == text.split()


def test_a_known_word_is_looked_up_once(monkeypatch):
    encode = packing.WordEncoder(open(tokenizer_path(PACKING_TOKENIZER), encoding="utf-8").read())
    text, asked = b"one two three two\n" * 50, []
    first = encode(text)

    class Counted(dict):
        fresh = []
        __contains__ = lambda self, w: asked.append(w) or dict.__contains__(self, w)
        __getitem__ = lambda self, w: asked.append(w) or dict.__getitem__(self, w)

    encode.known = Counted(encode.known)
    assert encode(text) == first and len(asked) == 200


def test_words_encode_as_whole_texts(library, monkeypatch):
    monkeypatch.setattr(packing, "SLICE_BYTES", 40)
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 2000)
    encode = packing.WordEncoder(open(tokenizer_path(PACKING_TOKENIZER), encoding="utf-8").read())
    rng = np.random.default_rng(3)
    odd = ["é", "e", "́", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "ΑΣ", "'s", "'LL", "12", "٣", "½", "ﬁ", "😀", "<|endoftext|>",
           "<|startoftext|>", "ÀB", "İ", "ß", "a", "Zz", "…", "don't", "中文", "가", "ᄀ", "ᅡ", "İ", "ſ", "ŉ", "µ", "ª", "²", "Ÿ", "Œ", "<|", "|>", "'", "\x0b", "\x0c", "\r", "x1y"]
    for size in (1, 2, 3, 8, 60):
        for _ in range(300):
            text = "".join(rng.choice(odd, size))
            assert np.frombuffer(encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def check_pieces(rows, texts, library):
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(of[i], key=lambda r: r.start):
            assert (r.start, r.offset, r.doc_tokens) == (at, 0, len(ids)) and r.length & (r.length - 1) == 0 and r.length <= 2048
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len({r.sequence_id for r in rows}) == len(rows)
    by_bucket = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert by_bucket == sorted(by_bucket)


def test_query_equals_brute_force(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    check_pieces(op11_packing(spark, SMALL).collect(), texts, library)


def test_odd_texts(spark, library, tmp_path):
    texts = {1: None, 2: "", 3: " \n", 4: "one two", 5: " ".join(f"w{i % 977} x{i % 31}" for i in range(80_000)), 6: "x" * 100_000, None: "ß"}
    docs = spark.createDataFrame([(i, t, None, None, None, "extra", "extra") for i, t in texts.items()], SCHEMA)
    pieces = packing.pack(docs, tokenizer_path(PACKING_TOKENIZER))
    check_pieces(packing.digest(pieces).collect(), texts, library)
    packing.write_buckets(pieces, str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.where("octet_length(ids) <> 4 * length").count() == 0 and back.agg(F.sum("length")).first()[0] == \
        pieces.agg(F.sum("length")).first()[0]
    twice = packing.digest(packing.pack(docs.union(docs), tokenizer_path(PACKING_TOKENIZER))).collect()
    assert len(twice) == 2 * pieces.count() and len({r.sequence_id for r in twice}) == len(twice)
    assert packing.pack(docs.where("false"), tokenizer_path(PACKING_TOKENIZER)).count() == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text); the query's rows."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            start = at - at % 3
            yield level[start:at], level[at + 1:start + 3]
            at //= 3

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    of = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: levels([leaf(r) for r in of[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for at, r in enumerate(of[s]):
            steps = [*path(trees[s], at), *path(top, k)]
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf((*r[:4], text))
            for left, right in steps:
                node = sha("".join(left) + node + "".join(right))
            yield (r[0], leaf(r), trees[s][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in steps)), node, node == top[-1][0])


def as_rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_equals_brute_force(spark):
    rows = [(i, "hot", "en", i, f"text {i}\nnext") for i in range(800)]
    rows += [(i, f"s{i % 300}é", None, None, "a\n\nb" if i % 2 else None) for i in range(900, 1300)]
    rows += [(2000, "lone", "de", 0, ""), (None, None, None, None, None), (None, None, None, None, None), (7, "hot", "en", 7, "other\n"),
             (7, "hot", "en", 7, "other\n"), (2001, None, "fr", 3, "x" * 50_000 + "\n"), (2002, "", "fr", 3, "y\n")]
    docs = spark.createDataFrame([(i, t, lang, s, n, "extra", "extra") for i, s, lang, n, t in rows], SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = as_rows(merkle.verify(merkle.manifest(docs, altered)))
    assert got == sorted(brute(rows), key=repr)
    assert all(r[-1] for r in as_rows(merkle.verify(merkle.manifest(docs))))
    assert merkle.verify(merkle.manifest(docs.where("false"))).count() == 0


def test_manifest_of_three_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SIDE", 9)
    monkeypatch.setattr(merkle, "STEPS", 2)
    rows = [(i, "hot", "en", i, f"t{i}\n") for i in range(100)] + [(i, f"s{i}", "en", 1, "u\n") for i in range(100, 130)]
    docs = spark.createDataFrame([(i, t, lang, s, n, "", "") for i, s, lang, n, t in rows], SCHEMA)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    assert as_rows(merkle.verify(merkle.manifest(docs, altered))) == sorted(brute(rows), key=repr)


def test_query_equals_brute_force_on_the_table(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert as_rows(op12_merkle(spark, SMALL)) == sorted(brute(rows), key=repr)
