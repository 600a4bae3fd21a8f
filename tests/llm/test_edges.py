"""Every operator over nulls, empty and long texts, repeated rows, empty tables and clashing extra columns."""

import hashlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfline.llm import bpe, chat, language, mixing, pii, quality, simhash, substrings, toxicity, vectors
from shelfline.llm.common import components, prepared
from shelfline.llm.queries import MIX, PII_KEY, tokenizer_path

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one two"), (5, LONG), (6, LONG), (7, "x" * 200_000)]


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text) pairs, with an extra column whose name clashes with inner names."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "extra") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, words string")

    return make


@pytest.fixture(scope="module", autouse=True)
def session(spark):
    prepared(spark)


def run_all(docs):
    labels = docs.select("doc_id", F.lit(0).alias("toxic"))
    return {
        "language": language.identify(docs, language.train(docs)),
        "simhash": simhash.simhash_components(docs),
        "simhash_stage": simhash.drop_near_copies(docs),
        "toxicity": toxicity.score(docs, toxicity.train(docs, labels)),
        "quality": quality.judge(quality.ledger(docs)),
        "quality_stage": quality.keep_good(docs),
        "substrings": substrings.remove_repeated(docs),
        "bpe": bpe.digests(docs, tokenizer_path()),
        "pii": pii.pseudonyms(docs, PII_KEY),
        "pii_stage": pii.hide(docs, PII_KEY),
        "mixing": mixing.mix(docs, MIX),
        "mixing_stage": mixing.mixed_documents(docs, MIX),
    }


def test_odd_rows(docs_of):
    docs = docs_of(ROWS)
    got = {name: df.collect() for name, df in run_all(docs).items()}
    for name in ("language", "simhash", "toxicity", "quality", "substrings", "bpe", "pii", "pii_stage"):
        assert len(got[name]) == len(ROWS), name
    assert {r.lang_pred for r in got["language"] if r.doc_id in (1, 2, 3)} == {"und"}
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in got["simhash"]}
    assert prints[1] == prints[2] == prints[3] == ("0" * 16, 1)
    assert prints[4][1] == prints[None][1] == 4 and prints[6][1] == 5
    assert sorted((r.doc_id or -1) for r in got["simhash_stage"]) == [-1, 1, 4, 5, 7]
    assert {r.row.doc_id: r.n_words for r in got["quality"]}[5] == 60_000
    cut = {r.doc_id: (r.n_words, r.n_removed) for r in got["substrings"]}
    assert cut[6] == (60_000, 60_000) and cut[5][1] == 0 and cut[1] == (0, 0)
    assert {r.doc_id: r.n_tokens for r in got["bpe"]}[1] == 0
    assert all(set(got[s][0].asDict()) == set(docs.columns) for s in ("pii_stage", "simhash_stage", "mixing_stage"))


def test_empty_tables(docs_of, spark):
    for name, df in run_all(docs_of(ROWS).where("doc_id = -99")).items():
        assert df.count() == 0, name
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(turns)).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_chat_of_odd_turns_equals_brute_force(spark):
    """Null ids, turns, roles and texts, equal turn numbers, repeated rows, very long texts, an extra column named like an inner one."""
    rows = [(1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "user", "z"), (1, None, "user", "first"), (1, 1, None, "</s>[INST]"),
            (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (2, 0, "user", None),
            (None, 1, "user", "q"), (None, 2, "assistant", "\\[/INST] r"), (None, 2, "assistant", None),
            (3, 0, "user", "[INST]<" * 40_000), (3, 1, "assistant", "</s> long " * 40_000), (4, 0, None, None)]
    frame = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, pieces string")
    want = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = chat.digest(chat.format_conversations(frame)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


def test_language_and_toxicity_of_repeated_rows(spark, docs_of):
    """Copies get one answer each, and equal ones, whatever their id; other columns change nothing."""
    texts = [f"the cat sat on mat number {i} and the dog ran off" for i in range(30)] + [f"le chat est sur la table {i} et le chien court" for i in range(30)]
    docs = docs_of(list(enumerate(texts * 2))).withColumn("lang", F.when(F.col("text").startswith("the"), "en").otherwise("fr"))
    labels = docs.select("doc_id", F.col("text").contains("table").cast("int").alias("toxic"))
    lang = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.train(docs)).collect()}
    toxic = {r.doc_id: (r.predicted, r.score) for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert len(lang) == len(toxic) == 120
    assert all(lang[i] == lang[i + 60] and toxic[i] == toxic[i + 60] for i in range(60))
    assert all(lang[i][0] == ("en" if i < 30 else "fr") for i in range(60))


def test_mixing_of_rows_without_ids_equals_sql(spark):
    """Null ids, languages, sources and texts, copies: the rows taken are those of the SQL, and rows without id get cells of their own."""
    rows = [(None if i % 3 else i, None if i % 50 == 7 else f"t{i // 2} " * (1 + i % 9), [None, "en", "de"][i % 7 % 3],
             None if i % 11 == 3 else f"src{i % 4 * 6}") for i in range(900)]
    rows += [(None, None, "en", "src0"), (None, "", "en", "src0"), *rows[:40]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("place", F.lit("extra"))
    documents = docs.toPandas()  # noqa: F841 (read by the SQL)
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    columns = ["doc_id", "domain", "lang", "source", "n_tokens", "epoch"]
    got = mixing.mix(docs, MIX).select("row.doc_id", "domain", "row.lang", "row.source", "n_tokens", "epoch")
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({mixing.mix_sql(MIX)})").fetchall()
    assert want and Counter(map(tuple, got.collect())) == Counter(want)
    named = mixing.with_leaf(docs.where("doc_id IS NULL"), MIX)
    assert named.select("named").distinct().count() == docs.where("doc_id IS NULL").select(F.coalesce("text", F.lit(""))).distinct().count()


def test_components_of_a_long_chain(spark):
    links = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 0) for i in range(1, 201)}
