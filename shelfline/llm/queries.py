"""Registered queries of the operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import bpe, chat, language, merkle, mixing, packing, phrases, pii, quality, simhash, substrings, toxicity, vectors
from shelfline.llm.common import table

#: Production parameters.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.json"
PACKING_TOKENIZER = "word_bpe_49k.json"
PII_KEY = b"corpus-pseudonyms-1"
MIX = mixing.MixPolicy(
    domain_of={"src0": "web", **{f"src{i}": "web" for i in range(1, 10)}, **{f"src{i}": "reference" for i in range(10, 15)},
               **{f"src{i}": "forum" for i in range(15, 20)}},
    domains={"web": 5, "reference": 3, "forum": 2}, langs={"en": 4, "de": 2, "fr": 2, "es": 1})


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The vocabulary file, as the folder's own module names it."""
    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(TOKENIZERS, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.path(name)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    flags = docs.select(F.struct("doc_id", language.held_out().alias("held_out")).alias("doc_id"), "text")
    return language.identify(flags, model).select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    flags = docs.select(F.struct("doc_id", toxicity.held_out().alias("held_out")).alias("doc_id"), "text")
    return toxicity.score(flags, model).select("doc_id.doc_id", "doc_id.held_out", "score", "predicted")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.ledger(table(spark, sf_dir, "documents")))
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "n_lines", "failed_bits", "policy")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("""SELECT CAST(-7 AS LONG) AS conv_id, CAST(turn AS LONG) AS turn, role, '</s>[INST] ok [/INST]' AS text
                         FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonyms(table(spark, sf_dir, "documents"), PII_KEY)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX).select(
        "row.doc_id", "domain", "row.lang", "row.source", "n_tokens", "epoch")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(PACKING_TOKENIZER)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), altered))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_vectors": op2_vectors,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_chat": op6_chat,
    "op7_substrings": op7_substrings,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
    "op11_packing": op11_packing,
    "op12_merkle": op12_merkle,
    "op13_phrases": op13_phrases,
}

WORDS = "[x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']"

QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
    [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM documents),
o AS (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS spot FROM w WHERE len(words) >= 8),
k AS (SELECT doc_id, spot, count(*) OVER (PARTITION BY doc_id, list_slice(words, spot, spot + 7)) AS times FROM o),
c AS (SELECT doc_id, count(DISTINCT spot + j) AS n FROM k, range(8) AS r(j) WHERE times > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([length(x) FOR x IN words]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, ({" + ".join(f"CASE WHEN {rule} THEN {quality.BIT[name]} ELSE 0 END" for name, rule in quality.RULES)})::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {quality.BASE.mask}) <> 0 AS base_failed,
    (failed_bits & {quality.BASE.mask | quality.CURRENT.mask}) = 0 AS kept, n_lines, failed_bits, '{quality.CURRENT.version}' AS policy
FROM f"""

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, row_number() OVER o AS nth, lag(role) OVER o IS NOT DISTINCT FROM role AND row_number() OVER o > 1 AS joined,
    regexp_replace(text, '([\[<])(\\*)(/?SYS\]|/?INST\]|/?ROLE\]|:\]|\+\]|/?s>)', '\1\\\2\3', 'g') AS escaped
    FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
n AS (SELECT *, length(escaped) + CASE WHEN joined THEN 3 ELSE CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
    ELSE 16 + length(role) END END AS chars FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""

VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)"""

ORACLES: dict[str, str] = {
    "op2_vectors": VECTORS_SQL,
    "op5_quality": QUALITY_SQL,
    "op6_chat": CHAT_SQL,
    "op10_mixing": mixing.mix_sql(MIX),
    "op12_merkle": merkle.MERKLE_SQL,
    "op13_phrases": phrases.PHRASES_SQL,
}
