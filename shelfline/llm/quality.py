"""Quality rules as a bitmask ledger, in DataFrame functions only.

`ledger` measures a text once and stores the measurements and one bit for each
rule that fails. Policies are versioned sets of rules: applying one is a bitwise
and, and `ablation` counts from the distinct bit patterns what each rule of a
policy costs alone. Neither looks at a text again.

Null and empty texts have no words, so they fail `too_short`. Ratios with an
empty denominator don't fail. Repeated rows are judged each for itself; other
columns are not read. A very long text is measured whole. An empty table gives
an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import BLANKS, let

WINDOW = 8
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Name and failure condition; a rule's bit is its place. New rules go to the end, so stored ledgers stay valid.
RULES = (
    ("too_short", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("symbol_heavy", "100 * n_symbols > 10 * n_words"),
    ("words_too_short", "word_chars < 2 * n_words"),
    ("words_too_long", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << place for place, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rules)


BASE = Policy("base", ("too_short", "repeated_windows"))
CURRENT = Policy("2", tuple(BIT))


def repeated_words(words: Column) -> Column:
    """Words inside a window of eight words that the text holds more than once.

    Windows are sorted by hash and start; neighbours with equal hashes are
    compared word by word. A text without equal hashes is done after one pass.
    """

    def marked(hashes: Column, w: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def same(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (F.slice(w, x["i"] + 1, WINDOW) == F.slice(w, y["i"] + 1, WINDOW))

        def starts(p: Column) -> Column:
            twice = F.filter(p, lambda x, j: F.coalesce((j > 0) & same(x, F.get(p, j - 1)), F.lit(False))
                             | F.coalesce(same(x, F.get(p, j + 1)), F.lit(False)))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        first = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(let(pairs, starts), first,
                           lambda a, s: F.struct(s.alias("last"), (a["total"] + F.least(F.lit(WINDOW), s - a["last"]))
                                                 .cast("long").alias("total")), lambda a: a["total"])

    def counted(w: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
        hashes = F.transform(spots, lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long"))
                   .otherwise(marked(h, w)))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(words, counted))


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns in `keep`), the measurements (long) and failed_bits (long) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.translate(text, BLANKS, " " * len(BLANKS))
    words = docs.select(F.struct(*keep).alias("row"), text.alias("text"), F.filter(F.split(spaced, " "), lambda w: w != "").alias("words"),
                        F.filter(F.split(text, "\n"), lambda line: F.trim(F.translate(line, BLANKS, " " * len(BLANKS)))
                                 != "").alias("lines"))
    measured = words.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"))
    bits = sum((F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)) for name, fails in RULES), F.lit(0))
    return measured.select("row", *MEASURES, bits.cast("long").alias("failed_bits"))


def fails(policy: Policy, bits: str = "failed_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def judge(measured: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The ledger with base_failed, kept and the policy's version."""
    return measured.select("*", fails(BASE).alias("base_failed"), (~fails(BASE) & ~fails(policy)).alias("kept"),
                           F.lit(policy.version).alias("policy"))


def ablation(measured: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects (kept if it were dropped)."""
    patterns = measured.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    sums = []
    for name in policy.rules:
        bit = F.lit(BIT[name])
        sums += [F.sum(F.when(F.col("bits").bitwiseAND(bit) != 0, F.col("count")).otherwise(0)).alias(f"{name}_failed"),
                 F.sum(F.when(F.col("bits") == bit, F.col("count")).otherwise(0)).alias(f"{name}_only")]
    one = patterns.agg(F.sum("count").alias("n_docs"), *sums)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f"{n}_failed", F.lit(0)).alias("n_failed"),
                              F.coalesce(f"{n}_only", F.lit(0)).alias("n_only"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
                     for n in policy.rules])
    return one.select(F.lit(policy.version).alias("policy"), F.inline(rows))


def keep_good(docs: DataFrame, policy: Policy = CURRENT) -> DataFrame:
    """The rows of `docs` that pass, with the columns of `docs`. One pass and no join: the bits stay beside the row."""
    return judge(ledger(docs, tuple(docs.columns)), policy).where("kept").select("row.*")
