"""Chat formatting in Spark expressions only.

Turns are collected and sorted per conversation, adjacent turns of one role
merge into a block, and blocks are concatenated between control strings:

    [SYS]text[/SYS]   [INST]text[/INST]   <s>text</s>   [ROLE]name[:]text[/ROLE]

for system, user, assistant and any other role. Inside a block `[+]` stands
between merged turns, so the turns can be read back one by one.

Escaping is reversible: a control string inside a text, however many
backslashes follow its first character, gets one more there; reading takes one
away. An unescaped control string in the output is thus always a mark.

The output carries the loss mask as `pieces`, whose texts make up `formatted`;
`loss` is true for assistant texts alone.

A null text is empty, a null role is a role with an empty name, a null turn
sorts first. Equal turn numbers sort by role, then text; repeated rows stay.
Rows with a null conv_id form one conversation. Other columns are not read.
A conversation is one row of the result, so it is gathered as one value, very
long texts included. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import let

#: Role, opening and closing mark. Every control string begins with [ or < and holds neither again.
MARKS = (("system", "[SYS]", "[/SYS]"), ("user", "[INST]", "[/INST]"), ("assistant", "<s>", "</s>"))
OPEN, NAMED, CLOSE, NEXT = "[ROLE]", "[:]", "[/ROLE]", "[+]"
CONTROL = r"(/?SYS\]|/?INST\]|/?ROLE\]|:\]|\+\]|/?s>)"
ESCAPED_BLOCK = r"(?s)(?:\[SYS\]|\[INST\]|<s>|\[ROLE\]).*?(?:\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + CONTROL, r"$1$2$3")


def _by_role(role: Column, place: int, other: Column) -> Column:
    found = other
    for mark in MARKS:
        found = F.when(role == mark[0], F.lit(mark[place])).otherwise(found)
    return found


def _blocks(turns: Column) -> Column:
    """Arrays of adjacent turns with one role."""

    def cut(t: Column) -> Column:
        spots = F.sequence(F.lit(1), F.size(t))
        starts = F.filter(spots, lambda i: (i == 1) | ~F.get(t, i - 1)["role"].eqNullSafe(F.get(t, i - 2)["role"]))
        return let(starts, lambda s: F.transform(s, lambda at, j: F.slice(
            t, at, F.coalesce(F.get(s, j + 1), F.size(t) + 1) - at)))

    return let(turns, cut)


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("text"), loss.alias("loss"))


def _pieces(block: Column) -> Column:
    role = block[0]["role"]
    loss, no = role == "assistant", F.lit(False)
    head = _by_role(role, 1, F.concat(F.lit(OPEN), escape(role), F.lit(NAMED)))
    inner = F.flatten(F.transform(block, lambda t, i: F.when(i == 0, F.array(_piece(escape(t["text"]), loss))).otherwise(
        F.array(_piece(F.lit(NEXT), no), _piece(escape(t["text"]), loss)))))
    return F.concat(F.array(_piece(head, no)), inner, F.array(_piece(_by_role(role, 2, F.lit(CLOSE)), no)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (string), pieces (array of text, loss): one row per conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = gathered.select("conv_id", F.flatten(F.transform(_blocks(F.col("turns")), _pieces)).alias("pieces"))
    return made.select("conv_id", F.array_join("pieces.text", "").alias("formatted"), "pieces")


def read_turns(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) read from `formatted` alone."""

    def turns(block: Column) -> Column:
        opening = F.regexp_extract(block, r"^(\[SYS\]|\[INST\]|<s>|\[ROLE\])", 1)
        rest = F.regexp_replace(block, r"^(\[SYS\]|\[INST\]|<s>|\[ROLE\])|(\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])$", "")
        role = F.when(opening == OPEN, unescape(F.substring_index(rest, NAMED, 1)))
        for name, mark, _ in MARKS:
            role = F.when(opening == mark, F.lit(name)).otherwise(role)
        texts = F.split(F.when(opening == OPEN, F.regexp_replace(rest, r"(?s)^.*?\[:\]", "")).otherwise(rest), r"\[\+\]", -1)
        return let(role, lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

    blocks = F.regexp_extract_all("formatted", F.lit(ESCAPED_BLOCK), F.lit(0))
    return formatted.select("conv_id", F.flatten(F.transform(blocks, turns)).alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """Turns and loss text, read back from the output, as counts and hashes."""
    loss = F.array_join(F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    turns = read_turns(formatted.select(F.struct("conv_id", "formatted", loss.alias("loss")).alias("conv_id"), "formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id.conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("conv_id.loss").cast("long").alias("loss_chars"), F.sha2("conv_id.loss", 256).alias("loss_sha256"),
        F.length("conv_id.formatted").cast("long").alias("formatted_chars"))
