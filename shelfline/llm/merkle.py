"""Merkle dataset manifest over concatenated-level strings.

A document's leaf is the hash of its columns. Per source, leaves ascend by doc_id and
every FAN consecutive nodes become the hash of their joined hex digests, until one node
(the subroot) is left; the subroots, ordered by source, give the root the same way.

The tree is made block by block. A block is SIDE = FAN ** STEPS aligned places of one
source; it keeps each of its levels as one hex string. Parents hash fixed-width substrings
of FAN digests, and a node's siblings are the two flanking substrings of its run.
A round turns blocks into one node each and the nodes into the next round's blocks, so a source of N
leaves needs log(N) / log(SIDE) rounds and no task ever holds more than SIDE nodes of
it, however many rows one source has. On the way down every block receives the path
of its own node once and hands it to its leaves.

Leaves of equal doc_id stand in the order of their hashes; null doc_ids come first. Texts
may be null, empty or of any length: only their hash is kept. Repeated rows are leaves
of their own. An empty table gives an empty manifest. Extra columns are not hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.llm.places import placed
from shelfline.session import stored

FAN, STEPS, HEX = 3, 5, 64
SIDE = FAN ** STEPS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(columns: dict[str, Column]) -> Column:
    """Hash of the values, each with its length in bytes, `-` for null."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(part, columns.values())), 256)


def _parents(level: str) -> Column:
    runs = F.sequence(F.lit(0), F.expr(f"(length({level}) - 1) div {FAN * HEX}").cast("int"))
    node = lambda i: F.sha2(F.substring(F.col(level), i * (FAN * HEX) + 1, F.lit(FAN * HEX)), 256)
    return F.array_join(F.transform(runs, node), "")


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """tree, block, n (nodes of the tree), items (sorted), l0 .. l5 (levels; the last is the block's node)."""
    own = [c for c in nodes.columns if c not in ("tree", "n")]
    df = nodes.groupBy("tree", F.expr(f"pos div {SIDE}").alias("block")) \
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", *[c for c in own if c != "pos"]))).alias("items"))
    df = df.withColumn("l0", F.array_join(F.transform("items", lambda x: x["h"]), ""))
    for k in range(STEPS):
        df = df.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN ** k, _parents(f"l{k}")).otherwise(F.col(f"l{k}")))
    return stored(df, name)


def _rounds(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Blocks of every round, from the leaves up; in the last round each tree is one block."""
    rounds = [_blocks(nodes, f"{name}-0")]
    left = rounds[0].agg(F.max("n")).first()[0] or 0
    while left > SIDE:
        above = rounds[-1].select("tree", F.col("block").alias("pos"), F.expr(f"(n + {SIDE - 1}) div {SIDE}").alias("n"),
                                  F.col(f"l{STEPS}").alias("h"))
        rounds.append(_blocks(above, f"{name}-{len(rounds)}"))
        left = -(-left // SIDE)
    return rounds


def _down(blocks: DataFrame, up: DataFrame) -> DataFrame:
    """Nodes of `blocks` with `path` (array of left and right siblings, from the node up) and the columns of `up`."""
    rows = blocks.join(up, ["tree", "block"]).select(*[c for c in (*blocks.columns, *up.columns) if c not in ("items", "tree", "block")],
                                                     "tree", F.posexplode("items").alias("place", "item"))

    def step(k: int) -> Column:
        at = F.expr(f"place div {FAN ** k}").cast("int")
        start = at - at % FAN
        level = F.col(f"l{k}")
        return F.struct(F.substring(level, start * HEX + 1, (at - start) * HEX).alias("left"),
                        F.substring(level, (at + 1) * HEX + 1, (start + FAN - 1 - at) * HEX).alias("right"))

    deep = sum(((F.col("n") > FAN ** k).cast("int") for k in range(STEPS)), F.lit(0))
    own = F.slice(F.array(*map(step, range(STEPS))), F.lit(1), deep)
    kept = [c for c in up.columns if c not in ("tree", "block", "path")]
    return rows.select("tree", "item", F.concat(own, "path").alias("path"), *kept)


def _descend(rounds: list[DataFrame], up: DataFrame) -> DataFrame:
    """Leaves of the trees; `up` has a row (tree, block 0, path, ...) per tree."""
    for blocks in reversed(rounds):
        nodes = _down(blocks, up)
        up = nodes.select(*[c for c in nodes.columns if c != "item"], F.col("item.pos").alias("block"))
    return nodes


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof(path: Column) -> Column:
    """All siblings on a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, again, subroot, root, path: a row per document.

    `again` is the leaf with `altered` in place of the text, null without it or where it is the same.
    """
    leaf = leaf_hash({c: F.col(c) for c in COLUMNS})
    again = F.lit(None).cast("string") if altered is None else F.when(
        ~altered.eqNullSafe(F.col("text")), leaf_hash({c: altered if c == "text" else F.col(c) for c in COLUMNS}))
    # Trees sort as their sources do: null first, then by bytes.
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = stored(docs.select(tree.alias("tree"), "doc_id", leaf.alias("h"), again.alias("again")), "merkle-leaves")
    rounds = _rounds(placed(leaves, "tree", ["doc_id", "h"], "merkle-order"), "merkle-block")
    subroots = stored(rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col(f"l{STEPS}").alias("h")), "merkle-subroots")
    top = _rounds(placed(subroots, "tree", ["of"], "merkle-sources"), "merkle-top")
    last = top[-1].select("tree", "block", F.col(f"l{STEPS}").alias("root"),
                          F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"))
    sources = _descend(top, last).select(F.col("item.of").alias("tree"), F.lit(0).cast("long").alias("block"), "path", "root",
                                         F.col("item.h").alias("subroot"))
    return _descend(rounds, sources).select("item.doc_id", F.col("item.h").alias("leaf"), "item.again", "subroot", "root", "path")


def verify(rows: DataFrame) -> DataFrame:
    """Proof digest, the root recomputed from the altered leaf where there is one, and whether it is the root."""
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                       fold(F.coalesce("again", "leaf"), F.col("path")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, base: str) -> str:
    """CTEs `name` (tree, pos, h, n, lvl: all nodes) and `name`_s (with the siblings on both sides)."""
    return f"""{name} AS ({base} UNION ALL
    SELECT tree, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3, any_value(lvl) + 1
    FROM {name} WHERE n > 1 GROUP BY tree, pos // 3),
{name}_s AS (SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL)"""


def _climb(name: str, tree: str, base: str) -> str:
    return f"""{name} AS ({base} UNION ALL
    SELECT f.nr, f.tree, f.pos // 3, f.lvl + 1, sha256(s.l || f.h || s.r), f.p || s.l || s.r
    FROM {name} f JOIN {tree}_s s ON f.tree = s.tree AND f.lvl = s.lvl AND f.pos = s.pos)"""


_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_CRC = """list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: list_reduce([xor(c, x)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))"""

MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_LEAF.format("text")} AS leaf,
    CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} END AS again FROM documents),
o AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY source) AS n, row_number() OVER () AS nr FROM d),
{_levels("t", "SELECT tree, pos, leaf AS h, n, 0 AS lvl FROM o")},
q AS (SELECT tree AS src, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
{_levels("u", "SELECT '' AS tree, pos, subroot AS h, n, 0 AS lvl FROM q")},
{_climb("f", "t", "SELECT nr, tree, pos, 0 AS lvl, coalesce(again, leaf) AS h, '' AS p FROM o")},
mid AS (SELECT nr, tree, max_by(h, lvl) AS h, max_by(p, lvl) AS p FROM f GROUP BY nr, tree),
{_climb("g", "u", "SELECT m.nr, '' AS tree, q.pos, 0 AS lvl, m.h, m.p FROM mid m JOIN q ON m.tree = q.src")},
e AS (SELECT nr, max_by(h, lvl) AS folded_root, max_by(p, lvl) AS p FROM g GROUP BY nr)
SELECT o.doc_id, o.leaf, q.subroot, r.h AS root, sha256(e.p) AS proof_sha256, e.folded_root, e.folded_root = r.h AS verified
FROM o JOIN q ON o.tree = q.src JOIN e USING (nr) JOIN (SELECT h FROM u WHERE n = 1) r ON true"""
