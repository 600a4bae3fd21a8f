"""Mixing sources to target weights by hierarchical budgets.

A tree of domain, language and source splits a token budget. Every node gets
its share by weight, limited by what its leaves can give (their tokens times
the epochs allowed). What a node cannot use goes to its siblings by weight, and
only what all siblings together cannot use goes up to the ancestor's siblings:
a node's limit is the sum of its children's, so each level is filled to the
brim before the level above shares out the rest.

A leaf then takes whole epochs and a prefix of one more, in an order seeded by
epoch and doc_id, as far as its tokens reach. The prefix is found without
sorting a leaf: documents fall into cells of the order, cell totals find the
cell where the budget ends, and only that cell is sorted. A leaf of n documents
has about the square root of n cells, so neither the cells nor the last cell
grow with a hot leaf.

Null domain, language or source is a value of its own. Null texts have no
tokens and ride along in the prefix. A row without doc_id has its place by its
text, so such rows spread over the cells. Equal places in the order sort by doc_id,
then text; repeated rows count and are taken one by one. Weight 0 takes nothing.
A document is counted and taken whole, however long. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import stored

LEAF = ("domain", "lang", "source")
SPACE = 1 << 32


@dataclass(frozen=True)
class MixPolicy:
    """Weights are integers; a child without one has `default_weight`. The budget is a share of all tokens."""

    domain_of: dict[str, str]
    domains: dict[str, int]
    langs: dict[str, int]
    sources: dict[str, int] = field(default_factory=dict)
    other_domain: str = "other"
    default_weight: int = 1
    budget_percent: int = 80
    epochs: int = 2
    seed: str = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text; the unit of the budget."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]"), "")).cast("long")


def _looked_up(key: Column, values: dict, default: Column) -> Column:
    if not values:
        return default
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.coalesce(key, F.lit(""))), default)


def _whole(column: Column) -> Column:
    return column.cast("decimal(38,0)")


def share_out(children: DataFrame, parent: tuple[str, ...], child: str) -> DataFrame:
    """Fill siblings by weight up to their limits: adds `share` to (parent..., child, weight, limit, budget).

    Sorted by limit / weight, siblings that cannot use their share come first;
    the rest divide what is left. Single tokens that division leaves over go to
    the first of the rest.
    """
    order = [(F.col("limit") / F.col("weight")).asc(), F.col(child).asc_nulls_first()]
    by = Window.partitionBy(*parent).orderBy(*order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    group = Window.partitionBy(*parent)
    step = children.withColumn("_used", F.coalesce(F.sum("limit").over(before), F.lit(0))) \
        .withColumn("_weights", F.sum("weight").over(after))
    full = _whole(F.col("limit")) * F.col("_weights") <= (_whole(F.col("budget")) - F.col("_used")) * F.col("weight")
    step = step.withColumn("_full", full) \
        .withColumn("_left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("limit"))).over(group), F.lit(0))) \
        .withColumn("_rest", F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), F.lit(0)))
    part = F.when(F.col("_full"), F.lit(0)).otherwise(
        F.expr("cast(_left as decimal(38,0)) * weight div _rest")).cast("long")
    step = step.withColumn("_part", part) \
        .withColumn("_over", F.col("_left") - F.sum("_part").over(group)) \
        .withColumn("_place", F.sum(F.when(F.col("_full"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    share = F.when(F.col("_full"), F.col("limit")).otherwise(
        F.col("_part") + F.when(F.col("_place") <= F.col("_over"), 1).otherwise(0))
    return step.withColumn("share", share.cast("long")).drop(*[c for c in step.columns if c.startswith("_")])


def _null_safe(a: DataFrame, b: DataFrame, keys: tuple[str, ...]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[f"p_{k}"])
    return cond


def _with_budget(children: DataFrame, parents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    up = parents.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("share").alias("budget"))
    return children.join(up, _null_safe(children, up, keys)).select(*children.columns, "budget")


def leaf_plan(leaves: DataFrame, policy: MixPolicy) -> DataFrame:
    """For each leaf (domain, lang, source, tokens, docs): share, whole epochs, tokens of the last one, cells of its order."""
    none = F.lit(policy.default_weight)
    leaves = leaves.withColumn("weight", _looked_up(F.col("source"), policy.sources, none).cast("long")).where("weight > 0") \
        .withColumn("limit", F.col("tokens") * policy.epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("limit").alias("limit")) \
        .withColumn("weight", _looked_up(F.col("lang"), policy.langs, none).cast("long")).where("weight > 0")
    domains = langs.groupBy("domain").agg(F.sum("limit").alias("limit")) \
        .withColumn("weight", _looked_up(F.col("domain"), policy.domains, none).cast("long")).where("weight > 0")
    total = leaves.agg(F.expr(f"cast(cast(sum(tokens) as decimal(38,0)) * {policy.budget_percent} div 100 as long)").alias("share"))
    domains = share_out(_with_budget(domains, total, ()).withColumn("_all", F.lit(0)), ("_all",), "domain")
    langs = share_out(_with_budget(langs, domains, ("domain",)), ("domain",), "lang")
    leaves = share_out(_with_budget(leaves, langs, ("domain", "lang")), ("domain", "lang"), "source")
    per = F.greatest("tokens", F.lit(1))
    return leaves.select(*LEAF, "tokens", "docs", "share", F.expr("share div greatest(tokens, 1)").alias("whole"),
                         (F.col("share") % per).alias("last"), F.ceil(F.sqrt("docs")).cast("long").alias("cells"))


def with_leaf(docs: DataFrame, policy: MixPolicy) -> DataFrame:
    """row (the columns of `docs`), doc_id, domain, lang, source, text, named (what gives a row its place: doc_id, without one its text)."""
    domain = _looked_up(F.col("source"), policy.domain_of, F.lit(policy.other_domain))
    named = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", domain.alias("domain"), "lang", "source", "text", named.alias("named"))


def _placed(rows: DataFrame, plan: DataFrame, policy: MixPolicy) -> DataFrame:
    """Rows with their leaf's plan, their place in the last epoch's order, and its cell."""
    up = plan.select(*[F.col(k).alias(f"p_{k}") for k in LEAF], *[c for c in plan.columns if c not in LEAF])
    said = F.concat_ws(":", F.lit(policy.seed), (F.col("whole") + 1).cast("string"), F.col("named"))
    joined = rows.join(up, _null_safe(rows, up, LEAF)).drop(*[f"p_{k}" for k in LEAF])
    return joined.withColumn("place", F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")) \
        .withColumn("cell", F.expr(f"place * cells div {SPACE}"))


def mix(docs: DataFrame, policy: MixPolicy) -> DataFrame:
    """row, domain, n_tokens, epoch: one row for each document and epoch in which it is taken."""
    rows = with_leaf(docs, policy)
    counted = stored(rows.select("named", *LEAF, word_count(F.col("text")).alias("n_tokens")), "mix-counts")
    leaves = counted.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = stored(leaf_plan(leaves, policy), "mix-plan")
    cells = _placed(counted, plan, policy).groupBy(*LEAF, "cell", "last").agg(F.sum("n_tokens").alias("in_cell"))
    upto = Window.partitionBy(*LEAF).orderBy("cell")
    ends = cells.withColumn("upto", F.sum("in_cell").over(upto)).where(F.col("upto") > F.col("last")) \
        .groupBy(*LEAF).agg(F.min(F.struct("cell", (F.col("upto") - F.col("in_cell")).alias("before"))).alias("end"))
    up = ends.select(*[F.col(k).alias(f"p_{k}") for k in LEAF], F.col("end.cell").alias("end_cell"), F.col("end.before").alias("before"))
    plan = stored(plan.join(up, _null_safe(plan, up, LEAF), "left").drop(*[f"p_{k}" for k in LEAF]), "mix-cells")

    placed = _placed(rows, plan, policy)
    at_end = F.coalesce(F.col("cell") == F.col("end_cell"), F.lit(False))
    whole = placed.where(~at_end).withColumn("copies", F.col("whole") + F.coalesce(
        F.col("cell") < F.col("end_cell"), F.lit(True)).cast("long")).where("copies > 0") \
        .withColumn("n_tokens", word_count(F.col("text")))
    order = Window.partitionBy(*LEAF).orderBy("place", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.where(at_end).withColumn("n_tokens", word_count(F.col("text"))) \
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(order)) \
        .withColumn("copies", F.col("whole") + (F.col("upto") <= F.col("last")).cast("long")).where("copies > 0")
    both = whole.select("row", "domain", "n_tokens", "copies").unionByName(split.select("row", "domain", "n_tokens", "copies"))
    return both.select("row", "domain", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("epoch"))


def mixed_documents(docs: DataFrame, policy: MixPolicy) -> DataFrame:
    """The rows taken, once for each epoch, with the columns of `docs`."""
    return mix(docs, policy).select("row.*")


def _case(column: str, values: dict, default) -> str:
    said = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    when = " ".join(f"WHEN '{k}' THEN {said(v)}" for k, v in values.items())
    return f"CASE {column} {when} ELSE {said(default)} END" if when else said(default)


def mix_sql(policy: MixPolicy, source: str = "documents") -> str:
    """DuckDB SQL for `mix`: doc_id, domain, lang, source, n_tokens, epoch. It sorts whole leaves."""

    def level(name: str, frm: str, parent: str, child: str) -> str:
        by = f"PARTITION BY {parent} " if parent else ""
        order = f"ORDER BY lim / weight, {child} NULLS FIRST"
        return f"""
{name}_a AS (SELECT *, coalesce(sum(lim) OVER ({by}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
    sum(weight) OVER ({by}{order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM {frm}),
{name}_b AS (SELECT *, lim::HUGEINT * ws <= (budget::HUGEINT - used) * weight AS full_up FROM {name}_a),
{name}_c AS (SELECT *, budget - coalesce(sum(lim) FILTER (full_up) OVER ({by}), 0) AS lft,
    coalesce(sum(weight) FILTER (NOT full_up) OVER ({by}), 0) AS rest FROM {name}_b),
{name}_d AS (SELECT *, CASE WHEN full_up THEN 0 ELSE (lft::HUGEINT * weight) // rest END AS part FROM {name}_c),
{name}_e AS (SELECT *, lft - sum(part) OVER ({by}) AS over,
    sum(CASE WHEN full_up THEN 0 ELSE 1 END) OVER ({by}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM {name}_d),
{name} AS (SELECT * EXCLUDE (used, ws, full_up, lft, rest, part, over, nth), (CASE WHEN full_up THEN lim
    ELSE part + CASE WHEN nth <= over THEN 1 ELSE 0 END END)::BIGINT AS share FROM {name}_e)"""

    return f"""
WITH d AS (SELECT doc_id, text, {_case("source", policy.domain_of, policy.other_domain)} AS domain, lang, source,
    len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''])::BIGINT AS n_tokens FROM {source}),
l0 AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {policy.epochs})::BIGINT AS lim,
    {_case("source", policy.sources, policy.default_weight)} AS weight FROM d GROUP BY ALL),
l1 AS (SELECT * FROM l0 WHERE weight > 0),
g0 AS (SELECT domain, lang, sum(lim)::BIGINT AS lim, {_case("lang", policy.langs, policy.default_weight)} AS weight FROM l1 GROUP BY domain, lang),
g1 AS (SELECT * FROM g0 WHERE weight > 0),
m0 AS (SELECT domain, sum(lim)::BIGINT AS lim, {_case("domain", policy.domains, policy.default_weight)} AS weight FROM g1 GROUP BY domain),
m1 AS (SELECT *, (SELECT (sum(tokens)::HUGEINT * {policy.budget_percent}) // 100 FROM l1) AS budget FROM m0 WHERE weight > 0),
{level("m", "m1", "", "domain")},
g2 AS (SELECT g1.*, m.share AS budget FROM g1 JOIN m ON g1.domain IS NOT DISTINCT FROM m.domain),
{level("g", "g2", "domain", "lang")},
l2 AS (SELECT l1.*, g.share AS budget FROM l1 JOIN g ON l1.domain IS NOT DISTINCT FROM g.domain AND l1.lang IS NOT DISTINCT FROM g.lang),
{level("l", "l2", "domain, lang", "source")},
p AS (SELECT d.*, l.share // greatest(l.tokens, 1) AS whole, l.share % greatest(l.tokens, 1) AS last_tokens
    FROM d JOIN l ON d.domain IS NOT DISTINCT FROM l.domain AND d.lang IS NOT DISTINCT FROM l.lang AND d.source IS NOT DISTINCT FROM l.source),
q AS (SELECT *, ('0x' || substr(md5('{policy.seed}:' || (whole + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS place FROM p),
r AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q)
SELECT doc_id, domain, lang, source, n_tokens, unnest(generate_series(1, (whole + CASE WHEN upto <= last_tokens THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS epoch
FROM r"""
