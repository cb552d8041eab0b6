"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A token budget flows down the tree domain -> language -> source by the children's weights.
A child that can't use its part (its tokens times ``max_epochs`` are fewer) gets what it
can use, and its siblings share the rest by their weights, before anything goes back to
the level above: a node's own capacity is the sum of its leaves', so a shortage reaches
its parent's other children only when all its own are exhausted. Each leaf then takes
whole epochs and, of the last, the prefix of its documents in a seeded order that fits.

The prefix is found without sorting a leaf: tokens are added up by the leading hex digits
of the order key, and only the group in which the budget ends is split further, step by step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAF = ("domain", "lang", "source")
#: Hex digits of the order key by which tokens are added up, per refinement.
DIGITS = (2, 2, 2)
#: Leaf tables of at most so many rows are broadcast; larger ones are joined over salted keys.
BROADCAST_LEAVES = 20_000
SALTS = 64
NONE = "(none)"


@dataclass(frozen=True)
class Plan:
    """Target weights (whole numbers; 1 unless given; 0: nothing), share of all tokens, epochs and seed."""

    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    share: float = 0.6
    max_epochs: int = 2
    seed: int = 11


def domain_of(source: Column) -> Column:
    """The domain of a source where the caller has none of its own: one of three, by the source's name."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source.cast("binary")), 1, 4), 16, 10).cast("long") % 3).cast("string"))


def n_words(text: Column) -> Column:
    """Tokens of a text: its runs of other characters than ASCII white space."""
    t = F.coalesce(text, F.lit(""))
    runs = F.size(F.split(t, r"[\x09-\x0D\x20]+", -1))
    edges = F.when(t.rlike(r"^[\x09-\x0D\x20]"), 1).otherwise(0) + F.when(t.rlike(r"[\x09-\x0D\x20]\z"), 1).otherwise(0)
    return F.when(t.rlike(r"[^\x09-\x0D\x20]"), runs - edges).otherwise(0).cast("long")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Where a document comes in an epoch: md5 of seed, epoch and id, in hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def _weight(col: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(col) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _fill(nodes: DataFrame, parent: list[str], child: str, budgets: DataFrame | None, total: float,
    weights: dict[str, int]) -> DataFrame:
    """Budgets of the children: (parent columns, child, budget). ``nodes`` has the leaves' capacities.

    Children sorted by capacity per weight fill up one after the other: a child is full if
    giving all from it on the same amount per weight as it can hold stays in the budget.
    """
    caps = nodes.groupBy(*parent, child).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(child, weights)).filter(F.col("w") > 0)
    caps = caps.withColumn("budget_in",
        F.lit(total)) if budgets is None else caps.join(budgets.withColumnRenamed("budget", "budget_in"), parent)
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w"), child)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum("cap")
        .over(before), F.lit(0)) + F.col("cap").cast("double") / F.col("w") * F.sum("w").over(after) <= F.col("budget_in")
    held = caps.withColumn("full", full)
    one = Window.partitionBy(*parent)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(one), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("w"))).over(one)
    part = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * (F.col("budget_in") - spent) / open_)
    return held.select(*parent, child, part.alias("budget"))


def _joined(docs: DataFrame, leaves: DataFrame, on: list[str], key: str, salt: str = "__salt") -> DataFrame:
    """``docs`` joined to its leaf's row: broadcast within the bound, else over salted leaves (``salt``: a name for that)."""
    if leaves.count() <= BROADCAST_LEAVES:
        return docs.join(F.broadcast(leaves), on)
    dealt = leaves.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = docs.withColumn(salt, F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, [*on, salt]).drop(salt)


def _with_leaf(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    return _joined(docs, leaves, list(LEAF), "doc_id")


def leaf_columns(docs: DataFrame, domain: Column | None = None) -> list[Column]:
    """Domain, language and source of a row; a null counts as a name of its own."""
    source = F.coalesce(docs["source"].cast("string"), F.lit(NONE))
    return [
        (domain_of(source) if domain is None else F.coalesce(domain.cast("string"), F.lit(NONE))).alias("domain"),
        F.coalesce(docs["lang"].cast("string"), F.lit(NONE)).alias("lang"),
        source.alias("source"),
    ]


def leaf_budgets(sized: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens, budget, full, rest): whole tokens budgeted to a leaf, its whole epochs, and what the last takes."""
    leaves = stored(sized.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).withColumn("cap", F.col("tokens") * plan.max_epochs))
    total = float((leaves.agg(F.sum("tokens")).first()[0] or 0) * plan.share)
    domains = _fill(leaves, [], "domain", None, total, plan.domains)
    langs = _fill(leaves, ["domain"], "lang", domains, total, plan.langs)
    found = _fill(leaves, ["domain", "lang"], "source", langs, total, plan.sources)
    whole = F.floor(F.col("budget") + 1e-6).cast("long")
    done = leaves.join(found, list(LEAF)).withColumn("budget", F.least(whole, F.col("cap")))
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return stored(done.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).drop("cap"))


def _cuts(sized: DataFrame, leaves: DataFrame, plan: Plan) -> DataFrame:
    """(leaf, full, cut): of epoch ``full``, documents with order keys up to ``cut`` are in; null: none are."""
    some = leaves.filter((F.col("rest") > 0) & (F.col("full") < plan.max_epochs)).select(*LEAF, "full", "rest")
    keyed = _with_leaf(sized, some).select(*LEAF, "full", "rest", order_key(plan.seed, F.col("full"), F.col("doc_id"))
        .alias("key"), "tokens")
    keyed = stored(keyed.groupBy(*LEAF, "full", "key").agg(F.sum("tokens").alias("tokens")))
    cuts, at = some.withColumn("prefix", F.lit("")).withColumn("room", F.col("rest")), 0
    for digits in DIGITS:
        at += digits
        inside = _with_leaf(keyed.drop("full").withColumn("doc_id", F.col("key")), cuts.drop("rest", "full")).filter(F.col("key")
            .startswith(F.col("prefix")))
        # Written first, so that the window below reads one row a group: at most 16^digits a leaf.
        sums = stored(inside.groupBy(*LEAF, F.substring("key", 1, at).alias("group"))
            .agg(F.sum("tokens").alias("n"), F.max("room").alias("room")))
        order = Window.partitionBy(*LEAF).orderBy("group")
        ends = sums.withColumn("upto", F.sum("n")
            .over(order)).filter((F.col("upto") > F.col("room")) & (F.col("upto") - F.col("n") <= F.col("room")) & (F.col("n") > 0))
        hit = ends.select(*LEAF, F.col("group").alias("prefix"), (F.col("room") - F.col("upto") + F.col("n")).alias("room"))
        cuts = stored(cuts.select(*LEAF, "full", "rest").join(hit, list(LEAF)))
    # What is left lies in groups of one in 16^6 keys: taken one by one.
    inside = _with_leaf(keyed.drop("full").withColumn("doc_id", F.col("key")), cuts.drop("rest", "full")).filter(F.col("key")
        .startswith(F.col("prefix")))
    order = Window.partitionBy(*LEAF).orderBy("key")
    first_out = inside.withColumn("upto", F.sum("tokens")
        .over(order)).filter(F.col("upto") > F.col("room")).groupBy(*LEAF).agg(F.min("key").alias("out"))
    return stored(some.select(*LEAF, "full").join(first_out, list(LEAF)))


def _names(docs: DataFrame, *wanted: str) -> dict[str, str]:
    """For each wanted name one that no column of ``docs`` has."""
    used = {c.lower() for c in docs.columns}
    pad = "_"
    while any(f"{pad}{n}" in used for n in wanted):
        pad += "_"
    return {n: f"{pad}{n}" for n in wanted}


def _taken(docs: DataFrame, plan: Plan, domain: Column | None) -> tuple[DataFrame, dict[str, str]]:
    """The selected documents with all columns of ``docs``, and the names of the columns domain, epoch and tokens beside them."""
    named = dict(zip(LEAF, leaf_columns(docs, domain)))
    sized = stored(docs.select(*named.values(), docs["doc_id"].cast("long").alias("doc_id"), n_words(docs["text"]).alias("tokens")))
    leaves = leaf_budgets(sized, plan)
    cuts = _cuts(sized, leaves, plan)
    own = _names(docs, *LEAF, "full", "rest", "out", "id", "tokens", "epoch", "epochs", "salt")
    rules = leaves.select(*LEAF, "full", "rest").join(cuts.drop("full"), list(LEAF), "left")
    rules = stored(rules.select(*(F.col(c).alias(own[c]) for c in (*LEAF, "full", "rest", "out"))))
    kept = [docs[c] for c in docs.columns]
    keys = [named[n].alias(own[n]) for n in LEAF]
    marked = docs.select(*kept, *keys, n_words(docs["text"]).alias(own["tokens"]), docs["doc_id"].cast("long").alias(own["id"]))
    joined = _joined(marked, rules, [own[n] for n in LEAF], own["id"], own["salt"])
    full, rest, out = (F.col(own[c]) for c in ("full", "rest", "out"))
    key = order_key(plan.seed, full, F.col(own["id"]))
    last = (full < plan.max_epochs) & (rest > 0) & (out.isNull() | (key < out))
    n = (full + F.when(last, 1).otherwise(0)).cast("int")
    found = joined.withColumn(own["epochs"], n).filter(F.col(own["epochs"]) > 0)
    found = found.withColumn(own["epoch"], F.explode(F.sequence(F.lit(0), F.col(own["epochs"]) - 1)))
    return found, {c: own[c] for c in ("domain", "epoch", "tokens")}


def take(docs: DataFrame, plan: Plan, domain: Column | None = None) -> DataFrame:
    """The selected documents with all columns of ``docs``, once for each epoch that takes them; see ``mix``."""
    found, _ = _taken(docs, plan, domain)
    return found.select(*docs.columns)


def mix(docs: DataFrame, plan: Plan, domain: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The selected documents: ``columns`` of ``docs`` (all unless given), and ``domain``, ``epoch`` (from 0) and ``tokens``.

    A document comes once for each epoch that takes it. Null languages and sources are names
    of their own; a null or empty text has no tokens and costs nothing; repeated rows of an
    id come or stay together; an empty table gives an empty result. Columns of ``docs`` that
    are named like a new one are replaced.
    """
    kept = [c for c in (columns or docs.columns) if c not in ("domain", "epoch", "tokens")]
    found, names = _taken(docs, plan, domain)
    return found.select(*kept, *(F.col(c).alias(n) for n, c in names.items()))
