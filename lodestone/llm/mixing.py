"""Mixing sources to target weights by hierarchical budgets.

Documents hang on a tree of levels (domain, language, source); each node has a weight among its siblings and can give
the tokens below it, MAX_EPOCHS times. The total goes down the tree. At a node it is split by weight; a child that can't
take its share gives what it can, and the rest goes to its siblings by their weights. As a node never gets more than
what lies below it, a shortage stays among siblings as long as they can fill it and goes on through the ancestors only
then. All amounts are whole tokens.

A leaf with budget b and a tokens gives whole epochs, b div a of them, and then a prefix of one more: its documents in
the order of a hash of seed, epoch and doc_id, as long as their tokens fit in what is left. The prefix's last document
lies in one of 4096 ranges of the hash; only that range's documents are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEED, MAX_EPOCHS, RANGE = 7, 4, 3  # RANGE: hex digits that name a range
#: Up to so many leaves, the leaves' table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_LEAVES = 50_000
LEVELS = ("domain", "lang", "source")
#: Weights among siblings; a name that isn't listed has the weight under "".
WEIGHTS = {"domain": {"web": 500, "books": 300, "forum": 200, "": 50}, "lang": {"en": 600, "de": 150, "es": 120, "fr": 130, "": 50}, "source": {"": 1}}


def words(text: Column) -> Column:
    """Tokens as pieces between blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source of the test data: by the number in its name, modulo 3."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]+)", 1)
    return F.when(number == "", "other").otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum")), (F.pmod(number.cast("long"), F.lit(3)) + 1).cast("int")))


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    own = weights[level]
    named = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])
    return F.coalesce(F.try_element_at(named, F.col(level)), F.lit(own.get("", 0))).cast("long")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], total: Column, max_epochs: int) -> DataFrame:
    """Adds `budget` to the leaves (levels, tokens). `total` is an expression over `tokens`, the sum of all."""
    can = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    all_of = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).select(total.cast("long").alias("budget"))
    parents, above = all_of, []
    for level in levels:
        keys = [*above, level]
        nodes = can.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights)).where("weight > 0")
        nodes = nodes.join(parents, above) if above else nodes.crossJoin(F.broadcast(parents))  # the root is one row
        among = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        order = among.orderBy(F.col("cap") / F.col("weight"), level)
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumn("room", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        nodes = nodes.withColumn("heavy", F.sum("weight").over(among) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        nodes = nodes.withColumn("full", F.col("cap") * F.col("heavy") <= F.col("weight") * F.col("room"))
        taken, light = F.sum(F.when(F.col("full"), F.col("cap"))).over(among), F.sum(F.when(~F.col("full"), F.col("weight"))).over(among)
        nodes = nodes.withColumn("left", F.col("budget") - F.coalesce(taken, F.lit(0))).withColumn("light", light)
        parents = nodes.select(*keys, F.when(F.col("full"), F.col("cap")).otherwise(F.expr("weight * left div light")).alias("budget"))
        above = keys
    return leaves.join(parents, list(levels))


def key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), epoch, doc_id))


def plan(docs: DataFrame, levels: Sequence[str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, total: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Per leaf: levels, tokens, budget, epochs (whole ones) and cut (the last hash of the prefix of one more).

    docs: levels (not null), doc_id, tokens. Without `total`, the budget is as many tokens as there are."""
    leaf = list(levels)
    leaves = docs.groupBy(*leaf).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
    leaves = stored(budgets(leaves, levels, weights, F.col("tokens") if total is None else total, max_epochs))
    leaves = leaves.withColumn("epochs", F.expr("budget div tokens")).withColumn("rest", F.expr("budget % tokens"))
    small = leaves.where("rest > 0").select(*leaf, "epochs", "rest")
    keyed = docs.join(small, leaf).withColumn("key", key(F.col("epochs"), F.col("doc_id"), seed)).withColumn("range", F.substring("key", 1, RANGE))
    sums = keyed.groupBy(*leaf, "range", "rest").agg(F.sum("tokens").alias("held"))
    until = F.sum("held").over(Window.partitionBy(*leaf).orderBy("range"))  # at most 16 ** RANGE rows a leaf
    edge = sums.withColumn("until", until).where("until > rest and until - held <= rest").select(*leaf, "range", (F.col("rest") - F.col("until") + F.col("held")).alias("room"))
    last = keyed.join(edge, [*leaf, "range"])
    upto = F.sum("tokens").over(Window.partitionBy(*leaf, "range").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    fits = last.withColumn("upto", upto).groupBy(*leaf, "range").agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("key"))).alias("cut"))
    cuts = fits.select(*leaf, F.coalesce("cut", "range").alias("cut"))
    return leaves.join(cuts, leaf, "left").withColumn("cut", F.coalesce("cut", F.lit(""))).drop("rest")


def with_leaf(docs: DataFrame, domain: Column | None = None) -> DataFrame:
    """docs with `domain`, and "unknown" for a null language or source."""
    named = docs.withColumn("domain", domain_of(F.col("source")) if domain is None else domain)
    return named.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in LEVELS})


def chosen(docs: DataFrame, leaves: DataFrame, levels: Sequence[str] = LEVELS, seed: int = SEED) -> DataFrame:
    """docs (levels, doc_id and any others) with `copies`, the times that the plan takes them, where that is not 0."""
    few = leaves.select(*levels, "epochs", "cut")
    few = F.broadcast(few) if few.count() <= BROADCAST_LEAVES else few
    out = docs.join(few, list(levels))
    more = (key(F.col("epochs"), F.col("doc_id"), seed) <= F.col("cut")).cast("long")
    return out.withColumn("copies", F.col("epochs") + more).where("copies > 0").drop("epochs", "cut")


def mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, total: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per document that the mix takes: doc_id, domain, lang, source, tokens, copies.

    Null language or source is "unknown"; null text has no tokens, and comes with a leaf's documents by its hash. Rows
    that repeat a doc_id come together or not at all. A document goes in whole or not. Only doc_id, text, lang and
    source are read. An empty table gives no rows."""
    told = with_leaf(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", words(F.col("text")).alias("tokens")))
    told = stored(told.select("doc_id", *LEVELS, "tokens"))
    return chosen(told, stored(plan(told, LEVELS, weights, total, max_epochs, seed)), LEVELS, seed).select("doc_id", *LEVELS, "tokens", "copies")


def mixed_documents(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, total: Column | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The documents that the mix takes, each as often as it does, with their own columns."""
    told = with_leaf(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", words(F.col("text")).alias("tokens")))
    told = stored(told.select("doc_id", *LEVELS, "tokens"))
    leaves = stored(plan(told, LEVELS, weights, total, max_epochs, seed))
    whole = with_leaf(docs.select(F.col("doc_id"), "lang", "source", F.struct(*docs.columns).alias("row")))
    taken = chosen(whole, leaves, LEVELS, seed)
    return taken.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy")).drop("__copy")


def _sql_level(name: str, keys: list[str], weights: Mapping[str, Mapping[str, int]], parent: str) -> str:
    """DuckDB SQL of one level of the tree: a budget for each node."""
    own, above = weights[keys[-1]], keys[:-1]
    weight = "CASE " + " ".join(f"WHEN {keys[-1]} = '{k}' THEN {w}" for k, w in own.items() if k) + f" ELSE {own.get('', 0)} END" if any(own) else str(own.get("", 0))
    by, part = ", ".join(keys), f"PARTITION BY {', '.join(above)}" if above else ""
    return f"""
    {name}_n AS (SELECT {by}, sum(cap)::BIGINT AS cap, ({weight})::BIGINT AS weight FROM leaves GROUP BY {by}),
    {name}_o AS (SELECT n.*, p.budget, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_b, coalesce(sum(weight) OVER b, 0)::BIGINT AS weight_b,
        (sum(weight) OVER ({part}))::BIGINT AS weights FROM {name}_n n {f"JOIN {parent} p USING ({', '.join(above)})" if above else f"CROSS JOIN {parent} p"} WHERE weight > 0
        WINDOW b AS ({part} ORDER BY cap::DOUBLE / weight::DOUBLE, {keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    {name}_f AS (SELECT *, cap * (weights - weight_b) <= weight * (budget - cap_b) AS is_full FROM {name}_o),
    {name} AS (SELECT {by}, CASE WHEN is_full THEN cap ELSE (weight * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({part}), 0)::BIGINT))
        // (sum(weight) FILTER (NOT is_full) OVER ({part}))::BIGINT END AS budget FROM {name}_f)"""


def oracle(weights: Mapping[str, Mapping[str, int]] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The rows of mixed() for the table `documents`, in DuckDB SQL: plain windows over whole leaves."""
    leaf = ", ".join(LEVELS)
    return f"""WITH told AS (SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)', 1) = '' THEN 'other' ELSE
            ['web', 'books', 'forum'][(CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 3 + 1)::INT] END AS domain,
        coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
        coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS tokens FROM documents),
    sums AS (SELECT {leaf}, sum(tokens)::BIGINT AS tokens FROM told GROUP BY {leaf} HAVING sum(tokens) > 0),
    leaves AS (SELECT *, tokens * {max_epochs} AS cap FROM sums),
    root AS (SELECT coalesce(sum(tokens), 0)::BIGINT AS budget FROM leaves),{_sql_level("one", ["domain"], weights, "root")},{_sql_level("two", ["domain", "lang"], weights, "one")},{_sql_level("three", ["domain", "lang", "source"], weights, "two")},
    epochs AS (SELECT {leaf}, budget // tokens AS epochs, budget % tokens AS rest FROM leaves JOIN three USING ({leaf})),
    keyed AS (SELECT t.*, epochs, rest, md5(concat_ws('|', {seed}, epochs, doc_id)) AS key FROM told t JOIN epochs USING ({leaf})),
    placed AS (SELECT *, sum(tokens) OVER (PARTITION BY {leaf} ORDER BY key) AS upto FROM keyed),
    taken AS (SELECT *, (epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM placed)
    SELECT doc_id, {leaf}, tokens, copies FROM taken WHERE copies > 0"""
