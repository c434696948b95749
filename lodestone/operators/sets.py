"""Joins of sets by the share that they have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import kept


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score): ids of a left and a right set whose intersection over union is at least `least`, every such pair and
    no other. Both sides: id, items (distinct). Null and empty sets are like nothing.

    Items stand in one order, the rarest on both sides first. Two sets so much alike share one of the first
    n - ceil(least * n) + 1 items of each, so only sets that meet in such an item, and are not too unlike in size, are
    compared. Frequent items stand last and so make no candidates; what still meets more than once is compared once."""

    def told(rows: DataFrame) -> DataFrame:
        return kept(rows.where(F.size("items") > 0).select("id", "items", F.size("items").alias("n")))

    a, b = told(left), told(right)
    counts = a.select(F.explode("items").alias("item")).unionByName(b.select(F.explode("items").alias("item"))).groupBy("item").agg(F.count("*").alias("times"))

    def first(rows: DataFrame, id: str, n: str) -> DataFrame:
        each = rows.select("id", "n", F.explode("items").alias("item")).join(counts, "item")
        listed = each.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("x"))  # one set
        size = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
        return listed.select(F.col("id").alias(id), F.col("n").alias(n), F.explode(F.slice("x", F.lit(1), size.cast("int"))).alias("x")).select(id, n, F.col("x.item").alias("item"))

    def near(x: Column, y: Column) -> Column:
        return x >= y * least - 1e-9

    met = first(a, "a", "n_a").join(first(b, "b", "n_b"), "item").where(near(F.col("n_a"), F.col("n_b")) & near(F.col("n_b"), F.col("n_a")))
    pairs = met.select("a", "b").distinct()
    both = pairs.join(a.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(b.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("score")).where(F.col("score") >= least)
