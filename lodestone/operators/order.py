"""Places and running sums in sorted tables whose keys may hold any share of the rows: no key is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import dropped, kept


def placed(rows: DataFrame, keys: list[str], order: list[Column | str], value: str | None = None) -> DataFrame:
    """Adds `place` (from 0 within the keys, in order) and, for a value, `before` (its sum over earlier rows of the key).

    Rows are sorted into ranges of (keys, order) over all tasks. Within a range a window counts; a range's totals of each
    key are rows of their own, as many as ranges that the key spans, and what they sum up to is added by a join on (keys,
    range). `order` should settle ties. Null keys are a key; null values count as 0."""
    pid, key = "__part", "__key"
    ordered = rows.repartitionByRange(*keys, *order) if keys or order else rows
    told = kept(ordered.withColumns({pid: F.spark_partition_id(), key: F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__one"))}))
    own = Window.partitionBy(key, pid).orderBy(*order)
    add = F.coalesce(F.col(value), F.lit(0)) if value else None
    sums = [F.count("*").alias("__n"), *([F.sum(add).alias("__s")] if value else [])]
    earlier = Window.partitionBy(key).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    totals = told.groupBy(key, pid).agg(*sums)
    totals = totals.select(key, pid, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"), *([F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s")] if value else []))
    local = told.withColumn("__place", F.row_number().over(own) - 1)
    if value:
        local = local.withColumn("__before", F.coalesce(F.sum(add).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    both = local.join(totals, [key, pid])
    out = [F.col(c) for c in rows.columns] + [(F.col("__place") + F.col("__n")).alias("place")]
    return both.select(*out, *([(F.col("__before") + F.col("__s")).alias("before")] if value else []))


def ranked_values(rows: DataFrame, keys: list[str], value: str, ties: str, shares: dict[str, float]) -> DataFrame:
    """keys, n, the columns named by `shares` (the value at floor(n * share), the last at most) and the exact `median`: rows
    are placed over all tasks and only those whose place is asked for are kept. Null values are left out."""
    there = rows.where(F.col(value).isNotNull()).select(*keys, value, ties)
    at = placed(there, keys, [value, ties])
    sizes = there.groupBy(*keys).agg(F.count("*").alias("n"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    wanted = {name: F.least(F.floor(F.col("n") * share), F.col("n") - 1) for name, share in shares.items()} | {"__low": low, "__high": high}
    key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__one"))
    asked = sizes.select(key.alias("k"), "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), p.cast("long").alias("place")) for name, p in wanted.items()])).alias("x"))
    asked = asked.select("k", "n", "x.name", "x.place")  # a few places of each key
    hit = at.select(key.alias("k"), F.col("place").cast("long").alias("place"), value).join(asked, ["k", "place"])
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col(value)))
    told = hit.groupBy("k").agg(F.first("n").alias("n"), *[pick(name).alias(name) for name in shares], ((pick("__low") + pick("__high")) / 2).alias("median"))
    return told.select(*[F.col(f"k.{k}").alias(k) for k in keys], "n", *shares, "median")


def greedy_within(rows: DataFrame, keys: list[str], order: list[Column | str], size: str, budget: int, most: int | None = None) -> DataFrame:
    """The rows that a plain loop would take: in order, each that still fits its key's budget, and on past those that
    don't; at most `most` a key, if given. Adds `used`, what is used with the row.

    In a round the longest prefix that fits is taken, and of the rest all rows that are larger than the room left are
    gone for good; rounds end when nothing is left. A round works on all keys at once, by placed(), whatever share of
    the rows a key has. Rows without a size, or with a negative one, are not taken. `order` should settle ties."""
    left = kept(rows.where(F.col(size) >= 0).where(F.col(size) <= budget).withColumns({"__used": F.lit(0).cast("long"), "__taken": F.lit(0).cast("long")}))
    taken, names = None, rows.columns
    while True:
        at = kept(placed(left, keys, order, size).withColumn("used", F.col("__used") + F.col("before") + F.col(size)).withColumn("__rank", F.col("__taken") + F.col("place")))
        fits = (F.col("used") <= budget) & (F.lit(True) if most is None else F.col("__rank") < most)
        own = kept(at.where(fits).select(*names, F.col("used").cast("long").alias("used")))
        taken = own if taken is None else taken.unionByName(own)
        key = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__one"))
        now = at.where(fits).groupBy(key.alias("__k")).agg(F.max("used").cast("long").alias("__now"), (F.max("__rank") + 1).cast("long").alias("__count"))
        rest = at.where(~fits).select(*names, key.alias("__k")).join(now, "__k").where(F.col("__now") + F.col(size) <= budget)  # a key's first row always fits
        if most is not None:
            rest = rest.where(F.col("__count") < most)
        new = kept(rest.select(*names, F.col("__now").alias("__used"), F.col("__count").alias("__taken")))
        dropped(left, at)
        if new.isEmpty():
            dropped(new)
            return taken
        left = new
