"""Views, dashboards and jobs over interactions, scores and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import numbers as W

from . import order as R


def validated(interactions: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows that are validated and at least so heavy."""
    return interactions.where(F.col("is_validated") & (F.col("weight") >= least))


def active(interactions: DataFrame, as_of: Column, days: int = 30, least: float = 0.5) -> DataFrame:
    """Validated, heavy and lately accessed rows, with days since access and accesses a day."""
    told = interactions.where(F.col("is_validated") & (F.col("weight") > least) & (F.col("last_accessed") > as_of - F.expr(f"interval {days} days")))
    age = F.greatest(F.lit(1), W.whole_days(F.col("created_at"), as_of))
    return told.withColumns({"days_since_access": W.whole_days(F.col("last_accessed"), as_of), "access_rate": F.col("access_count") / age})


def session_stats(interactions: DataFrame) -> DataFrame:
    """Counts, weights, accesses and types by session, of validated rows."""
    return interactions.where("is_validated").groupBy("session_id").agg(
        F.count("*").alias("total"),
        F.avg("weight").alias("avg_weight"),
        F.max("weight").alias("max_weight"),
        F.min("weight").alias("min_weight"),
        F.sum("access_count").alias("accesses"),
        F.max("last_accessed").alias("last_activity"),
        F.array_sort(F.collect_set("interaction_type")).alias("types"),
    )


def with_decay(interactions: DataFrame, config: DataFrame, as_of: Column) -> DataFrame:
    """Adds new_weight, least and preserve by the type's settings; types without any have the defaults. `config` is one
    row a type."""
    joined = interactions.join(F.broadcast(config), "interaction_type", "left")
    rate, least, after = F.coalesce("rate", F.lit(0.0001)), F.coalesce("least", F.lit(0.01)), F.coalesce("faster_after", F.lit(30))
    days = W.whole_days(F.col("last_accessed"), as_of)
    return joined.withColumns({"days": days, "new_weight": W.decayed(F.col("weight"), days, F.col("access_count"), rate, least, after), "least": least, "preserve": F.coalesce("preserve", F.lit(0.85))}).drop("rate", "factor", "faster_after")


def decay_batch(interactions: DataFrame, config: DataFrame, as_of: Column) -> DataFrame:
    """What a run of decay does with each row: preserve, remove (weight 0), update or keep."""
    told = with_decay(interactions, config, as_of)
    action = (
        F.when(F.col("weight") >= F.col("preserve"), "preserve")
        .when(F.col("new_weight") <= F.col("least"), "remove")
        .when(F.abs(F.col("new_weight") - F.col("weight")) > 0.001, "update")
        .otherwise("keep")
    )
    new = F.when(F.col("action") == "remove", 0.0).when(F.col("action") == "update", F.col("new_weight")).otherwise(F.col("weight"))
    return told.withColumn("action", action).withColumn("applied", new)


def decay_summary(batch: DataFrame) -> DataFrame:
    """One row: how many rows of each action, and the mean share of weight lost."""
    lost = F.when(F.col("weight") > 0, (F.col("weight") - F.col("applied")) / F.col("weight") * 100)
    return batch.agg(F.count("*").alias("processed"), *[F.count_if(F.col("action") == a).alias(f"{a}_n") for a in ("preserve", "remove", "update", "keep")], F.avg(lost).alias("avg_decay_percent"))


def reinforced(interactions: DataFrame, batch: DataFrame, config: DataFrame) -> DataFrame:
    """Rows of the batch (interaction_id, strength) with their new weight and count; others unchanged."""
    joined = interactions.join(batch, "interaction_id", "left").join(F.broadcast(config.select("interaction_type", "factor")), "interaction_type", "left")
    new = F.greatest(F.least(F.col("weight") * F.coalesce("factor", F.lit(1.5)) * F.col("strength"), F.lit(1.0)), F.col("weight") * 1.1)
    hit = F.col("strength").isNotNull()
    return joined.withColumn("weight", F.when(hit, new).otherwise(F.col("weight"))).withColumn("access_count", F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count"))).drop("factor", "strength")


def violations_by_hour(log: DataFrame) -> DataFrame:
    """Failed, total, failure rate and mean score by hour and type. log: validated_at, validation_type, passed, score."""
    return log.groupBy(F.date_trunc("hour", "validated_at").alias("hour"), "validation_type").agg(
        F.count_if(~F.col("passed")).alias("failed_count"),
        F.count("*").alias("total_count"),
        F.round(100.0 * F.count_if(~F.col("passed")) / F.count("*"), 2).alias("failure_rate"),
        F.avg("score").alias("avg_score"),
    )


def score_dashboard(history: DataFrame) -> DataFrame:
    """Scores by hour. history: ts, new_score, score_delta."""
    return history.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("total"),
        F.avg("new_score").alias("avg_score"),
        F.min("new_score").alias("min_score"),
        F.max("new_score").alias("max_score"),
        F.sum(F.when(F.col("new_score") < 0.8, 1).otherwise(0)).alias("failed_count"),
        F.avg(F.coalesce("score_delta", F.lit(0.0))).alias("avg_delta"),
    )


def previous_score(history: DataFrame) -> DataFrame:
    """Adds a content's previous score and the change."""
    w = Window.partitionBy("content").orderBy("ts")
    return history.withColumn("previous", F.lag("new_score").over(w)).withColumn("score_delta", F.col("new_score") - F.col("previous"))


def rank_exact_percentile(values: Column, share: float) -> Column:
    """The element at floor(n * share) of a sorted array, the last one at most."""
    at = F.least(F.floor(F.size(values) * share).cast("int") + 1, F.size(values))
    return F.try_element_at(values, at)


def current_metrics(events: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, exact median, variance and exact 95th and 99th percentiles of `value` by keys. Ranks are places in a
    table sorted over all tasks; the rest are plain aggregates."""
    ranks = R.ranked_values(events, keys, "value", "event_id", {"p95": 0.95, "p99": 0.99}).drop("n")
    told = ranks.select(*[F.col(k).alias(f"__{k}") for k in keys], "median", "p95", "p99")
    sums = events.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return sums.join(told, same, "left").select(*keys, "n", "mean", "median", "variance", "p95", "p99")


def rollup(events: DataFrame, unit: str) -> DataFrame:
    """Events, errors and values by hour or day."""
    return events.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.countDistinct("user_id").alias("users"))


def alerts(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row for each metric (a column) over its limit: key columns, metric, value, threshold."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("threshold")) for k, v in limits.items()])
    keys = [c for c in metrics.columns if c not in limits]
    return metrics.select(*keys, F.explode(each).alias("a")).select(*keys, "a.*").where("value > threshold")


def keep_last(events: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def moving_average(events: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Adds the mean of the last k values of a key."""
    w = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(1 - k, 0)
    return events.withColumn("smoothed", F.avg("value").over(w))


def within_budget(rows: DataFrame, keys: list[str], budget: int, most: int | None = None) -> DataFrame:
    """Rows by score whose tokens fit the budget of their keys, past those that don't fit. rows: keys, id, score, tokens."""
    return R.greedy_within(rows, keys, [F.desc("score"), F.asc("id")], "tokens", budget, most)


def to_free(rows: DataFrame, keys: list[str], required: int) -> DataFrame:
    """The rows of lowest score to drop until `required` tokens are free."""
    at = R.placed(rows, keys, [F.asc("score"), F.asc("id")], "tokens")
    return at.withColumnRenamed("before", "freed_before").where(F.col("freed_before") < required)


def page(rows: DataFrame, order: list[Column], number: int, size: int = 20, most: int = 100) -> DataFrame:
    """A page of rows; pages hold `most` rows at most."""
    size = min(size, most)
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def listed(rows: DataFrame, as_of: Column, kinds: list[str], days: int, limit: int = 20, most: int = 50) -> DataFrame:
    """Rows of some types accessed within some days, latest first; a list holds `most` rows at most."""
    since = as_of - F.expr(f"interval {days} days")
    found = rows.where(F.col("interaction_type").isin(*kinds) & (F.col("last_accessed") > since))
    return found.orderBy(F.desc("last_accessed"), "interaction_id").limit(min(limit, most))


def sorted_page(rows: DataFrame, column: str, direction: str, allowed: list[str], key: str, number: int, size: int = 20) -> DataFrame:
    """A page by a column that a caller names: only those allowed, in a known direction; ties by key."""
    if column not in allowed or direction not in ("asc", "desc"):
        raise ValueError(f"can't sort by {column} {direction}")
    return page(rows, [F.col(column).desc() if direction == "desc" else F.col(column).asc(), F.col(key)], number, size)


def candidates(rows: DataFrame, most: int = 500) -> DataFrame:
    """The rows accessed last, so many at most: what interactive clustering starts from."""
    return rows.orderBy(F.desc("last_accessed"), "interaction_id").limit(most)


def by_category(docs: DataFrame) -> DataFrame:
    """docs once for each category, that of their own (column category) and those of their tags."""
    each = F.array_distinct(F.array_compact(F.concat(F.array("category"), F.coalesce("tags", F.array().cast("array<string>")))))
    return docs.withColumn("category", F.explode(each))


def audit(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """How many rows break each rule, a SQL condition; null counts as kept."""
    counts = rows.agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(True))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("x")).select("x.*")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, operation, changed): insert, update or delete of each row that differs, with the names of changed columns."""
    a = old.select(key, F.struct(*columns).alias("o"))
    b = new.select(key, F.struct(*columns).alias("n"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    op = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("update")
    return both.select(key, op.alias("operation"), changed.alias("changed")).where((F.col("operation") != "update") | (F.size("changed") > 0))


def upserted(old: DataFrame, new: DataFrame, key: str, adds: list[str], latest: list[str]) -> DataFrame:
    """Old and new rows merged by key: `adds` are summed, `latest` are the greatest."""
    both = old.unionByName(new)
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in adds], *[F.max(c).alias(c) for c in latest])


def retained(buckets: DataFrame, as_of: Column, span: str) -> DataFrame:
    """Buckets (column bucket) that a span of retention, such as `24 hours` or `30 days`, still holds."""
    return buckets.where(F.col("bucket") >= as_of - F.expr(f"interval {span}"))


def last_events(events: DataFrame, most: int = 10_000) -> DataFrame:
    """The last events, so many at most: what is kept whatever its age."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def metric_rows(section: str, metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(section, key, metric, value): metrics in long form, one row each, so that sections of any shape stand in one file."""
    key = F.concat_ws(",", *[F.col(k).cast("string") for k in keys])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    return metrics.select(F.lit(section).alias("section"), key.alias("key"), each.alias("m")).select("section", "key", "m.metric", "m.value")


def evolution_patterns(entries: DataFrame, top: int = 10, recent: int = 20) -> DataFrame:
    """(what, rank, reference, n) of changes of references (reference, document, ts, id): the most evolved, the latest
    changes (n is the change's id), and the number of documents affected. Each part takes its top rows first."""
    most = entries.groupBy("reference").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reference").limit(top)
    late = entries.orderBy(F.desc("ts"), F.desc("id")).limit(recent)
    ranked = lambda df, what, order, n: df.select(F.lit(what).alias("what"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"), "reference", n.alias("n"))  # noqa: E731 (top rows only)
    affected = entries.agg(F.countDistinct("document").alias("n")).select(F.lit("affected").alias("what"), F.lit(1).cast("long").alias("rank"), F.lit(None).cast(entries.schema["reference"].dataType).alias("reference"), "n")
    first = ranked(most, "most_evolved", [F.desc("n"), F.asc("reference")], F.col("n"))
    return first.unionByName(ranked(late, "recent", [F.desc("ts"), F.desc("id")], F.col("id").cast("long"))).unionByName(affected)


SYNC = "struct<synced:boolean,path:string,last_sync:timestamp>"


def mark_synced(memories: DataFrame, marks: DataFrame, at: Column) -> DataFrame:
    """memories with `vault_sync` set for those marked (memory_id, path; one row each) and kept for the others."""
    old = F.col("vault_sync") if "vault_sync" in memories.columns else F.lit(None).cast(SYNC)
    told = memories.withColumn("vault_sync", old).join(marks.select("memory_id", F.col("path").alias("__path"), F.lit(True).alias("__marked")), "memory_id", "left")
    new = F.struct(F.lit(True).alias("synced"), F.col("__path").alias("path"), at.cast("timestamp").alias("last_sync"))
    return told.withColumn("vault_sync", F.when(F.col("__marked"), new).otherwise(F.col("vault_sync"))).drop("__path", "__marked")


def clear_synced(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """memories without `vault_sync` for the given memory_ids."""
    told = memories.join(ids.select("memory_id", F.lit(True).alias("__gone")).distinct(), "memory_id", "left")
    return told.withColumn("vault_sync", F.when(F.col("__gone").isNull(), F.col("vault_sync"))).drop("__gone")


def sync_status(memories: DataFrame) -> DataFrame:
    """memory_id, is_synced, path, last_sync and needs_sync: not synced, or updated since (column updated_at)."""
    synced = F.coalesce(F.col("vault_sync.synced"), F.lit(False))
    stale = F.coalesce(F.col("updated_at") > F.col("vault_sync.last_sync"), F.lit(False))
    return memories.select("memory_id", synced.alias("is_synced"), F.col("vault_sync.path").alias("path"), F.col("vault_sync.last_sync").alias("last_sync"), (~synced | stale).alias("needs_sync"))
