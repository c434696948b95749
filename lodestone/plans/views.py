"""Queries over interactions, scores and events (S, F, A, W, L, U, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import detect as D
from lodestone.operators import views as V
from lodestone.sources import model as M
from lodestone.sources.model import as_of, read, sql

from . import texts
from .base import query

NOW = f"TIMESTAMP '{M.AS_OF}'"
LONG = lambda *names: [F.col(n).cast("long").alias(n) for n in names]


def interactions(spark, folder):
    return M.interactions(spark, folder)


def events(spark, folder):
    return read(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


EV = "ev AS (SELECT event_id, ts::TIMESTAMP AS ts, user_id, event_type, value FROM events)"


@query("s15_validated_memories", sql("SELECT interaction_id, session_id, interaction_type, weight, access_count FROM interactions WHERE is_validated AND weight >= 0.3", "interactions"))
def validated_memories(spark, folder):
    return V.validated(interactions(spark, folder)).select("interaction_id", "session_id", "interaction_type", "weight", "access_count")


@query("s16_active_memories", sql(f"SELECT interaction_id, weight, floor(epoch({NOW} - last_accessed) / 86400)::BIGINT AS days_since_access, round(access_count / greatest(1, floor(epoch({NOW} - created_at) / 86400)), 8)::DOUBLE AS access_rate FROM interactions WHERE is_validated AND weight > 0.2 AND last_accessed > {NOW} - INTERVAL 30 DAYS", "interactions"))
def active_memories(spark, folder):
    return V.active(interactions(spark, folder), as_of(), least=0.2).select("interaction_id", "weight", F.col("days_since_access").cast("long"), F.round("access_rate", 8).alias("access_rate"))


@query("a07_session_stats", sql("SELECT session_id, count(*) AS total, round(avg(weight), 8) AS avg_weight, max(weight) AS max_weight, min(weight) AS min_weight, sum(access_count)::BIGINT AS accesses, max(last_accessed) AS last_activity, array_to_string(list_sort(list(DISTINCT interaction_type)), ',') AS types FROM interactions WHERE is_validated GROUP BY session_id", "interactions"))
def session_stats(spark, folder):
    return V.session_stats(interactions(spark, folder)).withColumns({"avg_weight": F.round("avg_weight", 8), "types": F.array_join("types", ",")})


DECAYED = f"""joined AS (SELECT i.*, coalesce(d.rate, 0.0001) AS rate, coalesce(d.least, 0.01) AS least, coalesce(d.faster_after, 30) AS faster_after, coalesce(d.preserve, 0.85) AS preserve, floor(epoch({NOW} - last_accessed) / 86400) AS days FROM interactions i LEFT JOIN decay d USING (interaction_type)),
    raw AS (SELECT *, weight * exp(-rate * days * CASE WHEN days > faster_after THEN 1.5 ELSE 1.0 END) * CASE WHEN access_count > 1 THEN 1 + ln(access_count) * 0.05 ELSE 1 END AS w FROM joined),
    decayed AS (SELECT *, least(greatest(w, least), 1.0)::DOUBLE AS new_weight FROM raw),
    acted AS (SELECT *, CASE WHEN weight >= preserve THEN 'preserve' WHEN new_weight <= least THEN 'remove' WHEN abs(new_weight - weight) > 0.001 THEN 'update' ELSE 'keep' END AS action FROM decayed),
    applied AS (SELECT *, CASE action WHEN 'remove' THEN 0.0 WHEN 'update' THEN new_weight ELSE weight END::DOUBLE AS applied FROM acted)"""


@query("x13_decay", sql(f"{DECAYED} SELECT interaction_id, days::BIGINT AS days, round(new_weight, 8) AS new_weight FROM decayed", "interactions", "decay"))
def decay(spark, folder):
    return V.with_decay(interactions(spark, folder), M.decay_config(spark), as_of()).select("interaction_id", F.col("days").cast("long"), F.round("new_weight", 8).alias("new_weight"))


@query("m01_decay_batch", sql(f"{DECAYED} SELECT interaction_id, action, round(applied, 8) AS applied FROM applied", "interactions", "decay"))
def decay_batch(spark, folder):
    return V.decay_batch(interactions(spark, folder), M.decay_config(spark), as_of()).select("interaction_id", "action", F.round("applied", 8).alias("applied"))


@query("a20_decay_summary", sql(f"{DECAYED} SELECT count(*) AS processed, count(*) FILTER (action = 'preserve') AS preserve_n, count(*) FILTER (action = 'remove') AS remove_n, count(*) FILTER (action = 'update') AS update_n, count(*) FILTER (action = 'keep') AS keep_n, round(avg(CASE WHEN weight > 0 THEN (weight - applied) / weight * 100 END), 8) AS avg_decay_percent FROM applied", "interactions", "decay"))
def decay_summary(spark, folder):
    return V.decay_summary(V.decay_batch(interactions(spark, folder), M.decay_config(spark), as_of())).withColumn("avg_decay_percent", F.round("avg_decay_percent", 8))


@query("a08_decay_statistics", sql("SELECT count(*) AS total, round(avg(weight), 8) AS avg_weight, count(*) FILTER (weight < 0.1) AS low, count(*) FILTER (weight >= 0.5) AS high, round(avg(access_count), 8) AS avg_access FROM interactions", "interactions"))
def decay_statistics(spark, folder):
    return interactions(spark, folder).agg(F.count("*").alias("total"), F.round(F.avg("weight"), 8).alias("avg_weight"), F.count_if(F.col("weight") < 0.1).alias("low"), F.count_if(F.col("weight") >= 0.5).alias("high"), F.round(F.avg("access_count"), 8).alias("avg_access"))


@query("a09_decay_by_type", sql(f"SELECT interaction_type, count(*) AS n, round(avg(weight), 8) AS avg_weight, min(weight) AS min_weight, max(weight) AS max_weight FROM interactions WHERE last_accessed >= {NOW} - INTERVAL 30 DAYS GROUP BY interaction_type", "interactions"))
def decay_by_type(spark, folder):
    recent = interactions(spark, folder).where(F.col("last_accessed") >= as_of() - F.expr("interval 30 days"))
    return recent.groupBy("interaction_type").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 8).alias("avg_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"))


@query("m02_reinforced", sql("SELECT i.interaction_id, round(CASE WHEN session_id % 10 = 0 THEN greatest(least(weight * d.factor * 1.0, 1.0), weight * 1.1) ELSE weight END, 8)::DOUBLE AS weight, CASE WHEN session_id % 10 = 0 THEN access_count + 1 ELSE access_count END AS access_count FROM interactions i JOIN decay d USING (interaction_type)", "interactions", "decay"))
def reinforced(spark, folder):
    """Reinforces the interactions of a tenth of the sessions: that batch is what the operator is given."""
    i = interactions(spark, folder)
    batch = i.where("session_id % 10 = 0").select("interaction_id", F.lit(1.0).alias("strength"))
    return V.reinforced(i, batch, M.decay_config(spark)).select("interaction_id", F.round("weight", 8).alias("weight"), "access_count")


def validation_log(spark, folder):
    """A row per document: validated_at, validation_type, passed, score."""
    at = F.expr(f"timestamp '{M.AS_OF}' - make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)")
    kind = F.element_at(F.array(F.lit("completeness"), F.lit("safety"), F.lit("temporal")), (F.pmod("doc_id", F.lit(3)) + 1).cast("int"))
    return texts.scored(spark, folder).select("doc_id", "refs", "critical", at.alias("validated_at"), kind.alias("validation_type"), (F.col("score") >= 0.8).alias("passed"), "score")


LOG = f"{texts.SCORED}, log AS (SELECT doc_id, refs, critical, {NOW} - to_minutes(doc_id) AS validated_at, ['completeness', 'safety', 'temporal'][(doc_id % 3 + 1)::INT] AS validation_type, score >= 0.8 AS passed, score FROM scored)"


@query("a01_violations_by_hour", f"WITH {LOG} SELECT date_trunc('hour', validated_at) AS hour, validation_type, count(*) FILTER (NOT passed) AS failed_count, count(*) AS total_count, round(100.0 * count(*) FILTER (NOT passed) / count(*), 2)::DOUBLE AS failure_rate, round(avg(score), 8) AS avg_score FROM log WHERE validated_at > {NOW} - INTERVAL 24 HOURS GROUP BY ALL")
def violations_by_hour(spark, folder):
    log = validation_log(spark, folder).where(F.col("validated_at") > as_of() - F.expr("interval 24 hours"))
    return V.violations_by_hour(log).withColumn("avg_score", F.round("avg_score", 8))


HISTORY = f"{LOG}, history AS (SELECT doc_id AS content, validated_at AS ts, score AS new_score FROM log UNION ALL SELECT doc_id, validated_at + INTERVAL 30 MINUTES, 1.0::DOUBLE FROM log WHERE refs > 0)"


def history(spark, folder):
    """Scores of each document, and again once it is abstracted if it held references."""
    log = validation_log(spark, folder)
    first = log.select(F.col("doc_id").alias("content"), F.col("validated_at").alias("ts"), F.col("score").alias("new_score"))
    later = log.where("refs > 0").select(F.col("doc_id").alias("content"), (F.col("validated_at") + F.expr("interval 30 minutes")).alias("ts"), F.lit(1.0).alias("new_score"))
    return first.unionByName(later)


@query("w01_score_deltas", f"WITH {HISTORY} SELECT content, ts, new_score, lag(new_score) OVER (PARTITION BY content ORDER BY ts) AS previous, new_score - lag(new_score) OVER (PARTITION BY content ORDER BY ts) AS score_delta FROM history")
def score_deltas(spark, folder):
    return V.previous_score(history(spark, folder))


@query("a02_score_dashboard", f"WITH {HISTORY}, d AS (SELECT *, new_score - lag(new_score) OVER (PARTITION BY content ORDER BY ts) AS score_delta FROM history) SELECT date_trunc('hour', ts) AS hour, count(*) AS total, round(avg(new_score), 8) AS avg_score, min(new_score) AS min_score, max(new_score) AS max_score, sum(CASE WHEN new_score < 0.8 THEN 1 ELSE 0 END)::BIGINT AS failed_count, round(avg(coalesce(score_delta, 0.0)), 8)::DOUBLE AS avg_delta FROM d GROUP BY ALL")
def score_dashboard(spark, folder):
    out = V.score_dashboard(V.previous_score(history(spark, folder)))
    return out.withColumns({"avg_score": F.round("avg_score", 8), "avg_delta": F.round("avg_delta", 8)})


@query("a03_quality_trends", f"WITH {LOG} SELECT date_trunc('hour', validated_at) AS hour, count(*) AS assessments, round(avg(score), 8) AS avg_quality, round(count(*) FILTER (passed)::DOUBLE / count(*), 8) AS pass_rate FROM log WHERE validated_at > {NOW} - INTERVAL 7 DAYS GROUP BY ALL")
def quality_trends(spark, folder):
    log = validation_log(spark, folder).where(F.col("validated_at") > as_of() - F.expr("interval 7 days"))
    return log.groupBy(F.date_trunc("hour", "validated_at").alias("hour")).agg(F.count("*").alias("assessments"), F.round(F.avg("score"), 8).alias("avg_quality"), F.round(F.count_if("passed") / F.count("*"), 8).alias("pass_rate"))


@query("a04_quality_issues", "SELECT type, severity, count(*) AS n, count(DISTINCT doc_id) AS affected FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, '{s}' AS severity FROM documents WHERE {texts.like('text', p)}" for k, _, s, p in D.CONCRETE) + ") GROUP BY ALL")
def quality_issues(spark, folder):
    v = read(spark, folder, "documents").select("doc_id", F.explode(D.violations(F.col("text"))).alias("v"))
    return v.groupBy("v.type", "v.severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("affected"))


@query("a05_detection_dashboard")
def detection_dashboard(spark, folder):
    found = D.detections(read(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), M.RULES)
    return found.groupBy("severity").agg(F.count("*").alias("total"), F.countDistinct("rule").alias("rules"), F.countDistinct("id").alias("contents"), F.round(F.avg("confidence"), 8).alias("avg_confidence"), F.max("confidence").alias("max_confidence"), F.count_if(F.col("action") == "quarantine").alias("quarantined"), F.count_if(F.col("action") == "reject").alias("rejected"))


@query("a06_queue_status", f"SELECT CASE WHEN value > 150 THEN 'pending' WHEN value > 50 THEN 'in_progress' ELSE 'done' END AS status, event_type AS scan_type, count(*) AS n, round(avg(epoch({NOW} - ts::TIMESTAMP)), 3) AS avg_age_seconds, min(user_id)::BIGINT AS highest_priority FROM events GROUP BY ALL")
def queue_status(spark, folder):
    status = F.when(F.col("value") > 150, "pending").when(F.col("value") > 50, "in_progress").otherwise("done")
    age = F.unix_micros(as_of()) / 1e6 - F.unix_micros("ts") / 1e6
    return events(spark, folder).groupBy(status.alias("status"), F.col("event_type").alias("scan_type")).agg(F.count("*").alias("n"), F.round(F.avg(age), 3).alias("avg_age_seconds"), F.min("user_id").alias("highest_priority"))


@query("a13_current_metrics", f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, round(median(value), 8) AS median, round(var_samp(value), 4) AS variance, max(value) FILTER (r = floor(n * 0.95)) AS p95, max(value) FILTER (r = floor(n * 0.99)) AS p99 FROM r GROUP BY event_type")
def current_metrics(spark, folder):
    out = V.current_metrics(events(spark, folder), ["event_type"])
    return out.withColumns({"mean": F.round("mean", 8), "median": F.round("median", 8), "variance": F.round("variance", 4)})


def _rollup(unit):
    return f"WITH {EV} SELECT date_trunc('{unit}', ts) AS bucket, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 8) AS avg_value, max(value) AS max_value, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL"


@query("a14_hourly_rollup", _rollup("hour").replace("date_trunc('hour', ts)", "date_trunc('hour', ts)::TIMESTAMP"))
def hourly_rollup(spark, folder):
    return V.rollup(events(spark, folder), "hour").withColumn("avg_value", F.round("avg_value", 8))


@query("a14_daily_rollup", _rollup("day").replace("date_trunc('day', ts)", "date_trunc('day', ts)::TIMESTAMP"))
def daily_rollup(spark, folder):
    return V.rollup(events(spark, folder), "day").withColumn("avg_value", F.round("avg_value", 8))


@query("a15_code_distribution", "SELECT json_extract_string(props, '$.k') AS page, event_type, count(*) AS n FROM events GROUP BY ALL")
def code_distribution(spark, folder):
    return events(spark, folder).groupBy(F.get_json_object("props", "$.k").alias("page"), "event_type").agg(F.count("*").alias("n"))


@query("a24_alerts", f"WITH {EV}, m AS (SELECT user_id, round(avg(value), 8) AS mean, max(value) AS most FROM ev GROUP BY user_id) SELECT user_id, 'mean' AS metric, mean AS value, 60.0::DOUBLE AS threshold FROM m WHERE mean > 60 UNION ALL SELECT user_id, 'most', most, 300.0::DOUBLE FROM m WHERE most > 300")
def alerts(spark, folder):
    m = events(spark, folder).groupBy("user_id").agg(F.round(F.avg("value"), 8).alias("mean"), F.max("value").alias("most"))
    return V.alerts(m, {"mean": 60.0, "most": 300.0})


@query("a25_audit_daily", "SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL")
def audit_daily(spark, folder):
    return events(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("a28_pattern_frequency", sql("SELECT session_id, interaction_type, access_count AS n, round(least(1.0, access_count / 10.0), 4)::DOUBLE AS confidence FROM interactions WHERE access_count >= 3", "interactions"))
def pattern_frequency(spark, folder):
    i = interactions(spark, folder).where("access_count >= 3")
    return i.select("session_id", "interaction_type", F.col("access_count").alias("n"), F.round(F.least(F.lit(1.0), F.col("access_count") / 10), 4).alias("confidence"))


@query("a31_hit_rate", "SELECT event_type, count(*) AS requests, count(DISTINCT user_id) AS keys, round(1 - count(DISTINCT user_id)::DOUBLE / count(*), 8) AS hit_rate FROM events GROUP BY event_type")
def hit_rate(spark, folder):
    """A cache by user would miss once a user."""
    return events(spark, folder).groupBy("event_type").agg(F.count("*").alias("requests"), F.countDistinct("user_id").alias("keys"), F.round(1 - F.countDistinct("user_id") / F.count("*"), 8).alias("hit_rate"))


@query("w02_moving_average", f"WITH {EV} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS smoothed FROM ev")
def moving_average(spark, folder):
    return V.moving_average(events(spark, folder), ["user_id"]).select("event_id", F.round("smoothed", 8).alias("smoothed"))


@query("w03_keep_last", f"WITH {EV} SELECT user_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def keep_last(spark, folder):
    return V.keep_last(events(spark, folder), ["user_id"], 10).select("user_id", "event_id")


BUDGET = "rows AS (SELECT source, doc_id AS id, ceil(length(text) / 4.0)::BIGINT AS tokens, n_chars % 97 AS score FROM documents)"


def budget_rows(spark, folder):
    return read(spark, folder, "documents").select("source", F.col("doc_id").alias("id"), F.ceil(F.length("text") / 4).alias("tokens"), F.pmod("n_chars", F.lit(97)).alias("score"))


@query("w04_token_budget", f"WITH RECURSIVE {BUDGET}, r AS (SELECT source, id, tokens, row_number() OVER (PARTITION BY source ORDER BY score DESC, id) AS n FROM rows), g AS (SELECT DISTINCT source, 0::BIGINT AS n, 0::BIGINT AS used, NULL::BIGINT AS id, false AS took FROM r UNION ALL SELECT r.source, r.n, CASE WHEN g.used + r.tokens <= 4000 THEN g.used + r.tokens ELSE g.used END, r.id, g.used + r.tokens <= 4000 FROM g JOIN r ON r.source = g.source AND r.n = g.n + 1) SELECT source, id, used FROM g WHERE took")
def token_budget(spark, folder):
    return V.within_budget(budget_rows(spark, folder), ["source"], 4000).select("source", "id", "used")


@query("w05_compaction", f"WITH {BUDGET} SELECT source, id, freed_before::BIGINT AS freed_before FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY score, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM rows) WHERE freed_before < 2000")
def compaction(spark, folder):
    return V.to_free(budget_rows(spark, folder), ["source"], 2000).select("source", "id", "freed_before")


@query("w10_first_last_seen", sql("SELECT session_id, min(created_at) AS first_seen, max(last_accessed) AS last_seen, count(*) AS kinds FROM interactions GROUP BY session_id", "interactions"))
def first_last_seen(spark, folder):
    return interactions(spark, folder).groupBy("session_id").agg(F.min("created_at").alias("first_seen"), F.max("last_accessed").alias("last_seen"), F.count("*").alias("kinds"))


@query("l01_heaviest", sql("SELECT interaction_id, weight, access_count FROM interactions ORDER BY weight DESC, access_count DESC, interaction_id LIMIT 50", "interactions"))
def heaviest(spark, folder):
    return interactions(spark, folder).orderBy(F.desc("weight"), F.desc("access_count"), "interaction_id").limit(50).select("interaction_id", "weight", "access_count")


@query("l05_page", sql("SELECT interaction_id, weight FROM interactions ORDER BY last_accessed DESC, interaction_id OFFSET 40 LIMIT 20", "interactions"))
def page(spark, folder):
    return V.page(interactions(spark, folder), [F.desc("last_accessed"), F.col("interaction_id")], 3).select("interaction_id", "weight")


@query("l04_oldest_first", sql("SELECT interaction_id, last_accessed FROM interactions ORDER BY last_accessed, interaction_id LIMIT 100", "interactions"))
def oldest_first(spark, folder):
    return interactions(spark, folder).orderBy("last_accessed", "interaction_id").limit(100).select("interaction_id", "last_accessed")


@query("f03_by_type", sql("SELECT interaction_type, interaction_id FROM interactions WHERE interaction_type IN ('conversation', 'debugging')", "interactions"))
def by_type(spark, folder):
    return interactions(spark, folder).where(F.col("interaction_type").isin("conversation", "debugging")).select("interaction_type", "interaction_id")


@query("f05_json_path", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') <> '/home'")
def json_path(spark, folder):
    return events(spark, folder).where(~F.get_json_object("props", "$.k").eqNullSafe(F.lit("/home"))).select("event_id")


@query("f17_stale", sql(f"SELECT interaction_id, floor(epoch({NOW} - last_accessed) / 86400)::BIGINT AS days FROM interactions WHERE last_accessed < {NOW} - INTERVAL 2 DAYS", "interactions"))
def stale(spark, folder):
    from lodestone.functions import numbers as W

    old = interactions(spark, folder).where(F.col("last_accessed") < as_of() - F.expr("interval 2 days"))
    return old.select("interaction_id", W.whole_days(F.col("last_accessed"), as_of()).cast("long").alias("days"))


@query("m05_quarantine", f"WITH {LOG} SELECT doc_id, score, CASE WHEN critical > 0 THEN 'critical' ELSE 'low_score' END AS reason, validated_at + INTERVAL 30 DAYS AS expires_at FROM log WHERE score < 0.8")
def quarantine(spark, folder):
    low = validation_log(spark, folder).where("score < 0.8")
    return low.select("doc_id", "score", F.when(F.col("critical") > 0, "critical").otherwise("low_score").alias("reason"), (F.col("validated_at") + F.expr("interval 30 days")).alias("expires_at"))


@query("m03_degraded_scores", f"WITH {LOG} SELECT doc_id, round(CASE WHEN NOT passed AND validated_at < {NOW} - INTERVAL 7 HOURS AND score > 0.4 THEN greatest(0.4, score * 0.98) ELSE score END, 8)::DOUBLE AS score FROM log")
def degraded_scores(spark, folder):
    log = validation_log(spark, folder)
    old = ~F.col("passed") & (F.col("validated_at") < as_of() - F.expr("interval 7 hours")) & (F.col("score") > 0.4)
    return log.select("doc_id", F.round(F.when(old, F.greatest(F.lit(0.4), F.col("score") * 0.98)).otherwise(F.col("score")), 8).alias("score"))


@query("m12_change_log", sql("SELECT interaction_id, CASE WHEN session_id % 11 = 0 THEN 'delete' ELSE 'update' END AS operation, CASE WHEN session_id % 11 = 0 THEN 'access_count,weight' ELSE 'weight' END AS changed FROM interactions WHERE session_id % 11 = 0 OR session_id % 5 = 0", "interactions"))
def change_log(spark, folder):
    old = interactions(spark, folder)
    new = old.where("session_id % 11 <> 0").withColumn("weight", F.when(F.col("session_id") % 5 == 0, F.col("weight") + 1).otherwise(F.col("weight")))
    out = V.snapshot_diff(old, new, "interaction_id", ["access_count", "weight"])
    return out.withColumn("changed", F.array_join("changed", ","))


@query("m07_upserted", "SELECT user_id, sum(n)::BIGINT AS n, max(last_used) AS last_used FROM (SELECT user_id, count(*) AS n, max(ts::TIMESTAMP) AS last_used FROM events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT user_id, count(*), max(ts::TIMESTAMP) FROM events WHERE event_id % 2 = 1 GROUP BY 1) GROUP BY user_id")
def upserted(spark, folder):
    halves = [events(spark, folder).where(f"event_id % 2 = {k}").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last_used")) for k in (0, 1)]
    return V.upserted(*halves, "user_id", ["n"], ["last_used"])


@query("v21_constraints", sql("SELECT 'weight_range' AS rule, count(*) FILTER (NOT (weight BETWEEN 0 AND 1)) AS violations FROM interactions UNION ALL SELECT 'time_order', count(*) FILTER (NOT (created_at <= last_accessed)) FROM interactions UNION ALL SELECT 'heavy_enough', count(*) FILTER (NOT (weight >= 0.2)) FROM interactions", "interactions"))
def constraints(spark, folder):
    return V.audit(interactions(spark, folder), {"weight_range": "weight between 0 and 1", "time_order": "created_at <= last_accessed", "heavy_enough": "weight >= 0.2"})


@query("u04_placeholder_difference", f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({texts._ABSTRACT}, '<[a-zA-Z][a-zA-Z0-9_]*>'))), ',') AS added FROM documents")
def placeholder_difference(spark, folder):
    from lodestone.functions import text as X

    d = read(spark, folder, "documents")
    added = F.array_except(X.placeholders(D.abstracted(F.col("text"))), F.filter(X.placeholders(F.col("text")), lambda p: F.lit(False)))
    return d.select("doc_id", F.array_join(F.array_sort(added), ",").alias("added"))
