"""The engine's tables, bound to Parquet tables: memories, interactions, vectors, relationships, scores.

Each is a DataFrame function of (spark, folder). SQL holds the same tables as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The time that stands for now.
AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


TYPES = ("conversation", "code_generation", "problem_solving", "documentation", "debugging")


def memories(spark: SparkSession, folder: str) -> DataFrame:
    """A user's turn with the assistant's next turn: memory_id, session_id, interaction_type, prompt, response,
    created_at."""
    turns = Window.partitionBy("conv_id").orderBy("turn")
    told = read(spark, folder, "conversations").withColumns({"next_role": F.lead("role").over(turns), "response": F.lead("text").over(turns)})
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.pmod("conv_id", F.lit(5)) + 1).cast("int"))
    made = F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(conv_id as int), cast(turn as int), 0)")
    return told.where("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("conv_id").alias("session_id"), kind.alias("interaction_type"), F.col("text").alias("prompt"), "response", made.alias("created_at"))


EVENT_TYPES = {"click": "conversation", "view": "documentation", "purchase": "code_generation", "signup": "problem_solving", "error": "debugging"}


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """What a user did of one kind: interaction_id, session_id, interaction_type, weight, last_accessed, created_at,
    access_count, is_validated."""
    ev = read(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_TYPES.items()], F.lit("conversation"))
    rows = ev.groupBy("user_id", "event_type").agg(F.max("ts").alias("last_accessed"), F.min("ts").alias("created_at"), F.count("*").alias("access_count"), F.least(F.lit(1.0), F.round(F.avg("value") / 200 + 1e-9, 6)).alias("weight"))
    key = F.concat_ws(":", "user_id", "event_type")
    return rows.select(key.alias("interaction_id"), F.col("user_id").alias("session_id"), kind.alias("interaction_type"), "weight", "last_accessed", "created_at", "access_count", (F.pmod("user_id", F.lit(7)) != 0).alias("is_validated"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """vec_id, label, prompt_vector and response_vector (the next row's; the last has the first's)."""
    v = read(spark, folder, "embeddings")
    ends = v.agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))  # one row
    own = v.crossJoin(F.broadcast(ends)).select("vec_id", "label", F.col("embedding").alias("prompt_vector"), F.when(F.col("vec_id") == F.col("hi"), F.col("lo")).otherwise(F.col("vec_id") + 1).alias("other"))
    return own.join(v.select(F.col("vec_id").alias("other"), F.col("embedding").alias("response_vector")), "other").drop("other")


#: Decay by interaction type.
DECAY = (
    ("conversation", 0.0002, 0.01, 1.5, 30, 0.85),
    ("code_generation", 0.0001, 0.02, 2.0, 60, 0.90),
    ("problem_solving", 0.00015, 0.015, 1.8, 45, 0.87),
    ("documentation", 0.00005, 0.03, 1.3, 90, 0.80),
    ("debugging", 0.00025, 0.01, 2.5, 20, 0.88),
)
DECAY_DEFAULT = (0.0001, 0.01, 1.5, 30, 0.85)


def decay_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DECAY, "interaction_type string, rate double, least double, factor double, faster_after int, preserve double")


#: Rules of detection (name, type, pattern, severity, action, threshold).
RULES = (
    ("absolute_unix_path", "regex", r"^/(?:home|usr|var|etc|opt)/[a-zA-Z0-9._/-]+", "critical", "quarantine", 0.95),
    ("windows_path", "regex", r"^[A-Z]:\\(?:Users|Windows|Program Files)\\", "critical", "quarantine", 0.95),
    ("private_ip", "regex", r"^(?:10|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.", "high", "flag", 0.9),
    ("localhost_ref", "regex", r"(?:localhost|127\.0\.0\.1)(?::\d+)?", "high", "flag", 0.85),
    ("aws_key", "regex", r"AKIA[0-9A-Z]{16}", "critical", "reject", 1.0),
    ("api_key_pattern", "regex", r"""(?:api[_-]?key|token)\s*[:=]\s*["'][a-zA-Z0-9_-]{32,}["']""", "critical", "quarantine", 0.9),
    ("high_entropy_secret", "entropy", "4.5", "high", "flag", 0.85),
    ("base64_secret", "regex", r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$", "medium", "flag", 0.8),
    ("repeated_pattern", "structural", r"(.{20,})\1{3,}", "medium", "flag", 0.8),
    ("suspicious_length", "structural", r".{10000,}", "high", "quarantine", 0.9),
)


def detection_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, type string, pattern string, severity string, action string, threshold double")


def _values(rows: tuple, columns: str) -> str:
    def put(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(put(x) for x in r) + ')' for r in rows)}) t({columns}))"


SQL = {
    "memories": f"""memories AS (SELECT conv_id * 1000 + turn AS memory_id, conv_id AS session_id, {list(TYPES)}[(conv_id % 5 + 1)::INT] AS interaction_type,
        text AS prompt, response, TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id) + to_minutes(turn) AS created_at
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant')""",
    "interactions": f"""interactions AS (SELECT user_id || ':' || event_type AS interaction_id, user_id AS session_id,
        CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items())} ELSE 'conversation' END AS interaction_type,
        least(1.0, round(avg(value) / 200 + 1e-9, 6))::DOUBLE AS weight, max(ts)::TIMESTAMP AS last_accessed, min(ts)::TIMESTAMP AS created_at, count(*) AS access_count,
        user_id % 7 <> 0 AS is_validated FROM events GROUP BY user_id, event_type)""",
    "vectors": """vectors AS (SELECT a.vec_id, a.label, a.embedding AS prompt_vector, b.embedding AS response_vector FROM embeddings a JOIN embeddings b
        ON b.vec_id = CASE WHEN a.vec_id = (SELECT max(vec_id) FROM embeddings) THEN (SELECT min(vec_id) FROM embeddings) ELSE a.vec_id + 1 END)""",
    "decay": f"decay AS {_values(DECAY, 'interaction_type, rate, least, factor, faster_after, preserve')}",
    "rules": f"rules AS {_values(RULES, 'rule, type, pattern, severity, action, threshold')}",
}


def sql(body: str, *tables: str) -> str:
    """DuckDB SQL with the named tables before it. `body` starts with SELECT, or with further tables and SELECT."""
    head = ", ".join(SQL[t] for t in tables)
    rest = body.strip()
    if not rest.upper().startswith("SELECT"):
        return f"WITH {head}{', ' if head else ''}{rest}"
    return f"WITH {head} {rest}" if head else rest
