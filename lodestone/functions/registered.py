"""Functions for SQL: scalars that the optimiser inlines, and a table function over JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import PLACEHOLDER

#: name, arguments, type, expression. Each is one SQL expression, so plans show it and not a call.
SCALARS = (
    ("placeholder_count", "t STRING", "INT", f"regexp_count(t, '{PLACEHOLDER}')"),
    ("placeholder_density", "t STRING", "DOUBLE", f"if(length(t) > 0, regexp_count(t, '{PLACEHOLDER}') * 100.0D / length(t), 1.0D)"),
    ("cosine", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
    ("memory_decay", "w DOUBLE, days INT, accesses BIGINT, rate DOUBLE, least DOUBLE, after INT", "DOUBLE", "least(greatest(w * exp(-rate * days * if(days > after, 1.5D, 1.0D)) * if(accesses > 1, 1 + ln(accesses) * 0.05D, 1.0D), least), 1.0D)"),
    ("token_estimate", "t STRING", "BIGINT", "cast(ceil(length(t) / 4) as bigint)"),
)


def register(spark: SparkSession) -> None:
    """Makes the scalars and the table function known to a session."""
    for name, arguments, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("json_leaves", JsonLeaves)


#: name, arguments, columns and query of table functions over three tables: vectors, rows and the rows as they are now.
TABLES = (
    ("related_memories", "id BIGINT, least DOUBLE", "vec_id BIGINT, score DOUBLE", "SELECT v.vec_id, cosine(cast(v.prompt_vector as array<double>), cast(q.prompt_vector as array<double>)) FROM {0} v JOIN {0} q ON q.vec_id = related_memories.id AND v.vec_id <> q.vec_id WHERE cosine(cast(v.prompt_vector as array<double>), cast(q.prompt_vector as array<double>)) >= related_memories.least"),
    ("stale_references", "days INT", "interaction_id STRING, age BIGINT", "SELECT interaction_id, floor((unix_timestamp(as_of) - unix_timestamp(last_accessed)) / 86400) FROM {1} WHERE floor((unix_timestamp(as_of) - unix_timestamp(last_accessed)) / 86400) > stale_references.days"),
    ("reference_drift", "", "interaction_id STRING, old DOUBLE, new DOUBLE", "SELECT coalesce(o.interaction_id, n.interaction_id), o.weight, n.weight FROM {1} o FULL JOIN {2} n ON o.interaction_id = n.interaction_id WHERE NOT o.weight <=> n.weight"),
    ("unsafe_in_time", "days INT", "interaction_id STRING", "SELECT interaction_id FROM {1} WHERE NOT is_validated OR floor((unix_timestamp(as_of) - unix_timestamp(last_accessed)) / 86400) > unsafe_in_time.days"),
)


def register_tables(spark: SparkSession, vectors: str, rows: str, new: str) -> None:
    """Makes the table functions over three views known to a session: they are queries, which the optimiser sees through."""
    for name, arguments, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) RETURN {body.format(vectors, rows, new)}")


@udtf(returnType="path string, value string, depth int, violation string")
class JsonLeaves:
    """Every value of a JSON text with its path; a path deeper than ten levels and a text that is no JSON are violations,
    as are values that look like paths or addresses."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            yield from self.walk("$", json.loads(text or "null"), 0)
        except ValueError:
            yield "$", None, 0, "invalid_json"

    def walk(self, path: str, value, depth: int) -> Iterator[tuple]:
        if depth > 10:
            yield path, None, depth, "too_deep"
        elif isinstance(value, dict):
            for k, v in value.items():
                yield from self.walk(f"{path}.{k}", v, depth + 1)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from self.walk(f"{path}[{i}]", v, depth + 1)
        else:
            plain = None if value is None else str(value)
            bad = "file_path" if plain and plain.startswith(("/home/", "/Users/")) else "email" if plain and "@" in plain and "." in plain else None
            yield path, plain, depth, bad
