"""Tables that grow and views that are kept: append, refresh, apply changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import memory as O


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def append_interactions(rows: DataFrame, path: str, vectors: list[str]) -> None:
    """Appends interactions; vectors that are missing come from the session's latest row that has them."""
    spark = rows.sparkSession
    old = spark.read.parquet(path)
    have = old.where(" and ".join(f"{v} is not null" for v in vectors))
    last = O.latest(have, ["session_id"], "created_at", vectors)
    told = rows.join(last.select("session_id", *[F.col(v).alias(f"__{v}") for v in vectors]), "session_id", "left")
    filled = told.withColumns({v: F.coalesce(v, f"__{v}") for v in vectors}).select(*old.columns)
    append(filled, path)


def refresh(spark: SparkSession, views: dict[str, Callable[[], DataFrame]], path: str) -> None:
    """Rebuilds materialised views, each a table of a folder."""
    for name, make in views.items():
        make().write.mode("overwrite").parquet(f"{path}/{name}")


def visible(rows: DataFrame, role: str, least: float = 0.8) -> DataFrame:
    """What a role may read: an admin all, an auditor failures only, others what scores enough."""
    if role == "admin":
        return rows
    return rows.where(~F.col("passed")) if role == "auditor" else rows.where(F.col("score") >= least)


def changed(old: DataFrame, updates: DataFrame, deletes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with updates (key and columns; null leaves a value) applied and deletes (key) gone."""
    kept = old.join(deletes.select(key), key, "left_anti")
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return kept.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*old.columns)
