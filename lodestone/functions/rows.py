"""Columns that are worked out once for a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with further columns, each worked out once for a row, however often later columns and conditions name it: as
    a plain projection, dear expressions would be copied into them. Streams, too."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
