"""Best-fit packing of tokenised documents into sequences of a fixed length, planned on the histogram of lengths.

1. One pass codes whole texts and cuts what is longer than a sequence. A piece gets its block (the writing task) and
   its rank among the block's pieces of the same length; both are stored with it, so a retried task can't move them.
2. Counts by (block, length) give each block's first rank within a length, and the histogram.
3. The plan is best-fit decreasing over counts: one step places as many pieces of a length as there are bins in the
   fullest class that takes them. It sees at most `capacity` counts, whatever the corpus.
4. Pieces take planned slots by joining on length and on the rank within it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import lean, stored

CAPACITY, END_ID = 1024, 2


def tokenized_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Columns doc_id, piece, start, length, ids_crc32, block, place (rank in the block within the length), and ids if asked for. Null text counts as empty: its only id is the end mark. Only doc_id and text are read."""
    path = ranks_path or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, code, placed = TaskContext.get().partitionId(), tokens.encoder(path), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.packed(text.as_py() or "") + end
                n = len(ids) // 4
                stop = n % capacity or capacity  # the first piece takes what is over
                start = piece = 0
                while start < n:
                    own = ids[4 * start : 4 * stop]
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), block, int(placed[length]), own if keep_ids else None))
                    placed[length] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            cols = list(zip(*rows)) if rows else [()] * 8
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "block", "place"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, place long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(cut), schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, rank_from, rank_to, sequence_from, offset): the pieces of that length with rank_from <= rank <
    rank_to go, one each, to the sequences from sequence_from on, at that offset.

    A class is a range of sequences filled alike. Each step either uses up a length or a class, so the number of runs
    depends on the capacity, not on the counts."""
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # room left: classes (first sequence, sequences)
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            free.setdefault(room, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = min((r for r in free if r >= length), default=None)
            if room is None:  # new sequences, each with as many of this length as it takes
                each = capacity // length
                full, over = divmod(left, each)
                for n, bins in ((each, full), (over, 1)):
                    if n and bins:
                        for i in range(n):
                            runs.append((length, rank + i * bins, rank + (i + 1) * bins, sequences, i * length))
                        put(capacity - n * length, sequences, bins)
                        sequences, rank = sequences + bins, rank + n * bins
                left = 0
                continue
            first, n = free[room].pop()
            if not free[room]:
                del free[room]
            used = min(n, left)
            runs.append((length, rank, rank + used, first, capacity - room))
            put(room - length, first, used)
            put(room, first + used, n - used)
            rank, left = rank + used, left - used
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (with length, block and place). An empty table stays empty."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    names = ["length", "rank_from", "rank_to", "sequence_from", "offset"]
    columns = list(zip(*plan(histogram, capacity))) or [()] * len(names)
    slots = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names))  # from Arrow no Python worker is needed
    ranked = pieces.join(ahead, ["block", "length"]).withColumn("rank", F.col("ahead") + F.col("place"))
    taken = ranked.join(F.broadcast(slots), "length").where("rank >= rank_from and rank < rank_to")
    return taken.withColumn("sequence_id", F.col("sequence_from") + F.col("rank") - F.col("rank_from")).drop("rank", "ahead", "place", "block", "rank_from", "rank_to", "sequence_from")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` ids: one row per piece, with its sequence and offset.

    Null text or an empty one is a document of one id, the end mark. Repeated rows and null doc_ids are packed like
    others, row by row; other columns are not read. An empty table gives no rows. A text of any length is cut, never
    shortened."""
    return pack(stored(tokenized_pieces(docs, capacity, end_id, ranks_path, keep_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from packed pieces with ids. A group is bounded by the capacity."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
