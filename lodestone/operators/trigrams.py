"""Joins of texts by the share of trigrams that they have in common, over sets packed into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import dropped, kept

#: Letters and digits, and 0 for what stands between words; so many trigrams there are at most.
LETTERS = np.zeros(256, np.int32)
LETTERS[[*b"abcdefghijklmnopqrstuvwxyz0123456789"]] = np.arange(1, 37)
KINDS = 37**3
#: Sets of a block, and items of all its sets, at most.
SETS, ITEMS = 2048, 1 << 21
#: An item that more than this share of a block pair's pairs has in common is counted by a matrix product; so many are, at most.
SHARE, DENSE = 0.001, 4096
#: Sets of a block that are compared with another block at a time; partitions that blocks of either side are dealt into, at most.
STRIPE, DEALT = 512, (64, 8)


def codes(text: str) -> np.ndarray:
    """What functions.text.trigrams() finds in a lower-case text, as sorted numbers."""
    c = LETTERS[np.frombuffer(text.encode(), np.uint8)]
    c = c[(c != 0) | np.concatenate([[False], c[:-1] != 0])] if len(c) else c  # one blank between words
    c = np.concatenate([[0], c, [0]])
    c = np.insert(c, np.flatnonzero(c == 0), 0)  # and then two
    a, b, d = c[:-2], c[1:-1], c[2:]
    return np.unique(((a * 37 + b) * 37 + d)[(b != 0) | (d != 0)])


def _sets(texts: DataFrame) -> DataFrame:
    """(id, n, x): each text's trigrams as bytes; texts without any are left out."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [codes(t) for t in batch.column(1).to_pylist()]
            some = [k for k, x in enumerate(found) if len(x)]
            at = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([len(found[k]) for k in some], pa.int32()), pa.array([found[k].astype(np.uint16).tobytes() for k in some], pa.binary())], ["id", "n", "x"])

    told = texts.where("text is not null").select(F.col("id").cast("long").alias("id"), F.lower("text").alias("text"))
    return kept(told.mapInArrow(coded, "id long, n int, x binary"))


def _packed(sets: DataFrame) -> DataFrame:
    """Sets in blocks of like numbers of items, the smaller first: (lo, hi, ids, ns, xs)."""

    def block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        ids, n, x = zip(*rows)
        parts = [np.array(ids, np.int64).tobytes(), np.array(n, np.int32).tobytes(), b"".join(x)]
        return pa.RecordBatch.from_arrays([pa.array([n[0]], pa.int32()), pa.array([n[-1]], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], ["lo", "hi", "ids", "ns", "xs"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, items = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (len(rows) == SETS or items + row[1] > ITEMS):
                    yield block(rows)
                    rows, items = [], 0
                rows.append(row)
                items += row[1]
        if rows:
            yield block(rows)

    return kept(sets.repartitionByRange("n", "id").sortWithinPartitions("n").mapInArrow(pack, "lo int, hi int, ids binary, ns binary, xs binary"))


class _Side:
    """The sets of a block that may be alike one of `lo` to `hi` items: ids, sizes, and all items beside their set's place."""

    def __init__(self, row: dict, s: str, lo: int, hi: int, least: float):
        n = np.frombuffer(row["ns" + s], np.int32).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        a, b = np.searchsorted(n, lo * least - 1e-6), np.searchsorted(n * least, hi + 1e-6, "right")
        self.ids, self.n = np.frombuffer(row["ids" + s], np.int64)[a:b], n[a:b]
        self.x = np.frombuffer(row["xs" + s], np.uint16)[ends[a] : ends[b]]
        self.own = np.repeat(np.arange(len(self.n)), self.n)
        self.times = np.bincount(self.x, minlength=KINDS)

    def split(self, place: np.ndarray, width: int, met: np.ndarray) -> None:
        """Items with a place, as a matrix; and the others that the other side has, with where each set's begin."""
        at = place[self.x]
        self.dense = np.zeros((len(self.n), width), np.float32)
        self.dense[self.own[at >= 0], at[at >= 0]] = 1
        rare = (at < 0) & met[self.x]
        self.rare = self.x[rare]
        self.rest = np.bincount(self.own[rare], minlength=len(self.n))
        self.begin = np.cumsum(self.rest) - self.rest


def _alike(left: _Side, right: _Side, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left places, right places, scores) of all pairs of more than `least`, a stripe of left sets at a time."""
    met = left.times * right.times
    often = np.flatnonzero(met > SHARE * len(left.n) * len(right.n))
    often = often[np.argsort(-met[often], kind="stable")[:DENSE]]
    place = np.full(KINDS, -1)
    place[often] = np.arange(len(often))
    for side in (left, right):
        side.split(place, len(often), met > 0)
    held = np.zeros(KINDS, bool)
    need, need_2 = ((side.n * (least / (1 + least)) - 0.05).astype(np.float32) for side in (left, right))
    for k in range(0, len(left.n), STRIPE):
        n, rest = left.n[k : k + STRIPE], left.rest[k : k + STRIPE]
        common = left.dense[k : k + STRIPE] @ right.dense.T
        # alike by more than `least`: more than least / (1 + least) of both sizes in common, the others at most all there are
        able = common + np.minimum.outer(rest.astype(np.float32), right.rest.astype(np.float32)) > np.add.outer(need[k : k + STRIPE], need_2)
        i, j = np.nonzero(able)
        both = common[i, j].astype(np.int64)
        ends = np.searchsorted(i, np.arange(len(n) + 1))
        for q in np.flatnonzero((np.diff(ends) > 0) & (rest > 0)):  # the others, of pairs that they may decide
            own = left.rare[left.begin[k + q] : left.begin[k + q] + rest[q]]
            held[own] = True
            to = j[ends[q] : ends[q + 1]]
            size = right.rest[to]
            sums = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(sums[-1]) + np.repeat(right.begin[to] - sums[:-1], size)
            found = np.concatenate([[0], np.cumsum(held[right.rare[at]])])
            both[ends[q] : ends[q + 1]] += found[sums[1:]] - found[sums[:-1]]
            held[own] = False
        score = both / (n[i] + right.n[j] - both)
        hit = score > least
        yield i[hit] + k, j[hit], score[hit]


def similar_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, score): ids of a left and a right text (id, text) whose trigrams have an intersection over union of more than
    `least`, every such pair and no other.

    Blocks of sets meet where their sizes may be alike, and are read by the tasks that compare them. Items that many sets of
    both blocks have are counted for all pairs by a matrix product; the others, of which a set has few, only for pairs that
    they may raise above `least`. Time grows with left times right texts of like size, memory doesn't."""
    if any(t.schema["id"].dataType.typeName() not in ("long", "integer") for t in (left, right)):  # ids of other types are numbered
        one, two = (kept(t.withColumn("k", F.monotonically_increasing_id())) for t in (left, right))
        found = similar_texts(one.select(F.col("k").alias("id"), "text"), two.select(F.col("k").alias("id"), "text"), least)
        found = found.join(one.select(F.col("k").alias("a"), F.col("id").alias("x")), "a").join(two.select(F.col("k").alias("b"), F.col("id").alias("y")), "b")
        return found.select(F.col("x").alias("a"), F.col("y").alias("b"), "score")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, y = _Side(row, "", row["lo_2"], row["hi_2"], least), _Side(row, "_2", row["lo"], row["hi"], least)
                for i, j, score in _alike(x, y, least):
                    if len(i):
                        yield pa.RecordBatch.from_arrays([pa.array(x.ids[i]), pa.array(y.ids[j]), pa.array(score)], ["a", "b", "score"])

    sides = []
    for texts, most in zip((left, right), DEALT):
        sets = _sets(texts)
        blocks = _packed(sets)
        dropped(sets)
        sides.append(blocks.repartition(max(1, min(most, blocks.count()))))
    x, y = sides[0], sides[1].toDF("lo_2", "hi_2", "ids_2", "ns_2", "xs_2")
    near = (F.col("hi") >= F.col("lo_2") * least - 1e-6) & (F.col("hi_2") >= F.col("lo") * least - 1e-6)
    return x.hint("shuffle_replicate_nl").join(y, near).mapInArrow(compare, "a long, b long, score double")
