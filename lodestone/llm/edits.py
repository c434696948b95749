"""Token counts that follow edits.

A document's pre-tokens stand in leaves of LEAF pieces; a leaf may end before one white-space character between two
others, or between a letter and a sign, but not in the added token, so that no token crosses it. Over the leaves lies a segment tree of sums of
characters and tokens. An edit finds its leaves by descending on characters, takes in a neighbour where it touches the
place that parts them (the boundary context), re-encodes only these, and corrects the sums above them. A run of letters
is one pre-token and so one leaf, however long.

The trees are a table beside the documents; a leaf is some hundreds of characters, so it is small against the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import stored

LEAF = 64
_CUT = regex.compile(rf"(?<=\S)[ \t\n\r\f\v](?=\S)|(?<=\p{{L}})(?=[^\s\p{{L}}\p{{N}}])(?!(?<={regex.escape(tokens.ADDED[:-2])}){regex.escape(tokens.ADDED[-2:])})")


def cuts(text: str) -> list[int]:
    """The places where a leaf may end."""
    return [m.start() for m in _CUT.finditer(text)]


class Tree:
    """Sums over leaves in a heap: node 1 is the root, leaf i is node size + i. chars and counts are kept together."""

    def __init__(self, chars: np.ndarray, counts: np.ndarray):
        self.leaves = len(chars)
        self.size = 1 << max(0, int(self.leaves - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + self.leaves] = np.column_stack([chars, counts])
        for lo in (1 << k for k in range(self.size.bit_length() - 2, -1, -1)):
            self.sums[lo : 2 * lo] = self.sums[2 * lo : 4 * lo : 2] + self.sums[2 * lo + 1 : 4 * lo : 2]

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it starts. Past the end, the last leaf that holds any."""
        char, node, start = min(char, int(self.sums[1, 0]) - 1), 1, 0
        while node < self.size:
            node *= 2
            if char - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.size, start

    def set(self, leaf: int, chars: int, count: int) -> None:
        node = self.size + leaf
        change = np.array([chars, count]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def built(text: str, code: tokens.Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each leaf of a text."""
    at = [0, *cuts(text)[LEAF - 1 :: LEAF], len(text)]
    return np.diff(at), np.array([code.count(text[a:b]) for a, b in zip(at, at[1:])], np.int64)


def edit(text: str, tree: Tree, start: int, stop: int, put: str, code: tokens.Encoder) -> tuple[str, int]:
    """Replaces text[start:stop] by `put`; returns the new text and how many characters were coded again."""
    start = max(0, min(start, len(text)))
    stop = max(start, min(stop, len(text)))
    new = text[:start] + put + text[stop:]
    first, a = tree.find(max(0, start - 2)) if text else (0, 0)  # two characters on either side are context
    last, b = tree.find(stop + 1) if text else (tree.leaves - 1, 0)
    last = max(first, last)
    b += int(tree.sums[tree.size + last, 0])
    while True:
        own = new[a : b + len(new) - len(text)]
        end = a + len(own)
        open_left = a and not _CUT.match(new, a)
        open_right = end < len(new) and not _CUT.match(new, end)
        if not open_left and not open_right:
            break
        if open_left:
            first -= 1
            a -= int(tree.sums[tree.size + first, 0])
        if open_right:
            last += 1
            b += int(tree.sums[tree.size + last, 0])
    able = cuts(own)
    every = len(able) // (last - first + 1) + 1
    marks = able[every - 1 :: every][: last - first]
    at = [0, *marks, *[len(own)] * (last - first - len(marks)), len(own)]
    for i, (x, y) in enumerate(zip(at, at[1:])):
        tree.set(first + i, y - x, code.count(own[x:y]))
    return new, len(own)


def trees(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """doc_id, h (hash of the text), chars and counts (per leaf). Rows with the same doc_id and text have one tree.
    docs: doc_id, h, text."""
    path = ranks_path or tokens.default_path()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path)
        for batch in batches:
            both = [built(t or "", code) for t in batch.column(2).to_pylist()]
            lists = [pa.array([b[k].astype(np.int32) for b in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "h", "chars", "counts"])

    return docs.select("doc_id", "h", "text").mapInArrow(build, "doc_id long, h long, chars array<int>, counts array<int>").dropDuplicates(["doc_id", "h"])


def edited_counts(docs: DataFrame, edits: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_coded (again) and text (edited).

    edits: doc_id, seq, start, stop, put; `seq` orders a document's edits, places are code points of the text that the
    ones before have left and are clipped to it; null `put` deletes. Edits of an unknown or null doc_id change nothing.
    Null text counts as empty. Rows that repeat a doc_id are edited alike, row by row. Only doc_id and text are read of
    docs. An empty table gives no rows."""
    path = ranks_path or tokens.default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    known = stored(trees(docs, path))
    listed = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "put"))).alias("edits"))
    about = known.join(listed, "doc_id", "left").select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), "chars", "counts", "edits")
    joined = docs.join(about, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = tokens.encoder(path)
        for batch in batches:
            rows = []
            for text, chars, counts, changes in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                tree, coded = Tree(np.array(chars, np.int64), np.array(counts, np.int64)), 0
                before = int(tree.sums[1, 1])
                for e in changes or ():
                    text, n = edit(text, tree, e["start"], e["stop"], e["put"] or "", code)
                    coded += n
                rows.append((before, len(changes or ()), int(tree.sums[1, 1]), coded, text))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string())], ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_coded", "text"])

    return joined.select("doc_id", "text", "chars", "counts", "edits").mapInArrow(apply, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_chars_coded long, text string")


def seeded_edits(docs: DataFrame, per_chars: int = 4000, seed: int = 4) -> DataFrame:
    """Edits for each document, one and one more for every `per_chars` characters: in turn a replacement, an insertion
    and a deletion at hashed places, with pieces of the document's own text."""
    text, n = F.coalesce(F.col("text").cast("string"), F.lit("")), F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    each = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor(n / per_chars).cast("int"))).alias("seq"))

    def part(k: int, most: Column) -> Column:
        return F.pmod(F.xxhash64("doc_id", "seq", F.lit(seed + k)), most).cast("int")

    start, turn = part(0, F.col("n") + 1), F.col("seq") % 3
    stop = F.when(turn == 1, start).otherwise(start + part(1, F.lit(40)))
    put = F.when(turn != 2, F.substring("t", part(2, F.col("n") + 1) + 1, F.lit(1) + part(3, F.lit(24))))
    return each.select("doc_id", "seq", start.alias("start"), stop.alias("stop"), put.alias("put"))
