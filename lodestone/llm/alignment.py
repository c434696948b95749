"""Alignment of two tokenizers over the same bytes.

1. A task codes texts with both tokenizers in slices of about `SLICE` bytes. Tokens are byte ranges. Every token points to
   its farthest-right overlapping token; successors are doubled, all of a slice at once, until they stand still: each
   then names the terminal token of its component, which labels the group. Overlapping pairs are the stretches between
   neighbouring token ends of either side. A slice leaves one row: per document its sizes, the digest of its groups, and
   counts over the slice's own list of distinct id pairs; and that list with the slice's total counts.
2. Counts of id pairs are summed over all slices, and each B id's highest is taken: as many rows as the vocabulary has ids.
3. Corpus counts go back to the slices by a join on the pair, a pair once for a slice and not once for an occurrence, and
   a slice's documents add them up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, text_buffer

A_RANKS, B_MODEL = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SLICE = 2_000_000

_SLICES = "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, doc_pairs array<int>, pair array<int>, n array<int>, a array<int>, b array<int>, total array<long>"
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_ranks: str, b_model: str):
        import sentencepiece
        import tiktoken

        with open(a_ranks, "rb") as file:
            ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, file)}
        self.a = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.shown = [f"{i}{end}".encode() for end in ",|;" for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.width = len(self.shown) // 3

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Both codings of a space and the text; none if the joined bytes of either differ from that."""
        if not text:
            return [], []
        whole = " " + text
        data, a, b = whole.encode(), self.a.encode_ordinary(whole), self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != data or b"".join([self.b_bytes[i] for i in b]) != data:
            return [], []
        return a, b


@lru_cache(maxsize=2)
def pair(a_ranks: str, b_model: str) -> Pair:
    """One pair a worker process."""
    return Pair(a_ranks, b_model)


def components(a_end: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """For tokens by their ends (A's, then B's, both over the same bytes): the terminal token of each one's component.

    The farthest-right token that overlaps one is that of the other side which holds its last byte, unless it ends
    sooner or there; of two that end alike, B's is the terminal one. Doubling halves the way that is left each time."""
    n = len(a_end)
    over_a = np.searchsorted(b_end, a_end, "left")
    over_b = np.searchsorted(a_end, b_end, "left")
    successor = np.concatenate([n + over_a, np.where(a_end[over_b] > b_end, over_b, n + np.arange(len(b_end)))]) if n else np.zeros(0, np.int64)
    while True:
        further = successor[successor]
        if (further == successor).all():
            return successor
        successor = further


def aligned(texts: list[str], code: Pair) -> dict[str, np.ndarray | list]:
    """A slice: per text its sizes and groups, and the id pairs that its tokens link."""
    coded = [code.ids(t) for t in texts]
    n_a, n_b = (np.array([len(c[k]) for c in coded], np.int64) for k in (0, 1))
    a, b = (np.fromiter((i for c in coded for i in c[k]), np.int64, int(n.sum())) for k, n in ((0, n_a), (1, n_b)))
    del coded
    a_end, b_end = np.cumsum(code.a_size[a]), np.cumsum(code.b_size[b])
    terminal = components(a_end, b_end)
    a_doc, b_doc = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
    last = terminal[len(a) :] == len(a) + np.arange(len(b))  # the terminal tokens are B's
    # groups in order: A's tokens and then B's of each; a token is shown with the sign that follows it
    group = np.concatenate([np.searchsorted(np.flatnonzero(last), t - len(a)) for t in (terminal[: len(a)], terminal[len(a) :])]) if len(a) else terminal
    order = np.argsort(2 * group + (np.arange(len(group)) >= len(a)), kind="stable")
    sign = np.zeros(len(group), np.int64)
    if len(a):
        own = group[: len(a)]
        sign[: len(a)][np.append(own[1:] != own[:-1], True)] = 1
        sign[len(a) :][last] = 2
    shown = [code.shown[k] for k in (np.concatenate([a, b]) + sign * code.width)[order].tolist()]
    bounds = np.concatenate([[0], np.cumsum(n_a + n_b)])
    groups = [hashlib.sha256(b"".join(shown[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip(bounds, bounds[1:])]
    del shown
    ends = np.union1d(a_end, b_end)
    i, j = np.searchsorted(a_end, ends, "left"), np.searchsorted(b_end, ends, "left")
    pairs, at, total = np.unique(a[i] * (1 << 32) + b[j], return_inverse=True, return_counts=True)
    doc = a_doc[i]
    keys, n = np.unique(doc * np.int64(max(1, len(pairs))) + at, return_counts=True)
    doc_of, pair_of = keys // max(1, len(pairs)), keys % max(1, len(pairs))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(b_doc[last], minlength=len(texts)), "n_links": np.bincount(doc, minlength=len(texts)), "groups": groups,
        "doc_pairs": np.bincount(doc_of, minlength=len(texts)), "pair": pair_of, "n": n, "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "total": total,
    }


def _listed(values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def sliced(docs: DataFrame, a_ranks: str, b_model: str, slice_bytes: int = SLICE) -> DataFrame:
    """One row per slice of documents, by the schema of `_SLICES`."""
    types = [pa.int64()] * 5 + [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "doc_pairs", "pair", "n", "a", "b", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, number = pair(a_ranks, b_model), TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for x, y in slices(offsets, slice_bytes):
                own = batch.slice(x, y - x)
                found = aligned(own.column(1).to_pylist(), code)
                found["doc_id"] = own.column(0)
                lists = [_listed(found[c], t) for c, t in zip(names, types)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], ["slice", *names])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SLICES)


def alignment(docs: DataFrame, a_ranks: str | None = None, b_model: str | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is the B id's most frequent
    one in the corpus, ties included), count_sum (corpus counts over the links), groups_sha256.

    A null or empty text, or one whose coding doesn't give its bytes back, has no tokens: zeros and ''. Rows that repeat
    a doc_id, and null doc_ids, are counted and returned row by row. Only doc_id and text are read. An empty table gives
    no rows. A text is coded whole, however long, by the task that reads it."""
    parts = stored(sliced(docs, a_ranks or public_tokenizers.path(A_RANKS), b_model or public_tokenizers.path(B_MODEL), slice_bytes))
    each = parts.select("slice", F.posexplode(F.arrays_zip("a", "b", "total")).alias("pos", "p")).select("slice", "pos", "p.a", "p.b", "p.total")
    counts = stored(each.groupBy("a", "b").agg(F.sum("total").alias("count")))
    best = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of the vocabulary
    known = counts.join(F.broadcast(best), "b").select(F.col("a").alias("ka"), F.col("b").alias("kb"), "count", (F.col("count") == F.col("most")).alias("best"))
    back = each.join(known, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb"))).groupBy("slice").agg(F.array_sort(F.collect_list(F.struct("pos", "count", "best"))).alias("known"))
    joined = parts.drop("a", "b", "total").join(back.select(F.col("slice").alias("s"), F.col("known.count").alias("count"), F.col("known.best").alias("best")), F.col("slice") == F.col("s"), "left")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc_id, n_a, n_b, n_groups, n_links, groups, doc_pairs, at, n, count, best = (batch.column(c)[k].values for c in range(11))
                end = np.cumsum(doc_pairs.to_numpy())
                n_best, count_sum = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
                if len(at):
                    at, n, of = at.to_numpy(), n.to_numpy().astype(np.int64), np.repeat(np.arange(len(end)), doc_pairs.to_numpy())
                    np.add.at(count_sum, of, n * count.to_numpy()[at])
                    np.add.at(n_best, of, n * best.to_numpy(zero_copy_only=False)[at])
                yield pa.RecordBatch.from_arrays([doc_id, n_a, n_b, n_groups, n_links, pa.array(n_best), pa.array(count_sum), groups], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "doc_pairs", "pair", "n", "count", "best").mapInArrow(add, _RESULT)
