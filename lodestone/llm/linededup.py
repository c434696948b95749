"""Repeated runs of lines: a suffix array over line ids by prefix doubling, whose common-prefix intervals show what to
delete.

Every line of the corpus has a place in one sequence, document by document in the order of doc_id, and an id, a 128-bit
hash of its stripped text. Round k knows the suffixes' order by their first 2 ** k lines: suffixes alike so far share a rank,
which is an interval of the suffix array with a common prefix of 2 ** k lines. Round k + 1 ranks the pairs of a suffix's
rank and that of the suffix 2 ** k lines on, by a distributed sort of the distinct pairs. Suffixes alone in their
interval leave; so do those whose document ends first. Rounds end when none is left.

A run of MIN_WORDS words or more is deleted where it is a later copy of one earlier place; lines repeated on their own,
with fewer words, stay. Such runs are the unions of two kinds of windows: the shortest one of so many words that starts
at a line, and the shortest that ends at it. What a window holds tells how long it is, so its copies are windows too. A
window of n lines is named by the ranks of its first and last 2 ** k lines, where 2 ** k <= n < 2 ** (k + 1); of windows
with one name, all but the first in the corpus go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, lean, stored

MIN_WORDS = 25


def numbered_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines, texts). lines: pos, end (of the document), id and id_2 (the hash), ahead and behind (lines in the shortest window of
    min_words words that starts or ends there, 0 if none does). texts: doc_id, h, start, end. Rows with the same doc_id
    and text are one document."""

    names, kinds = ["ids", "more", "ahead", "behind"], "ids array<long>, more array<long>, ahead array<int>, behind array<int>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, more, ahead, behind = [], [], [], []
            for t in batch.column(2).to_pylist():
                own = [x.strip() for x in (t or "").split("\n")]
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode()) for x in own]), np.int64).reshape(-1, 2)
                ids.append(both[:, 0])
                more.append(both[:, 1])
                total = np.concatenate([[0], np.cumsum([len(x.split()) for x in own])])
                at = np.arange(len(own))
                stop = np.searchsorted(total, total[:-1] + min_words, "left")  # the first place where enough words lie behind
                start = np.searchsorted(total, total[1:] - min_words, "right") - 1
                ahead.append(np.where(stop <= len(own), np.maximum(stop - at, 1), 0).astype(np.int32))
                behind.append(np.where(start >= 0, np.maximum(at + 1 - start, 1), 0).astype(np.int32))
            lists = [pa.array(x, pa.list_(t)) for x, t in ((ids, pa.int64()), (more, pa.int64()), (ahead, pa.int32()), (behind, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc_id", "h", *names])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = np.diff(batch.column(2).offsets.to_numpy())
            stop = at + np.cumsum(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(size), block, np.int32)), pa.array(stop - size), pa.array(size.astype(np.int64))], ["doc_id", "h", *names, "block", "at", "n"])
            at = int(stop[-1]) if len(stop) else at

    read = docs.select("doc_id", "h", "text").mapInArrow(lean(split), f"doc_id long, h long, {kinds}")
    once = read.groupBy("doc_id", "h").agg(*[F.first(c).alias(c) for c in names])
    ordered = once.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h")
    placed = stored(ordered.mapInArrow(lean(place), f"doc_id long, h long, {kinds}, block int, at long, n long"))
    blocks = placed.groupBy("block").agg(F.sum("n").alias("n"))  # one row a task
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = placed.join(F.broadcast(base), "block").withColumn("start", F.col("base") + F.col("at")).withColumn("end", F.col("start") + F.col("n"))
    lines = placed.select("start", "end", F.posexplode(F.arrays_zip(*names)).alias("i", "x"))
    lines = lines.select((F.col("start") + F.col("i")).alias("pos"), "end", F.col("x.ids").alias("id"), F.col("x.more").alias("id_2"), "x.ahead", "x.behind")
    return lines, placed.select("doc_id", "h", "start", "end")


def rounds(lines: DataFrame) -> list[DataFrame]:
    """The suffixes that share an interval, a table per round k: pos, end, rank; ahead and behind in the first one. Rounds
    go as far as the longest window needs."""
    alike = lines.groupBy("id", "id_2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    alike = stored(alike.withColumn("rank", F.monotonically_increasing_id()))  # a table: so a common line's rows can be split in the join
    tables = [stored(lines.join(alike, ["id", "id_2"]).select("pos", "end", "rank", "ahead", "behind"))]
    discard(alike)
    longest = tables[0].agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 0
    reach = 1
    while 2 * reach <= longest:
        last = tables[-1].select("pos", "end", "rank")
        ahead = last.select((F.col("pos") - reach).alias("pos"), F.col("rank").alias("rank_2"))
        pairs = last.where(F.col("pos") + 2 * reach <= F.col("end")).join(ahead, "pos")
        alike = pairs.groupBy("rank", "rank_2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        ranked = stored(alike.repartitionByRange("rank", "rank_2").sortWithinPartitions("rank", "rank_2").withColumn("new", F.monotonically_increasing_id()))
        if ranked.isEmpty():
            discard(ranked)
            break
        tables.append(stored(pairs.join(ranked, ["rank", "rank_2"]).select("pos", "end", F.col("new").alias("rank"))))
        discard(ranked)
        reach *= 2
    return tables


def later_copies(levels: list[DataFrame]) -> DataFrame:
    """(start, stop, end): windows of enough words that stand earlier in the corpus as well."""
    first = levels[0]
    starts = first.where("ahead > 0").select("end", F.col("pos").alias("start"), F.col("ahead").alias("n"))
    stops = first.where("behind > 0").select("end", (F.col("pos") + 1 - F.col("behind")).alias("start"), F.col("behind").alias("n"))
    windows = starts.unionByName(stops).distinct().withColumn("k", F.floor(F.log2("n")).cast("int"))
    named = None
    for k, table in enumerate(levels):
        head = table.select(F.col("pos").alias("start"), F.col("rank").alias("head"))
        own = windows.where(F.col("k") == k).join(head, "start").withColumn("tail_at", F.col("start") + F.col("n") - 2**k)
        own = own.join(table.select(F.col("pos").alias("tail_at"), F.col("rank").alias("tail")), "tail_at").select("k", "n", "head", "tail", "start", "end")
        named = own if named is None else named.unionByName(own)
    named = stored(named)
    again = named.groupBy("k", "n", "head", "tail").agg(F.min("start").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    return named.join(stored(again), ["k", "n", "head", "tail"]).where("start > first").select("start", (F.col("start") + F.col("n")).alias("stop"), "end")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h and `gone` (numbers of the lines to delete, from 0) of the documents that lose any. docs: doc_id, h
    (hash of the text), text."""
    lines, texts = numbered_lines(docs, min_words)
    copies = later_copies(rounds(stored(lines))).groupBy("end", "start").agg(F.max("stop").alias("stop"))
    sofar = Window.partitionBy("end").orderBy("start")  # a document's windows
    apart = F.col("start") > F.coalesce(F.max("stop").over(sofar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    merged = copies.withColumn("apart", apart.cast("int")).withColumn("stretch", F.sum("apart").over(sofar))
    merged = merged.groupBy("end", "stretch").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    gone = merged.groupBy("end").agg(F.sort_array(F.flatten(F.collect_list(F.sequence("start", F.col("stop") - 1)))).alias("gone"))  # bounded by a document's lines
    return gone.join(texts, "end").select("doc_id", "h", F.transform("gone", lambda p: (p - F.col("start")).cast("int")).alias("gone"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with `text` less the later copies of repeated runs of lines, and n_lines, n_removed and `removed` (the
    numbers of the deleted lines, from 0) added. The other columns stay as they are, save those of these names.

    A line is a piece between line feeds; lines are alike if they are, stripped. The first copy in the order of doc_id
    stays, also within one text. Null and empty texts lose nothing and keep their value; null doc_ids come first. Rows
    that repeat a doc_id and its text are one document and have one result. A document may lose all its lines: its text
    is then empty. An empty table gives no rows."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(*names).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    gone = stored(repeated_lines(keyed.where("text is not null").select("doc_id", "h", "text"), min_words)).select(F.col("doc_id").alias("id_2"), F.col("h").alias("h_2"), "gone").hint("merge")  # one plan at every size: texts are shuffled once
    out = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("id_2")) & (F.col("h") == F.col("h_2")), "left")
    lines = F.split("text", "\n", -1)
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    removed = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    own = [new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names]
    return out.select(*own, F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.size(removed).alias("n_removed"), removed.alias("removed"))
