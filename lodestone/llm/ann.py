"""Nearest neighbours by largest inner product: a hash-prefix forest.

A vector is scaled by the greatest norm and gets one more coordinate that makes its length 1, so the largest inner
product is the smallest angle. In each of `TREES` trees it gets a string of `LENGTH` symbols: a fast rotation is cut into
blocks, and a block's nearest cross-polytope vertex is one symbol. A tree is the array of all strings in sorted order;
vectors that share a prefix stand side by side in it, so a prefix is a range and its size a count.

A query descends in every tree to its longest matching prefix, then ascends in all trees at once, symbol by symbol,
until the ranges hold at least `LEAST` entries and a share of all vectors; the whole table is the last step. The share
is fitted on a bounded sample: the least of SHARES with which the sample's queries find TARGET of their true neighbours
in the sample. Where neighbours are near it is 0 and a query has some LEAST candidates, however large the table; where
all vectors are about equally far, as in isotropic data, no index finds them with few, and the share grows.

Each (tree, prefix) range that queries ended at is cut into blocks of about `BLOCK` entries and of about `ASKING` queries;
each pair of blocks is scored as one matrix product, of which only the best leave.

Equal vectors are one entry of the forest, with as many of their smallest ids as a result can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, stored
from .vectors import matrix, power_of_two, rotated, symbols, usable

TREES, LENGTH, BLOCK, ASKING, NEAREST = 40, 4, 4096, 1024, 20
LEAST, SHARES, TARGET = 2000, (0.0, 0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.35, 0.5, 1.0), 0.95
#: The share is fitted on at most so many vectors, and so many queries among them.
SAMPLE, SAMPLE_QUERIES = 16_384, 128


def strings(x: np.ndarray, trees: int, length: int) -> np.ndarray:
    """Hash strings (rows x trees) of unit vectors, a symbol to 8 bits, the first symbol highest."""
    to = max(32 * length, power_of_two(x.shape[1]))
    block = to // length
    out = []
    for t in range(trees):
        y = rotated(x, 7_000 + t, to)
        code = np.zeros(len(x), np.int64)
        for s in range(length):
            code = code << 8 | (symbols(y[:, s * block : (s + 1) * block])[:, 0] & 255)
        out.append(code)
    return np.stack(out, 1)


def forest(classes: DataFrame, greatest: float, trees: int, length: int) -> DataFrame:
    """Entries and queries of the forest: rep, embedding, asks, and `codes`, one string per tree. Queries are hashed as
    entries and, being scaled to length 1 without the extra coordinate, once more as `query_codes`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = matrix(part.column(1))
                norm = np.sqrt((x * x).sum(1))
                lift = np.sqrt(np.maximum(0, 1 - (norm / greatest) ** 2))
                codes = strings(np.column_stack([x / greatest, lift]), trees, length)
                asks = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                own = np.zeros_like(codes)
                if asks.any():
                    own[asks] = strings(np.column_stack([x / norm[:, None], np.zeros(len(x))])[asks], trees, length)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * trees), pa.array(v.ravel())) for v in (codes, own)]
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], ["rep", "embedding", "asks", "codes", "query_codes"])

    return classes.select("rep", "embedding", "asks").mapInArrow(run, "rep long, embedding array<double>, asks boolean, codes array<long>, query_codes array<long>")


def fitted_share(index: DataFrame, k: int, least: int, length: int) -> float:
    """The share of a table that a query's ranges must hold, from a sample of at most SAMPLE entries by hash."""
    rows = index.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding", "asks", "codes", "query_codes").toArrow()
    asking = np.flatnonzero(rows["asks"].to_numpy())[:SAMPLE_QUERIES]
    n = rows.num_rows
    if n <= max(least, k) or not len(asking):
        return 1.0
    x, codes, own_codes = matrix(rows["embedding"]), *(ragged(rows[c])[0].reshape(n, -1) for c in ("codes", "query_codes"))
    levels, recalls = [], []
    for q in asking:
        own = own_codes[q]
        score = x @ x[q]
        score[q] = -np.inf
        true = np.argsort(-score, kind="stable")[:k]
        met = [(codes >> 8 * (length - v)) == (own >> 8 * (length - v))[None] for v in range(1, length + 1)]
        levels.append([n, *(int(m.sum()) for m in met)])
        recalls.append([1.0, *(m[true].any(1).mean() for m in met)])
    levels, recalls = np.array(levels), np.array(recalls)
    for share in SHARES:
        deepest = ((levels >= share * n) * np.arange(length + 1)).max(1)
        if recalls[np.arange(len(asking)), deepest].mean() >= TARGET:
            return share
    return 1.0


def best_of_ranges(asked: DataFrame, held: DataFrame, keep: int) -> DataFrame:
    """For each group (tree, level, prefix, part, asking): each query's `keep` best entries, as (query, rep, score)."""

    def score(queries: pa.Table, entries: pa.Table) -> pa.Table:
        if not queries.num_rows or not entries.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q, x = matrix(queries["embedding"]), matrix(entries["embedding"])
        who, rep = queries["query"].to_numpy(), entries["rep"].to_numpy()
        order = np.argsort(rep)  # ties go to the smaller id
        x, rep = x[order], rep[order]
        n, rows = min(keep, len(rep)), []
        for a in range(0, len(q), 256):
            s = q[a : a + 256] @ x.T
            at = np.argsort(-s, axis=1, kind="stable")[:, :n] if n < len(rep) else np.broadcast_to(np.arange(n), (len(s), n))
            rows.append((np.repeat(who[a : a + 256], n), rep[at].ravel(), np.take_along_axis(s, at, 1).ravel()))
        cols = [np.concatenate(c) for c in zip(*rows)]
        return pa.table({"query": cols[0], "rep": cols[1], "score": cols[2]})

    key = ["tree", "level", "prefix", "part", "asking"]
    return asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(score, "query long, rep long, score double")


def nearest(vectors: DataFrame, asks, k: int = NEAREST, trees: int = TREES, length: int = LENGTH, least: int = LEAST, share: float | None = None) -> DataFrame:
    """The k nearest of each query among all other rows: query_id, rank (from 1), vec_id, score (inner product of the
    given vectors, in double precision), nearest first, ties to the smaller vec_id. `asks` is a condition on vec_id. The
    share of a table that a query's candidates make is fitted, unless it is given.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a null vec_id, take no part.
    A query meets vectors of its own length only. Rows that repeat a vec_id count once; if their vectors differ, the
    first in order counts. Only vec_id and embedding are
    read. With fewer than k others, a query has fewer rows; an empty table gives none."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    able = given.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    able = stored(able.withColumn("ask", asks(F.col("vec_id"))).withColumn("square", F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).withColumn("dim", F.size("embedding")))
    found = None
    for row in able.groupBy("dim").agg(F.max("square").alias("most"), F.count("*").alias("n")).collect():  # lengths of vectors
        own = nearest_of_one_length(able.where(F.col("dim") == row["dim"]), row["most"] ** 0.5, row["n"], k, trees, length, least, share)
        found = own if found is None else found.unionByName(own)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return empty if found is None else found


def nearest_of_one_length(able: DataFrame, greatest: float, n: int, k: int, trees: int, length: int, least: int, share: float | None) -> DataFrame:
    keep = k + 1
    classes = able.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.max("ask").alias("asks"))
    index = stored(forest(classes, greatest, trees, length))
    share = fitted_share(index, k, least, length) if share is None else share

    def prefixes(code: str, levels, who: str) -> DataFrame:
        rows = (index if who == "rep" else index.where("asks")).select(F.col("rep").alias(who), F.posexplode(code).alias("tree", "text"))
        rows = rows.select(who, "tree", "text", F.explode(F.array(*[F.lit(v) for v in levels])).alias("level"))
        return rows.select(who, "tree", "level", F.expr(f"shiftright(text, cast(8 * ({length} - level) as int))").alias("prefix"))

    counts = prefixes("codes", range(1, length + 1), "rep").groupBy("tree", "level", "prefix").agg(F.count("*").alias("n"))
    met = prefixes("query_codes", range(1, length + 1), "query").join(counts, ["tree", "level", "prefix"])
    level = met.groupBy("query", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, int(share * n))).groupBy("query").agg(F.max("level").alias("level"))
    asking = index.where("asks").select(F.col("rep").alias("query"), "query_codes", F.col("embedding"))
    asking = asking.join(level, "query", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    #: At level 0 a range is the whole table, which one tree holds as well as all.
    ranged = asking.select("query", "embedding", "level", F.posexplode("query_codes").alias("tree", "text")).where("level > 0 or tree = 0")
    ranged = stored(ranged.select("query", "embedding", "tree", "level", F.expr(f"if(level = 0, 0, shiftright(text, cast(8 * ({length} - level) as int)))").alias("prefix")))
    spots = ranged.select("tree", "level", "prefix").distinct()

    entries = prefixes("codes", range(1, length + 1), "rep").unionByName(index.select("rep", F.lit(0).alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("prefix")))
    entries = entries.join(spots, ["tree", "level", "prefix"])
    spot = ["tree", "level", "prefix"]
    sizes = entries.groupBy(*spot).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    sizes = stored(sizes.join(ranged.groupBy(*spot).agg(F.ceil(F.count("*") / ASKING).alias("askings")), spot))

    def numbers(c: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))

    held = entries.join(sizes, spot).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts"))).withColumn("asking", numbers("askings")).drop("parts", "askings")
    held = held.join(index.select("rep", "embedding"), "rep")
    asked = ranged.join(sizes, spot).withColumn("asking", F.pmod(F.xxhash64("query"), F.col("askings"))).withColumn("part", numbers("parts")).drop("parts", "askings")
    scored = best_of_ranges(asked, held, keep).groupBy("query", "rep").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    scored = scored.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep)
    #: A class's smallest ids: of one class, no more than these can be in a result.
    few = Window.partitionBy("embedding").orderBy("vec_id")
    ids = able.withColumn("place", F.row_number().over(few)).where(F.col("place") <= keep)
    reps = index.select("rep", "embedding")
    members = ids.join(reps, "embedding").select("rep", "vec_id")
    askers = able.where("ask").join(reps, "embedding").select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    full = askers.join(scored, "query").join(members, "rep").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
