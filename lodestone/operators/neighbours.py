"""Near vectors over whole tables: all alike pairs by verified buckets, a stored index of inverted lists, and clusters by
average linkage on a sparse graph of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.sources.scratch import dropped, kept

#: Vectors that a bucket holds in the mean; up to so many in all, one bucket has all pairs and nothing is missed.
BUCKET = 1024
#: Members of a bucket that one task compares with as many others.
BLOCK = 1024
#: Vectors of a block where all pairs are compared; partitions that the blocks of a side are dealt into, at most.
SIDE, DEALT = 4096, 64
#: Rows of a block that are compared with another at a time, where only the nearest counts; partitions of the other blocks at
#: least, and blocks of each at most.
STRIPE, OTHERS, HELD = 256, 8, 32
#: Rows of an index that its centres are fitted on, and queries that its probes are fitted on, at most.
SAMPLE, PROBED = 100_000, 256
#: Scores that a task holds at a time, of rows with queries or centres.
CELLS = 1 << 21


def valid(column: str) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    v = F.col(column)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-300, np.sqrt((x * x).sum(1)))[:, None]


def tables_for(bits: int, least: float, recall: float) -> int:
    """Tables after which a pair of just the least cosine has met in one with probability `recall`."""
    one = (1 - math.acos(least) / math.pi) ** bits
    return 1 if bits == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - one)))


def _packed(rows: DataFrame, side: int) -> tuple[DataFrame, int]:
    """Rows (id, n, v) as blocks of about `side` vectors of one length, a row each with arrays as bytes, and how many. A
    block's rows stand by id."""
    blocks = max(1, math.ceil(rows.count() / side))

    def pack(block: pa.Table) -> pa.Table:
        x, order = _matrix(block.column("v").combine_chunks()), np.argsort(block.column("id").to_numpy())
        parts = [block.column("id").to_numpy()[order].tobytes(), block.column("n").to_numpy()[order].astype(np.int64).tobytes(), x[order].tobytes()]
        return pa.table([pa.array([x.shape[1]], pa.int32()), block.column("b").slice(0, 1), *(pa.array([p], pa.binary()) for p in parts)], names=["size", "b", "ids", "ns", "xs"])

    told = rows.select("id", "n", "v", F.size("v").alias("size"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    return kept(told.groupBy("size", "b").applyInArrow(pack, "size int, b int, ids binary, ns binary, xs binary")), blocks


def _met(left: DataFrame, right: DataFrame, parts: int, once: bool = False, others: int | None = None) -> DataFrame:
    """Every block of one side beside every block of the other; `once` gives each pair of one table's blocks once. Blocks
    are read by the tasks that compare them: no pair is shuffled, and a task holds two blocks. A left block's pairs follow
    each other; the right ones are dealt into `others` partitions."""
    a, b = left.repartition(min(parts, DEALT)), right.repartition(others or min(parts, DEALT)).toDF("size_2", "b_2", "ids_2", "ns_2", "xs_2")
    same = (F.col("size") == F.col("size_2")) & ((F.col("b") <= F.col("b_2")) if once else F.lit(True))
    return a.hint("shuffle_replicate_nl").join(b, same)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of each row of _met(): whether both sides are one block, and ids, numbers and vectors of both."""
    for row in batch.to_pylist():
        sides = [(np.frombuffer(row["ids" + s], np.int64), np.frombuffer(row["ns" + s], np.int64), np.frombuffer(row["xs" + s]).reshape(-1, row["size"])) for s in ("", "_2")]
        yield row["b"] == row["b_2"], *sides


def all_links(rows: DataFrame, least: float, side: int = SIDE) -> DataFrame:
    """(a, b, similarity, pairs) of all pairs a < b of rows (id, n, v) with a cosine of at least `least`, none missed: pairs
    of blocks are matrix products, and only links leave a task. Time grows with the square of the rows, memory doesn't."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, (ids, n, x), (ids_2, n_2, y) in _blocks(batch):
                x, y = _unit(x), _unit(y)
                for k in range(0, len(ids), 1024):
                    near = x[k : k + 1024] @ y.T >= least
                    i, j = np.nonzero(np.triu(near, k + 1) if same else near)
                    i = i + k
                    low, high = np.minimum(ids[i], ids_2[j]), np.maximum(ids[i], ids_2[j])
                    yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array((x[i] * y[j]).sum(1)), pa.array(n[i] * n_2[j])], ["a", "b", "similarity", "pairs"])

    packed, parts = _packed(rows, side)
    return _met(packed, packed, parts, once=True).mapInArrow(compare, "a long, b long, similarity double, pairs long")


def alike_classes(vectors: DataFrame, least: float = 0.7, recall: float | None = 0.95, seed: int = 8, bucket: int = BUCKET, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links) of all rows against all. members: vec_id, class_id, the smallest vec_id with the same vector.
    links: a < b (classes), similarity of at least `least`, pairs (of members that the link stands for).

    Vectors of one class are compared once. Classes meet in buckets of signs of random projections: as many bits as make
    buckets of about `bucket` classes, and as many tables as meet a pair of just the least cosine with probability
    `recall`, a nearer one more surely; without `recall` all pairs are compared, by all_links(). Up to `bucket` classes there is one bucket and no pair is missed. A bucket of more
    than `block` classes is dealt into blocks, and pairs of blocks are tasks of bounded size. Pairs are verified on the
    vectors in double precision. Vectors that are null, empty, zero or hold null or non-finite components are classes of
    their own without links; vectors of different lengths never meet. vectors: vec_id, prompt_vector."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("prompt_vector").cast("array<double>").alias("v"))
    good = rows.where(valid("v")).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(seed), "v")})
    classes = kept(good.groupBy("h", "h2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v")))
    members = good.join(classes.select("h", "h2", "class_id"), ["h", "h2"]).select("vec_id", "class_id")
    members = members.unionByName(rows.where(~valid("v")).select("vec_id", F.col("vec_id").alias("class_id")))
    if recall is None:
        return members, all_links(classes.select(F.col("class_id").alias("id"), "n", "v"), least)
    bits = max(0, math.ceil(math.log2(max(1, classes.count()) / bucket)))
    tables = tables_for(bits, least, recall)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for size in np.unique(sizes):
                own = batch.filter(pa.array(sizes == size))
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, int(size)]).standard_normal((int(size), tables * bits))
                for a in range(0, own.num_rows, 512):
                    part = own.slice(a, 512)
                    sign = (_matrix(part.column(2)) @ planes[size] > 0).reshape(part.num_rows, tables, bits)
                    key = (sign * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                    key = (np.arange(tables) << 48) + (np.int64(size) << 32) + key  # tables, length and bits apart
                    at = pa.array(np.repeat(np.arange(part.num_rows), tables))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(part.column(c).take(at) for c in range(3))], ["key", "class_id", "n", "v"])

    placed = classes.select("class_id", "n", "v").mapInArrow(hashed, "key long, class_id long, n long, v array<double>")
    placed = kept(placed)
    large = placed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block).select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = placed.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("right"), "class_id", "n", "v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cell: pa.Table) -> pa.RecordBatch:
            x, ids, n, right = _unit(_matrix(cell.column("v").combine_chunks())), cell.column("class_id").to_numpy(), cell.column("n").to_numpy(), cell.column("right").to_numpy(zero_copy_only=False)
            if cell.column("lo")[0].as_py() == cell.column("hi")[0].as_py():
                i, j = np.nonzero(np.triu(x @ x.T >= least, 1))
            else:
                a, b = np.flatnonzero(~right), np.flatnonzero(right)
                i, j = np.nonzero(x[a] @ x[b].T >= least)
                i, j = a[i], b[j]
            score = (x[i] * x[j]).sum(1)
            low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            return pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(score), pa.array(n[i] * n[j])], ["a", "b", "similarity", "pairs"])

        held = None  # a cell's rows follow one another, as the partition is sorted; a cell is bounded by two blocks
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            names = np.column_stack([held.column(c).to_numpy() for c in ("key", "lo", "hi")])
            ends = np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1
            for a, b in zip([0, *ends[:-1]], ends):
                yield pairs(held.slice(a, b - a))
            held = held.slice(ends[-1] if len(ends) else 0)
        if held is not None and held.num_rows:
            yield pairs(held)

    found = cells.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "a long, b long, similarity double, pairs long")
    return members, found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.max("pairs").alias("pairs"))


def link_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """vec_id, class_id and n_links: how many other vectors are alike, copies included."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("class_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    each = sizes.join(others, "class_id", "left").select("class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(each, "class_id").select("vec_id", "class_id", "n_links")


# Stated queries against all rows, as matrix products


def _rows(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column, zeros for nulls, and which are there."""
    there = column.is_valid().to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), size))
    x[there] = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return _unit(x), there


def _matches(batch: pa.RecordBatch, ids: np.ndarray, q: np.ndarray, groups: np.ndarray | None, weights: list[float | None], least: float, k: int | None) -> Iterator[pa.RecordBatch]:
    """source_id, vec_id, score of a batch (vec_id, vectors by weight, group) of compared(), a thousand rows with CELLS as
    many queries at a time: the memory of a task doesn't grow with the queries."""
    for a in range(0, batch.num_rows, 1024):
        part = batch.slice(a, 1024)
        sides = [_rows(part.column(c), q.shape[1]) for c in range(1, len(weights) + 1)]
        names = part.column(0).to_numpy()
        own_group = None if groups is None else part.column(len(weights) + 1).to_numpy(zero_copy_only=False).astype(float)
        for b in range(0, len(ids), CELLS // 1024):
            at, score = slice(b, b + CELLS // 1024), None
            for (x, there), weight in zip(sides, weights):
                own = np.where(there, q[at] @ x.T, -np.inf) * (1 if weight is None else weight)
                score = own if score is None else np.maximum(score, own) if weight is None else score + own
            score[ids[at, None] == names[None]] = -np.inf
            if groups is not None:
                score = np.where(groups[at, None] == own_group[None], np.round(score, 12), -np.inf)
            low = np.full((len(score), 1), least)
            if k is not None and score.shape[1] > k:
                low = np.maximum(low, np.partition(score, score.shape[1] - k, axis=1)[:, -k, None])
            i, j = np.nonzero((score >= low) & (score > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at][i]), pa.array(names[j]), pa.array(score[i, j])], ["source_id", "vec_id", "score"])


def compared(vectors: DataFrame, queries: DataFrame, columns: dict[str, float | None], least: float, k: int | None = None, most: int = 20_000, group: str | None = None) -> DataFrame:
    """source_id, vec_id, score of at least `least`, of each query with every other row; the `k` best of a query, if given.

    The score adds up the cosines of the query with the columns by their weights, and needs them all; weights of None
    take the greatest cosine there is. queries: source_id, vector: a stated set, which goes to the tasks in parts of about
    `most`, however many there are. Vectors without a direction, or of another length than the query's, have no cosine.
    A batch of rows and a part of the queries are one matrix product; only matches leave the task. `group` names a column of
    whole numbers on both sides: a query then meets rows of its own group only, and scores count to twelve digits, so that
    copies tie."""
    spark, out = vectors.sparkSession, None
    told = queries.where(F.col(group).isNotNull()).select("source_id", F.col(group).cast("long")).toArrow() if group else None  # of the stated queries
    own_group = dict(zip(*(c.to_pylist() for c in told.columns))) if group else {}
    for ids, q in _parts(queries, most):
        groups = np.array([own_group.get(i, np.nan) for i in ids.tolist()], float) if group else None
        shared, size = spark.sparkContext.broadcast((ids, q, groups)), q.shape[1]

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _matches(batch, *shared.value, list(columns.values()), least, k)

        told = [F.when(valid(c) & (F.size(c) == size), F.col(c).cast("array<double>")).alias(c) for c in columns]
        found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *told, *([F.col(group).cast("double")] if group else [])).mapInArrow(search, "source_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "source_id long, vec_id long, score double")
    if k is None:
        return out
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k)


def nearest_centres(vectors: DataFrame, centres: DataFrame, k: int, most: int = 20_000) -> DataFrame:
    """vec_id, rank, cluster, score: the k centres (label, centroid) of the greatest cosine with each prompt_vector, ties to
    the smaller label. Centres go to the tasks in parts; k rows of a vector leave a task for each part."""
    kind, out, parts = centres.schema["label"].dataType, None, 0
    for ids, q in _parts(centres.select(F.col("label").alias("source_id"), F.col("centroid").alias("vector")), most):
        order = np.argsort(ids, kind="stable")
        shared, size, parts = vectors.sparkSession.sparkContext.broadcast((ids[order], q[order])), q.shape[1], parts + 1

        def rank(batches: Iterator[pa.RecordBatch], shared=shared, size=size) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            step = min(1024, max(1, CELLS // len(ids)))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    score = _rows(part.column(1), size)[0] @ q.T
                    best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    n = best.shape[1]
                    at = np.repeat(np.arange(part.num_rows), n)
                    ranks = np.tile(np.arange(1, n + 1, dtype=np.int32), part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(ranks), pa.array(ids[best.ravel()]), pa.array(score[at, best.ravel()])], ["vec_id", "rank", "cluster", "score"])

        own = vectors.where(valid("prompt_vector") & (F.size("prompt_vector") == size)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("prompt_vector").cast("array<double>"))
        found = own.mapInArrow(rank, "vec_id long, rank int, cluster long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = vectors.sparkSession.createDataFrame([], "vec_id long, rank int, cluster long, score double")
    if parts > 1:
        place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("score"), "cluster"))
        out = out.withColumn("rank", place).where(F.col("rank") <= k)
    return out.withColumn("cluster", F.col("cluster").cast(kind))


# A stored index of inverted lists: a folder with `centres`, `vectors` (partitioned by list) and `probes`.


def lists_for(n: int) -> int:
    """50, 100 or 200 lists, by the number of vectors."""
    return 50 if n < 50_000 else 100 if n < 1_000_000 else 200


def _nearest_list(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, unit, list: the list whose centre has the greatest inner product with a unit vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # as many rows as the index has lists

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column(1)))
                unit = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), unit, pa.array((x @ shared.value.T).argmax(1).astype(np.int32))], ["vec_id", "unit", "list"])

    known = vectors.where(valid("prompt_vector") & (F.size("prompt_vector") == centres.shape[1]))
    return known.select(F.col("vec_id").cast("long"), F.col("prompt_vector").cast("array<double>")).mapInArrow(place, "vec_id long, unit array<double>, list int")


def _centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])  # one row a list


def build_index(vectors: DataFrame, path: str, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> None:
    """Writes an index of vectors (vec_id, prompt_vector) to a folder. Centres are fitted by k-means on at most about
    `sample` rows; every valid vector gets a list. The folder must be new."""
    good = vectors.where(valid("prompt_vector"))
    n = good.count()
    if not n:
        raise ValueError("no vector to index")
    few = good.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1_000_003)) < max(1, int(1_000_003 * sample / n))) if n > sample else good
    unit = kept(few.select(W.normalised(F.col("prompt_vector")).alias("unit")))  # read in as many parts as there are cores
    model = KMeans(k=min(lists or lists_for(n), n), seed=seed, featuresCol="features").fit(unit.select(array_to_vector("unit").alias("features")))
    dropped(unit)
    centres = _unit(np.array(model.clusterCenters()))
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    vectors.sparkSession.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    append_vectors(vectors, path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Adds vectors to an index, by its present centres. A vec_id that is there already is there twice then."""
    placed = _nearest_list(vectors, _centres(vectors.sparkSession, path))
    placed.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.mode("append").partitionBy("list").parquet(f"{path}/vectors")


def _index_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, unit array<double>, list int").parquet(f"{path}/vectors")


def refreshed_centres(spark: SparkSession, path: str) -> DataFrame:
    """(list, centre, n, moved): the mean direction of each list's present vectors, and its distance from the centre by
    which they were placed. A list without vectors keeps its centre."""
    from .memory import centroids

    rows = _index_rows(spark, path)
    now = centroids(rows.select(F.col("list").alias("label"), F.col("unit").alias("prompt_vector")))
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    old = spark.read.parquet(f"{path}/centres")
    both = old.join(now.select(F.col("label").alias("list"), W.normalised(F.col("centroid")).alias("new")), "list", "left").join(sizes, "list", "left")
    return both.select("list", F.coalesce("new", "centre").alias("centre"), F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("new").isNull(), 0.0).otherwise(1 - W.dot(F.col("new"), F.col("centre"))).alias("moved"))


def rebuilt_index(spark: SparkSession, path: str, new_path: str) -> None:
    """A copy of an index in a new folder whose centres are refreshed and whose vectors are placed by them."""
    refreshed_centres(spark, path).select("list", "centre").coalesce(1).write.parquet(f"{new_path}/centres")
    append_vectors(_index_rows(spark, path).select("vec_id", F.col("unit").alias("prompt_vector")), new_path)


def _parts(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stated queries (source_id, vector) in parts of about `most` rows, whatever their number: ids and unit vectors."""
    known = queries.where(valid("vector")).select(F.col("source_id").cast("long").alias("source_id"), F.col("vector").cast("array<double>").alias("vector"))
    n = math.ceil(known.count() / most)
    for k in range(n):
        rows = (known.where(F.pmod(F.xxhash64("source_id"), F.lit(n)) == k) if n > 1 else known).toArrow()
        if rows.num_rows:
            yield rows.column(0).to_numpy(), _unit(_matrix(rows.column(1).combine_chunks()))


class _Best:
    """The k rows of the greatest score of each of n queries, ties to the smaller name, of blocks that come one after another.
    What can't be among them isn't kept: n * k rows stay, beside at most twice CELLS that wait to be sorted in."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.last = k, np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def add(self, at: np.ndarray, names: np.ndarray, score: np.ndarray) -> None:
        """Scores of queries `at` with the rows `names`; minus infinity for none."""
        few = np.flatnonzero(self.least[at] == -np.inf)  # the queries that have no k rows yet
        if score.shape[1] >= self.k and len(few):
            self.least[at[few]] = np.partition(score[few], score.shape[1] - self.k, axis=1)[:, -self.k]
        least = self.least[at]
        i, j = np.nonzero(score >= least[:, None])
        s, query, name = score[i, j], at[i], names[j]
        good = (s > -np.inf) & ((s > least[i]) | (name <= self.last[query]))
        self.held.append((query[good], name[good], s[good]))
        self.waiting += int(good.sum())
        if self.waiting > CELLS:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, names and scores so far, at most k rows a query."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, name, s = (np.concatenate(v) for v in zip(*self.held))
        order = np.lexsort((name, -s, query))
        query, name, s = query[order], name[order], s[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        full = place == self.k - 1
        self.least[query[full]], self.last[query[full]] = s[full], name[full]
        top = place < self.k
        self.held, self.waiting = [(query[top], name[top], s[top])], 0
        return self.held[0]


def nearest_in_lists(spark: SparkSession, path: str, queries: DataFrame, probes: int, k: int = 10, most: int = 20_000) -> DataFrame:
    """source_id, rank, vec_id, score: the k nearest by cosine of each query among the vectors of its `probes` nearest
    lists, but itself. Only the partitions of lists that a query probes are read. Queries come in parts of `most`. A task
    gives k rows of a query at most, however many lists, files and blocks it reads."""
    centres, out = _centres(spark, path), None
    for ids, q in _parts(queries, most):
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        asked = {int(c): np.flatnonzero((near == c).any(1)) for c in np.unique(near)}
        shared = spark.sparkContext.broadcast((ids, q, asked))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, asked = shared.value
            best = _Best(len(ids), k)
            for batch in batches:
                lists = batch.column(2).to_numpy()
                for c in np.unique(lists):
                    part, rows = batch.filter(pa.array(lists == c)), asked[int(c)]
                    for a in range(0, part.num_rows, 1024):
                        own = part.slice(a, 1024)
                        x, names = _matrix(own.column(1)), own.column(0).to_numpy()
                        for b in range(0, len(rows), CELLS // 1024):
                            at = rows[b : b + CELLS // 1024]
                            score, same = q[at] @ x.T, np.flatnonzero(np.isin(names, ids[at]))
                            score[:, same] = np.where(ids[at][:, None] == names[None, same], -np.inf, score[:, same])
                            best.add(at, names, score)
            at, names, score = best.rows()
            for a in range(0, len(at), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[a : a + (1 << 16)]]), *(pa.array(v[a : a + (1 << 16)]) for v in (names, score))], ["source_id", "vec_id", "score"])

        found = _index_rows(spark, path).where(F.col("list").isin(*asked)).mapInArrow(search, "source_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "source_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("source_id", "rank", "vec_id", "score")


def fitted_probes(spark: SparkSession, path: str, k: int = 10, recall: float = 0.95, sample: int = PROBED, seed: int = 2) -> int:
    """The fewest lists to probe so that at least `recall` of the true k nearest of a sample of indexed vectors are in
    them. The sample's neighbours come from all lists, so the figure is measured, not assumed. Stored with the index."""
    rows, centres = _index_rows(spark, path), _centres(spark, path)
    few = rows.orderBy(F.xxhash64("vec_id", F.lit(seed))).limit(sample).select(F.col("vec_id").alias("source_id"), F.col("unit").alias("vector"))
    few = kept(few)
    true = nearest_in_lists(spark, path, few, len(centres), k).select("source_id", "vec_id")
    own = true.join(few.select("source_id", "vector"), "source_id").join(rows.select("vec_id", "list"), "vec_id").select("vector", "list").toArrow()  # sample x k rows
    if not own.num_rows:
        return 1
    order = np.argsort(-(_matrix(own.column(0).combine_chunks()) @ centres.T), axis=1, kind="stable")
    place = np.sort((order == own.column(1).to_numpy()[:, None]).argmax(1))
    probes = int(place[min(len(place) - 1, math.ceil(recall * len(place)) - 1)]) + 1
    spark.createDataFrame([(k, recall, probes)], "k int, recall double, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return probes


# Clusters


def linked_clusters(nodes: DataFrame, links: DataFrame, stop: float = 0.3) -> DataFrame:
    """(id, cluster): agglomerative clusters by average linkage on a graph of similarities, merged until no two clusters
    have a mean similarity of at least 1 - stop over all pairs of their members; a pair without a link counts as 0. A
    cluster is named by its smallest id.

    Every cluster's best neighbour is found by an aggregation, and those that are each other's best merge, all in one
    round. Average linkage never lets a merged cluster come nearer than its parts were, so this gives the clusters that
    merging the best pair at a time gives, save where similarities tie. Rounds end when no pair is near enough; each is a
    constant number of joins over what is left, written as a table. nodes: id; links: a, b, similarity, one row a pair."""
    least = 1 - stop
    member = nodes.select(F.col("id"), F.col("id").alias("cluster"))
    total = kept(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("similarity").alias("total"), F.lit(1).cast("long").alias("n_a"), F.lit(1).cast("long").alias("n_b")))
    while True:
        rated = total.withColumn("mean", F.col("total") / (F.col("n_a") * F.col("n_b"))).where(F.col("mean") >= least)
        both = rated.select("a", "b", "mean").unionByName(rated.select(F.col("b").alias("a"), F.col("a").alias("b"), "mean"))
        best = both.groupBy("a").agg(F.max_by("b", F.struct("mean", -F.col("b"))).alias("b"))
        merge = best.join(best.select(F.col("a").alias("b"), F.col("b").alias("back")), "b").where((F.col("back") == F.col("a")) & (F.col("a") < F.col("b")))
        merge = kept(merge.select(F.col("b").alias("gone"), F.col("a").alias("into")))
        if merge.isEmpty():
            return member
        old, member = member, kept(_renamed(member, merge, "cluster"))
        dropped(old)
        moved = total
        for side in ("a", "b"):
            into = merge.select(F.col("gone").alias(side), "into")
            moved = moved.join(into, side, "left").withColumn(side, F.coalesce("into", side)).drop("into", f"n_{side}")
        moved = moved.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total"))
        size = member.groupBy("cluster").agg(F.count("*").alias("n"))
        for side in ("a", "b"):
            moved = moved.join(size.select(F.col("cluster").alias(side), F.col("n").alias(f"n_{side}")), side)
        old, total = total, kept(moved.select("a", "b", "total", "n_a", "n_b"))
        dropped(old, merge)


def _renamed(rows: DataFrame, merge: DataFrame, column: str) -> DataFrame:
    told = rows.join(merge.withColumnRenamed("gone", column), column, "left")
    return told.withColumn(column, F.coalesce("into", column)).drop("into").select(*rows.columns)


class _Nearest:
    """Of each row of a block the other row with the largest product, rounded to twelve digits, of those of at least `least`;
    of equal ones that with the smallest id. Products are single ones first; those that may be the largest, as far as a
    single product's error goes, are worked out in double precision."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, least: float):
        self.ids, self.x, self.single, self.least = ids, x, x.astype(np.float32), least
        self.id, self.top = np.zeros(len(ids), np.int64), np.full(len(ids), -np.inf)
        self.error = (x.shape[1] + 8) * 2.0**-23

    def add(self, others: np.ndarray, y: np.ndarray) -> None:
        """A block of other rows, by id, none longer than 1; a row isn't its own neighbour."""
        at = np.searchsorted(others, self.ids).clip(max=len(others) - 1)
        itself, single = others[at] == self.ids, y.astype(np.float32).T
        for k in range(0, len(self.ids), STRIPE):
            own = slice(k, k + STRIPE)
            product = self.single[own] @ single
            product[np.flatnonzero(itself[own]), at[own][itself[own]]] = -np.inf
            top, low = product.max(1), np.maximum(self.top[own], self.least) - self.error
            some = np.flatnonzero(top >= low)
            if not len(some):
                continue
            i, j = np.nonzero(product[some] >= np.maximum(low, top - 2 * self.error)[some, None])
            if len(i) <= 8 * len(some):
                value = np.round((self.x[k + some[i]] * y[j]).sum(1), 12)
                first = np.lexsort((j, -value, i))
                first = first[np.searchsorted(i, np.arange(len(some)))]
                value, j = value[first], j[first]
            else:  # many are as good as equal
                whole = np.round(self.x[k + some] @ y.T, 12)
                whole[product[some] == -np.inf] = -np.inf
                j = whole.argmax(1)
                value = whole[np.arange(len(some)), j]
            some = some + k
            better = (value >= self.least) & ((value > self.top[some]) | ((value == self.top[some]) & (others[j] < self.id[some])))
            self.id[some[better]], self.top[some[better]] = others[j[better]], value[better]

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.top >= self.least)
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (self.ids, self.id, self.top)], ["a", "b", "mean"])


def average_linkage(vectors: DataFrame, stop: float = 0.3, floor: float = 0.5, recall: float = 0.95) -> DataFrame:
    """(vec_id, cluster): all vectors, clustered on the graph of their pairs of a cosine of at least `floor`, which is
    below 1 - stop so that a cluster may hold pairs that are somewhat further apart. Copies of one vector are one node."""
    members, links = alike_classes(vectors, floor, recall)
    members = kept(members)
    placed = linked_clusters(members.select(F.col("class_id").alias("id")).distinct(), links, stop)
    return members.join(placed.withColumnRenamed("id", "class_id"), "class_id").select("vec_id", "cluster")


def mean_linkage(vectors: DataFrame, stop: float = 0.3, side: int = SIDE) -> DataFrame:
    """(vec_id, cluster): all vectors, clustered by average linkage over all pairs, copies included, until no two clusters
    have a mean cosine of at least 1 - stop. A cluster is named by its smallest vec_id; vectors without a direction are
    alone.

    A mean cosine of two clusters is the product of the sums of their unit vectors over the product of their sizes, so a
    cluster is one row and no pair is ever stored. Each cluster's best neighbour comes from products of blocks; those that
    are each other's best merge, all in one round, which gives what merging the best pair at a time gives, save where
    means tie. A merged cluster is never nearer to another than its parts were: so a best neighbour stands until one of
    the two merges, and a cluster without any leaves the search. Once `side` clusters are left in it, or fewer, one task
    merges them to the end."""
    least = 1 - stop
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("prompt_vector").cast("array<double>").alias("v"))
    good = rows.where(valid("v")).withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(8), "v")})
    classes = kept(good.groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v")))
    member = kept(good.join(classes.select("h", "h2", F.col("id").alias("cluster")), ["h", "h2"]).select("vec_id", "cluster"))
    whole, best, asked = kept(classes.select("id", "n", F.transform(W.normalised(F.col("v")), lambda x: x * F.col("n")).alias("v"))), None, None
    dropped(classes)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, found = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                this = row.column("size")[0].as_py(), row.column("b")[0].as_py()
                _, (ids, n, x), (ids_2, n_2, y) = next(_blocks(row))
                if this != block:
                    if found:
                        yield found.rows()
                    block, found = this, _Nearest(ids, x / n[:, None], least)
                found.add(ids_2, y / n_2[:, None])
        if found:
            yield found.rows()

    def merged(rest: pa.Table) -> pa.Table:
        order = np.argsort(rest.column("id").to_numpy())
        ids, n = rest.column("id").to_numpy()[order], rest.column("n").to_numpy()[order].astype(float)
        x = _matrix(rest.column("v").combine_chunks())[order] / n[:, None]
        mean = np.round(x @ x.T, 12)
        np.fill_diagonal(mean, -np.inf)
        into, j = np.arange(len(ids)), mean.argmax(1)
        top = mean[into, j]
        while len(ids) > 1 and top.max() >= least:
            a = int(top.argmax())
            a, b = min(a, j[a]), max(a, j[a])
            mean[a] = mean[:, a] = (mean[a] * n[a] + mean[b] * n[b]) / (n[a] + n[b])
            mean[b], mean[:, b], mean[a, a], n[a] = -np.inf, -np.inf, -np.inf, n[a] + n[b]
            into[into == b] = a
            stale = np.flatnonzero((j == a) | (j == b) | (np.arange(len(ids)) == a) | (np.arange(len(ids)) == b))
            j[stale] = mean[stale].argmax(1)
            top[stale] = mean[stale, j[stale]]
        gone = into != np.arange(len(ids))
        return pa.table({"gone": ids[gone], "into": ids[into[gone]]})

    while True:
        if whole.count() <= side:  # so few are left that one task of bounded size merges them to the end
            last = kept(whole.groupBy(F.size("v")).applyInArrow(merged, "gone long, into long"))
            alone = rows.where(~valid("v")).select("vec_id", F.col("vec_id").alias("cluster"))
            return _renamed(member, last, "cluster").unionByName(alone)
        right, parts = _packed(whole, side)
        left, few = (right, parts) if asked is None else _packed(asked, side)
        met = _met(left, right, few, others=min(parts, max(OTHERS, math.ceil(parts / HELD)))).mapInArrow(nearest, "a long, b long, mean double")
        new = met.groupBy("a").agg(F.max_by(F.struct("b", "mean"), F.struct("mean", -F.col("b"))).alias("x")).select("a", "x.b", "x.mean")
        old, best = best, kept(new if best is None else best.unionByName(new))
        dropped(left, right, *([asked] if asked is not None else []), *([old] if old is not None else []))
        both = best.where("a < b").join(best.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
        merge = kept(both.select(F.col("b").alias("gone"), F.col("a").alias("into")))
        if merge.isEmpty():  # means that tie may stand in a ring: then the best pair merges alone
            dropped(merge)
            merge = kept(best.orderBy(F.desc("mean"), "a").limit(1).select(F.greatest("a", "b").alias("gone"), F.least("a", "b").alias("into")))
            if merge.isEmpty():
                alone = rows.where(~valid("v")).select("vec_id", F.col("vec_id").alias("cluster"))
                return member.unionByName(alone)
        old, member = member, kept(_renamed(member, merge, "cluster"))
        dropped(old)
        able = whole.join(best.select(F.col("a").alias("id")).unionByName(best.select(F.col("b").alias("id"))).distinct(), "id")
        joined = _renamed(able, merge, "id")
        total = joined.groupBy("id").agg(F.sum("n").alias("n"), F.collect_list("v").alias("v"))  # one row, or two that merge
        old, whole = whole, kept(total.select("id", "n", F.reduce("v", F.transform(F.col("v")[0], lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y)).alias("v")))
        touched = merge.select(F.col("gone").alias("id")).unionByName(merge.select(F.col("into").alias("id")))
        stands = best.join(touched.withColumnRenamed("id", "a"), "a", "left_anti").join(touched.withColumnRenamed("id", "b"), "b", "left_anti")
        stands = kept(stands.select("a", "b", "mean"))
        asked = kept(whole.join(stands.select(F.col("a").alias("id")), "id", "left_anti"))
        dropped(old, best, merge)
        best = stands
