"""What several operators of this subpackage share: shared-folder tables, text buffers, hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


_OWN: dict[str, str] = {}  # by application: Spark doesn't let a running session name the folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one only where a local session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN.get(spark.sparkContext.applicationId) or tempfile.mkdtemp(prefix="lodestone-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def _files(spark: SparkSession, path: str):
    """The file system that holds a path."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and losing an
    executor loses none of it. What is not discarded before goes when the driver ends, as results read it lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared folder, for files that tasks write themselves. It goes when the driver ends."""
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    _files(spark, path).deleteOnExit(spark._jvm.org.apache.hadoop.fs.Path(path))
    return path


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    _files(df.sparkSession, df.stored_path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_path), True)


def give_back() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """step, for mapInArrow, with the memory of a batch given back before the next one and when the task ends. Workers
    stay between tasks, so what they kept would stand beside the executor's heap while they wait."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(fed(batches))
        give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, end to end, and n + 1 offsets into them. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 500_000) -> list[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=U64))
_PLACE = np.arange(1, 257, dtype=U64) * _GOLD  # shingles have up to 256 words


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, and the index of each word's text. Words are what
    stands between blanks and control blanks (0x20, 0x09-0x0D); they end with their text."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, n))
    at = np.arange(starts[0], n) - np.repeat(starts, lengths)
    power = np.full(int(lengths.max()), U64(0xD6E8FEB86659FD93), U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = _BYTE[_LOWER[data[starts[0] :]]] * power[at]
    value[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(offsets, starts, "right") - 1


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct `width`-word shingles of each text as 64-bit hashes, sorted within a text, and n + 1 offsets into
    them. A text with fewer words has its whole sequence as one; a text without words has none."""
    n = len(offsets) - 1
    h, doc = words(data, offsets)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    parts, sizes = [], np.zeros(n + 1, np.int64)
    if len(h):
        total = np.zeros(len(h), U64)
        for k in range(min(width, len(h))):  # the order of the words counts
            total[: len(h) - k] += mix(h[k:] + _PLACE[k])
        total = mix(total)
    for i in range(n):
        a, c = first[i], count[i]
        if c >= width:
            s = np.sort(total[a : a + c - width + 1])
            s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif c:
            s = mix(np.add.reduce(mix(h[a : a + c] + _PLACE[:c]), keepdims=True) + U64(c))
        else:
            continue
        parts.append(s)
        sizes[i + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.cumsum(sizes)


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a list column, end to end, and n + 1 offsets into them."""
    column = column.combine_chunks()
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(), ends - ends[0]


def rooted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b) and, for each, the smallest node that it reaches by them."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, low = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        np.minimum.at(new, low[i], least)
        np.minimum.at(new, low[j], least)
        new = new[new]
        if (new == low).all():
            return names, names[low]
        low = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a long, b long): one row (node, component) per linked node, component its
    smallest reachable node. Alternating large-star and small-star steps; each is an aggregation and an equi-join, and
    what a pair of steps leaves is a table in the shared folder. They end when the links are stars: no node has two
    centres, and no centre has one."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        parents = e.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        twice = parents.where("n > 1").select(F.col("a").alias("x"))
        chained = e.select(F.col("b").alias("x")).distinct().join(parents.select(F.col("a").alias("x")), "x", "left_semi")
        if twice.unionByName(chained).isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))  # a table, so that a hot centre's rows can be split in the join
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = stored(small.select("x.a", "x.b").where("a <> b").distinct())
        discard(e)
        discard(least)
        e = new
    out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
