"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors of one label are one class; its smallest vec_id stands for it. Each of `TABLES` tables joins the nearest
cross-polytope vertices of `FUNCTIONS` rotations to one bucket key. A vector also goes to `FUNCTIONS` probe buckets of
each table, each with one vertex replaced by the runner-up. Only buckets with two vectors or more get vectors at all.
A bucket is cut into blocks of about `BLOCK` vectors and each pair of blocks is one group: its cosines are one matrix
product in a task of bounded memory. Pairs don't leave it: of each vector, the number of verified links that no earlier
bucket holds, and the smallest vector that it reaches by links of the group. So rows grow as members, not as pairs.

Two vectors meet in a table where the main key of one is the main key or a probe key of the other.

A pair of cosine 0.98 in 64 dimensions meets in a table with probability 0.74 (measured), so it is missed by twelve
tables with probability about 1e-7.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, discard, mix, rooted, stored
from .vectors import matrix, of_one_size, power_of_two, rotated, symbols, usable

TABLES, FUNCTIONS, BLOCK, COSINE = 12, 3, 256, 0.98


def bucket_keys(x: np.ndarray, salt: np.ndarray, tables: int, functions: int) -> tuple[np.ndarray, np.ndarray]:
    """Main keys (rows x tables) and probe keys (rows x tables x functions) of unit vectors. `salt` keeps labels apart."""
    to = power_of_two(x.shape[1])
    mains, probes = [], []
    for t in range(tables):
        top = np.stack([symbols(rotated(x, 1000 * t + f, to), 2) for f in range(functions)], 1).astype(U64)
        seed = mix(salt.view(U64) + U64(t))

        def key(vertex: np.ndarray, seed: np.ndarray = seed) -> np.ndarray:
            out = seed
            for f in range(functions):
                out = mix(out ^ vertex[:, f])
            return out

        mains.append(key(top[:, :, 0]))
        own = []
        for f in range(functions):
            other = top[:, :, 0].copy()
            other[:, f] = top[:, f, 1]
            own.append(key(other))
        probes.append(np.stack(own, 1))
    return np.stack(mains, 1).view(np.int64), np.stack(probes, 1).view(np.int64)


def hashed(classes: DataFrame, tables: int, functions: int) -> DataFrame:
    """rep, copies, embedding, mains (a key per table) and probes (all probe keys, table by table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                for a in range(0, own.num_rows, 4096):
                    part = own.slice(a, 4096)
                    x = matrix(part.column(2))
                    x = x / np.sqrt((x * x).sum(1))[:, None]
                    m, p = bucket_keys(x, part.column(3).to_numpy(), tables, functions)
                    lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(v.ravel())) for v, k in ((m, tables), (p, tables * functions))]
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2).cast(pa.list_(pa.float64())), *lists], ["rep", "copies", "embedding", "mains", "probes"])

    salt = F.xxhash64("label", "dim")
    return classes.select("rep", "copies", "embedding", salt.alias("salt"), "dim").mapInArrow(run, "rep long, copies long, embedding array<double>, mains array<long>, probes array<long>")


def first_meeting(mi: np.ndarray, mj: np.ndarray, pi: np.ndarray, pj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table where two vectors meet, by main keys (pairs x tables) and probe keys (pairs x tables x functions),
    and the key of that meeting; of two such keys, the smaller one."""
    same, of_i, of_j = mi == mj, (mi[:, :, None] == pj).any(2), (mj[:, :, None] == pi).any(2)
    table = (same | of_i | of_j).argmax(1)
    row = np.arange(len(mi))
    a, b = mi[row, table], mj[row, table]
    only_i, only_j = of_i[row, table], of_j[row, table]
    key = np.where(same[row, table] | (only_i & ~only_j), a, np.where(only_i & only_j, np.minimum(a, b), b))
    return table, key


def verified(cells: DataFrame, cosine: float) -> DataFrame:
    """(a, b, linked) from groups (key, low, high) of two blocks of a bucket: of each vector a with links of cosine >=
    `cosine` that first meet in this bucket, the smallest vector b that it reaches by them, and the copies linked."""

    def compare(group: pa.Table) -> pa.Table:
        rep, slot, main, copies = (group[c].to_numpy() for c in ("rep", "slot", "main", "copies"))
        n = len(rep)
        x = matrix(group["embedding"])
        mains = group["mains"].combine_chunks().flatten().to_numpy().reshape(n, -1)
        probes = group["probes"].combine_chunks().flatten().to_numpy().reshape(n, mains.shape[1], -1)
        key, low, high, table = (group[c][0].as_py() for c in ("key", "low", "high", "t"))
        one, two = np.flatnonzero(slot == low), np.flatnonzero(slot == high)
        norm = np.sqrt((x * x).sum(1))
        linked, links = np.zeros(n, np.int64), []
        for a in range(0, len(one), 64):  # bounds the pairs at hand
            own = one[a : a + 64]
            i, j = np.nonzero((x[own] @ x[two].T) >= (cosine - 1e-6) * norm[own][:, None] * norm[two][None])
            i, j = own[i], two[j]
            keep = (main[i] | main[j]).astype(bool) & ((rep[i] < rep[j]) if low == high else (rep[i] != rep[j]))
            i, j = i[keep], j[keep]
            if len(i):
                t, k = first_meeting(mains[i], mains[j], probes[i], probes[j])
                keep = (t == table) & (k == key) & ((x[i] * x[j]).sum(1) / (norm[i] * norm[j]) >= cosine)
                i, j = i[keep], j[keep]
                np.add.at(linked, i, copies[j])
                np.add.at(linked, j, copies[i])
                links.append(np.stack([i, j]))
        i, j = np.concatenate(links, 1) if links else np.zeros((2, 0), np.int64)
        a, b = rooted(rep[i], rep[j])
        of = dict(zip(rep.tolist(), linked.tolist()))
        return pa.table({"a": a, "b": b, "linked": pa.array([of[r] for r in a.tolist()], pa.int64())})

    return cells.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long, linked long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, functions: int = FUNCTIONS) -> DataFrame:
    """One row per vector: vec_id, n_links (others of its label of cosine >= `cosine`), component_id (smallest vec_id
    reachable) and kept (vec_id = component_id).

    A vector that is null, empty, zero or holds null or non-finite numbers, or whose label or vec_id is null, links
    with nothing. Vectors of other lengths are not compared. A repeated row, or another vector of the same vec_id, counts
    as another vector. Labels may be of any type that has a text. Only vec_id, embedding and label are read. An empty table gives no rows."""
    given = of_one_size(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")))
    taking_part = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    able = given.where(taking_part)
    #: The number of a class says nothing but which it is.
    classes = stored(able.groupBy("label", "embedding", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    index = stored(hashed(classes, tables, functions))
    main = index.select("rep", F.posexplode("mains").alias("t", "key"))
    probe = index.select("rep", F.posexplode("probes").alias("t", "key")).withColumn("t", F.floor(F.col("t") / functions).cast("int"))
    entry = main.withColumn("main", F.lit(1)).unionByName(probe.withColumn("main", F.lit(0)))
    shared = entry.groupBy("key").agg(F.count("*").alias("n"), F.max("main").alias("any")).where("n > 1 and any = 1")
    cut = entry.join(shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("slot", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    cells = cut.select("key", "t", "rep", "main", "slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("key", "t", "rep", "main", "slot", F.least("slot", "other").alias("low"), F.greatest("slot", "other").alias("high"))
    found = stored(verified(cells.join(index, "rep"), cosine))
    discard(index)

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("linked").alias("linked"))
    comp = stored(components(found.select("a", "b")))
    top = comp.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("top"))
    top = stored(top)
    named = comp.join(top, "component").select(F.col("node").alias("rep"), "top")
    about = classes.join(links, "rep", "left").join(named, "rep", "left")
    about = stored(about.select("label", "embedding", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "least").alias("component_id")))
    for table in (classes, found, comp, top):
        discard(table)
    out = able.join(about, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    rest = given.where(~taking_part)
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
