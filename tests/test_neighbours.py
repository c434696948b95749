"""Vectors over whole tables against all pairs, plain merging, and brute-force search."""

import math
import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import neighbours as N

SF = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, prompt_vector array<float>"


def frame(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(y) for y in v]) for i, v in x], SCHEMA).repartition(4)


def groups(rng, n, size, dim, noise):
    out = []
    for _ in range(n):
        c = rng.standard_normal(dim)
        out += [c + noise * rng.standard_normal(dim) for _ in range(size)]
    return out


def cosines(x):
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    return u @ u.T


def merged(d: np.ndarray, stop: float) -> list[list[int]]:
    """Members of the clusters of a distance matrix by average linkage."""
    n = len(d)
    size, own = np.ones(n), [[i] for i in range(n)]
    np.fill_diagonal(d, np.inf)
    while n:
        i, j = np.unravel_index(d.argmin(), d.shape)
        if not d[i, j] <= stop:
            break
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = row, row
        d[i, i] = d[j] = d[:, j] = np.inf
        size[i], own[i], own[j] = size[i] + size[j], own[i] + own[j], []
    return [c for c in own if c]


def test_all_pairs_in_one_bucket(spark):
    """Copies, odd vectors and another length; nothing is missed while one bucket holds all, dealt in blocks or not."""
    rng = np.random.default_rng(1)
    x = groups(rng, 12, 6, 8, 0.5)
    x += [x[3]] * 7
    rows = list(enumerate(x)) + [(900, None), (901, []), (902, [0.0] * 8), (903, [math.nan] + [1.0] * 7), (904, [1.0, 2.0]), (905, [2.0, 4.0]), (906, [math.inf] + [1.0] * 7)]
    s = cosines(x)
    near = {(i, j) for i, j in zip(*np.nonzero(np.triu(s >= 0.7, 1)))}
    for block in (1000, 10):
        members, links = N.alike_classes(frame(spark, rows), 0.7, block=block)
        cls = {r["vec_id"]: r["class_id"] for r in members.collect()}
        assert set(cls) == {i for i, _ in rows} and all(cls[k] == 3 for k in range(72, 79)) and cls[900] == 900
        got = {(r["a"], r["b"]): r for r in links.collect()}
        assert {(904, 905)} | {tuple(sorted((cls[i], cls[j]))) for i, j in near if cls[i] != cls[j]} == set(got)
        assert all(abs(r["similarity"] - s[a, b]) < 1e-9 for (a, b), r in got.items() if b < 900)
        counts = {r["vec_id"]: r["n_links"] for r in N.link_counts(members, links).collect()}
        want = (s >= 0.7).sum(1) - 1
        assert all(counts[k] == want[k] for k in range(len(x))) and counts[900] == 0 and counts[904] == 1


@pytest.mark.parametrize("bucket", [16, 64])
def test_recall_of_buckets(spark, bucket):
    rng = np.random.default_rng(2)
    x = groups(rng, 100, 6, 32, 0.55)
    near = {(i, j) for i, j in zip(*np.nonzero(np.triu(cosines(x) >= 0.7, 1)))}
    _, links = N.alike_classes(frame(spark, enumerate(x)), 0.7, bucket=bucket)
    got = {(r["a"], r["b"]) for r in links.collect()}
    assert got <= near and len(got) >= 0.9 * len(near) > 300


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_on_given_vectors(spark):
    LEAST = 0.4  # no pair of these reaches 0.7
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", F.col("embedding").alias("prompt_vector"))
    rows = v.orderBy("vec_id").collect()
    ids, s = np.array([r["vec_id"] for r in rows]), cosines([r["prompt_vector"] for r in rows])
    want = dict(zip(ids.tolist(), ((s >= LEAST).sum(1) - 1).tolist()))
    got = {r["vec_id"]: r["n_links"] for r in N.link_counts(*N.alike_classes(v, LEAST, bucket=128)).collect()}
    assert set(got) == set(want) and all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


def test_stored_index(spark, tmp_path):
    """Build, append, search, refresh; recall by brute force; only probed partitions are read."""
    rng = np.random.default_rng(3)
    x = groups(rng, 60, 20, 16, 0.6)
    path, rows = f"{tmp_path}/index", frame(spark, enumerate(x))
    N.build_index(rows.where("vec_id < 900"), path, lists=20)
    N.append_vectors(rows.where("vec_id >= 900"), path)
    probes = N.fitted_probes(spark, path, k=10, recall=0.95)
    assert 1 <= probes < 20 and spark.read.parquet(f"{path}/probes").first()["probes"] == probes
    asked = rows.where("vec_id % 7 = 0").select(F.col("vec_id").alias("source_id"), F.col("prompt_vector").alias("vector"))
    s = cosines(x)
    np.fill_diagonal(s, -np.inf)

    def recall(found):
        hits = sum(r["vec_id"] in set(np.argsort(-s[r["source_id"]])[:10].tolist()) for r in found)
        return hits / (10 * len({r["source_id"] for r in found}))

    found = N.nearest_in_lists(spark, path, asked, probes).collect()
    assert len({r["source_id"] for r in found}) == asked.count() and recall(found) >= 0.9
    assert all(abs(r["score"] - s[r["source_id"], r["vec_id"]]) < 1e-6 for r in found)
    whole = N.nearest_in_lists(spark, path, asked, 20, most=50).collect()
    assert recall(whole) == 1 and sorted((r["source_id"], r["rank"]) for r in whole) == [(i, k) for i in range(0, 1200, 7) for k in range(1, 11)]
    one = asked.where("source_id = 14")
    plan = N.nearest_in_lists(spark, path, one, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1].split("]")[0]
    moved = N.refreshed_centres(spark, path).collect()
    assert len(moved) == 20 and sum(r["n"] for r in moved) == 1200 and max(r["moved"] for r in moved) > 0
    N.rebuilt_index(spark, path, f"{tmp_path}/again")
    assert recall(N.nearest_in_lists(spark, f"{tmp_path}/again", asked, probes).collect()) >= 0.9
    with pytest.raises(ValueError, match="no vector"):
        N.build_index(rows.where("vec_id < 0"), f"{tmp_path}/none")


def test_average_linkage_equals_plain_merging(spark):
    """Loose groups, where the order of merges matters."""
    rng = np.random.default_rng(4)
    x = groups(rng, 25, 12, 12, 0.6)
    s = cosines(x)
    d = np.where(s >= 0.3, 1 - s, 1.0)
    np.fill_diagonal(d, 0)
    want = sorted(sorted(c) for c in merged(d, 0.3))
    placed = N.average_linkage(frame(spark, enumerate(x)), 0.3, floor=0.3).collect()
    own = {}
    for r in placed:
        own.setdefault(r["cluster"], []).append(r["vec_id"])
    assert sorted(sorted(c) for c in own.values()) == want and all(k == min(v) for k, v in own.items())
    assert len(want) < len(x)


def test_clusters_of_copies_and_single_vectors(spark):
    rows = [(k, [1.0, 0.0]) for k in range(5)] + [(9, [0.0, 1.0]), (10, None)]
    got = {r["vec_id"]: r["cluster"] for r in N.average_linkage(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 9: 9, 10: 10}
    assert N.average_linkage(frame(spark, [])).count() == 0


def test_stated_queries_in_parts(spark):
    """Queries in many parts give what one part gives, and what plain cosines give; odd rows have no score."""
    rng = np.random.default_rng(5)
    x, y = rng.standard_normal((80, 6)), rng.standard_normal((80, 6))
    rows = [(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y))] + [(100, None, y[0].tolist()), (101, [0.0] * 6, None), (102, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, prompt_vector array<double>, response_vector array<double>").repartition(3)
    asked = df.where("vec_id % 3 = 0 and vec_id < 80").select(F.col("vec_id").alias("source_id"), F.col("prompt_vector").alias("vector"))
    q, p, r = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, x, y))
    cp, cr = q @ p.T, q @ r.T
    for columns, score in (({"prompt_vector": None, "response_vector": None}, np.maximum(cp, cr)), ({"prompt_vector": 0.3, "response_vector": 0.7}, 0.3 * cp + 0.7 * cr)):
        want = {(i, j) for i in range(0, 80, 3) for j in range(80) if i != j and score[i, j] >= 0.2}
        for most in (1000, 4):
            found = {(a.source_id, a.vec_id): a.score for a in N.compared(df, asked, columns, 0.2, most=most).collect()}
            assert {k for k in found if k[1] < 80} == want and all(abs(found[k] - score[k]) < 1e-9 for k in want)
            top = N.compared(df.where("vec_id < 80"), asked, columns, 0.2, 3, most=most).collect()
            for i in range(0, 80, 3):
                best = sorted((-score[i, j], j) for a, j in want if a == i)[:3]
                assert [a.vec_id for a in sorted(top, key=lambda a: a.rank) if a.source_id == i] == [j for _, j in best]
    centres = spark.createDataFrame([(k, y[k].tolist()) for k in range(9)], "label int, centroid array<double>")
    for most in (100, 2):
        near = N.nearest_centres(df, centres, 2, most=most).collect()
        assert len(near) == 160 and {a.vec_id: a.cluster for a in near if a["rank"] == 1} == dict(enumerate((p @ r[:9].T).argmax(1).tolist()))
    assert N.compared(df, asked.where("source_id < 0"), {"prompt_vector": None}, 0.1).count() == 0


def test_scores_are_held_in_blocks():
    """i05: a task's memory doesn't grow with the queries, and blocks of these find what one product finds."""
    r = np.random.default_rng(5)
    q, x = (N._unit(r.standard_normal((n, 8))) for n in (20_000, 1100))
    batch = pa.record_batch([pa.array(np.arange(len(x))), pa.array(x.tolist()), pa.array((-x).tolist())], names=["vec_id", "a", "b"])
    tracemalloc.start()
    parts = list(N._matches(batch, np.arange(len(q)), q, None, [0.3, 0.7], 0.39, None))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
    score = -0.4 * q @ x.T
    score[np.arange(len(x)), np.arange(len(x))] = -1
    assert {(i, j) for p in parts for i, j in zip(p["source_id"].to_pylist(), p["vec_id"].to_pylist())} == set(zip(*(c.tolist() for c in np.nonzero(score >= 0.39))))
    assert max(p.num_rows for p in N._matches(batch, np.arange(len(q)), q, None, [None], -2.0, 3)) == 3 * N.CELLS // 1024
