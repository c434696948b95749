"""What keeps work from growing faster than its rows: bounds of what tasks give and of what a step does."""

import time
from collections import OrderedDict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.operators import neighbours as N
from lodestone.operators import trigrams as TG
from lodestone.streaming import jobs as S


@pytest.mark.parametrize("cells", [50, 1 << 20])
def test_best_of_blocks_equals_sorting_all(monkeypatch, cells):
    """Ties, queries that meet few rows, rows that are no candidates, blocks narrower than k; sorted in often and once."""
    monkeypatch.setattr(N, "CELLS", cells)
    rng, n, k = np.random.default_rng(5), 40, 4
    best, met = N._Best(n, k), [[] for _ in range(n)]
    names = rng.permutation(3000)
    for a in (0, 2, 5, 100, 101, 700, 1500):
        own = names[a : a + (2 if a < 100 else 90)]
        at = np.flatnonzero(rng.random(n) < 0.6)
        at = at[at > 0] if a else at[:0]  # query 0 meets nothing, and the first block no query
        score = rng.integers(0, 12, (len(at), len(own))).astype(float)
        score[rng.random(score.shape) < 0.05] = -np.inf
        best.add(at, own, score)
        for i, row in zip(at, score):
            met[i] += [(-s, int(m)) for s, m in zip(row, own) if s > -np.inf]
    query, name, s = best.rows()
    assert [(int(a), -b, int(c)) for a, b, c in zip(query, s, name)] == [(i, *x) for i in range(n) for x in sorted(met[i])[:k]]


def test_tasks_of_an_index_give_k_rows_a_query(spark, tmp_path, monkeypatch):
    """However many files and lists a task reads; copies of few directions, so ties go to the smaller vec_id."""
    rng, k = np.random.default_rng(6), 3
    x = np.zeros((900, 8))
    for row, kind in zip(x, rng.integers(0, 2, 900)):
        row[rng.permutation(8)[: 4 if kind else 1]] = 1 if kind else 2  # all of one length: cosines are exact
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, prompt_vector array<double>")
    path = f"{tmp_path}/index"
    N.build_index(rows.where("vec_id % 3 = 0"), path, lists=5)
    for part in (1, 2):
        N.append_vectors(rows.where(f"vec_id % 3 = {part}"), path)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("source_id"), F.col("prompt_vector").alias("vector"))
    found = sorted((r["source_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in N.nearest_in_lists(spark, path, asked, 5, k).collect())
    s = np.round(x @ x.T / 4, 9)
    want = [(i, r + 1, j, s[i, j]) for i in range(0, 900, 20) for r, j in enumerate(sorted((j for j in range(900) if j != i), key=lambda j: (-s[i, j], j))[:k])]
    assert found == want

    class All:
        def over(self, _):
            return F.lit(1)

    monkeypatch.setattr(N.F, "row_number", All)  # every row that leaves a task has the first place
    given = N.nearest_in_lists(spark, path, asked, 5, k).count()
    tasks = N._index_rows(spark, path).rdd.getNumPartitions()
    files = len(N._index_rows(spark, path).inputFiles())
    assert given <= tasks * k * 45 and files > 2 * tasks


def test_norm_is_worked_out_once_a_vector(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, []), (4, [1.0, None])], "i int, v array<double>")
    told = rows.select("i", W.normalised(F.col("v")).alias("u"))
    assert told._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    assert [r["u"] for r in told.orderBy("i").collect()] == [[0.6, 0.8], [0.0, 0.0], None, [], [1.0, None]]


class Watched(OrderedDict):
    """Entries of a shard that may not be gone through."""

    def __iter__(self):
        raise AssertionError("goes through all entries for one request")


def test_a_request_does_not_go_through_the_cache():
    shard = S.Shard(3, 10.0, [("a", 0.0), ("b", 1.0)])
    shard.entries = Watched(zip("ab", (0.0, 1.0)))
    asked = [("a", 5.0), ("c", 6.0), ("d", 7.0), ("b", 8.0), ("c", 9.0), ("a", 20.0), ("d", 21.0), ("c", 21.0)]
    assert [shard.ask(*x) for x in asked] == [("hit", 0), ("miss", 0), ("miss", 1), ("miss", 1), ("hit", 0), ("miss", 1), ("miss", 1), ("expired", 0)]
    smaller = S.Shard(1, 10.0, [("a", 0.0), ("b", 1.0), ("c", 2.0)])  # state of a cache that was larger
    assert smaller.ask("b", 3.0) == ("hit", 2) and list(smaller.entries.items()) == [("b", 1.0)]


def test_seconds_are_those_of_timestamps():
    rng = np.random.default_rng(7)
    for unit in ("us", "ns"):
        ts = pd.Series(pd.to_datetime(rng.integers(-(10**15), 3 * 10**15, 20_000), unit="us")).astype(f"datetime64[{unit}]")
        assert S.seconds(ts).tolist() == [t.timestamp() for t in ts]
    assert np.isnan(S.seconds(pd.Series([pd.NaT, pd.Timestamp(0)]))).tolist() == [True, False]


def _kinds_of_sets(rng, many):
    """Sets of few kinds, with own items and common ones, of 1 to 90 items and some nearly equal."""
    words = [rng.permutation(300)[:120] for _ in range(3)]
    sets = [rng.permutation(np.concatenate([words[k % 3], rng.integers(300, TG.KINDS, 6)]))[: int(rng.integers(1, 90))] for k in range(many)]
    sets += [np.concatenate([s[: max(1, len(s) - 1)], rng.integers(0, 400, 1)]) for s in sets[::2]]
    return sorted((np.unique(s) for s in sets), key=len)


def _row(sets, s, first):
    parts = {"ids": np.arange(first, first + len(sets)), "ns": np.array([len(x) for x in sets], np.int32), "xs": np.concatenate(sets).astype(np.uint16)}
    return {k + s: v.tobytes() for k, v in parts.items()}


@pytest.mark.parametrize(("share", "dense", "stripe", "least"), [(0.001, 4096, 512, 0.8), (0.05, 9, 16, 0.5), (2.0, 9, 50, 0.8), (0.0, 9999, 33, 0.3)])
def test_alike_blocks_equal_counting_all(monkeypatch, share, dense, stripe, least):
    """Whatever part of the items goes to the matrix product, and where sets of the other side are too small or large."""
    for name, value in (("SHARE", share), ("DENSE", dense), ("STRIPE", stripe)):
        monkeypatch.setattr(TG, name, value)
    rng = np.random.default_rng(9)
    a, b = _kinds_of_sets(rng, 90), _kinds_of_sets(rng, 40) + [np.arange(200)]
    b += [x for x in a[::5]]
    b.sort(key=len)
    x = TG._Side(_row(a, "", 0), "", len(b[0]), len(b[-1]), least)
    y = TG._Side(_row(b, "_2", 1000), "_2", len(a[0]), len(a[-1]), least)
    got = {(int(x.ids[i]), int(y.ids[j])): s for p, q, t in TG._alike(x, y, least) for i, j, s in zip(p, q, t)}
    own = [set(v.tolist()) for v in a], [set(v.tolist()) for v in b]
    want = {(i, 1000 + j): len(v & w) / len(v | w) for i, v in enumerate(own[0]) for j, w in enumerate(own[1]) if len(v & w) / len(v | w) > least}
    assert got == want and len(want) > 30


def test_blocks_of_like_texts_are_bounded(spark, monkeypatch):
    """By sets and by items; a pair of blocks is compared as a whole, not a set at a time."""
    monkeypatch.setattr(TG, "SETS", 7)
    monkeypatch.setattr(TG, "ITEMS", 60)
    rng = np.random.default_rng(2)
    words = ["".join(w) for w in rng.choice(list("abcde"), (40, 4))]
    texts = [" ".join(rng.choice(words, rng.integers(1, 9))) for _ in range(60)]
    texts += [t + " x" for t in texts[:30]] + ["".join(rng.choice(list("abcdefghijkl"), 200))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [set(TG.codes(t).tolist()) for t in texts]
    blocks = TG._packed(TG._sets(df)).collect()
    sizes = [np.frombuffer(r["ns"], np.int32) for r in blocks]
    assert sum(map(len, sizes)) == len(texts) and all(len(n) <= 7 and (n.sum() <= 60 or len(n) == 1) and (np.diff(n) >= 0).all() for n in sizes)
    assert [(r["lo"], r["hi"]) for r in blocks] == [(n[0], n[-1]) for n in sizes]
    want = {(i, j): len(v & w) / len(v | w) for i, v in enumerate(sets) for j, w in enumerate(sets) if j % 4 == 0 and len(v & w) / len(v | w) > 0.8}
    assert {(r["a"], r["b"]): r["score"] for r in TG.similar_texts(df, df.where("id % 4 = 0"), 0.8).collect()} == want
    assert TG.similar_texts(df.where("id < 0"), df, 0.8).count() == TG.similar_texts(df, df.where("text is null"), 0.8).count() == 0


def test_a_pair_of_whole_blocks_takes_no_step_per_pair():
    """Four million pairs of sets of 400 items."""
    rng = np.random.default_rng(1)
    a, b = ([np.flatnonzero(rng.random(1500) < 0.27) for _ in range(TG.SETS)] for _ in range(2))
    a, b = sorted(a, key=len), sorted(b, key=len)
    began = time.process_time()
    x = TG._Side(_row(a, "", 0), "", len(b[0]), len(b[-1]), 0.8)
    y = TG._Side(_row(b, "_2", 0), "_2", len(a[0]), len(a[-1]), 0.8)
    assert not sum(len(i) for i, _, _ in TG._alike(x, y, 0.8)) and time.process_time() - began < 10


@pytest.mark.parametrize("stripe", [7, 256])
def test_nearest_of_blocks_equals_all_in_double(monkeypatch, stripe):
    """Ties, copies, rows nearer to each other than single precision tells apart, and a row that meets itself."""
    monkeypatch.setattr(N, "STRIPE", stripe)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    x[100:180] = x[100] + 1e-6 * rng.standard_normal((80, 16))  # a few as good as equal
    x[200:400] = x[200] + 1e-8 * rng.standard_normal((200, 16))  # many
    x[400:420], x[420:440] = x[0:20], np.sign(x[420:440])  # copies, and equal means of others
    x = N._unit(x) * rng.choice([1.0, 0.7], (600, 1))
    ids = rng.permutation(5000)[:600]
    for least in (0.3, 0.6):
        found = N._Nearest(ids[:300], x[:300], least)
        for part in np.array_split(rng.permutation(600), 4):
            part = part[np.argsort(ids[part])]
            found.add(ids[part], x[part])
        got = {r["a"]: (r["b"], r["mean"]) for r in found.rows().to_pylist()}
        # a product's last bit may depend on how it is summed, so means are compared to 1e-11, and ids where they are the first of all
        mean = np.round(x[:300] @ x.T, 12)
        mean[np.arange(300), np.arange(300)] = -np.inf
        assert set(got) == {int(i) for i, m in zip(ids, mean) if m.max() >= least}
        place = {int(i): k for k, i in enumerate(ids)}
        for i, (a, m) in enumerate(zip(ids, mean)):
            if int(a) in got:
                b, top = got[int(a)]
                assert abs(top - m.max()) < 1e-11 and abs(m[place[b]] - m.max()) < 1e-11
                equal = ids[m >= m.max() - 2e-11]
                assert len(equal) > 1 or b == equal[0]


def test_nearest_takes_the_smallest_id_of_equal_ones():
    x = np.eye(4)[[0, 0, 0, 1, 1, 2]]
    found = N._Nearest(np.array([5, 9, 2, 7, 1, 4]), x, 0.5)
    for part in ([4, 1], [2, 5, 0], [3]):  # by id
        found.add(np.array([5, 9, 2, 7, 1, 4])[part], x[part])
    assert found.rows().to_pylist() == [{"a": a, "b": b, "mean": 1.0} for a, b in ((5, 2), (9, 2), (2, 5), (7, 1), (1, 7))]


def test_tasks_compare_a_block_with_many_others(spark, monkeypatch):
    """So that a cluster's nearest leaves a task once, and not once for each of them."""
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 4)))], "vec_id long, prompt_vector array<double>")
    met, whole = [], N._met

    def pairs(*args, **more):
        out = whole(*args, **more)
        met.append((args[0].count(), out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(N, "_met", pairs)
    N.mean_linkage(rows, 0.2, side=20).count()
    blocks, tasks = met[0]
    assert blocks == 20 and tasks == blocks * N.OTHERS  # not blocks times blocks
