import numpy as np
from pyspark.sql import types as T

from lodestone.llm import ann, embed_dedup

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def made(n=300, dim=64, seed=0):
    """Vectors in groups of near and exact copies, with odd ones among them."""
    r = np.random.default_rng(seed)
    rows, i = [], 0
    while i < n:
        base = r.normal(size=dim)
        for _ in range(r.integers(1, 9)):
            v = base + r.normal(size=dim) * r.choice([0.0, 0.02, 0.1, 0.2])
            rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 3 == 0)))
            i += 1
    odd = [None, [0.0] * dim, [float("nan")] * dim, [None] * dim, [], [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0]]
    return rows + [(10_000 + k, v, 1) for k, v in enumerate(odd)] + [(20_000, rows[0][1], None)]


def good(v, dim=64):
    return v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_links_equal_brute_force(spark):
    rows = made()
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    able = [r for r in rows if good(r[1]) and r[2] is not None]
    x = np.array([r[1] for r in able], float)
    c = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (c >= 0.98) & (np.array([r[2] for r in able])[:, None] == np.array([r[2] for r in able])[None])
    np.fill_diagonal(link, False)
    part = np.arange(len(able))
    for _ in range(len(able)):
        new = np.minimum(part, np.where(link, part[None], len(able)).min(1))
        if (new == part).all():
            break
        part = new
    for k, r in enumerate(able):
        assert out[r[0]][:2] == (link[k].sum(), able[part[k]][0])
    for r in rows:
        if not good(r[1]) or r[2] is None:
            assert out[r[0]] == (0, r[0], True)
    assert len(out) == len(rows)


def test_nearest_reach_recall_and_order(spark):
    rows = made(700, seed=5)
    scale = np.random.default_rng(1).uniform(0.5, 2, len(rows))
    rows = [(i, [float(np.float32(x * s)) for x in v] if good(v) else v, y) for (i, v, y), s in zip(rows, scale)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), lambda c: c % 20 == 0, least=150).collect()
    able = [r for r in rows if good(r[1])]
    x, ids = np.array([r[1] for r in able], float), np.array([r[0] for r in able])
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        want = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:20]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == ids[q])
        assert [o[0] for o in own] == list(range(1, 21))
        assert all(own[k][2] > own[k + 1][2] - 1e-12 for k in range(19))
        assert all(abs(o[2] - x[list(ids).index(o[1])] @ x[q]) < 1e-9 for o in own)
        hit, total = hit + len(set(want) & {o[1] for o in own}), total + 20
    assert hit / total >= 0.9


def test_copies_and_small_tables(spark):
    v = [1.0] + [0.5] * 7
    rows = [(i, v, 1) for i in range(45)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), lambda c: c % 20 == 0).collect()
    assert {r["query_id"]: [x["vec_id"] for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == r["query_id"]] for r in got} == {q: [i for i in range(22) if i != q][:20] for q in (0, 20, 40)}
    few = ann.nearest(spark.createDataFrame(rows[:3], SCHEMA), lambda c: c % 20 == 0).collect()
    assert len(few) == 2
    none = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(none, lambda c: c % 20 == 0).count() == 0 and embed_dedup.near_vectors(none).count() == 0


def recall(spark, x, sample=None, **more):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x.astype(np.float32))]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), lambda c: c % 20 == 0, **more).collect()
    x, own = x.astype(np.float32).astype(float), {}
    for r in got:
        own.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = []
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(own[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    return float(np.mean(hit))


def test_recall_with_production_parameters(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(5000, 64))
    assert recall(spark, x * np.exp(r.normal(size=5000) * 0.4)[:, None]) >= 0.9


def test_clustered_vectors_need_few_candidates(spark, monkeypatch):
    r = np.random.default_rng(9)
    centres = r.normal(size=(250, 64))
    x = np.repeat(centres, 40, 0) + r.normal(size=(10_000, 64)) * 0.15
    x /= np.linalg.norm(x, axis=1)[:, None]
    shares, plain = [], ann.fitted_share
    monkeypatch.setattr(ann, "fitted_share", lambda *a: shares.append(plain(*a)) or shares[-1])
    assert recall(spark, x, least=500) >= 0.9 and shares[0] <= 0.05


def test_repeated_ids_labels_of_text_and_clashing_columns(spark):
    v, w = [1.0] + [0.25] * 7, [0.25] * 7 + [1.0]
    rows = [(1, v, "a"), (1, w, "a"), (2, v, "a"), (3, v, "b"), (4, w, "a"), (5, v, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    for c in ("rep", "copies", "key", "t", "slot", "part", "n", "tree", "level", "prefix", "query", "score", "component", "linked"):
        df = df.selectExpr("*", f"'x' AS {c}")
    out = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embed_dedup.near_vectors(df).collect())
    assert out == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 1, 1), (5, 0, 5)]
    near = ann.nearest(df, lambda c: c == 2, k=3).collect()
    assert [(r["vec_id"]) for r in sorted(near, key=lambda r: r["rank"])][:2] == [3, 5]


def test_ties_between_different_vectors(spark):
    e = np.eye(8) * 2
    rows = [(100 - i, [float(c) for c in (e[i % 8] + e[0])], 0) for i in range(1, 8)] + [(0, [float(c) for c in e[0]], 0)]
    near = ann.nearest(spark.createDataFrame(rows, SCHEMA), lambda c: c == 0, k=4).collect()
    assert [(r["vec_id"]) for r in sorted(near, key=lambda r: r["rank"])] == [93, 94, 95, 96]
