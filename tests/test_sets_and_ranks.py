"""Set joins, similarity rules and PageRank against plain loops; times and tokens among the spans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import detect as D
from lodestone.operators import graph as G
from lodestone.operators import memory as O
from lodestone.operators import spans as P


@pytest.mark.parametrize("least", [0.3, 0.7, 0.8, 1.0])
def test_set_join_is_exact(spark, least):
    """One item stands in most sets; sizes from none to many; copies."""
    from lodestone.operators.sets import similar_sets

    rng = random.Random(int(least * 10))
    base = [rng.sample(range(60), rng.randint(1, 20)) for _ in range(12)]
    sets = [sorted({*(x for x in rng.choice(base) if rng.random() < 0.9), *rng.sample(range(60), rng.randint(0, 3)), *([99] if rng.random() < 0.8 else [])}) for _ in range(90)] + [[], None, [99], [99]]
    rows = spark.createDataFrame(list(enumerate(sets)), "id long, items array<long>").repartition(4)
    right = rows.where("id % 2 = 0")
    got = {(r["a"], r["b"]): r["score"] for r in similar_sets(rows, right, least).collect()}
    want = {}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if j % 2 == 0 and x and y:
                s = len(set(x) & set(y)) / len(set(x) | set(y))
                if s >= least:
                    want[i, j] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 40
    assert similar_sets(rows.limit(0), right, least).count() == 0


def test_similarity_rules(spark):
    bad = "drop every table of the production database now"
    texts = [bad, bad + "!", bad.upper(), bad.replace("now", "today"), "something else entirely", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rule = ("known_bad", "similarity", bad, "high", "flag", 0.8)
    plan = {(r["id"], r["rule"]): r["confidence"] for r in D.detections(df, [rule]).collect()}
    join = {(r["id"], r["rule"]): r["confidence"] for r in D.similar_to(df, spark.createDataFrame([("known_bad", bad)], "rule string, pattern string")).collect()}
    assert plan == join and {i for i, _ in plan} == {0, 1, 2, 3} and plan[0, "known_bad"] == 1.0 and 0.8 < plan[3, "known_bad"] < 1


def test_text_search_in_parts(spark, monkeypatch):
    rng = random.Random(4)
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    texts = spark.createDataFrame([(i, " ".join(rng.choices(names, k=3))) for i in range(40)], "id long, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(names, k=3))) for i in range(9)] + [(20, ""), (21, None)], "query_id long, query string")
    whole = sorted(map(tuple, O.text_search(texts, asked).collect()))
    monkeypatch.setattr(O, "MOST_CELLS", 40)
    assert sorted(map(tuple, O.text_search(texts, asked, most=4).collect())) == whole and len(whole) > 20
    assert O.text_search(texts, asked.limit(0)).count() == 0


@pytest.mark.parametrize("damping", [0.5, 0.85])
def test_pagerank_equals_power_iteration(spark, damping):
    """A node that most link to, nodes without links, unknown ends, an edge that is there twice, a loop."""
    rng = random.Random(5)
    edges = [(rng.randrange(25), 0 if rng.random() < 0.4 else rng.randrange(30)) for _ in range(90)] + [(3, 3), (7, 8), (7, 8), (1, 500), (500, 1)]
    nodes = spark.createDataFrame([(i,) for i in range(30)] + [(0,), (None,)], "id long")
    got = {r["id"]: r["rank"] for r in G.pagerank(nodes, spark.createDataFrame(edges, "source long, target long"), damping, tolerance=1e-8 if damping > 0.6 else 1e-12).collect()}
    m = np.zeros((30, 30))
    for a, b in edges:
        if a < 30 and b < 30:
            m[b, a] += 1
    out = m.sum(0)
    m = np.where(out > 0, m / np.maximum(out, 1), 1 / 30)
    r = np.full(30, 1 / 30)
    for _ in range(2000):
        r = (1 - damping) / 30 + damping * m @ r
    assert set(got) == set(range(30)) and abs(sum(got.values()) - 1) < 1e-9
    assert max(abs(got[i] - r[i]) for i in range(30)) < (1e-7 if damping > 0.6 else 1e-9)
    assert G.pagerank(nodes.limit(0), spark.createDataFrame([], "source long, target long")).count() == 0


@pytest.mark.parametrize(
    ("text", "kind", "value", "placeholder"),
    [
        ("at 2024-01-02T03:04:05Z sharp", "timestamp", "2024-01-02T03:04:05Z", "<timestamp>"),
        ("created_at=1700000000 ", "timestamp", "1700000000", "<unix_timestamp>"),
        ("api_key = abcdefghij0123456789xyz", "token", "abcdefghij0123456789xyz", "<api_key>"),
        ("see eyJhbGci.eyJzdWIi.abc-_1 ok", "token", "eyJhbGci.eyJzdWIi.abc-_1", "<jwt_token>"),
        ("password: hunter2hunter2", "token", "hunter2hunter2", "<password>"),
        ("pull repo/image:1.2-rc today", "container", "repo/image:1.2-rc", "<container_name>"),
    ],
)
def test_times_tokens_and_images(spark, text, kind, value, placeholder):
    found = P.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (kind, value, placeholder) in {(r["type"], r["value"], r["placeholder"]) for r in found}
