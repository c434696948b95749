"""Places, ranks and greedy choice against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lodestone.operators import order as R
from lodestone.operators import views as V

SCHEMA = "source string, id long, score long, tokens long"


def rows(rng, n=400):
    """One source has most rows, one is null, one has a row; ties in score; sizes of all kinds."""
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", None])
        out.append((source, i, rng.randrange(9), rng.choice([0, 1, 2, 5, 30, 90, 200, 500, 999, 1001, None])))
    return [*out, ("single", n, 1, 3)]


def by_source(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def test_places_and_sums(spark):
    data = rows(random.Random(1))
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = R.placed(df, ["source"], [F.desc("score"), F.asc("id")], "tokens").collect()
    want = {}
    for own in by_source(data).values():
        total = 0
        for k, r in enumerate(sorted(own, key=lambda r: (-r[2], r[1]))):
            want[r[1]] = (k, total)
            total += r[3] or 0
    assert {r["id"]: (r["place"], r["before"]) for r in got} == want
    assert R.placed(df.limit(0), ["source"], ["id"]).count() == 0


@pytest.mark.parametrize("most", [None, 7])
def test_greedy_equals_a_plain_loop(spark, most):
    data = rows(random.Random(2))
    got = V.within_budget(spark.createDataFrame(data, SCHEMA).repartition(5), ["source"], 1000, most).collect()
    want = {}
    for own in by_source(data).values():
        used = n = 0
        for r in sorted(own, key=lambda r: (-r[2], r[1])):
            if r[3] is not None and used + r[3] <= 1000 and (most is None or n < most):
                used, n = used + r[3], n + 1
                want[r[1]] = used
    assert {r["id"]: r["used"] for r in got} == want and len(want) > 20


def test_greedy_takes_what_fits_after_what_does_not(spark):
    df = spark.createDataFrame([("s", 1, 9, 6), ("s", 2, 8, 7), ("s", 3, 7, 3), ("s", 4, 6, 2), ("s", 5, 5, 1), ("s", 6, 4, 0)], SCHEMA)
    assert sorted(r["id"] for r in V.within_budget(df, ["source"], 10).collect()) == [1, 3, 5, 6]
    assert V.within_budget(df.where("tokens > 90"), ["source"], 10).count() == 0


def test_exact_ranks(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.7 else rng.choice(["a", None]), i, rng.choice([rng.random(), 1.0, None])) for i in range(300)] + [("one", 900, 4.0)]
    got = {r["k"]: r for r in V.current_metrics(spark.createDataFrame(data, "k string, event_id long, value double").repartition(5), ["k"]).collect()}
    for key, own in by_source(data).items():
        v = sorted(r[2] for r in own if r[2] is not None)
        n = len(v)
        r = got[key]
        assert (r["p95"], r["p99"]) == (v[min(n - 1, int(n * 0.95))], v[min(n - 1, int(n * 0.99))]) and abs(r["median"] - statistics.median(v)) < 1e-12
        assert r["n"] == len(own) and abs(r["mean"] - statistics.mean(v)) < 1e-12
