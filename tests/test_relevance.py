"""Relevance to a context and choice under a budget, on literal rows and against a plain loop."""

import random

from pyspark.sql import functions as F

from lodestone.operators import relevance as R

CONTEXT = R.Context("/src/app/Main.py", ["/lib/util.ts", "/docs/a/b/guide.md"], ["load", "save"], "feature-x")
SCHEMA = "id long, text string, days double, accesses long, stage string"


def test_references(spark):
    text = "see <project>/src/One.py and [Label](x/y.md), import './Two' then <a href='/Three'> <img src=\"four.png\">"
    row = spark.range(1).select(R.file_references(F.lit(text)).alias("r"), R.file_references(F.lit(None).cast("string")).alias("none")).first()
    assert list(row) == [["src/one.py", "label", "./two", "/three", "four.png"], []]


def test_parts_and_boosts(spark):
    rows = [
        (1, "<project>/main.py load", 30.0, 0, "draft"),  # part of no path, but holds its last part: 0.4; one of two symbols: 0.1
        (2, "[x](y) href='/docs/a/zzz' feature-x", 0.5, 11, "active"),  # two of three parts are shared: half of 0.3; branch 0.1
        (3, None, None, None, None),
        (4, "href='/src/app' save load", 6.9, 6, "archived"),  # part of the path: 0.4; both symbols: 0.2
        (5, "", 1.0, 5, "active"),
    ]
    got = {r["id"]: (r["score"], r["tokens"]) for r in R.scored(spark.createDataFrame(rows, SCHEMA), CONTEXT).collect()}
    assert got == {1: (0.5, 6), 2: (round(0.25 * 1.5 * 1.3 * 1.2, 8), 9), 3: (0.0, 0), 4: (round(0.6 * 1.2 * 1.1 * 0.5, 8), 7), 5: (0.0, 0)}


def test_without_a_context(spark):
    rows = [(1, "href='a' b", 0.0, 99, "active")]
    assert R.scored(spark.createDataFrame(rows, SCHEMA), R.Context()).first()["score"] == 0.0


def test_choice_is_the_plain_loop(spark):
    rng = random.Random(5)
    rows = [(i, "load " * rng.choice([1, 3, 20, 60]) + rng.choice(["save", "", "feature-x"]), rng.choice([0.5, 3.0, 9.0]), rng.randrange(14), rng.choice(["active", "archived", "x"])) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for budget, most in ((60, 5), (90, 50), (0, 5)):
        plain, used = [], 0
        for r in sorted(R.scored(docs, CONTEXT).collect(), key=lambda r: (-r["score"], r["id"])):
            if len(plain) < most and used + r["tokens"] <= budget:
                used += r["tokens"]
                plain.append((r["id"], used))
        got = R.most_relevant(docs, CONTEXT, budget, most).select("id", "used").collect()
        assert sorted(map(tuple, got)) == sorted(plain)
    assert R.most_relevant(docs.limit(0), CONTEXT, 60).count() == 0
