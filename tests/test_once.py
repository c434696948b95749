"""Dear steps on texts are taken once a row, and cheaper patterns find the same."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import detect as D
from lodestone.operators import spans as P
from lodestone.operators import validate as V
from lodestone.plans import registry
from lodestone.streaming import jobs as S

FOLDER = "/root/testdata/sf0.001"
EMAIL, CONNECTION, TOKEN = "@[a-zA-Z0-9.-]+", "(postgresql|mysql|mongodb)", "{32,}"
PIECES = ["", "a", "Z9", "_", "-", ".", "@", "/", ":", "://", ":\\", "C:\\x", "http", "https://a.io", "id=7", "user_id: 5", "1.2.3.4", "10.0.0", "x_container-y", "CONTAINER", "sk_" + "a" * 24, "PK_" + "b" * 23, "é", " ", "\n", "me@b.co", "@b.co", "a@b.co_x@c.com", "key='v'", 'Token = "t"', "=''", "/home/me/x.py", "k" * 33]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choices(PIECES, k=r.randint(0, 7)))) for i in range(3000)] + [(-1, None), (-2, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()


def test_cheaper_patterns_find_the_same(texts):
    plain = sum((F.coalesce(F.col("text").rlike("(?i)" + p), F.lit(False)).cast("int") for p in D.COUNTED), F.lit(0))
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(n)) for _, n, _, p in D.CONCRETE]))
    replaced = F.col("text")
    for _, p, name in D.REPLACED:
        replaced = F.regexp_replace(replaced, p, name)
    both = texts.select(D.pattern_hits(F.col("text")).alias("a"), plain.alias("b"), D.violations(F.col("text"))["pattern"].alias("c"), kinds.alias("d"), D.abstracted(F.col("text")).alias("e"), replaced.alias("f"))
    rows = both.collect()
    assert all(r.a == r.b and r.c == r.d and r.e == r.f for r in rows)
    assert {r.a for r in rows} >= {0, 1, 2, 3}


def test_a_replacement_may_bring_an_address(spark):
    row = spark.createDataFrame([("name",)], "text string").select(D.replaced(F.col("text"), [("name", "a@b.co"), *D.EVERY]).alias("t")).first()
    assert row.t == "<email_address>"


def test_named_values(texts):
    """Numbers follow length and then name; the map has the same placeholders."""
    for t, named, pairs in texts.where("text is not null").select("text", D.named_values(F.col("text")), D.mapping(F.col("text"))).collect():
        assert {s.value: s.placeholder for s in named} == pairs
        found = {(k, m.group(0)) for k, p, _ in D.REPLACED for m in re.finditer(p, t)}
        assert {s.kind for s in named} == {k for k, _ in found}
        for kind in {s.kind for s in named}:
            own = sorted((s.value for s in named if s.kind == kind), key=lambda v: (len(v), v), reverse=True)
            assert [pairs[v] for v in own] == [f"<{kind}>", *[f"<{kind}_{i}>" for i in range(1, len(own))]]


def test_streamed_scores_find_references_once(texts):
    """t01 and t02: neither the score, its parts nor a condition on it tries the patterns again."""
    told = S.scored(texts).where("score < 0.8").select("doc_id", "score", "refs")
    assert plan(told).count(CONNECTION) == 1
    q = texts.select("doc_id", V.abstraction_quality(F.col("text")).alias("q")).select("doc_id", "q.score", F.col("q.violation_count").alias("refs")).where("score < 0.8")
    assert sorted(told.collect()) == sorted(q.collect())


@pytest.mark.parametrize("name, sign", [("v22_reference_rows", TOKEN), ("v17_overall_quality", CONNECTION), ("m05_quarantine", CONNECTION)])
def test_patterns_stand_once_in_a_plan(spark, name, sign):
    assert plan(registry.QUERIES[name](spark, FOLDER)).count(sign) == 1


@pytest.mark.parametrize("name", ["v13_quality_parts", "f18_attention", "f15_visible", "d09_suggestions"])
def test_texts_are_read_once(spark, name):
    """What several parts read, or a sort samples, is a small table by then: the plan reads texts once, or not at all."""
    told = plan(registry.QUERIES[name](spark, FOLDER))
    read = [x for x in told.splitlines() if "Relation [doc_id" in x and "text" in x]
    assert len(read) <= 1 and told.count(CONNECTION) == 0
    assert name == "d09_suggestions" or told.count(TOKEN) == 0


def test_member_texts_move_lengths(spark):
    """j20: texts are abstracted below the join, whose rows are numbers."""
    lines = plan(registry.QUERIES["j20_member_texts"](spark, FOLDER)).splitlines()
    assert min(i for i, x in enumerate(lines) if "Join" in x) < min(i for i, x in enumerate(lines) if "inline" in x)


def test_spans_need_what_they_are_said_to_need():
    """d02: no text is passed over that a pattern matches, and few patterns are tried on plain prose."""
    r = random.Random(4)
    more = ["host = db1", "order_id='12'", "where ID = 4", "file:///x/y", "~/x", "./a", "2024-01-02T03:04:05Z", "1:2:3:4:5:6:7:8", "--name=web", "eyJa.eyJb.c", "img/x:latest", "API_KEY=" + "a" * 20, "password: hunter222", "localhost:80", "a" * 12, "12345678-1234-1234-1234-123456789abc", "D:\\dir\\f", "expires=1234567890", "redis://h", "255.1.0.9"]
    texts = ["".join(r.choices([*PIECES, *more], k=r.randint(1, 6))) for _ in range(4000)]
    hits = {row[0]: 0 for row in P.PATTERNS}
    for name, _, _, p, needed, hint in P.compiled(P.PATTERNS):
        for t in texts:
            if p.search(t):
                hits[name] += 1
                assert P.may_match(t, needed, hint), (name, t)
    assert min(hits.values()) > 0, hits
    prose = "Plain words, as they come: some are long. Others aren't; 3.5 of them count.\n"
    assert sum(P.may_match(prose, *row[4:]) for row in P.compiled(P.PATTERNS)) < 10
    assert P.may_match("x", *P.compiled((("ipv4", "mine", 0.5, "x"),))[0][4:])
