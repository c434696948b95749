"""One test for each fault that a review of the third round found, on literal rows."""

import datetime as dt

from pyspark.sql import functions as F

from lodestone.operators import views as VW
from lodestone.sources import model as M


def moment(day, micros=0):
    return dt.datetime(2024, 1, day) + dt.timedelta(microseconds=micros)


def test_days_count_by_the_microsecond(spark):
    """The first second of a day isn't a whole day before the day after."""
    rows = [(k, "conversation", True, 0.5, moment(29, k), moment(28, k), 6) for k in (0, 1, 999_999, 1_000_000)]
    i = spark.createDataFrame(rows, "interaction_id long, interaction_type string, is_validated boolean, weight double, last_accessed timestamp, created_at timestamp, access_count long")
    got = {r["interaction_id"]: (r["days_since_access"], r["access_rate"]) for r in VW.active(i, M.as_of(), least=0.2).collect()}
    assert got == {0: (2, 2.0), 1: (1, 3.0), 999_999: (1, 3.0), 1_000_000: (1, 3.0)}


def test_decay_counts_whole_days(spark):
    rows = [(k, "conversation", 0.5, moment(29, k), 1) for k in (0, 1, 1_000_000)]
    i = spark.createDataFrame(rows, "interaction_id long, interaction_type string, weight double, last_accessed timestamp, access_count long")
    got = {r["interaction_id"]: r["days"] for r in VW.with_decay(i, M.decay_config(spark), M.as_of()).collect()}
    assert got == {0: 2, 1: 1, 1_000_000: 1}


def test_thresholds_move_as_a_window_mean_does(spark, tmp_path):
    """Two means that differ by exactly the least change: how they are added up decides, and the SQL's window adds plainly."""
    import duckdb

    from lodestone.plans import more
    from lodestone.streaming import jobs as S

    table = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id, ts, user_id, value FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id = 893) TO '{table}'")
    stream = spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{tmp_path}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r["event_id"], round(r["threshold"], 7)) for r in S.drained(S.smoothed_threshold(stream)).collect())
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{table}'")
    assert got == sorted((e, t) for _, e, t in con.execute(more.THRESHOLD).fetchall())


def test_numbered_names_the_values_of_large_texts(spark):
    """The same placeholders as mapping() of one text, though the values come in rows."""
    from lodestone.operators import detect as D

    texts = {k: " ".join(f"https://h{i * k}.example.com/{'a' * (i % 5)} u{i}@example.org" for i in range(30)) for k in (1, 2)}
    whole = spark.createDataFrame(list(texts.items()), "id long, text string")
    want = {(r["id"], k, v) for r in whole.select("id", D.mapping(F.col("text")).alias("m")).collect() for k, v in r["m"].items()}
    parts = spark.createDataFrame([(k, w) for k, t in texts.items() for w in t.split(" ") * 2], "id long, text string").repartition(5)
    values = parts.select("id", F.explode(D.found_values(F.col("text"))).alias("v")).select("id", "v.kind", "v.value")
    assert {(r["id"], r["value"], r["placeholder"]) for r in D.numbered(values, "id").collect()} == want


def test_unique_placeholders_are_of_ten_texts_of_all_pages(spark, tmp_path):
    from lodestone.plans import registry

    spark.createDataFrame([(i, f"https://h{i // 20}.example.com/") for i in range(100)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["conv_id"]: r["numbered"] for r in registry.QUERIES["p02_unique_placeholders"](spark, str(tmp_path)).collect()}
    assert got == {k: 4 for k in range(10)}


def test_cognitive_sql_is_the_fold():
    """The SQL carries the depth from line to line, as the operator does."""
    import duckdb

    from lodestone.plans import registry

    sql = registry.ORACLE["n03_cognitive"]
    assert "list_reduce" in sql and "depth" in sql
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (1, ''), (2, 'if x:\n  for y in z:\n    pass\n\nwhile (a) {\n}\n'), (3, NULL)) t(doc_id, text)")
    assert sorted(con.execute(sql).fetchall()) == [(1, 0), (2, 3), (3, None)]


def test_cognitive_is_the_fold_of_the_reference(spark):
    """Operator and SQL against the plain loop of complexity_analyzer.py:287-307: four openers, depth by braces and colons."""
    import random

    import duckdb

    from lodestone.operators import code as N
    from lodestone.plans import registry

    def plain(text):
        total = depth = 0
        for line in text.split("\n"):
            x = line.strip()
            if any(w in x.lower() for w in ("if ", "for ", "while ", "function")):
                total += 1 + depth
                depth += "{" in x or ":" in x
            if "}" in x or (x and x[0] not in " \t" and depth > 0):
                depth = max(0, depth - 1)
        return total

    rng = random.Random(6)
    parts = ["if ", "IF x:", "for (", "while ", "else if {", "function", "Function f() {", "}", "switch (a) {", "catch", "except:", "elif a:", "if", "\t", "  ", "\r", "\xa0", "notif ", "b;"]
    texts = ["\n".join("".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    want = {k: plain(t) for k, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n"] for r in df.select("doc_id", N.cognitive(F.col("text")).alias("n")).collect()} == want
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert dict(con.execute(registry.ORACLE["n03_cognitive"]).fetchall()) == want and max(want.values()) > 4


def test_all_links_miss_no_pair(spark):
    """Many blocks and no buckets: every pair is met, however far from the others."""
    import numpy as np

    from lodestone.operators import neighbours as N

    x = np.random.default_rng(7).standard_normal((700, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate([*x, *x[:9]])], "vec_id long, prompt_vector array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.4, 1)))}
    rows = df.where("vec_id < 700").select(F.col("vec_id").alias("id"), F.lit(1).cast("long").alias("n"), F.col("prompt_vector").cast("array<double>").alias("v"))
    got = [(r["a"], r["b"]) for r in N.all_links(rows, 0.4, side=60).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counts = {r["vec_id"]: r["n_links"] for r in N.link_counts(*N.alike_classes(df, 0.4, recall=None)).collect()}
    all_ = np.vstack([u, u[:9]])
    assert counts == dict(enumerate(((all_ @ all_.T >= 0.4).sum(1) - 1).tolist()))


def test_mean_linkage_equals_plain_merging(spark):
    """All pairs count, copies too; blocks of a few rows."""
    import numpy as np

    from lodestone.operators import neighbours as N
    from tests.test_neighbours import cosines, frame, groups, merged

    x = groups(np.random.default_rng(4), 20, 8, 12, 0.6)
    x += [x[5]] * 6 + [x[40]] * 3
    want = sorted(sorted(c) for c in merged(1 - cosines(x), 0.4))
    own = {}
    for r in N.mean_linkage(frame(spark, [*enumerate(x), (900, None), (901, [1.0, 2.0])]), 0.4, side=50).collect():
        own.setdefault(r["cluster"], []).append(r["vec_id"])
    assert own.pop(900) == [900] and own.pop(901) == [901]
    assert sorted(sorted(c) for c in own.values()) == want and all(k == min(v) for k, v in own.items()) and len(want) < len(x) / 2


def test_similar_texts_equal_plain_sets(spark):
    """Numbered trigrams are those of the column function; every pair above the least share is found, over several blocks."""
    import random

    from lodestone.functions import text as X
    from lodestone.operators import trigrams as TG

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef9", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(40)]
    texts += [t + rng.choice(["", " x", ", É!", "\nzz"]) for t in texts] + ["", "--", "É"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(999, None)], "id long, text string").repartition(5)
    own = {r["id"]: set(r["g"] or ()) for r in df.select("id", X.trigrams(F.col("text")).alias("g")).collect()}
    assert all(len(TG.codes(t.lower())) == len(own[i]) for i, t in enumerate(texts))
    want = {(i, j): len(a & b) / len(a | b) for i, a in own.items() for j, b in own.items() if j % 3 == 0 and a and b and len(a & b) / len(a | b) > 0.8}
    got = {(r["a"], r["b"]): r["score"] for r in TG.similar_texts(df, df.where("id % 3 = 0"), 0.8).collect()}
    assert got == want and len(want) > 40


def test_detection_needs_no_slow_pattern(spark):
    """Entropy in one pass, and a test of a line that every text with a stretch four times over passes."""
    import re

    from lodestone.functions import text as X

    texts = ["", "aab", "é😀é", "ab" * 40, "x" * 79, "x" * 80, ("abcdefghij" * 2 + "\n") * 9, "z" + "0123456789abcdefghijk" * 4, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("t", X.entropy(F.col("t")).alias("e"), X.may_repeat(F.col("t")).alias("r")).collect()
    got = {r["t"]: (round(r["e"], 9), r["r"]) for r in rows}
    assert got["aab"][0] == 0.918295834 and got["é😀é"][0] == 0.918295834 and got[""] == got[None] == (0.0, False)
    assert all(got[t][1] == bool(re.search(r"(.{20,})\1{3,}", t)) for t in texts if t)


def test_nearest_of_a_group(spark):
    import numpy as np

    from lodestone.operators import neighbours as N

    x = np.random.default_rng(9).standard_normal((60, 5))
    x[7] = x[9] = x[3]
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)] + [(99, None, [1.0] * 5)], "vec_id long, label int, prompt_vector array<double>").repartition(3)
    asked = df.where("vec_id % 3 = 0").select(F.col("vec_id").alias("source_id"), "label", F.col("prompt_vector").alias("vector"))
    got = {}
    for r in sorted(N.compared(df, asked, {"prompt_vector": None}, -2.0, 4, group="label").collect(), key=lambda r: r["rank"]):
        got.setdefault(r["source_id"], []).append(r["vec_id"])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    assert got == {i: sorted((j for j in range(60) if j != i and j % 2 == i % 2), key=lambda j: (-s[i, j], j))[:4] for i in range(0, 60, 3)}
