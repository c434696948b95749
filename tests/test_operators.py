"""Facts about single operators on literal rows, and streams against their batch forms."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X
from lodestone.operators import code as N
from lodestone.operators import detect as D
from lodestone.operators import graph as G
from lodestone.operators import intent as I
from lodestone.operators import memory as O
from lodestone.operators import validate as V
from lodestone.operators import views as VW
from lodestone.sources import files
from lodestone.sources import model as M
from lodestone.streaming import jobs as S


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "value, expression, want",
    [
        ("aab", X.entropy, 0.9182958340544896),
        ("", X.entropy, 0.0),
        ("https://api.example.com/v1/users?api_key=secret123", lambda c: F.size(V.url_violations(c)), 1),
        ("no url", lambda c: V.url_violations(c)[0]["type"], "invalid_url"),
        ("http://10.0.0.1/x", lambda c: V.url_violations(c)[0]["type"], "concrete_ip"),
        ("Mixed <placeholder> and {placeholder} styles", lambda c: V.consistency(c)["issues"], 1),
        ("This is a test with <placeholder> content", lambda c: V.density_valid(c), True),
        ("test content with /home/user/file.txt", lambda c: V.abstraction_quality(c)["score"], 0.0),
        ('password = "secretpass123"', lambda c: V.code_report(c)["critical"], 1),
        ("plain", lambda c: V.abstraction_quality(c)["score"], 0.7),
        ("10.1.2.3", X.ip_class, "private_ip"),
        ("192.168.0.1", X.ip_class, "local_ip"),
        ("::1", X.ip_class, "localhost_ipv6"),
        ("1.2.3.4", X.masked_ip, "1.2.***.***"),
        ("get_user", X.identifier_class, "<getter_method>"),
        ("MAX_SIZE", X.identifier_class, "<constant>"),
        ("one two three four five six", X.title, "one two three four five..."),
        ("sk_" + "a" * 40, lambda c: V.credential_violations(c)[0]["type"], "credential_pattern"),
        ("why is this query slow?", lambda c: X.first_class(c, X.DOMAINS), "database"),
        ("if a:\n    for b in c:\n        pass", N.cyclomatic, 3),
        ("def f(x):\n  return self.x", N.language, "python"),
        ("a\n\n\n\nb", lambda c: X.compacted(c, "light"), "a\n\nb"),
        ("x" * 50, lambda c: X.truncated(c, 10), "xxxxxxx..."),
    ],
)
def test_facts(spark, value, expression, want):
    got = one(spark, value, expression)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_null_texts_give_no_violations(spark):
    assert one(spark, None, lambda c: F.size(D.violations(c))) == 0
    assert one(spark, None, D.pattern_hits) == 0


def test_mapping_is_unique_and_undone(spark):
    text = "mail a@b.org and c@d.org from 10.0.0.1 at http://x.org/p"
    row = spark.createDataFrame([(text,)], "v string").select(D.mapping(F.col("v")).alias("m"), D.apply(F.col("v"), D.mapping(F.col("v"))).alias("a")).first()
    assert len(set(row["m"].values())) == len(row["m"]) == 4 and "@" not in row["a"] and "10.0" not in row["a"]
    assert one(spark, text, lambda c: D.restored(D.apply(c, D.mapping(c)), D.mapping(c))) == text


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r["x"] for r in df.select(W.cosine(F.col("a"), F.col("b")).alias("x")).collect()] == [pytest.approx(0.96), 0.0]
    assert df.select(W.normalised(F.col("a")).alias("x")).first()["x"] == pytest.approx([0.6, 0.8])
    assert spark.range(1).select(W.decayed(F.lit(0.5), F.lit(60), F.lit(1), F.lit(0.0002), F.lit(0.01), F.lit(30)).alias("x")).first()["x"] == pytest.approx(0.5 * math.exp(-0.0002 * 60 * 1.5))
    assert spark.range(1).select(W.reinforced(F.lit(0.95), F.lit(2.0)).alias("x")).first()["x"] == pytest.approx(1.045)


def test_detection_rules(spark):
    from lodestone.sources import model

    rows = [(1, "AKIA" + "A" * 16), (2, "x" * 10001), (3, "abcdefghijklmnopqrstuvwxyz" * 5), (4, None)]
    got = {(r["id"], r["rule"]) for r in D.detections(spark.createDataFrame(rows, "id long, text string"), model.RULES).collect()}
    assert (2, "repeated_pattern") in got and (3, "repeated_pattern") in got and all(r[0] != 4 for r in got)


def test_graph_walk_components_and_index(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 1, 0.5), (7, 8, 1.0)], "source long, target long, weight double")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 7, 8, 9)], "id long")
    assert {tuple(r) for r in G.walk(edges, nodes.where("id = 1"), 5).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {tuple(r) for r in G.components(edges).select("id", "component").collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert [r["index"] for r in G.dense_index(nodes).orderBy("id").collect()] == list(range(6))
    paths = {tuple(r["path"]) for r in G.sequences(edges, nodes, 5).collect()}
    assert (1, 2, 3) in paths and (1, 2, 3, 1) not in paths


def test_intents(spark):
    df = spark.createDataFrame([(1, "why is my code broken? debug this error"), (2, "zzz")], "id long, q string")
    got = {r["id"]: r for r in I.best_intent(df, "id", "q").collect()}
    assert got[1]["intent"] == "debug" and got[2]["intent"] == "unknown" and got[2]["confidence"] == 0.0
    pairs = spark.createDataFrame([("question", "learn"), ("debug", "plan")], "a string, b string")
    assert [r["x"] for r in pairs.select(I.related(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]
    assert [r["x"] for r in pairs.select(I.in_sequence(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False]


def test_code_corpus(spark):
    df = spark.createDataFrame([("f.py", "def get_a():\n  return b()\ndef b():\n  return 1\nclass C:\n  pass\n")], "file string, text string")
    assert {(r["kind"], r["name"]) for r in N.definitions(df).collect()} == {("function", "get_a"), ("function", "b"), ("class", "C")}
    assert {(r["name"], r["uses"]) for r in N.dependencies(df).collect()} == {("get_a", "b")}


def test_notes_go_out_and_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("n1", "First", "body #tag\nmore", ["a", "b"])], "note string, title string, body string, tags array<string>")
    files.write_notes(rows, f"{tmp_path}/vault")
    back = files.notes(spark, f"{tmp_path}/vault/*/*.txt").first()
    assert back["title"] == "First" and back["tags"] == ["tag"] and "more" in back["body"]
    for form in ("json", "csv", "markdown"):
        files.export(rows, f"{tmp_path}/{form}", form)
    assert spark.read.json(f"{tmp_path}/json").first()["note"] == "n1"


def test_conflicts_are_resolved(spark):
    mine = spark.createDataFrame([("a", "one line here"), ("b", "same")], "note string, text string")
    theirs = spark.createDataFrame([("a", "one line here\nanother longer line"), ("b", "same"), ("c", "x")], "note string, text string")
    got = {r["note"]: r for r in O.resolved(O.conflicts(mine, theirs), "merge").collect()}
    assert got["a"]["conflict"] == "changed" and "another longer line" in got["a"]["resolved"] and got["c"]["conflict"] == "missing_note" and "b" not in got


def test_stream_equals_batch(spark, tmp_path):
    """A hot user and others, rows dealt at random over files and frames of seven rows."""
    rows = [(i, 0 if i % 4 else i % 3, 1e9 + i * 600.0) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.orderBy(F.xxhash64("event_id")).repartition(5).write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    want = {tuple(r) for r in S.admitted_batch(df, 1 / 3600, 2.0).collect()}
    assert {tuple(r) for r in S.drained(S.admitted(stream, 1 / 3600, 2.0)).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 0 < sum(r[2] for r in want) < 120


def test_scan_queue_gives_up_after_three(spark, tmp_path):
    rows = [(1, True, 4), (1, False, 1), (1, False, 3), (1, False, 2), (2, True, 5), (3, False, 6)]  # not in order
    df = spark.createDataFrame(rows, "item long, ok boolean, event_id long").withColumn("ts", F.timestamp_seconds("event_id"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    assert {tuple(r) for r in S.drained(S.scan_queue(stream), "update", ["item"]).collect()} == {(1, "failed", 3), (2, "done", 0), (3, "pending", 1)}


def test_budget_and_audit(spark):
    rows = spark.createDataFrame([("s", 1, 9, 50), ("s", 2, 8, 60), ("s", 3, 7, 10)], "k string, id long, score long, tokens long")
    assert [r["id"] for r in VW.within_budget(rows, ["k"], 115).orderBy("id").collect()] == [1, 2]
    assert {tuple(r) for r in VW.audit(rows, {"score": "score < 9", "tokens": "tokens > 0"}).collect()} == {("score", 1), ("tokens", 0)}


def test_templates_and_sql_functions(spark):
    from lodestone.functions import registered

    df = spark.createDataFrame([("T", ["a", "b"], None)], "t string, tags array<string>, n string")
    text = "# {{t}}{{#if n}} note{{/if}}\n{{#each tags}}- {{this}}\n{{/each}}"
    assert df.select(X.filled(text, {c: F.col(c) for c in df.columns}).alias("x")).first()["x"] == "# T\n- a\n- b\n"
    registered.register(spark)
    assert spark.sql("select placeholder_count('<a> <b1>') a, round(cosine(array(3D, 4D), array(4D, 3D)), 2) b, token_estimate('12345') c").first().asDict() == {"a": 2, "b": 0.96, "c": 2}
    found = spark.sql("""select path, violation from json_leaves('{"a": {"p": "/home/u/x"}, "b": [1]}')""").collect()
    assert {(r["path"], r["violation"]) for r in found} == {("$.a.p", "file_path"), ("$.b[0]", None)}


def test_tables(spark, tmp_path):
    from lodestone.sources import tables

    rows = spark.createDataFrame([(1, 1, [1.0], "2024-01-01"), (2, 1, None, "2024-01-02")], "id long, session_id long, v array<double>, created_at string")
    tables.append(rows.where("id = 1"), f"{tmp_path}/i")
    tables.append_interactions(rows.where("id = 2"), f"{tmp_path}/i", ["v"])
    assert {(r["id"], tuple(r["v"])) for r in spark.read.parquet(f"{tmp_path}/i").collect()} == {(1, (1.0,)), (2, (1.0,))}
    changes = spark.createDataFrame([(2, "2025-01-01")], "id long, created_at string")
    out = tables.changed(rows, changes, rows.where("id = 1").select("id"), "id", ["created_at"]).collect()
    assert [(r["id"], r["created_at"]) for r in out] == [(2, "2025-01-01")]


def test_spans(spark):
    from lodestone.operators import spans as P

    df = spark.createDataFrame([(1, "see http://a.org/x and mail a@b.org, id=42"), (2, None)], "doc_id long, text string")
    got = {(r["type"], r["value"], r["placeholder"]) for r in P.report(df).collect()}
    assert ("url", "http://a.org/x", "<url>") in got and ("identifier", "42", "<numeric_id>") in got and ("user_data", "a@b.org", "<email_address>") in got
    assert one(spark, "get_user_by_id", P.by_rule) == "get_<entity>_by_id" and one(spark, "00:11:22:33:44:55", P.by_rule) == "<mac_address>"
    with pytest.raises(Exception):
        P.checked("bad", "x", "(")


def test_detections_equal_plain_rules(spark):
    import re

    texts = ["10.1.2.3 here", "see localhost:80", "x" * 10_001, "ab" * 60, "AKIA" + "A1" * 8, "", "/home/a/b", "plain words of a text"]
    got = {(r["id"], r["rule"]) for r in D.detections(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), M.RULES).collect()}
    want = set()
    for i, t in enumerate(texts):
        for name, kind, pattern, _, _, threshold in M.RULES:
            if kind == "entropy":
                bits = -sum(t.count(c) / len(t) * np_log2(t.count(c) / len(t)) for c in set(t))
                hit = bits > float(pattern) and min(1, bits / 5) >= threshold
            else:
                hit = bool(re.search(pattern, t)) and (0.95 if kind == "regex" else 0.85) >= threshold
            if hit:
                want.add((i, name))
    assert got == want


def np_log2(x):
    import math

    return math.log2(x)


def test_audit_log_grows_by_changes(spark, tmp_path):
    for n, rows in enumerate([[(1, 1, "a"), (2, 1, "b")], [(1, 2, "a"), (2, 2, "c"), (3, 2, "d")]]):
        spark.createDataFrame(rows, "id long, seq long, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long, seq long, kind string").parquet(f"{tmp_path}/in")
        S.append_changes(stream, f"{tmp_path}/log", "id", ["kind"])
    got = sorted((r["id"], r["kind"], r["operation"], r["changed"], r["batch"]) for r in spark.read.option("basePath", f"{tmp_path}/log").parquet(f"{tmp_path}/log").collect())
    assert got == [(1, "a", "insert", "kind", 0), (2, "b", "insert", "kind", 0), (2, "c", "update", "kind", 1), (3, "d", "insert", "kind", 1)]


def test_lists_and_pages_keep_to_their_limits(spark):
    rows = spark.range(100).selectExpr("cast(id as string) as interaction_id", "'debugging' as interaction_type", "timestamp_seconds(id * 3600) as last_accessed", "id as weight")
    now = F.lit("1970-01-05 00:00:00").cast("timestamp")
    assert VW.listed(rows, now, ["debugging"], 30, 80).count() == 50 and VW.listed(rows, now, ["other"], 30).count() == 0
    with pytest.raises(ValueError):
        VW.sorted_page(rows, "secret", "asc", ["weight"], "interaction_id", 1)
    with pytest.raises(ValueError):
        O.stated(rows, 10)


def test_reference_similarity(spark):
    from lodestone.functions import text as X

    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d = _row(d, i, x, b)
        longer = max(len(a), len(b))
        s, p, q = (longer - d[-1]) / longer if longer else 1.0, a.replace("\\", "/").split("/"), b.replace("\\", "/").split("/")
        return (s + sum(x in q for x in p) / max(len(p), len(q))) / 2

    def _row(d, i, x, b):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
        return new

    pairs = [("src/a/b.py", "src/c/b.py"), ("", ""), ("a", ""), ("C:\\x\\y", "C:\\x\\z\\y"), ("a/a/b", "a/c"), ("same/path", "same/path")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.reference_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r["s"] - plain(r["a"], r["b"])) < 1e-12 for r in rows) and {r["s"] for r in rows if r["a"] == r["b"]} == {1.0}


def test_cognitive_is_the_fold(spark):
    from lodestone.operators import code as N

    def plain(text):
        total = depth = 0
        for line in text.split("\n"):
            line = line.strip()
            if any(p in line.lower() for p in ("if ", "for ", "while ", "function")):
                total += 1 + depth
                depth += "{" in line or ":" in line
            if "}" in line or (line and line[0] not in " \t" and depth > 0):
                depth = max(0, depth - 1)
        return total

    texts = ["", "if x:\n  for y in z:\n    pass\n\nwhile (a) {\n}\n", "FUNCTION f() {\n\n if b {\n}}\nif ", "x\n\tfor i\r\n  else\n", "nothing"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", N.cognitive(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in rows} == {t: plain(t) for t in texts}


def test_suggestions_by_type_and_template(spark):
    texts = ['at /home/ann/x.py and 10.0.0.1', 'p = "/etc/passwd"; Token: "abc"', "https://a.example.org/x?key=1&b=2", "mail a@b.org " + "k" * 40, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    told = lambda kind, templates=(): [r[0] for r in rows.orderBy("id").select(D.suggestion(F.col("t"), kind, templates)).collect()]
    assert told("memory")[0] == "at <file_path> and <ip_address>" and told("general")[0] == texts[0]
    assert told("code")[1] == 'p = "<file_path>"; Token = "<Token_value>"'
    assert told("url")[2] == "<protocol>://<domain>/x?key=<key_value>&b=2"
    assert told("general")[3:] == ["mail <email_address> <secret_token>", None]
    assert told("general", [(1, "two", "three"), (9, "ann", "two")])[0] == "at /home/three/x.py and 10.0.0.1"


def test_features_count_words_row_by_row(spark):
    """c12: no word or text is shuffled; equal texts have equal vectors, texts without words none."""
    rows = [(1, "One two, ONE!"), (2, "one one two"), (3, " ., "), (4, None), (5, "")]
    told = O.features(spark.createDataFrame(rows, "id long, text string"))
    text = told._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and "Aggregate" not in text and "Generate" not in text
    v = {r["id"]: r["vector"] for r in told.collect()}
    slot = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(64)).alias("s")).first()["s"] for w in ("one", "two")}
    assert v[1] == v[2] and len(v[1]) == 64 and v[3] is v[4] is v[5] is None
    assert v[1][slot["one"]] == pytest.approx(2 / math.sqrt(5)) and v[1][slot["two"]] == pytest.approx(1 / math.sqrt(5))


def test_notes_are_written_and_read_by_tasks(spark, tmp_path):
    """s07: a file a note, also of notes that share a name, with no folder of its own and no listing by the driver."""
    rows = spark.range(2500).select(F.floor(F.col("id") / 2).alias("note"), F.concat(F.lit("t"), "id").alias("title"), F.concat(F.lit("body "), "id", F.lit("\nmore #x")).alias("body"), F.array(F.lit("x")).alias("tags")).repartition(2)
    path = f"{tmp_path}/vault"
    written = files.write_notes(rows, path)
    listed = files.notes(spark, f"{path}/*/*.txt").select("title", "tags", "body").collect()
    read = files.notes(spark, path, written)
    assert sorted(read.select("title", "tags", "body").collect()) == sorted(listed) and len({r.title for r in listed}) == 2500
    assert read.where("modified > '2020-01-01' and file like '%note=%'").count() == 2500
    assert len(list((tmp_path / "vault").iterdir())) == 4 and spark.read.format("binaryFile").load(f"{path}/*/*.txt").count() == 2500
