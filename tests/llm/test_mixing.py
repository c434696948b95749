import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import mixing

from . import data


def filled(levels, leaves, weights, total, epochs):
    """Budgets by filling one node after the other, shortage by shortage."""

    def split(budget, nodes, depth):
        out, open_ = {}, {k: (w, c) for k, (w, c) in nodes.items() if w > 0}
        while open_:
            heavy = sum(w for w, _ in open_.values())
            full = {k: c for k, (w, c) in open_.items() if c * heavy <= w * budget}
            if not full:
                return out | {k: w * budget // heavy for k, (w, _) in open_.items()}
            k = min(full, key=lambda x: (open_[x][1] / open_[x][0], x))
            out[k] = full[k]
            budget -= full[k]
            del open_[k]
        return out

    def go(prefix, budget, depth):
        if depth == len(levels):
            return {prefix: budget}
        own = weights[levels[depth]]
        names = {k[depth] for k in leaves if k[:depth] == prefix}
        nodes = {n: (own.get(n, own.get("", 0)), sum(v * epochs for k, v in leaves.items() if k[: depth + 1] == (*prefix, n))) for n in names}
        out = {}
        for n, b in split(budget, nodes, depth).items():
            out |= go((*prefix, n), b, depth + 1)
        return out

    return go((), total, 0)


def rows(n=400):
    return [(i, " ".join(["w"] * (i % 7 * 5 + (i % 3 == 0) * 40)), ["en", "de", "fr", None][i % 4], f"src{i % 5}" if i % 11 else None, 0) for i in range(n)]


def test_budgets_equal_stepwise_filling(spark):
    docs = spark.createDataFrame(rows(), data.DOCUMENTS)
    told = mixing.with_leaf(docs.select("doc_id", "lang", "source", mixing.words(F.col("text")).alias("tokens")))
    leaves = {tuple(r)[:3]: r["n"] for r in told.groupBy(*mixing.LEVELS).agg(F.sum("tokens").alias("n")).where("n > 0").collect()}
    for part in (1, 3, 5):
        got = {tuple(r)[:3]: r["budget"] for r in mixing.plan(told, total=F.col("tokens") * part).select(*mixing.LEVELS, "budget").collect()}
        want = filled(list(mixing.LEVELS), leaves, mixing.WEIGHTS, sum(leaves.values()) * part, mixing.MAX_EPOCHS)
        assert all(abs(got[k] - want[k]) <= 2 for k in leaves), (part, got, want)
        assert sum(got.values()) <= sum(leaves.values()) * part


def test_rows_equal_sql(spark):
    docs = spark.createDataFrame(rows(), data.DOCUMENTS)
    got = sorted(map(tuple, mixing.mixed(docs).select("doc_id", *mixing.LEVELS, "tokens", "copies").collect()))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows()], "text": [r[1] for r in rows()], "lang": [r[2] for r in rows()], "source": [r[3] for r in rows()]}))
    want = sorted(con.execute(f"SELECT doc_id, domain, lang, source, tokens, copies FROM ({mixing.oracle()})").fetchall())
    assert got == want


def test_odd_rows(spark):
    """Null, empty and very long texts, null and repeated doc_ids, ties: as the SQL says."""
    docs = data.odd_documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    same = docs.select("doc_id", "text", "lang", "source").unionByName(docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "'src7' as source"))
    got = mixing.mixed(same).select("doc_id", *mixing.LEVELS, "tokens", "copies").collect()
    rows_ = same.collect()
    con = duckdb.connect()
    con.register("documents", pa.table({c: pa.array([r[c] for r in rows_], pa.int64() if c == "doc_id" else pa.string()) for c in same.columns}))
    want = con.execute(f"SELECT doc_id, domain, lang, source, tokens, copies FROM ({mixing.oracle()})").fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))
    assert order(got) == order(want)
    empty = docs.where("doc_id = -1")
    assert mixing.mixed(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
