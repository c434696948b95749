import os
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import collocations, entry

from . import data

SF = "/root/testdata/sf0.01"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, subsumed=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    able = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in able.items():
        longer = [b for (m, q), b in able.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * b >= subsumed * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], k + 1, *r[1:]) for k, r in enumerate(own)]
    return sorted(ranked)


def corpus(rng):
    """Few words, so phrases repeat; one pair and one word make up a third; odd signs and separators."""
    names = [a + b for a in "ka lo mi".split() for b in "ru te".split()] + ["é", "Ünd", "漢字", "\xa0x", "THE", "a\x00b"]
    rows = []
    for k in range(150):
        own = [rng.choice(names) if rng.random() > 0.3 else "hot pair" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "\x0b"]) for w in own)
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), text))
    rows += [("en", None), ("en", ""), ("en", " .,;\n "), ("xx", "one two"), ("de", "hot " * 500), ("de", "A a " * 40 + "." + "b " * 9), *rows[:5]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("x") for c in ("k", "w1", "w2", "n", "f", "a", "word", "part", "salt")}).repartition(4)


@pytest.mark.parametrize("most", [1, 40, 1024])
def test_against_brute_force(spark, monkeypatch, most):
    """Also with stripes dealt out in many parts, filled and merged by few bytes."""
    monkeypatch.setattr(collocations, "SHARES", most)
    rows = corpus(random.Random(most))
    split = collocations.shares(frame(spark, rows).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text <> ''"), most=most)
    assert (most == 1) == (not split) and len([w for x in split.values() for w in x]) < most
    monkeypatch.setattr(collocations, "shares", lambda df: split)
    got = sorted(tuple(r[c] for c in NAMES) for r in collocations.collocations(frame(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 40


def test_top_and_parameters(spark):
    rows = corpus(random.Random(9))
    got = sorted(tuple(r[c] for c in NAMES) for r in collocations.collocations(frame(spark, rows), least=3, subsumed=30, top=20).collect())
    assert got == brute(rows, 3, 30, 20)
    whole = collocations.collocations(frame(spark, rows), least=3, subsumed=30, top=None)
    assert whole.count() == len(brute(rows, 3, 30, 10**9))


def test_stripes_merge_elementwise():
    """One stripe over many rows, merged a few bytes at a time, gives the counts of one filled at once."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choices("a b c d".split(), k=200)).encode() for _ in range(8)]
    once = pa.Table.from_batches([collocations.stripes_of(texts, "en", {})]).sort_by([("word", "ascending")])
    apart = pa.Table.from_batches([collocations.stripes_of([t], "en", {}) for t in texts]).sort_by([("word", "ascending")])
    assert apart.num_rows > once.num_rows
    assert collocations._counted(once, {}, 2).to_pylist() == collocations._counted(apart, {}, 2).to_pylist() == collocations._counted(collocations._compact(apart), {}, 2).to_pylist()


def test_long_products(spark):
    """A score whose products pass 64 bits, and an empty table."""
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    got = spark.range(1).select(F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))")).first()[0]
    assert got == 1_000_000 * a * a // (left * right)
    assert collocations.collocations(data.documents(spark, [])).count() == 0
    assert collocations.collocations(data.odd_documents(spark), least=100).columns == NAMES


def test_texts_are_cut_between_pieces(spark, monkeypatch):
    rows = [("en", ("one two three. four five, " * 30)), ("en", "no end of this " * 20)]
    want = sorted(tuple(r[c] for c in NAMES) for r in collocations.collocations(frame(spark, rows)).collect())
    assert want == brute(rows)
    for size in (10, 64):
        held = [collocations._SEPARATORS.search(rows[0][1].encode(), size)]
        assert held[0].start() >= size


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    rows = entry.QUERIES["op12_collocations"](spark, SF).collect()
    assert sorted(tuple(r[c] for c in NAMES) for r in rows) == sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({entry.ORACLE['op12_collocations']})").fetchall())
    assert len(rows) > 1000
