"""Phrases whose words belong together, by the stripes pattern.

1. A word's stripe is an associative counter of what follows it: pairs of next words, with "." for the end of a piece.
   A task fills the stripes of some megabytes of text at once and emits one row for each word.
2. Rows of one word are merged elementwise in the order of a sorted partition. One stripe tells everything: the sum of
   all counts is f(word), the sum under a next word f(word next), each count f(word next after), and the greatest count
   under a next word is the longest continuation that may subsume the pair.
3. A word that a sample finds to be frequent has its stripe dealt out in parts by the hash of the next words; sums are
   then taken over the parts. The sample decides how stripes are dealt, never what is counted.
4. Phrases seen often enough are scored against the counts of their parts by joins, subsumed ones go, and each language's
   best are found first within salted shares of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix, stored

LEAST, SUBSUMED, TOP, SCALE = 10, 50, 2000, 1_000_000
SHARES = 1024  # a word with more than one in so many of the sampled words has its stripe dealt out
SAMPLE = 5000  # documents
TEXT = 8_000_000  # bytes whose stripes a task fills at once
MERGED = 8_000_000  # bytes of stripes that are merged at once
SALTS = 64

_END = b"."  # never part of a word
_SEPARATORS = re.compile(rb"[.,;:!?\n\x0b\x0c\r]+")
_STRIPES = pa.schema([("lang", pa.string()), ("word", pa.string()), ("part", pa.int32()), ("following", pa.binary()), ("counts", pa.binary())])
_COUNTS = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64()), ("longer", pa.int64())])


def _blob(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column whose rows are runs of 64-bit numbers; `ends` has n + 1 places in values."""
    values = np.ascontiguousarray(values, "<i8")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends * 8, np.int32)), pa.py_buffer(values)])


def _triples(first: np.ndarray, second: np.ndarray, third: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct triples in order with their summed counts; second and third are below `size`."""
    pairs, at = np.unique(first * np.int64(size) + second, return_inverse=True)
    key = at * np.int64(size) + third
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, new) if len(key) else n
    pair = pairs[key[new] // size]
    return pair // size, pair % size, key[new] % size, total


def stripes_of(texts: list[bytes], lang: str, parts: dict[bytes, int]) -> pa.RecordBatch:
    """The stripes of some texts of a language: rows (lang, word, part, following, counts). `following` holds next words
    in pairs, blank-separated; counts are 64-bit, in that order."""
    tokens = _SEPARATORS.sub(b" . ", b".".join(texts).lower()).split()
    coded = pa.array([*tokens, _END, _END], pa.binary()).dictionary_encode()
    del tokens
    ids, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    end, size = int(ids[-1]), len(names)
    at = np.flatnonzero(ids != end)
    second = ids[at + 1]
    third = np.where(second == end, end, ids[np.minimum(at + 2, len(ids) - 1)])
    w1, w2, w3, n = _triples(ids[at], second, third, np.ones(len(at), np.int64), size)
    part = np.zeros(len(w1), np.int64)
    many = np.array([parts.get(x, 1) for x in names.to_pylist()], np.int64)[w1] if parts else None
    if many is not None and (many > 1).any():
        crc = np.array([zlib.crc32(x) for x in names.to_pylist()], U64)
        dealt = np.flatnonzero(many > 1)
        part[dealt] = (mix(mix(crc[w2[dealt]]) + crc[w3[dealt]]) % many[dealt].astype(U64)).astype(np.int64)
        order = np.lexsort((part, w1))
        w1, w2, w3, n, part = (x[order] for x in (w1, w2, w3, n, part))
    new = np.flatnonzero(np.append(True, (w1[1:] != w1[:-1]) | (part[1:] != part[:-1]))) if len(w1) else np.zeros(0, np.int64)
    ends = np.append(new, len(w1))
    words = names.take(pa.array(np.column_stack([w2, w3]).ravel()))
    following = pc.binary_join(pa.ListArray.from_arrays(pa.array(2 * ends, pa.int32()), words), b" ")
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(new), pa.string()), names.take(pa.array(w1[new])).cast(pa.string()), pa.array(part[new], pa.int32()), following, _blob(n, ends)], schema=_STRIPES)


def stripes(docs: DataFrame, parts: dict[str, dict[bytes, int]]) -> DataFrame:
    """docs: lang and text, neither null. A text beyond TEXT bytes is cut between pieces."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                left = text.as_py()
                while left:
                    cut = _SEPARATORS.search(left, TEXT) if len(left) > TEXT else None
                    piece, left = (left[: cut.start()], left[cut.end() :]) if cut else (left, b"")
                    held.setdefault(lang, []).append(piece)
                    size += len(piece)
                    if size >= TEXT:
                        yield from (stripes_of(v, k, parts.get(k, {})) for k, v in held.items())
                        held, size = {}, 0
        yield from (stripes_of(v, k, parts.get(k, {})) for k, v in held.items())

    return docs.select("lang", "text").mapInArrow(fill, "lang string, word string, part int, following binary, counts binary")


def _merge(rows: pa.Table) -> tuple[np.ndarray, pa.Array, tuple[np.ndarray, ...]]:
    """Rows in order of (lang, word, part), elementwise: first row of each stripe, the words, and (stripe, next, after, count)."""
    lang, word, part = (rows.column(c).combine_chunks() for c in ("lang", "word", "part"))
    differs = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in (lang, word, part)]
    first = np.append(True, np.logical_or.reduce(differs)) if len(word) else np.zeros(0, bool)
    counts = rows.column("counts").combine_chunks()
    n = np.frombuffer(b"".join(counts.to_pylist()), "<i8")
    sizes = pc.binary_length(counts).to_numpy().astype(np.int64) // 8
    coded = pa.array(b" ".join(rows.column("following").to_pylist()).split(), pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64).reshape(-1, 2)
    stripe = np.repeat(np.cumsum(first) - 1, sizes)
    return np.flatnonzero(first), coded.dictionary, _triples(stripe, ids[:, 0], ids[:, 1], n, max(1, len(coded.dictionary)))


def _counted(rows: pa.Table, split: dict[str, dict[bytes, int]], least: int) -> pa.RecordBatch:
    """What whole stripes tell: k = 0, the words of a language; 1, f(word); 2, f(word next) and the greatest count of a
    longer phrase; 3, f(word next after). Only counts of `least` and more, unless they are sums over a part."""
    first, names, (stripe, w2, w3, n) = _merge(rows)
    lang, word = rows.column("lang").take(pa.array(first)).combine_chunks(), rows.column("word").take(pa.array(first)).combine_chunks()
    end = pc.index(names, pa.scalar(_END, pa.binary())).as_py()
    whole = np.array([x.encode() not in split.get(k, {}) for k, x in zip(lang.to_pylist(), word.to_pylist())], bool)
    total = np.bincount(stripe, n, len(first)).astype(np.int64)  # exact below 2**53
    new = np.flatnonzero(np.append(True, (stripe[1:] != stripe[:-1]) | (w2[1:] != w2[:-1]))) if len(n) else np.zeros(0, np.int64)
    pair_n = np.add.reduceat(n, new) if len(n) else n
    longer = np.maximum.reduceat(np.where((w3 != end) & (n >= least), n, 0), new) if len(n) else n
    ones = np.flatnonzero(~whole | (total >= least))
    twos = np.flatnonzero((w2[new] != end) & (~whole[stripe[new]] | (pair_n >= least)))
    threes = np.flatnonzero((w3 != end) & (n >= least))
    text, none = names.cast(pa.string()), pa.nulls
    by_lang: dict[str, int] = {}
    for k, t in zip(lang.to_pylist(), total.tolist()):
        by_lang[k] = by_lang.get(k, 0) + t
    blocks = [
        (pa.array(list(by_lang), pa.string()), 0, none(len(by_lang), pa.string()), none(len(by_lang), pa.string()), none(len(by_lang), pa.string()), np.array(list(by_lang.values()), np.int64), np.zeros(len(by_lang), np.int64)),
        (lang.take(pa.array(ones)), 1, word.take(pa.array(ones)), none(len(ones), pa.string()), none(len(ones), pa.string()), total[ones], np.zeros(len(ones), np.int64)),
        (lang.take(pa.array(stripe[new][twos])), 2, word.take(pa.array(stripe[new][twos])), text.take(pa.array(w2[new][twos])), none(len(twos), pa.string()), pair_n[twos], longer[twos]),
        (lang.take(pa.array(stripe[threes])), 3, word.take(pa.array(stripe[threes])), text.take(pa.array(w2[threes])), text.take(pa.array(w3[threes])), n[threes], np.zeros(len(threes), np.int64)),
    ]
    made = [pa.RecordBatch.from_arrays([a, pa.array(np.full(len(a), k), pa.int32()), b, c, d, pa.array(e, pa.int64()), pa.array(f, pa.int64())], schema=_COUNTS) for a, k, b, c, d, e, f in blocks]
    return pa.Table.from_batches(made).combine_chunks().to_batches(max_chunksize=None)[0] if any(b.num_rows for b in made) else made[0]


def _compact(rows: pa.Table) -> pa.Table:
    """The same stripes, each as one row."""
    first, names, (stripe, w2, w3, n) = _merge(rows)
    ends = np.searchsorted(stripe, np.arange(len(first) + 1))
    following = pc.binary_join(pa.ListArray.from_arrays(pa.array(2 * ends, pa.int32()), names.take(pa.array(np.column_stack([w2, w3]).ravel()))), b" ")
    kept = [rows.column(c).take(pa.array(first)).combine_chunks() for c in ("lang", "word", "part")]
    return pa.table([*kept, following, _blob(n, ends)], schema=_STRIPES)


def counted(emitted: DataFrame, split: dict[str, dict[bytes, int]], least: int) -> DataFrame:
    """Merges stripes. Partitions are dealt by (lang, word, part) and sorted, so a stripe's rows follow one another."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.cast(_STRIPES))
            size += batch.nbytes
            if size >= MERGED:
                rows = pa.Table.from_batches(held)
                last = {c: rows.column(c)[-1].as_py() for c in ("lang", "word", "part")}
                same = np.logical_and.reduce([pc.equal(rows.column(c), v).combine_chunks().to_numpy(zero_copy_only=False) for c, v in last.items()])
                start = int(np.argmax(same))  # the last stripe may go on
                if start:
                    yield _counted(rows.slice(0, start).combine_chunks(), split, least)
                left = _compact(rows.slice(start).combine_chunks())
                held, size = left.to_batches(), 0
        if held:
            yield _counted(pa.Table.from_batches(held).combine_chunks(), split, least)

    dealt = emitted.repartition("lang", "word", "part").sortWithinPartitions("lang", "word", "part")
    return dealt.mapInArrow(merge, "lang string, k int, w1 string, w2 string, w3 string, n long, longer long")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shares(docs: DataFrame, sample: int = SAMPLE, most: int = SHARES) -> dict[str, dict[bytes, int]]:
    """Into how many parts the stripes of frequent words are dealt, by language, from about `sample` documents. Fewer than
    `most` words can have more than one in `most` of the sampled words."""
    n = docs.count()
    few = docs.where(F.pmod(F.xxhash64("text", F.lit(12)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / max(n, 1))) + 1) if n > sample else docs
    words = few.select("lang", F.explode(F.split(_lower(F.col("text")), "[ \\t.,;:!?\\n\\x0b\\x0c\\r]+")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n").alias("n"))
    frequent = words.join(F.broadcast(total.select(F.col("n").alias("t"))), F.col("n") * most > F.col("t")).collect()
    out: dict[str, dict[bytes, int]] = {}
    for r in frequent:
        out.setdefault(r["lang"], {})[r["w"].encode()] = 1 + r["n"] * most // r["t"]
    return out


def collocations(docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int | None = TOP) -> DataFrame:
    """The best phrases of two and three words in each language: lang, rank, phrase, a, l, r, n, score.

    Null lang is 'und'; null and empty texts have no words. Texts are counted row by row, repeated ones as often as they
    come; only lang and text are read. Ties in score go to the greater count and then to the smaller phrase by bytes, so
    ranks are fixed. A language without phrases gives no rows, as does an empty table. `top` None returns all phrases."""
    base = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    split = shares(base)
    found = stored(counted(stripes(base, split), split, least))
    words = found.where("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    ones = stored(found.where("k = 1").groupBy("lang", "w1").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    twos = stored(found.where("k = 2").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("f"), F.max("longer").alias("longer")).where(F.col("f") >= least))
    threes = found.where("k = 3").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))

    def one(of: str, name: str) -> DataFrame:
        return ones.select(F.col("lang"), F.col("w1").alias(of), F.col("f").alias(name))

    def two(x: str, y: str, name: str) -> DataFrame:
        return twos.select(F.col("lang"), F.col("w1").alias(x), F.col("w2").alias(y), F.col("f").alias(name))

    def scored(df: DataFrame, left: str, right: str, name: str) -> DataFrame:
        kind = "decimal(15,0)"
        return df.withColumn(name, F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as {kind}) * cast(a as {kind})) div (cast({left} as {kind}) * cast({right} as {kind}))"))

    before = threes.groupBy("lang", "w2", "w3").agg(F.max("a").alias("before")).select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "before")
    pairs = twos.withColumnRenamed("f", "a").join(before, ["lang", "w1", "w2"], "left")
    pairs = pairs.where(100 * F.greatest("longer", F.coalesce("before", F.lit(0))) < subsumed * F.col("a"))
    pairs = scored(pairs.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"]), "l", "r", "score")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", "score")
    triples = threes.join(two("w1", "w2", "l2"), ["lang", "w1", "w2"]).join(two("w2", "w3", "r1"), ["lang", "w2", "w3"])
    triples = triples.join(one("w1", "l1"), ["lang", "w1"]).join(one("w3", "r2"), ["lang", "w3"])
    triples = scored(scored(triples, "l1", "r1", "s1"), "l2", "r2", "s2")
    early = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.when(early, F.col("l1")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    phrases = pairs.unionByName(triples)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        shared = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        phrases = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
        phrases = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    else:
        phrases = phrases.withColumn("rank", F.lit(None))
    return phrases.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for the rows of op12_collocations.
ORACLE = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, regexp_extract_all(p, '[^ \t]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
),
words AS (SELECT lang, unnest(w) AS w1, unnest(list_concat(w[2:], [NULL])) AS w2, unnest(list_concat(w[3:], [NULL, NULL])[:len(w)]) AS w3 FROM pieces WHERE len(w) > 0),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
ones AS (SELECT lang, w1, count(*) AS f FROM words GROUP BY lang, w1),
twos AS (SELECT lang, w1, w2, count(*) AS f FROM words WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10),
threes AS (SELECT lang, w1, w2, w3, count(*) AS a FROM words WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
longer AS (
    SELECT lang, w1, w2, max(a) AS longer FROM (SELECT lang, w1, w2, a FROM threes UNION ALL SELECT lang, w2, w3, a FROM threes) GROUP BY lang, w1, w2
),
cuts AS (
    SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, x.f AS l, y.f AS r, 1 AS k
    FROM twos t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w2
    LEFT JOIN longer g ON g.lang = t.lang AND g.w1 = t.w1 AND g.w2 = t.w2 WHERE 100 * coalesce(g.longer, 0) < 50 * t.f
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.f, y.f, 1
    FROM threes t JOIN ones x ON x.lang = t.lang AND x.w1 = t.w1 JOIN twos y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.a, x.f, y.f, 2
    FROM threes t JOIN twos x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN ones y ON y.lang = t.lang AND y.w1 = t.w3
),
scored AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
