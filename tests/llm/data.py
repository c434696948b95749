"""Small fixtures: invented words, nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = "ka lo mi ru te so ba ne vi do pa fe".split()


def words(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(["", "n", "s", "ra"]) for _ in range(n)]


def text(rng, n):
    return " ".join(words(rng, n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCUMENTS)


def odd_rows(rng):
    """Rows that every operator must take: null and empty texts, blanks, one word, a long text, a repeated row."""
    same = text(rng, 30)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, same), (5, same), (None, "no id here"), (6, text(rng, 9000)), (7, "é ü ß 漢字 🎈"), (8, "x" * 5000)]


def odd_documents(spark, seed=0):
    rng = random.Random(seed)
    df = documents(spark, odd_rows(rng))
    extra = {c: "x" for c in ("h", "key", "rep", "length", "component", "block", "pos", "end", "budget", "label", "score", "row_id", "gone")}
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})
