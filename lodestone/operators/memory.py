"""Joins and searches over memories: relationships, similarity, clusters, notes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X

from . import neighbours as N


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges, and bidirectional ones once more the other way."""
    back = edges.where("bidirectional").withColumns({"source": F.col("target"), "target": F.col("source")})
    return edges.unionByName(back)


def relationships_of(edges: DataFrame, ids: DataFrame, kinds: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """Edges that start at the given ids (column id), or end there if bidirectional, strongest first within an id."""
    found = both_ways(edges).join(ids.select(F.col("id").alias("source")), "source", "left_semi").where(F.col("strength") >= least)
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def continuations(memories: DataFrame, strength: float = 0.8) -> DataFrame:
    """Edges from each memory of a session to its next."""
    w = Window.partitionBy("session_id").orderBy("created_at", "memory_id")
    told = memories.withColumn("target", F.lead("memory_id").over(w)).where("target is not null")
    return told.select(F.col("memory_id").alias("source"), "target", F.lit("continuation").alias("kind"), F.lit(strength).alias("strength"), F.lit(True).alias("bidirectional"))


def within_hours(memories: DataFrame, hours: int, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of a key, b at most `hours` after a: joined on buckets of that length, then on time."""
    bucket = F.floor(F.unix_timestamp("created_at") / (hours * 3600))
    a = memories.select(*keys, F.col("memory_id").alias("a"), F.col("created_at").alias("ta"), F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    b = memories.select(*keys, F.col("memory_id").alias("b"), F.col("created_at").alias("tb"), bucket.alias("bucket"))
    gap = F.unix_timestamp("tb") - F.unix_timestamp("ta")
    both = a.join(b, [*keys, "bucket"]).withColumn("gap", gap).where((F.col("a") != F.col("b")) & (F.col("gap") >= 0) & (F.col("gap") <= hours * 3600))
    return both.select(*keys, "a", "b", (F.col("gap") / 3600.0).alias("hours"))


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value differs between two tables, null-safe: added, removed or changed."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.withColumn("drift", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed"))


def latest(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Of each key, the columns of the latest row: one aggregate, no sort of a group."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("x")).select(*keys, "x.*")


def tag_overlap(notes: DataFrame, asked: DataFrame) -> DataFrame:
    """Pairs (a, b) of an asked note and any other note that share a tag, with how many: a stated set (column note)
    against all notes, whatever the number of notes a tag is on. notes: note, tags."""
    each = notes.select("note", F.explode(F.array_distinct("tags")).alias("tag"))
    own = each.join(asked.select("note"), "note", "left_semi").select("tag", F.col("note").alias("a"))
    both = own.join(each.select("tag", F.col("note").alias("b")), "tag").where("a <> b")
    return both.groupBy("a", "b").agg(F.count("*").alias("shared"))


#: A part of text queries and their distinct trigrams make a table of so many cells at most.
MOST_CELLS = 50_000_000


def text_search(texts: DataFrame, queries: DataFrame, least: float = 0.3, k: int = 10, most: int = 10_000) -> DataFrame:
    """The k texts most like each query by trigrams, of those of at least `least`. texts: id, text; queries: query_id,
    query: a stated set. Queries go to the tasks in parts of about `most`, and fewer if their trigrams are many, so any
    number can be asked. A batch of texts and a part are compared by one product of 0/1 matrices over the part's
    trigrams; only matches leave the task."""
    grams = queries.select("query_id", X.trigrams(F.col("query")).alias("g"))
    parts, out = -(-grams.count() // most), None
    for p in range(parts):
        asked = (grams.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p) if parts > 1 else grams).collect()
        while asked:
            n, known = 0, set()
            while n < len(asked) and (n == 0 or len(known | set(asked[n]["g"] or ())) * (n + 1) <= MOST_CELLS):
                known |= set(asked[n]["g"] or ())
                n += 1
            found = _matches(texts, asked[:n], sorted(known), least)
            out, asked = found if out is None else out.unionByName(found), asked[n:]
    if out is None:
        out = texts.sparkSession.createDataFrame([], "query_id long, id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _matches(texts: DataFrame, asked: list, known: list[str], least: float) -> DataFrame:
    """(query_id, id, score) of one part of the queries, rows (query_id, g), whose trigrams are `known`."""
    index = {g: i for i, g in enumerate(known)}
    ids, matrix = [r["query_id"] for r in asked], np.zeros((len(index), len(asked)), np.float32)
    for j, r in enumerate(asked):
        matrix[[index[g] for g in r["g"] or ()], j] = 1
    sizes = np.array([len(r["g"] or ()) for r in asked], np.float64)
    shared = texts.sparkSession.sparkContext.broadcast((index, np.array(ids, np.int64), matrix, sizes))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids, matrix, sizes = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                own, n = np.zeros((part.num_rows, len(index)), np.float32), np.zeros(part.num_rows)
                for i, grams in enumerate(part.column(1).to_pylist()):
                    n[i] = len(grams or ())
                    own[i, [index[g] for g in grams or () if g in index]] = 1
                both = (own @ matrix).astype(np.float64)
                union = n[:, None] + sizes[None] - both
                score = np.divide(both, union, out=np.zeros_like(both), where=union > 0)
                i, j = np.nonzero(score >= least)
                yield pa.RecordBatch.from_arrays([pa.array(ids[j]), part.column(0).take(pa.array(i)), pa.array(score[i, j])], ["query_id", "id", "score"])

    return texts.select(F.col("id").cast("long"), X.trigrams(F.col("text")).alias("g")).mapInArrow(compare, "query_id long, id long, score double")


def related_vectors(vectors: DataFrame, sources: DataFrame, least: float = 0.7, k: int = 10) -> DataFrame:
    """The k vectors nearest to each source by the greater cosine of prompt and response, at least `least`.

    vectors: vec_id, prompt_vector, response_vector; sources: source_id, vector: a stated set of queries."""
    return N.compared(vectors, sources, {"prompt_vector": None, "response_vector": None}, least, k).select("source_id", "rank", "vec_id", "score")


def similar_vectors(vectors: DataFrame, sources: DataFrame, least: float) -> DataFrame:
    """(source_id, vec_id, score): every vector whose cosine with a source reaches `least`. sources: a stated set."""
    return N.compared(vectors, sources, {"prompt_vector": None}, least)


#: So many stated queries go to every task at once; more must come in parts.
MOST_QUERIES = 100_000


def stated(queries: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """A stated set of queries, broadcast: at most `most`, which is checked."""
    if queries.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} queries; search for them in parts")
    return F.broadcast(queries)


def alike_pairs(vectors: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of each asked vector (source_id, vector: a stated set) and all others of at least `least`."""
    return N.compared(vectors, asked, {"prompt_vector": None}, least).select(F.col("source_id").alias("a"), F.col("vec_id").alias("b"), F.col("score").alias("similarity"))


def labelled(related: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds the kind of an existing relationship, or `similar`."""
    known = edges.groupBy(F.col("source").alias("source_id"), F.col("target").alias("vec_id")).agg(F.min("kind").alias("kind"))
    return related.join(known, ["source_id", "vec_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("similar")))


def centroids(vectors: DataFrame, weight: Column | None = None) -> DataFrame:
    """(label, centroid): the weighted mean of a label's vectors. Each task sums up its own vectors first."""
    w = F.lit(1.0) if weight is None else weight
    told = vectors.select("label", w.cast("double").alias("w"), array_to_vector(F.col("prompt_vector").cast("array<double>")).alias("v"))
    return told.groupBy("label").agg(Summarizer.mean(F.col("v"), F.col("w")).alias("m")).select("label", vector_to_array("m").alias("centroid"))


def memberships(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """(label, vec_id, score): cosine of each vector with its label's centroid. Centroids are one row a label."""
    return vectors.join(centres, "label").select("label", "vec_id", W.cosine(F.col("prompt_vector"), F.col("centroid")).alias("score"))


def recommended(vectors: DataFrame, centres: DataFrame, k: int = 3) -> DataFrame:
    """The k clusters whose centroids are nearest to each vector."""
    return N.nearest_centres(vectors, centres, k)


def cluster_statistics(members: DataFrame) -> DataFrame:
    return members.groupBy("label").agg(F.count("*").alias("members"), F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


def boosted_search(found: DataFrame, members: DataFrame, sizes: DataFrame, k: int = 10) -> DataFrame:
    """Search hits (query_id, id, score) raised by their cluster's membership and size; hits without a cluster stay."""
    joined = found.join(members.select(F.col("vec_id").alias("id"), "label", F.col("score").alias("membership")), "id", "left").join(sizes, "label", "left")
    score = W.boosted(F.col("score"), F.col("membership"), F.col("members"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted"), "id"))
    return joined.withColumn("boosted", score).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "label", "boosted")


def unique_lines(mine: Column, theirs: Column) -> Column:
    """Lines of `theirs` that `mine` lacks, over ten characters and no headings."""
    known = F.transform(F.split(mine, "\n"), lambda x: F.trim(x))
    return F.filter(F.transform(F.split(theirs, "\n"), lambda x: F.trim(x)), lambda x: ~F.array_contains(known, x) & (F.length(x) > 10) & ~x.startswith("#"))


def conflicts(notes: DataFrame, files: DataFrame) -> DataFrame:
    """(note, conflict) where the hash of the lines differs or a side is missing. Both: note, text."""
    a, b = (t.select("note", X.lines_hash(F.col("text")).alias(n), F.col("text").alias(f"{n}_text")) for t, n in ((notes, "mine"), (files, "theirs")))
    both = a.join(b, "note", "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))
    return both.withColumn("conflict", F.when(F.col("theirs").isNull(), "missing_file").when(F.col("mine").isNull(), "missing_note").otherwise("changed"))


def resolved(found: DataFrame, strategy: str) -> DataFrame:
    """conflicts() with the text to keep: memory, vault, merge (the note's, and the file's own lines) or skip."""
    merged = F.concat(F.col("mine_text"), F.lit("\n\n"), F.array_join(unique_lines(F.col("mine_text"), F.col("theirs_text")), "\n"))
    text = {"memory": F.col("mine_text"), "vault": F.col("theirs_text"), "merge": merged, "skip": F.lit(None).cast("string")}[strategy]
    return found.withColumn("resolved", F.coalesce(text, F.col("mine_text"), F.col("theirs_text")) if strategy != "skip" else text)


def features(texts: DataFrame, size: int = 64) -> DataFrame:
    """Adds a vector of hashed word counts of length 1, null for texts without words. Words are hashed and counted row by
    row: neither words nor texts are shuffled."""

    @F.pandas_udf("array<double>")
    def unit_counts(slots: pd.Series) -> pd.Series:
        return slots.map(lambda s: None if s is None or not len(s) else _unit_counts(s, size))

    words = F.filter(F.split(F.lower("text"), r"[^a-z0-9]+"), lambda w: w != "")
    return texts.withColumn("vector", unit_counts(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))))


def _unit_counts(slots: np.ndarray, size: int) -> np.ndarray:
    n = np.bincount(slots, minlength=size).astype(float)
    return n / np.sqrt((n * n).sum())


def joined_or_new(vectors: DataFrame, centres: DataFrame, least: float = 0.8) -> DataFrame:
    """(vec_id, cluster, score, action): the nearest cluster if it is near enough, else a new one of its own."""
    best = recommended(vectors, centres, 1)
    action = F.when(F.col("score") >= least, "join").otherwise("create")
    return best.withColumn("action", action).withColumn("cluster", F.when(F.col("action") == "join", F.col("cluster"))).select("vec_id", "cluster", "score", "action")


def needing_vectors(rows: DataFrame, column: str, size: int) -> DataFrame:
    """Rows whose vector is missing or of another size."""
    return rows.where(F.col(column).isNull() | (F.size(column) != size))


def intent_search(found: DataFrame, intents: DataFrame, k: int = 10) -> DataFrame:
    """Hits (query_id, id, score) raised by 0.3 for the query's intent and 0.1 for a related one, up to 1. intents: id,
    intent, of queries and memories alike."""
    from . import intent as I

    q = intents.select(F.col("id").alias("query_id"), F.col("intent").alias("__q"))
    both = found.join(q, "query_id", "left").join(intents.select("id", "intent"), "id", "left")
    more = I.boost(F.col("__q"), F.col("intent"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return both.withColumn("score", F.least(F.lit(1.0), F.col("score") + more)).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
