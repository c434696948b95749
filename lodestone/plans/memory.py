"""Queries over memories, vectors, clusters and notes (J, C, X-02 to X-05, I-05 to I-11, M-14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X
from lodestone.operators import intent as I
from lodestone.operators import memory as O
from lodestone.sources import model as M
from lodestone.sources.model import read, sql

from .base import query
from .texts import _first

COS = "(CASE WHEN {a} IS NULL THEN NULL ELSE list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))) END)"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b)


def sources(spark, folder):
    """The stated queries of vector searches: every 50th vector."""
    return M.vectors(spark, folder).where("vec_id % 50 = 0").select(F.col("vec_id").alias("source_id"), F.col("prompt_vector").alias("vector"))


SRC = "src AS (SELECT vec_id AS source_id, prompt_vector AS vector FROM vectors WHERE vec_id % 50 = 0)"


@query("j01_memory_events", sql("SELECT m.memory_id, m.interaction_type, i.weight, i.access_count FROM memories m JOIN interactions i ON i.session_id = m.session_id AND i.interaction_type = m.interaction_type", "memories", "interactions"))
def memory_events(spark, folder):
    i = M.interactions(spark, folder).select("session_id", "interaction_type", "weight", "access_count")
    return M.memories(spark, folder).join(i, ["session_id", "interaction_type"]).select("memory_id", "interaction_type", "weight", "access_count")


@query("j02_left_joins", sql("SELECT m.memory_id, i.interaction_id, coalesce(i.weight, 0.5)::DOUBLE AS weight FROM memories m LEFT JOIN interactions i ON i.session_id = m.session_id AND i.interaction_type = m.interaction_type WHERE i.interaction_id IS NULL OR i.is_validated", "memories", "interactions"))
def left_joins(spark, folder):
    i = M.interactions(spark, folder).select("session_id", "interaction_type", "interaction_id", "weight", "is_validated")
    both = M.memories(spark, folder).join(i, ["session_id", "interaction_type"], "left").where(F.col("interaction_id").isNull() | F.col("is_validated"))
    return both.select("memory_id", "interaction_id", F.coalesce("weight", F.lit(0.5)).alias("weight"))


@query("j06_drift", sql("SELECT interaction_id, a.weight AS old, b.weight AS new, CASE WHEN a.weight IS NULL THEN 'added' WHEN b.weight IS NULL THEN 'removed' ELSE 'changed' END AS drift FROM (SELECT * FROM interactions WHERE session_id % 3 <> 0) a FULL JOIN (SELECT interaction_id, CASE WHEN session_id % 4 = 0 THEN weight + 1 ELSE weight END AS weight FROM interactions WHERE session_id % 5 <> 0) b USING (interaction_id) WHERE a.weight IS DISTINCT FROM b.weight", "interactions"))
def drift(spark, folder):
    i = M.interactions(spark, folder)
    new = i.where("session_id % 5 <> 0").withColumn("weight", F.when(F.col("session_id") % 4 == 0, F.col("weight") + 1).otherwise(F.col("weight")))
    return O.drift(i.where("session_id % 3 <> 0"), new, "interaction_id", "weight")


EDGES = "edges AS (SELECT memory_id AS source, next AS target FROM (SELECT memory_id, lead(memory_id) OVER (PARTITION BY session_id ORDER BY created_at, memory_id) AS next FROM memories) WHERE next IS NOT NULL)"


@query("j07_both_ways", sql(f"{EDGES} SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges", "memories"))
def both_ways(spark, folder):
    return O.both_ways(O.continuations(M.memories(spark, folder))).select("source", "target")


@query("f04_relationships", sql(f"{EDGES}, two AS (SELECT source, target FROM edges UNION ALL SELECT target, source FROM edges) SELECT source, target, 'continuation' AS kind FROM two WHERE source % 2 = 0", "memories"))
def relationships(spark, folder):
    m = M.memories(spark, folder)
    return O.relationships_of(O.continuations(m), m.where("memory_id % 2 = 0").select(F.col("memory_id").alias("id")), ["continuation"], 0.5).select("source", "target", "kind")


@query("j10_within_hours", sql("SELECT a.interaction_type, a.memory_id AS a, b.memory_id AS b, round(epoch(b.created_at - a.created_at) / 3600, 8)::DOUBLE AS hours FROM memories a JOIN memories b ON a.interaction_type = b.interaction_type AND a.memory_id <> b.memory_id AND b.created_at >= a.created_at AND b.created_at <= a.created_at + INTERVAL 24 HOURS", "memories"))
def within_hours(spark, folder):
    return O.within_hours(M.memories(spark, folder), 24, ["interaction_type"]).withColumn("hours", F.round("hours", 8))


@query("j11_validated_only", sql("SELECT memory_id FROM memories m WHERE EXISTS (SELECT 1 FROM interactions i WHERE i.session_id = m.session_id AND i.is_validated)", "memories", "interactions"))
def validated_only(spark, folder):
    ok = M.interactions(spark, folder).where("is_validated").select("session_id")
    return M.memories(spark, folder).join(ok, "session_id", "left_semi").select("memory_id")


@query("j12_without_errors", "SELECT user_id, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 50) GROUP BY user_id")
def without_errors(spark, folder):
    ev = read(spark, folder, "events")
    bad = ev.where("event_type = 'error' and value > 50").select("user_id")
    return ev.join(bad, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("j14_latest", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest(spark, folder):
    return O.latest(read(spark, folder, "events"), ["user_id"], "ts", ["event_id", "value"])


NOTES = "notes AS (SELECT conv_id * 1000 + turn AS note, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) = 9)) AS tags FROM conversations)"


def notes(spark, folder):
    """Turns as notes; their words of nine letters serve as tags."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) == 9)
    return read(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("note"), words.alias("tags"))


@query("j17_tag_overlap", f"WITH {NOTES}, e AS (SELECT note, unnest(tags) AS tag FROM notes), q AS (SELECT conv_id * 1000 + turn AS note FROM conversations WHERE role = 'user') SELECT a.note AS a, b.note AS b, count(*) AS shared FROM e a JOIN q ON q.note = a.note JOIN e b USING (tag) WHERE a.note <> b.note GROUP BY ALL")
def tag_overlap(spark, folder):
    """The notes that share a tag with a user's turn."""
    asked = read(spark, folder, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("note"))
    return O.tag_overlap(notes(spark, folder), asked)


@query("x02_cosine", sql(f"SELECT vec_id, round({cos('prompt_vector', 'response_vector')}, 8) AS cosine FROM vectors", "vectors"))
def cosine(spark, folder):
    return M.vectors(spark, folder).select("vec_id", F.round(W.cosine(F.col("prompt_vector"), F.col("response_vector")), 8).alias("cosine"))


@query("x05_combined", sql("SELECT vec_id, round(list_sum(list_transform(list_zip(prompt_vector, response_vector), lambda z: (z[1]::DOUBLE * 0.4 + z[2]::DOUBLE * 0.6))) / sqrt(list_sum(list_transform(list_zip(prompt_vector, response_vector), lambda z: (z[1]::DOUBLE * 0.4 + z[2]::DOUBLE * 0.6) * (z[1]::DOUBLE * 0.4 + z[2]::DOUBLE * 0.6)))), 7)::DOUBLE AS total FROM vectors", "vectors"))
def combined(spark, folder):
    v = M.vectors(spark, folder).select("vec_id", W.combined(F.col("prompt_vector"), F.col("response_vector")).alias("v"))
    return v.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 7).alias("total"))


RELATED = f"{SRC}, both_v AS (SELECT source_id, vec_id, greatest({cos('prompt_vector', 'vector')}, {cos('response_vector', 'vector')}) AS score FROM vectors, src WHERE vec_id <> source_id), related AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, round(score, 8) AS score FROM both_v WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY score DESC, vec_id) <= 10)"


def _related(spark, folder):
    return O.related_vectors(M.vectors(spark, folder), sources(spark, folder), 0.2).withColumn("score", F.round("score", 8))


@query("c01_related_vectors", sql(f"{RELATED} SELECT * FROM related", "vectors"))
def related_vectors(spark, folder):
    return _related(spark, folder)


@query("c03_related_labelled", sql(f"{RELATED}, known AS (SELECT DISTINCT vec_id AS source_id, vec_id + 1 AS vec_id FROM vectors) SELECT r.source_id, r.vec_id, r.rank, r.score, CASE WHEN k.vec_id IS NULL THEN 'similar' ELSE 'continuation' END AS kind FROM related r LEFT JOIN known k USING (source_id, vec_id)", "vectors"))
def related_labelled(spark, folder):
    edges = M.vectors(spark, folder).select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"), F.lit("continuation").alias("kind"))
    return O.labelled(_related(spark, folder), edges)


@query("a32_centroids", sql("SELECT label::INTEGER AS label, pos::INTEGER AS pos, round(avg(x), 7) AS x FROM (SELECT label, unnest(range(0, 64)) AS pos, unnest(prompt_vector::DOUBLE[]) AS x FROM vectors) GROUP BY ALL", "vectors"))
def centroids(spark, folder):
    return O.centroids(M.vectors(spark, folder)).select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 7))


CENTRES = f"flat AS (SELECT label, unnest(range(0, 64)) AS pos, unnest(prompt_vector::DOUBLE[]) AS x FROM vectors), means AS (SELECT label, pos, avg(x) AS x FROM flat GROUP BY ALL), centres AS (SELECT label, list(x ORDER BY pos) AS centroid FROM means GROUP BY label), members AS (SELECT v.label, vec_id, {cos('prompt_vector', 'centroid')} AS score FROM vectors v JOIN centres USING (label))"


@query("a10_cluster_statistics", sql(f"{CENTRES} SELECT label, count(*) AS members, round(avg(score), 7) AS avg_score, round(min(score), 7) AS min_score, round(max(score), 7) AS max_score FROM members GROUP BY label", "vectors"))
def cluster_statistics(spark, folder):
    v = M.vectors(spark, folder)
    out = O.cluster_statistics(O.memberships(v, O.centroids(v)))
    return out.withColumns({c: F.round(c, 7) for c in ("avg_score", "min_score", "max_score")})


@query("c07_recommended_clusters", sql(f"{CENTRES}, ranked AS (SELECT vec_id, c.label AS cluster, {cos('prompt_vector', 'c.centroid')} AS score FROM vectors v, centres c) SELECT vec_id, (row_number() OVER w)::INTEGER AS rank, cluster, round(score, 7) AS score FROM ranked WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC, cluster) QUALIFY row_number() OVER w <= 3", "vectors"))
def recommended_clusters(spark, folder):
    v = M.vectors(spark, folder)
    return O.recommended(v, O.centroids(v)).withColumn("score", F.round("score", 7))


def gram_sql(column: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({column}), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("c04_text_search", f"WITH t AS (SELECT conv_id * 1000 + turn AS id, {gram_sql('text')} AS g FROM conversations), q AS (SELECT item_id AS query_id, {gram_sql('text')} AS qg FROM benchmark), s AS (SELECT query_id, id, len(list_intersect(g, qg)) AS b, len(g) AS n, len(qg) AS m FROM t, q), r AS (SELECT query_id, id, CASE WHEN n + m - b > 0 THEN b::DOUBLE / (n + m - b) ELSE 0.0 END AS score FROM s) SELECT query_id, (row_number() OVER w)::INTEGER AS rank, id, score FROM r WHERE score >= 0.2 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10")
def text_search(spark, folder):
    t = read(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    q = read(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return O.text_search(t, q, 0.2)


def _asked(spark, folder):
    """Memories with intent, domain and complexity of their prompts."""
    best = I.best_intent(M.memories(spark, folder), "memory_id", "prompt")
    return best.withColumns({"domain": X.first_class(F.col("prompt"), X.DOMAINS), "complexity": X.first_class(F.col("prompt"), X.COMPLEXITY)})


def _queries(asked):
    return asked.select(F.col("memory_id").alias("query_id"), "session_id", "intent", "domain", "complexity", "created_at")


REL = "(" + " OR ".join(f"(q.intent IN ({', '.join(repr(x) for x in g)}) AND m.intent IN ({', '.join(repr(x) for x in g)}))" for g in I.GROUPS) + ")"
ASKED = I.oracle("prompt") + f", asked AS (SELECT m.*, b.intent, {_first('lower(prompt)', X.DOMAINS)} AS domain, {_first('lower(prompt)', X.COMPLEXITY)} AS complexity FROM memories m JOIN best b USING (memory_id))"


@query("i06_temporal_connections", sql(f"{ASKED}, t AS (SELECT q.memory_id AS query_id, m.memory_id, 'temporal' AS kind, CASE WHEN abs(epoch(q.created_at - m.created_at)) / 3600 <= 24 THEN least(1.0, greatest(0.0, 1 - abs(epoch(q.created_at - m.created_at)) / 3600 / 24) * CASE WHEN {REL} THEN 1.2 ELSE 1.0 END) END AS strength FROM asked q JOIN asked m ON q.session_id = m.session_id AND q.memory_id <> m.memory_id) SELECT query_id, memory_id, kind, round(strength, 8)::DOUBLE AS strength FROM t WHERE strength >= 0.3", "memories"))
def temporal_connections(spark, folder):
    asked = _asked(spark, folder)
    return I.temporal_connections(_queries(asked), asked).withColumn("strength", F.round("strength", 8))


@query("m14_resolved_notes", sql("SELECT m.memory_id AS note, 'changed' AS conflict FROM memories m WHERE m.session_id % 2 = 0 UNION ALL SELECT memory_id, 'missing_file' FROM memories WHERE session_id % 3 = 1 AND session_id % 2 = 1", "memories"))
def resolved_notes(spark, folder):
    """Files lack a third of the notes with odd sessions, and hold one more line for even sessions."""
    m = M.memories(spark, folder)
    mine = m.select(F.col("memory_id").alias("note"), F.col("prompt").alias("text"))
    more = F.when(F.col("session_id") % 2 == 0, F.concat("prompt", F.lit("\nA line that the note lacks."))).otherwise(F.col("prompt"))
    theirs = m.where("not (session_id % 3 = 1 and session_id % 2 = 1)").select(F.col("memory_id").alias("note"), more.alias("text"))
    return O.resolved(O.conflicts(mine, theirs), "merge").select("note", "conflict")
