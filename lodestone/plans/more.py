"""Further queries: streams over `events`, jobs, clusters, code, JSON, and what is left of the other sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X
from lodestone.operators import clusters as C
from lodestone.operators import code as N
from lodestone.operators import detect as D
from lodestone.operators import intent as I
from lodestone.operators import memory as O
from lodestone.operators import neighbours as NB
from lodestone.operators import validate as V
from lodestone.operators import views as VW
from lodestone.sources import model as M
from lodestone.sources.model import as_of, read, sql
from lodestone.sources.scratch import dropped, kept
from lodestone.streaming import jobs as S

from . import texts
from .base import like, query, quoted
from .memory import CENTRES, cos
from .views import DECAYED, EV, LOG, NOW, events, history, interactions, validation_log


def source(spark, folder, name):
    """A table as a stream of files: a pattern, so that it may be one file or a folder."""
    return spark.readStream.schema(read(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def stream(spark, folder):
    return source(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t04_stream_hourly", f"WITH {EV} SELECT date_trunc('hour', ts)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(value) AS max_value FROM ev GROUP BY ALL")
def stream_hourly(spark, folder):
    return S.drained(S.rollup(stream(spark, folder), "1 hour"), "complete")


@query("t05_stream_sliding", f"WITH {EV}, w AS (SELECT ev.*, unnest(range(0, 24)) AS k FROM ev) SELECT date_trunc('hour', ts)::TIMESTAMP - to_hours(k) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(value) AS max_value FROM w GROUP BY ALL")
def stream_sliding(spark, folder):
    return S.drained(S.rollup(stream(spark, folder), "24 hours", "1 hour"), "complete")


@query("t13_stream_activity", "SELECT user_id, event_type, count(*) AS n, max(ts)::TIMESTAMP AS last_activity FROM events GROUP BY ALL")
def stream_activity(spark, folder):
    return S.drained(S.activity(stream(spark, folder)), "complete")


@query("t08_stream_alerts", "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value > 60")
def stream_alerts(spark, folder):
    return S.drained(S.alerts(stream(spark, folder), (F.col("event_type") == "error") & (F.col("value") > 60)).select("event_id", "user_id", "value"))


BUCKET = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch(ts::TIMESTAMP) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    b AS (SELECT event_id, user_id, r, t, 2.0::DOUBLE AS tokens, TRUE AS admitted FROM e WHERE r = 1 UNION ALL
        SELECT e.event_id, e.user_id, e.r, e.t, CASE WHEN f >= 1 THEN f - 1 ELSE f END, f >= 1 FROM (SELECT e.*, least(3.0::DOUBLE, b.tokens + greatest(0.0, e.t - b.t) * (1 / 3600)) AS f FROM b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1) e)
    SELECT event_id, user_id, admitted FROM b"""


@query("t07_token_bucket", BUCKET)
def token_bucket(spark, folder):
    return S.admitted_batch(events(spark, folder), 1 / 3600, 3.0)


@query("t07_stream_token_bucket", BUCKET)
def stream_token_bucket(spark, folder):
    return S.drained(S.admitted(stream(spark, folder), 1 / 3600, 3.0))


THRESHOLD = """WITH RECURSIVE e AS (SELECT event_id, user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    b AS (SELECT event_id, user_id, r, m AS told, TRUE AS changed FROM e WHERE r = 1 UNION ALL
        SELECT e.event_id, e.user_id, e.r, CASE WHEN abs(e.m - b.told) > 1 THEN e.m ELSE b.told END, abs(e.m - b.told) > 1 FROM b JOIN e ON e.user_id = b.user_id AND e.r = b.r + 1)
    SELECT user_id, event_id, round(told, 7) AS threshold FROM b WHERE changed"""


@query("t12_stream_threshold", THRESHOLD)
def stream_threshold(spark, folder):
    return S.drained(S.smoothed_threshold(stream(spark, folder))).withColumn("threshold", F.round("threshold", 7))


@query("t03_stream_queue", "WITH e AS (SELECT user_id AS item, event_type <> 'click' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events), f AS (SELECT item, count(*) AS n, min(r) FILTER (ok) AS first FROM e GROUP BY item), k AS (SELECT item, first, coalesce(first - 1, n) AS failures FROM f) SELECT item, CASE WHEN failures >= 3 THEN 'failed' WHEN first IS NOT NULL THEN 'done' ELSE 'pending' END AS status, least(failures, 3)::INTEGER AS retries FROM k")
def stream_queue(spark, folder):
    asked = stream(spark, folder).select(F.col("user_id").alias("item"), (F.col("event_type") != "click").alias("ok"), "ts", "event_id")
    return S.drained(S.scan_queue(asked), "update", ["item"])


@query("t03_queue_cycle", "WITH q AS (SELECT user_id AS item, max(CASE WHEN value / 100 < 0.85 THEN 8 WHEN value / 100 < 0.9 THEN 6 ELSE 5 END) AS priority, min(ts) AS t FROM events WHERE NOT (event_type = 'view' AND value / 100 >= 0.95) GROUP BY user_id), top AS (SELECT item FROM q ORDER BY priority DESC, t, item LIMIT 100) SELECT q.item, priority::INTEGER AS priority, CASE WHEN top.item IS NOT NULL AND q.item % 3 <> 0 THEN 'completed' ELSE 'pending' END AS status, (top.item IS NOT NULL)::INTEGER AS retries FROM q LEFT JOIN top ON top.item = q.item")
def queue_cycle(spark, folder):
    """All users queued by the scores of what they did, and the hundred most urgent scanned; every third scan fails."""
    told = stream(spark, folder).select(F.col("user_id").alias("item"), (F.col("value") / 100).alias("score"), (F.col("event_type") == "view").alias("validated"), "ts")
    path = S.scratch(spark, "queue")
    S.run_queue(S.queued(told), path, F.col("item") % 3 != 0)
    return S.queue_state(spark, path).select("item", "priority", "status", "retries")


@query("t01_stream_scores", f"WITH {texts.SCORED} SELECT doc_id, score, refs::BIGINT AS refs FROM scored")
def stream_scores(spark, folder):
    docs = source(spark, folder, "documents")
    return S.drained(S.scored(docs).select("doc_id", "score", F.col("refs").cast("long").alias("refs")))


@query("t02_stream_quarantine", f"WITH {texts.SCORED} SELECT doc_id, score FROM scored WHERE score < 0.8")
def stream_quarantine(spark, folder):
    docs = source(spark, folder, "documents")
    timed = docs.withColumn("ts", F.expr(f"timestamp '{M.AS_OF}' - make_interval(0, 0, 0, 0, 0, cast(doc_id as int), 0)"))
    return S.drained(S.quarantined(timed).select("doc_id", "score"))


@query("c06_clusters")
def clusters(spark, folder):
    """All vectors, merged down to a mean cosine of 0.4: none here are as near as 0.7."""
    return NB.mean_linkage(M.vectors(spark, folder), 0.6)


@query("c06_bisecting_clusters")
def bisecting_clusters(spark, folder):
    return C.bisecting(M.vectors(spark, folder), 10)


@query("c09_inverted_lists")
def inverted_lists(spark, folder):
    """An index of most vectors, the rest appended, asked for every 50th vector with as many probes as its recall needs."""
    v, path = kept(M.vectors(spark, folder).select("vec_id", "prompt_vector")), S.scratch(spark, "lists")
    NB.build_index(v.where("vec_id % 9 <> 0"), path)
    NB.append_vectors(v.where("vec_id % 9 = 0"), path)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("source_id"), F.col("prompt_vector").alias("vector"))
    found = NB.nearest_in_lists(spark, path, asked, NB.fitted_probes(spark, path)).withColumn("score", F.round("score", 8))
    dropped(v)  # the search has its queries, and reads the index
    return found


@query("c11_members", sql("SELECT label, max(vec_id) AS newest, count(*) AS n FROM vectors WHERE vec_id % 9 <> 0 GROUP BY label", "vectors"))
def members(spark, folder):
    """Members after a batch that adds all and then takes every ninth away: the latest change wins."""
    v = M.vectors(spark, folder)
    changes = v.select("label", "vec_id", F.lit(1).alias("seq"), F.lit(True).alias("added")).unionByName(v.where("vec_id % 9 = 0").select("label", "vec_id", F.lit(2).alias("seq"), F.lit(False).alias("added")))
    now = O.latest(changes, ["label", "vec_id"], "seq", ["added"]).where("added")
    return now.groupBy("label").agg(F.max("vec_id").alias("newest"), F.count("*").alias("n"))


@query("a11_clustering_quality", sql(f"{CENTRES}, c AS (SELECT label, count(*) AS n, avg(score) AS s FROM members GROUP BY label) SELECT round(0.5 * avg(s) + 0.3 * least(1.0, avg(n) / 10) + 0.2 * least(1.0, count(*) / 20.0), 7)::DOUBLE AS quality FROM c", "vectors"))
def clustering_quality(spark, folder):
    v = M.vectors(spark, folder)
    c = O.cluster_statistics(O.memberships(v, O.centroids(v)))
    return c.agg(F.round(0.5 * F.avg("avg_score") + 0.3 * F.least(F.lit(1.0), F.avg("members") / 10) + 0.2 * F.least(F.lit(1.0), F.count("*") / 20), 7).alias("quality"))


@query("l02_vector_top_k", sql(f"SELECT a.vec_id AS source_id, b.vec_id, round({cos('a.prompt_vector', 'b.prompt_vector')}, 8) AS score FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos('a.prompt_vector', 'b.prompt_vector')} DESC, b.vec_id) <= 5", "vectors"))
def vector_top_k(spark, folder):
    """The five nearest of the same label for every 50th vector."""
    v = M.vectors(spark, folder)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("source_id"), "label", F.col("prompt_vector").alias("vector"))
    found = NB.compared(v, asked, {"prompt_vector": None}, -2.0, 5, group="label")
    return found.select("source_id", "vec_id", F.round("score", 8).alias("score"))


@query("v04_json_paths", "SELECT event_id, json_valid(props) AS valid, length(json_extract_string(props, '$.k'))::BIGINT AS page_length FROM events")
def json_paths(spark, folder):
    e = events(spark, folder)
    return e.select("event_id", F.get_json_object("props", "$").isNotNull().alias("valid"), F.length(F.get_json_object("props", "$.k")).cast("long").alias("page_length"))


@query("f06_json_keys", "SELECT event_id, list_contains(json_keys(props), 'k') AS has_ref FROM events")
def json_keys(spark, folder):
    return events(spark, folder).select("event_id", F.array_contains(F.json_object_keys("props"), "k").alias("has_ref"))


@query("x19_json_map", "SELECT event_id, json_extract_string(props, '$.k') AS page, TRUE AS synced FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_map(spark, folder):
    """Marks each event's properties as synced, as a typed map."""
    m = events(spark, folder).withColumn("m", F.from_json("props", "map<string,string>")).where(F.try_element_at("m", F.lit("k")).isNotNull())
    marked = F.map_concat("m", F.create_map(F.lit("vault_synced"), F.lit("true")))
    return m.select("event_id", F.try_element_at(marked, F.lit("k")).alias("page"), (F.try_element_at(marked, F.lit("vault_synced")) == "true").alias("synced"))


@query("x21_masked_ips", r"SELECT masked, count(*) AS n FROM (SELECT split_part(ip, '.', 1) || '.' || split_part(ip, '.', 2) || '.***.***' AS masked FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ip FROM documents)) GROUP BY masked")
def masked_ips(spark, folder):
    ips = read(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))).alias("ip"))
    return ips.groupBy(X.masked_ip(F.col("ip")).alias("masked")).agg(F.count("*").alias("n"))


@query("x34_relative_time", sql(f"SELECT interaction_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 604800 THEN d || ' day' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' ago' ELSE w || ' week' || CASE WHEN w = 1 THEN '' ELSE 's' END || ' ago' END AS ago FROM (SELECT interaction_id, s, (s // 60)::BIGINT AS m, (s // 3600)::BIGINT AS h, (s // 86400)::BIGINT AS d, (s // 604800)::BIGINT AS w FROM (SELECT interaction_id, (floor(epoch({NOW})) - floor(epoch(last_accessed)))::BIGINT AS s FROM interactions))", "interactions"))
def relative_time(spark, folder):
    return interactions(spark, folder).select("interaction_id", X.relative_time(F.col("last_accessed"), as_of()).alias("ago"))


@query("x15_time_weights", sql(f"SELECT interaction_id, round(exp(-((floor(epoch({NOW})) - floor(epoch(last_accessed))) / 3600.0) / 168.0), 8)::DOUBLE AS weight FROM interactions", "interactions"))
def time_weights(spark, folder):
    return interactions(spark, folder).select("interaction_id", F.round(W.time_weight(W.hours_between(F.col("last_accessed"), as_of())), 8).alias("weight"))


@query("x04_normalised", sql("SELECT vec_id, round(list_sum(list_transform(prompt_vector, lambda x: x::DOUBLE / sqrt(list_dot_product(prompt_vector::DOUBLE[], prompt_vector::DOUBLE[])))), 6)::DOUBLE AS total FROM vectors", "vectors"))
def normalised(spark, folder):
    return M.vectors(spark, folder).select("vec_id", F.round(F.aggregate(W.normalised(F.col("prompt_vector")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("m06_cascade", f"WITH {LOG} SELECT d.doc_id, l.passed AS is_validated FROM documents d JOIN log l USING (doc_id)")
def cascade(spark, folder):
    log = validation_log(spark, folder).select("doc_id", F.col("passed").alias("is_validated"))
    return read(spark, folder, "documents").select("doc_id").join(log, "doc_id")


@query("m04_revalidated", f"WITH {LOG} SELECT doc_id, CASE WHEN refs > 0 AND abs(1.0 - score) > 0.05 THEN 1.0 ELSE score END::DOUBLE AS score, CASE WHEN (CASE WHEN refs > 0 AND abs(1.0 - score) > 0.05 THEN 1.0 ELSE score END) >= 0.8 THEN 'validated' WHEN score >= 0.5 THEN 'pending' ELSE 'rejected' END AS status FROM log")
def revalidated(spark, folder):
    """Scores as they are once the contents are abstracted, where that moves them by more than 0.05."""
    log = validation_log(spark, folder)
    new = F.when((F.col("refs") > 0) & (F.abs(1.0 - F.col("score")) > 0.05), 1.0).otherwise(F.col("score"))
    return log.select("doc_id", new.alias("score")).withColumn("status", V.status(F.col("score")))


@query("m09_relationships", sql("SELECT source, target FROM (SELECT vec_id AS source, label AS target FROM vectors) WHERE source <> target GROUP BY ALL", "vectors"))
def new_relationships(spark, folder):
    v = M.vectors(spark, folder).select(F.col("vec_id").alias("source"), F.col("label").cast("long").alias("target"))
    return v.where("source <> target").dropDuplicates(["source", "target"]).select("source", F.col("target").cast("int").alias("target"))


@query("m11_changes_applied", sql("SELECT interaction_id, CASE WHEN session_id % 3 = 0 THEN 0.5 ELSE weight END::DOUBLE AS weight FROM interactions WHERE session_id % 8 <> 0", "interactions"))
def changes_applied(spark, folder):
    i = interactions(spark, folder)
    updates = i.where("session_id % 3 = 0").select("interaction_id", F.lit(0.5).alias("new_weight"))
    deletes = i.where("session_id % 8 = 0").select("interaction_id")
    return i.join(deletes, "interaction_id", "left_anti").join(updates, "interaction_id", "left").select("interaction_id", F.coalesce("new_weight", "weight").alias("weight"))


@query("a22_sync_rates", f"WITH {LOG} SELECT source, count(*) AS n, round(count(*) FILTER (passed)::DOUBLE / count(*), 8) AS success_rate FROM log JOIN documents USING (doc_id) GROUP BY source")
def sync_rates(spark, folder):
    log = validation_log(spark, folder).select("doc_id", "passed").join(read(spark, folder, "documents").select("doc_id", "source"), "doc_id")
    return log.groupBy("source").agg(F.count("*").alias("n"), F.round(F.count_if("passed") / F.count("*"), 8).alias("success_rate"))


@query("a33_rank_confidence", "SELECT user_id, round(sum(least(1.0, value / 100) / (r + 1)) / sum(1.0 / (r + 1)), 7)::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS r FROM events) GROUP BY user_id")
def rank_confidence(spark, folder):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    links = events(spark, folder).select(F.col("user_id").alias("query_id"), F.least(F.lit(1.0), F.col("value") / 100).alias("strength"), rank.alias("rank"))
    return I.overall_confidence(links).select(F.col("query_id").alias("user_id"), F.round("confidence", 7).alias("confidence"))


@query("a34_changed_fields", sql("SELECT interaction_id, CASE WHEN session_id % 2 = 0 THEN 'weight' ELSE '' END AS changed FROM interactions", "interactions"))
def changed_fields(spark, folder):
    old = F.create_map(F.lit("weight"), F.col("weight").cast("string"), F.lit("accesses"), F.col("access_count").cast("string"))
    new = F.create_map(F.lit("weight"), F.when(F.col("session_id") % 2 == 0, F.col("weight") + 1).otherwise(F.col("weight")).cast("string"), F.lit("accesses"), F.col("access_count").cast("string"))
    differ = F.map_filter(F.map_zip_with(old, new, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, d: d)
    return interactions(spark, folder).select("interaction_id", F.array_join(F.map_keys(differ), ",").alias("changed"))


@query("a36_feedback", "SELECT event_type, count(*) FILTER (value > 50) AS helpful, count(*) FILTER (value <= 50) AS not_helpful, round(avg(least(5, floor(value / 40) + 1)), 8)::DOUBLE AS rating FROM events GROUP BY event_type")
def feedback(spark, folder):
    e = events(spark, folder)
    return e.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("helpful"), F.count_if(F.col("value") <= 50).alias("not_helpful"), F.round(F.avg(F.least(F.lit(5), F.floor(F.col("value") / 40) + 1)), 8).alias("rating"))


@query("a30_coverage", "SELECT lang, round(count(*) FILTER (n_chars > 1000)::DOUBLE / count(*), 8) AS coverage FROM documents GROUP BY lang")
def coverage(spark, folder):
    return read(spark, folder, "documents").groupBy("lang").agg(F.round(F.count_if(F.col("n_chars") > 1000) / F.count("*"), 8).alias("coverage"))


@query("a21_conflicts", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'missing_file' WHEN doc_id % 5 = 0 THEN 'changed' END AS kind FROM documents) WHERE kind IS NOT NULL GROUP BY kind")
def conflicts(spark, folder):
    """Files lack every seventh document and add a line to every fifth."""
    d = read(spark, folder, "documents").select(F.col("doc_id").alias("note"), "text")
    files = d.where("note % 7 <> 0").withColumn("text", F.when(F.col("note") % 5 == 0, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text")))
    return O.conflicts(d, files).groupBy(F.col("conflict").alias("kind")).agg(F.count("*").alias("n"))


_TRIMMED = "list_transform(string_split({t}, chr(10)), lambda x: trim(x, ' '))"


@query("u06_unique_lines", f"WITH p AS (SELECT a.doc_id, {_TRIMMED.format(t='a.text')} AS mine, {_TRIMMED.format(t='b.text')} AS theirs FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1) SELECT doc_id, len(list_filter(theirs, lambda x: NOT list_contains(mine, x) AND length(x) > 10 AND NOT starts_with(x, '#')))::INTEGER AS lines FROM p")
def unique_lines(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("theirs"))
    return docs.join(other, "doc_id").select("doc_id", F.size(O.unique_lines(F.col("text"), F.col("theirs"))).alias("lines"))


@query("u08_scores_of_both", sql("SELECT 'interaction' AS what, count(*) AS n, round(avg(weight), 8) AS mean FROM interactions UNION ALL SELECT 'event', count(*), round(avg(value), 8) FROM events", "interactions"))
def scores_of_both(spark, folder):
    both = interactions(spark, folder).select(F.lit("interaction").alias("what"), F.col("weight").alias("x")).unionByName(events(spark, folder).select(F.lit("event").alias("what"), F.col("value").alias("x")))
    return both.groupBy("what").agg(F.count("*").alias("n"), F.round(F.avg("x"), 8).alias("mean"))


@query("d13_document_abstraction", f"WITH a AS (SELECT doc_id, text, {texts._ABSTRACT} AS a FROM documents) SELECT doc_id, len(regexp_extract_all(a, '{X.PLACEHOLDER}'))::BIGINT AS placeholders, round(length(a)::DOUBLE / greatest(1, length(text)), 8) AS ratio FROM a")
def document_abstraction(spark, folder):
    a = read(spark, folder, "documents").select("doc_id", "text", D.abstracted(F.col("text")).alias("a"))
    return a.select("doc_id", X.placeholder_count(F.col("a")).cast("long").alias("placeholders"), F.round(F.length("a") / F.greatest(F.lit(1), F.length("text")), 8).alias("ratio"))


@query("d14_map_abstraction", f"SELECT page_id, {texts._ABSTRACT.replace('text', 'url', 1)} AS url FROM pages")
def map_abstraction(spark, folder):
    """Abstracts each value of a map column."""
    m = read(spark, folder, "pages").select("page_id", F.transform_values(F.create_map(F.lit("url"), F.col("url")), lambda k, v: D.abstracted(v)).alias("m"))
    return m.select("page_id", F.try_element_at("m", F.lit("url")).alias("url"))


@query("v20_metadata_safety", f"SELECT event_id, {like('props', '(?i)(password|secret|token|api_key)')} AS sensitive FROM events")
def metadata_safety(spark, folder):
    keys = F.json_object_keys("props")
    held = F.exists(F.array(F.col("props")), lambda p: p.rlike("(?i)(password|secret|token|api_key)"))
    return events(spark, folder).where(keys.isNotNull() | F.col("props").isNotNull()).select("event_id", held.alias("sensitive"))


@query("v24_staleness", sql(f"SELECT interaction_id, CASE WHEN epoch({NOW} - last_accessed) > 86400 * 7 THEN 'stale' ELSE 'fresh' END AS verdict FROM interactions", "interactions"))
def staleness(spark, folder):
    old = F.unix_timestamp(as_of()) - F.unix_timestamp("last_accessed") > 86400 * 7
    return interactions(spark, folder).select("interaction_id", F.when(old, "stale").otherwise("fresh").alias("verdict"))


@query("n02_complexity_levels", "WITH c AS (SELECT (1 + " + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in N.BRANCHES) + ") AS n FROM documents) SELECT CASE WHEN n <= 5 THEN 'excellent' WHEN n <= 10 THEN 'good' WHEN n <= 20 THEN 'fair' ELSE 'poor' END AS level, count(*) AS documents FROM c GROUP BY level")
def complexity_levels(spark, folder):
    return read(spark, folder, "documents").groupBy(N.cyclomatic_level(N.cyclomatic(F.col("text"))).alias("level")).agg(F.count("*").alias("documents"))


_WORDS = "len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]'))"
_NAMES = "regexp_extract_all(text, '[a-zA-Z_][A-Za-z0-9_]*')"
_OPS = "regexp_extract_all(text, '[+\\-*/=<>!&|%^~]+')"
_CYCLO = "(1 + " + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in N.BRANCHES) + ")"


@query("n04_maintainability", f"SELECT doc_id, round(greatest(0.0, least(100.0, (171 - 5.2 * ln(greatest(1.0, {_WORDS} * log2(greatest(2, {_WORDS})))) - 0.23 * {_CYCLO} - 16.2 * ln(greatest(1, len(string_split(text, chr(10)))))) * 100 / 171)), 4)::DOUBLE AS maintainability, round(CASE WHEN len(list_distinct({_NAMES})) > 0 THEN len(list_distinct({_OPS})) / 2.0 * len({_NAMES}) / len(list_distinct({_NAMES})) ELSE 0.0 END, 4)::DOUBLE AS difficulty FROM documents")
def maintainability(spark, folder):
    t = F.col("text")
    return read(spark, folder, "documents").select("doc_id", F.round(N.maintainability(t), 4).alias("maintainability"), F.round(N.halstead_difficulty(t), 4).alias("difficulty"))


@query("l03_by_severity", "SELECT severity, pattern, n FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS severity, '{n}' AS pattern, count(*) AS n FROM documents WHERE {like('text', p)}" for _, n, s, p in D.CONCRETE) + ") WHERE n > 0")
def by_severity(spark, folder):
    v = read(spark, folder, "documents").select(F.explode(D.violations(F.col("text"))).alias("v")).groupBy("v.severity", "v.pattern").agg(F.count("*").alias("n"))
    order = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    return v.orderBy(order, "pattern").select("severity", "pattern", "n")


@query("h_revenue", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4)::DOUBLE AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2)::DOUBLE AS revenue FROM lineitem GROUP BY ALL")
def revenue(spark, folder):
    li = read(spark, folder, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).cast("double").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).cast("double").alias("revenue"))
