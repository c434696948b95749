"""Queries on sources and sinks, filters, joins, aggregates, ordering, sets and column functions (S to X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X
from lodestone.functions.rows import once
from lodestone.operators import detect as D
from lodestone.operators import graph as G
from lodestone.operators import intent as I
from lodestone.operators import memory as O
from lodestone.operators import spans as P
from lodestone.operators import validate as V
from lodestone.operators import views as VW
from lodestone.sources import files as FS
from lodestone.sources import model as M
from lodestone.sources import tables as T
from lodestone.sources.model import as_of, read, sql
from lodestone.sources.scratch import kept
from lodestone.streaming.jobs import scratch

from . import texts
from .base import like, query, quoted
from .graphs import STAR, star
from .memory import ASKED, CENTRES, EDGES, NOTES, RELATED, _asked, _queries, _related, cos, gram_sql, notes
from .views import LOG, NOW, events, interactions, validation_log

DOCS = "documents"


def documents(spark, folder):
    return read(spark, folder, DOCS)


# Sources and sinks


@query("s02_interactions_by_id", sql("SELECT interaction_id, session_id, interaction_type, weight, access_count, last_accessed FROM interactions WHERE interaction_id IN (SELECT user_id || ':' || event_type FROM events WHERE value > 100)", "interactions"))
def interactions_by_id(spark, folder):
    """The interactions of a batch of ids."""
    ids = events(spark, folder).where("value > 100").select(F.concat_ws(":", "user_id", "event_type").alias("interaction_id"))
    return interactions(spark, folder).join(ids, "interaction_id", "left_semi").select("interaction_id", "session_id", "interaction_type", "weight", "access_count", "last_accessed")


@query("s03_append", sql("SELECT interaction_type, count(*) AS n, min(memory_id) AS first_id, max(memory_id) AS last_id FROM memories GROUP BY interaction_type", "memories"))
def appended(spark, folder):
    """Memories appended in two batches to a table partitioned by type."""
    path, m = scratch(spark, "append"), M.memories(spark, folder)
    for part in (0, 1):
        T.append(m.where(F.pmod("session_id", F.lit(2)) == part), path, "interaction_type")
    return spark.read.parquet(path).groupBy(F.col("interaction_type").cast("string").alias("interaction_type")).agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"), F.max("memory_id").alias("last_id"))


@query("s04_append_with_vectors", "WITH old AS (SELECT label, max_by(embedding, vec_id) AS v FROM embeddings WHERE vec_id % 4 <> 3 GROUP BY label) SELECT e.vec_id, round(CASE WHEN e.vec_id % 4 = 3 THEN old.v[1] ELSE e.embedding[1] END, 6)::DOUBLE AS x FROM embeddings e LEFT JOIN old USING (label)")
def appended_with_vectors(spark, folder):
    """A quarter of the rows comes without a vector and takes that of its label's latest earlier row."""
    path = scratch(spark, "append")
    rows = read(spark, folder, "embeddings").select("vec_id", F.col("label").alias("session_id"), F.timestamp_seconds("vec_id").alias("created_at"), "embedding")
    T.append(rows.where("vec_id % 4 <> 3"), path)
    T.append_interactions(rows.where("vec_id % 4 = 3").withColumn("embedding", F.lit(None).cast("array<float>")), path, ["embedding"])
    return spark.read.parquet(path).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))


@query("s06_rules_in_use", sql("SELECT r.rule, r.severity, coalesce(n, 0)::BIGINT AS contents FROM rules r LEFT JOIN (SELECT rule, count(*) AS n FROM (" + texts._RULE_ROWS + ") GROUP BY rule) USING (rule) WHERE r.type = 'regex'", "rules"))
def rules_in_use(spark, folder):
    """The seeded rules and how many contents break each."""
    hits = D.detections(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), [r for r in M.RULES if r[1] == "regex"])
    seeds = M.detection_rules(spark).where("type = 'regex'")
    return seeds.join(hits.groupBy("rule").agg(F.count("*").alias("n")), "rule", "left").select("rule", "severity", F.coalesce("n", F.lit(0)).alias("contents"))


@query("s07_notes_round_trip", sql("SELECT memory_id AS note, array_to_string(list_slice(w, 1, 5), ' ') || CASE WHEN len(w) > 5 THEN '...' ELSE '' END AS title, length(rtrim(prompt, chr(10)))::BIGINT AS chars FROM (SELECT memory_id, prompt, list_filter(regexp_split_to_array(trim(prompt), '\\s+'), lambda x: x <> '') AS w FROM memories)", "memories"))
def notes_round_trip(spark, folder):
    """Memories written as Markdown notes, one file each, and read back with front matter, title and body."""
    path = scratch(spark, "notes")
    m = M.memories(spark, folder).select(F.col("memory_id").alias("note"), X.title(F.col("prompt")).alias("title"), F.col("prompt").alias("body"), X.hashtags(F.col("prompt")).alias("tags"))
    written = FS.write_notes(m, path)
    note = F.regexp_extract("file", r"note=([0-9]+)", 1).cast("long")
    return FS.notes(spark, path, written).select(note.alias("note"), F.try_element_at("front", F.lit("title")).alias("title"), F.length(F.rtrim(F.col("body"), F.lit("\n"))).cast("long").alias("chars"))


@query("s09_exports", sql("SELECT f.form, count(*) AS n, round(sum(weight), 6)::DOUBLE AS weight FROM interactions, (VALUES ('json'), ('csv')) f(form) GROUP BY f.form UNION ALL SELECT 'markdown', count(*), NULL FROM interactions", "interactions"))
def exports(spark, folder):
    """Interactions exported in three forms and read back."""
    path, rows = scratch(spark, "export"), interactions(spark, folder).select("interaction_id", "weight", "access_count")
    for form in ("json", "csv", "markdown"):
        FS.export(rows, f"{path}/{form}", form)
    schema = "interaction_id string, weight double, access_count long"
    both = [spark.read.schema(schema).json(f"{path}/json"), spark.read.schema(schema).option("header", True).csv(f"{path}/csv")]
    out = [df.agg(F.lit(form).alias("form"), F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight")) for form, df in zip(("json", "csv"), both)]
    lines = spark.read.text(f"{path}/markdown").where("value like '## %'")
    return out[0].unionByName(out[1]).unionByName(lines.agg(F.lit("markdown").alias("form"), F.count("*").alias("n"), F.lit(None).cast("double").alias("weight")))


SESSIONS = "SELECT user_id::VARCHAR AS session_id, count(*) AS samples, count(*) FILTER (event_type = 'error') AS alerts, round(avg(value), 6)::DOUBLE AS avg_cpu, max(value) AS max_cpu FROM events GROUP BY user_id ORDER BY min(ts)::TIMESTAMP(3) DESC, session_id LIMIT 100"


@query("s11_sessions", SESSIONS.replace("min(ts)::TIMESTAMP(3)", "date_trunc('second', min(ts))"))
def sessions(spark, folder):
    """A monitoring session a user; the last hundred are written as JSON, read back and summed up (A-26)."""
    path, e = scratch(spark, "sessions"), events(spark, folder)
    last = e.groupBy("user_id").agg(F.date_trunc("second", F.min("ts")).alias("started")).orderBy(F.desc("started"), F.col("user_id").cast("string")).limit(100)
    made = e.join(F.broadcast(last.select("user_id")), "user_id", "left_semi").groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        F.date_trunc("second", F.min("ts")).alias("started"),
        F.collect_list(F.struct("ts", F.col("value").alias("cpu"), (F.col("value") / 2).alias("memory"))).alias("system_metrics"),
        F.collect_list(F.when(F.col("event_type") == "error", F.struct("ts", F.col("event_type").alias("kind")))).alias("alerts"),
    )
    made.write.json(path)
    out = FS.session_summary(FS.sessions(spark, path))
    return out.select("session_id", "samples", F.col("alerts").cast("long").alias("alerts"), F.round("avg_cpu", 6).alias("avg_cpu"), "max_cpu")


@query("s12_suspicious_lines", "SELECT 'auth_failure' AS kind, count(*) AS n FROM events WHERE event_type = 'error' UNION ALL SELECT 'injection', count(*) FROM events WHERE event_type = 'signup'")
def suspicious_lines(spark, folder):
    """Log lines of events: errors are failed authentications, sign-ups hold a tautology."""
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("password authentication failed for user "), "user_id")).when(F.col("event_type") == "signup", F.concat(F.lit("id="), "user_id", F.lit(" OR 1 = 1"))).otherwise(F.col("event_type"))
    return FS.suspicious_lines(events(spark, folder).select(line.alias("value")))


_ABSTRACT_PROMPT = texts._ABSTRACT.replace("text", "prompt", 1)


@query("s13_changelog", sql(f"SELECT substring(sha256(memory_id::VARCHAR), 1, 8) AS hash, 'author_' || substring(sha256(session_id::VARCHAR), 1, 8) AS author, created_at AS ts, {_ABSTRACT_PROMPT} AS message FROM memories ORDER BY created_at DESC, sha256(memory_id::VARCHAR) LIMIT 10", "memories"))
def changelog(spark, folder):
    """Memories as commits: the last ten, messages abstracted, authors hidden."""
    m = M.memories(spark, folder)
    return FS.changelog(m.select(F.sha2(F.col("memory_id").cast("string"), 256).alias("hash"), F.col("session_id").cast("string").alias("author"), F.col("created_at").alias("ts"), F.col("prompt").alias("message")))


@query("s14_source_files", "SELECT item_id AS id, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS lines FROM benchmark")
def source_files(spark, folder):
    """Texts as files of a folder, read whole, one row each."""
    path = scratch(spark, "code")
    read(spark, folder, "benchmark").select("item_id", F.col("text").alias("value")).write.partitionBy("item_id").text(path)
    f = FS.code_files(spark, path).withColumn("text", F.regexp_replace("text", r"\n\z", ""))
    return f.select(F.regexp_extract("file", r"item_id=([0-9]+)", 1).cast("long").alias("id"), F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("lines"))


@query("s17_refreshed", sql(f"SELECT 'validated' AS view, count(*) AS n FROM interactions WHERE is_validated AND weight >= 0.3 UNION ALL SELECT 'active', count(*) FROM interactions WHERE is_validated AND weight > 0.2 AND last_accessed > {NOW} - INTERVAL 30 DAYS", "interactions"))
def refreshed(spark, folder):
    """Two materialised views rebuilt twice."""
    path, i = scratch(spark, "views"), interactions(spark, folder)
    views = {"validated": lambda: VW.validated(i), "active": lambda: VW.active(i, as_of(), least=0.2)}
    for _ in range(2):
        T.refresh(spark, views, path)
    out = [spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("view"), F.count("*").alias("n")) for n in views]
    return out[0].unionByName(out[1])


# Filters


@query("f01_validated", sql("SELECT interaction_id FROM interactions WHERE is_validated AND weight >= 0.25", "interactions"))
def validated(spark, folder):
    return VW.validated(interactions(spark, folder), 0.25).select("interaction_id")


@query("f02_active", sql(f"SELECT interaction_id FROM interactions WHERE is_validated AND weight > 0.25 AND last_accessed > {NOW} - INTERVAL 3 DAYS", "interactions"))
def active(spark, folder):
    return VW.active(interactions(spark, folder), as_of(), 3, 0.25).select("interaction_id")


@query("f07_listed", sql(f"SELECT interaction_id, last_accessed FROM interactions WHERE interaction_type IN ('debugging', 'documentation') AND last_accessed > {NOW} - INTERVAL 20 DAYS ORDER BY last_accessed DESC, interaction_id LIMIT 50", "interactions"))
def listed(spark, folder):
    """A list by type and age; it asks for more than a list may hold."""
    return VW.listed(interactions(spark, folder), as_of(), ["debugging", "documentation"], 20, 200).select("interaction_id", "last_accessed")


@query("f10_edges", sql("SELECT a.memory_id AS source, b.memory_id AS target FROM memories a JOIN memories b ON a.session_id = b.session_id AND a.memory_id <> b.memory_id AND b.created_at >= a.created_at AND b.created_at <= a.created_at + INTERVAL 24 HOURS WHERE 1 - epoch(b.created_at - a.created_at) / 3600 / 24 >= 0.998 AND a.memory_id % 4 <> 0", "memories"))
def edges(spark, folder):
    """Edges of a kind, of a least weight and confidence."""
    e = G.follows(O.within_hours(M.memories(spark, folder), 24, ["session_id"])).withColumn("confidence", F.when(F.col("source") % 4 == 0, 0.2).otherwise(0.9))
    return G.edges_of(e, ["follows"], 0.998, 0.5).select("source", "target")


_CONCRETE_PROMPT = " OR ".join(like("prompt", p) for *_, p in D.CONCRETE)
TEMPORAL = f"{ASKED}, temporal AS (SELECT q.memory_id AS query_id, q.intent, m.memory_id, 'temporal' AS kind, CASE WHEN abs(epoch(q.created_at - m.created_at)) / 3600 <= 24 THEN least(1.0, greatest(0.0, 1 - abs(epoch(q.created_at - m.created_at)) / 3600 / 24) * CASE WHEN {{REL}} THEN 1.2 ELSE 1.0 END) END AS strength FROM asked q JOIN asked m ON q.session_id = m.session_id AND q.memory_id <> m.memory_id)"
TEMPORAL = TEMPORAL.replace("{REL}", "(" + " OR ".join(f"(q.intent IN ({', '.join(map(quoted, g))}) AND m.intent IN ({', '.join(map(quoted, g))}))" for g in I.GROUPS) + ")")


@query("f11_safe_connections", sql(f"{TEMPORAL} SELECT query_id, t.memory_id FROM temporal t JOIN memories m ON m.memory_id = t.memory_id WHERE strength >= 0.3 AND NOT ({_CONCRETE_PROMPT})", "memories"))
def safe_connections(spark, folder):
    asked = _asked(spark, folder)
    concrete = M.memories(spark, folder).select("memory_id", (F.size(D.violations(F.col("prompt"))) > 0).alias("has_concrete"))
    return I.safe(I.temporal_connections(_queries(asked), asked, least=0.0), concrete).select("query_id", "memory_id")


@query("f12_non_directive", r"SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches(lower(text), '\b(should|must|need to|have to|ought to)\b')")
def non_directive(spark, folder):
    """Turns, taken as explanations, that don't tell the reader what to do."""
    return I.non_directive(read(spark, folder, "conversations").withColumnRenamed("text", "explanation")).select("conv_id", "turn")


@query("f14_length_buckets", "SELECT CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'medium' WHEN length(text) < 2000 THEN 'long' ELSE 'very_long' END AS bucket, count(*) AS n FROM documents GROUP BY bucket")
def length_buckets(spark, folder):
    return documents(spark, folder).groupBy(X.length_bucket(F.col("text")).alias("bucket")).agg(F.count("*").alias("n"))


@query("f15_visible", f"WITH {LOG} SELECT 'admin' AS role, count(*) AS n FROM log UNION ALL SELECT 'auditor', count(*) FROM log WHERE NOT passed UNION ALL SELECT 'user', count(*) FROM log WHERE score >= 0.8")
def visible(spark, folder):
    log = kept(validation_log(spark, folder).select("passed", "score"))  # three roles read what is scored once
    out = [T.visible(log, r).agg(F.lit(r).alias("role"), F.count("*").alias("n")) for r in ("admin", "auditor", "user")]
    return out[0].unionByName(out[1]).unionByName(out[2])


CENTRAL = f"{STAR}, n AS (SELECT count(*) AS n FROM nodes), central AS (SELECT id, (coalesce(o, 0) + coalesce(i, 0))::DOUBLE / (n - 1) AS centrality FROM nodes CROSS JOIN n LEFT JOIN (SELECT source AS id, count(*) AS o FROM sedges GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM sedges GROUP BY 1) USING (id))"


@query("f20_export_filter", f"WITH {CENTRAL}, few AS (SELECT id FROM central WHERE centrality >= 0.0002 ORDER BY centrality DESC, id LIMIT 30) SELECT source, target FROM sedges WHERE source IN (SELECT id FROM few) AND target IN (SELECT id FROM few)")
def export_filter(spark, folder):
    """The edges among the 30 most central nodes of a least centrality."""
    nodes, e = star(spark, folder)
    c = G.centrality(nodes, e)
    return G.queried(c, e, F.col("centrality") >= 0.0002, [F.desc("centrality"), F.col("id")], 30)[1].select("source", "target")


DEGREE = f"{STAR}, deg AS (SELECT id, coalesce(o, 0) AS o, coalesce(i, 0) AS i FROM nodes LEFT JOIN (SELECT source AS id, count(*) AS o FROM sedges GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM sedges GROUP BY 1) USING (id))"


@query("f21_coupling_band", f"WITH {DEGREE} SELECT id, least(1.0, (o + i) / 10.0)::DOUBLE AS coupling, CASE WHEN o + i > 7 THEN 'high' WHEN o + i > 3 THEN 'medium' ELSE 'low' END AS band FROM deg WHERE o + i > 3 OR o + i = 0")
def coupling_band(spark, folder):
    """Coupled nodes by band, and those that depend on nothing."""
    d = G.banded(G.degrees(*star(spark, folder)))
    return d.where("band <> 'low' or isolated").select("id", "coupling", "band")


@query("f22_by_category", "WITH t AS (SELECT doc_id, lang, source, contains(text, '@') AS refers FROM documents) SELECT source AS category, count(*) AS n, count(*) FILTER (refers) AS referring FROM t WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT lang, count(*), count(*) FILTER (refers) FROM t WHERE lang IS NOT NULL GROUP BY lang")
def by_category(spark, folder):
    """Documents by category, from the source or from a tag, and those of each that refer to an address."""
    d = documents(spark, folder).select("doc_id", F.col("source").alias("category"), F.array("lang").alias("tags"), F.col("text").contains("@").alias("refers"))
    return VW.by_category(d).groupBy("category").agg(F.count("*").alias("n"), F.count_if("refers").alias("referring"))


# Joins


@query("j04_one_row_source", sql(f"one AS (SELECT prompt_vector AS q, vec_id AS source_id FROM vectors ORDER BY vec_id LIMIT 1), s AS (SELECT source_id, vec_id, greatest({cos('prompt_vector', 'q')}, {cos('response_vector', 'q')}) AS score FROM vectors, one WHERE vec_id <> source_id) SELECT (row_number() OVER (ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, round(score, 8) AS score FROM s WHERE score >= 0.1 QUALIFY row_number() OVER (ORDER BY score DESC, vec_id) <= 20", "vectors"))
def one_row_source(spark, folder):
    """The twenty nearest to one vector, the first."""
    v = M.vectors(spark, folder)
    one = v.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("source_id"), F.col("prompt_vector").alias("vector"))
    return O.related_vectors(v, one, 0.1, 20).select("rank", "vec_id", F.round("score", 8).alias("score"))


@query("j05_kind_or_similar", sql("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN k = 1 AND vec_id % 3 = 0 THEN 'continuation' ELSE 'similar' END AS kind FROM vectors, (VALUES (1), (2)) s(k)) GROUP BY kind", "vectors"))
def kind_or_similar(spark, folder):
    v = M.vectors(spark, folder).select("vec_id")
    related = v.select(F.col("vec_id").alias("source_id"), F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 2)).alias("vec_id"))
    known = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"), F.lit("continuation").alias("kind"))
    return O.labelled(related, known).groupBy("kind").agg(F.count("*").alias("n"))


@query("j13_conflict_references", f"SELECT v.doc_id AS note, CASE WHEN v.doc_id % 7 = 0 THEN 'missing_file' ELSE 'changed' END AS conflict, v.kind, v.value FROM ({texts._VALUES}) v WHERE v.doc_id % 7 = 0 OR v.doc_id % 5 = 0")
def conflict_references(spark, folder):
    """The references that stand in notes with a conflict. Files lack every seventh note and add a line to every fifth."""
    d = documents(spark, folder).select(F.col("doc_id").alias("note"), "text")
    files = d.where("note % 7 <> 0").withColumn("text", F.when(F.col("note") % 5 == 0, F.concat("text", F.lit("\none more line"))).otherwise(F.col("text")))
    refs = d.select("note", F.explode(D.found_values(F.col("text"))).alias("v")).select("note", "v.kind", "v.value")
    return O.conflicts(d, files).select("note", "conflict").join(refs, "note").select("note", "conflict", "kind", "value")


@query("j15_rules_by_content", f"SELECT doc_id AS id, rule FROM ({texts._RULE_ROWS})")
def rules_by_content(spark, folder):
    rules = [r for r in M.RULES if r[1] == "regex"]
    return D.detections(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), rules).select("id", "rule")


@query("j18_containment", "SELECT 'n' || n_nationkey AS source, 's' || s_suppkey AS target FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def containment(spark, folder):
    parents = read(spark, folder, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return G.contains(parents, read(spark, folder, "supplier").select(F.col("s_nationkey").alias("key"), F.concat(F.lit("s"), "s_suppkey").alias("id")), "key").select("source", "target")


_GROUPS = ", ".join(f"({i}, {quoted(x)})" for i, g in enumerate(I.GROUPS) for x in g)


@query("j19_intent_groups", sql(f"{I.oracle('prompt')} SELECT g.grp, count(*) AS n FROM best JOIN (VALUES {_GROUPS}) g(grp, intent) USING (intent) GROUP BY g.grp", "memories"))
def intent_groups(spark, folder):
    """Memories by the groups that their intents belong to: a join with a small dimension."""
    best = I.best_intent(M.memories(spark, folder), "memory_id", "prompt")
    return best.join(F.broadcast(I.group_dimension(spark)), "intent").groupBy("grp").agg(F.count("*").alias("n"))


@query("j20_member_texts", f"SELECT e.label, count(*) AS members, sum(length(a.a))::BIGINT AS chars FROM embeddings e JOIN (SELECT doc_id, {texts._ABSTRACT} AS a FROM documents) a ON a.doc_id = e.vec_id GROUP BY e.label")
def member_texts(spark, folder):
    """Cluster members whose abstracted text is there."""
    told = once(documents(spark, folder).select(F.col("doc_id").alias("vec_id"), "text"), n=F.length(D.abstracted(F.col("text"))))
    both = read(spark, folder, "embeddings").select("vec_id", "label").join(told.select("vec_id", "n"), "vec_id")  # lengths move, not texts
    return both.groupBy("label").agg(F.count("*").alias("members"), F.sum("n").cast("long").alias("chars"))


PATHS = r"SELECT regexp_extract(url, '((/[a-zA-Z0-9_.-]+)+)', 1) AS pattern, count(*) AS n FROM pages GROUP BY 1"
EVOLVED = f"(SELECT pattern, n, regexp_replace(pattern, '[0-9]+', '[0-9]+', 'g') AS evolved FROM ({PATHS}) WHERE length(pattern) >= 5)"


def learned_paths(spark, folder):
    return D.learned(read(spark, folder, "pages").select(F.col("url").alias("text"), F.lit("file_path").alias("type")))


@query("j21_promoted", f"SELECT evolved AS pattern, n AS detections FROM {EVOLVED}")
def promoted(spark, folder):
    """Patterns learnt from the paths of URLs, with the evolved form in place of those that have one."""
    p = learned_paths(spark, folder)
    return D.updated(p, D.evolved(p, 0.4, 0)).select("pattern", "detections")


@query("d12_evolved", f"SELECT pattern, 'file_path' AS type, evolved, round(least(1.0, 0.5 + 0.05 * (n - 1)), 6)::DOUBLE AS fitness, least(1.0, 0.5 + 0.05 * (n - 1)) > 0.9 AS promoted FROM {EVOLVED} WHERE evolved <> pattern")
def evolved(spark, folder):
    """Generalised forms of the patterns learnt from URLs."""
    return D.evolved(learned_paths(spark, folder), 0.4, 0).withColumn("fitness", F.round("fitness", 6))


# Aggregates, windows, ordering, sets


@query("a12_cluster_maintenance", sql(f"{CENTRES} SELECT label, count(*) AS members, round(avg(score), 7) AS avg_score FROM members WHERE score >= 0.1 GROUP BY label", "vectors"))
def cluster_maintenance(spark, folder):
    v = M.vectors(spark, folder)
    kept = O.memberships(v, O.centroids(v)).where("score >= 0.1")
    return O.cluster_statistics(kept).select("label", "members", F.round("avg_score", 7).alias("avg_score"))


@query("a18_composite", f"WITH {texts.SCORED} SELECT source, sum(refs)::BIGINT AS violations, sum(critical)::BIGINT AS critical, round(avg(CASE WHEN critical > 0 THEN 0.0 ELSE greatest(0.0, score - refs * 0.1) END), 6)::DOUBLE AS composite FROM scored GROUP BY source")
def composite(spark, folder):
    s = texts.scored(spark, folder).withColumn("composite", V.composite_score(F.col("refs"), F.col("critical"), F.col("score")))
    return s.groupBy("source").agg(F.sum("refs").cast("long").alias("violations"), F.sum("critical").cast("long").alias("critical"), F.round(F.avg("composite"), 6).alias("composite"))


@query("a26_session_summary", "SELECT user_id::VARCHAR AS session_id, count(*) AS samples, round(avg(value / 2), 6)::DOUBLE AS avg_memory, max(value) AS max_cpu FROM events GROUP BY user_id")
def session_summary(spark, folder):
    """Sessions as they come, summed up without their samples in one row."""
    e = events(spark, folder).groupBy(F.col("user_id").cast("string").alias("session_id"))
    return e.agg(F.count("*").alias("samples"), F.round(F.avg(F.col("value") / 2), 6).alias("avg_memory"), F.max("value").alias("max_cpu"))


@query("w07_without_overlaps", "SELECT page_id, 2::BIGINT AS kept, (2 * length(url))::BIGINT AS chars FROM pages")
def without_overlaps(spark, folder):
    """Spans of two URLs and of the paths inside them: only the URLs, which come first, stay."""
    rules = (*[p for p in P.PATTERNS if p[0] == "http_url"], P.checked("host", "url", r"[a-z]+\.example\.com[^ ]*"))
    both = F.concat("url", F.lit(" "), "url")
    s = read(spark, folder, "pages").select("page_id", P.without_overlaps(P.extracted(both, rules)).alias("s"))
    return s.select("page_id", F.size("s").cast("long").alias("kept"), F.aggregate("s", F.lit(0), lambda a, x: a + x["stop"] - x["start"]).cast("long").alias("chars"))


BOOSTED = f"{RELATED}, {CENTRES}, sizes AS (SELECT label, count(*) AS n FROM members GROUP BY label), boosted AS (SELECT source_id AS query_id, r.vec_id AS id, m.label, r.score * (1 + 0.2 * m.score) * (1 + 0.01 * least(s.n, 10)) AS boosted FROM related r JOIN members m USING (vec_id) JOIN sizes s ON s.label = m.label)"


@query("w11_boosted_ranks", sql(f"{BOOSTED} SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id))::INTEGER AS rank, id, round(boosted, 6)::DOUBLE AS boosted FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id) <= 5", "vectors"))
def boosted_ranks(spark, folder):
    v = M.vectors(spark, folder)
    members = O.memberships(v, O.centroids(v))
    hits = _related(spark, folder).select(F.col("source_id").alias("query_id"), F.col("vec_id").alias("id"), "score")
    return O.boosted_search(hits, members, members.groupBy("label").agg(F.count("*").alias("members")), 5).select("query_id", "rank", "id", F.round("boosted", 6).alias("boosted"))


@query("l07_sorted_by_name", sql("SELECT interaction_id, access_count FROM interactions ORDER BY access_count DESC, interaction_id LIMIT 20 OFFSET 20", "interactions"))
def sorted_by_name(spark, folder):
    """The second page by a column that a caller named."""
    return VW.sorted_page(interactions(spark, folder), "access_count", "desc", ["weight", "access_count", "last_accessed"], "interaction_id", 2).select("interaction_id", "access_count")


@query("l09_candidates", sql("SELECT interaction_id FROM interactions ORDER BY last_accessed DESC, interaction_id LIMIT 500", "interactions"))
def candidates(spark, folder):
    """The 500 rows accessed last, which clustering starts from."""
    return VW.candidates(interactions(spark, folder), 500).select("interaction_id")


@query("u01_walk", f"WITH RECURSIVE {STAR}, w AS (SELECT id, 0 AS depth FROM nodes WHERE type = 'region' UNION ALL SELECT target, depth + 1 FROM w JOIN sedges ON source = id WHERE depth < 3) SELECT id, min(depth)::INTEGER AS depth FROM w GROUP BY id")
def walk(spark, folder):
    nodes, e = star(spark, folder)
    return G.walk(e, nodes.where("type = 'region'"), 3)


def _scores(column: str, name: str) -> str:
    parts = []
    for intent, patterns in I.PATTERNS.items():
        n = " + ".join(f"regexp_matches(lower({column}), {quoted(p)})::INT" for p in patterns)
        parts.append(f"SELECT memory_id, '{intent}' AS intent, least(1.0, ({n})::DOUBLE / {len(patterns)} * 1.5) AS score FROM memories WHERE ({n}) > 0")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


UNITED = f"{_scores('prompt', 'ps')}, {_scores('response', 'rs')}, united AS (SELECT memory_id, intent, coalesce(p.score, 0.0) * 0.6 + coalesce(r.score, 0.0) * 0.4 AS score FROM ps p FULL JOIN rs r USING (memory_id, intent))"


@query("u03_united_scores", sql(f"{UNITED} SELECT memory_id, intent, round(score, 6)::DOUBLE AS score FROM united", "memories"))
def united_scores(spark, folder):
    """Scores of the prompt's and the response's intents: all that either has."""
    m = M.memories(spark, folder)
    both = [m.select("memory_id", F.explode(I.pattern_scores(F.col(c))).alias("s")).select("memory_id", "s.intent", F.col("s.score").alias(c)) for c in ("prompt", "response")]
    out = both[0].join(both[1], ["memory_id", "intent"], "full_outer")
    return out.select("memory_id", "intent", F.round(F.coalesce("prompt", F.lit(0.0)) * 0.6 + F.coalesce("response", F.lit(0.0)) * 0.4, 6).alias("score"))


@query("u05_shared_tags", f"WITH {NOTES} SELECT a.note, len(list_intersect(a.tags, b.tags))::BIGINT AS shared FROM notes a JOIN notes b ON b.note = a.note + 1")
def shared_tags(spark, folder):
    n = notes(spark, folder)
    return n.join(n.select((F.col("note") - 1).alias("note"), F.col("tags").alias("other")), "note").select("note", F.size(F.array_intersect("tags", "other")).cast("long").alias("shared"))


@query("u07_distinct_tags", f"WITH {NOTES} SELECT tag, count(*) AS notes FROM (SELECT note, unnest(tags) AS tag FROM notes) GROUP BY tag")
def distinct_tags(spark, folder):
    return notes(spark, folder).select("note", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("notes"))


# Column functions


@query("x01_trigrams", sql(f"g AS (SELECT memory_id, {gram_sql('prompt')} AS a, {gram_sql('response')} AS b FROM memories), s AS (SELECT memory_id, len(list_intersect(a, b)) AS i, len(a) AS n, len(b) AS m FROM g) SELECT memory_id, round(CASE WHEN n + m - i > 0 THEN i::DOUBLE / (n + m - i) ELSE 0.0 END, 8)::DOUBLE AS similarity FROM s", "memories"))
def trigrams(spark, folder):
    m = M.memories(spark, folder)
    return m.select("memory_id", F.round(X.trigram_similarity(X.trigrams(F.col("prompt")), X.trigrams(F.col("response"))), 8).alias("similarity"))


@query("x03_greatest_cosine", sql(f"one AS (SELECT prompt_vector AS q FROM vectors ORDER BY vec_id LIMIT 1) SELECT vec_id, round(greatest({cos('prompt_vector', 'q')}, {cos('response_vector', 'q')}), 8)::DOUBLE AS score FROM vectors, one", "vectors"))
def greatest_cosine(spark, folder):
    v = M.vectors(spark, folder)
    one = F.broadcast(v.orderBy("vec_id").limit(1).select(F.col("prompt_vector").alias("q")))  # one row
    score = F.greatest(W.cosine(F.col("prompt_vector"), F.col("q")), W.cosine(F.col("response_vector"), F.col("q")))
    return v.crossJoin(one).select("vec_id", F.round(score, 8).alias("score"))


@query("x07_cache_keys", "SELECT doc_id, sha256(text) || ':code:large:' || 'python' AS key FROM documents")
def cache_keys(spark, folder):
    return documents(spark, folder).select("doc_id", X.cache_key(F.col("text"), "large", "code", "python").alias("key"))


_A = f"(SELECT doc_id, {texts._ABSTRACT} AS a FROM documents)"
_HELD = f"regexp_extract_all(a, '{X.PLACEHOLDER}')"


@query("x09_placeholders", f"SELECT doc_id, len({_HELD})::BIGINT AS n, array_to_string({_HELD}, ' ') AS list FROM {_A}")
def placeholders(spark, folder):
    a = documents(spark, folder).select("doc_id", D.abstracted(F.col("text")).alias("a"))
    return a.select("doc_id", X.placeholder_count(F.col("a")).cast("long").alias("n"), F.array_join(X.placeholders(F.col("a")), " ").alias("list"))


@query("x10_density", f"SELECT doc_id, round(CASE WHEN length(a) > 0 THEN len({_HELD}) * 100.0 / length(a) ELSE 1.0 END, 8)::DOUBLE AS density FROM {_A}")
def density(spark, folder):
    return documents(spark, folder).select("doc_id", F.round(X.placeholder_density(D.abstracted(F.col("text"))), 8).alias("density"))


@query("x12_elapsed", sql(f"SELECT interaction_id, floor((floor(epoch({NOW})) - floor(epoch(last_accessed))) / 86400)::BIGINT AS days, round((floor(epoch({NOW})) - floor(epoch(last_accessed))) / 3600.0, 6)::DOUBLE AS hours FROM interactions", "interactions"))
def elapsed(spark, folder):
    t = F.col("last_accessed")
    return interactions(spark, folder).select("interaction_id", W.days_between(t, as_of()).cast("long").alias("days"), F.round(W.hours_between(t, as_of()), 6).alias("hours"))


@query("x14_reinforced", sql("SELECT interaction_id, round(greatest(least(weight * d.factor * 1.2, 1.0), weight * 1.1), 8)::DOUBLE AS weight FROM interactions JOIN decay d USING (interaction_type)", "interactions", "decay"))
def reinforced(spark, folder):
    both = interactions(spark, folder).join(F.broadcast(M.decay_config(spark)), "interaction_type")  # a row a type
    return both.select("interaction_id", F.round(W.reinforced(F.col("weight"), F.col("factor"), 1.2), 8).alias("weight"))


@query("x16_boosted", sql(f"{CENTRES}, sizes AS (SELECT label, count(*) AS n FROM members GROUP BY label) SELECT vec_id, round(0.5 * (1 + 0.2 * score) * (1 + 0.01 * least(n, 10)), 7)::DOUBLE AS boosted FROM members JOIN sizes USING (label)", "vectors"))
def boosted(spark, folder):
    v = M.vectors(spark, folder)
    m = O.memberships(v, O.centroids(v))
    return m.join(m.groupBy("label").agg(F.count("*").alias("n")), "label").select("vec_id", F.round(W.boosted(F.lit(0.5), F.col("score"), F.col("n")), 7).alias("boosted"))


_RELATED_TO_Q = "(" + " OR ".join(f"('question' IN ({', '.join(map(quoted, g))}) AND intent IN ({', '.join(map(quoted, g))}))" for g in I.GROUPS) + ")"


@query("x17_intent_boost", sql(f"{I.oracle('prompt')} SELECT memory_id, CASE WHEN intent = 'question' THEN 0.3 WHEN {_RELATED_TO_Q} THEN 0.1 ELSE 0.0 END::DOUBLE AS boost FROM best", "memories"))
def intent_boost(spark, folder):
    best = I.best_intent(M.memories(spark, folder), "memory_id", "prompt")
    return best.select("memory_id", I.boost(F.lit("question"), F.col("intent")).alias("boost"))


_ENTITIES = "list_slice(list_sort(list_distinct(flatten([" + ", ".join(f"regexp_extract_all(prompt, {quoted(p)})" for p in X.ENTITY_PATTERNS) + "]))), 1, 5)"


@query("x24_entities", sql(f"SELECT memory_id, array_to_string({_ENTITIES}, '|') AS entities FROM (SELECT memory_id, regexp_replace(prompt, '[^ -~]', '', 'g') AS prompt FROM memories)", "memories"))
def entities(spark, folder):
    """Names in prompts, of their plain letters: engines differ in what bounds a word beside others."""
    plain = F.regexp_replace("prompt", "[^ -~]", "")
    return M.memories(spark, folder).select("memory_id", F.array_join(X.entities(plain), "|").alias("entities"))


@query("x28_templates", sql("SELECT interaction_id, 'Type ' || interaction_type || CASE WHEN is_validated THEN ' (checked)' ELSE '' END || ': ' || access_count || ' accesses [' || interaction_type || ';' || session_id || ';]' AS line FROM interactions", "interactions"))
def templates(spark, folder):
    i = interactions(spark, folder)
    values = {"kind": F.col("interaction_type"), "ok": F.when(F.col("is_validated"), "yes"), "n": F.col("access_count"), "parts": F.array("interaction_type", F.col("session_id").cast("string"))}
    return i.select("interaction_id", X.filled("Type {{kind}}{{#if ok}} (checked){{/if}}: {{n}} accesses [{{#each parts}}{{this}};{{/each}}]", values).alias("line"))


@query("x29_token_estimates", "SELECT conv_id, turn, ceil(length(text) / 4.0)::BIGINT AS tokens FROM conversations")
def token_estimates(spark, folder):
    return read(spark, folder, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))


@query("x32_identifier_classes", "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '<getter_method>' WHEN 1 THEN '<setter_method>' WHEN 2 THEN '<predicate_method>' WHEN 3 THEN '<private_member>' WHEN 4 THEN '<constant>' ELSE '<class_name>' END AS cls FROM customer")
def identifier_classes(spark, folder):
    """Names made of customers' names, by turns of six shapes."""
    n = F.regexp_replace("c_name", "#", "_")
    shapes = [F.concat(F.lit("get_"), n), F.concat(F.lit("set_"), n), F.concat(F.lit("is_"), n), F.concat(F.lit("_"), n), F.upper(n), n]
    c = read(spark, folder, "customer")
    return c.select("c_custkey", X.identifier_class(F.element_at(F.array(*shapes), (F.pmod("c_custkey", F.lit(6)) + 1).cast("int"))).alias("cls"))


@query("x33_combined_weight", sql("SELECT a.memory_id AS a, b.memory_id AS b, round(0.9 * (0.5 + 0.5 * (a.memory_id % 2)) * exp(-(epoch(b.created_at - a.created_at) / 3600.0) / 168.0), 8)::DOUBLE AS weight FROM memories a JOIN memories b ON a.session_id = b.session_id AND a.memory_id <> b.memory_id AND b.created_at >= a.created_at AND b.created_at <= a.created_at + INTERVAL 24 HOURS", "memories"))
def combined_weight(spark, folder):
    near = O.within_hours(M.memories(spark, folder), 24, ["session_id"])
    weight = W.combined_weight(F.lit(0.9), 0.5 + 0.5 * (F.col("a") % 2), W.time_weight(F.col("hours")))
    return near.select("a", "b", F.round(weight, 8).alias("weight"))


@query("x36_reference_types", f"SELECT kind, type, count(*) AS n FROM (SELECT kind, CASE WHEN contains(value, '/') OR contains(value, '\\') THEN 'file_path' WHEN contains(value, '://') THEN 'url' WHEN contains(value, '@') AND contains(value, '.') THEN 'user_data' WHEN regexp_matches(lower(value), 'password|token|key') THEN 'credential' ELSE 'variable' END AS type FROM ({texts._VALUES})) GROUP BY ALL")
def reference_types(spark, folder):
    v = documents(spark, folder).select(F.explode(D.found_values(F.col("text"))).alias("v"))
    return v.groupBy(F.col("v.kind").alias("kind"), X.reference_type(F.col("v.value")).alias("type")).agg(F.count("*").alias("n"))


@query("x37_is_code", f"SELECT page_id, {texts._signs('lower(html)', X.CODE_SIGNS)} >= 3 AS is_code FROM pages")
def is_code(spark, folder):
    return read(spark, folder, "pages").select("page_id", X.is_code(F.col("html")).alias("is_code"))


@query("x38_formatted", f"SELECT page_id, length(CASE WHEN {texts._signs('lower(html)', X.CODE_SIGNS)} >= 3 THEN '```' || chr(10) || html || chr(10) || '```' WHEN suffix(trim(html), '?') THEN '> ' || html ELSE html END)::BIGINT AS chars FROM pages")
def formatted(spark, folder):
    return read(spark, folder, "pages").select("page_id", F.length(X.formatted(F.col("html"))).cast("long").alias("chars"))


@query("x39_thresholds", "SELECT user_id, least(80 + 5 * (count(*) - 1), 90)::BIGINT AS threshold FROM events WHERE event_type = 'error' GROUP BY user_id")
def thresholds(spark, folder):
    n = events(spark, folder).where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", W.dynamic_threshold(F.col("n")).cast("long").alias("threshold"))
