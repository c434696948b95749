"""Queries on abstraction, validation, jobs, graphs, clusters, intents, code, streams and registered functions (D to P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import registered as R
from lodestone.functions import text as X
from lodestone.functions.rows import once
from lodestone.operators import clusters as C
from lodestone.operators import code as N
from lodestone.operators import detect as D
from lodestone.operators import graph as G
from lodestone.operators import intent as I
from lodestone.operators import memory as O
from lodestone.operators import spans as P
from lodestone.operators import validate as V
from lodestone.operators import views as VW
from lodestone.operators import scopes as SC
from lodestone.sources import model as M
from lodestone.sources import tables as T
from lodestone.sources.model import as_of, read, sql
from lodestone.sources.scratch import kept
from lodestone.streaming import jobs as S

from . import texts
from .base import like, query, quoted
from .memory import CENTRES, EDGES, RELATED, _asked, _queries, _related, cos, sources
from .more import source, stream
from .views import DECAYED, LOG, NOW, events, interactions, validation_log
from .wider import EVOLVED, TEMPORAL, UNITED, documents, learned_paths

# Abstraction


@query("d04_by_type", f"SELECT kind, abstraction, count(*) AS n FROM (SELECT kind, CASE kind WHEN 'email' THEN '<email>' WHEN 'ip_address' THEN CASE WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) THEN '<private_ip>' WHEN a = 192 AND b = 168 THEN '<local_ip>' WHEN value = '127.0.0.1' THEN '<localhost>' WHEN value IN ('8.8.8.8', '8.8.4.4', '1.1.1.1') THEN '<public_dns>' ELSE '<public_ip>' END ELSE '<credential>' END AS abstraction FROM (SELECT kind, value, try_cast(split_part(value, '.', 1) AS INT) AS a, try_cast(split_part(value, '.', 2) AS INT) AS b FROM ({texts._VALUES}) WHERE kind IN ('email', 'ip_address', 'credential'))) GROUP BY ALL")
def by_type(spark, folder):
    """What stands for each value, by its type."""
    v = documents(spark, folder).select(F.explode(D.found_values(F.col("text"))).alias("v")).select("v.kind", "v.value").where("kind in ('email', 'ip_address', 'credential')")
    return v.groupBy("kind", P.by_type(F.col("kind"), F.col("value")).alias("abstraction")).agg(F.count("*").alias("n"))


@query("d05_by_rule", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '<email_address>' WHEN 1 THEN 'get_<entity>_by_id' WHEN 2 THEN '/api/<version>/customer/<resource_id>' ELSE '<mac_address>' END AS abstraction FROM customer")
def by_rule(spark, folder):
    """Values made of customers' keys, in turn of four kinds, as the rules write them."""
    k = F.col("c_custkey").cast("string")
    two = F.lpad(F.hex(F.pmod("c_custkey", F.lit(256))), 2, "0")
    kinds = [F.concat(F.lit("user"), k, F.lit("@example.com")), F.concat(F.lit("get_c"), k, F.lit("_by_id")), F.concat(F.lit("/api/v1/customer/"), k), F.concat(F.lit("00:11:22:33:44:"), two)]
    return read(spark, folder, "customer").select("c_custkey", P.by_rule(F.element_at(F.array(*kinds), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))).alias("abstraction"))


@query("d06_applied", "SELECT page_id, '<url> and <url>' AS text, 1::BIGINT AS pairs FROM pages")
def applied(spark, folder):
    """A value that stands twice is replaced twice by the same placeholder."""
    told = read(spark, folder, "pages").select("page_id", F.concat("url", F.lit(" and "), "url").alias("text")).withColumn("pairs", D.mapping(F.col("text")))
    return told.select("page_id", D.apply(F.col("text"), F.col("pairs")).alias("text"), F.size("pairs").cast("long").alias("pairs"))


# Validation


@query("v10_storage_ready", f"WITH {texts.SCORED} SELECT doc_id, coalesce(source IS NOT NULL AND lang IS NOT NULL AND length(source) > 0 AND length(lang) > 0 AND score >= 0.8 AND length(text) > 0, FALSE) AS ready FROM scored")
def storage_ready(spark, folder):
    return texts.scored(spark, folder).select("doc_id", V.storage_ready(["text", "source", "lang"], F.col("score")).alias("ready"))


_A = f"SELECT doc_id, text, {texts._ABSTRACT} AS a FROM documents"
_HELD = f"regexp_extract_all(a, '{X.PLACEHOLDER}')"
def _has(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def _score(parts) -> str:
    return "greatest(0.0, least(1.0, 0.5" + "".join(f" + CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w in parts) + "))"


_NAME = "regexp_replace(p, '^[<>]+|[<>]+$', '', 'g')"
_SPEC = _score([(_has("p", P.SPECIFIC), 0.3), ("contains(p, '_')", 0.2), (_has("p", P.GENERIC), -0.3), *[(f"contains(o, '{x}') AND contains(p, '{y}')", 0.1) for x, y in P.CONTEXT]])
_SEM = _score([*[y for k, v in P.CONCEPTS.items() for y in ((f"contains(o, '{k}') AND {_has('p', v)}", 0.2), (f"contains(o, '{k}') AND NOT {_has('p', v)}", -0.1))], *[(f"contains(o, '{k}') AND contains(p, '{k}')", 0.15) for k in P.KEPT], (f"length({_NAME}) < 3", -0.2)])
_MAIN = _score([(f"regexp_matches({_NAME}, '^[a-z][a-z0-9_]*[a-z0-9]$')", 0.2), (f"length({_NAME}) BETWEEN 5 AND 25", 0.15), (f"length({_NAME}) NOT BETWEEN 5 AND 25", -0.1), (_has(_NAME, P.UNCLEAR), -0.1), (f"len(string_split({_NAME}, '_')) = 2 AND len(list_filter(string_split({_NAME}, '_'), lambda w: length(w) <= 2)) = 0", 0.15), (f"len(string_split({_NAME}, '_')) > 4", -0.2)])
_SAME = "CASE WHEN len(x) > 1 AND len(y) > 1 AND len(x) = len(y) THEN len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) >= len(x) * 0.6 ELSE contains(a, b) OR contains(b, a) END"
_LEVEL = "CASE " + " ".join(f"WHEN score >= {v} THEN '{n}'" for n, v in P.LEVELS) + " ELSE 'unacceptable' END"


@query("v13_quality_parts", f"WITH v AS (SELECT doc_id, kind, lower(value) AS o, '<' || kind || CASE WHEN r > 1 THEN '_' || (r - 1) ELSE '' END || '>' AS p FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY length(value) DESC, value DESC) AS r FROM ({texts._VALUES}))), s AS (SELECT doc_id, avg({_SPEC}) AS specificity, avg({_SEM}) AS semantic, avg({_MAIN}) AS maintainability, sum(length(p))::DOUBLE / sum(length(o)) AS ratio FROM v GROUP BY doc_id), n AS (SELECT doc_id, kind, {_NAME} AS a FROM v), q AS (SELECT doc_id, kind, a, b, string_split(a, '_') AS x, string_split(b, '_') AS y FROM (SELECT m.doc_id, m.kind, m.a, k.a AS b FROM n m JOIN n k ON m.doc_id = k.doc_id AND m.kind = k.kind AND m.a < k.a)), c AS (SELECT doc_id, sum(odd) AS odd FROM (SELECT doc_id, kind, count(*) FILTER (NOT ({_SAME}))::DOUBLE / count(*) * 0.3 AS odd FROM q GROUP BY ALL) GROUP BY doc_id), p AS (SELECT d.doc_id, coalesce(specificity, 0.0) AS specificity, greatest(0.0, 1 - coalesce(odd, 0.0)) AS consistency, coalesce(semantic, 1.0) AS semantic, CASE WHEN ratio IS NULL THEN 1.0 ELSE 0.5 * CASE WHEN ratio BETWEEN 0.3 AND 0.7 THEN 1.0 WHEN ratio < 0.3 THEN ratio / 0.3 ELSE greatest(0.0, 1 - (ratio - 0.7) / 0.3) END + 0.5 END AS efficiency, coalesce(maintainability, 1.0) AS maintainability FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN c USING (doc_id)), t AS (SELECT *, 0.2 * specificity + 0.25 * consistency + 0.2 + 0.15 * semantic + 0.1 * efficiency + 0.1 * maintainability AS score FROM p) SELECT doc_id, round(specificity, 6)::DOUBLE AS specificity, round(consistency, 6)::DOUBLE AS consistency, round(semantic, 6)::DOUBLE AS semantic, round(efficiency, 6)::DOUBLE AS efficiency, round(maintainability, 6)::DOUBLE AS maintainability, round(score, 6)::DOUBLE AS score, {_LEVEL} AS level FROM t")
def quality_parts(spark, folder):
    """The six parts of the quality of each document's abstraction, the score and its level; here all is abstracted."""
    d = documents(spark, folder)
    told = kept(d.select("doc_id", F.inline(D.named_values(F.col("text")))).withColumnRenamed("kind", "type"))  # read by all parts
    abstractions = told.select("doc_id", "type", F.col("value").alias("original"), F.col("placeholder").alias("abstracted"))
    q = P.quality_parts(d, abstractions, told.select("doc_id", "type", "value"))
    out = q.withColumn("score", P.quality_score({k: F.col(k) for k in P.QUALITY})).drop("completeness")
    return out.withColumn("level", P.quality_level(F.col("score"))).withColumns({c: F.round(c, 6) for c in ("specificity", "consistency", "semantic", "efficiency", "maintainability", "score")})


@query("v16_semantic_quality", f"WITH {texts._NUMBERED}, t AS (SELECT d.doc_id, d.text, coalesce(h.held, 0) AS held, length(d.text) + coalesce(h.more, 0) AS m FROM documents d LEFT JOIN h USING (doc_id) WHERE NOT {like('text', X.PLACEHOLDER)}) SELECT doc_id, round(CASE WHEN m < length(text) * 0.5 THEN 0.8 ELSE 1.0 END, 6)::DOUBLE AS semantic, held > 0 AS reconstructable FROM t")
def semantic_quality(spark, folder):
    """How much meaning each document keeps once abstracted, of those that hold no placeholder before."""
    told = documents(spark, folder).where(~F.col("text").rlike(X.PLACEHOLDER)).withColumn("pairs", D.mapping(F.col("text")))
    s = told.select("doc_id", V.semantic_quality(F.col("text"), D.apply(F.col("text"), F.col("pairs")), F.col("pairs")).alias("s"))
    return s.select("doc_id", F.round("s.score", 6).alias("semantic"), "s.reconstructable")


def _refs(column: str) -> str:
    return "(" + " + ".join(f"{like(column, p)}::INT" for *_, p in D.CONCRETE) + ")"


@query("v19_note_scores", sql(f"SELECT memory_id, round(greatest(0.0, 1.0 - 0.1 * ({_refs('prompt')} + {_refs('response')})), 6)::DOUBLE AS score FROM memories", "memories"))
def note_scores(spark, folder):
    return M.memories(spark, folder).select("memory_id", F.round(V.note_score([F.col("prompt"), F.col("response")]), 6).alias("score"))


_COUNTED = "(" + " + ".join(f"{like('{c}', '(?i)' + p)}::INT" for p in D.COUNTED) + ")"


@query("v22_reference_rows", "SELECT doc_id, CASE WHEN length(text) > 0 AND doc_id % 9 = 0 THEN 'missing_abstraction' WHEN " + _COUNTED.replace("{c}", "a") + f" > 0 AND doc_id % 9 <> 0 THEN 'still_concrete' END AS issue FROM ({_A}) WHERE doc_id % 9 = 0 OR " + _COUNTED.replace("{c}", "a") + " > 0")
def reference_rows(spark, folder):
    """References whose abstraction is missing (every ninth) or still concrete."""
    t = once(documents(spark, folder).select("doc_id", "text"), a=F.when(F.col("doc_id") % 9 != 0, D.abstracted(F.col("text"))))
    return once(t, issue=V.reference_row(F.col("text"), F.col("a"))).select("doc_id", "issue").where("issue is not null or doc_id % 9 = 0")


@query("v23_verdicts", f"WITH {texts.SCORED} SELECT doc_id, CASE WHEN refs > 0 THEN refs || ' references are not abstracted' WHEN score < 0.8 THEN printf('score %.2f is too low', score) ELSE 'complete' END AS verdict FROM scored")
def verdicts(spark, folder):
    return texts.scored(spark, folder).select("doc_id", V.verdict(F.col("refs"), F.col("score")).alias("verdict"))


@query("v25_merge_safe", "SELECT doc_id, " + _COUNTED.replace("{c}", "text") + " <= 1 AND len(regexp_extract_all(text, '(?m)^```')) % 2 = 0 AS safe FROM documents")
def merge_safe(spark, folder):
    return documents(spark, folder).select("doc_id", V.merge_safe(F.col("text"), 1).alias("safe"))


@query("v26_corpus_audit", f"WITH {texts.SCORED} SELECT source, count(*) AS checked, count(*) FILTER (score >= 0.5) AS passed, count(*) FILTER (score < 0.5) AS failed, round(avg(score), 6)::DOUBLE AS safety, coalesce(sum(refs) FILTER (score < 0.5), 0)::BIGINT AS violations FROM scored GROUP BY source")
def corpus_audit(spark, folder):
    """Files checked, passed and failed by source, with their violations. Texts without placeholders score 0.7 at most, so
    half is asked for here."""
    out = V.corpus_audit(texts.scored(spark, folder).select("source", "score", F.col("refs").alias("violations")), "source", 0.5)
    return out.select("source", "checked", "passed", "failed", F.round("safety", 6).alias("safety"), F.col("violations").cast("long").alias("violations"))


# Jobs


@query("m10_promotions", f"SELECT evolved AS pattern, sum(n)::BIGINT AS detections FROM {EVOLVED} WHERE evolved <> pattern GROUP BY 1")
def promotions(spark, folder):
    """Evolved patterns with the detections of all that they stand for."""
    p = learned_paths(spark, folder)
    e = D.evolved(p, 0.4, 0)
    return e.join(p, ["pattern", "type"]).groupBy(F.col("evolved").alias("pattern")).agg(F.sum("detections").alias("detections"))


# Graphs


def code_files(spark, folder):
    """Source texts made of suppliers, eight functions to a file: each calls the next of its file, and a class holds them."""
    s = read(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 8).alias("file"), "s_suppkey", "s_nationkey")
    name = F.concat(F.lit("get_supplier_"), "s_suppkey")
    body = F.concat(F.lit("def "), name, F.lit("(x):\n    # supplier\n    if x > "), "s_nationkey", F.lit(":\n        return get_supplier_"), F.col("s_suppkey") + 1, F.lit("(x)\n    return x\n"))
    each = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", body.alias("b")))).alias("b"))  # eight rows a file
    return each.select("file", F.concat(F.lit("class Suppliers"), "file", F.lit(":\n    _instance = None\n"), F.array_join(F.col("b.b"), "")).alias("text"))


@query("n06_definitions", "SELECT (s_suppkey // 8)::BIGINT AS file, 'function' AS kind, 'get_supplier_' || s_suppkey AS name, '<getter_method>' AS shape FROM supplier UNION ALL SELECT DISTINCT (s_suppkey // 8)::BIGINT, 'class', 'Suppliers' || (s_suppkey // 8), '<class_name>' FROM supplier")
def definitions(spark, folder):
    return N.definitions(code_files(spark, folder))


def scoped_files(spark, folder):
    """Source texts of both syntaxes: a class by indentation with a nested helper, or one by braces with brackets in
    strings and comments; each supplier's method calls the next one's, if it is in the same file."""
    s = read(spark, folder, "supplier").select(F.floor(F.col("s_suppkey") / 5).alias("file"), "s_suppkey")
    k, after = F.col("s_suppkey").cast("string"), (F.col("s_suppkey") + 1).cast("string")
    by_indent = F.concat(F.lit("    def get_"), k, F.lit("(self,\n            x=(1, 2)):\n        # } get_0(\n        def helper(y):\n            return '{' + str(y)\n\n        return helper(get_"), after, F.lit("(x))\n\n"))
    by_brace = F.concat(F.lit("  function get_"), k, F.lit("(x) {\n    // { get_0(\n    const helper = (y) => { return \"}\" + y; };\n    return helper(get_"), after, F.lit("(x));\n  }\n"))
    each = s.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", by_indent.alias("i"), by_brace.alias("b")))).alias("m"))  # five rows a file
    even = F.col("file") % 2 == 0
    text = F.when(even, F.concat(F.lit("class Group"), "file", F.lit(":\n"), F.array_join("m.i", ""))).otherwise(F.concat(F.lit("class Group"), "file", F.lit(" {\n"), F.array_join("m.b", ""), F.lit("}\n")))
    return each.select("file", text.alias("text"))


_SCOPED = "f AS (SELECT (s_suppkey // 5)::BIGINT AS file, 'get_' || s_suppkey AS own, 'get_' || (s_suppkey + 1) AS next, s_suppkey FROM supplier)"


@query("n06_scopes", f"WITH {_SCOPED} SELECT DISTINCT file, 'class' AS kind, 'Group' || file AS name, 0::INTEGER AS depth, NULL::VARCHAR AS parent FROM f UNION ALL SELECT file, 'function', own, 1, 'Group' || file FROM f UNION ALL SELECT file, 'function', 'helper', 2, own FROM f")
def scopes(spark, folder):
    return SC.definitions(scoped_files(spark, folder)).select("file", "kind", "name", "depth", "parent")


@query("n07_scoped_calls", f"WITH {_SCOPED} SELECT file, own AS name, 'helper' AS uses, 1::BIGINT AS n FROM f UNION ALL SELECT a.file, a.own, b.own, 1 FROM f a JOIN f b ON b.file = a.file AND b.own = a.next")
def scoped_calls(spark, folder):
    return SC.calls(scoped_files(spark, folder))


_CALLS = "SELECT (a.s_suppkey // 8)::BIGINT AS file, 'get_supplier_' || a.s_suppkey AS name, 'get_supplier_' || b.s_suppkey AS uses FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 AND b.s_suppkey // 8 = a.s_suppkey // 8"


@query("n07_dependencies", _CALLS)
def dependencies(spark, folder):
    return N.dependencies(code_files(spark, folder))


@query("g02_code_nodes", "SELECT type, count(*) AS n FROM (SELECT 'function' AS type FROM supplier UNION ALL SELECT 'class' FROM (SELECT DISTINCT s_suppkey // 8 FROM supplier) UNION ALL SELECT 'module' FROM (SELECT DISTINCT s_suppkey // 8 FROM supplier)) GROUP BY type")
def code_nodes(spark, folder):
    return G.code_nodes(code_files(spark, folder)).groupBy("type").agg(F.count("*").alias("n"))


@query("g03_semantic_edges", sql(f"SELECT vec_id AS source, CASE WHEN s >= 0.9 THEN 'similar_to' WHEN s >= 0.8 THEN 'related_to' ELSE 'references' END AS type, round(s * exp(-(vec_id % 24) / 168.0), 8)::DOUBLE AS weight FROM (SELECT vec_id, abs({cos('prompt_vector', 'response_vector')}) AS s FROM vectors)", "vectors"))
def semantic_edges(spark, folder):
    v = M.vectors(spark, folder)
    pairs = v.select(F.col("vec_id").alias("source"), (F.col("vec_id") + 1).alias("target"), F.abs(W.cosine(F.col("prompt_vector"), F.col("response_vector"))).alias("similarity"), F.pmod("vec_id", F.lit(24)).alias("hours"))
    return G.semantic_edges(pairs).select("source", "type", F.round("weight", 8).alias("weight"))


@query("g15_diagram_edges", "SELECT 'file_' || (s_suppkey // 8) AS source, 'get_supplier_' || s_suppkey AS target FROM supplier UNION ALL SELECT DISTINCT 'file_' || (s_suppkey // 8), 'Suppliers' || (s_suppkey // 8) FROM supplier")
def diagram_edges(spark, folder):
    d = N.definitions(code_files(spark, folder))
    files = d.select("file").distinct().select("file", F.concat(F.lit("file_"), "file").alias("id"))
    return G.contains(files, d.select("file", F.col("name").alias("id")), "file").select("source", "target")


# Clusters and search


@query("c02_similar", sql(f"SELECT a.vec_id AS source_id, b.vec_id, round({cos('a.prompt_vector', 'b.prompt_vector')}, 8) AS score FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND {cos('a.prompt_vector', 'b.prompt_vector')} >= 0.25", "vectors"))
def similar(spark, folder):
    """All vectors alike enough to each of a given batch."""
    v = M.vectors(spark, folder)
    return O.similar_vectors(v, sources(spark, folder), 0.25).select("source_id", "vec_id", F.round("score", 8).alias("score"))


@query("c08_joined_or_new", sql(f"{CENTRES}, r AS (SELECT vec_id, c.label AS cluster, {cos('prompt_vector', 'c.centroid')} AS score FROM vectors v, centres c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {cos('prompt_vector', 'c.centroid')} DESC, c.label) = 1) SELECT vec_id, CASE WHEN score >= 0.3 THEN cluster END AS cluster, CASE WHEN score >= 0.3 THEN 'join' ELSE 'create' END AS action FROM r", "vectors"))
def joined_or_new(spark, folder):
    v = M.vectors(spark, folder)
    return O.joined_or_new(v, O.centroids(v), 0.3).select("vec_id", "cluster", "action")


@query("c13_needing_vectors", "SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 GROUP BY label")
def needing_vectors(spark, folder):
    """Every seventh vector is missing, every eleventh too short."""
    v = read(spark, folder, "embeddings")
    odd = v.withColumn("embedding", F.when(F.col("vec_id") % 7 != 0, F.when(F.col("vec_id") % 11 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding"))))
    return O.needing_vectors(odd, "embedding", 64).groupBy("label").agg(F.count("*").alias("n"))


@query("c05_boosted_search", sql(f"{RELATED}, {CENTRES}, sizes AS (SELECT label, count(*) AS n FROM members GROUP BY label), boosted AS (SELECT source_id AS query_id, r.vec_id AS id, m.label, r.score * (1 + 0.2 * m.score) * (1 + 0.01 * least(s.n, 10)) AS boosted FROM related r JOIN members m USING (vec_id) JOIN sizes s ON s.label = m.label) SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, id))::INTEGER AS rank, id, label, round(boosted, 7)::DOUBLE AS boosted FROM boosted", "vectors"))
def boosted_search(spark, folder):
    """Vector hits raised by their cluster's membership and size."""
    v = M.vectors(spark, folder)
    members = O.memberships(v, O.centroids(v))
    hits = _related(spark, folder).select(F.col("source_id").alias("query_id"), F.col("vec_id").alias("id"), "score")
    found = O.boosted_search(hits, members, members.groupBy("label").agg(F.count("*").alias("members")))
    return found.withColumn("boosted", F.round("boosted", 7))


@query("c12_features", "WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM conversations) SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN 1.0 END::DOUBLE AS norm FROM w")
def features(spark, folder):
    """Vectors of hashed word counts have length 1; a text without words has none."""
    f = O.features(read(spark, folder, "conversations").select("conv_id", "turn", "text"))
    return f.select("conv_id", "turn", F.round(W.norm(F.col("vector")), 6).alias("norm"))


# Intents


@query("i03_combined", sql(f"{UNITED}, first AS (SELECT memory_id, intent, score FROM united QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, intent) = 1) SELECT m.memory_id, coalesce(f.intent, 'unknown') AS intent, round(coalesce(f.score, 0.0), 6)::DOUBLE AS confidence FROM memories m LEFT JOIN first f USING (memory_id)", "memories"))
def combined_intents(spark, folder):
    """0.6 of the prompt's pattern scores and 0.4 of the response's, the best one of each memory."""
    m = M.memories(spark, folder)
    return I.best_intent(m, "memory_id", "prompt", 0.6, I.pattern_scores(F.col("response"))).select("memory_id", "intent", "confidence")


def _next_to(a: str, b: str) -> str:
    parts = []
    for s in I.SEQUENCES:
        at = [f"CASE {c} " + " ".join(f"WHEN {quoted(x)} THEN {i}" for i, x in enumerate(s)) + " END" for c in (a, b)]
        parts.append(f"coalesce(abs(({at[0]}) - ({at[1]})) <= 1, FALSE)")
    return "(" + " OR ".join(parts) + ")"


PATTERNED = f"patterned AS (SELECT q.memory_id AS query_id, q.intent, m.memory_id, 'pattern' AS kind, least(1.0, 0.4 + CASE WHEN {_next_to('q.intent', 'm.intent')} THEN 0.6 ELSE 0.0 END + CASE WHEN q.complexity = m.complexity THEN 0.2 ELSE 0.0 END)::DOUBLE AS strength FROM asked q JOIN asked m ON q.session_id = m.session_id AND q.domain = m.domain AND q.memory_id <> m.memory_id)"
_LINKED = f"{TEMPORAL}, {PATTERNED}, links AS (SELECT query_id, intent, memory_id, kind, strength FROM temporal WHERE strength >= 0.3 UNION ALL SELECT query_id, intent, memory_id, kind, strength FROM patterned WHERE strength >= 0.4)"
_BONUS = "CASE " + " ".join(f"WHEN intent = {quoted(i)} AND kind = {quoted(k)} THEN {b}" for i, k, b in I.BONUSES) + " ELSE 0.0 END"
RANKED = f"{_LINKED}, ranked AS (SELECT *, strength + {_BONUS} AS score FROM links), placed AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id, kind))::INTEGER AS rank FROM ranked)"


def _links(spark, folder):
    asked = _asked(spark, folder)
    q = _queries(asked)
    return I.temporal_connections(q, asked).unionByName(I.pattern_connections(q, asked, 0.4)), q.select("query_id", "intent")


@query("i07_pattern_connections", sql(f"{TEMPORAL}, {PATTERNED} SELECT query_id, memory_id, round(strength, 6)::DOUBLE AS strength FROM patterned WHERE strength >= 0.4", "memories"))
def pattern_connections(spark, folder):
    asked = _asked(spark, folder)
    return I.pattern_connections(_queries(asked), asked, 0.4).select("query_id", "memory_id", F.round("strength", 6).alias("strength"))


@query("i08_ranked", sql(f"{RANKED} SELECT query_id, memory_id, kind, rank, round(score, 7)::DOUBLE AS score FROM placed WHERE rank <= 3", "memories"))
def ranked(spark, folder):
    return I.ranked(*_links(spark, folder), 3).select("query_id", "memory_id", "kind", "rank", F.round("score", 7).alias("score"))


_HOW = "'This memory is ' || CASE WHEN strength >= 0.9 THEN 'very strongly' WHEN strength >= 0.7 THEN 'strongly' ELSE 'somewhat' END || ' connected: it ' || CASE kind WHEN 'temporal' THEN 'came about the same time' ELSE 'follows a similar pattern' END"


@query("i09_explained", sql(f"{_LINKED} SELECT query_id, memory_id, kind, {_HOW} AS explanation FROM links", "memories"))
def explained(spark, folder):
    return I.explained(_links(spark, folder)[0]).select("query_id", "memory_id", "kind", "explanation")


@query("i11_query_analysis", sql(f"{RANKED} SELECT query_id, memory_id, kind, round(score, 7)::DOUBLE AS score, rank, {_HOW} AS explanation FROM placed WHERE rank <= 10", "memories"))
def query_analysis(spark, folder):
    """All connections of all queries of a session, ranked, explained and without orders to the reader."""
    out = I.non_directive(I.explained(I.ranked(*_links(spark, folder))))
    return out.select("query_id", "memory_id", "kind", F.round("score", 7).alias("score"), "rank", "explanation")


@query("u02_all_connections", sql(f"{_LINKED} SELECT query_id, memory_id, kind, round(strength, 7)::DOUBLE AS strength FROM links", "memories"))
def all_connections(spark, folder):
    """Temporal and pattern connections of all queries, one list."""
    return _links(spark, folder)[0].withColumn("strength", F.round("strength", 7))


_GROUPED = "(" + " OR ".join(f"(q.intent IN ({', '.join(map(quoted, g))}) AND m.intent IN ({', '.join(map(quoted, g))}))" for g in I.GROUPS) + ")"


@query("i10_intent_search", sql(f"{TEMPORAL}, hits AS (SELECT query_id, memory_id AS id, 0.5 + 0.3 * (memory_id % 2) AS score FROM temporal), b AS (SELECT h.query_id, h.id, least(1.0, h.score + CASE WHEN q.intent = m.intent THEN 0.3 WHEN {_GROUPED} THEN 0.1 ELSE 0.0 END) AS score FROM hits h JOIN asked q ON q.memory_id = h.query_id JOIN asked m ON m.memory_id = h.id) SELECT query_id, (row_number() OVER w)::INTEGER AS rank, id, round(score, 7)::DOUBLE AS score FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3", "memories"))
def intent_search(spark, folder):
    """Hits of the same session, raised by the intents of query and memory."""
    asked = _asked(spark, folder)
    m = asked.select("session_id", F.col("memory_id").alias("id"))
    hits = asked.select("session_id", F.col("memory_id").alias("query_id")).join(m, "session_id").where("query_id <> id").select("query_id", "id", (0.5 + 0.3 * (F.col("id") % 2)).alias("score"))
    return O.intent_search(hits, asked.select(F.col("memory_id").alias("id"), "intent"), 3).withColumn("score", F.round("score", 7))


# Code


@query("n01_languages", "SELECT language, count(*) AS n FROM (SELECT DISTINCT s_suppkey // 8 AS file, CASE WHEN (s_suppkey // 8) % 2 = 0 THEN 'javascript' ELSE 'python' END AS language FROM supplier) GROUP BY language")
def languages(spark, folder):
    """Languages of source texts: every other file has an ending that says another one than its text does."""
    f = code_files(spark, folder).withColumn("name", F.concat(F.lit("file"), F.when(F.col("file") % 2 == 0, ".js").otherwise("")))
    return f.groupBy(N.language(F.col("text"), F.col("name")).alias("language")).agg(F.count("*").alias("n"))


_STRIPPED = r"regexp_replace(x, '^[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}]+|[\t\n\x0B\f\r\x1c-\x1f \x{85}\x{a0}]+$', '', 'g')"
_LINE = f"lambda s: {{'total': 0::BIGINT, 'depth': 0::BIGINT, 'opens': ({' OR '.join(f'contains(lower(s), {quoted(w)})' for w in N.OPENERS)}), 'block': contains(s, '{{') OR contains(s, ':'), 'closes': contains(s, '}}'), 'told': s <> ''}}"
_DEEPER = "(a.depth + (x.opens AND x.block)::BIGINT)"
_FOLD = f"lambda a, x: {{'total': a.total + CASE WHEN x.opens THEN 1 + a.depth ELSE 0 END, 'depth': CASE WHEN x.closes OR (x.told AND {_DEEPER} > 0) THEN greatest(0, {_DEEPER} - 1) ELSE {_DEEPER} END, 'opens': x.opens, 'block': x.block, 'closes': x.closes, 'told': x.told}}"
_COGNITIVE = f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN list_reduce(list_concat([{{'total': 0::BIGINT, 'depth': 0::BIGINT, 'opens': FALSE, 'block': FALSE, 'closes': FALSE, 'told': FALSE}}], list_transform(list_transform(string_split(text, chr(10)), lambda x: {_STRIPPED}), {_LINE})), {_FOLD}).total END AS cognitive FROM documents"


@query("n03_cognitive", _COGNITIVE)
def cognitive(spark, folder):
    return documents(spark, folder).select("doc_id", N.cognitive(F.col("text")).alias("cognitive"))


_CYCLO = "(1 + " + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in N.BRANCHES) + ")"


@query("n05_quality", f"WITH q AS (SELECT doc_id, ({_CYCLO} > 20)::INT AS a, (len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 120)) > 0)::INT AS b, (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s*(#|//|/\\*|\\*)'))) * 10 < len(string_split(text, chr(10))))::INT AS c FROM documents) SELECT doc_id, (a + b + c)::BIGINT AS issues, round(greatest(0.0, 1.0 - 0.2 * (a + b + c)), 6)::DOUBLE AS score FROM q")
def code_quality(spark, folder):
    q = documents(spark, folder).select("doc_id", N.quality(F.col("text")).alias("q"))
    return q.select("doc_id", F.size("q.issues").cast("long").alias("issues"), F.round("q.score", 6).alias("score"))


@query("n08_pattern_hints", "SELECT DISTINCT (s_suppkey // 8)::BIGINT AS file, 'singleton' AS hint FROM supplier")
def pattern_hints(spark, folder):
    """Files hold a field and a method that look like a singleton's."""
    files = code_files(spark, folder).withColumn("text", F.concat("text", F.lit("def get_instance():\n    pass\n")))
    return files.select("file", F.explode(N.pattern_hints(F.col("text"))).alias("hint"))


@query("n09_documentation_coverage", "WITH c AS (SELECT s_nationkey AS nation, count(*) AS functions, max(s_acctbal) > 8000 AS api_docs, min(s_acctbal) < 1000 AS readme, count(*) % 2 = 0 AS changelog FROM supplier GROUP BY s_nationkey), d AS (SELECT *, CASE WHEN api_docs THEN 0.8 ELSE 0.0 END + CASE WHEN readme THEN 0.2 ELSE 0.0 END AS coverage FROM c) SELECT nation, functions, round(coverage, 6)::DOUBLE AS coverage, concat_ws(', ', CASE WHEN coverage < 0.5 THEN 'api documentation' END, CASE WHEN NOT readme THEN 'read-me' END, CASE WHEN NOT changelog THEN 'changelog' END, CASE WHEN coverage < 0.8 THEN 'examples' END) AS recommendations FROM d")
def documentation_coverage(spark, folder):
    """A corpus a nation, a function a supplier; balances decide what documentation there is."""
    c = read(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("functions"), F.lit(0).alias("classes"), (F.max("s_acctbal") > 8000).alias("api_docs"), (F.min("s_acctbal") < 1000).alias("readme"), (F.count("*") % 2 == 0).alias("changelog"))
    return N.documentation_coverage(c).select("nation", "functions", F.round("coverage", 6).alias("coverage"), F.concat_ws(", ", "recommendations").alias("recommendations"))


# Streams


@query("t06_cached", "WITH RECURSIVE e AS (SELECT user_id || ':' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events), g AS (SELECT key, n, ts AS put, 'miss' AS found FROM e WHERE n = 1 UNION ALL SELECT e.key, e.n, CASE WHEN e.ts > g.put + INTERVAL 24 HOURS THEN e.ts ELSE g.put END, CASE WHEN e.ts > g.put + INTERVAL 24 HOURS THEN 'expired' ELSE 'hit' END FROM g JOIN e ON e.key = g.key AND e.n = g.n + 1) SELECT found, count(*) AS n FROM g GROUP BY found")
def cached(spark, folder):
    """What requests find in a cache that is large enough, and whose keys live a day."""
    keyed = stream(spark, folder).withColumn("key", F.concat_ws(":", "user_id", "event_type"))
    return S.drained(S.cache_requests(keyed, 86_400, 10_000_000)).groupBy("found").agg(F.count("*").alias("n"))


@query("t09_pattern_counts", f"SELECT placeholder, count(*) AS n FROM (SELECT unnest({_HELD}) AS placeholder FROM ({_A})) GROUP BY placeholder")
def pattern_counts(spark, folder):
    docs = source(spark, folder, "documents").withColumn("text", D.abstracted(F.col("text")))
    return S.drained(S.pattern_counts(docs), "complete")


@query("t10_audit_append", "SELECT user_id AS id, max_by(event_type, event_id) AS event_type, 'insert' AS operation FROM events GROUP BY user_id")
def audit_append(spark, folder):
    """An audit log of users' last kinds of event: what a stream's batches change is appended."""
    path = S.scratch(spark, "audit")
    S.append_changes(stream(spark, folder).select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type"), path, "id", ["event_type"])
    return spark.read.parquet(path).select("id", "event_type", "operation")


@query("t11_scheduled_decay", sql(f"{DECAYED}, again AS (SELECT interaction_id, applied AS weight, rate, least, faster_after, preserve, days, access_count FROM applied), twice AS (SELECT *, least(greatest(weight * exp(-rate * days * CASE WHEN days > faster_after THEN 1.5 ELSE 1.0 END) * CASE WHEN access_count > 1 THEN 1 + ln(access_count) * 0.05 ELSE 1 END, least), 1.0) AS w2 FROM again) SELECT interaction_id, round(CASE WHEN weight >= preserve THEN weight WHEN w2 <= least THEN 0.0 WHEN abs(w2 - weight) > 0.001 THEN w2 ELSE weight END, 7)::DOUBLE AS weight FROM twice", "interactions", "decay"))
def scheduled_decay(spark, folder):
    """Two runs of the decay job, one on what the other has left."""
    path = S.scratch(spark, "decay")
    S.scheduled_decay(spark, lambda: interactions(spark, folder), M.decay_config(spark), as_of(), path, 2)
    return spark.read.parquet(f"{path}/run=1").select("interaction_id", F.round("weight", 7).alias("weight"))


# Registered functions and extensions


@query("p02_unique_placeholders", "SELECT conv_id, (count(*) - count(*) FILTER (r = 1))::BIGINT AS numbered FROM (SELECT page_id % 10 AS conv_id, row_number() OVER (PARTITION BY page_id % 10 ORDER BY url) AS r FROM (SELECT DISTINCT page_id % 10 AS page_id, url FROM pages)) GROUP BY conv_id")
def unique_placeholders(spark, folder):
    """Ten texts that list all URLs between them: each but the first of a text has a number in its placeholder."""
    found = read(spark, folder, "pages").select(F.pmod("page_id", F.lit(10)).alias("conv_id"), F.explode(D.found_values(F.col("url"))).alias("v"))
    named = D.numbered(found.select("conv_id", "v.kind", "v.value"), "conv_id")
    return named.groupBy("conv_id").agg(F.count_if(F.col("placeholder").rlike("_[0-9]+>$")).alias("numbered"))


@query("p03_json_leaves", "SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_leaves(spark, folder):
    """Every value of the events' properties, by a table function joined laterally in SQL."""
    R.register(spark)
    events(spark, folder).select("event_id", "props").createOrReplaceTempView("lodestone_events")
    return spark.sql("SELECT event_id, j.path, j.value FROM lodestone_events, LATERAL json_leaves(props) j")


@query("p04_custom_pattern", "SELECT l_orderkey % 10 AS k, count(*) AS n FROM (SELECT o_orderkey AS l_orderkey FROM orders) GROUP BY k")
def custom_pattern(spark, folder):
    """A user's own pattern finds the numbers of orders in lines of text."""
    rule = (P.checked("order_number", "identifier", r"order no\. (\d+)", 0.9),)
    t = read(spark, folder, "orders").select("o_orderkey", F.concat(F.lit("see order no. "), "o_orderkey", F.lit(" of today")).alias("text"))
    s = t.select("o_orderkey", F.explode(P.extracted(F.col("text"), rule)).alias("s")).where("s.value = cast(o_orderkey as string)")
    return s.groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count("*").alias("n"))


@query("p05_pluggable_model", "SELECT conv_id, turn, length(text)::BIGINT AS first FROM conversations")
def pluggable_model(spark, folder):
    """A model that a caller gives; this one's vectors hold a text's length first."""

    def model():
        import numpy as np

        return lambda texts: np.array([[float(len(t)), 1.0] for t in texts])

    return C.embedded(read(spark, folder, "conversations"), model).select("conv_id", "turn", F.col("vector")[0].cast("long").alias("first"))


@query("p06_sql_scalars", sql(f"SELECT interaction_id, round(least(greatest(weight * exp(-0.0002 * days * CASE WHEN days > 30 THEN 1.5 ELSE 1.0 END) * CASE WHEN access_count > 1 THEN 1 + ln(access_count) * 0.05 ELSE 1.0 END, 0.01), 1.0), 8)::DOUBLE AS decayed, ceil(length(interaction_type) / 4.0)::BIGINT AS tokens FROM (SELECT *, floor((floor(epoch({NOW})) - floor(epoch(last_accessed))) / 86400)::INT AS days FROM interactions)", "interactions"))
def sql_scalars(spark, folder):
    """Registered scalars called from SQL."""
    R.register(spark)
    i = interactions(spark, folder).withColumn("days", W.days_between(F.col("last_accessed"), as_of()).cast("int"))
    return i.select("interaction_id", F.expr("round(memory_decay(weight, days, access_count, 0.0002D, 0.01D, 30), 8)").alias("decayed"), F.expr("token_estimate(interaction_type)").alias("tokens"))


_P07 = f"one AS (SELECT 'related' AS what, count(*) AS n FROM (SELECT a.vec_id FROM vectors a, (SELECT prompt_vector AS q FROM vectors WHERE vec_id = 0) WHERE a.vec_id <> 0 AND {cos('a.prompt_vector', 'q')} >= 0.1)), two AS (SELECT 'stale', count(*) FROM interactions WHERE floor((floor(epoch({NOW})) - floor(epoch(last_accessed))) / 86400) > 7), three AS (SELECT 'drift', count(*) FROM interactions WHERE session_id % 4 = 0), four AS (SELECT 'unsafe_in_time', count(*) FROM interactions WHERE NOT is_validated OR floor((floor(epoch({NOW})) - floor(epoch(last_accessed))) / 86400) > 14)"


@query("p07_table_functions", sql(f"{_P07} SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three UNION ALL SELECT * FROM four", "vectors", "interactions"))
def table_functions(spark, folder):
    """Related memories, stale references, drift and safety in time, called as table functions of SQL."""
    i = interactions(spark, folder).withColumn("as_of", as_of())
    views = {"lodestone_vectors": M.vectors(spark, folder), "lodestone_rows": i, "lodestone_new": i.withColumn("weight", F.when(F.col("session_id") % 4 == 0, F.col("weight") + 1).otherwise(F.col("weight")))}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    R.register(spark)
    R.register_tables(spark, "lodestone_vectors", "lodestone_rows", "lodestone_new")
    parts = {"related": "related_memories(0, 0.1D)", "stale": "stale_references(7)", "drift": "reference_drift()", "unsafe_in_time": "unsafe_in_time(14)"}
    return spark.sql(" UNION ALL ".join(f"SELECT '{k}' AS what, count(*) AS n FROM {call}" for k, call in parts.items()))


@query("p08_metric_recorder", "SELECT event_type AS metric, count(*) AS n, max(value) AS most FROM events GROUP BY event_type")
def metric_recorder(spark, folder):
    """Metrics of a caller's own names, recorded by appending, and read back."""
    path = S.scratch(spark, "metrics")
    T.append(events(spark, folder).select(F.col("event_type").alias("metric"), "ts", "value"), path, "metric")
    return spark.read.parquet(path).groupBy(F.col("metric").cast("string").alias("metric")).agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("p09_aggregates", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (r = least(floor(n * 0.95), n - 1)) AS p95 FROM r GROUP BY event_type")
def aggregates(spark, folder):
    return VW.current_metrics(events(spark, folder), ["event_type"]).select("event_type", "p95")
