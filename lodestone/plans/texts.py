"""Queries over texts: functions, detection, validation (X, D, V, N, I-01 to I-04)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.rows import once
from lodestone.operators import code as N
from lodestone.operators import detect as D
from lodestone.operators import intent as I
from lodestone.operators import validate as V
from lodestone.sources import model as M
from lodestone.sources.model import read, sql

from .base import like, query, quoted

HELD = f"len(regexp_extract_all(text, '{X.PLACEHOLDER}'))"
REFS = "(" + " + ".join(f"{like('text', p)}::INT" for *_, p in D.CONCRETE) + ")"
CRITICAL = "(" + " + ".join(f"{like('text', p)}::INT" for _, _, s, p in D.CONCRETE if s == "critical") + ")"
SCORE = "CASE WHEN length(text) = 0 THEN 0.0 WHEN held = 0 AND refs > 0 THEN 0.0 WHEN refs > 0 THEN round(greatest(0.0, least(1.0, held * 0.3::DOUBLE + greatest(0.0, 0.7::DOUBLE - refs * 0.2::DOUBLE), 0.5)), 2) ELSE round(least(1.0, held * 0.3::DOUBLE + 0.7::DOUBLE), 2) END::DOUBLE"
SCORED = f"""marked AS (SELECT doc_id, text, lang, source, n_chars, {REFS} AS refs, {CRITICAL} AS critical, {HELD} AS held FROM documents),
    scored AS (SELECT *, {SCORE} AS score FROM marked)"""


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """documents with references, critical ones, placeholders and the abstraction score. References are found once, as a
    column of their own."""
    docs = once(read(spark, folder, "documents"), found=D.violations(F.col("text")), held=X.placeholder_count(F.col("text")))
    counted = docs.withColumns({"refs": F.size("found"), "critical": F.size(F.filter("found", lambda v: v["severity"] == "critical"))})
    score = V.score_of(F.length("text"), F.col("held"), F.col("refs"))
    return counted.select("doc_id", "text", "lang", "source", "n_chars", "refs", "critical", "held", score.alias("score")).withColumn("meets_minimum", F.col("score") >= 0.8)


def documents(spark, folder):
    return read(spark, folder, "documents")


@query("d07_concrete_references", "SELECT type, pattern, severity, count(*) AS documents FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, '{n}' AS pattern, '{s}' AS severity FROM documents WHERE {like('text', p)}" for k, n, s, p in D.CONCRETE) + ") GROUP BY ALL")
def concrete_references(spark, folder):
    return documents(spark, folder).select("doc_id", F.explode(D.violations(F.col("text"))).alias("v")).groupBy("v.type", "v.pattern", "v.severity").agg(F.count("*").alias("documents"))


@query("d07_contains_concrete", f"SELECT doc_id, hits::BIGINT AS hits, hits > 0 AS has_concrete FROM (SELECT doc_id, {' + '.join(like('text', '(?i)' + p) + '::INT' for p in D.COUNTED)} AS hits FROM documents)")
def contains_concrete(spark, folder):
    return documents(spark, folder).select("doc_id", D.pattern_hits(F.col("text")).cast("long").alias("hits"), D.has_concrete(F.col("text")).alias("has_concrete"))


@query("v_safety_score", f"WITH {SCORED} SELECT doc_id, refs::BIGINT AS refs, critical::BIGINT AS critical, held::BIGINT AS held, score, score >= 0.8 AS meets_minimum FROM scored")
def safety_score(spark, folder):
    return scored(spark, folder).select("doc_id", *[F.col(c).cast("long") for c in ("refs", "critical", "held")], "score", "meets_minimum")


@query("v08_composite", f"WITH {SCORED} SELECT doc_id, refs::BIGINT AS total_violations, critical::BIGINT AS critical_violations, CASE WHEN critical > 0 THEN 0.0 ELSE round(greatest(0.0, 1.0 - refs * 0.1::DOUBLE), 4) END::DOUBLE AS final_score, (critical = 0 AND round(greatest(0.0, 1.0 - refs * 0.1::DOUBLE), 4) >= 0.8) AS passed FROM scored")
def composite(spark, folder):
    s = scored(spark, folder).withColumn("final_score", F.round(V.composite_score(F.col("refs"), F.col("critical")), 4))
    return s.select("doc_id", F.col("refs").cast("long").alias("total_violations"), F.col("critical").cast("long").alias("critical_violations"), "final_score", (F.col("final_score") >= 0.8).alias("passed"))


@query("a19_batch_validation", f"WITH {SCORED} SELECT source, count(*) AS total, count(*) FILTER (critical = 0 AND refs <= 2) AS passed, sum(refs)::BIGINT AS violations, round(avg(score), 6) AS avg_score FROM scored GROUP BY source")
def batch_validation(spark, folder):
    return scored(spark, folder).groupBy("source").agg(F.count("*").alias("total"), F.count_if((F.col("critical") == 0) & (F.col("refs") <= 2)).alias("passed"), F.sum("refs").alias("violations"), F.round(F.avg("score"), 6).alias("avg_score"))


@query("a16_scoring_statistics", f"WITH {SCORED} SELECT CASE WHEN score >= 0.95 THEN 'excellent' WHEN score >= 0.9 THEN 'very_good' WHEN score >= 0.8 THEN 'good' WHEN score >= 0.7 THEN 'fair' ELSE 'poor' END AS level, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS least, max(score) AS most FROM scored GROUP BY level")
def scoring_statistics(spark, folder):
    return scored(spark, folder).groupBy(X.score_bucket(F.col("score")).alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("v02_score_against_labels", f"WITH {SCORED} SELECT quality::BIGINT AS quality, toxic::BIGINT AS toxic, count(*) AS n, round(avg(score), 6) AS avg_score, count(*) FILTER (score >= 0.8) AS safe FROM scored JOIN labels USING (doc_id) GROUP BY ALL")
def score_against_labels(spark, folder):
    joined = scored(spark, folder).select("doc_id", "score").join(read(spark, folder, "labels"), "doc_id")
    return joined.groupBy(F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.count_if(F.col("score") >= 0.8).alias("safe"))


@query("f13_safety_buckets", f"WITH {SCORED} SELECT doc_id, CASE WHEN score >= 0.95 THEN 'excellent' WHEN score >= 0.9 THEN 'very_good' WHEN score >= 0.8 THEN 'good' WHEN score >= 0.7 THEN 'fair' ELSE 'poor' END AS bucket, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 500 THEN 'medium' WHEN length(text) < 2000 THEN 'long' ELSE 'very_long' END AS length_class FROM scored")
def safety_buckets(spark, folder):
    return scored(spark, folder).select("doc_id", X.score_bucket(F.col("score")).alias("bucket"), X.length_bucket(F.col("text")).alias("length_class"))


_ABSTRACT = "text"
for _k, _p, _n in D.REPLACED:
    _ABSTRACT = f"regexp_replace({_ABSTRACT}, {quoted(_p)}, '{_n}', 'g')"


@query("d03_abstracted", f"SELECT doc_id, length(a)::BIGINT AS n, sha256(a) AS hash, len(regexp_extract_all(a, '{X.PLACEHOLDER}'))::BIGINT AS placeholders FROM (SELECT doc_id, {_ABSTRACT} AS a FROM documents)")
def abstracted(spark, folder):
    a = documents(spark, folder).select("doc_id", D.abstracted(F.col("text")).alias("a"))
    return a.select("doc_id", F.length("a").cast("long").alias("n"), X.sha256(F.col("a")).alias("hash"), X.placeholder_count(F.col("a")).cast("long").alias("placeholders"))


_VALUES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(list_distinct(regexp_extract_all(text, {quoted(p)}))) AS value FROM documents" for k, p, _ in D.REPLACED)


@query("d01_reference_values", f"SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values, count(DISTINCT doc_id) AS documents, sum(length(value))::BIGINT AS chars FROM ({_VALUES}) GROUP BY kind")
def reference_values(spark, folder):
    each = documents(spark, folder).select("doc_id", F.explode(D.found_values(F.col("text"))).alias("v")).select("doc_id", "v.kind", "v.value")
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("documents"), F.sum(F.length("value")).cast("long").alias("chars"))


@query("d10_round_trip", "SELECT doc_id, TRUE AS restored FROM documents WHERE NOT regexp_matches(text, '<[a-z_0-9]+>')")
def round_trip(spark, folder):
    """Abstracts with placeholders of its own for each value, and undoes it: the text must come back."""
    told = documents(spark, folder).where(~F.col("text").rlike("<[a-z_0-9]+>")).withColumn("pairs", D.mapping(F.col("text")))
    return told.select("doc_id", (D.restored(D.apply(F.col("text"), F.col("pairs")), F.col("pairs")) == F.col("text")).alias("restored"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("d08_similar_contents", f"WITH g AS (SELECT doc_id, {_GRAMS} AS g FROM documents), s AS (SELECT a.doc_id AS id, b.doc_id AS rule, len(list_intersect(a.g, b.g)) AS c, len(a.g) + len(b.g) AS n FROM g a JOIN g b ON b.doc_id % 50 = 0 AND len(a.g) >= 0.8 * len(b.g) AND len(b.g) >= 0.8 * len(a.g)) SELECT id, rule, round(c::DOUBLE / (n - c), 8) AS confidence FROM s WHERE n > 0 AND c::DOUBLE / (n - c) > 0.8")
def similar_contents(spark, folder):
    """Contents against known bad patterns: every fiftieth document stands for one."""
    d = documents(spark, folder)
    rules = d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("rule"), F.col("text").alias("pattern"))
    return D.similar_to(d.select(F.col("doc_id").alias("id"), "text"), rules).withColumn("confidence", F.round("confidence", 8))


@query("d08_detections")
def detections(spark, folder):
    return D.detections(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), M.RULES)


_RULE_ROWS = " UNION ALL ".join(f"SELECT doc_id, '{r[0]}' AS rule, '{r[3]}' AS severity, '{r[4]}' AS action FROM documents WHERE {like('text', r[2])}" for r in M.RULES if r[1] == "regex" and r[5] <= 0.95)


@query("d08_regex_rules", f"SELECT rule, severity, action, count(*) AS contents FROM ({_RULE_ROWS}) GROUP BY ALL")
def regex_rules(spark, folder):
    rules = [r for r in M.RULES if r[1] == "regex"]
    return D.detections(documents(spark, folder).select(F.col("doc_id").alias("id"), "text"), rules).groupBy("rule", "severity", "action").agg(F.count("*").alias("contents"))


#: Templates of a caller, with priorities: the second one is applied first.
TEMPLATES = ((1, "<link>(/[a-z0-9]+)*", "<page>"), (5, r"https?://[a-zA-Z0-9.-]+", "<link>"))


def _suggested(content_type: str) -> str:
    rows = [r[1:] for r in sorted(TEMPLATES, key=lambda r: -r[0])] + [*D.TYPED[content_type], *D.EVERY]
    return reduce(lambda t, r: f"regexp_replace({t}, {quoted(r[0])}, {quoted(r[1].replace('$', chr(92)))}, 'g')", rows, "text")


@query("d09_suggestions", " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, sha256({_suggested(k)}) AS hash FROM documents" for k in D.TYPED))
def suggestions(spark, folder):
    each = [F.struct(F.lit(k).alias("kind"), X.sha256(D.suggestion(F.col("text"), k, TEMPLATES)).alias("hash")) for k in D.TYPED]
    return documents(spark, folder).select("doc_id", F.inline(F.array(*each)))


_SHAPES = " UNION ALL ".join(f"SELECT doc_id, text, '{k}' AS type FROM documents WHERE {like('text', p)}" for k, _, _, p in D.CONCRETE)


@query("d11_learned_patterns", f"""WITH v AS (SELECT DISTINCT doc_id, type, CASE type WHEN 'file_path' THEN regexp_extract(text, '((/[a-zA-Z0-9_.-]+)+)', 1) WHEN 'network' THEN regexp_extract(text, '(https?://[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}})', 1)
    WHEN 'credential' THEN CASE WHEN length(text) > 100 THEN 'sha256:' || sha256(regexp_replace(text, '[a-zA-Z0-9]', 'X', 'g')) ELSE regexp_replace(text, '[a-zA-Z0-9]', 'X', 'g') END ELSE substring(text, 1, 100) END AS pattern FROM ({_SHAPES}))
    SELECT pattern, type, count(*) AS detections, round(least(1.0, 0.5 + 0.05 * (count(*) - 1)), 4)::DOUBLE AS confidence FROM v WHERE length(pattern) >= 5 GROUP BY ALL""")
def learned_patterns(spark, folder):
    told = documents(spark, folder).select("doc_id", "text", F.explode(F.array_distinct(D.violations(F.col("text"))["type"])).alias("type"))
    return D.learned(told).withColumn("confidence", F.round("confidence", 4))


_URL = {k: f"regexp_extract(url, '{p}', 1)" for k, p in (("protocol", "^([a-zA-Z][a-zA-Z0-9+.-]*)://"), ("host", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)"), ("path", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+(/[^?#]*)"), ("query", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^?#]+\?([^#]*)"))}


@query("x18_url_parts", "SELECT page_id, " + ", ".join(f"{e} AS {k}" for k, e in _URL.items()) + " FROM pages")
def url_parts(spark, folder):
    return read(spark, folder, "pages").select("page_id", X.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


@query("v06_url_validation", f"""WITH u AS (SELECT page_id, url, {', '.join(f'{e} AS {k}' for k, e in _URL.items())} FROM pages),
    f AS (SELECT *, (protocol NOT IN ({', '.join(map(quoted, V.PROTOCOLS))}))::INT + (regexp_matches(host, '^[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}') OR regexp_matches(host, '^(localhost|127\\.0\\.0\\.1)') OR regexp_matches(host, '\\.(local|internal|corp|test)$'))::INT
    + regexp_matches(path, '/(home|Users)/[a-zA-Z0-9_-]+')::INT + regexp_matches(query, '(?i)(api_key|token|secret|password)=[^&]+')::INT AS n FROM u)
    SELECT page_id, n::BIGINT AS violations, CASE WHEN n > 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM f""")
def url_validation(spark, folder):
    found = read(spark, folder, "pages").withColumn("found", V.url_violations(F.col("url")))
    return found.select("page_id", F.size("found").cast("long").alias("violations"), V.url_score(F.col("url"), F.col("found")).cast("double").alias("score"))


_CRED = like("text", "|".join(f"(?:{p})" for p in V.CREDENTIALS))


@query("v07_credentials", f"SELECT doc_id, {_CRED} AND NOT {like('text', X.PLACEHOLDER)} AS credential_pattern FROM documents")
def credentials(spark, folder):
    found = documents(spark, folder).withColumn("found", V.credential_violations(F.col("text")))
    return found.select("doc_id", F.exists("found", lambda v: v["type"] == "credential_pattern").alias("credential_pattern"))


@query("x08_entropy", "WITH c AS (SELECT doc_id, n, sum(1) AS k FROM (SELECT doc_id, length(text) AS n, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0) GROUP BY doc_id, n, c), e AS (SELECT doc_id, -sum(k::DOUBLE / n * log2(k::DOUBLE / n)) AS e FROM c GROUP BY doc_id) SELECT lang, count(*) AS n, round(avg(e), 5) AS bits, round(min(e), 5) AS least, round(max(e), 5) AS most FROM e JOIN documents USING (doc_id) GROUP BY lang")
def text_entropy(spark, folder):
    """Entropy of whole texts by language."""
    told = documents(spark, folder).where(F.length("text") > 0).select("lang", X.entropy(F.col("text")).alias("e"))
    return told.groupBy("lang").agg(F.count("*").alias("n"), *[F.round(f("e"), 5).alias(n) for f, n in ((F.avg, "bits"), (F.min, "least"), (F.max, "most"))])


@query("x06_hashes", "SELECT doc_id, sha256(text) AS content_hash, sha256(text) || ':text:small' AS cache_key FROM documents")
def hashes(spark, folder):
    t = F.col("text")
    return documents(spark, folder).select("doc_id", X.sha256(t).alias("content_hash"), X.cache_key(t, "small", "text").alias("cache_key"))


@query("x22_shortened", "SELECT doc_id, CASE WHEN length(text) > 80 THEN substring(text, 1, 77) || '...' ELSE text END AS short, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def shortened(spark, folder):
    return documents(spark, folder).select("doc_id", X.truncated(F.col("text"), 80).alias("short"), X.token_estimate(F.col("text")).alias("tokens"))


_STOP = ", ".join(map(quoted, X.STOP_WORDS))


@query("x23_keywords", sql(f"SELECT memory_id, array_to_string(list_slice(list_filter(regexp_extract_all(lower(prompt), '[a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), 1, 10), ' ') AS keywords FROM memories", "memories"))
def keywords(spark, folder):
    return M.memories(spark, folder).select("memory_id", F.array_join(X.keywords(F.col("prompt")), " ").alias("keywords"))


def _signs(column: str, of) -> str:
    return "(" + " + ".join(f"contains({column}, {quoted(s)})::INT" for s in of) + ")"


@query("x25_content_type", sql(f"SELECT memory_id, CASE WHEN c > d AND c > 0 THEN 'code' WHEN d > 0 THEN 'documentation' ELSE 'text' END AS content_type FROM (SELECT memory_id, {_signs('t', X.CODE_SIGNS)} AS c, {_signs('t', X.DOC_SIGNS)} AS d FROM (SELECT memory_id, lower(prompt || ' ' || response) AS t FROM memories))", "memories"))
def content_type(spark, folder):
    return M.memories(spark, folder).select("memory_id", X.content_type(F.concat_ws(" ", "prompt", "response")).alias("content_type"))


def _first(column: str, classes) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({column}, {quoted(k)})' for k in keys)} THEN '{name}'" for name, keys in classes.items()) + " END"


@query("x30_domains", sql(f"SELECT memory_id, {_first('lower(prompt)', X.DOMAINS)} AS domain, {_first('lower(prompt)', X.COMPLEXITY)} AS complexity FROM memories", "memories"))
def domains(spark, folder):
    return M.memories(spark, folder).select("memory_id", X.first_class(F.col("prompt"), X.DOMAINS).alias("domain"), X.first_class(F.col("prompt"), X.COMPLEXITY).alias("complexity"))


@query("x20_ip_classes", r"""SELECT cls, count(*) AS n FROM (SELECT CASE WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) THEN 'private_ip' WHEN a = 192 AND b = 168 THEN 'local_ip' WHEN ip = '127.0.0.1' THEN 'localhost' WHEN ip IN ('8.8.8.8', '8.8.4.4', '1.1.1.1') THEN 'public_dns' ELSE 'public_ip' END AS cls
    FROM (SELECT ip, split_part(ip, '.', 1)::INT AS a, split_part(ip, '.', 2)::INT AS b FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) AS ip FROM documents))) GROUP BY cls""")
def ip_classes(spark, folder):
    ips = documents(spark, folder).select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0))).alias("ip"))
    return ips.groupBy(X.ip_class(F.col("ip")).alias("cls")).agg(F.count("*").alias("n"))


@query("a35_placeholder_distribution", f"SELECT placeholder, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest(regexp_extract_all({_ABSTRACT}, '{X.PLACEHOLDER}')) AS placeholder FROM documents) GROUP BY placeholder")
def placeholder_distribution(spark, folder):
    held = documents(spark, folder).select("doc_id", F.explode(X.placeholders(D.abstracted(F.col("text")))).alias("placeholder"))
    return held.groupBy("placeholder").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


@query("v14_consistency", f"SELECT doc_id, (m + n)::BIGINT AS issues, round(greatest(0.0, 1.0 - (m + n) * 0.2), 4)::DOUBLE AS score FROM (SELECT doc_id, ({like('text', X.PLACEHOLDER)} AND regexp_matches(text, '\\{{[a-zA-Z][a-zA-Z0-9_]*\\}}'))::INT AS m, (contains(text, '<file_path>') AND contains(text, '<filepath>'))::INT AS n FROM documents)")
def consistency(spark, folder):
    c = documents(spark, folder).select("doc_id", V.consistency(F.col("text")).alias("c"))
    return c.select("doc_id", F.col("c.issues").cast("long").alias("issues"), F.round("c.score", 4).alias("score"))


_NUMBERED = f"v AS (SELECT doc_id, kind, value, row_number() OVER (PARTITION BY doc_id, kind ORDER BY length(value) DESC, value DESC) AS r FROM ({_VALUES})), o AS (SELECT v.*, (length(d.text) - length(replace(d.text, value, ''))) / length(value) AS occ FROM v JOIN documents d USING (doc_id)), h AS (SELECT doc_id, sum(occ) AS held, sum(occ * (length(kind) + 2 + CASE WHEN r > 1 THEN 1 + length((r - 1)::VARCHAR) ELSE 0 END - length(value))) AS more FROM o GROUP BY doc_id)"


@query("v17_overall_quality", f"WITH {SCORED}, {_NUMBERED} SELECT s.doc_id, s.score, CASE WHEN length(s.text) = 0 OR coalesce(h.held, 0) * 100.0 / (length(s.text) + coalesce(more, 0)) >= 0.1 THEN 1.0 ELSE 0.0 END::DOUBLE AS density, 1.0::DOUBLE AS consistent, 1.0::DOUBLE AS complete, 1.0::DOUBLE AS semantic, round((0.25 * CASE WHEN length(s.text) = 0 OR coalesce(h.held, 0) * 100.0 / (length(s.text) + coalesce(more, 0)) >= 0.1 THEN 1.0 ELSE 0.0 END + 0.25 + 0.3 + 0.2) * 0.8 + 0.2 * s.score, 6)::DOUBLE AS overall FROM scored s LEFT JOIN h USING (doc_id)")
def overall_quality(spark, folder):
    """Quality of each document once abstracted: density, consistency, completeness, meaning kept, safety."""
    t = F.col("a")
    told = once(scored(spark, folder), pairs=D.mapping(F.col("text")))
    told = once(told, a=D.apply(F.col("text"), F.col("pairs")))
    parts = {"density": F.when(V.density_valid(t), 1.0).otherwise(0.0), "consistent": V.consistency(t)["score"], "complete": V.completeness(t, F.col("pairs"))["score"], "semantic": (D.restored(t, F.col("pairs")) == F.col("text")).cast("double")}
    out = told.select("doc_id", "score", *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("overall", F.round(V.overall_quality(*[F.col(k) for k in parts], F.col("score")), 6))


@query("i01_intents", sql(I.oracle("prompt") + " SELECT memory_id, intent, confidence FROM best", "memories"))
def intents(spark, folder):
    return I.best_intent(M.memories(spark, folder), "memory_id", "prompt").select("memory_id", "intent", "confidence")


@query("i04_intent_safety", sql(I.oracle("prompt") + " SELECT intent, count(*) AS n, round(avg(0.9 - 0.1 * (CASE intent WHEN 'command' THEN contains(lower(prompt), 'delete')::INT + contains(lower(prompt), 'remove')::INT + contains(lower(prompt), 'destroy')::INT + contains(lower(prompt), 'kill')::INT WHEN 'debug' THEN contains(lower(prompt), 'hack')::INT + contains(lower(prompt), 'crack')::INT + contains(lower(prompt), 'exploit')::INT + contains(lower(prompt), 'attack')::INT ELSE 0 END)), 6)::DOUBLE AS safety FROM best JOIN memories USING (memory_id) GROUP BY intent", "memories"))
def intent_safety(spark, folder):
    best = I.best_intent(M.memories(spark, folder), "memory_id", "prompt")
    return best.withColumn("safety", I.safety(F.col("intent"), F.col("prompt"))).groupBy("intent").agg(F.count("*").alias("n"), F.round(F.avg("safety"), 6).alias("safety"))


@query("n01_code_metrics", "SELECT doc_id, (1 + " + " + ".join(f"len(regexp_extract_all(text, {quoted(p)}))" for p in N.BRANCHES) + ")::BIGINT AS cyclomatic, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents")
def code_metrics(spark, folder):
    t = F.col("text")
    return documents(spark, folder).select("doc_id", N.cyclomatic(t).cast("long").alias("cyclomatic"), F.size(F.split(t, "\n")).cast("long").alias("lines"))


_TOLD = f"list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '' AND NOT {like('x', V.COMMENT)})"
_HITS = [f"len(list_filter(told, lambda x: {like('x', p)}" + ("" if b else f" AND NOT {like('x', X.PLACEHOLDER)}") + "))" for _, _, p, b in V.CODE_LINES]
_CODE = f"c AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines, {' + '.join(_HITS)} AS violations, {_HITS[0]} + {_HITS[1]} AS critical, coalesce(list_sum(list_transform(told, lambda x: len(regexp_extract_all(x, '{X.PLACEHOLDER}')))), 0) AS placeholders, len(list_filter(told, lambda x: {like('x', V.IMPORT)})) AS imports, len(list_filter(told, lambda x: {like('x', V.IMPORT)} AND {like('x', V.LOCAL_IMPORT)})) AS concrete_imports FROM (SELECT doc_id, text, {_TOLD} AS told FROM documents))"


@query("v05_code_report", f"WITH {_CODE} SELECT doc_id, violations::INTEGER AS violations, critical::INTEGER AS critical, lines::INTEGER AS lines, placeholders::INTEGER AS placeholders, imports::INTEGER AS imports, concrete_imports::INTEGER AS concrete_imports, round(greatest(0.0, 1.0 - violations * 0.2 + placeholders / lines * 0.5) * CASE WHEN imports > 0 AND concrete_imports > 0 THEN 1 - concrete_imports / imports * 0.3 ELSE 1.0 END, 7)::DOUBLE AS score FROM c")
def code_report(spark, folder):
    return documents(spark, folder).select("doc_id", V.code_report(F.col("text")).alias("r")).select("doc_id", "r.*").withColumn("score", F.round("score", 7))


@query("x26_tags", "SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_concat(list_concat(regexp_extract_all(lower(text), '#([a-z0-9_]+)', 1), regexp_extract_all(lower(text), '@([a-z0-9_]+)', 1)), list_concat(regexp_extract_all(lower(text), 'tag:([a-z0-9_]+)', 1), regexp_extract_all(lower(text), 'topic:([a-z0-9_]+)', 1))))), ',') AS tags FROM conversations")
def tags(spark, folder):
    return read(spark, folder, "conversations").select("conv_id", "turn", F.array_join(X.hashtags(F.col("text")), ",").alias("tags"))


@query("x35_split_exchange", "SELECT doc_id, length(split_part(text, chr(10), 1))::BIGINT AS prompt, (CASE WHEN contains(text, chr(10)) THEN length(text) - length(split_part(text, chr(10), 1)) - 1 ELSE 0 END)::BIGINT AS response FROM documents")
def split_exchange(spark, folder):
    s = documents(spark, folder).select("doc_id", X.split_exchange(F.col("text")).alias("s"))
    return s.select("doc_id", F.length("s.prompt").cast("long").alias("prompt"), F.length("s.response").cast("long").alias("response"))
