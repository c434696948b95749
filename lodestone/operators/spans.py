"""Reference spans with positions, overlaps resolved, and what to put in their place."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: Patterns of references (name, type, confidence, pattern).
PATTERNS = (
    ("unix_absolute", "file_path", 0.9, r"(?<![\w/])/(?:[a-zA-Z0-9_\-.]+/)*[a-zA-Z0-9_\-.]+\b"),
    ("windows_absolute", "file_path", 0.95, r'\b[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]+\b'),
    ("home_directory", "file_path", 1.0, r"~[/\\][^\s'\"<>|]+"),
    ("relative_explicit", "file_path", 0.8, r"\.{1,2}[/\\][^\s'\"<>|]+"),
    ("numeric_id_assignment", "identifier", 0.95, r"\b(?:id|ID|Id)\s*[=:]\s*(\d+)\b"),
    ("uuid", "identifier", 1.0, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    ("numeric_id_patterns", "identifier", 0.9, r"\b(?:user_id|order_id|product_id|customer_id|session_id|transaction_id)\s*[=:]\s*[\"']?(\d+)[\"']?\b"),
    ("db_primary_key", "identifier", 0.85, r"(?i)WHERE\s+id\s*=\s*(\d+)"),
    ("http_url", "url", 1.0, r"https?://[a-zA-Z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+"),
    ("database_url", "url", 1.0, r"(?:postgresql|mysql|mongodb|redis)://[^\s'\"<>]+"),
    ("file_url", "url", 1.0, r"file://[^\s'\"<>]+"),
    ("ipv4", "ip_address", 0.9, r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("ipv6", "ip_address", 0.9, r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("localhost_port", "ip_address", 0.8, r"(?:localhost|0\.0\.0\.0|127\.0\.0\.1):(\d{1,5})\b"),
    ("container_name", "container", 0.9, r"(?:container_name|--name)\s*[=:]\s*[\"']?([a-zA-Z0-9][a-zA-Z0-9_\-.]*)[\"']?"),
    ("image_tag", "container", 0.85, r"\b[a-zA-Z0-9][a-zA-Z0-9_\-.]*(?:/[a-zA-Z0-9_\-.]+)*:[a-zA-Z0-9_\-.]+\b"),
    ("container_id", "container", 0.7, r"\b[0-9a-f]{12}\b"),
    ("environment", "config", 0.7, r"\b[A-Z][A-Z0-9_]*\s*=\s*[\"']?([^\"'\s]+)[\"']?"),
    ("config_value", "config", 0.8, r"(?i)(?:host|port|database|username|server)\s*[=:]\s*[\"']?([^\"'\s,}]+)[\"']?"),
    ("iso_time", "timestamp", 1.0, r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b"),
    ("unix_time", "timestamp", 0.9, r"(?i)(?:timestamp|expires?|created_at|updated_at)\s*[=:]\s*(\d{10})\b"),
    ("api_key", "token", 0.95, r"(?i)(?:api[_\-]?key|apikey)\s*[=:]\s*[\"']?([a-zA-Z0-9_\-]{20,})[\"']?"),
    ("jwt", "token", 1.0, r"eyJ[a-zA-Z0-9_\-]+\.eyJ[a-zA-Z0-9_\-]+\.[a-zA-Z0-9_\-]+"),
    ("secret", "token", 0.8, r"(?i)(?:secret|password|token)\s*[=:]\s*[\"']?([^\s\"']{8,})[\"']?"),
    ("email", "user_data", 1.0, r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
)
#: Of patterns by name, texts one of which a text must hold for the pattern to match at all; finding these is far cheaper.
NEEDED = {
    "unix_absolute": "/", "windows_absolute": (":\\",), "home_directory": "~", "relative_explicit": ("./", ".\\"), "numeric_id_assignment": "=:", "uuid": "-",
    "numeric_id_patterns": ("_id",), "db_primary_key": "=", "http_url": ("://",), "database_url": ("://",), "file_url": ("://",), "ipv4": ".", "ipv6": ":", "localhost_port": ":",
    "container_name": ("container_name", "--name"), "image_tag": ":", "environment": "=", "config_value": "=:", "iso_time": "T", "unix_time": "=:", "api_key": "=:", "jwt": ("eyJ",),
    "secret": "=:", "email": "@",
}
#: The same as patterns, which start with what is rare.
HINTS = {"ipv4": r"\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", "ipv6": r":[0-9a-fA-F]{1,4}:[0-9a-fA-F]", "image_tag": r":[a-zA-Z0-9_\-.]", "iso_time": r"T\d{2}:"}
SCHEMA = "array<struct<type:string,value:string,start:int,stop:int,context:string,confidence:double,rule:string>>"
AROUND = 50


@lru_cache(maxsize=8)
def compiled(patterns: tuple) -> list:
    """(name, type, confidence, pattern, what is needed, hint); only the given patterns have the last two."""
    own = set(PATTERNS)
    return [(*row[:3], re.compile(row[3]), NEEDED.get(row[0], "") if row in own else "", re.compile(HINTS.get(row[0], "") if row in own else "")) for row in patterns]


def may_match(text: str, needed, hint: re.Pattern) -> bool:
    """Whether a text holds what a pattern needs, by cheap tests; nothing needed holds for every text."""
    return (not needed or any(n in text for n in needed)) and hint.search(text) is not None


def checked(name: str, kind: str, pattern: str, confidence: float = 0.8) -> tuple:
    """A user's pattern, tried on the driver before any task sees it."""
    re.compile(pattern)
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must lie between 0 and 1")
    return (name, kind, confidence, pattern)


def extracted(text: Column, patterns: tuple = PATTERNS) -> Column:
    """All references of a text with their places, by start and then by confidence. Empty for null."""

    @F.pandas_udf(SCHEMA)
    def find(texts: pd.Series) -> pd.Series:
        rules, out = compiled(patterns), []
        for t in texts:
            t, found = t or "", []
            for name, kind, confidence, p, needed, hint in rules:
                for m in p.finditer(t) if may_match(t, needed, hint) else ():
                    a, b = m.span()
                    found.append({"type": kind, "value": m.group(1) if m.groups() else m.group(0), "start": a, "stop": b, "context": t[max(0, a - AROUND) : b + AROUND], "confidence": confidence, "rule": name})
            out.append(sorted(found, key=lambda r: (r["start"], -r["confidence"], r["rule"])))
        return pd.Series(out)

    return find(text)


def without_overlaps(spans: Column) -> Column:
    """The first of spans that overlap, in their order."""
    start = F.struct(F.lit(-1).alias("stop"), F.filter(spans, lambda s: F.lit(False)).alias("kept"))

    def step(a: Column, s: Column) -> Column:
        return F.when(s["start"] >= a["stop"], F.struct(s["stop"].alias("stop"), F.concat(a["kept"], F.array(s)).alias("kept"))).otherwise(a)

    return F.aggregate(spans, start, step, lambda a: a["kept"])


#: Rules that are tried on a value before its type decides (pattern, replacement).
RULES = (
    (r"(?i)\b(current_?user|user_?obj|user_?instance|active_?user)\b", "<user_reference>"),
    (r"(?i)\b(auth_?token|session_?id|auth_?header|bearer_?token)\b", "<auth_reference>"),
    (r"\b(get|set|update|delete|create)_([a-zA-Z0-9]+)_?(by_id|by_name|by_email)\b", "$1_<entity>_$3"),
    (r"(postgresql|mysql|mongodb|redis)://([^:\s]+):([^@\s]+)@([^:/\s]+)(?::(\d+))?/([^\s?]+)", "$1://<username>:<password>@<host>/<database>"),
    (r"/api/v\d+/([a-zA-Z]+)/(\d+|[a-zA-Z0-9-]+)", "/api/<version>/$1/<resource_id>"),
    (r"arn:aws:([^:]+):([^:]+):([^:]+):([^:]+)", "arn:aws:$1:<region>:<account>:<resource>"),
    (r"s3://([a-zA-Z0-9\-.]+)/", "s3://<bucket_name>/"),
    (r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", "<email_address>"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "<ssn>"),
    (r"\b([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", "<mac_address>"),
)


def by_rule(value: Column) -> Column:
    """A value as the first rule that matches writes it; null if none does."""
    out = None
    for pattern, new in RULES:
        hit = F.regexp_replace(value, pattern, new)
        out = F.when(value.rlike(pattern), hit) if out is None else out.when(value.rlike(pattern), hit)
    return out


#: Placeholders of times (pattern of the value) and of tokens (pattern of the value, or of what stands around it in lower case), first match.
TIMES = ((r"T.*[:-]|[:-].*T", "timestamp"), (r"^[0-9]{10}$", "unix_timestamp"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "date"), (r"Mon|Tue|Wed|Thu|Fri|Sat|Sun", "http_date"))
TOKENS = (("^eyJ", None, "jwt_token"), (None, "(?s)api.*key|key.*api", "api_key"), ("^AKIA", None, "aws_access_key"), ("(?s)^.{40}$", "aws", "aws_secret"), (None, "password", "password"), (None, "token", "auth_token"), (None, "secret", "secret"))


def _first_of(rules: list[tuple[Column, str]], other: str) -> Column:
    return F.coalesce(*[F.when(c, F.lit(f"<{name}>")) for c, name in rules], F.lit(f"<{other}>"))


def by_type(kind: Column, value: Column, context: Column | None = None) -> Column:
    """A placeholder by type, from what the value looks like and, for tokens, what stands around it."""
    near = F.lower(F.coalesce(context, F.lit(""))) if context is not None else F.lit("")
    time = _first_of([(value.rlike(p), name) for p, name in TIMES], "timestamp")
    held = [((F.lit(True) if own is None else value.rlike(own)) & (F.lit(True) if around is None else near.rlike(around)), name) for own, around, name in TOKENS]
    low = F.lower(value)
    path = F.when(low.rlike(r"^(/home|/users|~)"), "<user_home>/<file_path>").when(low.rlike(r"\.(py|js|ts|java|go|rs)$"), "<source_file>").when(low.rlike(r"\.(json|ya?ml|toml|ini|env)$"), "<config_file>").otherwise("<file_path>")
    url = F.when(low.rlike("^(postgresql|mysql|mongodb|redis)://"), "<database_url>").when(low.contains("api"), "<api_endpoint>").otherwise("<url>")
    return (
        F.when(kind == "file_path", path)
        .when(kind == "url", url)
        .when(kind == "ip_address", F.concat(F.lit("<"), X.ip_class(value), F.lit(">")))
        .when(kind == "identifier", F.when(value.rlike("^[0-9]+$"), "<numeric_id>").otherwise("<uuid>"))
        .when(kind == "container", "<container_name>")
        .when(kind == "config", "<config_value>")
        .when(kind == "timestamp", time)
        .when(kind == "token", _first_of(held, "token"))
        .otherwise(F.concat(F.lit("<"), kind, F.lit(">")))
    )


def abstraction(kind: Column, value: Column, context: Column | None = None) -> Column:
    return F.coalesce(by_rule(value), by_type(kind, value, context))


def report(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, value, start, stop, placeholder) of the references that stand after overlaps are resolved."""
    each = texts.select(key, F.explode(without_overlaps(extracted(F.col("text")))).alias("s")).select(key, "s.type", "s.value", "s.start", "s.stop", "s.confidence", "s.context")
    return each.withColumn("placeholder", abstraction(F.col("type"), F.col("value"), F.col("context"))).drop("context")


#: Shares of a validation's score.
WEIGHTS = {"coverage": 0.30, "errors": 0.25, "consistency": 0.20, "quality": 0.15, "warnings": 0.10}


def staged_score(coverage: Column, critical: Column, errors: Column, consistency: Column, quality: Column, warnings: Column) -> Column:
    """Weighted score of five stages; halved by any critical error; within 0 and 1."""
    parts = {"coverage": coverage, "errors": F.greatest(F.lit(0.0), 1 - 0.2 * critical - 0.1 * errors), "consistency": consistency, "quality": quality, "warnings": F.greatest(F.lit(0.0), 1 - 0.05 * warnings)}
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(critical > 0, total * 0.5).otherwise(total)))


#: Shares of the quality of an abstraction.
QUALITY = {"specificity": 0.20, "consistency": 0.25, "completeness": 0.20, "semantic": 0.15, "efficiency": 0.10, "maintainability": 0.10}


def quality_score(parts: dict[str, Column]) -> Column:
    return sum((parts[k] * w for k, w in QUALITY.items()), F.lit(0.0))


#: What raises or lowers the parts of an abstraction's quality.
SPECIFIC = ("_id", "_url", "_path", "_key", "_token", "_config", "_service", "_host", "_port", "_database", "_user")
GENERIC = ("reference", "value", "data", "item", "thing")
CONTEXT = (("user", "user"), ("database", "db"), ("config", "config"))
CONCEPTS = {
    "user": ("user", "person", "account"), "database": ("db", "database", "data"), "config": ("config", "setting", "option"),
    "auth": ("auth", "login", "credential"), "api": ("api", "service", "endpoint"), "file": ("file", "path", "document"),
    "network": ("network", "ip", "host"), "time": ("time", "date", "timestamp"),
}
KEPT = ("id", "key", "token")
UNCLEAR = ("tmp", "cfg", "usr", "sys", "obj", "var")
CRITICAL_TYPES = ("credential", "file_path", "url")
LEVELS = (("excellent", 0.9), ("good", 0.8), ("acceptable", 0.7), ("poor", 0.5))


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _bounded(parts: list[tuple[Column, float]]) -> Column:
    """0.5 and what applies of the parts, within 0 and 1."""
    score = sum((F.when(c, w).otherwise(0.0) for c, w in parts), F.lit(0.5))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def specificity(original: Column, abstracted: Column) -> Column:
    low, name = F.lower(abstracted), F.lower(original)
    context = [(name.contains(a) & low.contains(b), 0.1) for a, b in CONTEXT]
    return _bounded([(_any(low, SPECIFIC), 0.3), (low.contains("_"), 0.2), (_any(low, GENERIC), -0.3), *context])


def meaning(original: Column, abstracted: Column) -> Column:
    """Whether a placeholder still tells what it stands for."""
    low, name = F.lower(abstracted), F.lower(original)
    parts = []
    for concept, signs in CONCEPTS.items():
        parts += [(name.contains(concept) & _any(low, signs), 0.2), (name.contains(concept) & ~_any(low, signs), -0.1)]
    parts += [(name.contains(k) & low.contains(k), 0.15) for k in KEPT]
    return _bounded([*parts, (F.length(_bare(low)) < 3, -0.2)])


def _bare(placeholder: Column) -> Column:
    return F.regexp_replace(placeholder, "^[<>]+|[<>]+$", "")


def maintainable(abstracted: Column) -> Column:
    name = _bare(abstracted)
    words, fits = F.split(name, "_"), F.length(name).between(5, 25)
    return _bounded([
        (name.rlike("^[a-z][a-z0-9_]*[a-z0-9]$"), 0.2), (fits, 0.15), (~fits, -0.1), (_any(name, UNCLEAR), -0.1),
        ((F.size(words) == 2) & F.forall(words, lambda w: F.length(w) > 2), 0.15), (F.size(words) > 4, -0.2),
    ])


def _alike(a: Column, b: Column) -> Column:
    """Whether two placeholders follow one pattern: six tenths of their words are the same, or one holds the other."""
    a, b = _bare(a), _bare(b)
    x, y = F.split(a, "_"), F.split(b, "_")
    same = F.size(F.filter(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), lambda e: e))
    parts = (F.size(x) > 1) & (F.size(y) > 1) & (F.size(x) == F.size(y))
    return F.when(parts, same >= F.size(x) * 0.6).otherwise(F.contains(a, b) | F.contains(b, a))


def quality_parts(texts: DataFrame, abstractions: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, the six parts of QUALITY) of each text. abstractions: key, type, original, abstracted; references: key, type,
    value: all that should be abstracted. A text without abstractions has specificity 0 and 1 for the other parts, one
    without references is complete. Pairs of placeholders are counted by type, within a text."""
    told = abstractions.select(key, "type", "original", "abstracted")
    scored = told.withColumns({"spec": specificity(F.col("original"), F.col("abstracted")), "sem": meaning(F.col("original"), F.col("abstracted")), "main": maintainable(F.col("abstracted"))})
    form = F.when(F.col("abstracted").rlike("^<.*>$"), "angle").when(F.col("abstracted").rlike(r"^\{.*\}$"), "curly").when(F.col("abstracted").rlike(r"^\[.*\]$"), "square").otherwise("none")
    ratio = F.sum(F.length("abstracted")) / F.sum(F.length("original"))
    shape = F.when(ratio.between(0.3, 0.7), 1.0).when(ratio < 0.3, ratio / 0.3).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 0.7) / 0.3))
    critical = F.count_if(F.col("type").isin(*CRITICAL_TYPES))
    each = scored.groupBy(key).agg(
        F.avg("spec").alias("specificity"), F.avg("sem").alias("semantic"), F.avg("main").alias("maintainability"), F.countDistinct(form).alias("forms"), F.count("*").alias("n"), critical.alias("n_critical"),
        (0.5 * F.coalesce(shape, F.lit(1.0)) + 0.3 * F.countDistinct("abstracted") / F.count("*") + 0.2).alias("efficiency"),
    )
    names = told.select(key, "type", "abstracted").distinct()
    pairs = names.join(names.withColumnRenamed("abstracted", "other"), [key, "type"]).where("abstracted < other")
    odd = pairs.groupBy(key, "type").agg((F.count_if(~_alike(F.col("abstracted"), F.col("other"))) / F.count("*") * 0.3).alias("odd")).groupBy(key).agg(F.sum("odd").alias("odd"))
    shared = told.groupBy(key, "abstracted").agg(F.countDistinct("original").alias("k"), F.count("*").alias("m"))
    mapped = shared.groupBy(key).agg((F.sum(F.when(F.col("k") == 1, F.col("m")).otherwise(0)) / F.sum("m")).alias("mapped"))
    due = references.groupBy(key).agg(F.count("*").alias("due"), critical.alias("due_critical"))
    folder = F.regexp_extract("original", "^(.*)/[^/]*$", 1)
    split = told.where("type = 'file_path'").groupBy(key, folder.alias("folder")).agg(F.countDistinct("abstracted").alias("k")).where("k > 1").groupBy(key).agg(F.least(F.lit(0.5), F.count("*") * 0.1).alias("split"))
    out = texts.select(key)
    for part in (each, odd, mapped, due, split):
        out = out.join(part, key, "left")
    cover = F.col("n") / F.col("due")
    cover = F.when(F.col("due_critical") > 0, 0.3 * cover + 0.7 * F.col("n_critical") / F.col("due_critical")).otherwise(cover)
    lost = F.coalesce("odd", F.lit(0.0)) + (1 - F.col("mapped")) * 0.4 + F.when(F.col("forms") > 1, 0.3 * 0.3).otherwise(0.0)
    parts = {
        "specificity": F.coalesce("specificity", F.lit(0.0)),
        "consistency": F.when(F.col("n").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - lost)),
        "completeness": F.when(F.col("due").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cover, F.lit(0.0)) - F.coalesce("split", F.lit(0.0))))),
        **{c: F.coalesce(c, F.lit(1.0)) for c in ("semantic", "efficiency", "maintainability")},
    }
    return out.select(key, *[parts[c].alias(c) for c in QUALITY])


def quality_level(score: Column) -> Column:
    out = F.when(score >= LEVELS[0][1], LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("unacceptable")


def first_failure(stages: list[tuple[str, Column]]) -> Column:
    """The name of the first stage that doesn't hold; null if all do. Null counts as not holding."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(stages):
        out = F.when(~F.coalesce(holds, F.lit(False)), name).otherwise(out)
    return out
