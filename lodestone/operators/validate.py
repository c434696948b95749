"""Scores and verdicts on texts: how safe they are, and how well they are abstracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

from . import detect

HAS_PLACEHOLDER = X.PLACEHOLDER


def score_of(length: Column, held: Column, references: Column) -> Column:
    """0 to 1 from placeholders and the number of concrete references: at most 0.5 with any of these, 0 if there is no
    placeholder beside them, 0 for the empty text; two decimals."""
    base = F.when(references == 0, 0.7).otherwise(F.greatest(F.lit(0.0), 0.7 - references * 0.2))
    score = F.least(F.lit(1.0), held * 0.3 + base)
    score = F.when(references > 0, F.least(score, F.lit(0.5))).otherwise(score)
    score = F.when((held == 0) & (references > 0), 0.0).otherwise(score)
    return F.when(length == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 2))


def abstraction_score(text: Column, references: Column) -> Column:
    return score_of(F.length(text), X.placeholder_count(text), references)


def abstraction_quality(text: Column, least: float = 0.8) -> Column:
    """struct<score, violation_count, critical_count, has_placeholders, meets_minimum>."""
    found = detect.violations(text)
    score = abstraction_score(text, F.size(found))
    return F.struct(
        score.alias("score"),
        F.size(found).alias("violation_count"),
        F.size(F.filter(found, lambda v: v["severity"] == "critical")).alias("critical_count"),
        text.rlike(HAS_PLACEHOLDER).alias("has_placeholders"),
        (score >= least).alias("meets_minimum"),
    )


def coverage_score(coverage: Column, errors: Column, warnings: Column) -> Column:
    """Score from coverage, less for each error and warning, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), coverage - errors * 0.2 - warnings * 0.05))


#: Protocols that are not unusual.
PROTOCOLS = ("http", "https", "ftp", "sftp", "ssh", "git", "ws", "wss")


def url_violations(url: Column) -> Column:
    """array<struct<type, severity>> of a URL's violations; one `invalid_url` if it is none."""
    part = X.url_parts(url)

    def one(when: Column, kind: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))

    def put(c: Column) -> Column:
        return c.rlike(HAS_PLACEHOLDER)

    host = part["host"]
    domain = (
        F.when(host.rlike(r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.struct(F.lit("concrete_ip").alias("type"), F.lit("critical").alias("severity")))
        .when(host.rlike(r"^(localhost|127\.0\.0\.1)") & ~put(host), F.struct(F.lit("localhost_reference").alias("type"), F.lit("high").alias("severity")))
        .when(~put(host) & host.rlike(r"\.(local|internal|corp|test)$"), F.struct(F.lit("internal_domain").alias("type"), F.lit("high").alias("severity")))
    )
    each = F.array_compact(
        F.array(
            one(~part["protocol"].isin(*PROTOCOLS), "unusual_protocol", "medium"),
            domain,
            one(part["path"].rlike("/(home|Users)/[a-zA-Z0-9_-]+"), "file_path_in_url", "critical"),
            one(part["query"].rlike("(?i)(api_key|token|secret|password)=[^&]+") & ~put(part["query"]), "credential_in_url", "critical"),
        )
    )
    bad = F.array(F.struct(F.lit("invalid_url").alias("type"), F.lit("critical").alias("severity")))
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), each).otherwise(bad)


def url_score(url: Column, found: Column) -> Column:
    n, held = F.size(found), url.rlike(HAS_PLACEHOLDER)
    score = (
        F.when(~held & (n > 0), 0.0)
        .when(held & (n == 0), 1.0)
        .when(held, F.greatest(F.lit(0.3), 1.0 - n * 0.3))
        .otherwise(F.lit(0.5))
    )
    return F.when(url.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), score).otherwise(0.0)


#: Shapes of credentials.
CREDENTIALS = (
    r"sk_[a-zA-Z0-9]{32,}",
    r"pk_[a-zA-Z0-9]{32,}",
    r"api_[a-zA-Z0-9]{32,}",
    r"key-[a-zA-Z0-9]{32,}",
    r"AKIA[0-9A-Z]{16}",
    r"aws_[a-zA-Z0-9]{32,}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"gho_[a-zA-Z0-9]{36}",
    r"ghu_[a-zA-Z0-9]{36}",
    r"[a-zA-Z0-9_-]{40,}",
    r"eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+",
)


def credential_violations(text: Column, field: Column | None = None, bits: float = 4.5) -> Column:
    """array<struct<type, severity>>: a credential's shape, high entropy, base64, a sensitive field's value."""

    def one(when: Column, kind: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity")))

    open_ = ~text.rlike(HAS_PLACEHOLDER)
    each = [
        one(open_ & text.rlike("|".join(f"(?:{p})" for p in CREDENTIALS)), "credential_pattern", "critical"),
        one(open_ & (F.length(text) >= 20) & (X.entropy(text) > bits), "high_entropy", "high"),
        one((F.length(text) > 40) & text.rlike(r"^[A-Za-z0-9+/]+={0,2}$"), "base64_content", "medium"),
    ]
    if field is not None:
        each.append(one(open_ & (F.length(text) > 0) & field.rlike("(?i)(password|secret|token|key|credential)"), "sensitive_field", "critical"))
    return F.array_compact(F.array(*each))


def credential_score(text: Column, found: Column) -> Column:
    return F.when(F.size(found) > 0, 0.0).when(text.rlike(HAS_PLACEHOLDER), 1.0).otherwise(0.8)


#: Violations of a line of code (type, severity, pattern, may stand beside a placeholder).
CODE_LINES = (
    ("hardcoded_path", "critical", r"""["'](?:/(home|Users)/[a-zA-Z0-9_.-]+|[A-Z]:\\[a-zA-Z0-9_\\.-]+)""", True),
    ("hardcoded_credential", "critical", r"""(?i)(password|secret|api_key|token)\s*[:=]\s*["'][^"']+["']""", False),
    ("hardcoded_url", "high", r"https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", False),
    ("hardcoded_ip", "high", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", False),
)
COMMENT, IMPORT, LOCAL_IMPORT = r"^\s*(//|#|--|\*)", r"(?i)^\s*(import|include|require|using|from .* import)", r"""["']\.{0,2}/[^"']+["']"""


def code_report(code: Column) -> Column:
    """struct<violations, critical, lines, placeholders, imports, concrete_imports, score> of a code text; blank lines
    and comments count as lines only."""
    lines = F.split(code, "\n")
    told = F.filter(lines, lambda x: (F.trim(x) != "") & ~x.rlike(COMMENT))

    def hits(pattern: str, beside: bool) -> Column:
        return F.size(F.filter(told, lambda x: x.rlike(pattern) & (F.lit(beside) | ~x.rlike(HAS_PLACEHOLDER))))

    each = [hits(p, b) for _, _, p, b in CODE_LINES]
    found, critical = sum(each[1:], each[0]), each[0] + each[1]
    held = F.aggregate(told, F.lit(0), lambda a, x: a + X.placeholder_count(x))
    imports = F.size(F.filter(told, lambda x: x.rlike(IMPORT)))
    concrete = F.size(F.filter(told, lambda x: x.rlike(IMPORT) & x.rlike(LOCAL_IMPORT)))
    score = F.greatest(F.lit(0.0), 1.0 - found * 0.2 + held / F.size(lines) * 0.5)
    score = F.when((imports > 0) & (concrete > 0), score * (1 - concrete / imports * 0.3)).otherwise(score)
    return F.struct(found.alias("violations"), critical.alias("critical"), F.size(lines).alias("lines"), held.alias("placeholders"), imports.alias("imports"), concrete.alias("concrete_imports"), score.alias("score"))


def composite_score(base_violations: Column, critical: Column, component: Column | None = None) -> Column:
    """0 with any critical violation; else the component's score, or 1, less 0.1 for each violation."""
    score = F.lit(1.0) if component is None else F.round(component, 2)
    return F.when(critical > 0, 0.0).otherwise(F.greatest(F.lit(0.0), score - base_violations * 0.1))


def consistency(text: Column, content_type: str = "general") -> Column:
    """struct<score, issues>: mixed placeholder styles and names, and what a type of content adds."""
    has = text.rlike
    issues = [F.when(has(HAS_PLACEHOLDER) & has(r"\{[a-zA-Z][a-zA-Z0-9_]*\}"), 1), F.when(has("<file_path>") & has("<filepath>"), 1)]
    if content_type == "code":
        issues.append(F.when(has("<[a-z][a-zA-Z0-9_]*>") & has("<[A-Z][a-zA-Z0-9_]*>"), 1))
    elif content_type == "url":
        issues.append(F.when(has("https?://<[^>]+>/") & ~has("https?://<[^>]+>:<port>/"), 1))
    elif content_type == "path":
        issues.append(F.when(has("<[^>]+>/[^<]") & has(r"<[^>]+>\\[^<]"), 2))
    weight = sum((F.coalesce(i, F.lit(0)) for i in issues), F.lit(0))
    return F.struct(F.greatest(F.lit(0.0), 1.0 - weight * 0.2).alias("score"), weight.alias("issues"))


def completeness(text: Column, pairs: Column) -> Column:
    """struct<missing, unused, score>: placeholders without a mapping, mappings without a placeholder."""
    held, known = F.array_distinct(X.placeholders(text)), F.map_values(pairs)
    missing, unused = F.size(F.array_except(held, known)), F.size(F.array_except(known, held))
    share = F.when(F.size(held) > 0, 1 - missing / F.size(held)).otherwise(1.0)
    return F.struct(missing.alias("missing"), unused.alias("unused"), F.when(unused > 0, share * 0.9).otherwise(share).alias("score"))


def density_valid(text: Column, least: float = 0.1) -> Column:
    return X.placeholder_density(text) >= least


def semantic_quality(text: Column, abstract: Column, pairs: Column) -> Column:
    """struct<score, issues, reconstructable> of an abstracted text and its map of values to placeholders: less 0.3 if no
    placeholder of the map stands in it, 0.2 if it is less than half as long, 0.1 if its lines are gone, and 0.05 for each
    placeholder whose name is short or starts with no letter."""
    back = detect.restored(abstract, pairs)
    names = F.transform(F.map_values(pairs), lambda v: F.regexp_replace(v, "^<|>$", ""))
    poor = F.size(F.filter(names, lambda n: (F.length(n) < 3) | ~n.rlike("^[a-zA-Z]")))
    found = (
        ("no_substitution", 0.3, (back == abstract) & (F.size(pairs) > 0)),
        ("over_abstraction", 0.2, F.length(abstract) < F.length(text) * 0.5),
        ("structure_loss", 0.1, text.contains("\n") & ~abstract.contains("\n")),
    )
    score = 1.0 - sum((F.when(c, w).otherwise(0.0) for _, w, c in found), F.lit(0.0)) - 0.05 * poor
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in found], F.when(poor > 0, F.lit("poor_placeholder_name"))))
    return F.struct(F.greatest(F.lit(0.0), score).alias("score"), issues.alias("issues"), (back != abstract).alias("reconstructable"))


def corpus_audit(files: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """Files checked, passed (a score of at least `least`) and failed by a key, the mean score, and the violations of
    those that failed. files: key, score, violations."""
    ok = F.col("score") >= least
    return files.groupBy(key).agg(F.count("*").alias("checked"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.avg("score").alias("safety"), F.sum(F.when(ok, 0).otherwise(F.col("violations"))).alias("violations"))


def overall_quality(density: Column, consistent: Column, complete: Column, semantic: Column, safety: Column) -> Column:
    return (0.25 * density + 0.25 * consistent + 0.3 * complete + 0.2 * semantic) * 0.8 + 0.2 * safety


#: What a violation leaves of a quality score, by severity.
PENALTY = {"critical": 0.3, "high": 0.7, "medium": 0.9, "low": 0.95}


def memory_score(found: Column, quality: Column, density: Column) -> Column:
    """Quality times a factor for each violation, a tenth more for dense placeholders, within 0 and 1."""

    def step(score: Column, v: Column) -> Column:
        factor = F.lit(1.0)
        for severity, share in PENALTY.items():
            factor = F.when(v["severity"] == severity, share).otherwise(factor)
        return score * factor

    score = F.aggregate(found, quality.cast("double"), step)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(density > 1, score * 1.1).otherwise(score)))


def status(score: Column) -> Column:
    return F.when(score >= 0.8, "validated").when(score >= 0.5, "pending").otherwise("rejected")


def query_score(original: Column, references: Column) -> Column:
    """0.9 less 0.1 for each reference, at least 0.5; 1 without any."""
    return F.when(references == 0, 1.0).otherwise(F.greatest(F.lit(0.5), 0.9 - 0.1 * references))


def storage_ready(columns: list[str], score: Column, least: float = 0.8) -> Column:
    """Whether a row has all that storage asks for and scores enough."""
    held = F.lit(True)
    for c in columns:
        held = held & F.col(c).isNotNull() & (F.length(F.col(c).cast("string")) > 0)
    return F.coalesce(held & (score >= least), F.lit(False))


def note_score(parts: list[Column]) -> Column:
    """1 less 0.1 for each concrete reference in a note's components, at least 0."""
    found = sum((F.size(detect.violations(F.coalesce(p, F.lit("")))) for p in parts), F.lit(0))
    return F.greatest(F.lit(0.0), 1.0 - 0.1 * found)


def reference_row(concrete: Column, abstract: Column) -> Column:
    """What is wrong with a reference: no abstraction, one that is still concrete, or null."""
    return F.when(F.coalesce(concrete, F.lit("")).rlike(".") & (F.coalesce(abstract, F.lit("")) == ""), "missing_abstraction").when(detect.pattern_hits(abstract) > 0, "still_concrete")


def verdict(open_references: Column, score: Column) -> Column:
    return F.when(open_references > 0, F.concat(open_references.cast("string"), F.lit(" references are not abstracted"))).when(score < 0.8, F.format_string("score %.2f is too low", score)).otherwise("complete")


def merge_safe(text: Column, most: int = 5) -> Column:
    """Whether a merged text has few enough references and no unclosed code fence."""
    return (detect.pattern_hits(text) <= most) & (F.regexp_count(text, F.lit("(?m)^```")) % 2 == 0)
