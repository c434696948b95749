"""Measures of code texts: language, complexity, definitions, dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

#: What adds a branch.
BRANCHES = (r"\bif\b", r"\belif\b", r"\belse\s+if\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"\bexcept\b", r"&&", r"\|\|")
#: Signs of a language (pattern, weight) and its file endings.
LANGUAGES = {
    "python": (((r"(?m)^\s*def \w+\(", 2), (r"(?m)^\s*import \w+", 1), (r"(?m)^\s*from \w+ import", 2), (r"\bself\b", 1)), ("py",)),
    "javascript": (((r"\bfunction\s+\w+\s*\(", 2), (r"\b(const|let|var)\s+\w+", 1), (r"=>", 1), (r"console\.log", 2)), ("js", "jsx")),
    "typescript": (((r"\binterface\s+\w+", 2), (r":\s*(string|number|boolean)\b", 2), (r"\b(const|let)\s+\w+\s*:", 2)), ("ts", "tsx")),
}
DEFINITION = r"(?:function\s+(\w+)|class\s+(\w+)|def\s+(\w+))"


def cyclomatic(code: Column) -> Column:
    return sum((F.regexp_count(code, F.lit(p)) for p in BRANCHES), F.lit(1))


def cyclomatic_level(n: Column) -> Column:
    return F.when(n <= 5, "excellent").when(n <= 10, "good").when(n <= 20, "fair").otherwise("poor")


#: What opens a block, in a stripped line in lower case.
OPENERS = ("if ", "for ", "while ", "function")
_BLANKS = r"[\t\n\x0B\f\r\x1c-\x1f \u0085\u00a0]+"


def cognitive(code: Column) -> Column:
    """A fold over lines: one that opens a block adds one and the depth, and one more level if it holds a brace or a
    colon; then a closing brace, and any line that isn't blank, ends a level. Blank lines leave the depth as it is."""
    lines = F.transform(F.split(code, "\n", -1), lambda x: F.regexp_replace(x, f"^{_BLANKS}|{_BLANKS}$", ""))

    def step(a: Column, x: Column) -> Column:
        opens = F.lower(x).contains(OPENERS[0])
        for word in OPENERS[1:]:
            opens = opens | F.lower(x).contains(word)
        deeper = a["depth"] + F.when(opens & (x.contains("{") | x.contains(":")), 1).otherwise(0)
        ends = x.contains("}") | ((x != "") & (deeper > 0))
        return F.struct((a["total"] + F.when(opens, 1 + a["depth"]).otherwise(0)).alias("total"), F.when(ends, F.greatest(F.lit(0).cast("long"), deeper - 1)).otherwise(deeper).alias("depth"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("depth"))
    return F.aggregate(lines, start, step, lambda a: a["total"])


def halstead_difficulty(code: Column) -> Column:
    ops = F.regexp_extract_all(code, F.lit(r"[+\-*/=<>!&|%^~]+"), F.lit(0))
    words = F.regexp_extract_all(code, F.lit(r"[a-zA-Z_][A-Za-z0-9_]*"), F.lit(0))
    unique = F.size(F.array_distinct(words))
    return F.when(unique > 0, F.size(F.array_distinct(ops)) / 2 * F.size(words) / unique).otherwise(F.lit(0.0))


def maintainability(code: Column) -> Column:
    """171 less terms in volume, complexity and lines, scaled to 0 to 100."""
    words = F.size(F.regexp_extract_all(code, F.lit(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"), F.lit(0)))
    volume = F.greatest(F.lit(1.0), words * F.log2(F.greatest(F.lit(2), words)))
    lines = F.greatest(F.lit(1), F.size(F.split(code, "\n")))
    score = 171 - 5.2 * F.ln(volume) - 0.23 * cyclomatic(code) - 16.2 * F.ln(lines)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score * 100 / 171))


def language(code: Column, name: Column | None = None) -> Column:
    """The language of the file ending, else the one with the most weighted signs, else unknown."""
    scores = [F.struct((-sum((F.regexp_count(code, F.lit(p)) * w for p, w in signs), F.lit(0))).alias("minus"), F.lit(k).alias("name")) for k, (signs, _) in LANGUAGES.items()]
    best = F.array_min(F.array(*scores))
    by_text = F.when(best["minus"] < 0, best["name"]).otherwise("unknown")
    if name is None:
        return by_text
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    by_name = F.coalesce(*[F.when(ending.isin(*endings), k) for k, (_, endings) in LANGUAGES.items()])
    return F.coalesce(by_name, by_text)


def definitions(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, kind, name, shape) of the functions and classes of a table of files (key, text)."""
    each = []
    for kind, pattern in (("function", r"(?:function|def)\s+(\w+)"), ("class", r"class\s+(\w+)")):
        names = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
        each.append(files.select(key, F.lit(kind).alias("kind"), F.explode(names).alias("name")))
    both = each[0].unionByName(each[1])
    return both.withColumn("shape", X.identifier_class(F.col("name")))


def dependencies(files: DataFrame, key: str = "file") -> DataFrame:
    """(key, name, uses): a definition's body up to the next one calls another definition of the file."""
    parts = files.select(key, F.posexplode(F.split("text", r"(?=\b(?:function|def|class)\s+\w)")).alias("part", "body"))
    named = parts.select(key, F.regexp_extract("body", r"^(?:function|def|class)\s+(\w+)", 1).alias("name"), "body").where("name <> ''")
    others = named.select(key, F.col("name").alias("uses")).distinct()
    calls = named.select(key, "name", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("uses"))
    return calls.join(others, [key, "uses"], "left_semi").where("name <> uses").select(key, "name", "uses").distinct()


#: Hints of design patterns, each worth a share of the score.
HINTS = {
    "singleton": (r"_instance\b", r"getInstance|get_instance", r"__new__|static\s+instance"),
    "factory": (r"\bcreate_?\w*\s*\(", r"[Ff]actory", r"return\s+new\s+\w+|return\s+\w+\("),
    "observer": (r"subscribe|addListener|add_observer", r"notify\w*\s*\(", r"unsubscribe|removeListener|remove_observer"),
}


def pattern_hints(code: Column, least: float = 0.6) -> Column:
    """Names of the design patterns of which at least a share of the hints stand in a code text."""
    each = [F.when(sum((code.rlike(p).cast("int") for p in hints), F.lit(0)) / len(hints) >= least, F.lit(k)) for k, hints in HINTS.items()]
    return F.array_compact(F.array(*each))


def quality(code: Column) -> Column:
    """struct<score, issues> from complexity, length of lines and comments."""
    lines = F.split(code, "\n")
    issues = F.array_compact(
        F.array(
            F.when(cyclomatic(code) > 20, F.lit("complex")),
            F.when(F.exists(lines, lambda x: F.length(x) > 120), F.lit("long_lines")),
            F.when(F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(#|//|/\*|\*)"))) * 10 < F.size(lines), F.lit("few_comments")),
        )
    )
    return F.struct(F.greatest(F.lit(0.0), 1.0 - 0.2 * F.size(issues)).alias("score"), issues.alias("issues"))


def documentation_coverage(corpora: DataFrame) -> DataFrame:
    """Coverage of each corpus and what to do. corpora: functions, classes, readme, api_docs, changelog (whether there is
    one), and other columns. Reference pages count for 0.8 of the items, a read-me for 0.2; no items, no coverage."""
    items = F.col("functions") + F.col("classes")
    share = F.when(F.col("api_docs"), 0.8).otherwise(0.0) + F.when(F.col("readme"), 0.2).otherwise(0.0)
    out = corpora.withColumn("coverage", F.when(items > 0, F.least(F.lit(1.0), share)).otherwise(0.0))
    todo = (("api documentation", F.col("coverage") < 0.5), ("read-me", ~F.col("readme")), ("changelog", ~F.col("changelog")), ("examples", F.col("coverage") < 0.8))
    return out.withColumn("recommendations", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in todo])))
