"""Column functions over texts: similarity, entropy, placeholders, URL parts, classes, shortening."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

PLACEHOLDER = r"<[a-zA-Z][a-zA-Z0-9_]*>"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words of a text, each padded by two blanks before and one after."""
    padded = F.transform(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram arrays; 0 if there are none."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for the empty text and null. Characters are counted in one pass over a text
    as an array, in the order of their numbers."""
    return _entropy(text)


def may_repeat(text: Column) -> Column:
    """Whether some line holds twenty characters at four places or more: without that, no stretch of twenty or more follows
    itself three times. One sort of a line, where a pattern tries every start with every length."""
    return _may_repeat(text)


def _numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bits(text: str | None) -> float:
    if not text:
        return 0.0
    x = np.frombuffer(text.encode(), np.uint8) if text.isascii() else _numbers(text)
    n = np.bincount(x) if text.isascii() else np.unique(x, return_counts=True)[1]
    share = n[n > 0] / len(x)
    return float(0.0 - (share * np.log2(share)).sum())


def _repeats(text: str | None, size: int = 20, times: int = 4) -> bool:
    for line in re.split("[\n\r\x85\u2028\u2029]", text or ""):
        if len(line) >= size * times:
            x = _numbers(line).astype(np.uint64)
            grams = np.zeros(len(x) - size + 1, np.uint64)
            for k in range(size):
                grams = grams * np.uint64(0x9E3779B97F4A7C15) + x[k : k + len(grams)]
            grams.sort()
            if (grams[times - 1 :] == grams[: len(grams) - times + 1]).any():
                return True
    return False


@F.pandas_udf(DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    return texts.map(_bits).astype(float)


@F.pandas_udf(BooleanType())
def _may_repeat(texts: pd.Series) -> pd.Series:
    return texts.map(_repeats).astype(bool)


def placeholder_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(PLACEHOLDER))


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def placeholder_density(text: Column) -> Column:
    """Placeholders per 100 characters; 1 for the empty text."""
    return F.when(F.length(text) > 0, placeholder_count(text) * 100.0 / F.length(text)).otherwise(F.lit(1.0))


def url_parts(url: Column) -> Column:
    """struct<protocol, host, path, query> by pattern; empty where a part is missing."""
    start = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
    return F.struct(
        F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1).alias("protocol"),
        F.regexp_extract(url, start + r"([^/?#]+)", 1).alias("host"),
        F.regexp_extract(url, start + r"[^/?#]+(/[^?#]*)", 1).alias("path"),
        F.regexp_extract(url, start + r"[^?#]+\?([^#]*)", 1).alias("query"),
    )


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def lines_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the trimmed lines that aren't empty."""
    kept = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.sha2(F.array_join(kept, "\n"), 256), 1, 16)


def cache_key(text: Column, model: str, kind: str, language: str | None = None) -> Column:
    parts = [F.sha2(text, 256), F.lit(kind), F.lit(model)] + ([F.lit(language)] if language else [])
    return F.concat_ws(":", *parts)


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


#: Words that are no keywords.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "may", "might",
    "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them",
)


def keywords(text: Column, most: int = 10, stop: Sequence[str] = STOP_WORDS) -> Column:
    """The first `most` words of more than two characters that aren't stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)), 1, most)


#: Patterns of capitalised names, dotted names, calls and quoted code.
ENTITY_PATTERNS = (r"\b[A-Z][a-zA-Z]*(?:[A-Z][a-zA-Z]*)*\b", r"\b[a-z_]+\.[a-z_]+\b", r"\b[a-z_]+\(\)\b", r"`[^`]+`")


def entities(text: Column, most: int = 5) -> Column:
    """Names and code in a text, distinct and sorted, the first `most`."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ENTITY_PATTERNS]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*found))), 1, most)


def ip_class(ip: Column) -> Column:
    """Placeholder name of an address by its range."""
    part = F.split(ip, r"\.")
    a, b = F.try_element_at(part, F.lit(1)).try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    v4 = (
        F.when((a == 10) | ((a == 172) & b.between(16, 31)), "private_ip")
        .when((a == 192) & (b == 168), "local_ip")
        .when(ip == "127.0.0.1", "localhost")
        .when(ip.isin("8.8.8.8", "8.8.4.4", "1.1.1.1"), "public_dns")
        .otherwise("public_ip")
    )
    return F.when(ip.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), v4).when(ip == "::1", "localhost_ipv6").when(ip.contains(":"), "ipv6_address").otherwise("ip_address")


def masked_ip(ip: Column) -> Column:
    """The first half of a dotted address; anything else is hidden."""
    parts = F.split(ip, r"\.")
    return F.when(F.coalesce(ip, F.lit("")) == "", ip).when(F.size(parts) == 4, F.concat_ws(".", parts[0], parts[1], F.lit("***.***"))).otherwise("***REDACTED***")


def hashtags(text: Column) -> Column:
    """Distinct sorted tags written as #x, @x, tag:x or topic:x."""
    found = [F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)) for p in (r"#([a-z0-9_]+)", r"@([a-z0-9_]+)", r"tag:([a-z0-9_]+)", r"topic:([a-z0-9_]+)")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def title(text: Column, words: int = 5) -> Column:
    """The first words of a text, with ... where there are more."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(parts, 1, words), " "), F.when(F.size(parts) > words, "...").otherwise(""))


#: What tells code and documentation from other text, matched against lower case.
CODE_SIGNS = (
    "def ", "function", "class ", "import ", "from ", "if __name__", "return ", "print(", "console.log", "#!/", "<?php",
    "<script", "<html", "SELECT ", "INSERT ", "CREATE TABLE", "function(", "=>", "async ", "await ", "public class",
    "private ", "protected ", "#include",
)
DOC_SIGNS = ("readme", "documentation", "guide", "tutorial", "installation", "getting started", "api reference", "changelog", "license", "contributing")


def signs(text: Column, of: Sequence[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(x) for x in of]), lambda s: F.contains(F.lower(text), s)))


def content_type(text: Column) -> Column:
    """code if it has more signs of it than of documentation, else documentation if it has any, else text."""
    code, doc = signs(text, CODE_SIGNS), signs(text, DOC_SIGNS)
    return F.when((code > doc) & (code > 0), "code").when(doc > 0, "documentation").otherwise("text")


def identifier_class(name: Column) -> Column:
    """Placeholder of an identifier by its shape."""
    return (
        F.when(F.length(name) <= 3, F.concat(F.lit("<"), F.lower(name), F.lit(">")))
        .when(name.startswith("get_"), "<getter_method>")
        .when(name.startswith("set_"), "<setter_method>")
        .when(name.startswith("is_") | name.startswith("has_"), "<predicate_method>")
        .when(name.startswith("_"), "<private_member>")
        .when((F.upper(name) == name) & (F.lower(name) != name), "<constant>")
        .when(name.rlike("^[A-Z]"), "<class_name>")
        .otherwise("<identifier>")
    )


def reference_type(value: Column) -> Column:
    """Kind of a reference by its characters."""
    return (
        F.when(value.contains("/") | value.contains("\\"), "file_path")
        .when(value.contains("://"), "url")
        .when(value.contains("@") & value.contains("."), "user_data")
        .when(F.lower(value).rlike("password|token|key"), "credential")
        .otherwise("variable")
    )


#: Keywords of domains and of levels of complexity, in the order they are tried.
DOMAINS = {
    "database": ("sql", "database", "db", "query", "table", "index", "join"),
    "api": ("api", "rest", "endpoint", "http", "request", "response"),
    "frontend": ("html", "css", "javascript", "react", "vue", "angular"),
    "backend": ("server", "backend", "node", "python", "java", "spring"),
    "devops": ("docker", "kubernetes", "deployment", "ci/cd", "pipeline"),
}
COMPLEXITY = {
    "beginner": ("what is", "how to", "basic", "simple", "introduction"),
    "intermediate": ("optimize", "implement", "integrate", "configure"),
    "advanced": ("architecture", "performance", "scale", "distribute", "complex"),
}


def first_class(text: Column, classes: dict[str, tuple[str, ...]]) -> Column:
    """The first class one of whose keywords stands in the text; null if none does."""
    out = None
    for name, keys in classes.items():
        hit = F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.contains(F.lower(text), k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def score_bucket(score: Column) -> Column:
    return F.when(score >= 0.95, "excellent").when(score >= 0.9, "very_good").when(score >= 0.8, "good").when(score >= 0.7, "fair").otherwise("poor")


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 100, "short").when(n < 500, "medium").when(n < 2000, "long").otherwise("very_long")


def reference_similarity(left: Column, right: Column) -> Column:
    """Mean of the edit similarity and the share of common path segments."""
    most = F.greatest(F.length(left), F.length(right))
    a, b = F.split(left, "/"), F.split(right, "/")
    edit = F.when(most > 0, 1 - F.levenshtein(left, right) / most).otherwise(F.lit(1.0))
    return (edit + F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))) / 2


def compacted(text: Column, strategy: str) -> Column:
    """Shorter text. light: blank runs; moderate: quotes too and repeated lines; heavy: lists and long lines too."""
    out = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    if strategy in ("moderate", "heavy"):
        out = F.regexp_replace(out, r"(?m)^> .*\n?", "")
        out = F.array_join(F.array_distinct(F.split(out, "\n")), "\n")
    if strategy == "heavy":
        out = F.regexp_replace(out, r"(?m)^[-*] .*\n?", "")
        out = F.array_join(F.transform(F.split(out, "\n"), lambda x: truncated(x, 200)), "\n")
    return out


def split_exchange(text: Column) -> Column:
    """struct<prompt, response>: what stands before and after the first line feed."""
    parts = F.split(text, "\n", 2)
    return F.struct(parts[0].alias("prompt"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("response"))


def relative_time(then: Column, as_of: Column) -> Column:
    """just now, minutes, hours, days or weeks ago."""
    s = F.unix_timestamp(as_of) - F.unix_timestamp(then)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))

    return F.when(s < 60, "just now").when(s < 3600, ago(F.floor(s / 60), "minute")).when(s < 86400, ago(F.floor(s / 3600), "hour")).when(s < 604800, ago(F.floor(s / 86400), "day")).otherwise(ago(F.floor(s / 604800), "week"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {{name}} in place of values, and {{#if name}}...{{/if}} and {{#each name}}...{{this}}...{{/each}}
    blocks, as one expression: the template is read once, when the plan is built."""
    import re

    parts, at = [], 0
    for m in re.finditer(r"\{\{#(if|each) (\w+)\}\}(.*?)\{\{/\1\}\}|\{\{(\w+)\}\}", template, re.S):
        parts.append(F.lit(template[at : m.start()]))
        kind, name, inner, plain = m.groups()
        if plain:
            parts.append(F.coalesce(values[plain].cast("string"), F.lit("")))
        elif kind == "if":
            parts.append(F.when(F.coalesce(values[name].cast("string"), F.lit("")) != "", filled(inner, values)).otherwise(""))
        else:
            parts.append(F.array_join(F.transform(values[name], _each(inner)), ""))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def _each(inner: str):
    return lambda x: F.replace(F.lit(inner), F.lit("{{this}}"), x.cast("string"))


def is_code(text: Column, least: int = 3) -> Column:
    return signs(text, CODE_SIGNS) >= least


def formatted(text: Column) -> Column:
    """A note's text as Markdown: code in a fence, a question as a quotation, anything else as it is."""
    return F.when(is_code(text), F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(F.trim(text).endswith("?"), F.concat(F.lit("> "), text)).otherwise(text)


def reference_similarity(old: Column, new: Column) -> Column:
    """How surely one reference has become another: the mean of 1 less edit distance over the longer length, and the share
    of the old one's path segments that the new one has, over the longer path. Two empty ones are alike entirely."""
    longer = F.greatest(F.length(old), F.length(new))
    text = F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(old, new)) / longer)
    a, b = F.split(old, r"[/\\]", -1), F.split(new, r"[/\\]", -1)
    shared = F.size(F.filter(a, lambda part: F.array_contains(b, part)))
    return (text + shared / F.greatest(F.size(a), F.size(b))) / 2
