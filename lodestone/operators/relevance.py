"""How relevant documents are to what a user works on, and the best of them that a budget holds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.views import within_budget

#: What refers to a file (the first group), shares of the score, and boosts (beyond or below a bound, factor; first match).
REFERENCES = (r"<project>/([^>\s]+)", r"\[([^\]]+)\]\([^)]+\)", r"""(?:from|import)\s+['"]([^'"]+)['"]""", r"""(?:src|href)=["']([^"']+)["']""")
SHARES = {"current": 0.4, "recent": 0.3, "symbols": 0.2, "branch": 0.1}
RECENCY = ((1, 1.5), (7, 1.2))
ACCESSES = ((10, 1.3), (5, 1.1))
STAGES = (("active", 1.2), ("archived", 0.5))


@dataclass(frozen=True)
class Context:
    """What a user works on: the file that is open, files of late, symbols in view, the branch."""

    current: str | None = None
    recent: Sequence[str] = ()
    symbols: Sequence[str] = ()
    branch: str | None = None


def file_references(text: Column) -> Column:
    """All that a text refers to as files, in lower case. None for null."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in REFERENCES]))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda r: F.lower(r))


def refers_to(references: Column, path: str) -> Column:
    """Whether any reference is part of the path, holds its last part, or shares over half the parts of the shorter one."""
    path = path.lower()
    parts = [p for p in path.replace("\\", "/").split("/") if p]
    if not parts:
        return F.lit(False)

    def related(r: Column) -> Column:
        own = F.filter(F.split(r, r"[/\\]"), lambda p: p != "")
        shared = F.size(F.filter(own, lambda p: p.isin(*parts)))
        return F.lit(path).contains(r) | r.contains(parts[-1]) | (shared > 0.5 * F.least(F.size(own), F.lit(len(parts))))

    return F.exists(references, related)


def _share(flags: list[Column]) -> Column:
    return sum((f.cast("int") for f in flags), F.lit(0)) / max(1, len(flags))


def relevance(text: Column, references: Column, context: Context) -> Column:
    """Score of a text in a context, 0 to 1 before boosts. What a context lacks adds nothing; a null text has 0."""
    held = F.coalesce(text, F.lit(""))
    parts = {
        "current": _share([refers_to(references, context.current)] if context.current else []),
        "recent": _share([refers_to(references, p) for p in context.recent]),
        "symbols": _share([held.contains(s) for s in context.symbols]),
        "branch": _share([held.contains(context.branch)] if context.branch else []),
    }
    return sum((parts[k] * w for k, w in SHARES.items()), F.lit(0.0))


def boost(days: Column, accesses: Column, stage: Column) -> Column:
    """Factor for documents changed of late, read often, active or archived. Null raises and lowers nothing."""

    def first(cases: list[tuple[Column, float]]) -> Column:
        return F.coalesce(*[F.when(c, w) for c, w in cases], F.lit(1.0))

    return first([(days < d, w) for d, w in RECENCY]) * first([(accesses > n, w) for n, w in ACCESSES]) * first([(stage == s, w) for s, w in STAGES])


def scored(documents: DataFrame, context: Context) -> DataFrame:
    """(id, score, tokens) of documents: id, text, days (since the last change), accesses, stage. A token is four characters."""
    told = documents.withColumn("__refs", file_references(F.col("text")))
    score = relevance(F.col("text"), F.col("__refs"), context) * boost(F.col("days"), F.col("accesses"), F.col("stage"))
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    return told.select("id", F.round(score, 8).alias("score"), tokens.alias("tokens"))


def most_relevant(documents: DataFrame, context: Context, budget: int, most: int = 5) -> DataFrame:
    """(id, score, tokens, used): by score and then id, at most `most` documents that fit `budget` tokens, past those that don't."""
    return within_budget(scored(documents, context), [], budget, most)
