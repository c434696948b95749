"""Column functions over vectors and weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0; null for unequal lengths."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def normalised(a: Column) -> Column:
    """Unit length; zeros stay. The norm is an array of one, as a plain one would be worked out again for every component."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))[0]


def combined(prompt: Column, response: Column, share: float = 0.4) -> Column:
    """share * prompt + (1 - share) * response, normalised."""
    return normalised(F.zip_with(prompt, response, lambda x, y: x.cast("double") * share + y.cast("double") * (1 - share)))


def days_between(then: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(then)) / 86400)


def whole_days(then: Column, as_of: Column) -> Column:
    """Days that have passed entirely, by the microsecond: days_between() leaves fractions of a second out, so it counts a
    day too many for the first second of a day."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(then)) / 86_400_000_000)


def hours_between(then: Column, as_of: Column) -> Column:
    return (F.unix_timestamp(as_of) - F.unix_timestamp(then)) / 3600.0


def decayed(weight: Column, days: Column, accesses: Column, rate: Column, least: Column, faster_after: Column) -> Column:
    """Weight after exponential decay, one and a half times as fast after a while, slowed by accesses, within bounds."""
    speed = F.when(days > faster_after, 1.5).otherwise(1.0)
    w = weight * F.exp(-rate * days * speed)
    w = F.when(accesses > 1, w * (1 + F.ln(accesses) * 0.05)).otherwise(w)
    return F.least(F.greatest(w, least), F.lit(1.0))


def reinforced(weight: Column, factor: Column, strength: float = 1.0) -> Column:
    return F.greatest(F.least(weight * factor * strength, F.lit(1.0)), weight * 1.1)


def time_weight(hours: Column, scale: float = 168.0) -> Column:
    return F.exp(-hours / scale)


def linear_time_weight(hours: Column, span: float = 24.0) -> Column:
    return F.greatest(F.lit(0.0), 1 - hours / span)


def boosted(similarity: Column, membership: Column, members: Column) -> Column:
    return similarity * (1 + 0.2 * F.coalesce(membership, F.lit(0.0))) * (1 + 0.01 * F.least(F.coalesce(members, F.lit(0)), F.lit(10)))


def dynamic_threshold(readings: Column) -> Column:
    return F.least(80 + 5 * (readings - 1), F.lit(90))


def combined_weight(weight: Column, confidence: Column, temporal: Column) -> Column:
    """Weight of an edge: its own times its confidence times what time leaves of it."""
    return weight * confidence * temporal
