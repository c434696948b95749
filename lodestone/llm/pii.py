"""Personal data: base spans by pattern, and terms that give the found entities away, by corpus co-occurrence.

Everything here is DataFrame and SQL functions. Base spans are the leftmost non-overlapping matches of four patterns.
Spark gives no match positions, so they come from the lengths of the matches and of what `split` leaves between them.

An entity is a distinct base value. A term (a word of `SHORTEST` letters or more) that stands near it, within `AROUND`
characters, in `SUPPORT` documents or more tells p(entity | term) about it. With document counts n over N documents,
where n(t, e) counts the documents that hold both, however far apart,
    IC(e) = log2(N / n(e))      PMI(t; e) = log2(N * n(t, e) / (n(t) * n(e)))
and PMI(t; e) / IC(e) is the share of the entity that the term discloses: 1 if it stands nowhere without it. A term that
discloses `GENERALISE` or more of an entity is a span of kind `term` wherever it stands, also in texts without the
entity, to be replaced by a placeholder; from `REMOVE` on it is to be removed. Counts cover all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

AROUND, SHORTEST, SUPPORT, GENERALISE, REMOVE = 48, 4, 3, 0.8, 0.95
#: Beyond so many distinct terms, counts are joined by a shuffle and no longer by a broadcast.
BROADCAST_TERMS = 100_000

KINDS = ("email", "ip", "card", "phone")
#: The given patterns with runs that don't backtrack. A run starts where none reaches to from before, or where the
#: previous match ended; so each is linear in the text and matches what the plain one does.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a match at all.
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}


WORD = r"\p{L}{" + str(SHORTEST) + ",}+"


def literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _passes(kind: str, value: str) -> str:
    """SQL for whether a match of this kind stands."""
    digits = f"regexp_replace({value}, '[^0-9]', '')"
    if kind == "ip":
        return f"{value} rlike {literal(r'^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:[.]0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$')}"
    if kind == "phone":
        return f"length({digits}) between 9 and 15"
    if kind == "card":  # Luhn: every second digit from the right is doubled, less 9 if over 9
        d = f"cast(substring(reverse({digits}), i, 1) as int)"
        luhn = f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if(i % 2 = 1, {d}, 2 * {d} - if({d} > 4, 9, 0))) % 10 = 0"
        return f"(length({digits}) between 12 and 19 and {luhn})"
    return "true"


SPAN = "struct<start:bigint,rank:int,stop:bigint,kind:string,value:string>"


def found(text: str, kind: str, pattern: str, rank: int, passes: str = "true") -> str:
    """SQL for the array of spans of a pattern in a text: code points, end exclusive, those that pass `passes` on x.v."""
    got, left = f"regexp_extract_all({text}, {literal(pattern)}, 0)", f"split({text}, {literal(pattern)}, -1)"
    return f"""aggregate(
        zip_with({got}, slice({left}, 1, size({got})), (v, g) -> named_struct('v', v, 'g', length(g))),
        named_struct('at', 0L, 'out', cast(array() as array<{SPAN}>)),
        (a, x) -> named_struct('at', a.at + x.g + length(x.v), 'out', if({passes}, concat(a.out, array(named_struct(
            'start', a.at + x.g, 'rank', {rank}, 'stop', a.at + x.g + length(x.v), 'kind', '{kind}', 'value', x.v))), a.out)),
        a -> a.out)"""


def base_spans(text: str) -> Column:
    """All base spans of a text, by start and then by kind as listed."""
    none = f"cast(array() as array<{SPAN}>)"
    each = [f"if({text} rlike {literal(NEEDS[k])}, {found(text, k, PATTERNS[k], i, _passes(k, 'x.v'))}, {none})" for i, k in enumerate(KINDS)]
    return F.expr(f"array_sort(concat({', '.join(each)}))")


def near_terms(text: str, spans: str) -> Column:
    """Terms near each base span of a text: (kind, value) of the entity, term, start, stop. A word that the window cuts,
    and one that touches a base span, is none."""
    term = "struct<kind:string,value:string,term:string,start:bigint,stop:bigint>"

    def side(begin: str, end: str, whole_left: str, whole_right: str) -> str:
        part = f"substring({text}, cast({begin} + 1 as int), cast({end} - {begin} as int))"
        kept = f"filter({found(part, 'term', WORD, 0)}, w -> ({whole_left} or w.start > 0) and ({whole_right} or w.stop < {end} - {begin}))"
        shifted = f"transform({kept}, w -> named_struct('kind', s.kind, 'value', lower(s.value), 'term', lower(w.value), 'start', w.start + {begin}, 'stop', w.stop + {begin}))"
        return f"filter({shifted}, w -> not exists({spans}, b -> b.start < w.stop and w.start < b.stop))"

    low, high = f"greatest(0L, s.start - {AROUND})", f"least(cast(length({text}) as bigint), s.stop + {AROUND})"
    left, right = side(low, "s.start", f"{low} = 0", "true"), side("s.stop", high, "true", f"{high} = length({text})")
    return F.expr(f"flatten(transform({spans}, s -> cast(concat({left}, {right}) as array<{term}>)))")


def terms_of(rows: DataFrame) -> DataFrame:
    """(row_id, term): the distinct terms of each text."""
    return rows.select("row_id", F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(text, {literal(WORD)}, 0), w -> lower(w)))")).alias("term"))


def disclosing(near: DataFrame, entities: DataFrame, held: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(term, share) of the terms that disclose an entity, with the greatest share. near: row_id, kind, value, term;
    entities: row_id, kind, value; words: row_id, term, once each, of all rows; held: the same of rows with entities."""
    entity = ["kind", "value"]
    pairs = near.groupBy(*entity, "term").agg(F.countDistinct("row_id").alias("n_near")).where(F.col("n_near") >= SUPPORT)
    pairs = stored(pairs.drop("n_near"))
    #: Counted before anything is joined to them: as many rows as there are terms, not places.
    n_term = words.groupBy("term").agg(F.count("*").alias("n_term"))
    n_term = stored(n_term.join(pairs.select("term").distinct(), "term"))
    n_entity = entities.groupBy(*entity).agg(F.count("*").alias("n_entity"))
    #: n(t, e) is counted in the rows of the entity only.
    both = entities.join(pairs, entity).join(held, ["row_id", "term"]).groupBy(*entity, "term").agg(F.count("*").alias("n_both"))
    known = both.join(n_term, "term").join(n_entity, entity)
    pmi = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    share = F.when(F.col("n_entity") < total, pmi / F.log2(F.lit(float(total)) / F.col("n_entity")))
    telling = known.withColumn("share", share).where(F.col("share") >= GENERALISE)
    out = stored(telling.groupBy("term").agg(F.max("share").alias("share")))
    discard(pairs)
    discard(n_term)
    return out


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, `spans`, an array of (start, rank, stop, kind, value) with kinds email, ip, card,
    phone and term, by start and then by kind, `remove`, the starts of the terms to be removed, and `clean`, the text
    with spans replaced or removed.

    Null text counts as empty, and both have no spans. Repeated rows and null doc_ids are treated row by row. A text of
    any length is searched whole. Only doc_id and text are read. An empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    based = texts.withColumn("spans", base_spans("text"))
    near = F.when(F.size("spans") > 0, near_terms("text", "spans"))
    rows = stored(based.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text", "spans", near.alias("near")))
    seen = rows.select("row_id", F.explode("near").alias("w")).select("row_id", "w.kind", "w.value", "w.term")
    entities = rows.select("row_id", F.explode("spans").alias("s")).select("row_id", "s.kind", F.lower("s.value").alias("value")).distinct()
    words = terms_of(rows)
    telling = disclosing(seen, entities, terms_of(rows.where(F.size("spans") > 0)), words, rows.count())
    listed = F.broadcast(telling) if telling.count() <= BROADCAST_TERMS else telling
    told = words.join(listed, "term").groupBy("row_id").agg(F.collect_list("term").alias("told"), F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term"))).alias("gone"))
    none = f"cast(array() as array<{SPAN}>)"
    all_terms = found("text", "term", WORD, len(KINDS), "array_contains(told, lower(x.v))")
    free = f"filter({all_terms}, w -> not exists(spans, b -> b.start < w.stop and w.start < b.stop))"
    lowered = f"transform({free}, w -> named_struct('start', w.start, 'rank', w.rank, 'stop', w.stop, 'kind', w.kind, 'value', lower(w.value)))"
    out = rows.select("row_id", "doc_id", "text", "spans").join(told, "row_id", "left").withColumn("terms", F.expr(f"if(told is null, {none}, {lowered})"))
    remove = F.expr("coalesce(transform(filter(terms, w -> array_contains(gone, w.value)), w -> w.start), cast(array() as array<bigint>))")
    out = out.select("doc_id", "text", F.array_sort(F.concat("spans", "terms")).alias("spans"), remove.alias("remove"))
    return out.select("doc_id", "spans", "remove", sanitised(F.col("text"), F.col("spans"), F.col("remove")).alias("clean"))


def sanitised(text: Column, spans: Column, remove: Column) -> Column:
    """The text with base spans and terms replaced by `<kind>`, and terms in `remove` left out. Of spans that overlap,
    the first one counts."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        put = F.when((s["kind"] == "term") & F.array_contains(remove, s["start"]), F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        more = F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), put).alias("out"))
        return F.when(s["start"] >= a["at"], more).otherwise(a)

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the checksum of the base spans, all spans as text, and the text without them."""

    def written(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in (*KINDS, "term")]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "clean")
