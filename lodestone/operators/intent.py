"""What a query wants, and which memories bear on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X

from .memory import stated
from .neighbours import compared

#: Patterns of ten intents, matched against lower case.
PATTERNS = {
    "question": (r"\b(what|how|why|when|where|who|which)\b", r"\?", r"\b(explain|describe|tell me|clarify)\b", r"\b(is|are|can|could|would|should|do|does|did)\b.*\?"),
    "command": (r"\b(create|make|build|generate|write|implement)\b", r"\b(fix|solve|resolve|correct|repair)\b", r"\b(add|remove|delete|update|modify|change)\b", r"\b(run|execute|start|stop|deploy)\b", r"\b(please|can you|could you)\b.*\b(do|make|create|fix)\b"),
    "explanation": (r"\b(explain|elaborate|detail|clarify|walk through)\b", r"\b(understand|comprehend|grasp|learn about)\b", r"\b(how does|how do|why does|why do)\b", r"\b(breakdown|break down|step by step)\b"),
    "search": (r"\b(find|search|look for|locate|discover)\b", r"\b(where is|where can|show me)\b", r"\b(list|enumerate|show all)\b", r"\b(examples|samples|instances)\b"),
    "debug": (r"\b(debug|troubleshoot|diagnose|investigate)\b", r"\b(error|bug|issue|problem|failure)\b", r"\b(not working|broken|failing|crashed)\b", r"\b(why isn't|why doesn't|what's wrong)\b"),
    "optimize": (r"\b(optimize|improve|enhance|refactor)\b", r"\b(faster|better|efficient|performance)\b", r"\b(reduce|minimize|streamline)\b", r"\b(best practice|recommendation)\b"),
    "review": (r"\b(review|check|validate|verify|assess)\b", r"\b(feedback|opinion|thoughts|suggestions)\b", r"\b(correct|right|good|bad|better)\b", r"\b(code review|design review)\b"),
    "learn": (r"\b(learn|study|understand|tutorial)\b", r"\b(teach me|show me how|guide me)\b", r"\b(concept|principle|theory|approach)\b", r"\b(beginner|introduction|basics)\b"),
    "plan": (r"\b(plan|strategy|approach|roadmap)\b", r"\b(design|architecture|structure)\b", r"\b(organize|structure|layout)\b", r"\b(next steps|workflow|process)\b"),
    "reflect": (r"\b(reflect|retrospective|analysis|review)\b", r"\b(lessons learned|what went|outcome)\b", r"\b(evaluate|assess|consider)\b", r"\b(thoughts|insights|observations)\b"),
}
UNSAFE = {"command": ("delete", "remove", "destroy", "kill"), "debug": ("hack", "crack", "exploit", "attack")}
#: Intents that go together, and intents that follow each other.
GROUPS = (("question", "explanation", "learn"), ("debug", "optimize", "review"), ("create", "plan", "command"), ("search", "review", "reflect"))
SEQUENCES = (("question", "explanation", "create"), ("debug", "search", "optimize"), ("learn", "question", "review"), ("plan", "create", "review"))
BONUSES = (("question", "semantic", 0.2), ("question", "contextual", 0.1), ("debug", "solution", 0.3), ("debug", "pattern", 0.2), ("learn", "sequential", 0.2), ("learn", "topic", 0.1))


def pattern_scores(text: Column) -> Column:
    """array<struct<score, intent>> of the intents any of whose patterns match: 1.5 times the share that do, up to 1."""
    low = F.lower(text)
    each = []
    for name, patterns in PATTERNS.items():
        n = sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))
        each.append(F.when(n > 0, F.struct(F.least(F.lit(1.0), n / len(patterns) * 1.5).alias("score"), F.lit(name).alias("intent"))))
    return F.array_compact(F.array(*each))


def example_scores(queries: DataFrame, key: str, vector: str, examples: DataFrame) -> DataFrame:
    """(key, intent, score): the best cosine with an intent's examples, over 0.5. examples: intent, vector; a small
    table."""
    each = queries.select(key, F.col(vector).alias("__q")).crossJoin(stated(examples.select("intent", F.col("vector").alias("__e"))))
    return each.groupBy(key, "intent").agg(F.max(W.cosine(F.col("__q"), F.col("__e"))).alias("score")).where("score > 0.5")


def best_intent(queries: DataFrame, key: str, text: str, share: float = 0.6, examples: Column | None = None) -> DataFrame:
    """queries with intent, confidence and alternatives (up to three): `share` of the pattern score and the rest of the
    example score (array<struct<score, intent>>), ties by name; unknown with confidence 0 if nothing scores."""
    found = F.transform(pattern_scores(F.col(text)), lambda s: F.struct((s["score"] * share).alias("score"), s["intent"].alias("intent")))
    if examples is not None:
        found = F.concat(found, F.transform(examples, lambda s: F.struct((s["score"] * (1 - share)).alias("score"), s["intent"].alias("intent"))))
    names = F.array_distinct(found["intent"])
    total = F.transform(names, lambda n: F.struct((-F.aggregate(F.filter(found, lambda s: s["intent"] == n), F.lit(0.0), lambda a, s: a + s["score"])).alias("minus"), n.alias("intent")))
    out = queries.withColumn("__s", F.array_sort(total))
    first = F.try_element_at("__s", F.lit(1))
    out = out.withColumn("intent", F.coalesce(first["intent"], F.lit("unknown"))).withColumn("confidence", F.round(F.coalesce(-first["minus"], F.lit(0.0)), 6))
    return out.withColumn("alternatives", F.slice(F.col("__s.intent"), 2, 3)).drop("__s")


def safety(intent: Column, text: Column) -> Column:
    """0.9 less 0.1 for each word that is unsafe with the intent."""
    bad = F.lit(0)
    for name, words in UNSAFE.items():
        bad = F.when(intent == name, sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0))).otherwise(bad)
    return F.greatest(F.lit(0.0), 0.9 - 0.1 * bad)


def related(left: Column, right: Column) -> Column:
    """Whether two intents go together."""
    out = F.lit(False)
    for group in GROUPS:
        out = out | (left.isin(*group) & right.isin(*group))
    return out


def in_sequence(left: Column, right: Column) -> Column:
    """Whether two intents stand next to each other, or are the same, in a common sequence."""
    out = F.lit(False)
    for s in SEQUENCES:
        at = [F.when(c == s[0], 0).when(c == s[1], 1).when(c == s[2], 2) for c in (left, right)]
        out = out | F.coalesce(F.abs(at[0] - at[1]) <= 1, F.lit(False))
    return out


def semantic_connections(queries: DataFrame, memories: DataFrame, least: float = 0.7) -> DataFrame:
    """(query_id, memory_id, kind, strength) by 0.3 of the prompt's and 0.7 of the response's cosine, of each query with
    all memories.

    queries: query_id, vector: a stated set; memories: memory_id, prompt_vector, response_vector."""
    asked = queries.select(F.col("query_id").alias("source_id"), "vector")
    found = compared(memories.withColumnRenamed("memory_id", "vec_id"), asked, {"prompt_vector": 0.3, "response_vector": 0.7}, least)
    return found.select(F.col("source_id").alias("query_id"), F.col("vec_id").alias("memory_id"), F.lit("semantic").alias("kind"), F.col("score").alias("strength"))


def temporal_connections(queries: DataFrame, memories: DataFrame, hours: int = 24, least: float = 0.3) -> DataFrame:
    """(query_id, memory_id, kind, strength) of the same session within some hours, weaker with time, a fifth more for
    related intents."""
    m = memories.select("session_id", F.col("memory_id"), F.col("created_at").alias("__t"), F.col("intent").alias("__i"))
    both = queries.join(m, "session_id").where("query_id <> memory_id")
    gap = F.abs(W.hours_between(F.col("__t"), F.col("created_at")))
    base = F.when(gap <= hours, W.linear_time_weight(gap, hours))
    strength = F.least(F.lit(1.0), F.when(related(F.col("intent"), F.col("__i")), base * 1.2).otherwise(base))
    return both.select("query_id", "memory_id", F.lit("temporal").alias("kind"), strength.alias("strength")).where(F.col("strength") >= least)


def pattern_connections(queries: DataFrame, memories: DataFrame, least: float = 0.6) -> DataFrame:
    """(query_id, memory_id, kind, strength) of the same domain: 0.4, 0.6 for intents in sequence, 0.2 for the same
    complexity, up to 1. Both have domain, complexity and intent; the join is on session and domain."""
    m = memories.select("session_id", "domain", F.col("memory_id"), F.col("complexity").alias("__c"), F.col("intent").alias("__i"))
    both = queries.join(m, ["session_id", "domain"]).where("query_id <> memory_id")
    strength = 0.4 + F.when(in_sequence(F.col("intent"), F.col("__i")), 0.6).otherwise(0.0) + F.when(F.col("complexity") == F.col("__c"), 0.2).otherwise(0.0)
    return both.select("query_id", "memory_id", F.lit("pattern").alias("kind"), F.least(F.lit(1.0), strength).alias("strength")).where(F.col("strength") >= least)


def ranked(connections: DataFrame, intents: DataFrame, most: int = 10) -> DataFrame:
    """The `most` strongest connections of each query, with a bonus for kinds that suit its intent. intents: query_id,
    intent."""
    bonus = F.lit(0.0)
    for intent, kind, more in BONUSES:
        bonus = F.when((F.col("intent") == intent) & (F.col("kind") == kind), more).otherwise(bonus)
    told = connections.join(intents, "query_id").withColumn("score", F.col("strength") + bonus)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id", "kind"))
    return told.withColumn("rank", place).where(F.col("rank") <= most)


def overall_confidence(connections: DataFrame) -> DataFrame:
    """Per query, strengths weighted by one over the rank."""
    return connections.groupBy("query_id").agg((F.sum(F.col("strength") / F.col("rank")) / F.sum(1 / F.col("rank"))).alias("confidence"))


def safe(connections: DataFrame, concrete: DataFrame, least: float = 0.3) -> DataFrame:
    """Connections strong enough, to memories without a concrete reference. concrete: memory_id, has_concrete."""
    clean = concrete.where(~F.col("has_concrete")).select("memory_id")
    return connections.where(F.col("strength") >= least).join(clean, "memory_id", "left_semi")


def group_dimension(spark: SparkSession) -> DataFrame:
    """(grp, intent): which intents go together, as a table of a few rows."""
    return spark.createDataFrame([(i, x) for i, g in enumerate(GROUPS) for x in g], "grp int, intent string")


def boost(asked: Column, intent: Column) -> Column:
    """What a memory's intent adds to its score: 0.3 if it is the query's, 0.1 if it goes with it."""
    return F.when(asked == intent, 0.3).when(related(asked, intent), 0.1).otherwise(0.0)


def explained(connections: DataFrame) -> DataFrame:
    """A sentence for each connection."""
    how = F.when(F.col("strength") >= 0.9, "very strongly").when(F.col("strength") >= 0.7, "strongly").otherwise("somewhat")
    what = F.when(F.col("kind") == "semantic", "shares its meaning").when(F.col("kind") == "temporal", "came about the same time").otherwise("follows a similar pattern")
    return connections.withColumn("explanation", F.concat(F.lit("This memory is "), how, F.lit(" connected: it "), what))


def non_directive(connections: DataFrame) -> DataFrame:
    """Leaves out explanations that tell the reader what to do."""
    return connections.where(~F.lower("explanation").rlike(r"\b(should|must|need to|have to|ought to)\b"))


def oracle(column: str) -> str:
    """DuckDB tables scored_intents and best (memory_id, intent, confidence) over memories."""
    parts = []
    for name, patterns in PATTERNS.items():
        n = " + ".join(f"regexp_matches(lower({column}), '{p.replace(chr(39), chr(39) * 2)}')::INT" for p in patterns)
        parts.append(f"SELECT memory_id, '{name}' AS intent, least(1.0, ({n})::DOUBLE / {len(patterns)} * 1.5) * 0.6 AS score FROM memories WHERE ({n}) > 0")
    return f"""scored_intents AS ({' UNION ALL '.join(parts)}),
    first_intents AS (SELECT memory_id, intent, score FROM scored_intents QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, intent) = 1),
    best AS (SELECT m.memory_id, coalesce(f.intent, 'unknown') AS intent, round(coalesce(f.score, 0.0), 6)::DOUBLE AS confidence FROM memories m LEFT JOIN first_intents f USING (memory_id))"""
