"""Knowledge graphs as tables of nodes (id, type, title, created_at, safety) and edges (source, target, type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import numbers as W
from lodestone.functions import text as X
from lodestone.sources.scratch import dropped, kept, shared_dir

from . import code as N


def memory_nodes(memories: DataFrame) -> DataFrame:
    """Memories as nodes: an id of 16 hex digits, a title and the first 100 characters."""
    return memories.select(
        F.substring(F.sha2(F.col("memory_id").cast("string"), 256), 1, 16).alias("id"),
        "memory_id",
        F.lit("memory").alias("type"),
        X.title(F.col("prompt")).alias("title"),
        X.truncated(F.concat_ws(" ", "prompt", "response"), 100).alias("description"),
        "created_at",
    )


def code_nodes(files: DataFrame) -> DataFrame:
    """(id, type, title): a module a file, and its functions and classes. files: file, text."""
    modules = files.select(F.concat(F.lit("file_"), "file").alias("id"), F.lit("module").alias("type"), F.col("file").cast("string").alias("title"))
    own = N.definitions(files).select(F.concat_ws(":", F.col("file").cast("string"), "name").alias("id"), F.col("kind").alias("type"), F.col("name").alias("title"))
    return modules.unionByName(own)


def semantic_edges(pairs: DataFrame) -> DataFrame:
    """Edges of pairs (source, target, similarity, hours): type by similarity, weight by it and by time."""
    kind = F.when(F.col("similarity") >= 0.9, "similar_to").when(F.col("similarity") >= 0.8, "related_to").otherwise("references")
    return pairs.select("source", "target", kind.alias("type"), (F.col("similarity") * W.time_weight(F.col("hours"))).alias("weight"))


def follows(pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """FOLLOWS edges of pairs (a, b, hours), weaker with time, at least so strong."""
    weight = W.linear_time_weight(F.col("hours"))
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("follows").alias("type"), weight.alias("weight")).where(F.col("weight") >= least)


def contains(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Edges from each parent to the children of its key. Both: key, id."""
    both = parents.select(key, F.col("id").alias("source")).join(children.select(key, F.col("id").alias("target")), key)
    return both.select("source", "target", F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    ids = nodes.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return kept.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def queried(nodes: DataFrame, edges: DataFrame, keep: Column, order: list[Column], most: int, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Nodes that `keep` holds for, the first `most` in an order, and the edges among them of at least a weight."""
    found = nodes.where(keep).orderBy(*order).limit(most)
    return found, induced(found, edges.where(F.col("weight") >= least))


def edges_of(edges: DataFrame, kinds: list[str], least: float = 0.0, sure: float = 0.0) -> DataFrame:
    """Edges of some types, of a least weight and confidence."""
    return edges.where(F.col("type").isin(*kinds) & (F.col("weight") >= least) & (F.col("confidence") >= sure))


def banded(degrees: DataFrame) -> DataFrame:
    """degrees() with the band of coupling (over 0.7 high, over 0.3 medium), and whether a node has no edge."""
    band = F.when(F.col("coupling") > 0.7, "high").when(F.col("coupling") > 0.3, "medium").otherwise("low")
    return degrees.withColumns({"band": band, "isolated": F.col("in_degree") + F.col("out_degree") == 0})


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, coupling) of all nodes."""
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    both = nodes.select("id").join(out, "id", "left").join(into, "id", "left").fillna(0, ["out_degree", "in_degree"])
    return both.withColumn("coupling", F.least((F.col("in_degree") + F.col("out_degree")) / 10, F.lit(1.0)))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean degree, density."""
    n, e = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges"), F.avg("weight").alias("avg_weight"))
    both = n.crossJoin(F.broadcast(e))  # one row each
    return both.withColumn("avg_degree", F.when(F.col("nodes") > 0, 2 * F.col("edges") / F.col("nodes")).otherwise(0.0)).withColumn("density", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0))


def walk(edges: DataFrame, starts: DataFrame, depth: int, keep=lambda df: df) -> DataFrame:
    """(id, depth) of what is reached from the starts (id) along edges: breadth first, a step a join, each node once.
    `keep` thins the frontier. Ends early when a step finds nothing new."""
    seen = keep(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    front, steps = edges.select("source", "target").distinct(), seen
    for step in range(1, depth + 1):
        new = steps.join(front, steps["id"] == front["source"]).select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        steps = keep(new.withColumn("depth", F.lit(step)))
        seen = seen.unionByName(steps)
    return seen


def sequences(edges: DataFrame, starts: DataFrame, depth: int = 5) -> DataFrame:
    """Paths without a node twice: (start, path, length, strength), strength the product of the edges'."""
    paths = starts.select(F.col("id").alias("start"), F.array("id").alias("path"), F.lit(1.0).alias("strength"))
    out = None
    for _ in range(depth):
        at = paths.withColumn("source", F.element_at("path", -1)).join(edges.select("source", "target", "weight"), "source").where(~F.array_contains("path", F.col("target")))
        paths = at.select("start", F.concat("path", F.array("target")).alias("path"), (F.col("strength") * F.col("weight")).alias("strength"))
        out = paths if out is None else out.unionByName(paths)
    return out.withColumn("length", F.size("path") - 1)


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the session names; one of its own only where none is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that a node reaches. Least labels spread over edges, and each round follows the
    label's own label, so long chains halve; a checkpoint a round cuts lineage. Rounds end when one changes nothing."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    label = both.groupBy(F.col("source").alias("id")).agg(F.least(F.col("source"), F.min("target")).alias("component"))
    while True:
        near = both.join(label, both["target"] == label["id"]).groupBy("source").agg(F.min("component").alias("near"))
        low = label.join(near, label["id"] == near["source"], "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        hop = low.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = checkpointed(low.join(hop, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        moved = new.join(label.select("id", F.col("component").alias("old")), "id").where("component <> old")
        if moved.isEmpty():
            return new
        label = new


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, centrality): degree over the number of other nodes."""
    n = nodes.agg(F.count("*").alias("n"))
    return degrees(nodes, edges).crossJoin(F.broadcast(n)).select("id", F.when(F.col("n") > 1, (F.col("in_degree") + F.col("out_degree")) / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """(id, rank): the share of time that a walk spends on a node, which follows a link with probability `damping` (each
    of a node's links alike; from a node without links, to any node) and else goes to any node. Ranks add up to 1.

    Power iteration: a round joins ranks to edges by their source and sums them up by target, each task its own rows
    first, so a node that many link to is no burden; the mass of nodes without links is one number. It ends when the
    ranks change by less than `tolerance` in all, or after `most` rounds. Edges to or from unknown ids don't count; an
    edge that is there twice counts twice. nodes: id; edges: source, target."""
    ids = kept(nodes.select("id").where("id is not null").distinct())
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    own = induced(ids, edges).select("source", "target")
    out = own.groupBy("source").agg(F.count("*").alias("out"))
    links = kept(own.join(out, "source").select("source", "target", (1 / F.col("out")).alias("share")))
    starts = out.select(F.col("source").alias("id"), F.lit(True).alias("linked"))
    ranks = kept(ids.join(starts, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"), F.lit(1.0 / n).alias("rank"), F.lit(1.0).alias("moved")))
    for _ in range(most):
        state = ranks.agg(F.sum(F.when(~F.col("linked"), F.col("rank")).otherwise(0.0)).alias("lost"), F.sum("moved").alias("moved")).first()
        if state["moved"] < tolerance:
            break
        given = links.join(ranks.select(F.col("id").alias("source"), "rank"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("given"))
        new = (1 - damping) / n + damping * (F.coalesce("given", F.lit(0.0)) + state["lost"] / n)
        old = ranks
        ranks = kept(old.join(given, "id", "left").select("id", "linked", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")))
        dropped(old)
    return ranks.select("id", "rank")


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges out of each node."""
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "target")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def json_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per node and edge, with what it is."""
    a = nodes.select(F.lit("node").alias("what"), F.to_json(F.struct(*nodes.columns)).alias("line"))
    return a.unionByName(edges.select(F.lit("edge").alias("what"), F.to_json(F.struct(*edges.columns)).alias("line")))


def mermaid_lines(edges: DataFrame, most: int = 100) -> DataFrame:
    """Lines of a Mermaid graph of the `most` heaviest edges."""
    few = edges.orderBy(F.desc("weight"), "source", "target").limit(most)
    return few.select(F.format_string("    %s -->|%s| %s", F.col("source").cast("string"), "type", F.col("target").cast("string")).alias("line"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML elements of nodes and edges."""
    a = nodes.select(F.format_string('<node id="%s"/>', F.col("id").cast("string")).alias("line"))
    return a.unionByName(edges.select(F.format_string('<edge source="%s" target="%s" type="%s"/>', F.col("source").cast("string"), F.col("target").cast("string"), "type").alias("line")))


def dense_index(nodes: DataFrame) -> DataFrame:
    """Adds an index from 0 in the order of id: counts of ranges, then ranks within a range, so no task has all."""
    ranged = nodes.repartitionByRange("id").withColumn("__p", F.spark_partition_id())
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    ahead = sizes.select("__p", before.alias("ahead"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("id")) - 1
    return ranged.join(F.broadcast(ahead), "__p").withColumn("index", F.col("ahead") + own).drop("__p", "ahead")
