"""Queries over graphs (G, F-09, F-10, F-20, W-06, A-23, A-27) and generic star-schema ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import graph as G
from lodestone.operators import memory as O
from lodestone.sources import model as M
from lodestone.sources.model import read, sql

from .base import query
from .memory import EDGES


def star(spark, folder):
    """The containment graph region, nation, customer: (nodes, edges), ids with a letter for the type."""
    t = {n: read(spark, folder, n) for n in ("region", "nation", "customer")}
    r = t["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("title"))
    n = t["nation"].select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("title"))
    c = t["customer"].select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("customer").alias("type"), F.col("c_name").alias("title"))
    e = t["nation"].select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    f = t["customer"].select(F.concat(F.lit("n"), "c_nationkey").alias("source"), F.concat(F.lit("c"), "c_custkey").alias("target"))
    edges = e.unionByName(f).withColumns({"type": F.lit("contains"), "weight": F.lit(1.0)})
    return r.unionByName(n).unionByName(c), edges


STAR = """nodes AS (SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'customer', c_name FROM customer),
    sedges AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""


@query("g01_memory_nodes", sql("SELECT substring(sha256(memory_id::VARCHAR), 1, 16) AS id, memory_id, created_at FROM memories", "memories"))
def memory_nodes(spark, folder):
    return G.memory_nodes(M.memories(spark, folder)).select("id", "memory_id", "created_at")


@query("g04_follows", sql("SELECT a.memory_id AS source, b.memory_id AS target, 'follows' AS type, round(1 - epoch(b.created_at - a.created_at) / 3600 / 24, 8)::DOUBLE AS weight FROM memories a JOIN memories b ON a.session_id = b.session_id AND a.memory_id <> b.memory_id AND b.created_at >= a.created_at AND b.created_at <= a.created_at + INTERVAL 24 HOURS", "memories"))
def follows(spark, folder):
    return G.follows(O.within_hours(M.memories(spark, folder), 24, ["session_id"])).withColumn("weight", F.round("weight", 8))


@query("g05_containment", "SELECT 'o' || o_orderkey AS source, 'l' || l_orderkey || '-' || l_linenumber AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def containment(spark, folder):
    parents = read(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.concat(F.lit("o"), "o_orderkey").alias("id"))
    children = read(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("id"))
    return G.contains(parents, children, "key").select("source", "target")


@query("a27_degrees", f"WITH {STAR} SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, least(1.0, (coalesce(o, 0) + coalesce(i, 0)) / 10.0)::DOUBLE AS coupling FROM nodes LEFT JOIN (SELECT source AS id, count(*) AS o FROM sedges GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM sedges GROUP BY 1) USING (id)")
def degrees(spark, folder):
    return G.degrees(*star(spark, folder))


@query("g11_centrality", f"WITH {STAR}, n AS (SELECT count(*) AS n FROM nodes) SELECT id, (coalesce(o, 0) + coalesce(i, 0))::DOUBLE / (n - 1) AS centrality FROM nodes CROSS JOIN n LEFT JOIN (SELECT source AS id, count(*) AS o FROM sedges GROUP BY 1) USING (id) LEFT JOIN (SELECT target AS id, count(*) AS i FROM sedges GROUP BY 1) USING (id)")
def centrality(spark, folder):
    return G.centrality(*star(spark, folder))


@query("g11_pagerank")
def pagerank(spark, folder):
    """Sums of floating numbers over many rounds: held against a plain power iteration."""
    return G.pagerank(*star(spark, folder))


@query("a23_graph_metrics", f"WITH {STAR} SELECT n AS nodes, e AS edges, 1.0::DOUBLE AS avg_weight, round(2.0 * e / n, 8)::DOUBLE AS avg_degree, round(e::DOUBLE / (n * (n - 1)), 8) AS density FROM (SELECT count(*) AS n FROM nodes), (SELECT count(*) AS e FROM sedges)")
def graph_metrics(spark, folder):
    return G.metrics(*star(spark, folder)).withColumns({"avg_degree": F.round("avg_degree", 8), "density": F.round("density", 8)})


@query("j09_induced_edges", f"WITH {STAR} SELECT source, target FROM sedges WHERE source IN (SELECT id FROM nodes WHERE type <> 'region') AND target IN (SELECT id FROM nodes WHERE type <> 'region')")
def induced_edges(spark, folder):
    nodes, edges = star(spark, folder)
    return G.induced(nodes.where("type <> 'region'"), edges).select("source", "target")


@query("g06_graph_query", f"WITH {STAR}, few AS (SELECT id FROM nodes WHERE type <> 'customer' AND contains(lower(title), 'a') ORDER BY title, id LIMIT 20) SELECT source, target FROM sedges WHERE source IN (SELECT id FROM few) AND target IN (SELECT id FROM few)")
def graph_query(spark, folder):
    nodes, edges = star(spark, folder)
    keep = (F.col("type") != "customer") & F.lower("title").contains("a")
    return G.queried(nodes, edges, keep, [F.col("title"), F.col("id")], 20)[1].select("source", "target")


@query("g08_walk", f"WITH {STAR} SELECT 'r1' AS id, 0 AS depth UNION ALL SELECT target, 1 FROM sedges WHERE source = 'r1' UNION ALL SELECT b.target, 2 FROM sedges a JOIN sedges b ON b.source = a.target WHERE a.source = 'r1'")
def walk(spark, folder):
    nodes, edges = star(spark, folder)
    return G.walk(edges, nodes.where("id = 'r1'"), 2)


@query("g07_sequences", sql(f"RECURSIVE_MARK {EDGES}, p AS (SELECT source AS start, [source, target] AS path, 0.8::DOUBLE AS strength FROM edges UNION ALL SELECT p.start, list_append(p.path, e.target), p.strength * 0.8 FROM p JOIN edges e ON e.source = p.path[-1] WHERE len(p.path) < 6 AND NOT list_contains(p.path, e.target)) SELECT start, array_to_string(path, '>') AS path, (len(path) - 1)::INTEGER AS length, round(strength, 8) AS strength FROM p", "memories").replace("WITH memories", "WITH RECURSIVE memories").replace("RECURSIVE_MARK ", ""))
def sequences(spark, folder):
    m = M.memories(spark, folder)
    edges = O.continuations(m).withColumnRenamed("strength", "weight")
    out = G.sequences(edges, m.select(F.col("memory_id").alias("id")), 5)
    return out.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "length", F.round("strength", 8).alias("strength"))


@query("g10_components", sql(f"{EDGES}, linked AS (SELECT source AS id FROM edges UNION SELECT target FROM edges) SELECT memory_id AS id, min(memory_id) OVER (PARTITION BY session_id) AS component FROM memories WHERE memory_id IN (SELECT id FROM linked)", "memories"))
def components(spark, folder):
    return G.components(O.continuations(M.memories(spark, folder)))


@query("w06_neighbours", f"WITH {STAR} SELECT source, target FROM sedges QUALIFY row_number() OVER (PARTITION BY source ORDER BY target) <= 5")
def neighbours(spark, folder):
    return G.neighbours(star(spark, folder)[1], 5).select("source", "target")


@query("g13_mermaid", f"WITH {STAR} SELECT '    ' || source || ' -->|contains| ' || target AS line FROM sedges ORDER BY source, target LIMIT 100")
def mermaid(spark, folder):
    return G.mermaid_lines(star(spark, folder)[1])


@query("g13_graphml", f"""WITH {STAR} SELECT '<node id="' || id || '"/>' AS line FROM nodes UNION ALL SELECT '<edge source="' || source || '" target="' || target || '" type="contains"/>' FROM sedges""")
def graphml(spark, folder):
    return G.graphml_lines(*star(spark, folder))


@query("w09_dense_index", f"WITH {STAR} SELECT id, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS index FROM nodes")
def dense_index(spark, folder):
    return G.dense_index(star(spark, folder)[0].select("id")).select("id", F.col("index").cast("long").alias("index"))


@query("g12_json", f"WITH {STAR} SELECT what, count(*) AS n FROM (SELECT 'node' AS what FROM nodes UNION ALL SELECT 'edge' FROM sedges) GROUP BY what")
def json_lines(spark, folder):
    return G.json_lines(*star(spark, folder)).where("line like '{%}'").groupBy("what").agg(F.count("*").alias("n"))
