"""Graph operators on relations between nations, and path roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import paths
from strandloom.operators import aggs, graph
from strandloom.plans.lookups import EDGES, nation_edges
from strandloom.plans.registry import query, table

#: A sparse graph: each nation and its two largest partners.
PARTNERS = f"""(SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, dst) AS rn FROM {EDGES} t WHERE src <> dst GROUP BY src, dst) WHERE rn <= 2)"""


def partners(spark, sf_dir):
    pairs = nation_edges(spark, sf_dir).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return pairs.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))).where("rn <= 2").select("src", "dst")


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS} t), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r")
def o14_closure(spark, sf_dir):
    return graph.closure(partners(spark, sf_dir))


@query(
    f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS} t), r AS (SELECT 0 AS node, 0 AS depth UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON r.node = e.src WHERE depth < 8),
    d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
    SELECT d.node, d.depth, (SELECT min(e.src) FROM e JOIN d p ON p.node = e.src WHERE e.dst = d.node AND p.depth = d.depth - 1 AND d.depth > 0) AS parent FROM d"""
)
def o15_bfs_first_reach(spark, sf_dir):
    return graph.bfs(partners(spark, sf_dir), 0)[0]


@query(
    f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS} t), r AS (SELECT [n_nationkey] AS path FROM nation WHERE n_regionkey = 0 UNION ALL SELECT list_append(path, e.dst) FROM r JOIN e ON path[-1] = e.src WHERE NOT list_contains(path, e.dst) AND len(path) <= 5)
    SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INTEGER) AS hops FROM r WHERE len(path) > 1 AND path[-1] IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"""
)
def o16_paths(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    sources, sinks = (nation.where(F.col("n_regionkey") == k).select("n_nationkey") for k in (0, 2))
    found, _ = graph.enumerate_paths(partners(spark, sf_dir), sources, sinks, most_hops=5, most_paths=None)
    return found.select(F.array_join("path", ">").alias("path"), "hops")


@query(
    f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {EDGES} t WHERE src > dst), r AS (SELECT n_nationkey AS node, 0 AS level FROM nation UNION SELECT e.src, r.level + 1 FROM r JOIN e ON r.node = e.dst)
    SELECT node, max(level) AS level FROM r GROUP BY node"""
)
def o17_layers(spark, sf_dir):
    edges = nation_edges(spark, sf_dir).where("src > dst").select("src", "dst").distinct()
    return graph.layers(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node")), edges)


@query(
    f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS} t), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT a.src AS node, least(min(a.dst), a.src) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"""
)
def o18_scc(spark, sf_dir):
    return graph.scc(partners(spark, sf_dir))


@query(
    """
    WITH d AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 0), o AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 2 = 1)
    SELECT src, dst, 'declared_only' AS side FROM (SELECT * FROM d EXCEPT SELECT * FROM o) UNION ALL SELECT src, dst, 'observed_only' FROM (SELECT * FROM o EXCEPT SELECT * FROM d)"""
)
def o19_divergence(spark, sf_dir):
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return graph.divergence(met.where("o_orderkey % 2 = 0"), met.where("o_orderkey % 2 = 1"), ["src", "dst"])


@query(
    r"""
    WITH f AS (SELECT doc_id, source || '/' || lang || '/d' || CAST(doc_id AS VARCHAR) AS path, lang, n_chars FROM documents)
    SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS grp, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS chars, CASE WHEN count(DISTINCT lang) = 1 THEN max(lang) END AS lang FROM f GROUP BY 1"""
)
def o41_rollup_depth(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("path"), "lang", "n_chars")
    return files.groupBy(paths.rollup(F.col("path"), 2).alias("grp")).agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("chars"), aggs.agreed(F.col("lang")).alias("lang"))


@query(f"SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM {EDGES} t UNION ALL SELECT dst FROM {EDGES} t) GROUP BY node")
def o42_degree(spark, sf_dir):
    return aggs.degree(nation_edges(spark, sf_dir), "src", "dst")


@query(
    f"""SELECT CASE WHEN channel = 'N' THEN dst ELSE src END AS src, CASE WHEN channel = 'N' THEN src ELSE dst END AS dst, channel AS kind, count(*) AS n FROM {EDGES} t GROUP BY ALL"""
)
def o54_flow_view(spark, sf_dir):
    return graph.flow_view(nation_edges(spark, sf_dir), ["N"], "src", "dst", "channel")


@query(
    f"""WITH g AS (SELECT n_nationkey AS node, n_regionkey AS grp FROM nation) SELECT a.grp AS src_group, b.grp AS dst_group, channel AS kind, count(*) AS n
    FROM {EDGES} t JOIN g a ON src = a.node JOIN g b ON dst = b.node WHERE a.grp <> b.grp GROUP BY ALL"""
)
def o60_rollup_edges(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))
    return graph.rollup_edges(nation_edges(spark, sf_dir), groups, "channel").withColumnRenamed("channel", "kind")
