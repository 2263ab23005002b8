"""Further operators on the star tables: declared edges, unions of claims, text functions, logs, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import paths, text
from strandloom.operators import aggs, graph, joins, ranking, setops
from strandloom.plans.graphs import PARTNERS, partners
from strandloom.plans.registry import query, table

MODULES = "(SELECT DISTINCT p_brand || '/' || p_type AS m FROM part UNION SELECT DISTINCT 'lib/' || p_name FROM part)"
DECLARED = """(SELECT DISTINCT p_brand || '/' || p_type AS src, CASE p_size % 4 WHEN 0 THEN 'Brand#' || CAST(p_partkey % 30 AS VARCHAR) || '/' || p_type WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE 'gone' END AS dep FROM part)"""


def _declared(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    modules = part.select(F.concat_ws("/", "p_brand", "p_type").alias("m")).unionByName(part.select(F.concat(F.lit("lib/"), "p_name").alias("m"))).distinct()
    k = F.col("p_size") % 4
    dep = F.when(k == 0, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 30).cast("string"), F.lit("/"), F.col("p_type"))).when(k == 1, F.col("p_name")).when(k == 2, F.col("p_type")).otherwise("gone")
    return joins.declared_edges(part.select(F.concat_ws("/", "p_brand", "p_type").alias("src"), dep.alias("dep")).distinct(), modules, "src", "dep", "m")


BASED = f"""WITH m AS (SELECT m, regexp_replace(m, '^.*/', '') AS base FROM {MODULES} t), d AS (SELECT * FROM {DECLARED} t),
    f AS (SELECT src, dep AS "to" FROM d WHERE dep IN (SELECT m FROM m)), r AS (SELECT * FROM d WHERE dep NOT IN (SELECT m FROM m)),
    b AS (SELECT src, dep, count(*) AS n, min(m.m) AS one, string_agg(m.m, ',' ORDER BY m.m) AS candidates FROM r JOIN m ON r.dep = m.base GROUP BY src, dep)"""


@query(BASED + """ SELECT DISTINCT src, "to" FROM (SELECT * FROM f UNION ALL SELECT src, one FROM b WHERE n = 1) WHERE src <> "to" """)
def o61_declared_edges(spark, sf_dir):
    return _declared(spark, sf_dir)[0]


@query(BASED + " SELECT src, dep, candidates FROM b WHERE n > 1")
def o62_declared_ambiguous(spark, sf_dir):
    return _declared(spark, sf_dir)[1].select("src", "dep", F.array_join("candidates", ",").alias("candidates"))


@query(
    """
    WITH c AS (SELECT l_partkey AS subject, l_returnflag AS kind, l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity AS INTEGER) AS q, CASE WHEN l_discount >= 0.09 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem)
    SELECT subject, kind, count(DISTINCT q) AS n_statements, count(DISTINCT (l_orderkey, l_linenumber)) AS n_evidence,
    CASE max(CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
    string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS nodes FROM c GROUP BY subject, kind"""
)
def o63_union_claims(spark, sf_dir):
    d = F.col("l_discount")
    claims = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.lit("a").alias("anchor"),
        F.col("l_suppkey").cast("string").alias("node"), F.col("l_quantity").cast("int").cast("string").alias("statement"), F.when(d >= 0.09, "high").when(d >= 0.04, "medium").otherwise("low").alias("confidence"),
    )
    merged = aggs.union_claims(claims, ["subject", "kind"], ["file", "line"], "statement", "file", "anchor", "line", "confidence", "node")
    return merged.select("subject", "kind", F.size("statements").cast("long").alias("n_statements"), F.size("evidence").cast("long").alias("n_evidence"), "confidence", F.array_join("source_nodes", ",").alias("nodes"))


@query(
    r"""
    SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 'node.' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS id,
    p_type || '#' || p_name AS short, CASE WHEN length(p_name) <= 8 THEN p_name ELSE rtrim(substr(p_name, 1, 7)) || '…' END AS cut, CAST(length(p_name) // 4 AS BIGINT) AS tokens,
    CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS shape, 'a.b.c' AS root FROM part"""
)
def o64_text_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), text.claim_id(F.lit("node"), F.col("p_type")).alias("id"),
        F.concat(text.short_name(F.concat(F.lit("x/y."), F.col("p_type"))), F.lit("#"), F.col("p_name")).alias("short"),
        text.truncate(F.col("p_name"), 8).alias("cut"), text.token_estimate(F.col("p_name")).alias("tokens"), text.power_of_two(F.col("p_size")).alias("shape"), text.library_root(F.lit("a.b.c.d")).alias("root"),
    )


@query(
    """SELECT l_partkey AS fqn, count(*) AS n, min(struct_pack(a := l_orderkey, b := l_linenumber)).a AS file, min(struct_pack(a := l_orderkey, b := l_linenumber)).b AS line FROM lineitem WHERE l_returnflag = 'R'
    GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 200"""
)
def o65_top_unresolved(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_partkey", "fqn")
    return aggs.top_unresolved(rows, "fqn", "l_orderkey", "l_linenumber").select("fqn", "n", F.col("first.l_orderkey").alias("file"), F.col("first.l_linenumber").alias("line"))


@query(f"WITH e AS (SELECT * FROM {PARTNERS} t), w AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1) SELECT src, dst FROM e WHERE src IN (SELECT n FROM w) OR dst IN (SELECT n FROM w)")
def o66_graph_focus(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey")
    return graph.focus(nation, partners(spark, sf_dir), nation.where("n_regionkey = 1").select("node"))[1]


@query(f"WITH e AS (SELECT * FROM {PARTNERS} t), k AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey NOT IN (0, 4)) SELECT src, dst FROM e WHERE src IN (SELECT n FROM k) AND dst IN (SELECT n FROM k)")
def o67_hide_roles(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").cast("string").alias("role"))
    return graph.hide_roles(nation, partners(spark, sf_dir), ["0", "4"])[1]


@query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1 EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0")
def o68_append_new(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return setops.append_new(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), keys).select(*keys)


@query(
    """
    WITH fresh AS (SELECT * FROM orders WHERE o_totalprice > 480000) SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM fresh)
    UNION ALL SELECT o_orderkey, o_custkey FROM fresh"""
)
def o69_replace_groups(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return setops.replace_groups(orders, orders.where("o_totalprice > 480000"), "o_custkey").select("o_orderkey", "o_custkey")


@query(
    """
    WITH r AS (SELECT DISTINCT source || '/' || lang AS root FROM documents WHERE doc_id % 7 = 0 UNION SELECT DISTINCT source FROM documents),
    f AS (SELECT doc_id, source || '/' || lang || '/d' || CAST(doc_id AS VARCHAR) AS path FROM documents)
    SELECT doc_id, arg_max(root, length(root)) AS module FROM f JOIN r ON starts_with(path, root || '/') GROUP BY doc_id"""
)
def o70_deepest_root(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/d"), F.col("doc_id").cast("string")).alias("path"))
    roots = docs.where("doc_id % 7 = 0").select(F.concat_ws("/", "source", "lang").alias("prefix")).unionByName(docs.select(F.col("source").alias("prefix"))).distinct()
    return joins.prefix_owner(files, roots.withColumn("module", F.col("prefix")), "path", "prefix", "module", boundary="/").select("doc_id", "module")


@query(
    """
    WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    SELECT o_orderkey, o_custkey FROM r WHERE rn <= 2"""
)
def o71_top_k(spark, sf_dir):
    return ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_orderkey", "o_custkey")


@query(
    """
    WITH l AS (SELECT max(o_orderkey) AS k FROM orders), f AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer WHERE c_acctbal < 0)
    SELECT c_custkey, rn + k AS seq FROM f, l"""
)
def o72_next_in_sequence(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    fresh = table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")
    return ranking.next_in_sequence(log, fresh, "seq", ["c_custkey"])


@query(
    """
    WITH a AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer)
    SELECT b.k, b.v FROM b LEFT JOIN a USING (k) WHERE a.k IS NULL OR a.v IS DISTINCT FROM b.v"""
)
def o73_changed_scopes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    new = customer.withColumn("v", F.when(F.col("k") % 5 == 0, F.lit(None)).when(F.col("k") % 7 == 0, "OTHER").otherwise(F.col("v")))
    return setops.changed(customer.where("k % 3 > 0"), new, "k", "v")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'bl') OR contains(lower(p_brand), '#1')")
def o74_contains(spark, sf_dir):
    return table(spark, sf_dir, "part").where(text.contains_ci(F.col("p_name"), "BL") | text.contains_ci(F.col("p_brand"), "#1")).select("p_partkey")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def x03_tumbling_window(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


@query("SELECT count(*) FILTER (WHERE third) AS third_party, count(*) FILTER (WHERE NOT third) AS own FROM (SELECT starts_with(n, 'java.') OR starts_with(n, 'org.apache.') OR NOT contains(n, '.') AS third FROM (SELECT CASE l_linenumber WHEN 1 THEN 'java.util.X' WHEN 2 THEN 'org.apache.Y' WHEN 3 THEN 'plain' ELSE 'com.acme.Z' END AS n FROM lineitem))")
def o75_third_party(spark, sf_dir):
    n = F.col("l_linenumber")
    name = F.when(n == 1, "java.util.X").when(n == 2, "org.apache.Y").when(n == 3, "plain").otherwise("com.acme.Z")
    third = paths.looks_third_party(F.col("n"))
    return table(spark, sf_dir, "lineitem").select(name.alias("n")).agg(F.count(F.when(third, 1)).alias("third_party"), F.count(F.when(~third, 1)).alias("own"))
