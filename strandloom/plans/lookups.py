"""Lookups, ownership, symbols, prefixes, links: operators on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import hashing, paths, text
from strandloom.operators import aggs, joins, ranking
from strandloom.plans.registry import query, table


def col_string(name):
    return F.col(name).cast("string")


@query(
    """
    SELECT CAST(l_partkey AS BIGINT) AS item,
           string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'A') AS owned_by,
           string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'R') AS written_by,
           string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FILTER (WHERE l_returnflag = 'N') AS read_by,
           count(*) FILTER (WHERE l_returnflag = 'A') AS n_migrations
    FROM lineitem GROUP BY l_partkey"""
)
def o01_ownership(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), col_string("l_suppkey").alias("actor"), F.col("l_returnflag").alias("channel"))
    return aggs.ownership(edges, "item", "actor", "channel", {"owned_by": "A", "written_by": "R", "read_by": "N"}, count_of=("n_migrations", "A"))


@query("SELECT p_type AS key, count(*) AS n FROM part GROUP BY p_type")
def o02_tally(spark, sf_dir):
    return aggs.tally(table(spark, sf_dir, "part").select(F.col("p_type").alias("key")), "key")


FOLDERS = ["src/test/java", "docs", ".github/workflows", "src/main/java", "tests", "assets", "ci", "lib", "spec"]
ENDINGS = [".java", ".md", ".png", ".py", ".sql", ".go", ".ts"]
STEMS = ["", "Test", "_test", ".spec"]


def _part_paths(spark, sf_dir):
    def pick(values, n):
        return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))

    key = F.col("p_partkey")
    name = F.concat(F.regexp_replace(F.lower("p_brand"), "#", ""), F.lit("/"), pick(FOLDERS, key), F.lit("/F"), key.cast("string"), pick(STEMS, F.floor(key / 9)), pick(ENDINGS, F.col("p_size")))
    return table(spark, sf_dir, "part").select("*", name.alias("path"))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PART_PATHS = f"""(SELECT *, replace(lower(p_brand), '#', '') || '/' || ({_sql_list(FOLDERS)})[p_partkey % 9 + 1] || '/F' || CAST(p_partkey AS VARCHAR)
    || ({_sql_list(STEMS)})[(p_partkey // 9) % 4 + 1] || ({_sql_list(ENDINGS)})[p_size % 7 + 1] AS path FROM part)"""
SQL_TEST = " OR ".join(f"regexp_matches(path, '{p}')" for p in paths.TEST_PATTERNS)
SQL_ROLE = f"""CASE WHEN {SQL_TEST} THEN 'test' WHEN regexp_matches(path, '{paths.CI_PATTERN}') THEN 'ci' WHEN path LIKE '%.sql' THEN 'schema'
    WHEN regexp_matches(path, '{paths.ASSET_PATTERN}') THEN 'asset' WHEN regexp_matches(path, '{paths.DOC_PATTERN}') THEN 'docs' ELSE 'source' END"""


@query(f"SELECT path, {SQL_ROLE} AS role FROM {PART_PATHS} t")
def o03_role_cascade(spark, sf_dir):
    return _part_paths(spark, sf_dir).select("path", paths.role(F.col("path")).alias("role"))


@query(
    f"""WITH r AS (SELECT p_partkey, {SQL_ROLE} AS role FROM {PART_PATHS} t)
    SELECT l_orderkey AS claim, count(*) AS n_evidence FROM lineitem LEFT JOIN r ON l_partkey = p_partkey
    GROUP BY l_orderkey HAVING bool_or(role IS NULL OR role NOT IN ('test', 'docs', 'source'))"""
)
def o04_exclude_evidence_any(spark, sf_dir):
    roles = _part_paths(spark, sf_dir).select(F.col("p_partkey").alias("file"), paths.role(F.col("path")).alias("role"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim"), F.col("l_partkey").alias("file"))
    return joins.exclude_evidence_any(evidence, roles, "claim", "file", ["test", "docs", "source"])


@query(
    """SELECT p_brand || '.' || p_type AS fqn, arg_min(p_name, p_partkey) AS kind, arg_max(p_retailprice, p_partkey) AS value,
       string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS modules,
       string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS sites, count(*) > 1 AS collision
    FROM part GROUP BY ALL"""
)
def o05_symbol_table(spark, sf_dir):
    defs = table(spark, sf_dir, "part").withColumn("fqn", F.concat_ws(".", "p_brand", "p_type"))
    return aggs.symbol_table(defs, "fqn", "p_partkey", {"p_name": "kind"}, {"p_retailprice": "value"}, "p_size", "p_partkey")


@query("SELECT p_name AS fqn, count(*) AS n_sites, count(DISTINCT p_brand) > 1 AS cross_module FROM part GROUP BY p_name HAVING count(*) > 1")
def o06_collisions(spark, sf_dir):
    return aggs.collisions(table(spark, sf_dir, "part").withColumnRenamed("p_name", "fqn"), "fqn", "p_brand")


@query(
    """SELECT p_brand || '.' || p_name AS short, count(*) AS n_candidates, count(DISTINCT p_type) = 1 AS unambiguous,
       CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS value FROM part GROUP BY ALL"""
)
def o07_constant_unambiguous(spark, sf_dir):
    return aggs.constants(table(spark, sf_dir, "part").withColumn("short", F.concat_ws(".", "p_brand", "p_name")), "short", "p_type")


@query(
    """
    WITH s AS (SELECT p_brand || '.' || p_type || '.' || p_name AS fqn, p_brand AS module, CASE WHEN p_size <= 20 THEN 'test' ELSE 'source' END AS role FROM part),
    per AS (SELECT fqn, count(*) AS n, list(DISTINCT module) AS modules, count(*) FILTER (WHERE role <> 'test') AS np, max(module) FILTER (WHERE role <> 'test') AS prod FROM s GROUP BY fqn),
    u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Brand#' || CAST(l_suppkey % 25 AS VARCHAR) AS module,
          CASE WHEN l_linenumber = 7 THEN 'java.util.' || p_name WHEN l_linenumber = 6 THEN p_name WHEN l_linenumber = 5 THEN 'x.' || p_name ELSE p_brand || '.' || p_type || '.' || p_name END AS fqn
          FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT module, CASE WHEN n IS NULL THEN CASE WHEN fqn LIKE 'java.%' OR (fqn NOT LIKE '%.%' AND fqn NOT LIKE '%/%') THEN 'third_party' ELSE 'unresolved' END
      WHEN n = 1 AND list_contains(modules, module) THEN 'local' WHEN n = 1 THEN 'matched' WHEN list_contains(modules, module) THEN 'local'
      WHEN np = 1 AND prod = module THEN 'local' WHEN np = 1 THEN 'matched' ELSE 'ambiguous' END AS resolved, count(*) AS n_uses
    FROM u LEFT JOIN per USING (fqn) GROUP BY ALL"""
)
def o08_resolve_uses(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("fqn", F.concat_ws(".", "p_brand", "p_type", "p_name"))
    sites = part.select("fqn", F.col("p_brand").alias("module"), F.when(F.col("p_size") <= 20, "test").otherwise("source").alias("role"))
    line = F.col("l_linenumber")
    fqn = F.when(line == 7, F.concat(F.lit("java.util."), "p_name")).when(line == 6, F.col("p_name")).when(line == 5, F.concat(F.lit("x."), "p_name")).otherwise(F.col("fqn"))
    uses = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(fqn.alias("fqn"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25).cast("string")).alias("module"))
    return joins.resolve_uses(uses, sites).groupBy("module", "resolved").agg(F.count("*").alias("n_uses"))


@query(
    """
    WITH n AS (SELECT p_partkey, p_brand || '.' || p_type || '.' || replace(p_name, ' ', '.') AS fqn FROM part),
    ns AS (SELECT fqn AS k, min(p_partkey) AS owner FROM n WHERE p_partkey % 5 = 0 GROUP BY fqn
           UNION ALL SELECT p_brand || '.' || p_type, min(p_partkey) FROM part WHERE p_partkey % 3 = 0 GROUP BY 1
           UNION ALL SELECT p_brand, min(p_partkey) FROM part WHERE p_size > 45 GROUP BY 1)
    SELECT p_partkey, fqn, arg_max(k, length(k)) AS prefix, arg_max(owner, length(k)) AS owner
    FROM n LEFT JOIN ns ON fqn = k OR starts_with(fqn, k || '.') GROUP BY p_partkey, fqn"""
)
def o09_prefix_owner(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select("p_partkey", "p_size", "p_brand", "p_type", F.concat_ws(".", "p_brand", "p_type", F.replace(F.col("p_name"), F.lit(" "), F.lit("."))).alias("fqn"))
    own = F.min("p_partkey").alias("owner")
    owners = (
        names.where("p_partkey % 5 = 0").groupBy(F.col("fqn").alias("prefix")).agg(own)
        .unionByName(names.where("p_partkey % 3 = 0").groupBy(F.concat_ws(".", "p_brand", "p_type").alias("prefix")).agg(own))
        .unionByName(names.where("p_size > 45").groupBy(F.col("p_brand").alias("prefix")).agg(own))
    )
    return joins.prefix_owner(names.select("p_partkey", "fqn"), owners, "fqn", "prefix", "owner")


@query(
    """
    WITH h AS (SELECT regexp_extract(url, '^[a-z]+://[^/?#]+') AS prefix, 'host' AS label FROM pages WHERE page_id % 3 = 0
               UNION SELECT regexp_extract(url, '^[a-z]+://[^/?#]+/[^/?#]+'), 'section' FROM pages WHERE page_id % 4 = 0 UNION SELECT 'http', 'plain')
    SELECT page_id, url, arg_max(prefix, length(prefix)) AS prefix, arg_max(label, length(prefix)) AS label
    FROM pages LEFT JOIN h ON starts_with(url, prefix) AND (url = prefix OR substr(url, length(prefix) + 1, 1) IN ('.', '/', '?', '#')) GROUP BY page_id, url"""
)
def o10_prefix_longest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hints = (
        pages.where("page_id % 3 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("prefix"), F.lit("host").alias("label"))
        .unionByName(pages.where("page_id % 4 = 0").select(F.regexp_extract("url", "^[a-z]+://[^/?#]+/[^/?#]+", 0).alias("prefix"), F.lit("section").alias("label")))
        .unionByName(spark.createDataFrame([("http", "plain")], "prefix string, label string"))
        .where("prefix <> ''").distinct()
    )
    return joins.prefix_longest(pages, hints, "url", "prefix", "label")


EDGES = """(SELECT c_nationkey AS src, s_nationkey AS dst, l_returnflag AS channel, l_orderkey AS file, l_linenumber AS line, l_partkey FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def nation_edges(spark, sf_dir):
    line, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    met = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_returnflag").alias("channel"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), "l_partkey")


@query(
    f"""
    WITH e AS (SELECT * FROM {EDGES} t WHERE src <> dst),
    r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY file, line, l_partkey) AS rn FROM e)
    SELECT src, dst, count(*) AS weight, string_agg(CAST(file AS VARCHAR) || ':' || CAST(line AS VARCHAR), ',' ORDER BY file, line) FILTER (WHERE rn <= 3) AS examples FROM r GROUP BY src, dst"""
)
def o11_observed_weight(spark, sf_dir):
    return joins.weighted(nation_edges(spark, sf_dir).where("src <> dst"), ["src", "dst"], "file", "line")


@query(
    """SELECT l_partkey AS fqn, string_agg(CAST(l_suppkey AS VARCHAR) || ':' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR), ','
       ORDER BY l_suppkey, l_orderkey, l_linenumber) AS used_by FROM lineitem GROUP BY l_partkey"""
)
def o12_transpose(spark, sf_dir):
    return aggs.transpose(table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "fqn"), "fqn", ["l_suppkey", "l_orderkey", "l_linenumber"])


@query(
    """SELECT o_custkey AS source, l_suppkey AS target, l_returnflag AS channel, min(struct_pack(a := l_orderkey, b := l_linenumber)).a AS file,
       min(struct_pack(a := l_orderkey, b := l_linenumber)).b AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL"""
)
def o13_edge_dedupe(spark, sf_dir):
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = met.select(F.col("o_custkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("channel"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))
    return joins.first_by(edges, ["source", "target", "channel"], ["file", "line"])


@query(
    """
    WITH r AS (SELECT p_size % 3 AS list_no, p_partkey AS idx, p_name AS subject, p_retailprice AS evidence FROM part),
    s AS (SELECT list_no, count(*) AS n FROM r GROUP BY list_no),
    room AS (SELECT list_no, greatest(0, 1000 - coalesce(sum(n) OVER (ORDER BY list_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS room FROM s),
    k AS (SELECT r.*, row_number() OVER (PARTITION BY list_no ORDER BY evidence DESC, subject, idx) AS rn FROM r)
    SELECT list_no, idx, subject, evidence FROM k JOIN room USING (list_no) WHERE rn <= room"""
)
def o20_budget_take(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("list_no"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("subject"), F.col("p_retailprice").alias("evidence"))
    return ranking.budget_take(rows, "list_no", "idx", [F.desc("evidence"), F.asc("subject")], 1000)


@query(
    r"""
    WITH t AS (SELECT p_partkey, p_brand || '.' || p_type || '/' || p_name AS text FROM part),
    s AS (SELECT *, lower(text) AS low, [lower(x) FOR x IN regexp_split_to_array(text, '[.#:/_]+')] AS seg FROM t WHERE contains(lower(text), 'red'))
    SELECT p_partkey, text, CASE WHEN low = 'red' THEN 0 WHEN list_contains(seg, 'red') THEN 1 WHEN starts_with(low, 'red') OR len([x FOR x IN seg IF starts_with(x, 'red')]) > 0 THEN 3 ELSE 4 END AS tier, CAST(length(text) AS INTEGER) AS length FROM s"""
)
def o21_search_rank(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("."), F.col("p_type"), F.lit("/"), F.col("p_name")).alias("text"))
    return ranking.search(rows, "text", "red")


@query(
    """
    WITH b AS (SELECT p_type, count(*) AS demand FROM part GROUP BY p_type),
    s AS (SELECT demand, (1000 - (sum(demand) OVER w - demand)) // (count(*) OVER () - row_number() OVER w + 1) AS level FROM b WINDOW w AS (ORDER BY demand, p_type)),
    l AS (SELECT CAST(min_by(level, demand) AS BIGINT) AS level FROM s WHERE demand > level),
    c AS (SELECT p_type, demand, least(demand, coalesce(level, demand)) AS base, demand > coalesce(level, demand) AS unmet FROM b, l)
    SELECT p_type, demand, CAST(base + CASE WHEN unmet AND row_number() OVER (PARTITION BY unmet ORDER BY p_type) <= 1000 - sum(base) OVER () THEN 1 ELSE 0 END AS BIGINT) AS given FROM c"""
)
def o22_fair_split(spark, sf_dir):
    demands = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("demand"))
    return ranking.split_fairly(demands, "demand", "p_type", 1000)


@query(
    r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS k FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS cluster_id, count(*) OVER (PARTITION BY k) AS cluster_size FROM t"""
)
def o30_cluster(spark, sf_dir):
    return aggs.clusters(table(spark, sf_dir, "documents"), text.normalise_ws(F.col("text")), "doc_id")


LINKS = r"""
    WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages),
    q AS (SELECT page_id, CASE WHEN regexp_extract(u, '^[a-z]+://[^/]+(/.*)?$', 1) = '' THEN '/' ELSE regexp_extract(u, '^[a-z]+://[^/]+(/.*)?$', 1) END AS path FROM p),
    k AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE regexp_replace(path, '/[0-9]+$', '/{id}') END AS path FROM q),
    n AS (SELECT page_id, path, regexp_replace(regexp_replace(path, '/[0-9]+$', '/:id'), '\{[^{}]*\}|:[A-Za-z_][A-Za-z0-9_]*', '*', 'g') AS key FROM k)"""


def _link_sides(spark, sf_dir):
    plain = F.regexp_replace("url", "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", plain.alias("u"))
    calls = pages.where("page_id % 2 = 0").select("page_id", F.lit("http_out").alias("channel"), F.concat(F.lit("http:"), F.regexp_replace("u", "/[0-9]+$", "/:id")).alias("target"))
    path = F.regexp_replace(F.regexp_replace("u", "^[a-z]+://[^/]+", ""), "/[0-9]+$", "/{id}")
    routes = pages.where("page_id % 2 = 1").select("page_id", F.lit("http_in").alias("channel"), F.concat(F.lit("route:GET "), F.when(path == "", "/").otherwise(path)).alias("target"))
    return calls, routes


@query(
    LINKS
    + """ SELECT o.page_id AS out_page_id, i.page_id AS in_page_id, o.key AS key,
    CASE WHEN regexp_replace(o.path, '/[0-9]+$', '/:id') = i.path THEN 'exact' ELSE 'heuristic' END AS match_kind
    FROM n o JOIN n i ON o.key = i.key WHERE o.page_id % 2 = 0 AND i.page_id % 2 = 1"""
)
def o31_link_match(spark, sf_dir):
    calls, routes = _link_sides(spark, sf_dir)
    return joins.match_links(calls, routes, ["page_id"]).select("out_page_id", "in_page_id", "key", "match_kind")


@query(LINKS + " SELECT page_id, key FROM n o WHERE page_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM n i WHERE i.key = o.key AND i.page_id % 2 = 1)")
def o32_link_unmatched(spark, sf_dir):
    calls, routes = _link_sides(spark, sf_dir)
    return joins.unmatched_links(calls, routes).select("page_id", "key")


@query(
    """
    WITH old AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS c FROM orders WHERE o_orderkey % 2 = 0),
    fresh AS (SELECT o_custkey AS k, o_orderpriority AS c, min(o_orderkey) AS anchor FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
    SELECT k, c, anchor, CASE WHEN anchor IS NULL THEN 'decayed' ELSE 'live' END AS status FROM old LEFT JOIN fresh USING (k, c)"""
)
def o33_link_refresh(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("c"), F.col("o_orderkey").alias("anchor"))
    old = orders.where("anchor % 2 = 0").select("k", "c").distinct()
    return joins.refresh_links(old, orders.where("anchor % 2 = 1"), ["k", "c"], ["anchor"])


@query("SELECT doc_id, sha256(text) AS text_hash, substr(sha256(source || chr(31) || lang), 1, 16) AS scope_id FROM documents")
def o47_hash_scope(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hashing.sha256(F.col("text")).alias("text_hash"), hashing.short_id(F.col("source"), F.col("lang")).alias("scope_id"))


@query("SELECT c_custkey, 'name_' || substr(sha1(c_name), 1, 12) AS name, 'segment_' || substr(sha1(c_mktsegment), 1, 12) AS segment FROM customer")
def o48_anonymize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", hashing.anonymous("name", F.col("c_name")).alias("name"), hashing.anonymous("segment", F.col("c_mktsegment")).alias("segment"))


@query(
    """
    WITH e AS (SELECT user_id, event_id, ts, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
    SELECT user_id, event_id, event_type FROM e WHERE before IS DISTINCT FROM event_type"""
)
def o49_emit_on_change(spark, sf_dir):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).where(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props AS whole FROM events")
def o51_json_paths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), text.outermost_json(F.col("props")).alias("whole"))


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'A' AND l_quantity > 45)")
def o52_unreferenced(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 25").join(used, "p_partkey", "left_anti").select("p_partkey")


@query(
    """SELECT p.event_id, b.event_id AS near FROM events p JOIN events b ON p.user_id = b.user_id AND p.event_type = 'purchase' AND b.event_type = 'error'
       AND abs(p.event_id - b.event_id) <= 40"""
)
def o55_band_match(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    points = events.where("event_type = 'purchase'").select("user_id", "event_id")
    bands = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("near"))
    return joins.band_match(points, bands, "user_id", "event_id", "near", 40).select("event_id", "near")


@query(
    """
    SELECT p.event_id, p.user_id, b.event_id AS version FROM (SELECT * FROM events WHERE event_type <> 'click') p
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') b ON p.user_id = b.user_id AND p.event_id >= b.event_id"""
)
def o56_as_of_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.where("event_type <> 'click'").select("event_id", "user_id")
    versions = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("version"))
    return joins.as_of(rows, versions, "user_id", "event_id", "at")


@query(
    r"""
    WITH t AS (SELECT p_partkey, 'route/${' || p_brand || '.' || p_name || '}/x' AS template, p_brand || '.' || p_name AS k FROM part),
    c AS (SELECT p_brand || '.' || p_name AS k, CASE WHEN count(DISTINCT p_type) = 1 THEN min(p_type) END AS v FROM part GROUP BY 1)
    SELECT p_partkey, CASE WHEN v IS NULL THEN template ELSE 'route/' || v || '/x' END AS resolved, CASE WHEN v IS NULL THEN k END AS missing FROM t JOIN c USING (k)"""
)
def o57_route_constants(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("short", F.concat_ws(".", "p_brand", "p_name"))
    known = aggs.constants(part, "short", "p_type")
    rows = part.select("p_partkey", F.concat(F.lit("route/${"), "short", F.lit("}/x")).alias("template"))
    return joins.substitute(rows, known, "template", "short", "value").select("p_partkey", "resolved", aggs.joined(F.col("missing")).alias("missing"))
