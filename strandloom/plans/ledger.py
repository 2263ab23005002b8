"""Logs, claims, gates, retention and differences: operators on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import paths
from strandloom.operators import aggs, graph, packing, quality, ranking, setops
from strandloom.operators.joins import first_by
from strandloom.plans.lookups import EDGES, nation_edges
from strandloom.plans.registry import query, table


@query(
    """
    WITH c AS (SELECT l_partkey AS subject, l_returnflag AS kind, l_linestatus AS sig, l_suppkey % 50 + 1 AS module, l_orderkey AS anchor, l_tax AS statement FROM lineitem),
    m AS (SELECT c.*, p_partkey IS NOT NULL AS own FROM c LEFT JOIN part ON p_partkey = subject AND p_size = module),
    s AS (SELECT subject, kind, sig, count(DISTINCT anchor) AS anchors, bool_or(own) AS owned FROM m GROUP BY ALL),
    b AS (SELECT *, max(anchors) OVER (PARTITION BY subject, kind) AS best FROM s),
    g AS (SELECT subject, kind, count(*) AS n_signatures, count(*) FILTER (WHERE owned) AS n_owned, max(sig) FILTER (WHERE owned) AS own_sig,
          count(*) FILTER (WHERE anchors = best) AS n_best, max(sig) FILTER (WHERE anchors = best) AS best_sig FROM b GROUP BY ALL),
    d AS (SELECT subject, kind, n_signatures, CASE WHEN n_signatures = 1 THEN 'unanimous' WHEN n_owned = 1 THEN 'ownership' WHEN n_best = 1 THEN 'evidence' ELSE 'contested' END AS resolution, own_sig, best_sig FROM g),
    w AS (SELECT *, CASE resolution WHEN 'ownership' THEN own_sig WHEN 'contested' THEN NULL ELSE best_sig END AS winner FROM d)
    SELECT subject, kind, n_signatures, resolution, winner, count(DISTINCT anchor) AS n_anchors, count(DISTINCT statement) > 1 AND resolution = 'unanimous' AS near_miss
    FROM c JOIN w USING (subject, kind) WHERE resolution = 'contested' OR sig IS NOT DISTINCT FROM winner GROUP BY subject, kind, n_signatures, resolution, winner"""
)
def o23_conflict_merge(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("sig"), (F.col("l_suppkey") % 50 + 1).cast("int").alias("module"), F.col("l_orderkey").alias("anchor"), F.col("l_tax").alias("statement"))
    owners = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.col("p_size").alias("module"))
    return aggs.conflict_merge(claims, owners, "subject", "kind", "sig", "module", "anchor", "statement")


@query("SELECT o_custkey AS node, arg_max(o_orderkey, struct_pack(g := year(o_orderdate), h := o_orderkey)) AS best FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def o24_best_generation(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("node"), F.year("o_orderdate").alias("generation"), F.col("o_orderkey").alias("best"))
    return aggs.best_by(done, "node", ["generation", "best"], "best")


LOG = """(SELECT o_custkey AS node, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '' END AS error, year(o_orderdate) AS run FROM orders)"""


def attempts(spark, sf_dir):
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "complete").when(s == "O", "failed").otherwise("pending")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.when(s == "O", F.col("o_orderpriority")).otherwise("").alias("error"), F.year("o_orderdate").cast("long").alias("run"))


@query(
    f"""SELECT node, CASE max(CASE status WHEN 'complete' THEN 4 WHEN 'invalid' THEN 3 WHEN 'failed' THEN 2 ELSE 1 END) WHEN 4 THEN 'complete' WHEN 2 THEN 'failed' ELSE 'pending' END AS status,
    arg_max(error, seq) FILTER (WHERE error <> '') AS error FROM {LOG} t GROUP BY node"""
)
def o25_status_rank(spark, sf_dir):
    return aggs.node_status(attempts(spark, sf_dir), "node", "status", "error", "seq")


@query(f"SELECT run, count(*) FILTER (WHERE status = 'complete') AS done, count(*) AS total, round(count(*) FILTER (WHERE status = 'complete') / count(*), 4) AS coverage FROM {LOG} t GROUP BY run")
def o26_coverage(spark, sf_dir):
    done, total = F.count(F.when(F.col("status") == "complete", 1)), F.count("*")
    return attempts(spark, sf_dir).groupBy("run").agg(done.alias("done"), total.alias("total"), aggs.ratio(done, total).alias("coverage"))


@query(
    """
    WITH c AS (SELECT l_suppkey AS node, l_partkey AS subject, l_returnflag AS channel, CASE WHEN l_linenumber % 2 = 0 THEN 'public' ELSE 'private' END AS visibility FROM lineitem),
    e AS (SELECT DISTINCT l_partkey AS subject, l_returnflag AS channel FROM lineitem WHERE l_quantity > 45),
    v AS (SELECT node, CASE WHEN e.subject IS NOT NULL THEN 'entailed' WHEN (CASE WHEN p_size % 2 = 0 THEN 'public' ELSE 'private' END) <> visibility THEN 'contradicted' ELSE 'consistent' END AS verdict
          FROM c LEFT JOIN e USING (subject, channel) LEFT JOIN part ON p_partkey = c.subject)
    SELECT node, count(*) FILTER (WHERE verdict = 'entailed') AS entailed, count(*) FILTER (WHERE verdict = 'consistent') AS consistent, count(*) FILTER (WHERE verdict = 'contradicted') AS contradicted,
           round(count(*) FILTER (WHERE verdict = 'entailed') / count(*), 4) AS entailed_ratio FROM v GROUP BY node"""
)
def o27_entail(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    claims = line.select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("channel"), F.when(F.col("l_linenumber") % 2 == 0, "public").otherwise("private").alias("visibility"))
    edges = line.where("l_quantity > 45").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("channel"))
    defines = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.when(F.col("p_size") % 2 == 0, "public").otherwise("private").alias("visibility"))
    return quality.verdict_counts(quality.entail(claims, edges, defines, "subject", "channel", "visibility"), "node")


UNKNOWNS = """(SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 7 THEN l_partkey + 10000000 ELSE l_partkey END AS subject,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS channel, CASE WHEN l_quantity > 40 THEN 'nothing' ELSE 'needs_human' END AS needs FROM lineitem)"""


def unknown_rows(spark, sf_dir):
    line = F.col("l_linenumber")
    subject = F.when(line == 1, F.lit(None)).when(line == 7, F.col("l_partkey") + 10000000).otherwise(F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", subject.alias("subject"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("channel"), F.when(F.col("l_quantity") > 40, "nothing").otherwise("needs_human").alias("needs"))


@query(
    f"""
    WITH e AS (SELECT DISTINCT l_partkey AS subject, l_returnflag AS channel FROM lineitem WHERE l_quantity > 48),
    g AS (SELECT u.subject, CASE WHEN u.subject IS NOT NULL AND p_partkey IS NULL THEN 'subject' WHEN e.subject IS NOT NULL THEN 'answered' WHEN needs <> 'needs_human' THEN 'needs' END AS reason
          FROM {UNKNOWNS} u LEFT JOIN part ON p_partkey = u.subject LEFT JOIN e ON e.subject = u.subject AND e.channel = u.channel)
    SELECT subject, reason, count(*) AS n FROM g GROUP BY ALL"""
)
def o28_gates(spark, sf_dir):
    answered = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("channel"))
    subjects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"))
    return quality.gate(unknown_rows(spark, sf_dir), subjects, answered, "subject", "channel", "needs").groupBy("subject", "reason").agg(F.count("*").alias("n"))


@query(
    f"""
    WITH c AS (SELECT subject, channel, min(id) AS id FROM (SELECT l_partkey AS subject, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS channel, l_orderkey AS id FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL),
    v AS (SELECT c.*, id % 3 = 0 AS bad FROM c),
    s AS (SELECT u.subject, CASE WHEN u.subject IS NULL THEN 'open' WHEN p_partkey IS NULL THEN 'moot' WHEN v.id IS NOT NULL AND NOT bad THEN 'resolved' ELSE 'open' END AS status, v.id
          FROM {UNKNOWNS} u LEFT JOIN part ON p_partkey = u.subject LEFT JOIN v ON v.subject = u.subject AND v.channel IS NOT DISTINCT FROM u.channel)
    SELECT subject, status, CASE WHEN status = 'resolved' THEN id END AS resolved_by, count(*) AS n FROM s GROUP BY ALL"""
)
def o29_discharge(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_partkey").alias("subject"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("channel"), F.col("l_orderkey").alias("id"), F.when(F.col("l_orderkey") % 3 == 0, "contradicted").otherwise("consistent").alias("verdict"))
    subjects = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"))
    return quality.discharge(unknown_rows(spark, sf_dir), claims, subjects, "subject", "channel", "id", "verdict").groupBy("subject", "status", "resolved_by").agg(F.count("*").alias("n"))


@query(
    """
    WITH a AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 2 = 1)
    SELECT k, p, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT k, p, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
)
def o34_snapshot_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("p"))
    return setops.snapshot_diff(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), ["k", "p"])


@query(
    """
    WITH a AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS before FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS after FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT k, before, after FROM a JOIN b USING (k) WHERE before <> after"""
)
def o58_moved_anchor(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    return setops.moved(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "k", "o_orderstatus", "o_orderkey")


@query("SELECT o_custkey AS node, count(*) AS entries, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders) GROUP BY 1")
def o35_as_of(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    half = orders.agg(F.max("o_orderkey")).first()[0] // 2
    return setops.as_of(orders, "o_orderkey", half).groupBy(F.col("o_custkey").alias("node")).agg(F.count("*").alias("entries"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))


@query(
    """
    WITH last AS (SELECT max(o_orderkey) AS k FROM orders WHERE o_custkey = 7), gone AS (SELECT DISTINCT o_custkey FROM orders, last WHERE o_orderkey > last.k)
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM gone)"""
)
def o36_exclude_runs(spark, sf_dir):
    return setops.exclude_runs(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", since=7).select("o_orderkey", "o_custkey")


@query(
    """
    SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000 OR c_mktsegment = 'MACHINERY' OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"""
)
def o37_retention(spark, sf_dir):
    marked = table(spark, sf_dir, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 9000).alias("head"), (F.col("c_mktsegment") == "MACHINERY").alias("pinned"))
    cited = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select("o_custkey")
    return setops.retained(marked, "c_custkey", "head", "pinned", cited).select("c_custkey", "c_name")


def part_files(spark, sf_dir):
    """Parts as files: brand/type/size/name, with sizes as lines."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.concat_ws("/", F.col("p_brand"), F.col("p_type"), F.concat(F.lit("s"), (F.col("p_size") % 7).cast("string")), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))).alias("path"), (F.col("p_size") * 20).alias("loc"))


@query()
def o38_partition_packing(spark, sf_dir):
    return packing.partition(part_files(spark, sf_dir), "module", "path", "loc", most_files=20, most_loc=3000).drop("files")


@query(
    """
    WITH s AS (SELECT p_size AS level, p_partkey AS node, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) // 8 AS chunk FROM part),
    n AS (SELECT level, max(chunk) + 1 AS n FROM s GROUP BY level), b AS (SELECT level, coalesce(sum(n) OVER (ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
    SELECT level, node, CAST(before + chunk AS BIGINT) AS wave FROM s JOIN b USING (level)"""
)
def o39_waves(spark, sf_dir):
    return ranking.waves(table(spark, sf_dir, "part").select(F.col("p_size").alias("level"), F.col("p_partkey").alias("node")), "level", "node", 8).select("level", "node", "wave")


@query("SELECT s_suppkey AS node, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_tax = 0) THEN 'T3' ELSE 'T2' END AS tier FROM supplier")
def o40_tier(spark, sf_dir):
    unresolved = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_tax = 0").select(F.col("l_suppkey").alias("node"))
    return quality.tier(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), unresolved, "node")


CONFIDENCE = "CASE WHEN l_discount >= 0.09 THEN 'low' WHEN l_discount >= 0.05 THEN 'medium' WHEN l_discount >= 0.01 THEN 'high' ELSE 'contested' END"


@query(
    f"""SELECT l_suppkey AS grp, arg_min(c, CASE c WHEN 'contested' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS confidence
    FROM (SELECT l_suppkey, {CONFIDENCE} AS c FROM lineitem) GROUP BY l_suppkey"""
)
def o43_worst_confidence(spark, sf_dir):
    d = F.col("l_discount")
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.when(d >= 0.09, "low").when(d >= 0.05, "medium").when(d >= 0.01, "high").otherwise("contested").alias("confidence"))
    return graph.worst_confidence(members, "grp", "confidence", aggs.caution_rank)


@query(
    """SELECT p_type AS shape, s_nationkey AS kind, count(*) AS n, round(avg(l_quantity), 4) AS avg_quantity, round(avg(l_discount), 4) AS avg_discount,
    round(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) / count(*), 4) AS validated FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
)
def o44_star_prior(spark, sf_dir):
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    met = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return met.groupBy(F.col("p_type").alias("shape"), F.col("s_nationkey").alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 4).alias("avg_quantity"), F.round(F.avg("l_discount"), 4).alias("avg_discount"), aggs.ratio(F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)), F.count("*")).alias("validated"))


@query(
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' OR (o_totalprice >= 400000 AND o_orderstatus = 'F')
    ORDER BY (o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')::INT DESC, o_totalprice DESC, o_orderkey LIMIT 5"""
)
def o45_outliers(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).cast("int").alias("bad"), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("claims"))
    return ranking.outliers(runs, "bad", "o_totalprice", "claims", "o_orderkey", costly=400000).select("o_orderkey", "o_totalprice")


@query(
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
    n AS (SELECT doc_id, no, trim(regexp_replace(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g')) AS t FROM l),
    c AS (SELECT doc_id, no + doc_id % 9 AS line, substr(t, 1, 24) AS a FROM n WHERE no = 2),
    h AS (SELECT c.doc_id, line, a, list(n.no) FILTER (WHERE contains(n.t, trim(a)) AND length(trim(a)) >= 12) AS hits FROM c JOIN n USING (doc_id) GROUP BY ALL),
    k AS (SELECT *, len([x FOR x IN hits IF abs(x - line) <= 5]) AS near FROM h)
    SELECT doc_id, CAST(line AS BIGINT) AS line, CASE WHEN hits IS NULL THEN 'not_found' WHEN len(hits) > 3 THEN 'too_common' WHEN near = 0 THEN 'not_found' WHEN near > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict FROM k"""
)
def o46_anchor_verify(spark, sf_dir):
    from strandloom.functions.text import normalise_ws

    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "text")).withColumn("no", F.col("no") + 1)
    claims = lines.where("no = 2").select("doc_id", (F.col("no") + F.col("doc_id") % 9).alias("line"), F.substring(normalise_ws(F.col("text")), 1, 24).alias("anchor"))
    return quality.anchor_hits(claims, lines, "doc_id", "line", "anchor").select("doc_id", "line", "verdict")


@query("SELECT o_orderkey, node FROM (SELECT o_orderkey, o_custkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn > 3")
def o50_compaction_split(spark, sf_dir):
    return ranking.superseded(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey", F.col("o_custkey").alias("node"))


@query(
    """
    WITH e AS (SELECT p_partkey AS k FROM part), g AS (SELECT l_partkey AS k FROM lineitem UNION ALL SELECT p_partkey + 5 FROM part WHERE p_size = 50)
    SELECT k, 'duplicate' AS problem FROM g GROUP BY k HAVING count(*) > 1 UNION ALL SELECT k, 'missing' FROM e WHERE k NOT IN (SELECT k FROM g) UNION ALL SELECT DISTINCT k, 'extra' FROM g WHERE k NOT IN (SELECT k FROM e)"""
)
def o53_exactly_once(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    got = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")).unionByName(part.where("p_size = 50").select((F.col("p_partkey") + 5).alias("k")))
    return setops.exactly_once(part.select(F.col("p_partkey").alias("k")), got, "k")


@query(
    f"""
    WITH e AS (SELECT src AS node, file AS claim, channel FROM {EDGES} t), c AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey % 3 = 0 END AS churned FROM nation)
    SELECT claim, CASE WHEN max(CASE WHEN channel = 'A' THEN 1 END) IS NULL THEN 'anchored_unreviewed' WHEN coalesce(bool_or(churned), false) THEN 'stale' WHEN count(*) FILTER (WHERE churned IS NULL) > 0 THEN 'unknown_churn' ELSE 'live' END AS freshness
    FROM e LEFT JOIN c USING (node) GROUP BY claim"""
)
def o59_freshness(spark, sf_dir):
    evidence = nation_edges(spark, sf_dir).select(F.col("src").alias("file"), F.col("file").alias("claim"), F.when(F.col("channel") == "A", 1).alias("reviewed"))
    n = F.col("n_nationkey")
    churn = table(spark, sf_dir, "nation").select(n.alias("file"), F.when(n % 4 != 0, n % 3 == 0).alias("churned"))
    return quality.freshness(evidence, churn, "claim", "file", "reviewed")


@query(
    """
    WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, CAST(count(*) AS BIGINT) AS n_events, min(event_id) AS first_event FROM s GROUP BY user_id, session"""
)
def x01_session_window(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event")).drop("session_window")


@query("SELECT p_brand, p_type, count(*) AS n, sum(p_size) AS total FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())")
def x02_grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "part").groupingSets([["p_brand", "p_type"], ["p_brand"], []], "p_brand", "p_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))
