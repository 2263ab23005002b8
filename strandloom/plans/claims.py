"""The folded state of a log, and the reports over it: operators on the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import aggs, fold, graph, reports
from strandloom.plans.graphs import PARTNERS, partners
from strandloom.plans.registry import query, table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'pending' END"
#: The log of the fold: orders are patches of customers, line items their claims and their questions.
FOLD = f"""
    WITH p AS (SELECT o_orderkey AS patch, o_custkey AS node, year(o_orderdate) AS run, {STATUS} AS status FROM orders WHERE year(o_orderdate) <> 1995 AND o_custkey IN (SELECT c_custkey FROM customer)),
    done AS (SELECT * FROM p WHERE status = 'complete'),
    best AS (SELECT node, arg_max(patch, run * 1000000000 + patch) AS patch FROM done GROUP BY node),
    c AS (SELECT l_partkey AS subject, l_returnflag AS kind, l_linestatus AS sig, l_suppkey % 50 + 1 AS module, l_orderkey * 10 + l_linenumber AS anchor, l_tax AS statement
          FROM lineitem JOIN best ON patch = l_orderkey WHERE l_discount < 0.085)"""


def _folded(spark, sf_dir):
    s, items = F.col("o_orderstatus"), table(spark, sf_dir, "lineitem")
    status = F.when(s == "F", "complete").when(s == "O", "failed").otherwise("pending")
    patches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("patch"), F.col("o_custkey").alias("node"), F.year("o_orderdate").alias("run"), F.col("o_orderkey").alias("seq"), status.alias("status"), F.year("o_orderdate").alias("generation"), F.lit("").alias("error"))
    about = [F.col("l_orderkey").alias("patch"), F.col("l_partkey").alias("subject")]
    claims = items.select(*about, F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("sig"), (F.col("l_suppkey") % 50 + 1).cast("int").alias("module"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("anchor"), F.col("l_tax").alias("statement"), (F.col("l_discount") < 0.085).alias("verified"))
    unknowns = items.select(*about, F.col("l_suppkey").alias("question"), F.col("l_returnflag").alias("channel"))
    owners = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("subject"), F.col("p_size").alias("module"))
    scopes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") + 1).alias("n_files"))
    return fold.fold(patches, claims, unknowns, owners, scopes, spark.createDataFrame([(1995,)], "run int"))


@query(
    FOLD
    + """,
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
def o76_fold_claims(spark, sf_dir):
    return _folded(spark, sf_dir).claims


@query(
    FOLD
    + """,
    u AS (SELECT l_suppkey AS question, node, l_partkey AS subject, l_returnflag AS channel, min(patch) AS seq FROM lineitem JOIN done ON patch = l_orderkey GROUP BY ALL)
    SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.subject = u.subject AND c.kind = u.channel)"""
)
def o77_fold_unknowns(spark, sf_dir):
    return _folded(spark, sf_dir).unknowns.select("question", "node", "subject", "channel", "seq")


@query(
    FOLD
    + """
    SELECT CAST(sum(CASE WHEN c_custkey IN (SELECT node FROM done) THEN c_nationkey + 1 ELSE 0 END) AS BIGINT) AS files_done, CAST(sum(c_nationkey + 1) AS BIGINT) AS files,
           round(sum(CASE WHEN c_custkey IN (SELECT node FROM done) THEN c_nationkey + 1 ELSE 0 END) / sum(c_nationkey + 1), 4) AS coverage FROM customer"""
)
def o78_fold_coverage(spark, sf_dir):
    return _folded(spark, sf_dir).coverage


@query(f"SELECT year(o_orderdate) AS wave, count(*) FILTER (WHERE s = 'complete') AS complete, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'pending') AS pending, count(*) AS total FROM (SELECT *, {STATUS} AS s FROM orders) GROUP BY 1")
def o79_state_counts(spark, sf_dir):
    s = F.col("o_orderstatus")
    tasks = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("wave"), F.when(s == "F", "complete").when(s == "O", "failed").otherwise("pending").alias("state"))
    return reports.state_counts(tasks, "wave", "state", ["complete", "failed", "pending"])


@query("SELECT l_linestatus AS category, round(avg(CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY 1")
def o80_answer_score(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("category"), F.when(F.col("l_returnflag") == "A", "covered").when(F.col("l_returnflag") == "N", "partial").otherwise("absent").alias("verdict"))
    return facts.groupBy("category").agg(F.round(reports.answer_score(F.col("verdict")), 6).alias("score"))


@query("SELECT c_custkey AS node, round(avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 WHEN o_orderkey IS NOT NULL THEN 0.0 END), 6) AS rate FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def o81_escalation_rate(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    flag = F.when(F.col("o_orderkey").isNotNull(), F.col("o_orderpriority") == "1-URGENT")
    return met.groupBy(F.col("c_custkey").alias("node")).agg(F.round(reports.share_or_null(flag), 6).alias("rate"))


@query(
    """WITH k AS (SELECT o_custkey, max(o_orderstatus) = 'P' AS churned FROM orders GROUP BY 1)
    SELECT CASE WHEN churned IS NULL THEN 'unknown' WHEN churned THEN 'stale' ELSE 'fresh' END AS bucket, count(*) AS n FROM customer LEFT JOIN k ON c_custkey = o_custkey GROUP BY 1"""
)
def o82_freshness_counts(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.max("o_orderstatus") == "P").alias("churned"))
    return reports.freshness_by_cache(table(spark, sf_dir, "customer"), cache, "c_custkey", "churned")


SHARED = f"""
    WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS} t), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
    s AS (SELECT DISTINCT c_nationkey AS module, o_orderpriority || '/' || c_mktsegment || '/' || CAST(o_orderkey AS VARCHAR) AS target FROM customer JOIN orders ON c_custkey = o_custkey),
    t AS (SELECT target, list_sort(list(DISTINCT src)) AS processes FROM r JOIN s ON dst = module GROUP BY target HAVING count(DISTINCT src) >= 2)"""


def _shared(spark, sf_dir):
    reach = graph.closure(partners(spark, sf_dir))
    target = F.concat_ws("/", "o_orderpriority", "c_mktsegment", F.col("o_orderkey").cast("string"))
    storage = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("dst"), target.alias("target"))
    return reports.shared_by(reach, storage, "src", "dst", "target")


@query(SHARED + " SELECT target, array_to_string(processes, ',') AS processes FROM t")
def o83_shared_targets(spark, sf_dir):
    return _shared(spark, sf_dir).select("target", F.array_join(F.transform("processes", lambda x: x.cast("string")), ",").alias("processes"))


@query(SHARED + " SELECT array_to_string(processes, ',') AS processes, count(*) AS n_targets, min(target) AS first_target FROM t GROUP BY 1")
def o84_boundaries(spark, sf_dir):
    found = reports.boundaries(_shared(spark, sf_dir), "target")
    return found.withColumn("processes", F.array_join(F.transform("processes", lambda x: x.cast("string")), ","))


@query(
    """WITH n AS (SELECT p_partkey, ['other/' || p_brand, CASE WHEN p_size > 25 THEN 'root/' || p_type || '/' || p_name ELSE p_name END, 'root/last/x'] AS nodes FROM part)
    SELECT p_partkey, string_split([x FOR x IN nodes IF starts_with(x, 'root/')][1], '/')[2] AS module FROM n"""
)
def o85_module_of_claim(spark, sf_dir):
    below = F.when(F.col("p_size") > 25, F.concat(F.lit("root/"), "p_type", F.lit("/"), "p_name")).otherwise(F.col("p_name"))
    nodes = F.array(F.concat(F.lit("other/"), "p_brand"), below, F.lit("root/last/x"))
    return table(spark, sf_dir, "part").select("p_partkey", reports.module_of_claim(nodes, F.lit("none")).alias("module"))


@query(
    """WITH s AS (SELECT l_partkey AS subject, l_returnflag AS kind, coalesce(nullif(l_linestatus, 'O'), '') AS signature, min(l_tax) AS statement, count(DISTINCT l_orderkey) AS n_anchors FROM lineitem GROUP BY ALL)
    SELECT subject, kind, string_agg(signature || ':' || CAST(n_anchors AS VARCHAR), ';' ORDER BY signature) AS positions FROM s GROUP BY ALL HAVING count(*) > 1"""
)
def o86_conflict_positions(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_returnflag").alias("kind"), F.nullif("l_linestatus", F.lit("O")).alias("sig"), F.col("l_tax").alias("statement"), F.col("l_orderkey").alias("anchor"))
    found = reports.conflict_positions(claims, ["subject", "kind"], "sig", "statement", "anchor")
    return found.withColumn("positions", F.array_join(F.transform("positions", lambda p: F.concat(p.signature, F.lit(":"), p.n_anchors.cast("string"))), ";"))


@query("SELECT doc_id FROM documents WHERE CASE WHEN lang = 'en' THEN sha256(coalesce(text, '') || CASE WHEN source IS NULL THEN '' ELSE 'x' END) WHEN lang = 'de' THEN sha256(coalesce(text, '')) END <> sha256(coalesce(text, ''))")
def o87_broken_entries(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    stored = F.when(F.col("lang") == "en", F.sha2(F.concat(text, F.when(F.col("source").isNull(), "").otherwise("x")), 256)).when(F.col("lang") == "de", F.sha2(text, 256))
    return reports.broken_entries(table(spark, sf_dir, "documents").withColumn("stored", stored), F.col("text"), "stored").select("doc_id")


@query(
    """WITH w AS (SELECT o_custkey AS name, count(*) AS v FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), g AS (SELECT o_custkey AS name, count(*) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
    SELECT name, CASE WHEN g.v IS NULL THEN 'missing' WHEN w.v IS NULL THEN 'extra' ELSE 'different' END AS state FROM w FULL JOIN g USING (name) WHERE w.v IS DISTINCT FROM g.v"""
)
def o88_compare_artifacts(spark, sf_dir):
    side = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != s).groupBy(F.col("o_custkey").alias("name")).agg(F.count("*").alias("v"))
    return reports.compare_artifacts(side("O"), side("F"), "name", "v")


@query(
    """WITH h AS (SELECT c_custkey AS node, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS a, count(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS b FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT c_custkey AS node FROM customer JOIN h ON node = c_custkey WHERE c_acctbal > 0 AND a = b"""
)
def o89_carried_over(spark, sf_dir):
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").withColumnRenamed("c_custkey", "node")
    side = lambda s: met.groupBy("node").agg(F.count_if(F.col("o_orderstatus") == s).alias("h"))
    folded = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("node"))
    return reports.carried_over(folded, side("F"), side("O"), "node", "h")


@query(
    """SELECT conv_id, turn, string_agg(m, '; ' ORDER BY k) AS errors FROM (
      SELECT conv_id, turn, unnest([1, 2, 3, 4]) AS k, unnest([CASE WHEN NOT coalesce(role IN ('user', 'assistant'), false) THEN '/role: not one of the values' END, CASE WHEN NOT coalesce(length(text) BETWEEN 40 AND 400, false) THEN '/text: length' END,
        CASE WHEN NOT coalesce(turn < 6, false) THEN '/turn: too large' END, CASE WHEN NOT coalesce(role <> 'user' OR NOT contains(text, 'contested'), false) THEN '/text: agents may not author contested' END]) AS m FROM conversations)
    WHERE m IS NOT NULL GROUP BY ALL"""
)
def o90_schema_errors(spark, sf_dir):
    rules = [
        ("/role: not one of the values", F.col("role").isin("user", "assistant")),
        ("/text: length", F.char_length("text").between(40, 400)),
        ("/turn: too large", F.col("turn") < 6),
        ("/text: agents may not author contested", (F.col("role") != "user") | ~F.contains("text", F.lit("contested"))),
    ]
    rows = table(spark, sf_dir, "conversations").withColumn("m", reports.checked(rules)).where(F.size("m") > 0)
    return rows.select("conv_id", "turn", F.array_join("m", "; ").alias("errors"))


NAMES = "lower(replace(p_type, ' ', '.')) || '.' || replace(p_name, ' ', '.')"


def _names(spark, sf_dir):
    name = F.concat(F.lower(F.replace("p_type", F.lit(" "), F.lit("."))), F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), "p_brand")


@query(f"SELECT array_to_string(list_slice(string_split({NAMES}, '.'), 1, 2), '.') AS root, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, root LIMIT 60")
def o91_top_roots(spark, sf_dir):
    return reports.top_roots(_names(spark, sf_dir), "name", parts=2)


@query("SELECT p_size AS module, count(*) AS n, arg_min(p_brand || CASE WHEN p_retailprice > 950 THEN '.x' ELSE '' END, p_partkey) FILTER (WHERE p_retailprice > 950) AS label FROM part GROUP BY 1")
def o92_process_labels(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(F.col("p_size").alias("module"), F.concat("p_brand", F.when(F.col("p_retailprice") > 950, ".x").otherwise("")).alias("source"), "p_partkey")
    return reports.process_labels(edges, "module", "source", "p_partkey")


@query("SELECT doc_id, starts_with(source || '/' || lang || '/' || CAST(doc_id AS VARCHAR), source || '/en/') AS below FROM documents")
def o93_descends(spark, sf_dir):
    node = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", reports.descends(node, F.concat_ws("/", "source", F.lit("en"))).alias("below"))


@query("SELECT o_custkey AS caller, l_suppkey AS callee, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 7 OR l_suppkey = 7 GROUP BY ALL")
def o94_service_links(spark, sf_dir):
    met = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    links = met.select(F.col("o_custkey").alias("caller"), F.col("l_suppkey").alias("callee"))
    return reports.of_service(links, 7, "caller", "callee").groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS kind, CAST(sum(p_size) AS BIGINT) AS n, CASE p_brand WHEN 'Brand#5' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 3 END AS place FROM part GROUP BY 1")
def o95_legend(spark, sf_dir):
    return reports.legend(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), "p_size"), "kind", "p_size", ["Brand#5", "Brand#2"]).select("kind", "n", "place")


@query("SELECT l_suppkey AS unit, name, CAST(sum(k) AS BIGINT) AS n FROM (SELECT l_suppkey, l_returnflag AS name, l_linenumber AS k FROM lineitem UNION ALL SELECT l_suppkey, 'line ' || l_linestatus, 1 FROM lineitem) GROUP BY ALL")
def o96_merged_counts(spark, sf_dir):
    counts = F.map_from_arrays(F.array("l_returnflag", F.concat(F.lit("line "), "l_linestatus")), F.array(F.col("l_linenumber"), F.lit(1)))
    maps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), counts.alias("counts"))
    return reports.merged_counts(maps, ["unit"], "counts")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN p_retailprice > 950 THEN 'new/' || CAST(l_partkey AS VARCHAR) ELSE CAST(l_partkey AS VARCHAR) END AS file, coalesce(p_retailprice > 950, false) AS renamed FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def o97_redirected(spark, sf_dir):
    renames = table(spark, sf_dir, "part").where("p_retailprice > 950").select(F.col("p_partkey").cast("string").alias("old"), F.concat(F.lit("new/"), F.col("p_partkey").cast("string")).alias("new"))
    anchors = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("file"))
    return reports.redirected(anchors, renames, "file").select("l_orderkey", "l_linenumber", "file", "renamed")


@query(
    """SELECT o_custkey AS repo, arg_max(o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, o_orderkey) * 1000000000 + o_orderkey) AS snapshot
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1"""
)
def o98_latest_pinned(spark, sf_dir):
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repo"), F.col("o_orderkey").alias("snapshot"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("touched"))
    artifacts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("snapshot"))
    return reports.latest_pinned(snapshots, artifacts, "snapshot", "touched", "repo")


@query(
    """WITH o AS (SELECT doc_id, text FROM documents WHERE lang <> 'en'), n AS (SELECT doc_id, CASE WHEN source = 'web' THEN '  ' || text ELSE text || ' more' END AS text FROM documents WHERE lang <> 'de')
    SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'edited' END AS change FROM o FULL JOIN n USING (doc_id)
    WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.text || ' more' = n.text"""
)
def o99_change_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    side = lambda df, text: df.select(F.col("doc_id").cast("string").alias("path"), F.split(text, "\n").alias("lines"))
    new = F.when(F.col("source") == "web", F.concat(F.lit("  "), "text")).otherwise(F.concat("text", F.lit(" more")))
    renames = spark.createDataFrame([], "old string, new string")
    return reports.change_classes(side(docs.where("lang <> 'en'"), F.col("text")), side(docs.where("lang <> 'de'"), new), renames, "path", "lines")


OWNERS = f"""
    WITH s AS (SELECT {NAMES} AS name, CAST(p_partkey AS VARCHAR) AS file FROM part),
    l AS (SELECT name, file, string_split(name, '.') AS w FROM s), x AS (SELECT name, file, array_to_string(w[1:k], '.') AS prefix FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM l)),
    f AS (SELECT prefix, arg_min(file, (name <> prefix, name, file)) AS file FROM x GROUP BY prefix),
    n AS (SELECT DISTINCT array_to_string(string_split(name, '.')[1:2], '.') || '.' || file AS node FROM s),
    q AS (SELECT node, k, array_to_string(string_split(node, '.')[1:k], '.') AS prefix FROM (SELECT node, unnest(range(1, len(string_split(node, '.')) + 1)) AS k FROM n))
    SELECT node, arg_max(file, k) AS file FROM q JOIN f USING (prefix) GROUP BY node"""


@query(OWNERS)
def o100_owner_file(spark, sf_dir):
    symbols = _names(spark, sf_dir).select("name", F.col("p_partkey").cast("string").alias("file"))
    nodes = symbols.select(F.concat(F.array_join(F.slice(F.split("name", r"\."), 1, 2), "."), F.lit("."), "file").alias("node"))
    return reports.owner_file(nodes, symbols, "node", "name", "file")


@query("SELECT l_partkey AS symbol, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, symbol LIMIT 12")
def o101_most_referenced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.count_distinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "symbol").limit(12)


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS} t), r AS (SELECT dst AS node, 'down' AS way FROM e WHERE src = 0 UNION SELECT e.dst, way FROM r JOIN e ON e.src = r.node WHERE way = 'down'),
    u AS (SELECT src AS node, 'up' AS way FROM e WHERE dst = 0 UNION SELECT e.src, way FROM u JOIN e ON e.dst = u.node WHERE way = 'up')
    SELECT * FROM r WHERE node <> 0 UNION SELECT * FROM u WHERE node <> 0"""
)
def o102_reach(spark, sf_dir):
    edges = partners(spark, sf_dir)
    down, up = (graph.bfs(edges, 0, a, b, most=10**6)[0].where("depth > 0").select("node", F.lit(way).alias("way")) for a, b, way in (("src", "dst", "down"), ("dst", "src", "up")))
    return down.unionByName(up)


@query("SELECT l_returnflag AS reason, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS demoted, round(count(*) FILTER (WHERE l_linestatus = 'F') / count(*), 4) AS rate FROM lineitem GROUP BY 1")
def o103_demotion_rates(spark, sf_dir):
    bad = F.count_if(F.col("l_linestatus") == "F")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"), bad.alias("demoted"), aggs.ratio(bad, F.count("*")).alias("rate"))
