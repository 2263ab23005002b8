"""Literal cases of operators and expressions."""

from pyspark.sql import functions as F

from strandloom.functions import hashing, paths, text
from strandloom.operators import aggs, graph, joins, packing, quality, ranking, setops
from strandloom.sources import catalog
from strandloom.sources.extractors import extract
from strandloom.streaming import state


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_text_functions(spark):
    assert one(spark, text.normalise_ws, " a  b\x1fc \n") == "a b c"
    assert one(spark, text.lines_of, "a\r\nb c\n") == ["a", "b", "c"]
    assert one(spark, text.lines_of, "") == []
    assert one(spark, lambda x: text.truncate(x, 5), " abcdefgh ") == "abcd…"
    assert one(spark, text.slug, "--A b/C!") == "a_b_c" and one(spark, text.slug, "!!") == "x"
    assert one(spark, text.short_name, "p/q.A.b#m") == "b#m" and one(spark, text.short_name, "A") == "A"
    assert one(spark, text.node_type, "table:x") == "table" and one(spark, text.node_type, "a.b") is None
    assert one(spark, text.display_label, "a.b.c") == "b.c" and one(spark, text.display_label, "route:GET /x.y") == "GET /x.y"
    assert one(spark, lambda x: text.link_key(F.lit("http_in"), x), "route:GET /a/{id}/b") == "/a/*/b"
    assert one(spark, lambda x: text.link_key(F.lit("http_out"), x), "http:https://h/a/:id/b") == "/a/*/b"
    assert one(spark, lambda x: text.link_key(F.lit("persist"), x), "table:Orders") == "table:orders"
    assert one(spark, lambda x: text.join_route(F.lit("/a/"), x), "/b") == "/a/b" and one(spark, lambda x: text.join_route(x, F.lit(None)), "") == "/"
    assert one(spark, text.remote_name, "git@host.org:team/repo.git") == one(spark, text.remote_name, "https://host.org/team/repo/")
    assert [one(spark, lambda x, n=n: text.power_of_two(F.lit(n)), "") for n in (0, 1, 2, 3, 8, 9)] == [1, 1, 2, 4, 8, 16]
    assert one(spark, text.sql_tables_written, "INSERT INTO a; update b set x=1") == ["a", "b"]
    assert one(spark, text.schema_name, "9 A-b") == "_9_a_b"


def test_path_functions(spark):
    role = {p: one(spark, paths.role, p) for p in ("src/test/A.java", "a/b_test.go", ".github/x.yml", "db/x.sql", "a.png", "README.md", "A.java", "conf/a.yml", "pom.xml")}
    assert list(role.values()) == ["test", "test", "ci", "schema", "asset", "docs", "source", "config", "build"]
    assert one(spark, lambda x: paths.has_segment(x, ["build"]), "a/build/c") and not one(spark, lambda x: paths.has_segment(x, ["build"]), "a/builder/c")
    assert one(spark, paths.prefixes, "a.b/c") == ["a.b/c", "a.b", "a"]
    assert one(spark, lambda x: paths.rollup(x, 1), "a/b/c.py") == "a" and one(spark, lambda x: paths.rollup(x, 1), "c.py") == "(root)"
    assert one(spark, paths.is_binary, "a/x.JAR") and not one(spark, paths.is_binary, "a/x")
    assert one(spark, paths.looks_third_party, "lodash") and one(spark, paths.looks_third_party, "java.util.List") and not one(spark, paths.looks_third_party, "com.acme.X")


def test_conflicts_do_not_depend_on_order(spark):
    rows = [("s", "k", "a", "m1", "x1", "t"), ("s", "k", "b", "m2", "x2", "t"), ("s", "k", "b", "m2", "x3", "t"), ("u", "k", None, "m1", "x", "p"), ("u", "k", None, "m2", "y", "q"), ("c", "k", "a", "m", "x", "t"), ("c", "k", None, "m", "y", "t")]
    owners = spark.createDataFrame([("s", "m1")], "subject string, module string")

    def run(r):
        df = spark.createDataFrame(r, "subject string, kind string, sig string, module string, anchor string, statement string")
        return sorted(map(str, aggs.conflict_merge(df, owners, "subject", "kind", "sig", "module", "anchor", "statement").collect()))

    assert run(rows) == run(rows[::-1])
    by = {r.split("'")[1]: r for r in run(rows)}
    assert "ownership" in by["s"] and "winner='a'" in by["s"] and "near_miss=True" in by["u"] and "contested" in by["c"]


def test_budget_and_fair_split():
    assert ranking.fair_split(10, [1, 20, 3]) == [1, 6, 3]
    assert ranking.fair_split(0, [3]) == [0] and ranking.fair_split(9, [2, 2]) == [2, 2] and sum(ranking.fair_split(7, [9, 9, 9])) == 7


def test_search_tiers(spark):
    df = spark.createDataFrame([(x,) for x in ("id", "a.id", "AddImportJobId", "identity", "x_idle", "widget", "none")], "t string")
    assert {r.t: r.tier for r in ranking.search(df, "t", "ID").collect()} == {"id": 0, "a.id": 1, "AddImportJobId": 2, "identity": 3, "x_idle": 3, "widget": 4}


def test_graph_operators(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "x")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdxz"], "node string")
    assert {tuple(r) for r in graph.scc(e).collect()} == {("b", "b"), ("c", "b")}
    assert {tuple(r) for r in graph.layers(nodes, e).collect()} == {("a", 2), ("b", 1), ("c", 1), ("d", 0), ("x", 0), ("z", 0)}
    assert {("a", "d"), ("b", "b")} <= {tuple(r) for r in graph.closure(e).collect()}
    seen, more = graph.bfs(e, "a", most=2)
    assert {(r.node, r.depth) for r in seen.collect()} == {("a", 0), ("b", 1), ("c", 2)} and more
    found, cut = graph.enumerate_paths(e, nodes.where("node = 'a'"), nodes.where("node IN ('c', 'd')"), most_paths=1)
    assert cut and [r.path for r in found.collect()] == [["a", "b", "c"]]
    assert graph.focus(nodes, e, nodes.limit(0))[0].count() == 6


def test_joins(spark):
    a = spark.createDataFrame([("k", None), ("k", "c")], "s string, ch string")
    b = spark.createDataFrame([("k", None, 1), ("z", "c", 2)], "s string, ch string, id int")
    assert {(r.ch, r.id) for r in joins.null_safe(a, b, ["s", "ch"]).collect()} == {(None, 1), ("c", None)}
    declared = spark.createDataFrame([("web", "core"), ("web", "lib/core"), ("web", "util"), ("web", "gone")], "m string, dep string")
    modules = spark.createDataFrame([("core",), ("lib/core",), ("a/util",), ("b/util",), ("web",)], "m string")
    edges, ambiguous = joins.declared_edges(declared, modules, "m", "dep", "m")
    assert {tuple(r) for r in edges.collect()} == {("web", "core"), ("web", "lib/core")}
    assert [r.candidates for r in ambiguous.collect()] == [["a/util", "b/util"]]
    old = spark.createDataFrame([("a", 1)], "k string, v int")
    assert [r.k for r in setops.changed(old, spark.createDataFrame([("a", 1), ("b", None)], "k string, v int"), "k", "v").collect()] == ["b"]
    log = spark.createDataFrame([(1, "r1"), (2, "r2"), (3, "r3"), (4, "r1")], "seq int, run string")
    assert setops.exclude_runs(log, "run", "seq", since="r2").count() == 1 and setops.exclude_runs(log, "run", "seq", exact=["r1"]).count() == 2


def test_packing_is_greedy_and_keeps_all():
    unit = lambda n, f, loc: {"module": "m", "node": n, "n_files": f, "loc": loc, "oversized": False, "files": [f"{n}{i}" for i in range(f)]}
    joined = packing.join_up([unit("m/a/x", 1, 10), unit("m/a/y", 2, 10), unit("m/b", 30, 10)], 10, 100)
    assert sorted(u["node"] for u in joined) == ["m/a", "m/b"]
    fitted = packing.first_fit([unit("m/a", 2, 10), unit("m/b", 2, 20), unit("m/c", 9, 10)], 10, 100)
    assert sorted(u["node"] for u in fitted) == ["m/(a+1)", "m/c"]


def test_freshness_and_demotion(spark):
    ev = spark.createDataFrame([("c1", "f", "x"), ("c2", "g", "x"), ("c3", "h", "x"), ("c4", "f", None)], "claim string, file string, reviewed string")
    churn = spark.createDataFrame([("f", False), ("g", True)], "file string, churned boolean")
    got = {r.claim: r.freshness for r in quality.freshness(ev, churn, "claim", "file", "reviewed").collect()}
    assert got == {"c1": "live", "c2": "stale", "c3": "unknown_churn", "c4": "anchored_unreviewed"}
    v = spark.createDataFrame([("a", "ok"), ("a", "not_found"), ("b", "ok")], "claim string, verdict string")
    assert {r.claim: r.stands for r in quality.demotion(v, "claim", "verdict").collect()} == {"a": False, "b": True}
    assert quality.demotion(v, "claim", "verdict", strict=False).where("stands").count() == 2


def test_hashes(spark):
    df = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "b"), ("h", "a")], "g string, x string")
    assert df.groupBy("g").agg(hashing.set_hash(F.col("x")).alias("s")).select("s").distinct().count() == 1
    assert one(spark, lambda x: hashing.anonymous("n", F.when(x == "a", x)), "b") is None


def test_extractors():
    def names(path, lang, code, tag):
        return {(f[1], f[5], f[6]) if tag == "io_edge" else f[1] for f in extract(path, lang, code.splitlines())[1] if f[0] == tag}

    go = 'package main\n\nimport (\n\t"net/http"\n)\n\nfunc main() {\n\thttp.HandleFunc("/ping", ping)\n\tos.Getenv("TOKEN")\n}\n'
    assert {("cmd", "route:ANY /ping", "http_in"), ("cmd", "config:TOKEN", "config_read"), ("cmd", "process:cmd", "process_boundary")} <= names("cmd/main.go", "go", go, "io_edge")
    ts = "import express from 'express'\nimport x from './lib/x'\nexport class A {}\napp.get('/users/:id', h)\nconst k = process.env.KEY\n"
    assert {"web/A.js".replace("A.js", "main.A")} & names("web/main.ts", "typescript", ts, "define") and "web/lib/x" in names("web/main.ts", "typescript", ts, "import")
    assert ("web/main", "route:GET /users/:id", "http_in") in names("web/main.ts", "typescript", ts, "io_edge")
    cs = 'using Microsoft.AspNetCore.Mvc;\nnamespace Shop.Web;\n[Route("api/[controller]")]\npublic class OrdersController\n{\n    [HttpGet("{id}")]\n    public Order Find(int id)\n    {\n    }\n}\n'
    assert ("Shop.Web.OrdersController#Find", "route:GET /api/orders/{id}", "http_in") in names("Orders.cs", "csharp", cs, "io_edge")
    scala = "package a.b\nimport c.{D, E => F}\ncase class Order(id: Long)\nobject Main extends App\n"
    assert {"a.b.Order", "a.b.Main"} <= names("M.scala", "scala", scala, "define") and {"c.D", "c.E"} == names("M.scala", "scala", scala, "import")
    assert {"config:db.url", "config:db.pool.size"} <= names("a.yml", "yaml", "db:\n  url: x\n  pool:\n    size: 3\n", "define")
    assert names("pom.xml", "maven", "<artifactId>me</artifactId>\n<artifactId>dep</artifactId>\n", "dep") == {"dep"}
    assert names("package.json", "npm", '{"name": "n", "dependencies": {"a": "1"}}', "dep") == {"a"}
    assert any(f[0] == "note" for f in extract("bad.py", "python", ["def ("])[1])
    assert any("extractor_error" in (f[1] or "") for f in extract("x.java", "java", [None])[1])


def test_catalog(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "lake"))
    assert c.latest() is None
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    c.save("s1", {"files": df}, 1)
    c.save("s2", {"files": df.limit(1)}, 2)
    assert c.latest() == "s2" and c.load("files").count() == 1 and c.load("files", "s1").count() == 2
    assert c.append_log(df, ["id", "name"]) == 2 and c.append_log(df.unionByName(spark.createDataFrame([(3, "c")], "id int, name string")), ["id", "name"]) == 1
    assert sorted(r.seq for r in c.log().collect()) == [1, 2, 3]
    catalog.export_anonymized(df, str(tmp_path / "out"), {"name": "n"}, ["id"])
    assert {r.name[:2] for r in spark.read.json(str(tmp_path / "out")).collect()} == {"n_"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"id": 1}')
    (tmp_path / "in/b.json").write_text("{oops")
    inbox = catalog.read_inbox(spark, str(tmp_path / "in"), "id int").collect()
    assert sorted(str(r.id) for r in inbox) == ["1", "None"] and sum(r._corrupt is not None for r in inbox) == 1


def test_streams(spark, tmp_path):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "x"), (5, "a", "x")]
    df = spark.createDataFrame(rows, "seq int, key string, state string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    state.drain(state.emit_on_change(stream, "key", "state", ["seq"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 4, 5]
    query = state.newest(stream, "key", ["seq"], "state").writeStream.format("memory").queryName("newest").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.key, r.state, r.entries) for r in spark.table("newest").collect()} == {("a", "x", 4), ("b", "x", 1)}
    state.drain(state.once(stream, ["key", "state"]), str(tmp_path / "once"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 3


def test_pairs_of_one_hot_key_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    left = spark.range(700).selectExpr("CASE WHEN id < 600 THEN 'hot' WHEN id < 690 THEN 'k' || id % 9 END AS key", "id % 500 AS a")
    right = spark.range(500).selectExpr("CASE WHEN id < 400 THEN 'hot' ELSE 'k' || id % 12 END AS key", "id AS b")
    want = sorted(map(tuple, left.join(right, "key").collect()))
    for most in (40_000, 0):
        met = joins.meet_evenly(left, right, "key", cell_rows=50, task_pairs=10_000, broadcast_keys=most)
        assert sorted(map(tuple, met.collect())) == want
        per = [r[1] for r in met.where("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per) == 240_000 and max(per) < 60_000
    assert joins.meet_evenly(left, right.limit(0), "key").count() == 0


def test_split_fairly_equals_the_plain_rule(spark):
    for limit, demands in [(0, [3, 4]), (7, [9, 9, 9]), (10, [1, 20, 3]), (9, [2, 2]), (5, [0, 0, 8, 8]), (11, [4, 4, 4, 1])]:
        lists = spark.createDataFrame(list(enumerate(demands)), "k int, demand long")
        got = [r.given for r in ranking.split_fairly(lists, "demand", "k", limit).orderBy("k").collect()]
        assert got == ranking.fair_split(limit, demands)


def test_one_demand_beyond_the_limit_gets_the_limit(spark):
    for limit, demands in [(5, [8]), (5, [0, 8, 0]), (5, [-3, 9]), (-1, [3, 4]), (0, [0, 2])]:
        lists = spark.createDataFrame(list(enumerate(demands)), "k int, demand long")
        got = [r.given for r in ranking.split_fairly(lists, "demand", "k", limit).orderBy("k").collect()]
        assert got == ranking.fair_split(limit, demands)


def test_numbers_go_on_over_many_tasks(spark):
    fresh = spark.range(1000).selectExpr("1000 - id AS x").repartition(7)
    got = ranking.next_in_sequence(spark.createDataFrame([(41,), (7,)], "seq long"), fresh, "seq", ["x"])
    assert sorted((r.x, r.seq) for r in got.collect()) == [(k, 41 + k) for k in range(1, 1001)]
    assert ranking.next_in_sequence(spark.createDataFrame([], "seq long"), fresh.limit(0), "seq", ["x"]).count() == 0


def test_components_of_long_and_joined_cycles(spark):
    ring = [(k, (k + 1) % 9) for k in range(9)]
    joined = [(20, 21), (21, 20), (21, 22), (22, 23), (23, 22), (23, 24), (8, 20), (24, 24), (30, 31), (31, 32)]
    edges = spark.createDataFrame(ring + joined, "src int, dst int")
    want = {(k, 0) for k in range(9)} | {(20, 20), (21, 20), (22, 22), (23, 22)}
    assert {tuple(r) for r in graph.scc(edges).collect()} == want
    assert graph.scc(edges.limit(0)).count() == 0


def test_paths_tell_when_hops_run_out(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)], "src int, dst int")
    ends = lambda k: spark.createDataFrame([(k,)], "n int")
    found, cut = graph.enumerate_paths(edges, ends(0), ends(3), most_hops=3)
    assert [r.hops for r in found.collect()] == [3] and cut
    found, cut = graph.enumerate_paths(edges, ends(0), ends(6), most_hops=8)
    assert [r.hops for r in found.collect()] == [6] and not cut
