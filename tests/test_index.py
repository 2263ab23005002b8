"""A small repository of our own, indexed and asked."""

import subprocess

import pytest

from strandloom.plans import answers
from strandloom.sources import anchors, index, repository

FILES = {
    "settings.gradle": "rootProject.name = 'shop'\ninclude ':core', ':web'\n",
    "core/build.gradle": "plugins { id 'java' }\ndependencies {\n    implementation 'org.hibernate:hibernate-core:6.0'\n}\n",
    "web/build.gradle": "plugins { id 'java' }\ndependencies {\n    implementation project(':core')\n}\n",
    "core/src/main/java/com/acme/core/Paths.java": 'package com.acme.core;\n\npublic final class Paths {\n    public static final String ORDERS = "/v1/orders";\n}\n',
    "core/src/main/java/com/acme/core/OrderEntity.java": 'package com.acme.core;\n\nimport jakarta.persistence.Entity;\nimport jakarta.persistence.Table;\n\n@Entity\n@Table(name = "orders")\npublic class OrderEntity {\n    private long id;\n\n    public long getId() {\n        return id;\n    }\n}\n',
    "core/src/main/resources/db/V001__create_orders.sql": "CREATE TABLE orders (\n  id BIGINT PRIMARY KEY\n);\n",
    "web/src/main/java/com/acme/web/OrderResource.java": 'package com.acme.web;\n\nimport com.acme.core.OrderEntity;\nimport com.acme.core.Paths;\nimport jakarta.ws.rs.GET;\nimport jakarta.ws.rs.Path;\n\n@Path(Paths.ORDERS)\npublic class OrderResource {\n\n    @GET\n    @Path("/{id}")\n    public OrderEntity find(long id) {\n        return new OrderEntity();\n    }\n\n    public static void main(String[] args) {\n        System.out.println("starting the shop");\n    }\n}\n',
    "web/src/test/java/com/acme/web/OrderResourceTest.java": "package com.acme.web;\n\nimport com.acme.core.OrderEntity;\n\npublic class OrderResourceTest {\n    public void finds() {\n    }\n}\n",
    "web/Dockerfile": 'FROM eclipse-temurin:21\nENV SHOP_DB_URL=jdbc:none\nEXPOSE 8080\nENTRYPOINT ["java", "-jar", "web.jar"]\n',
    "tools/report.py": 'import os\nimport requests\n\nLIMIT = 10\n\n\ndef rows(db):\n    return db.execute("SELECT id FROM orders WHERE id > 3")\n\n\nif __name__ == "__main__":\n    print(os.environ["REPORT_TOKEN"], requests.get("http://shop/v1/orders/7"))\n',
    "docs/README.md": "# Shop\n\nHow orders are kept.\n",
}


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    repo = tmp_path_factory.mktemp("shop")
    for name, text in FILES.items():
        (repo / name).parent.mkdir(parents=True, exist_ok=True)
        (repo / name).write_text(text)
    git = ["git", "-C", str(repo), "-c", "user.email=a@b.c", "-c", "user.name=a"]
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    subprocess.run([*git, "add", "-A"], check=True)
    subprocess.run([*git, "commit", "-qm", "shop"], check=True)
    (repo / "untracked.txt").write_text("not in the census")
    built = index.build_index(spark, str(repo))
    return {k: v.cache() for k, v in built.items()}


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_inventory(shop):
    got = {r.path: r for r in shop["inventory"].collect()}
    assert got.keys() == FILES.keys()
    assert got["core/build.gradle"].module == "core" and got["web/src/test/java/com/acme/web/OrderResourceTest.java"].role == "test"
    assert got["docs/README.md"].role == "docs" and got["settings.gradle"].module == "(root)"
    assert got["core/src/main/resources/db/V001__create_orders.sql"].language == "sql" and got["core/src/main/resources/db/V001__create_orders.sql"].loc == 3


def test_table_routes_config(shop):
    (orders,) = answers.table(shop).collect()
    assert (orders.table, orders.owned_by, orders.migrations) == ("orders", "core", 1)
    assert orders.written_by == "com.acme.core.OrderEntity" and orders.read_by == "tools.report"
    (route,) = answers.routes(shop, "orders").collect()
    assert (route.verb, route.route, route.handler, route.resolved) == ("GET", "/v1/orders/{id}", "com.acme.web.OrderResource#find", True)
    assert rows(answers.config(shop, "DB_URL"), "key") == [("SHOP_DB_URL",)]


def test_graph_and_uses(shop):
    assert ("web", "core") in rows(shop["observed"], "src", "dst")
    assert ("web", "core") in rows(shop["declared"], "src", "dst")
    uses = {(r.fqn, r.module): r.resolved for r in shop["uses"].collect()}
    assert uses["com.acme.core.OrderEntity", "web"] == "matched" and uses["jakarta.ws.rs.GET", "web"] == "third_party"
    assert rows(answers.module(shop, "web")["depends_on"], "dst") == [("core",)]


def test_symbol_search_claims_stats(shop):
    found = answers.symbol(shop, "OrderEntity")
    assert rows(found["symbols"], "fqn") == [("com.acme.core.OrderEntity",)] and found["elided"] == 0
    assert {r.module for r in found["used_by"].collect()} == {"web"}
    assert len(answers.symbol(shop, "OrderEntity", exclude_role=["test"])["used_by"].collect()) < len(found["used_by"].collect())
    hits = answers.search(shop, "order", budget=4)
    assert hits["elided"] > 0 and sum(len(v.collect()) for k, v in hits.items() if k != "elided") == 4
    kinds = {r.kind for r in answers.claims(shop)["claims"].collect()}
    assert {"entrypoint", "data_model", "ownership", "dependency", "config", "deployable"} <= kinds
    cut = answers.claims(shop, budget=2)
    assert cut["claims"].count() == 2 and cut["elided"] == shop["claims"].count() - 2
    stats = answers.ask(shop, "stats")
    assert stats["files"] == len(FILES) and stats["routes"] == 1
    with pytest.raises(ValueError):
        answers.ask(shop, "stats", budget=3)
    assert answers.coverage(shop).first().covered == 0
    assert answers.trace(shop, "/v1/orders")["entry"] == "com.acme.web.OrderResource"
    assert answers.flow_paths(shop)[1] is False
    assert answers.unknowns(shop).count() >= 0 and answers.conflicts(shop).count() >= 0
    assert answers.file(shop, "OrderResource.java")["files"].count() == 1


def test_diff_link_levels(shop):
    changed = dict(shop)
    changed["routes"] = shop["routes"].limit(0)
    assert rows(answers.diff(shop, changed)["routes"], "route", "change") == [("/v1/orders/{id}", "removed")]
    links, lost = answers.link({"shop": shop})
    assert ("persist", "exact", True) in rows(links, "protocol", "match_kind", "self_link")
    for level in range(4):
        nodes, edges = answers.graph_level(shop, level)
        assert nodes.count() and edges.count() >= 0


def test_anchor_build_and_verify():
    lines = ["int a = 1;", "", "call(first, second);", "}", "call(first, second);", "x"]
    i = anchors.LineIndex(lines)
    assert i.hits("call(first, second);") == [3, 5]
    a = i.build(3)
    assert a and i.verify(a, 4) == ("ok", 3)
    assert i.verify("short", 1)[0] == "not_found" and i.verify("call(first, second);", 4)[0] == "ambiguous"


def test_walk_and_roots(tmp_path):
    for p in ("a/x.py", "node_modules/y.js", ".hidden/z", "b/pom.xml"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert repository.walked_files(str(tmp_path)) == ["a/x.py", "b/pom.xml"]
    assert repository.module_roots(["a/x.py", "b/pom.xml"]) == ["b"] and repository.module_roots(["a/x.py"]) == ["a"]


def test_a_refreshed_index_equals_a_full_build(spark, shop, tmp_path):
    """A changed, an added and a deleted file; only their modules are read again."""
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    old = index.build_index(spark, str(tmp_path))
    entity = "core/src/main/java/com/acme/core/OrderEntity.java"
    (tmp_path / entity).write_text(FILES[entity].replace("getId", "getNumber"))
    (tmp_path / "core/src/main/java/com/acme/core/Extra.java").write_text("package com.acme.core;\n\npublic class Extra {\n}\n")
    (tmp_path / "web/Dockerfile").unlink()
    new = index.refresh_index(spark, str(tmp_path), old, [entity, "core/src/main/java/com/acme/core/Extra.java", "web/Dockerfile"])
    whole = index.build_index(spark, str(tmp_path))
    for name in ("inventory", "facts", "symbols", "uses", "io_edges", "routes", "claims"):
        assert sorted(map(str, new[name].collect())) == sorted(map(str, whole[name].collect())), name
    assert "com.acme.core.Extra" in {r.fqn for r in new["symbols"].collect()}
    assert index.refresh_index(spark, str(tmp_path), whole, [])["inventory"].count() == whole["inventory"].count()


def test_toml_files_are_configuration_unless_manifests():
    from strandloom.sources import extractors

    keys = lambda path: [f[1] for f in extractors.extract(path, "toml", ["[db]", 'url = "x"', "# note", "pool = 3"])[1] if f[0] == "define"]
    assert keys("app/settings.toml") == ["config:url", "config:pool"] and keys("app/pyproject.toml") == []
