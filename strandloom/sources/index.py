"""The code index: relations built from a repository, and those derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import paths, text
from strandloom.operators import aggs, graph, joins, packing
from strandloom.sources import repository

TRAVERSABLE = ("call", "map", "persist", "read", "http_in", "http_out", "schedule", "event_publish", "event_subscribe", "process_boundary")
SINKS = ("persist", "http_out", "event_publish", "ssh_exec", "metric_emit")


def build_index(spark: SparkSession, repo: str, excludes: list[str] | None = None) -> dict[str, DataFrame]:
    """All relations of a repository. Facts are extracted once and written; the rest is lazy."""
    listed = repository.tracked_files(repo)
    listed = repository.walked_files(repo) if listed is None else listed
    roots = repository.module_roots(listed)
    files = repository.contents(spark, repo, listed, excludes)
    inventory = graph.cut(repository.inventory(files, roots))
    return derive(inventory, graph.cut(repository.facts(files, inventory)), roots)


def refresh_index(spark: SparkSession, repo: str, old: dict[str, DataFrame], changed: list[str], excludes: list[str] | None = None) -> dict[str, DataFrame]:
    """The index after ``changed`` files: only their modules are read and extracted again.

    ``old`` is an index with its ``inventory`` and ``facts``. Facts of a module are replaced as a whole,
    those of modules that are gone are dropped; where the modules themselves are others
    than before, everything is built anew. The result equals a full build.
    """
    listed = repository.tracked_files(repo)
    listed = repository.walked_files(repo) if listed is None else listed
    roots = repository.module_roots(listed)
    module_of = lambda path: next((r for r in sorted(roots, key=len, reverse=True) if path == r or path.startswith(r + "/")), "(root)")
    known = {r.module for r in old["inventory"].select("module").distinct().collect()}  # one row per module
    now = {module_of(p) for p in listed}
    if known != now:
        return build_index(spark, repo, excludes)
    stale = {module_of(p) for p in changed}
    files = repository.contents(spark, repo, [p for p in listed if module_of(p) in stale], excludes)
    fresh = graph.cut(repository.inventory(files, roots))
    fresh_facts = repository.facts(files, fresh)
    kept = lambda df: df.where(~F.col("module").isin(*stale)) if stale else df
    inventory = graph.cut(kept(old["inventory"]).unionByName(fresh))
    return derive(inventory, graph.cut(kept(old["facts"]).unionByName(fresh_facts)), roots)


def derive(inventory: DataFrame, facts: DataFrame, roots: list[str]) -> dict[str, DataFrame]:
    pick = lambda tag: facts.where(F.col("tag") == tag)
    role = inventory.select("path", "role")
    defines = pick("define").select(F.col("name").alias("fqn"), "kind", "visibility", "value", F.col("path").alias("file"), "module", "line", "anchor").join(role.withColumnRenamed("path", "file"), "file")
    uses = pick("use").select(F.col("name").alias("fqn"), F.col("path").alias("file"), "module", "line", "anchor", "primary").dropDuplicates(["fqn", "file"])
    edges = pick("io_edge").select(F.col("name").alias("source"), "target", "channel", F.col("path").alias("file"), "module", "line", "anchor")
    imports = pick("import").select(F.col("name").alias("fqn"), F.col("path").alias("file"), "module", "line")
    sites = defines.select("fqn", "module", "role").distinct()
    namespaces = pick("file").where("package <> ''").select(F.col("package").alias("prefix"), F.col("module").alias("owner")).distinct()
    owners = defines.select(F.col("fqn").alias("prefix"), F.col("module").alias("owner"), F.lit(0).alias("rank")).unionByName(namespaces.withColumn("rank", F.lit(1))).distinct()
    resolved = joins.resolve_uses(uses, sites)
    # what no symbol explains may still lie in a known namespace
    prefixed = joins.prefix_owner(resolved.where("resolved = 'unresolved'"), owners, "fqn", "prefix", "owner", "rank").drop("prefix")
    rescued = prefixed.withColumn("resolved", F.when(F.col("owner").isNull(), F.col("resolved")).when(F.col("owner") == F.col("module"), "local").otherwise("matched")).drop("owner")
    resolved = resolved.where("resolved <> 'unresolved'").unionByName(rescued)
    owned = joins.prefix_owner(imports.select("fqn").distinct(), owners, "fqn", "prefix", "owner", "rank").where("owner IS NOT NULL").select("fqn", "owner")
    observed = joins.observed_edges(imports, owned, "fqn", "module", "owner", "file", "line").withColumnsRenamed({"module": "src", "owner": "dst"})
    modules = inventory.select("module").distinct()
    declared, ambiguous = joins.declared_edges(pick("dep").select("module", F.col("name").alias("dep")).distinct(), modules, "module", "dep", "module")
    declared = declared.withColumnsRenamed({"module": "src", "to": "dst"})
    constants = aggs.constants(defines.where("kind = 'constant' AND value IS NOT NULL").withColumn("short", F.array_join(F.slice(F.split("fqn", r"\."), -2, 2), ".")).where(F.size(F.split("fqn", r"\.")) >= 2), "short", "value")
    raw = edges.where("channel = 'http_in' AND target LIKE 'route:%'")
    routed = joins.substitute(raw, constants, "target", "short", "value")
    verb = F.regexp_extract("resolved", "^route:([A-Z]+) ", 1)
    routes = routed.select(F.when(verb == "", "ANY").otherwise(verb).alias("verb"), F.regexp_replace("resolved", "^route:([A-Z]+ )?", "").alias("route"), F.col("source").alias("handler"), "module", "file", "line", "missing")
    flow = joins.first_by(edges.select("source", "target", "channel", "file", "line", "module"), ["source", "target", "channel"], ["file", "line"])
    calls = resolved.where("resolved IN ('local', 'matched') AND primary IS NOT NULL AND fqn <> primary AND NOT endswith(fqn, '.*')").select(F.col("primary").alias("source"), F.col("fqn").alias("target"), F.lit("call").alias("channel"), "file", "line", "module")
    flow = flow.unionByName(joins.first_by(calls, ["source", "target", "channel"], ["file", "line"]))
    scopes = packing.partition(inventory.where("NOT binary"), "module", "path", "loc")
    index = {"inventory": inventory, "facts": facts, "defines": defines, "uses": resolved, "io_edges": edges, "imports": imports, "notes": pick("note").select("path", "module", F.col("name").alias("note"), "line"), "modules": modules, "observed": observed, "declared": declared, "declared_ambiguous": ambiguous, "constants": constants, "routes": routes, "flow": flow, "scopes": scopes}
    index["symbols"] = aggs.symbol_table(defines.withColumn("at", text.cite(F.col("file"), F.col("line"))), "fqn", "at", {"kind": "kind", "visibility": "visibility"}, {"value": "value"}, "module", "at")
    index["claims"] = claims(index)
    return index


def _claim(df: DataFrame, subject, kind: str, channel, confidence, statement, parts) -> DataFrame:
    cited = text.cite(F.col("file"), F.col("line"))
    return df.select(text.claim_id(*parts).alias("id"), subject.alias("subject"), F.lit(kind).alias("kind"), channel.alias("channel"), F.lit(confidence).alias("confidence"), text.truncate(statement, 500).alias("statement"), "module", "file", "line", cited.alias("evidence"))


def claims(index: dict[str, DataFrame]) -> DataFrame:
    """Claims that follow from structure alone, one per id, each with its first evidence."""
    io, routes = index["io_edges"], index["routes"]
    c, s, t = F.col("channel"), F.col("source"), F.col("target")
    say = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    name = F.concat(F.lit("route:"), F.col("verb"), F.lit(" "), F.col("route"))
    known, open_ = routes.where(F.size("missing") == 0), routes.where(F.size("missing") > 0)
    channel = lambda v: F.lit(v)
    parts = [
        _claim(known, name, "entrypoint", channel("http_in"), "high", say(F.col("handler"), " serves ", F.col("verb"), " ", F.col("route")), [F.lit("entrypoint"), F.lit("route"), F.col("verb"), F.col("route")]),
        _claim(open_, name, "entrypoint", channel("http_in"), "low", say(F.col("handler"), " serves a route whose constants have no one value"), [F.lit("entrypoint"), F.lit("route_unresolved"), F.col("verb"), F.col("route")]),
        _claim(io.where((c == "process_boundary") & t.startswith("process:") & (s != F.col("module"))), s, "entrypoint", c, "high", say(s, " is the entry point of ", t), [F.lit("entrypoint"), F.lit("main"), s]),
        _claim(io.where((c == "schedule") & (t == "scheduler")), s, "entrypoint", c, "high", say(s, " runs as a scheduled job"), [F.lit("entrypoint"), F.lit("schedule"), s]),
        _claim(index["defines"].where("kind = 'config_key' AND fqn LIKE 'process:%' AND value IS NOT NULL"), F.col("fqn"), "deployable", channel("process_boundary"), "high", say(F.col("fqn"), " is started with ", F.col("value")), [F.lit("deployable"), F.col("fqn")]),
        _claim(io.where((c == "persist") & t.startswith("table:")), t, "data_model", c, "high", say(s, " writes ", t), [F.lit("data_model"), F.lit("entity"), t]),
        _claim(io.where((c == "persist") & t.startswith("entity:")), t, "data_model", c, "medium", say(s, " persists ", t), [F.lit("data_model"), F.lit("repository"), s, t]),
        _claim(io.where(c == "map"), say(s, " -> ", t), "data_model", c, "high", say(s, " is mapped to ", t), [F.lit("data_model"), F.lit("map"), s, t]),
        _claim(io.where(c == "schema_own"), t, "ownership", c, "high", say(t, " is owned by module ", F.col("module")), [F.lit("ownership"), F.lit("schema"), t]),
        _claim(io.where(c.isin("ssh_exec", "http_out", "metric_emit", "read")), say(F.col("module"), ":", c), "side_effect", c, "high", say("module ", F.col("module"), " has the side effect ", c), [F.lit("side_effect"), F.col("module"), c]),
        _claim(io.where((c == "config_read") & t.startswith("config:") & ~s.startswith("config-file:")), t, "config", c, "high", say(s, " reads ", t), [F.lit("config"), t]),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    declared = index["declared"].withColumn("_d", F.lit(True))
    seen = index["observed"].join(declared, ["src", "dst"], "left")
    first = F.split(F.substring_index("examples", ",", 1), ":(?=[0-9]+$)")
    dep = seen.select(text.claim_id(F.lit("dependency"), F.lit("observed"), F.col("src"), F.col("dst")).alias("id"), say(F.col("src"), " -> ", F.col("dst")).alias("subject"), F.lit("dependency").alias("kind"), F.lit(None).cast("string").alias("channel"), F.when(F.col("_d"), "high").otherwise("medium").alias("confidence"), say(F.col("src"), " imports from ", F.col("dst"), F.when(F.col("_d"), "").otherwise(", which it does not declare")).alias("statement"), F.col("src").alias("module"), first[0].alias("file"), first[1].cast("int").alias("line"), F.substring_index("examples", ",", 1).alias("evidence"))
    every = every.unionByName(dep)
    return joins.first_by(every, ["id", "subject", "kind"], ["file", "line", "statement"])
