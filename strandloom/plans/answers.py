"""The fixed questions over a code index. Each returns a DataFrame, or a dict of them.

Substrings match without regard to case and no character is a wildcard. Lists come
ordered; ``budget`` keeps that many rows in all and ``elided`` counts the rest, so that
a cut answer never looks like a whole one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import paths, text
from strandloom.operators import aggs, graph, joins, ranking, setops

DEFAULT_BUDGET = 200
UNBUDGETED = ("stats", "coverage")


class Budget:
    """One row allowance over the lists of an answer, in order."""

    def __init__(self, rows: int | None = None):
        self.left = DEFAULT_BUDGET if rows is None else max(0, rows)
        self.elided = 0

    def take(self, rows: DataFrame, rank: list, order: list) -> DataFrame:
        """The best rows that still fit, in the list's own order."""
        n = rows.count()
        kept, self.left = min(n, self.left), max(0, self.left - n)
        self.elided += n - kept
        return (rows if kept == n else rows.orderBy(*rank).limit(kept)).orderBy(*order)


def _without(df: DataFrame, index, exclude_role, file="file") -> DataFrame:
    return joins.exclude_role(df, index["inventory"].select(F.col("path").alias(file), "role"), file, exclude_role) if exclude_role else df


def symbol(index, name: str, budget: int | None = None, exclude_role=None) -> dict:
    b, s = Budget(budget), index["symbols"]
    last = F.substring_index(F.col("fqn"), ".", -1)
    exact = s.where((F.col("fqn") == name) | (last == name))
    found = exact if not exact.isEmpty() else s.where(text.contains_ci(F.col("fqn"), name))
    order = [(last != name), F.char_length("fqn"), F.col("fqn")]
    found = b.take(found, [F.col("fqn")], order)
    sites = _without(index["defines"], index, exclude_role).join(found.select("fqn"), "fqn", "left_semi")
    used = _without(index["uses"].where("resolved IN ('local', 'matched', 'ambiguous')"), index, exclude_role).join(found.select("fqn"), "fqn", "left_semi")
    short = found.select(F.col("fqn"), last.alias("short"))
    touching = index["claims"].join(short.select(F.col("fqn").alias("subject")), "subject", "left_semi")
    return {"symbols": found, "defined_at": sites.select("fqn", "kind", "visibility", text.cite(F.col("file"), F.col("line")).alias("at")), "used_by": used.select("fqn", "module", text.cite(F.col("file"), F.col("line")).alias("at")), "claims": touching, "elided": b.elided}


def file(index, path: str, budget: int | None = None) -> dict:
    b = Budget(budget)
    found = b.take(index["inventory"].where(text.contains_ci(F.col("path"), path)), [F.col("path")], [(F.col("path") != path), F.char_length("path"), F.col("path")])
    names = found.select(F.col("path").alias("file"))
    scope = index["scopes"].select("node", F.explode("files").alias("file")).join(names, "file", "left_semi")
    return {"files": found, "scopes": scope, "defines": index["defines"].join(names, "file", "left_semi"), "edges": index["io_edges"].join(names, "file", "left_semi"), "claims": index["claims"].join(names, "file", "left_semi"), "elided": b.elided}


def module(index, name: str) -> dict:
    hit = lambda c: text.contains_ci(F.col(c), name)
    return {
        "modules": index["inventory"].where(hit("module")).groupBy("module").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")),
        "depends_on": index["observed"].where(hit("src")),
        "depended_by": index["observed"].where(hit("dst")),
        "divergence": graph.divergence(index["declared"], index["observed"], ["src", "dst"]).where(hit("src")),
        "scopes": index["scopes"].where(hit("module")).drop("files"),
        "claims_by_kind": aggs.tally(index["claims"].where(hit("module")), "kind"),
    }


def routes(index, pattern: str = "", exclude_role=None) -> DataFrame:
    r = index["routes"].where(text.contains_ci(F.col("route"), pattern) | text.contains_ci(F.col("verb"), pattern))
    return _without(r, index, exclude_role).select("verb", "route", "handler", "module", text.cite(F.col("file"), F.col("line")).alias("at"), (F.size("missing") == 0).alias("resolved")).orderBy("route", "verb", "at")


def table(index, name: str = "", exclude_role=None) -> DataFrame:
    edges = _without(index["io_edges"].where("target LIKE 'table:%'"), index, exclude_role).withColumn("table", F.regexp_replace("target", "^table:", "")).where(text.contains_ci(F.col("table"), name))
    owner = F.when(F.col("channel") == "schema_own", F.col("module"))
    each = edges.groupBy("table").agg(aggs.joined(aggs.distinct_sorted(owner)).alias("owned_by"), F.count(owner).alias("migrations"), *[aggs.joined(aggs.distinct_sorted(F.when(F.col("channel") == c, F.col("source")))).alias(n) for c, n in (("persist", "written_by"), ("read", "read_by"))])
    return each.orderBy("table")


def config(index, key: str = "", exclude_role=None) -> DataFrame:
    declared = index["defines"].where("fqn LIKE 'config:%'").select(F.regexp_replace("fqn", "^config:", "").alias("key"), "file", "line", "value", F.lit("declared").alias("how"))
    read = index["io_edges"].where("channel = 'config_read' AND source NOT LIKE 'config-file:%'").select(F.regexp_replace("target", "^config:", "").alias("key"), "file", "line", F.lit(None).cast("string").alias("value"), F.lit("read").alias("how"))
    both = _without(declared.unionByName(read), index, exclude_role).where(text.contains_ci(F.col("key"), key))
    at = text.cite(F.col("file"), F.col("line"))
    return both.groupBy("key").agg(*[aggs.joined(aggs.distinct_sorted(F.when(F.col("how") == h, at))).alias(n) for h, n in (("declared", "declared_at"), ("read", "read_at"))], aggs.joined(aggs.distinct_sorted(F.col("value"))).alias("values")).orderBy("key")


def _sources(index) -> DataFrame:
    return index["flow"].where("channel IN ('http_in', 'schedule', 'process_boundary', 'event_subscribe') AND NOT startswith(target, 'library:')").select("source").distinct()


def flow_paths(index, source: str = "", sink: str = "", most_hops: int = 8, most_paths: int = 2000) -> tuple[DataFrame, bool]:
    from strandloom.sources.index import SINKS, TRAVERSABLE

    edges = index["flow"].where(F.col("channel").isin(*TRAVERSABLE) & ~F.col("target").startswith("library:"))
    sinks = edges.where(F.col("channel").isin(*SINKS)).select("target")
    found, cut = graph.enumerate_paths(edges, _sources(index), sinks, "source", "target", most_hops, most_paths)
    best = graph.shortest_per_pair(found)
    return best.where(text.contains_ci(F.col("source"), source) & text.contains_ci(F.col("sink"), sink)), cut


def trace(index, entry: str, most_hops: int = 8) -> dict:
    """Nodes reached from an entry (a route, a flow source or a symbol), and the files on the way."""
    flow = index["flow"]
    candidates = (
        index["routes"].where(text.contains_ci(F.col("route"), entry)).select(F.lit(0).alias("rank"), F.col("handler").alias("node"))
        .unionByName(flow.where(text.contains_ci(F.col("source"), entry)).select(F.lit(1).alias("rank"), F.col("source").alias("node")))
        .unionByName(index["symbols"].where(text.contains_ci(F.col("fqn"), entry)).select(F.lit(2).alias("rank"), F.col("fqn").alias("node")))
    )
    start = candidates.orderBy("rank", F.char_length("node"), "node").first()
    if start is None:
        return {"entry": None, "nodes": None, "files": None, "hops_exhausted": False}
    node = start.node
    owner = node.split("#")[0]
    if owner != node and not flow.where(F.col("source") == owner).isEmpty():
        node = owner  # calls and imports hang off the type that holds a method
    reached, more = graph.bfs(flow.where(F.col("channel") != "library"), node, "source", "target", most_hops, ["channel", "file", "line"])
    at = flow.select(F.col("target").alias("node"), "file").unionByName(index["defines"].select(F.col("fqn").alias("node"), "file"))
    files = reached.join(at, "node").groupBy("file").agg(F.min("depth").alias("depth"), F.min_by("node", F.struct("depth", "node")).alias("reason"))
    return {"entry": node, "nodes": reached.orderBy("depth", "node"), "files": files.orderBy("depth", "file"), "hops_exhausted": more}


def search(index, needle: str, budget: int | None = None) -> dict:
    """Symbols, files, claims and unresolved names that contain a text, with a fair share of the budget each."""
    lists = {"claims": index["claims"].select(F.col("subject").alias("text")), "symbols": index["symbols"].select(F.col("fqn").alias("text")), "unresolved": index["uses"].where("resolved = 'unresolved'").select(F.col("fqn").alias("text")), "files": index["inventory"].select(F.col("path").alias("text"))}
    found = {k: ranking.search(v.distinct(), "text", needle) for k, v in lists.items()}
    sizes = {k: v.count() for k, v in found.items()}
    share = dict(zip(found, ranking.fair_split(DEFAULT_BUDGET if budget is None else budget, list(sizes.values()))))
    return {k: v.orderBy("tier", "length", "text").limit(share[k]) for k, v in found.items()} | {"elided": sum(sizes.values()) - sum(share.values())}


def claims(index, kind: str | None = None, in_module: str | None = None, subject: str | None = None, budget: int | None = None, exclude_role=None) -> dict:
    b, c = Budget(budget), _without(index["claims"], index, exclude_role)
    if kind:
        c = c.where(F.col("kind") == kind)
    if in_module:
        c = c.where(F.col("module") == in_module)
    if subject:
        c = c.where(text.contains_ci(F.col("subject"), subject))
    return {"claims": b.take(c, [F.col("subject"), F.col("id")], [F.col("kind"), F.col("subject"), F.col("id")]), "elided": b.elided}


def unknowns(index) -> DataFrame:
    """What structure leaves open: ambiguous dependencies, unresolved routes, notes of extractors."""
    ambiguous = index["declared_ambiguous"].select(F.col("module").alias("source_node"), F.concat(F.lit("which module is "), "dep").alias("question"), F.lit("needs_human").alias("needs"))
    open_routes = index["routes"].where(F.size("missing") > 0).select(F.col("module").alias("source_node"), F.concat(F.lit("what is "), F.array_join("missing", ", ")).alias("question"), F.lit("needs_wider_scope").alias("needs"))
    notes = index["notes"].where("note LIKE 'extractor_error%' OR note LIKE 'syntax:%'").select(F.col("module").alias("source_node"), F.concat(F.lit("what is in "), "path").alias("question"), F.lit("needs_human").alias("needs"))
    return ambiguous.unionByName(open_routes).unionByName(notes).orderBy("source_node", "question")


def conflicts(index) -> DataFrame:
    return aggs.collisions(index["defines"], "fqn", "module")


def stats(index) -> dict:
    inv = index["inventory"]
    one = lambda df: df.count()
    return {"files": one(inv), "modules": one(index["modules"]), "scopes": one(index["scopes"]), "symbols": one(index["symbols"]), "routes": one(index["routes"]), "claims": one(index["claims"]), "declared": one(index["declared"]), "observed": one(index["observed"]), "by_language": aggs.tally(inv, "language"), "by_role": aggs.tally(inv, "role"), "claims_by_kind": aggs.tally(index["claims"], "kind"), "resolution": aggs.tally(index["uses"], "resolved")}


def coverage(index, complete: DataFrame | None = None) -> DataFrame:
    """Files in scopes that have been looked at, of all files in scopes."""
    scopes = index["scopes"]
    done = scopes.join(complete.select("node").distinct().withColumn("_done", F.lit(True)), "node", "left") if complete is not None else scopes.withColumn("_done", F.lit(None).cast("boolean"))
    seen = F.sum(F.when(F.col("_done"), F.col("n_files")).otherwise(0))
    return done.agg(seen.alias("covered"), F.sum("n_files").alias("total"), aggs.ratio(seen, F.sum("n_files")).alias("ratio"))


QUERIES = {"symbol": symbol, "file": file, "module": module, "routes": routes, "table": table, "config": config, "paths": flow_paths, "trace": trace, "search": search, "claims": claims, "unknowns": unknowns, "conflicts": conflicts, "stats": stats, "coverage": coverage}


def ask(index, kind: str, *args, **options):
    """One of the 14 questions by name."""
    if kind not in QUERIES:
        raise ValueError(f"{kind} is none of {', '.join(QUERIES)}")
    if kind in UNBUDGETED and options.keys() & {"budget", "exclude_role"}:
        raise ValueError(f"{kind} takes neither a budget nor roles")
    return QUERIES[kind](index, *args, **options)


def diff(old, new) -> dict[str, DataFrame]:
    """What two indexes have added and removed, relation by relation."""
    keys = {"modules": ["module"], "declared": ["src", "dst"], "observed": ["src", "dst"], "routes": ["verb", "route"], "claims": ["id"], "symbols": ["fqn"]}
    return {n: setops.snapshot_diff(old[n], new[n], k) for n, k in keys.items()}


def link(indexes: dict[str, dict[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(links, unmatched) over the indexes of several repositories, by channel pair."""
    every = None
    for name, index in indexes.items():
        e = index["io_edges"].where("NOT startswith(target, 'library:')").withColumn("repo", F.lit(name))
        every = e if every is None else every.unionByName(e)
    carry = ["repo", "module", "source", "target", "file", "line"]
    links = lost = None
    for out_channel, in_channel in (("http_out", "http_in"), ("event_publish", "event_subscribe"), ("persist", "schema_own")):
        out, into = every.where(F.col("channel") == out_channel), every.where(F.col("channel") == in_channel)
        got, rest = joins.match_links(out, into, carry).withColumn("protocol", F.lit(out_channel)), joins.unmatched_links(out, into)
        links, lost = (got, rest) if links is None else (links.unionByName(got), lost.unionByName(rest))
    own = (F.col("out_repo") == F.col("in_repo")) & (F.col("out_module") == F.col("in_module"))
    return links.withColumn("self_link", own), lost


def graph_level(index, level: int = 2, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): 0 symbols, 1 files, 2 the typed flow graph, 3 folders to a depth."""
    if level == 0:
        uses = index["uses"].where("resolved IN ('local', 'matched')").select(F.col("primary").alias("src"), F.col("fqn").alias("dst"))
        ids = index["symbols"].select(F.col("fqn").alias("node"))
        return ids, uses.join(ids.withColumnRenamed("node", "src"), "src", "left_semi").join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    if level == 2:
        edges = index["flow"].select(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("channel").alias("kind"))
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        return nodes.withColumn("type", text.node_type(F.col("node"))).withColumn("label", text.display_label(F.col("node"))), edges
    site = joins.first_by(index["defines"].select("fqn", F.col("file").alias("dst"), "line"), ["fqn"], ["dst", "line"]).drop("line")
    edges = index["uses"].select("fqn", F.col("file").alias("src")).join(site, "fqn").where("src <> dst").select("src", "dst", F.lit("import").alias("kind"))
    nodes = index["inventory"].select(F.col("path").alias("node"), "role")
    if level == 1:
        return nodes, edges
    groups = nodes.select("node", paths.rollup(F.col("node"), depth).alias("grp"))
    rolled = graph.rollup_edges(edges, groups)
    return nodes.join(groups, "node").groupBy(F.col("grp").alias("node")).agg(F.count("*").alias("members"), aggs.agreed(F.col("role")).alias("role")), rolled.withColumnsRenamed({"src_group": "src", "dst_group": "dst"})
