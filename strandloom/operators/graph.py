"""Graph operators on edge tables: closure, first reach, paths, layers, components, roll-ups.

Loops run one distributed step per level on a frontier and cut lineage through a
written table in the shared folder, so that a lost executor costs one level.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import paths

_TEMPORARY: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _TEMPORARY.setdefault(id(spark.sparkContext), "file://" + tempfile.mkdtemp(prefix="strandloom-"))


def cut(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder and read again; deleted when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/strandloom/step-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    atexit.register(_delete, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def _delete(spark: SparkSession, at: str) -> None:
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All (src, dst) with a path of at least one edge, by growing a frontier until it is empty.

    The result itself has a row for each reachable pair; where only components or layers
    are wanted, ``scc`` and ``layers`` do without it.
    """
    base = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct())
    known = frontier = base
    while not frontier.isEmpty():
        step = frontier.join(base.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        frontier = cut(step.join(known, ["a", "b"], "left_anti"))
        known = cut(known.unionByName(frontier))
    return known.select(F.col("a").alias(src), F.col("b").alias(dst))


def bfs(edges: DataFrame, start, src: str = "src", dst: str = "dst", most: int = 8, order: list[str] | None = None) -> tuple[DataFrame, bool]:
    """Nodes reached from ``start`` with depth and the first-reaching parent; and whether hops ran out.

    Of several edges that reach a node at one depth, that with the smallest parent,
    then the smallest ``order`` columns, counts.
    """
    order = order or []
    spark = edges.sparkSession
    seen = cut(edges.select(F.col(src).alias("node")).where(F.col("node") == start).unionByName(edges.select(F.col(dst).alias("node")).where(F.col("node") == start)).distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema[src].dataType).alias("parent")))
    frontier, depth = seen, 0
    while depth < most:
        depth += 1
        near = edges.join(frontier.select(F.col("node").alias(src)), src).groupBy(F.col(dst).alias("node")).agg(F.min(F.struct(src, *order)).alias("_e"))
        fresh = near.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), F.col(f"_e.{src}").alias("parent"))
        frontier = cut(fresh)
        if frontier.isEmpty():
            return seen, False
        seen = cut(seen.unionByName(frontier))
    more = edges.join(frontier.select(F.col("node").alias(src)), src).join(seen.select(F.col("node").alias(dst)), dst, "left_anti")
    return seen, not more.isEmpty()


def enumerate_paths(edges: DataFrame, sources: DataFrame, sinks: DataFrame, src: str = "src", dst: str = "dst", most_hops: int = 8, most_paths: int | None = 2000) -> tuple[DataFrame, bool]:
    """Simple paths from sources to sinks (each recorded when it crosses a sink, and continued).

    Rows (path, hops). With ``most_paths`` the report keeps that many, by hops and then
    by path; the flag says whether some are left out, or paths go on after ``most_hops``.
    """
    steps = edges.select(src, dst).distinct()
    live = cut(sources.select(F.array(F.col(sources.columns[0])).alias("path")).distinct())
    found, longer = None, False
    goal = sinks.select(F.col(sinks.columns[0]).alias("_end")).distinct()
    for hop in range(1, most_hops + 1):
        grown = live.withColumn(src, F.element_at("path", -1)).join(steps, src).where(~F.array_contains("path", F.col(dst)))
        live = cut(grown.select(F.concat("path", F.array(dst)).alias("path")))
        if live.isEmpty():
            break
        hit = live.withColumn("_end", F.element_at("path", -1)).join(goal, "_end", "left_semi").select("path", F.lit(hop).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
        if hop == most_hops:
            longer = not live.withColumn(src, F.element_at("path", -1)).join(steps, src).where(~F.array_contains("path", F.col(dst))).isEmpty()
    if found is None:
        return live.select("path", F.lit(0).alias("hops")).limit(0), longer
    if most_paths is None:
        return found, longer
    return found.orderBy("hops", "path").limit(most_paths), longer or found.count() > most_paths


def shortest_per_pair(found: DataFrame) -> DataFrame:
    """Per (source, sink) the path with the fewest hops, then the first in order."""
    return found.groupBy(F.get("path", F.lit(0)).alias("source"), F.element_at("path", -1).alias("sink")).agg(F.min(F.struct("hops", "path")).alias("_p")).select("source", "sink", "_p.hops", "_p.path")


def _settled(state: DataFrame, step) -> DataFrame:
    """``state`` after steps until one changes no row; ``step`` adds a column ``moved``."""
    while True:
        after = cut(step(state))
        if after.where("moved").isEmpty():
            return after.drop("moved")
        state = after.drop("moved")


def _spread(state: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's least colour among those that reach it along ``edges`` (a to b) inside its part."""

    def step(now: DataFrame) -> DataFrame:
        told = edges.join(now.select(F.col("node").alias("a"), "colour", "part"), "a")
        best = told.groupBy(F.col("b").alias("node"), "part").agg(F.min("colour").alias("heard"))
        met = now.join(best, ["node", "part"], "left")
        return met.select("node", "part", F.least("colour", F.coalesce("heard", "colour")).alias("colour"), F.coalesce(F.col("heard") < F.col("colour"), F.lit(False)).alias("moved"))

    return _settled(state, step)


def scc(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of strongly connected components of more than one node; the component is its least node.

    Forward and backward colouring: each node takes the least node that reaches it; of
    the nodes of one colour, those that reach the colour's own node are a component.
    What is left is coloured anew. Nodes without an edge in or out are trimmed first. A
    round's rows are nodes and edges, never pairs.
    """
    live = cut(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b").distinct())
    found = None
    while True:
        while True:  # what has no edge in, or none out, is in no cycle
            both = live.select(F.col("a").alias("node")).intersect(live.select(F.col("b").alias("node")))
            side = lambda c: both.select(F.col("node").alias(c))  # noqa: B023, E731
            kept = cut(live.join(side("a"), "a", "left_semi").join(side("b"), "b", "left_semi"))
            same, live = kept.count() == live.count(), kept
            if same:
                break
        if live.isEmpty():
            break
        nodes = live.select(F.col("a").alias("node")).distinct()
        coloured = _spread(nodes.select("node", F.lit(0).alias("part"), F.col("node").alias("colour")), live.select("a", "b"))
        # back along the edges of one colour, from the colour's own node
        own = coloured.select("node", F.col("colour").alias("part"), F.when(F.col("node") == F.col("colour"), F.lit(0)).otherwise(F.lit(1)).alias("colour"))
        reached = _spread(own, live.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("colour = 0").select("node", F.col("part").alias("component"))
        reached = cut(reached)
        found = reached if found is None else found.unionByName(reached)
        ends = lambda c: reached.select(F.col("node").alias(c))  # noqa: B023, E731
        live = cut(live.join(ends("a"), "a", "left_anti").join(ends("b"), "b", "left_anti"))
    if found is None:
        return edges.select(F.col(src).alias("node"), F.col(src).alias("component")).limit(0)
    sizes = found.groupBy("component").count().where("count > 1").select("component")
    return found.join(sizes, "component", "left_semi").select("node", "component")


def layers(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """Longest-path layer of each node (0 without targets); a cycle's nodes share their highest."""
    group = scc(edges, src, dst)
    comp = cut(nodes.select(F.col(node).alias("node")).join(group, "node", "left").select("node", F.coalesce("component", "node").alias("comp")))
    side = lambda c, a: comp.select(F.col("node").alias(c), F.col("comp").alias(a))
    lifted = cut(edges.select(src, dst).join(side(src, "a"), src).join(side(dst, "b"), dst).where("a <> b").select("a", "b").distinct())
    level = cut(comp.select("comp").distinct().withColumn("level", F.lit(0)))
    while True:
        risen = lifted.join(level.select(F.col("comp").alias("b"), F.col("level").alias("lb")), "b").groupBy(F.col("a").alias("comp")).agg((F.max("lb") + 1).alias("up"))
        after = cut(level.join(risen, "comp", "left").select("comp", "level", F.greatest("level", F.coalesce("up", F.lit(0))).alias("next")))
        if after.where("next <> level").isEmpty():
            break
        level = cut(after.select("comp", F.col("next").alias("level")))
    return comp.join(level, "comp").select("node", "level")


def divergence(declared: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Edges of one side that the other lacks, with the side."""
    a, b = declared.select(*keys).distinct(), observed.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("declared_only")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("observed_only")))


def rollup_edges(edges: DataFrame, groups: DataFrame, kind: str = "kind", src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges between groups with their number; none from a group to itself. ``groups``: node, grp."""
    side = lambda c, a: groups.select(F.col("node").alias(c), F.col("grp").alias(a))
    return edges.join(side(src, "src_group"), src).join(side(dst, "dst_group"), dst).where("src_group <> dst_group").groupBy("src_group", "dst_group", kind).agg(F.count("*").alias("n"))


def rollup_depth(files: DataFrame, path: str, largest: int = 350, most: int = 8) -> int:
    """The smallest depth at which no folder group is over ``largest``, as long as deeper folders differ."""
    depth, groups = 1, -1
    while True:
        got = files.groupBy(paths.rollup(F.col(path), depth).alias("g")).count().agg(F.max("count"), F.count("*")).first()
        if got[0] is None or got[0] <= largest or depth >= most or got[1] == groups:
            return depth
        groups, depth = got[1], depth + 1


def worst_confidence(members: DataFrame, group: str, confidence: str, rank) -> DataFrame:
    """Per group the most cautious confidence of its members."""
    return members.groupBy(group).agg(F.min_by(F.col(confidence), rank(F.col(confidence))).alias(confidence))


def flow_view(edges: DataFrame, reads: list[str], src: str = "source", dst: str = "target", channel: str = "channel") -> DataFrame:
    """Edges turned so that data flow from source to target (reads flow back), summed."""
    back = F.col(channel).isin(*reads)
    turned = edges.select(F.when(back, F.col(dst)).otherwise(F.col(src)).alias("src"), F.when(back, F.col(src)).otherwise(F.col(dst)).alias("dst"), F.col(channel).alias("kind"))
    return turned.groupBy("src", "dst", "kind").agg(F.count("*").alias("n"))


def focus(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the wanted nodes; where none matches, the graph as it is."""
    core = wanted.select(F.col(wanted.columns[0]).alias(node)).join(nodes.select(node), node, "left_semi").distinct()
    if core.isEmpty():
        return nodes, edges
    touching = edges.join(core.select(F.col(node).alias(src)), src, "left_semi").unionByName(edges.join(core.select(F.col(node).alias(dst)), dst, "left_semi")).distinct()
    ends = touching.select(F.col(src).alias(node)).unionByName(touching.select(F.col(dst).alias(node))).unionByName(core).distinct()
    return nodes.join(ends, node, "left_semi"), touching


def hide_roles(nodes: DataFrame, edges: DataFrame, roles: list[str], node: str = "node", src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame]:
    """The graph without nodes of the roles; nodes without a role stay."""
    kept = nodes.where(F.coalesce(~F.col("role").isin(*roles), F.lit(True)))
    ids = kept.select(node)
    return kept, edges.join(ids.withColumnRenamed(node, src), src, "left_semi").join(ids.withColumnRenamed(node, dst), dst, "left_semi")
