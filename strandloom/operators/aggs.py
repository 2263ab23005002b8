"""Keyed aggregates. Every function takes column names and is free of any domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def joined(values: Column, sep: str = ",") -> Column:
    """An array as one delimited string; an empty array is null."""
    return F.when(F.size(values) > 0, F.array_join(values, sep))


def distinct_sorted(x: Column) -> Column:
    return F.sort_array(F.collect_set(x))


def ownership(df: DataFrame, key: str, actor: str, channel: str, buckets: dict[str, str], count_of: tuple[str, str] | None = None) -> DataFrame:
    """Per key, the distinct sorted actors of each channel bucket, in one pass."""
    aggs = [joined(distinct_sorted(F.when(F.col(channel) == v, F.col(actor)))).alias(name) for name, v in buckets.items()]
    if count_of:
        aggs.append(F.count(F.when(F.col(channel) == count_of[1], 1)).alias(count_of[0]))
    return df.groupBy(key).agg(*aggs)


def tally(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts per key, largest first, keys in order among equals."""
    return df.groupBy(key).agg(F.count("*").alias(n)).orderBy(F.desc(n), F.asc(key))


def symbol_table(defs: DataFrame, name: str, order: str, first: dict[str, str], last: dict[str, str], module: str, site: str) -> DataFrame:
    """Per name: first and last values in ``order``, sorted distinct modules, sorted sites, collision."""
    return defs.groupBy(name).agg(
        *[F.min_by(F.col(c), F.col(order)).alias(a) for c, a in first.items()],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(a) for c, a in last.items()],
        joined(distinct_sorted(F.col(module).cast("string"))).alias("modules"),
        joined(F.transform(F.sort_array(F.collect_list(site)), lambda s: s.cast("string"))).alias("sites"),
        (F.count("*") > 1).alias("collision"),
    )


def collisions(defs: DataFrame, name: str, module: str) -> DataFrame:
    """Names with more than one site; those over several modules first."""
    found = defs.groupBy(name).agg(F.count("*").alias("n_sites"), (F.count_distinct(module) > 1).alias("cross_module")).where("n_sites > 1")
    return found.orderBy(F.desc("cross_module"), name)


def constants(defs: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: number of candidates, whether they agree on one value, and that value."""
    one = F.count_distinct(value) == 1
    return defs.groupBy(key).agg(F.count("*").alias("n_candidates"), one.alias("unambiguous"), F.when(one, F.min(value)).alias("value"))


def transpose(uses: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """The used-by index: per name its users in order, as one string."""
    users = F.array_sort(F.collect_list(F.struct(*parts)))
    return uses.groupBy(name).agg(joined(F.transform(users, lambda u: F.concat_ws(":", *[u[p].cast("string") for p in parts]))).alias("used_by"))


def top_unresolved(df: DataFrame, name: str, file: str, line: str, limit: int = 200) -> DataFrame:
    """Names by how often they occur, with their first anchor; the cap is the report's own."""
    return df.groupBy(name).agg(F.count("*").alias("n"), F.min(F.struct(file, line)).alias("first")).orderBy(F.desc("n"), name).limit(limit)


def index_of(df: DataFrame, values: str, item: str) -> DataFrame:
    """Array column to (value, sorted items)."""
    return df.select(F.explode(values).alias("value"), item).groupBy("value").agg(F.array_sort(F.collect_list(item)).alias("items"))


def conflict_merge(claims: DataFrame, owners: DataFrame, subject: str, kind: str, signature: str, module: str, anchor: str, statement: str) -> DataFrame:
    """One row per (subject, kind): how its signatures were reconciled.

    One signature is unanimous. Else the only signature claimed by an owning module
    wins, else the only one with most distinct anchors, else all are contested.
    ``owners``: subject, module. The result does not depend on the order of claims.
    """
    marked = claims.join(owners.select(subject, module).distinct().withColumn("_own", F.lit(True)), [subject, module], "left")
    per = marked.groupBy(subject, kind, signature).agg(F.count_distinct(anchor).alias("_anchors"), F.max(F.coalesce("_own", F.lit(False))).alias("_owned"))
    w = Window.partitionBy(subject, kind)
    ranked = per.withColumn("_best", F.max("_anchors").over(w))
    groups = ranked.groupBy(subject, kind).agg(
        F.count("*").alias("n_signatures"),
        F.count(F.when(F.col("_owned"), 1)).alias("_n_owned"),
        F.max(F.when(F.col("_owned"), F.struct(F.col(signature).alias("s")))).alias("_own_sig"),
        F.count(F.when(F.col("_anchors") == F.col("_best"), 1)).alias("_n_best"),
        F.max(F.when(F.col("_anchors") == F.col("_best"), F.struct(F.col(signature).alias("s")))).alias("_best_sig"),
    )
    how = F.when(F.col("n_signatures") == 1, "unanimous").when(F.col("_n_owned") == 1, "ownership").when(F.col("_n_best") == 1, "evidence").otherwise("contested")
    groups = groups.withColumn("resolution", how).withColumn("winner", F.when(how == "ownership", F.col("_own_sig.s")).when(how != "contested", F.col("_best_sig.s")))
    decided = groups.select(subject, kind, "n_signatures", "resolution", "winner")
    members = claims.join(decided, [subject, kind]).where((F.col("resolution") == "contested") | F.col(signature).eqNullSafe(F.col("winner")))
    return members.groupBy(subject, kind, "n_signatures", "resolution", "winner").agg(F.count_distinct(anchor).alias("n_anchors"), ((F.count_distinct(statement) > 1) & (F.first("resolution") == "unanimous")).alias("near_miss"))


def union_claims(claims: DataFrame, keys: list[str], order: list[str], statement: str, file: str, anchor: str, line: str, confidence: str, node: str) -> DataFrame:
    """Claims of one key as one: statements in order, distinct evidence, highest confidence, nodes."""
    rank = confidence_rank(F.col(confidence))
    statements = F.transform(F.array_sort(F.collect_list(F.struct(*order, statement))), lambda s: F.trim(s[statement]))
    evidence = F.array_sort(F.collect_set(F.struct(file, line, anchor)))
    return claims.groupBy(*keys).agg(F.filter(F.array_distinct(statements), lambda s: s != "").alias("statements"), evidence.alias("evidence"), F.max_by(F.col(confidence), rank).alias("confidence"), distinct_sorted(F.col(node)).alias("source_nodes"))


def confidence_rank(x: Column) -> Column:
    """low < medium < high < contested."""
    return F.when(x == "contested", 3).when(x == "high", 2).when(x == "medium", 1).otherwise(0)


def caution_rank(x: Column) -> Column:
    """contested < low < medium < high: the most cautious first, for display."""
    return F.when(x == "contested", 0).when(x == "low", 1).when(x == "medium", 2).otherwise(3)


def status_rank(x: Column) -> Column:
    """pending < failed < invalid < complete."""
    return F.when(x == "complete", 4).when(x == "invalid", 3).when(x == "failed", 2).when(x == "pending", 1).otherwise(0)


def node_status(log: DataFrame, node: str, status: str, error: str, seq: str, rank=status_rank) -> DataFrame:
    """Best status over a node's attempts, whatever their order, and its last non-empty error."""
    said = F.when(F.coalesce(F.col(error), F.lit("")) != "", F.col(seq))
    return log.groupBy(node).agg(F.max_by(F.col(status), rank(F.col(status))).alias(status), F.max_by(F.col(error), said).alias(error))


def best_by(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Per key the value of the row that is largest in ``order``."""
    return df.groupBy(key).agg(F.max_by(F.col(value), F.struct(*order)).alias(value))


def ratio(n: Column, d: Column, places: int = 4) -> Column:
    return F.round(F.coalesce(F.try_divide(n, d), F.lit(0.0)), places)


def clusters(df: DataFrame, key: Column, item: str) -> DataFrame:
    """Each row with the size of its cluster and the cluster's smallest item."""
    sizes = df.select(item, F.xxhash64(key).alias("_h1"), F.sha2(key, 256).alias("_k"))
    per = sizes.groupBy("_k").agg(F.count("*").alias("cluster_size"), F.min(item).alias("cluster_id"))
    return sizes.join(per, "_k").select(item, "cluster_id", "cluster_size")


def degree(edges: DataFrame, src: str, dst: str, weight: Column | None = None) -> DataFrame:
    """In plus out degree of each node."""
    w = F.lit(1) if weight is None else weight
    ends = edges.select(F.col(src).alias("node"), w.alias("w")).unionByName(edges.select(F.col(dst).alias("node"), w.alias("w")))
    return ends.groupBy("node").agg(F.sum("w").cast("long").alias("degree"))


def agreed(x: Column) -> Column:
    """Aggregate: the one value all members have, or null."""
    return F.when((F.count_distinct(x) == 1) & (F.count(x) == F.count(F.lit(1))), F.max(x))
