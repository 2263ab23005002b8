"""Reports over claims, tasks, archives and graphs: counts, comparisons, ownership by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state_counts(tasks: DataFrame, wave: str, state: str, states: list[str]) -> DataFrame:
    """Per wave the number of tasks in each state, as columns, and in all."""
    return tasks.groupBy(wave).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count("*").alias("total"))


def answer_score(verdict: Column) -> Column:
    """Covered facts count 1, partial ones 0.5, absent ones 0."""
    return F.avg(F.when(verdict == "covered", 1.0).when(verdict == "partial", 0.5).otherwise(0.0))


def share_or_null(flag: Column) -> Column:
    """The share of rows with a flag; null, not 0, where there are no rows."""
    return F.avg(flag.cast("double"))


def freshness_by_cache(claims: DataFrame, cache: DataFrame, key: str, churned: str) -> DataFrame:
    """Claims in each freshness bucket; what the cache does not know is unknown."""
    met = claims.join(cache.select(key, F.col(churned).alias("_churned")), key, "left")
    bucket = F.when(F.col("_churned").isNull(), "unknown").when(F.col("_churned"), "stale").otherwise("fresh")
    return met.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def shared_by(reach: DataFrame, storage: DataFrame, process: str, module: str, target: str, least: int = 2) -> DataFrame:
    """Targets that at least ``least`` processes touch through the modules they reach, with the sorted processes."""
    touched = reach.join(storage.select(module, target).distinct(), module).select(process, target).distinct()
    return touched.groupBy(target).agg(F.sort_array(F.collect_set(process)).alias("processes")).where(F.size("processes") >= least)


def boundaries(shared: DataFrame, target: str) -> DataFrame:
    """Shared targets grouped by the tuple of processes that meet in them."""
    return shared.groupBy("processes").agg(F.count("*").alias("n_targets"), F.min(target).alias("first_target"))


def sticky_unknowns(unknowns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Unknowns of all complete patches, one for each key: the earliest."""
    return unknowns.groupBy(*keys).agg(F.min(order).alias(order))


def module_of_claim(nodes: Column, fallback: Column, root: str = "root/") -> Column:
    """The second part of the first node below the root, else the fallback."""
    below = F.get(F.filter(nodes, lambda n: n.startswith(root)), F.lit(0))
    return F.coalesce(F.get(F.split(below, "/"), F.lit(1)), fallback)


def conflict_positions(claims: DataFrame, keys: list[str], signature: str, statement: str, anchor: str) -> DataFrame:
    """One row per contested key: its positions in order of signature, null as empty, with the evidence of each."""
    each = claims.groupBy(*keys, F.coalesce(signature, F.lit("")).alias("signature")).agg(F.min(statement).alias("statement"), F.count_distinct(anchor).alias("n_anchors"))
    positions = each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("signature", "statement", "n_anchors"))).alias("positions"))
    return positions.where(F.size("positions") > 1)


def broken_entries(archive: DataFrame, content: Column, stored: str) -> DataFrame:
    """Entries whose content no longer has its stored hash; entries without a hash are skipped."""
    return archive.where(F.col(stored).isNotNull() & (F.sha2(F.coalesce(content, F.lit("")), 256) != F.col(stored)))


def compare_artifacts(want: DataFrame, got: DataFrame, name: str, value: str) -> DataFrame:
    """(name, state) of what is missing, extra or different."""
    both = want.select(name, F.col(value).alias("_want"), F.lit(True).alias("_w")).join(got.select(name, F.col(value).alias("_got"), F.lit(True).alias("_g")), name, "full")
    state = F.when(F.col("_g").isNull(), "missing").when(F.col("_w").isNull(), "extra").when(~F.col("_want").eqNullSafe(F.col("_got")), "different")
    return both.select(name, state.alias("state")).where("state IS NOT NULL")


def carried_over(folded: DataFrame, old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Folded tasks whose scope has the same hash as before."""
    same = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key).where("_old = _new")
    return folded.join(same.select(key), key, "left_semi")


def generated(tracked: Column, on_disk: Column, times: int = 20) -> Column:
    """A module with far more files on disk than tracked ones is generated."""
    return (tracked > 0) & (on_disk >= times * tracked)


def checked(rules: list[tuple[str, Column]]) -> Column:
    """Messages of the rules that do not hold, in order; a null outcome does not hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(message)) for message, holds in rules]), lambda m: m.isNotNull())


def top_roots(names: DataFrame, name: str, parts: int = 3, most: int = 60) -> DataFrame:
    """The most frequent first ``parts`` dotted parts of names: the report's own cap, ties by name."""
    root = F.array_join(F.slice(F.split(name, r"\."), 1, parts), ".")
    return names.groupBy(root.alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(most)


def process_labels(edges: DataFrame, module: str, source: str, order: str) -> DataFrame:
    """Per module the number of its sources and, as label, the first that has a dot in it."""
    dotted = F.col(source).contains(".")
    return edges.groupBy(module).agg(F.count("*").alias("n"), F.min_by(F.when(dotted, F.col(source)), F.when(dotted, F.col(order))).alias("label"))


def descends(node: Column, ancestor: Column) -> Column:
    return (node == ancestor) | node.startswith(F.concat(ancestor, F.lit("/")))


def of_service(links: DataFrame, service, caller: str, callee: str) -> DataFrame:
    """Links with a service on either side."""
    return links.where((F.col(caller) == service) | (F.col(callee) == service))


def legend(groups: DataFrame, kind: str, members: str, order: list[str]) -> DataFrame:
    """Members of each kind, in the declared order, others after it."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(kind)), F.lit(0))
    return groups.groupBy(kind).agg(F.sum(members).alias("n")).withColumn("place", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def merged_counts(maps: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """(keys, name, n): maps of counts added up by name."""
    return maps.select(*keys, F.explode(counts).alias("name", "n")).groupBy(*keys, "name").agg(F.sum("n").alias("n"))


def redirected(anchors: DataFrame, renames: DataFrame, file: str) -> DataFrame:
    """Anchors with the new name of a renamed file, and whether it was one. ``renames``: old, new."""
    met = anchors.join(renames.withColumnRenamed("old", file), file, "left")
    return met.withColumn("renamed", F.col("new").isNotNull()).withColumn(file, F.coalesce("new", file)).drop("new")


def latest_pinned(snapshots: DataFrame, artifacts: DataFrame, key: str, touched: str, group: str) -> DataFrame:
    """Per group the snapshot that was touched last (by its own number where it never was) among those with an artifact."""
    whole = snapshots.join(artifacts.select(key).distinct(), key, "left_semi")
    return whole.groupBy(group).agg(F.max_by(key, F.struct(F.coalesce(touched, key), F.col(key))).alias(key))


def change_classes(old: DataFrame, new: DataFrame, renames: DataFrame, path: str, lines: str) -> DataFrame:
    """(path, change) of edited, added, deleted and renamed files; white space alone is no edit.

    A file counts by its lines without white space at the ends and between words, blank ones left out.
    """
    plain = lambda c: F.array_join(F.filter(F.transform(F.col(c), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), "\n")
    before = redirected(old.select(path, F.sha2(plain(lines), 256).alias("_old")), renames, path)
    both = before.join(new.select(path, F.sha2(plain(lines), 256).alias("_new")), path, "full")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "edited").when(F.col("renamed"), "renamed")
    return both.select(path, change.alias("change")).where("change IS NOT NULL")


def owner_file(nodes: DataFrame, symbols: DataFrame, node: str, name: str, file: str) -> DataFrame:
    """(node, file) by the symbol of a node's name, else by the smallest symbol inside it, else so for its nearest dotted ancestor.

    Symbols are listed once under each of their dotted prefixes with their least name;
    nodes ask for each of their own prefixes, and the longest that is known counts.
    """
    parts = lambda c: F.split(F.col(c), r"\.")
    prefixes = lambda c: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts(c), 1, n), ".").alias("prefix")))
    listed = symbols.select(name, file, F.explode(prefixes(name)).alias("p")).select(name, file, "p.prefix")
    known = listed.groupBy("prefix").agg(F.min_by(file, F.struct((F.col(name) != F.col("prefix")).alias("inside"), F.col(name), F.col(file))).alias("file"))
    asked = nodes.select(node).distinct().select(node, F.explode(prefixes(node)).alias("p")).select(node, "p.depth", "p.prefix")
    return asked.join(known, "prefix").groupBy(node).agg(F.max_by("file", "depth").alias(file))


def latest_of(log: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Per key the values of its last entry."""
    last = log.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(n) for c, n in values.items()])
