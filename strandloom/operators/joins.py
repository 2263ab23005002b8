"""Joins with the semantics of keyed lookups: prefixes, bands, first matches, links.

Prefix joins never compare all pairs: one side's prefixes are exploded and met in an
equi-join. Sides are broadcast by the optimizer from their sizes, never by a hint here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import paths, text


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order, in one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in order if c in rest]
    packed = F.min(F.struct(*ordered, *[c for c in rest if c not in ordered])).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Left join to the first of the matching right rows."""
    return left.join(first_by(right, keys, order), keys, "left")


def exclude_evidence_any(evidence: DataFrame, roles: DataFrame, claim: str, file: str, excluded: list[str], role: str = "role") -> DataFrame:
    """Claims with at least one piece of evidence whose file's role is not excluded.

    Files without a known role count as not excluded; claims without evidence go.
    """
    met = evidence.join(roles, file, "left")
    return met.groupBy(claim).agg(F.count("*").alias("n_evidence"), F.max(F.coalesce(~F.col(role).isin(*excluded), F.lit(True))).alias("_keep")).where("_keep").drop("_keep")


def exclude_role(df: DataFrame, roles: DataFrame, file: str, excluded: list[str], role: str = "role") -> DataFrame:
    """Rows whose file's role is not excluded; an unknown file stays."""
    return df.join(roles.select(file, F.col(role).alias("_role")), file, "left").where(F.coalesce(~F.col("_role").isin(*excluded), F.lit(True))).drop("_role")


def prefix_owner(names: DataFrame, owners: DataFrame, name: str, owner_key: str, owner: str, rank: str | None = None, boundary: str = r"[./]", most: int = 12) -> DataFrame:
    """Each name with the owner of its longest prefix, whole names included.

    ``rank`` breaks ties between owners of equal prefixes (smaller first).
    """
    distinct = names.select(name).distinct()
    each = distinct.select(name, F.posexplode(paths.prefixes(F.col(name), boundary, most)).alias("_depth", owner_key))
    met = each.join(owners, owner_key)
    key = F.struct("_depth", *([rank] if rank else []), owner)
    best = met.groupBy(name).agg(F.min(key).alias("_best"), F.min_by(owner_key, key).alias(owner_key))
    return names.join(best.select(name, owner_key, F.col(f"_best.{owner}").alias(owner)), name, "left")


def prefix_longest(rows: DataFrame, prefixes: DataFrame, value: str, prefix: str, label: str) -> DataFrame:
    """Each row with the label of the longest listed prefix that ends at a segment of the value.

    The lengths that occur among the prefixes are few; the value is cut at those only.
    """
    lengths = sorted(r[0] for r in prefixes.select(F.char_length(prefix)).distinct().collect())
    cuts = F.array(*[F.when(F.char_length(value) >= n, F.substring(value, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    each = rows.select(value).distinct().select(value, F.explode(F.filter(cuts, lambda x: x.isNotNull())).alias(prefix))
    whole = (F.col(value) == F.col(prefix)) | F.substr(F.col(value), F.char_length(prefix) + 1, F.lit(1)).isin(".", "/", "?", "#") | F.col(prefix).endswith("/")
    best = each.where(whole).join(prefixes, prefix).groupBy(value).agg(F.max_by(F.struct(prefix, label), F.struct(F.char_length(prefix), label)).alias("_b"))
    return rows.join(best.select(value, F.col(f"_b.{prefix}").alias(prefix), F.col(f"_b.{label}").alias(label)), value, "left")


def observed_edges(imports: DataFrame, owners: DataFrame, name: str, source: str, owner: str, file: str, line: str) -> DataFrame:
    """(source, owner) edges of imports with their weight and first three anchors; one per owner of a name."""
    met = imports.join(owners, name).where(F.col(source) != F.col(owner))
    return weighted(met, [source, owner], file, line)


def weighted(df: DataFrame, keys: list[str], file: str, line: str, first: int = 3) -> DataFrame:
    """Rows per key and the first anchors; no task holds more than those of a key."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(file, line)))
    anchor = F.when(F.col("_n") <= first, F.struct(file, line))
    examples = F.array_join(F.transform(F.array_sort(F.collect_list(anchor)), lambda a: text.cite(a[file].cast("string"), a[line])), ",")
    return ranked.groupBy(*keys).agg(F.count("*").alias("weight"), examples.alias("examples"))


def resolve_uses(uses: DataFrame, sites: DataFrame, fqn: str = "fqn", module: str = "module") -> DataFrame:
    """``uses`` with ``resolved``: local, matched, ambiguous, third_party or unresolved.

    ``sites``: fqn, module, role, one row per definition site.
    """
    production = F.col("role") != "test"
    per = sites.groupBy(fqn).agg(F.count("*").alias("_n"), F.collect_set(module).alias("_modules"), F.count(F.when(production, 1)).alias("_np"), F.max(F.when(production, F.col(module))).alias("_prod"))
    own = F.array_contains("_modules", F.col(module))
    known = (
        F.when((F.col("_n") == 1) & own, "local")
        .when(F.col("_n") == 1, "matched")
        .when(own, "local")
        .when((F.col("_np") == 1) & (F.col("_prod") == F.col(module)), "local")
        .when(F.col("_np") == 1, "matched")
        .otherwise("ambiguous")
    )
    other = F.when(paths.looks_third_party(F.col(fqn)), "third_party").otherwise("unresolved")
    return uses.join(per, fqn, "left").withColumn("resolved", F.when(F.col("_n").isNull(), other).otherwise(known)).drop("_n", "_modules", "_np", "_prod")


def declared_edges(declared: DataFrame, modules: DataFrame, source: str, dep: str, module: str) -> tuple[DataFrame, DataFrame]:
    """(edges, ambiguous): a dependency by a module's full name, else by its last part if that is one module's."""
    full = declared.join(modules.select(F.col(module).alias(dep)), dep, "left_semi").select(source, F.col(dep).alias("to"))
    rest = declared.join(modules.select(F.col(module).alias(dep)), dep, "left_anti")
    based = modules.select(paths.base_name(F.col(module)).alias(dep), F.col(module).alias("to")).groupBy(dep).agg(F.array_sort(F.collect_set("to")).alias("candidates"))
    met = rest.join(based, dep)
    one = met.where(F.size("candidates") == 1).select(source, F.element_at("candidates", 1).alias("to"))
    edges = full.unionByName(one).where(F.col(source) != F.col("to")).distinct()
    return edges, met.where(F.size("candidates") > 1).select(source, dep, "candidates")


#: Rows of a side in a cell of a key's pairs, pairs that a task makes, and the most heavy keys that are broadcast.
CELL_ROWS, TASK_PAIRS, BROADCAST_KEYS = 2048, 1 << 24, 40_000


def meet_evenly(left: DataFrame, right: DataFrame, key: str, cell_rows: int = CELL_ROWS, task_pairs: int = TASK_PAIRS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Inner join whose pairs are dealt evenly over tasks, however few keys have most of them.

    A key with many pairs is cut into a grid of cells of at most about ``cell_rows`` rows
    of either side, each a key of its own: rows are repeated once per cell of the other
    side, which is a small share of the pairs. The number of tasks follows from all pairs.
    """
    sizes = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key)
    pairs = F.col("_l").cast("double") * F.col("_r")
    heavy = pairs > cell_rows * cell_rows
    n_pairs, n_heavy = sizes.agg(F.sum(pairs), F.count(F.when(heavy, 1))).first()
    if not n_heavy:
        return left.join(right, key)
    grid = sizes.where(heavy).select(key, F.ceil(F.col("_l") / cell_rows).alias("_rows"), F.ceil(F.col("_r") / cell_rows).alias("_cols"))
    grid = F.broadcast(grid) if n_heavy <= broadcast_keys else grid
    n_tasks = max(int(n_pairs // task_pairs), int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(side: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*side.columns), F.coalesce(own, F.lit(1)))
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1))
        met = side.join(grid, key, "left").select(*side.columns, mine.alias(own), each.alias(other))
        return met.repartition(n_tasks, key, "_rows", "_cols")

    return dealt(left, "_rows", "_cols").join(dealt(right, "_cols", "_rows"), [key, "_rows", "_cols"]).drop("_rows", "_cols")


def match_links(outbound: DataFrame, inbound: DataFrame, carry: list[str], **cells: int) -> DataFrame:
    """Pairs of edges that share a link key; exact where their plain paths are equal.

    Both sides: channel, target and the ``carry`` columns, which come back with the
    prefixes out_ and in_. A key that many edges share on both sides gives all its pairs:
    that is the result's own size, and ``meet_evenly`` deals them over all tasks.
    """

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(text.link_key(F.col("channel"), F.col("target")).alias("key"), text.link_path(F.col("channel"), F.col("target")).alias(f"{prefix}path"), *[F.col(c).alias(prefix + c) for c in carry])

    return meet_evenly(side(outbound, "out_"), side(inbound, "in_"), "key", **cells).withColumn("match_kind", F.when(F.col("out_path") == F.col("in_path"), "exact").otherwise("heuristic"))


def unmatched_links(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    """Outbound edges whose key no inbound edge has."""
    key = text.link_key(F.col("channel"), F.col("target"))
    return outbound.withColumn("key", key).join(inbound.select(key.alias("key")).distinct(), "key", "left_anti")


def refresh_links(old: DataFrame, fresh: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old links re-anchored on the first fresh edge of their key, or decayed."""
    first = first_by(fresh, keys, order)
    return old.join(first.withColumn("_there", F.lit(True)), keys, "left").withColumn("status", F.when(F.col("_there"), "live").otherwise("decayed")).drop("_there")


def band_match(points: DataFrame, bands: DataFrame, key: str, at: str, centre: str, width: int) -> DataFrame:
    """Pairs of one key with |at - centre| <= width.

    Both sides are put in buckets as wide as the band, so a hot key is met piece by
    piece and only neighbouring buckets are compared.
    """
    size = max(1, 2 * width + 1)
    left = points.withColumn("_b", F.floor(F.col(at) / size))
    right = bands.withColumn("_b", F.explode(F.sequence(F.floor((F.col(centre) - width) / size), F.floor((F.col(centre) + width) / size))))
    return left.join(right, [key, "_b"]).where(F.abs(F.col(at) - F.col(centre)) <= width).drop("_b")


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null equals null; the right side's keys are not returned."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = None
    for k in keys:
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        on = c if on is None else on & c
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, version_at: str) -> DataFrame:
    """Each row with the last version of its key at or before it: one sort per key, no pairs."""
    vcols = [c for c in versions.columns if c not in (key, version_at)]
    left = rows.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(versions.schema[c].dataType).alias(f"_v_{c}") for c in vcols])
    right = versions.select(*[F.col(key) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.col(version_at).alias("_t"), F.lit(0).alias("_side"), *[F.col(c).alias(f"_v_{c}") for c in vcols])
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = left.unionByName(right).withColumn("_v", F.last(F.when(F.col("_side") == 0, F.struct(*[f"_v_{c}" for c in vcols])), ignorenulls=True).over(w))
    return filled.where("_side = 1").select(*rows.columns, *[F.col(f"_v._v_{c}").alias(c) for c in vcols])


def substitute(rows: DataFrame, constants: DataFrame, template: str, key: str, value: str, pattern: str = r"\$\{([^}]*)\}") -> DataFrame:
    """``template`` with every ${key} that has one value replaced; ``missing`` lists the others in order.

    ``constants``: key, value, unambiguous. Rows need no id: texts are met by themselves.
    """
    distinct = rows.select(template).distinct()
    refs = distinct.select(template, F.posexplode_outer(F.regexp_extract_all(template, F.lit(pattern), F.lit(1))).alias("_pos", key))
    met = refs.join(constants.where("unambiguous").select(key, F.col(value).alias("_value")), key, "left")
    per = met.groupBy(template).agg(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", key, "_value")))).alias("_refs"))
    filled = F.aggregate("_refs", F.col(template), lambda acc, r: F.when(r["_value"].isNull(), acc).otherwise(F.replace(acc, F.concat(F.lit("${"), r[key], F.lit("}")), r["_value"])))
    out = per.select(template, filled.alias("resolved"), F.transform(F.filter("_refs", lambda r: r["_value"].isNull()), lambda r: r[key]).alias("missing"))
    return rows.join(out, template, "left")
