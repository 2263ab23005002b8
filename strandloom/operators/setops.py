"""Set operations on relations and logs: differences, retention, replay, exclusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of one snapshot only, marked added or removed."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def moved(old: DataFrame, new: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Keys of both snapshots whose value differs; of repeated keys the last row counts."""
    last = lambda df, a: df.groupBy(key).agg(F.max_by(F.col(value), F.col(order)).alias(a))
    return last(old, "before").join(last(new, "after"), key).where(~F.col("before").eqNullSafe(F.col("after")))


def as_of(log: DataFrame, seq: str, at: int) -> DataFrame:
    """The log as it was up to an entry."""
    return log.where(F.col(seq) <= at)


def exclude_runs(log: DataFrame, run: str, seq: str, exact: list | None = None, since=None) -> DataFrame:
    """The log without some runs: those named, or every run with an entry after the last of ``since``."""
    if since is not None:
        last = log.where(F.col(run) == since).agg(F.max(seq)).first()[0]
        if last is None:
            return log
        gone = log.where(F.col(seq) > last).select(run).distinct()
        return log.join(gone, run, "left_anti")
    return log.where(~F.col(run).isin(*(exact or [])))


def retained(snapshots: DataFrame, key: str, head: str, pinned: str, cited: DataFrame) -> DataFrame:
    """Snapshots that are heads, pinned, or cited by another relation."""
    marked = snapshots.join(cited.select(F.col(cited.columns[0]).alias(key)).distinct().withColumn("_cited", F.lit(True)), key, "left")
    return marked.where(F.col(head) | F.col(pinned) | F.coalesce("_cited", F.lit(False))).drop("_cited")


def exactly_once(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """What breaks a partition of keys: duplicate, missing or extra ones."""
    e, g = expected.select(key).distinct(), got.select(key)
    duplicate = g.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("problem"))
    missing = e.join(g, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    extra = g.distinct().join(e, key, "left_anti").select(key, F.lit("extra").alias("problem"))
    return duplicate.unionByName(missing).unionByName(extra)


def changed(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """New keys, and keys whose value is not the old one."""
    return new.join(old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_there")), key, "left").where(F.col("_there").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).drop("_old", "_there")


def append_new(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows whose content is not in the log, once each: what an append may add."""
    return fresh.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def replace_groups(old: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """Old rows of untouched groups, and the fresh rows of the others."""
    return old.join(fresh.select(group).distinct(), group, "left_anti").unionByName(fresh)
