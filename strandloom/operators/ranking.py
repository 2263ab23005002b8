"""Ranking under budgets, search tiers, fair splits, waves, retention of generations."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.graph import cut


def budget_take(rows: DataFrame, list_no: str, index: str, rank: list[Column], limit: int) -> DataFrame:
    """One allowance of ``limit`` rows over lists in order: each takes what the lists before left.

    A list that does not fit keeps its best rows by ``rank`` (then by index). The sizes
    of lists are one small aggregate; ranks are taken inside each list.
    """
    sizes = rows.groupBy(list_no).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy(list_no).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.select(list_no, F.greatest(F.lit(0), F.lit(limit) - before).alias("_room"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(list_no).orderBy(*rank, index)))
    return ranked.join(F.broadcast(room), list_no).where(F.col("_rn") <= F.col("_room")).drop("_rn", "_room")


def fair_split(limit: int, demands: Sequence[int]) -> list[int]:
    """Water-filling over a few lists: all are served up to one level; what is left goes, one each, to the first above it."""
    want = np.maximum(np.asarray(demands, dtype=np.int64), 0)
    limit = max(0, int(limit))
    if want.sum() <= limit:
        return want.tolist()
    rising = np.sort(want)
    # were all demands under the k-th met in full, so much would be there for each of the others
    levels = (limit - (np.cumsum(rising) - rising)) // np.arange(len(rising), 0, -1)
    level = levels[np.argmax(rising > levels)]
    given = np.minimum(want, level)
    unmet = np.flatnonzero(want > level)[: limit - int(given.sum())]
    given[unmet] += 1
    return given.tolist()


def split_fairly(lists: DataFrame, demand: str, order: str, limit: int) -> DataFrame:
    """``fair_split`` for a table of lists, with the share as ``given``; ``order`` is unique.

    The level follows from the demands' histogram, of at most ``limit`` + 1 rows as no
    demand counts for more than the limit.
    """
    limit = max(0, int(limit))
    want = F.least(F.greatest(F.col(demand), F.lit(0)), F.lit(limit)).cast("long")
    histogram = lists.groupBy(want.alias("d")).agg(F.count("*").alias("k"))
    below = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("d").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = histogram.select("d", F.coalesce(F.sum(F.col("d") * F.col("k")).over(below), F.lit(0)).alias("met"), F.sum("k").over(onward).alias("others"))
    steps = steps.withColumn("level", F.floor((F.lit(limit) - F.col("met")) / F.col("others")))
    level = steps.where("d > level").agg(F.min_by("level", "d")).first()[0]
    if level is None:  # all fit, or one demand of the limit or more takes it alone
        return lists.withColumn("given", want)
    capped = F.least(want, F.lit(level)).cast("long")
    left = limit - lists.agg(F.sum(capped)).first()[0]
    extra = lists.where(want > level).orderBy(order).limit(int(left)).select(order, F.lit(1).alias("_extra"))
    return lists.join(extra, order, "left").withColumn("given", capped + F.coalesce("_extra", F.lit(0))).drop("_extra")


SEPARATORS = r"[.#:/_]+"
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def search_tier(text: Column, needle: str) -> Column:
    """0 exact, 1 a whole segment, 2 a whole camel-case word, 3 a prefix of text or segment, 4 inside; null: not there."""
    n = needle.lower()
    low = F.lower(text)
    segments = F.split(text, SEPARATORS)
    lowered = F.transform(segments, lambda s: F.lower(s))
    camel = F.flatten(F.transform(segments, lambda s: F.transform(F.split(s, CAMEL), lambda w: F.lower(w))))
    starts = low.startswith(n) | F.exists(lowered, lambda s: s.startswith(n))
    return F.when(low == n, 0).when(F.array_contains(lowered, n), 1).when(F.array_contains(camel, n), 2).when(starts, 3).when(F.contains(low, F.lit(n)), 4)


def search(df: DataFrame, text: str, needle: str) -> DataFrame:
    """Matches with their tier and place: tier, then length, then text."""
    found = df.withColumn("tier", search_tier(F.col(text), needle)).where(F.col("tier").isNotNull())
    return found.withColumn("length", F.char_length(text))


def waves(scopes: DataFrame, level: str, node: str, width: int) -> DataFrame:
    """Per level, chunks of ``width`` nodes in order; waves are numbered over all levels."""
    placed = scopes.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(level).orderBy(node)) - 1) / width).cast("int"))
    per = placed.groupBy(level).agg((F.max("_chunk") + 1).alias("_n"))
    offset = per.select(level, F.coalesce(F.sum("_n").over(Window.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offset), level).withColumn("wave", (F.col("_before") + F.col("_chunk")).cast("long")).drop("_chunk", "_before")


def superseded(df: DataFrame, keys: list[str], newest: list[Column], keep: int) -> DataFrame:
    """Rows beyond the ``keep`` newest generations of their key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))).where(F.col("_rn") > keep).drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def numbered(df: DataFrame, number: str, order: list[str], after: int = 0) -> DataFrame:
    """Rows numbered in order from ``after`` + 1, over any number of tasks.

    Rows are sorted by range; a task's first number follows from the sizes of the tasks
    before it, one row each. The sorted table is written, so that both passes see the same tasks.
    """
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    sizes = dealt.groupBy("_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_task", before.alias("_before"), "_least")  # one row per task
    placed = dealt.join(F.broadcast(offsets), "_task")
    return placed.withColumn(number, F.col("_before") + F.col("_at") - F.col("_least") + 1 + F.lit(after)).drop("_at", "_task", "_before", "_least")


def next_in_sequence(existing: DataFrame, fresh: DataFrame, seq: str, order: list[str]) -> DataFrame:
    """Fresh rows numbered on from the largest number so far."""
    return numbered(fresh, seq, order, existing.agg(F.coalesce(F.max(seq), F.lit(0))).first()[0])


def outliers(df: DataFrame, contradicted: str, tokens: str, claims: str, key: str, most: int = 5, costly: int = 5000) -> DataFrame:
    """Runs that contradict, or cost much for nothing; the report's own cap of ``most``."""
    return df.where((F.col(contradicted) > 0) | ((F.col(tokens) >= costly) & (F.col(claims) == 0))).orderBy(F.desc(contradicted), F.desc(tokens), key).limit(most)
