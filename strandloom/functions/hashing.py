"""Content hashes over canonical strings of our own; order of rows never matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def short_id(*parts: Column, n: int = 16) -> Column:
    return F.substring(sha256(F.concat_ws(UNIT, *parts)), 1, n)


def anonymous(prefix: str, x: Column) -> Column:
    """A stable token in place of a name; null stays null."""
    return F.when(x.isNotNull(), F.concat(F.lit(prefix + "_"), F.substring(F.sha1(x.cast("string")), 1, 12)))


def set_hash(hashes: Column) -> Column:
    """Aggregate: one hash of a group's hashes in sorted order."""
    return sha256(F.array_join(F.array_sort(F.collect_list(hashes)), ","))
