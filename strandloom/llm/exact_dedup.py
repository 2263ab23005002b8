"""Exact deduplication by progressive refinement.

Rows are grouped by length, the groups that survive by a hash of a prefix, and the
groups that survive that by a hash of the whole text, which is thus computed only
where a twin is still possible. The first two levels work on a written table of
lengths and prefix hashes alone; a level's surviving keys are met by equi-joins, at every
size alike. Texts meet the last level's keys in their own scan while these fit a
broadcast of counted size, and in a salted shuffle beyond.

Defined results: a null text equals the empty text. Of equal texts the row with the
largest id stays; null ids are smaller than any other, and where every id of a group
is null, or rows repeat an id with its text, all rows with that id stay. An empty
table gives an empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BESIDE_TEXTS, BROADCAST_BYTES, Scratch, left_join_sized, passthrough, quoted, table

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", prefix: int = 256, digest_all: bool = False, broadcast_bytes: int = BROADCAST_BYTES, beside_texts: int = BROADCAST_BESIDE_TEXTS) -> DataFrame:
    """Every input row with keep_id, group_size, kept and text_sha256.

    ``text_sha256`` is null for rows that no other row can equal, unless
    ``digest_all`` asks for it everywhere.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(
        quoted(id_col).alias("__id"),
        text.alias("__text"),
        F.octet_length(text).alias("__len"),
        F.xxhash64(F.substring(text, 1, prefix)).alias("__prefix"),
    )

    slim = scratch.write(rows.select("__len", "__prefix"), "slim")
    lengths = scratch.write(slim.groupBy("__len").agg(F.count("*").alias("__rows")).where("__rows > 1"), "lengths")
    by_length = left_join_sized(slim, lengths, ["__len"], 48, F.rand(17), broadcast_bytes).where("__rows IS NOT NULL")
    prefixes = by_length.groupBy("__len", "__prefix").agg(F.count("*").alias("__rows")).where("__rows > 1")
    prefixes = scratch.write(prefixes.select("__len", "__prefix", F.lit(True).alias("__twin")), "prefixes")
    by_prefix = left_join_sized(rows, prefixes, ["__len", "__prefix"], 64, F.col("__id"), beside_texts).where("__twin")
    groups = (
        by_prefix.select("__id", "__len", F.sha2("__text", 256).alias("__sha"))
        .groupBy("__len", "__sha")
        .agg(F.max("__id").alias("__keep"), F.count("*").alias("__n"))
        .where("__n > 1")
    )
    groups = scratch.write(groups, "groups")

    full = docs.select(*passthrough(docs, RESULT), quoted(id_col).alias("__id"), text.alias("__text"), F.octet_length(text).alias("__len"), F.xxhash64(F.substring(text, 1, prefix)).alias("__prefix"))
    if digest_all:
        hashed = full.withColumn("__sha", F.sha2("__text", 256)).withColumn("text_sha256", F.col("__sha"))
    else:
        marked = left_join_sized(full, prefixes, ["__len", "__prefix"], 64, F.col("__id"), beside_texts)
        hashed = marked.withColumn("text_sha256", F.when(F.col("__twin"), F.sha2("__text", 256)))
        # rows without a digest get keys of their own, not one null key
        hashed = hashed.withColumn("__sha", F.coalesce("text_sha256", F.concat(F.lit("-"), F.xxhash64("__id", "__prefix").cast("string"))))
    # the digest column is all that is left of a text here
    joined = left_join_sized(hashed.drop("__text"), groups, ["__len", "__sha"], 128, F.col("__id"), broadcast_bytes)
    keep = F.when(F.col("__n").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    return joined.select(
        *passthrough(docs, RESULT),
        keep.alias("keep_id"),
        F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, digest_all=True).select("doc_id", *RESULT)


QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {
    "op2_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
           sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
