"""Claims against structure: entailment, gates, discharge, tiers, anchors, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import text
from strandloom.operators.aggs import ratio
from strandloom.operators.joins import first_by, null_safe

#: What an unknown may say it needs.
NEEDS = ("needs_runtime", "needs_external_doc", "needs_human", "needs_wider_scope", "needs_other_repo")


def entail(claims: DataFrame, edges: DataFrame, defines: DataFrame, subject: str, channel: str, visibility: str) -> DataFrame:
    """Claims with a verdict: entailed by an edge, else contradicted by the define's visibility, else consistent."""
    keys = edges.select(subject, channel).distinct().withColumn("_edge", F.lit(True))
    met = claims.join(keys, [subject, channel], "left").join(defines.select(subject, F.col(visibility).alias("_vis")), subject, "left")
    differs = F.col("_vis").isNotNull() & F.col(visibility).isNotNull() & (F.col("_vis") != F.col(visibility))
    return met.withColumn("verdict", F.when(F.col("_edge"), "entailed").when(differs, "contradicted").otherwise("consistent")).drop("_edge", "_vis")


def verdict_counts(judged: DataFrame, node: str) -> DataFrame:
    n = {v: F.count(F.when(F.col("verdict") == v, 1)) for v in ("entailed", "consistent", "contradicted")}
    return judged.groupBy(node).agg(*[c.alias(v) for v, c in n.items()], ratio(n["entailed"], F.count("*")).alias("entailed_ratio"))


def gate(unknowns: DataFrame, subjects: DataFrame, answered: DataFrame, subject: str, channel: str, needs: str, allowed=NEEDS) -> DataFrame:
    """Unknowns with the first reason to reject them, or null.

    ``subjects``: all names that exist; ``answered``: (subject, channel) pairs that an edge already answers.
    """
    there = subjects.select(subject).distinct().withColumn("_there", F.lit(True))
    known = answered.select(subject, channel).distinct().withColumn("_known", F.lit(True))
    met = unknowns.join(there, subject, "left").join(known, [subject, channel], "left")
    reason = F.coalesce(
        F.when(F.col(subject).isNotNull() & F.col("_there").isNull(), F.lit("subject")),
        F.when(F.col("_known"), F.lit("answered")),
        F.when(~F.coalesce(F.col(needs).isin(*allowed), F.lit(False)), F.lit("needs")),
    )
    return met.withColumn("reason", reason).drop("_there", "_known")


def discharge(unknowns: DataFrame, claims: DataFrame, subjects: DataFrame, subject: str, channel: str, claim_id: str, verdict: str) -> DataFrame:
    """Unknowns with their status from the current claims: open, moot or resolved.

    A claim answers an unknown of its subject and channel, where no channel equals no
    channel; the first claim of a key counts, and a contradicted one answers nothing.
    """
    first = first_by(claims.select(subject, channel, claim_id, verdict), [subject, channel], [claim_id])
    there = subjects.select(subject).distinct().withColumn("_there", F.lit(True))
    met = null_safe(unknowns.join(there, subject, "left"), first, [subject, channel])
    answered = F.col(claim_id).isNotNull() & F.coalesce(F.col(verdict) != "contradicted", F.lit(True))
    status = F.when(F.col(subject).isNull(), "open").when(F.col("_there").isNull(), "moot").when(answered, "resolved").otherwise("open")
    return met.withColumn("status", status).withColumn("resolved_by", F.when(status == "resolved", F.col(claim_id))).drop("_there", claim_id, verdict)


def tier(scopes: DataFrame, unresolved: DataFrame, node: str) -> DataFrame:
    """T3 for scopes with any unresolved import, else T2."""
    hit = unresolved.select(node).distinct().withColumn("_hit", F.lit(True))
    return scopes.join(hit, node, "left").withColumn("tier", F.when(F.col("_hit"), "T3").otherwise("T2")).drop("_hit")


def freshness(evidence: DataFrame, churn: DataFrame, claim: str, file: str, reviewed: str) -> DataFrame:
    """Per claim: unreviewed, stale if any cited file changed, unknown if any is not known, else live."""
    met = evidence.join(churn, file, "left")
    state = F.when(F.max(F.col(reviewed)).isNull(), "anchored_unreviewed").when(F.coalesce(F.bool_or("churned"), F.lit(False)), "stale").when(F.count(F.when(F.col("churned").isNull(), 1)) > 0, "unknown_churn").otherwise("live")
    return met.groupBy(claim).agg(state.alias("freshness"))


def anchor_hits(claims: DataFrame, lines: DataFrame, file: str, line: str, anchor: str, near: int = 5) -> DataFrame:
    """Claims with where their one-line anchor stands in its file, and the verdict on it.

    ``lines``: file, no, text. An anchor under 12 characters, or found nowhere, is not
    found; one found over three times is too common; of the hits exactly one must lie
    within ``near`` lines of the claimed line, which is then corrected.
    """
    key = text.normalise_ws(F.col(anchor))
    wanted = claims.select(file, anchor).distinct().withColumn("_a", key).where(F.char_length("_a") >= 12)
    hits = lines.join(wanted, file).where(F.contains(text.normalise_ws(F.col("text")), F.col("_a"))).groupBy(file, anchor).agg(F.array_sort(F.collect_list("no")).alias("_hits"))
    met = claims.join(hits, [file, anchor], "left")
    close = F.filter("_hits", lambda n: F.abs(n - F.col(line)) <= near)
    return met.select(*claims.columns, anchor_verdict(F.col("_hits"), close).alias("verdict"), F.when(anchor_verdict(F.col("_hits"), close) == "ok", F.element_at(close, 1)).alias("at_line"))


def anchor_verdict(hits: Column, close: Column) -> Column:
    return F.when(hits.isNull(), "not_found").when(F.size(hits) > 3, "too_common").when(F.size(close) == 0, "not_found").when(F.size(close) > 1, "ambiguous").otherwise("ok")


def demotion(verified: DataFrame, claim: str, verdict: str, strict: bool = True) -> DataFrame:
    """Per claim whether it stands (all anchors good, or any if lenient), and its first failure."""
    good = F.col(verdict) == "ok"
    stands = (F.count("*") == F.count(F.when(good, 1))) if strict else (F.count(F.when(good, 1)) > 0)
    return verified.groupBy(claim).agg(stands.alias("stands"), F.min(F.when(~good, F.col(verdict))).alias("reason"))
