"""The state that a log of patches adds up to: one function of the log's tables, whatever their order.

Runs that are excluded go first. A node's status is its best over all attempts, its
claims those of its best complete generation, its unknowns those of all of its complete
patches. Claims of nodes that a newer cut has superseded are dropped; claims of one key
are merged, and where their signatures differ the conflict is settled by ownership, by
evidence, or left contested. Unknowns that a claim or the code answers are discharged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import aggs, reports


@dataclass
class Folded:
    """Tables of a folded state."""

    status: DataFrame
    claims: DataFrame
    unknowns: DataFrame
    coverage: DataFrame


def live_patches(patches: DataFrame, excluded: DataFrame | None = None, live_nodes: DataFrame | None = None) -> DataFrame:
    """Patches of runs that count and of nodes that the present cut has."""
    if excluded is not None:
        patches = patches.join(excluded.select("run"), "run", "left_anti")
    if live_nodes is not None:
        patches = patches.join(live_nodes.select("node"), "node", "left_semi")
    return patches


def fold(patches: DataFrame, claims: DataFrame, unknowns: DataFrame, owners: DataFrame, scopes: DataFrame, excluded: DataFrame | None = None) -> Folded:
    """The state of a log.

    ``patches``: patch, node, run, seq, status, generation, error. ``claims``: patch,
    subject, kind, sig, module, anchor, statement, verified. ``unknowns``: patch,
    question, channel, subject. ``owners``: subject, module. ``scopes``: node, n_files.
    """
    live = live_patches(patches, excluded, scopes)
    status = aggs.node_status(live, "node", "status", "error", "seq")
    complete = live.where("status = 'complete'")
    best = complete.groupBy("node").agg(F.max(F.struct("generation", "seq", "patch")).alias("b")).select("node", F.col("b.patch").alias("patch"))
    counted = claims.where("verified").join(best, "patch")
    merged = aggs.conflict_merge(counted, owners, "subject", "kind", "sig", "module", "anchor", "statement")
    asked = unknowns.join(complete.select("patch", "node", "seq"), "patch")
    sticky = reports.sticky_unknowns(asked, ["question", "node", "subject", "channel"], "seq")
    answered = counted.select("subject", F.col("kind").alias("channel")).distinct()
    left = sticky.join(answered, ["subject", "channel"], "left_anti")
    done = scopes.join(status, "node", "left")
    files = F.sum(F.when(F.col("status") == "complete", F.col("n_files")).otherwise(0))
    coverage = done.agg(files.alias("files_done"), F.sum("n_files").alias("files"), aggs.ratio(files, F.sum("n_files")).alias("coverage"))
    return Folded(status, merged, left, coverage)
