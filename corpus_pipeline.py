"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, documents with
benchmark passages go, what is left is repeated towards target weights (every document
stays at least once, which the fit of the rates knows), and its token ids are written and
read back. A stage's result has been written when the next one starts; the tables that
the stage needed on the way are cleared then, and no others.

Every stage handles null and empty texts (never toxic unless the curve says so, never
duplicates or contaminated, one end token), repeated rows (toxicity and decontamination
judge each alike; near-dedup keeps rows that repeat an id with its text together),
nulls in other columns (carried), empty tables (empty results) and extra columns of any
name (carried by all stages but the last, whatever operators call their own columns).
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import contamination, mixing, near_dedup, token_files, toxicity
from strandloom.llm.common import Scratch, table

#: Share of expected tokens of each (quality, toxic) domain, of as many tokens as the scarcer one needs.
TARGETS = {"q1t0": 0.75, "q0t0": 0.25}

#: Tables of the stage that ran last.
_made: list[Scratch] = []


def _cleared(stage):
    """The stage, run after the tables of the one before it are cleared."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _made:
            _made.pop().clear()
        with Scratch.recorded() as made:
            result = stage(spark, docs, sf_dir)
        _made.extend(made)
        return result

    return run_stage


@_cleared
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


@_cleared
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_each(docs, near_dedup.near_dedup(docs, shingle=5, percent=80))


@_cleared
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@_cleared
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(docs, mixing.label_domains(table(spark, sf_dir, "labels")), TARGETS, total=None, at_least=1)


@_cleared
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shards = token_files.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.with_starts(token_files.read_documents(shards), shards).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", token_output),
]

#: Near-duplicate groups, the toxicity model and the rates are no SQL; tests replay the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
