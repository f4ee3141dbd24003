"""From raw documents to token ids: five corpus operators in a row."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accessgeo.llm import decontamination, mixing, near_dedup, quality, tokens
from accessgeo.llm.common import discard, materialise, noted_paths, read, scratch
from accessgeo.llm.queries import vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables in the shared folder that the stage before has left, by application.
_left: dict[str, list[str]] = {}


def stage(run_stage: Stage) -> Stage:
    """A stage that first deletes what the stage before has left in the shared folder. What that one returned is written by now; tables that
    `docs` still reads stay."""

    @functools.wraps(run_stage)
    def run_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = spark.sparkContext.applicationId
        before = discard(spark, _left.pop(name, []), docs)
        with noted_paths() as made:
            out = run_stage(spark, docs, sf_dir)
        _left[name] = before + made
        return out

    return run_one


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_documents(docs, read(spark, sf_dir, "labels"))


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates stays."""
    return near_dedup.deduplicate(docs)


@stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item stands go."""
    return decontamination.decontaminate(docs, read(spark, sf_dir, "benchmark"))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store; what is returned is read from it."""
    path = scratch(spark, "token-store")
    tokens.write_store(docs, path, vocabulary())
    return tokens.read_digest(spark, path)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is written, and deleted when the next one's is."""
    docs, done = read(spark, sf_dir, "documents"), []
    for k, (_, one) in enumerate(STAGES):
        docs = one(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with noted_paths() as written:
                docs = materialise(docs, "stage")
            done, _ = written, discard(spark, done, docs)
    discard(spark, done, docs)
    return docs
