"""Labelled rows for fitting, and the split into rows to learn from and rows held out."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import give_back
from .common import bound_batches

#: Fitting sees at most so many labelled documents, the first by a hash of their ids, and stops after so many characters of them.
MAX_LABELLED, MAX_CHARACTERS = 3_000, 40_000_000


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by the CRC-32 of the id as text; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_LABELLED) -> DataFrame:
    """(at, text, y): texts and 0/1 labels of at most `most` documents that are not held out, `at` giving a fixed order.

    The bound holds at each size of the input, so the labels can be broadcast to the texts. Of several texts with one doc_id
    the least is taken, of several labels the greatest.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    drawn = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y")).select(F.xxhash64("doc_id", F.lit(17)).alias("at"), "text", "y")


def fitted(docs: DataFrame, labels: DataFrame, label: str, most: int, fit: Callable):
    """fit(texts, labels) over the sample, broadcast. One task reads the sample and fits, so no text reaches the driver."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known, left = [], [], MAX_CHARACTERS
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                left -= len(text)
                if left >= 0 or not texts:
                    texts.append(text)
                    known.append(y)
        model = pickle.dumps(fit(texts, known))
        texts.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = fitting_sample(docs, labels, label, most).repartition(1).sortWithinPartitions("at").mapInArrow(run, "model binary").collect()
    model = pickle.loads(rows[0]["model"]) if rows else fit([], [])
    return docs.sparkSession.sparkContext.broadcast(model)
