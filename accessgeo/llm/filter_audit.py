"""Interaction of document filters: what each removes in every order in which they may be applied.

The filters already applied form a subset, the next one leads to a larger subset: 5 filters have 80 such edges of
the lattice of subsets. A document's failures are a bit mask, so documents are first counted by (part, mask, labels);
each count then adds to its 80 edges, and an order of the filters is a path of 5 edges: 600 steps read the edges by a join.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bare

#: The filters, one bit each in this order: short, repetitive, capitals, symbols, copy.
FILTERS = "ABCDE"


def content_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone. A: under 100 words; B: under 80 % of the words are distinct; C: over 10 % of the
    code points are A to Z; D: holds one of #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    fails = [n < 100, 100 * F.size(F.array_distinct(words)) < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


def failure_patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, good, toxic, n): documents by language, failure mask and labels.

    Filter E fails a document whose text is also that of a smaller doc_id. Null text is the empty text, null lang the part ''.
    A document without doc_id fails no E and makes none fail. Rows that repeat a doc_id and text count each. A doc_id with
    several rows of labels is good or toxic if one of them says so. An empty table has no patterns.

    Texts travel as SHA-256, and rows of one text are put together before they are dealt out, so a group of copies
    comes to one task as a row for each of its patterns.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), content_failures(text).alias("fails"), F.unhex(F.sha2(text, 256)).alias("name"))
    known = bare(labels.where("quality = 1 OR toxic = 1"), doc_id=F.col("doc_id"), good=F.col("quality").eqNullSafe(1), toxic=F.col("toxic").eqNullSafe(1)).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    pattern = ["part", "fails", "good", "toxic"]
    rows = seen.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    once = rows.groupBy("doc_id", "name", *pattern).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    by_text = once.groupBy("name", *pattern).agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("name"))
    by_text = by_text.withColumn("passing", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    parts = F.array(F.struct(F.col("fails"), F.col("passing").alias("n")), F.struct(F.col("fails").bitwiseOR(16).alias("fails"), (F.col("n") - F.col("passing")).alias("n")))
    split = by_text.select("part", "good", "toxic", F.explode(parts).alias("p")).select("part", "p.fails", "good", "toxic", "p.n").where("n > 0")
    return split.groupBy(*pattern).agg(F.sum("n").alias("n"))


def lattice_edges(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, applied, next, counts): one row for each part and edge. `applied` is the mask of the filters before, `next` the number of the one that follows."""
    k = len(filters)
    every = [F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    rows = patterns.select("*", F.explode(F.array(*every)).alias("e")).select("part", "fails", "good", "toxic", "n", "e.applied", "e.next")
    before = F.col("fails").bitwiseAND(F.col("applied")) != 0
    bit = F.expr("shiftleft(1, next)")
    fails = F.col("fails").bitwiseAND(bit) != 0
    lost = ~before & fails
    total = lambda where, name: F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)
    edges = rows.groupBy("part", "applied", "next").agg(total(~before & ~fails, "kept"), total(lost, "removed"), total(before & fails, "redundant"), total(F.col("fails") == bit, "unique_fails"), total(lost & F.col("good"), "good_lost"), total(lost & F.col("toxic"), "toxic_lost"))
    # an edge after s filters lies on s! (k - 1 - s)! paths
    paths = F.element_at(F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k)]), F.bit_count("applied").cast("int") + 1)
    return edges.withColumn("shapley", F.sum(paths * F.col("removed")).over(Window.partitionBy("part", "next")))


def audit_filters(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row, zeros included, for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    steps = [("".join(order), s + 1, sum(1 << filters.index(x) for x in order[:s]), filters.index(order[s])) for order in itertools.permutations(filters) for s in range(len(filters))]
    walk = patterns.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return lattice_edges(patterns, filters).join(F.broadcast(walk), ["applied", "next"]).select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])
