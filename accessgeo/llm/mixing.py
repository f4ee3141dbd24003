"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, small_side

#: Bits of a document's hash, and bits that one round of the histogram resolves.
HASH_BITS, ROUND_BITS = 60, 10
ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_hash(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id; the same id has the same place in each run and at each size."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Targets per source from (key, source, source_size): weights repeat over the sources by code point,
    null last; all targets together are `share` of all sizes; a target stops at `most` times its source's
    size and the excess goes to the others by weight. One row per source is all that meets in a task.

    A source is full exactly if filling the sources in order of cap / weight reaches its cap, so the
    fixed point needs no loop.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = sizes.withColumn("weight", pick).withColumn("cap", F.lit(most) * F.col("source_size"))
    ranked = ranked.withColumn("level", level)
    full = F.col("cap") <= F.col("weight") * F.col("level")
    # the sources that are not full all get the level of the first of them
    share_out = F.min_by(F.when(~full, F.col("level")), F.when(~full, F.col("cap") / F.col("weight"))).over(everything)
    target = F.when(full, F.col("cap")).otherwise(F.col("weight") * share_out)
    return ranked.select("key", "source", "source_size", target.cast("double").alias("target"))


def hash_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: `copies` that all documents give and `cut`, the hash below which documents give one more.

    Round by round, sums by (source, bucket) find the bucket in which the budget ends; only that
    bucket is split further. The last round looks at single hashes and takes the document on the
    boundary if that brings the sum nearer to the budget. Sums are taken before the shuffle, so a
    source with a third of all rows is no larger for a task than another.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = targets.withColumn("copies", whole).select("key", "copies", (F.col("target") - whole * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("cut"), (F.col("source_size") > 0).alias("open"))
    for step in range(1, ROUNDS + 2):
        last = step > ROUNDS
        shift, above = (0 if last else HASH_BITS - ROUND_BITS * step), HASH_BITS - ROUND_BITS * (step - 1)
        state = materialise(state, "mix-state")
        ways = small_side(state.where("open").select("key", "bucket", "budget"))
        inside = sized.join(ways, "key").where(F.shiftright("h", above) == F.col("bucket"))
        sums = inside.groupBy("key", F.shiftright("h", shift).alias("part")).agg(F.sum("size").alias("s"), F.first("budget").alias("r"))
        along = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("b", F.coalesce(F.sum("s").over(along), F.lit(0)))
        taken = (2 * F.col("b") + F.col("s") < 2 * F.col("r")) if last else (F.col("b") + F.col("s") <= F.col("r"))
        edge = F.lit(False) if last else (F.col("b") < F.col("r")) & (F.col("r") < F.col("b") + F.col("s"))
        found = sums.groupBy("key").agg(F.max(F.when(taken, F.shiftleft(F.col("part") + 1, shift))).alias("end"), F.max(F.when(edge, F.col("part"))).alias("next"), F.max(F.when(edge, F.col("b"))).alias("used"))
        state = state.join(found, "key", "left").select(
            "key", "copies", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"), F.coalesce("next", F.lit(0)).cast("long").alias("bucket"),
            F.when(F.col("next").isNotNull(), F.shiftleft("next", shift)).otherwise(F.greatest("cut", F.coalesce("end", F.lit(0)))).cast("long").alias("cut"),
            F.col("next").isNotNull().alias("open"))
    return state.select("key", "copies", "cut")


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))


def mix_plan(sized: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Per source: key, source_size, target, copies, cut."""
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    cuts = materialise(hash_cuts(sized, targets), "mix-cuts")
    return small_side(materialise(targets.join(cuts, "key").select("key", "source_size", "target", "copies", "cut"), "mix-plan"))


def _sized(docs: DataFrame) -> DataFrame:
    return materialise(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), _key().alias("key"), word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id")).alias("h")), "mix-sized")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Take whole documents so that each source gives near its target number of words.

    Returns every document once: doc_id, size (words; null or empty text: 0), source_size, target of
    its source, copies (0, 1 or 2) and taken = copies * size. A null source is a source of its own.
    Rows with one doc_id in one source share a hash and are taken together. An empty table gives no
    rows; a source without words takes nothing. Columns besides doc_id, text and source are ignored.
    """
    sized = _sized(docs)
    copies = (F.col("copies") + (F.col("h") < F.col("cut")).cast("long")).alias("copies")
    return sized.join(mix_plan(sized, weights, share, most), "key").select("doc_id", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of `docs`, all columns whatever their names, each as often as mix_sources takes it."""
    plan = mix_plan(_sized(docs), weights, share, most).select("key", "copies", "cut")
    held = docs.select(F.struct(*docs.columns).alias("row"), _key().alias("key"), document_hash(F.col("doc_id")).alias("h"))
    times = F.col("copies") + (F.col("h") < F.col("cut")).cast("long")
    return held.join(plan, "key").select("row", times.alias("times")).where("times > 0").select(F.explode(F.array_repeat("row", F.col("times").cast("int"))).alias("row")).select("row.*")
