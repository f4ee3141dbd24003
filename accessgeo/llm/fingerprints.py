"""I-Match fingerprints (DataFrame functions only).

The terms of a text that lie in a band of inverse document frequency are its content; they are sorted, and each of several
randomised subsets of the lexicon hashes those of them that it holds. Texts with equal content in a subset have equal hashes there, so
the share of equal hashes tells how alike two texts are.

A term is its 64-bit hash, whose low bits deal the lexicon into 2^s disjoint random subsets. s follows the number of terms of the
text, so that a subset holds about one of them (and short texts have as many subsets as others): larger subsets would change with each edit. The fingerprint
has the first SUBSETS subsets at s and at s + 1, so that texts of up to twice the terms can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, small_side

#: Lexicon: terms in this share of all documents. There are at most (terms of a mean document) / BAND[0] such terms, whatever the corpus.
BAND = (0.001, 0.1)
#: Hashes at each of the two levels, the least s, and terms in the band from which on a text is told by them; below, all its terms count.
SUBSETS, LEAST_BITS, LEAST_TERMS = 64, 6, 32
#: Documents that meet in a block of the order by id, most blocks, and lexicon terms that are broadcast at most.
BLOCK_ROWS, MAX_BLOCKS, SENT_TERMS = 500, 100_000, 500_000


def text_terms(text: Column) -> Column:
    """The distinct words of a text, in lower case, as 64-bit hashes."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(term): terms of the band, counted over all documents."""
    n = docs.count()
    terms = docs.select(F.explode(text_terms(F.col("text").cast("string"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("documents")).where(F.col("documents").between(band[0] * n, band[1] * n)).select("term")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: inside the functions of array functions an expression is else computed for each element."""
    return F.transform(F.array(value), body)[0]


def _subset_hashes(terms: Column, mask: Column) -> Column:
    """For each of the first subsets, told by the bits of `mask`: the hash of its terms in order, '-' if it has none."""

    def one(own: Column) -> Column:
        return F.when(F.size(own) == 0, "-").otherwise(F.substring(F.lower(F.hex(F.xxhash64(own))), -6, 6))

    def all_of(some: Column) -> Column:
        subsets = F.sequence(F.lit(0).cast("long"), F.least(mask, F.lit(SUBSETS - 1).cast("long")))
        return F.transform(F.transform(subsets, lambda k: F.filter(some, lambda t: t.bitwiseAND(mask) == k)), one)

    return _bound(F.filter(terms, lambda t: t.bitwiseAND(mask) < SUBSETS), all_of)


def fingerprint(inside: Column, outside: Column) -> Column:
    """Of the distinct terms inside and outside the band: '0' for none, else s and the hashes at s and s + 1, by spaces."""

    def told(terms: Column, bits: Column) -> Column:
        levels = [_bound(F.call_function("shiftleft", F.lit(1).cast("long"), bits + k) - 1, lambda mask: F.array_join(_subset_hashes(terms, mask), " ")) for k in (0, 1)]
        return F.concat_ws(" ", F.concat(F.lit("s"), bits.cast("string")), *levels)

    terms = F.array_sort(F.when(F.size(inside) >= LEAST_TERMS, inside).otherwise(F.concat(inside, outside)))
    return _bound(terms, lambda t: F.when(F.size(t) == 0, "0").otherwise(_bound(F.greatest(F.ceil(F.log2(F.size(t).cast("double"))).cast("int"), F.lit(LEAST_BITS)), lambda bits: told(t, bits))))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the share of equal hashes among the subsets in which one of two fingerprints has terms, at the level they share.

    Equal fingerprints have 1; one without terms, or with more than twice the subsets of the other, has 0.
    """
    x, y = F.split(a, " "), F.split(b, " ")
    s, t = (F.substring(v[0], 2, 2).cast("int") for v in (x, y))

    def level(v: Column, own: Column, at: Column) -> Column:
        width = lambda bits: F.least(F.call_function("shiftleft", F.lit(1), bits), F.lit(SUBSETS))
        return F.when(own == at, F.slice(v, 2, width(own))).otherwise(F.slice(v, width(own) + 2, width(at)))

    top = F.greatest(s, t)
    pairs = F.filter(F.arrays_zip(level(x, s, top).alias("x"), level(y, t, top).alias("y")), lambda p: (p["x"] != "-") | (p["y"] != "-"))
    equal = F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))
    told = F.when(F.size(pairs) > 0, equal / F.size(pairs)).otherwise(0.0)
    return F.when(a == b, 1.0).when((a == "0") | (b == "0"), 0.0).when(F.abs(s - t) > 1, 0.0).otherwise(told).cast("double")


def with_fingerprints(rows: DataFrame, texts: dict[str, str], terms: DataFrame) -> DataFrame:
    """`rows` with a fingerprint for each text column: texts maps text columns to new names; `terms` is the lexicon, written.

    `rows` must be keyed by its columns block and place; the text columns go. Where rows lie by block, nothing is dealt out anew.
    """
    kept = [c for c in rows.columns if c not in texts]

    def marked_with(k: int, text: Column) -> Column:
        return F.transform(text_terms(text), lambda t: F.struct(F.lit(k).alias("which"), t.alias("term")))

    found = F.flatten(F.array(*[F.coalesce(marked_with(k, F.col(c)), F.array()) for k, c in enumerate(texts)]))
    each = rows.select(*kept, F.explode_outer(found).alias("t")).select(*kept, "t.which", "t.term")
    marked = each.join(small_side(terms.withColumn("listed", F.lit(True)), SENT_TERMS), "term", "left")
    sets = [F.collect_list(F.when((F.col("which") == k) & (F.col("listed").isNotNull() if side else F.col("listed").isNull()), F.col("term"))).alias(f"{name}_{side}") for k, name in enumerate(texts.values()) for side in (1, 0)]
    grouped = marked.groupBy("block", "place").agg(*[F.first(c).alias(c) for c in kept if c not in ("block", "place")], *sets)
    return grouped.select(*kept, *[fingerprint(F.col(f"{name}_1"), F.col(f"{name}_0")).alias(name) for name in texts.values()])


def _order_blocks(docs: DataFrame) -> tuple[list[int], list[int]]:
    """Least and greatest doc_id of each block of the order by id: at most MAX_BLOCKS numbers each, however many documents."""
    n = max(1, min(MAX_BLOCKS, -(-docs.count() // BLOCK_ROWS)))
    ends = docs.repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("at")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    rows = sorted((r["low"], r["high"]) for r in ends.select("low", "high").collect())
    return [r[0] for r in rows], [r[1] for r in rows]


def _numbers(values: list[int]) -> Column:
    """An array literal; split once when the plan is made."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def beside_next(docs: DataFrame) -> DataFrame:
    """(block, place, again, doc_id, text, next_text): each document beside the next one by descending doc_id, behind the last the first.

    Documents are dealt out by blocks of neighbouring ids; the head of each block goes to the block before it as well, there with
    `again` and last. Documents of one id (a null id counts as the least) stand by their texts. Null text is the empty text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, high = _order_blocks(rows.select("key"))
    if not low:
        return rows.select(F.lit(0).alias("block"), F.lit(0).alias("place"), F.lit(False).alias("again"), "doc_id", "text", F.col("text").alias("next_text"))
    n, lows, highs = len(low), _numbers(low), _numbers(high)
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda b, s: F.when(b + s > n, b).when(F.get(lows, b + s - 1) <= F.col("key"), b + s).otherwise(b))
    placed = rows.withColumn("own", found)
    twice = F.when(F.get(highs, F.col("own") - 1) == F.col("key"), F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("again")), F.struct((F.col("own") % n + 1).alias("block"), F.lit(True).alias("again"))))
    dealt = placed.select("key", "doc_id", "text", F.explode(F.coalesce(twice, F.array(F.struct(F.col("own").alias("block"), F.lit(False).alias("again"))))).alias("to")).select("to.*", "key", "doc_id", "text")
    order = Window.partitionBy("block").orderBy("again", F.desc("key"), "text")
    return dealt.select("block", F.row_number().over(order).alias("place"), "again", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The text, its last third (rounded down) replaced by as many first characters of the next text, or all of it."""
    cut = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - cut), F.substr(F.coalesce(next_text, F.lit("")), F.lit(1), cut))


def fingerprint_documents(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """(doc_id, text, fingerprint), one row per row of `docs`. Equal texts have equal fingerprints; null text counts as empty, and a text
    without words has the fingerprint '0'. Rows may repeat; other columns are ignored; no rows give no rows."""
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    names = rows.groupBy(F.sha2("text", 256).alias("name")).agg(F.first("text").alias("text"))
    told = with_fingerprints(names.select(F.col("name").alias("block"), F.lit(0).alias("place"), "text"), {"text": "fingerprint"}, materialise(lexicon(rows, band), "lexicon"))
    return rows.withColumn("name", F.sha2("text", 256)).join(told.select(F.col("block").alias("name"), "fingerprint"), "name").select("doc_id", "text", "fingerprint")


def compare_edits(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are dealt out once, by blocks of ids; all that follows stays where the blocks lie.
    """
    terms = materialise(lexicon(docs, band), "lexicon")
    rows = beside_next(docs).withColumn("edited", F.when(~F.col("again"), edited(F.col("text"), F.col("next_text"))))
    rows = rows.select("block", "place", "again", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    told = with_fingerprints(rows, {"text": "fingerprint", "edited": "edited_fingerprint"}, terms)
    told = told.withColumn("next", F.lead("fingerprint").over(Window.partitionBy("block").orderBy("place"))).where("NOT again")
    return told.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"))
