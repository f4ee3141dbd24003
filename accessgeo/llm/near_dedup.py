"""Near-duplicate texts by Order MinHash and banded alignment.

A text's k-mers are its runs of five and, in a second sketch, of two words, labelled with their occurrence number. Of the
labelled k-mers of a text's SAMPLE least distinct ones each seed takes the two least and keeps them in text order; the
pair is a bucket key, so texts share a key if they share k-mers in the same order. Short texts have further keys of
words (see short_keys). In a bucket every text is aligned with one pivot, which merges most classes. Buckets that
then still hold several classes are compared wholly, in blocks: pairs of different classes whose counts of words do not rule them
out are aligned. So each pair of different texts that shares a key is looked at, or is already of one class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignment import banded_distance
from .arrays import coded, mix64, plain_text, slices, word_hashes, word_lists
from .common import bound_batches, discard, materialise, noted_paths, small_side
from .components import components

RUNS, SAMPLE, SEEDS, SIMILARITY = (5, 2), 64, 24, 0.8
#: Texts of up to so many words have keys of three words; up to so many, where one edit is all that can be, keys without one word.
SHORT, ONE_EDIT = 24, 9
#: Counters of a text's hashed words, as they are and summed to a few; members of a bucket's part, of which two meet in a block;
#: counters that are compared at once.
BAG, SMALL_BAG, BLOCK, AT_ONCE = 256, 64, 1_000, 4_000_000


def kmers(h: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, hash) of all runs of `size` words, given as hashes; a shorter text is one k-mer."""
    n = np.diff(ends)
    runs = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), runs)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs)
    start = ends[:-1][doc] + at
    out = n[doc].clip(max=size).astype(np.uint64)
    for k in range(size):
        inside = at + k < n[doc]
        out = mix_in(out, np.where(inside, h[np.minimum(start + k, len(h) - 1)], np.uint64(k)))
    return doc, at, mix64(out)


def mix_in(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x ^ y) * np.uint64(0x9E3779B97F4A7C15) + (x >> np.uint64(29))


def sample(doc: np.ndarray, at: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers whose hash is among the SAMPLE least distinct ones of their text, with their occurrence numbers mixed in."""
    n = np.bincount(doc, minlength=docs)
    share = np.minimum(1.0, 4.0 * SAMPLE / np.maximum(n, 1))
    low = h.astype(np.float64) < share[doc] * 2.0**64
    for first in (True, False):
        d, p, x = doc[low], at[low], h[low]
        order = np.lexsort((p, x, d))
        d, p, x = d[order], p[order], x[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
        kinds = np.bincount(d[fresh], minlength=docs)
        short = (kinds < SAMPLE) & (share < 1)
        if not first or not short.any():
            break
        low |= short[doc]  # many repeats: look at all k-mers of such a text
        share[short] = 1
    run = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    occurrence = np.arange(len(d)) - begin[run]
    rank = run - (np.cumsum(kinds) - kinds)[d]
    keep = rank < SAMPLE
    return d[keep], p[keep], mix64(x[keep] + occurrence[keep].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def pair_keys(h: np.ndarray, ends: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that hold words, and SEEDS keys of each from its runs of `size` words."""
    d, p, x = sample(*kmers(h, ends, size), len(ends) - 1)
    order = np.lexsort((p, d))
    d, x = d[order], x[order]
    begin = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
    count = np.diff(np.r_[begin, len(d)])
    place = np.arange(len(d))
    none, far = np.uint64(2**64 - 1), np.int64(2**62)
    out = np.zeros((len(begin), SEEDS), np.int64)
    for s in range(salt, salt + SEEDS):
        v = mix64(x ^ np.uint64((s + 1) * 0xA0761D6478BD642F % 2**64))
        picked = []
        for _ in range(2):
            least = np.minimum.reduceat(v, begin)
            where = np.minimum.reduceat(np.where(v == np.repeat(least, count), place, far), begin)
            picked.append(np.where(least == none, far, where))
            v[where] = none
        a, b = np.minimum(*picked), np.maximum(*picked)
        second = np.where(b == far, np.uint64(0), x[np.minimum(b, len(x) - 1)])
        out[:, s - salt] = (mix64(mix_in(x[a], second)) ^ np.uint64(s * 0xE7037ED1A0B428DB % 2**64)).astype(np.int64)
    return d[begin], out


def short_keys(h: np.ndarray) -> np.ndarray:
    """Keys of one short text. Up to ONE_EDIT words: the text and, where an edit is allowed, the text without each of its words,
    so that all similar pairs share one. From ONE_EDIT - 1 words: the three least labelled words of each seed, in text order."""
    import xxhash

    out = []
    if len(h) <= ONE_EDIT:
        cut = [h] + ([np.delete(h, k) for k in range(len(h))] if len(h) >= 1 / (1 - SIMILARITY) - 1e-9 else [])
        out.append(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in cut], np.uint64))
    if len(h) >= ONE_EDIT - 1:
        seen: Counter = Counter()
        label = np.zeros(len(h), np.uint64)
        for k, w in enumerate(h.tolist()):
            label[k] = seen[w]
            seen[w] += 1
        x = mix64(h + label * np.uint64(0xD1B54A32D192ED03))
        seeds = np.arange(1, SEEDS + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3)
        picked = np.sort(np.argpartition(mix64(x ^ seeds[:, None]), 2, axis=1)[:, :3], axis=1)
        key = seeds
        for k in range(3):
            key = mix64(mix_in(x[picked[:, k]], key))
        out.append(key)
    return np.unique(np.concatenate(out))


def sketches(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys of all texts in one array, how many each text has, and which texts hold words. Case does not count."""
    words, ends = word_lists(pc.utf8_lower(text))
    n = np.diff(ends)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(n), np.int64), n > 0
    codes, distinct = coded(words)
    h = word_hashes(distinct)[codes]
    docs, keys = [], []
    for turn, size in enumerate(RUNS):
        d, found = pair_keys(h, ends, size, turn * SEEDS)
        docs.append(np.repeat(d, SEEDS))
        keys.append(found.ravel())
    for d in np.flatnonzero((n > 0) & (n <= SHORT)).tolist():
        found = short_keys(h[ends[d] : ends[d + 1]]).view(np.int64)
        docs.append(np.full(len(found), d))
        keys.append(found)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    return key[np.argsort(doc, kind="stable")], np.bincount(doc, minlength=len(n)), n > 0


def similar(a: list[str], b: list[str], least: float = SIMILARITY) -> bool:
    """Whether 1 - edits / words of the longer text is at least `least`. Words that the texts do not share bound
    the edits from below, which settles most pairs before the alignment."""
    n = max(len(a), len(b))
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most or n - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return banded_distance(a, b, most) <= most


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        keys, n, some = sketches(plain_text(batch.column("text")))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(keys))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("name"), pa.array(some), lists], ["doc_id", "name", "some", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [similar(x.split(" "), y.split(" ")) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words of each text, and how often each of BAG hashes of words stands in it, up to 255."""
    for batch in slices(batches):
        words, ends = word_lists(plain_text(batch.column("text")))
        codes, distinct = coded(words)
        slot = (word_hashes(distinct) % np.uint64(BAG)).astype(np.int64)[codes]
        doc = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        bags = np.bincount(doc * BAG + slot, minlength=batch.num_rows * BAG).clip(max=255).astype(np.uint8).reshape(-1, BAG)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(np.diff(ends)), pa.array([b.tobytes() for b in bags], pa.binary())], ["node", "n", "bag"])


def _missing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Words of either side that are missing on the other, the larger number: at least so many edits lie between them."""
    d = x - y
    more = np.maximum(d, 0).sum(-1)
    return np.maximum(more, more - d.sum(-1))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that the counts of their words do not rule out."""
    for batch in batches:
        n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
        bags = [np.frombuffer(b"".join(batch.column(x).to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16) for x in ("bag", "gab")]
        most = ((1 - SIMILARITY) * np.maximum(n, m) + 1e-9).astype(np.int64)
        keep = pa.array((np.abs(n - m) <= most) & (_missing(*bags) <= most), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])


def _block_pairs(node: np.ndarray, c: np.ndarray, n: np.ndarray, part: np.ndarray, bags: np.ndarray, i: int, j: int, first: bool) -> np.ndarray:
    """Pairs of different classes, one of part i and one of part j of a bucket, that the counts of their words do not rule out: each
    edit takes at most one word from either text, so no pair that is similar goes. With `first` a text of part i has its nearest partner only."""
    small = bags.reshape(len(node), SMALL_BAG, -1).sum(2, dtype=np.int16)
    these, others, out = np.flatnonzero(part == i), np.flatnonzero(part == j), []
    step = max(1, AT_ONCE // (SMALL_BAG * max(len(others), 1)))
    for at in range(0, len(these), step):
        a = these[at : at + step]
        most = ((1 - SIMILARITY) * np.maximum(n[a][:, None], n[others]) + 1e-9).astype(np.int64)
        open_ = (c[a][:, None] != c[others]) & (np.abs(n[a][:, None] - n[others]) <= most)
        if i == j:
            open_ &= node[a][:, None] < node[others]
        x, y = np.nonzero(open_)
        left, right, most = a[x], others[y], most[x, y]
        for counts, width in ((small, SMALL_BAG), (bags, BAG)):
            parts = [_missing(counts[left[k : k + AT_ONCE // width]], counts[right[k : k + AT_ONCE // width]]) for k in range(0, len(left), AT_ONCE // width)]
            missing = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            keep = missing <= most
            left, right, most, missing = left[keep], right[keep], most[keep], missing[keep]
        if first:
            order = np.lexsort((node[right], missing, left))
            keep = order[np.flatnonzero(np.diff(left[order], prepend=-1))]
            left, right = left[keep], right[keep]
        out.append(np.stack([np.minimum(node[left], node[right]), np.maximum(node[left], node[right])], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _met_here_first(pairs: np.ndarray, node: np.ndarray, keys: pa.ChunkedArray, key: int) -> np.ndarray:
    """Those of the pairs of bucket `key` that share no lesser key: texts that share many buckets are paired in one of them."""
    place = {int(x): k for k, x in enumerate(node.tolist())}
    used = sorted({place[x] for x in np.unique(pairs).tolist()})
    own = {int(node[k]): set(x) for k, x in zip(used, keys.take(pa.array(used, pa.int64())).to_pylist(), strict=True)}
    return pairs[np.array([min(own[a] & own[b]) == key for a, b in pairs.tolist()], bool)]


def _blocks(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block (key, i, j); a block that a batch cuts is completed by the next one."""
    held: pa.Table | None = None

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {x: table.column(x).to_numpy() for x in ("key", "i", "j", "part", "node", "c", "n")}
        bags = np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16)
        change = np.ones(table.num_rows, bool)
        change[1:] = np.any([cols[x][1:] != cols[x][:-1] for x in ("key", "i", "j")], axis=0)
        edges = np.append(np.flatnonzero(change), table.num_rows).tolist()
        found, held_keys = [], None if first else table.column("keys")
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            pairs = _block_pairs(*(cols[x][a:b] for x in ("node", "c", "n", "part")), bags[a:b], cols["i"][a], cols["j"][a], first)
            found.append(pairs if first else _met_here_first(pairs, cols["node"][a:b], held_keys.slice(a, b - a), int(cols["key"][a])))
        pairs = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        last = [table.column(x).to_numpy() for x in ("key", "i", "j")]
        cut = int(np.flatnonzero(np.any([x != x[-1] for x in last], axis=0))[-1]) + 1 if any((x != x[-1]).any() for x in last) else 0
        held = table.slice(cut).combine_chunks()
        if cut:
            yield from compared(table.slice(0, cut))
    if held is not None and held.num_rows:
        yield from compared(held)


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    """key, node, c, parts of the buckets of `placed` (key, node, c) that hold several classes, one of those with the same members."""
    sets = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y")).where("lo < hi")
    chosen = sets.groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    return materialise(placed.join(chosen, "key").select("key", "node", "c", "parts"), "mixed")


def _open_pairs(members: DataFrame, bags: DataFrame, first: bool) -> DataFrame:
    """(a, b) of all pairs of different classes in a bucket of `members` that may be similar, or with `first` the nearest of
    each text. A block holds at most about 2 * BLOCK members, however large the bucket."""
    dealt = members.withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "c").join(bags.drop("keys") if first else bags, "node")
    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lambda batches: _blocks(batches, first), "a bigint, b bigint").distinct()


def name_of(text) -> F.Column:
    """A 128-bit name of a text."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """doc_id, name, class_id: for each row of `docs` the least doc_id of its class; `name` is the text's (see name_of).

    Two texts are linked if their words agree with a similarity of SIMILARITY or more (1 - edits / words of the
    longer one) and they share a key; classes are the links' components, equal texts are of one class. A text without words, null or
    empty, is a class of its own. Repeated rows keep their class; a null doc_id is never the least. An
    empty table gives no rows. Texts meet only in pairs; buckets, however large, are joined with one
    pivot each. Members of a bucket that stay of several classes are compared by their counts of words in blocks, which is
    quadratic in such a bucket but spread over tasks.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("name", name_of(F.col("text")))
    spark = docs.sparkSession
    # the keys are most of what is written; tables that hold them are deleted as soon as the next ones are there
    with noted_paths() as wide_sketches:
        wide = materialise(named.mapInArrow(_sketch_rows, f"doc_id {kind}, name binary, some boolean, keys array<bigint>"), "sketches")
    sketched = materialise(wide.select("doc_id", "name", "some"), "documents")
    one = wide.where("some").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    with noted_paths() as wide_nodes:
        keyed = materialise(one.withColumn("node", F.monotonically_increasing_id()), "keyed")
    nodes = materialise(keyed.select("name", "node", "rep"), "nodes")
    discard(spark, wide_sketches)
    members = keyed.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("size")).where("pivot < last").select("key", "pivot", "size")
    buckets = materialise(members.join(crowded, "key"), "buckets")
    discard(spark, wide_nodes)
    pairs = materialise(buckets.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    wanted = small_side(materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node"), "wanted"), 200_000)
    kept = named.join(wanted, "name").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    words = F.trim(F.regexp_replace(F.lower("text"), r"[\x20\x09-\x0D]+", " "))
    texts = materialise(kept.groupBy("node").agg(F.first(words).alias("text")), "texts")

    counted = materialise(texts.mapInArrow(_bags, "node bigint, n bigint, bag binary"), "counted")

    def verify(candidates: DataFrame) -> DataFrame:
        """Only texts of candidates travel; two of them for each pair."""
        needed = small_side(materialise(candidates.select(F.col("a").alias("node")).union(candidates.select("b")).distinct(), "needed"), 200_000)
        own = texts.join(needed, "node", "left_semi")
        with_b = candidates.join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        both = with_b.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        return materialise(both.select("a", "b", "x", "y").mapInArrow(_verified, "a bigint, b bigint"), "links")

    # counts of words go before texts: most pairs that share a key by chance end here
    stars = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("member")).join(counted.select(F.col("node").alias("member"), F.col("n").alias("m"), F.col("bag").alias("gab")), "member")
    stars = stars.join(counted.withColumnRenamed("node", "pivot"), "pivot").select(F.col("pivot").alias("a"), F.col("member").alias("b"), "n", "m", "bag", "gab")
    likely = materialise(stars.mapInArrow(_possible, "a bigint, b bigint"), "likely")
    tested, links = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), verify(likely)
    # a bucket of two is settled by its pivot; larger ones that hold several classes first join each text to its nearest one of
    # another class, which merges what belongs together, and then all pairs of classes that are left are compared
    wide, bags = buckets.where("size > 2").select("key", "node"), None
    for first in (True, False):
        placed = wide.join(components(links), "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
        mixed = _mixed_buckets(materialise(placed, "placed"))
        if bags is None:
            wide = mixed.select("key", "node")
            bags = materialise(counted.join(wide.groupBy("node").agg(F.collect_set("key").alias("keys")), "node"), "bags")
        fresh = materialise(_open_pairs(mixed, bags, first).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, links = tested.unionByName(fresh), links.unionByName(verify(fresh))
    found = components(links)

    linked = found.join(nodes, "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("class_id"))
    classes = nodes.join(found, "node", "left").join(least, "component", "left").select("name", F.coalesce("class_id", "rep").alias("class_id"))
    return sketched.select("doc_id", "name", "some").join(classes, "name", "left").select("doc_id", "name", F.when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, without those that are not the first of their class.

    Rows that repeat a doc_id with the same text leave one; texts without words are classes of their own, so they
    stay. A row without doc_id stays only if no row of its class has one. Columns of the input may have any names.
    """
    classes = materialise(near_duplicate_classes(docs), "classes")
    gone = small_side(materialise(classes.where("not doc_id <=> class_id").select("doc_id", "name").distinct(), "gone"), 200_000)
    # the input's columns go in one struct, so that none clashes with ours
    kept = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), name_of(F.col("text")).alias("own"))
    kept = kept.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("name")), "left_anti")
    if not classes.groupBy("doc_id", "name").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "own"])
    return kept.select("row.*")
