"""Token ids in a content-addressed store.

Layout under one folder (Parquet files, written by Spark's own committers):

    chunks/     one row per chunk of a document's ids; `payload` (little-endian ids of `width` bytes)
                is there once for each digest, other rows refer to it
    recipes/    one row per document in ascending doc_id order over ascending `part`: its place in the part, number of
                ids, digests of its chunks in order, root = sha256 of the digests
    manifest/   one row per part: first and last doc_id, documents, ids, ids of all parts before it, root of the tree over
                the documents' roots with FANOUT children a node, and `top`, the hash of all parts' roots

A document is read by its recipe: its digests name the payloads. Digests, documents' roots, parts' roots and the top are all computed
anew from what is read and compared with what is stored. A gear hash over the last 16 ids cuts a document's ids into chunks, so equal passages give equal
chunks wherever they stand.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import give_back, plain_text, ragged, slices
from .common import bound_batches, materialise, small_side

WINDOW, LEAST, MASK_BITS, MOST = 16, 192, 9, 4096
#: Children of a node of the manifest's tree, and levels of such nodes below a part's root.
FANOUT, LEVELS = 1_024, 2
#: White space beside white space, or a space at an end: there an encoding can depend on what stands around it.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
UNSAFE = rf"(^ )|( $)|({SPACE}{SPACE})|\x00"
KEPT_UNITS, JOINED = 400_000, 10_000
#: How byte-level vocabularies write the byte of a space; they write ASCII letters as they are.
SPACE_BYTE = "\u0120"


class Encoder:
    """Encodes many texts with the tokenizers library, each distinct unit once.

    A byte-level pre-tokenizer always begins a new piece at a space between two visible characters, at
    a lone line end, and where a letter meets a full stop or comma. Cut there, a text's ids are those of its units in order. Texts
    with other spacing or with a special token's string go through the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # for units of a space and ASCII letters only, which are one piece: the model without what cuts pieces
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        size = self.library.get_vocab_size()
        self.spaced = np.fromiter((self.library.decode([k], skip_special_tokens=False).startswith(" ") for k in range(size)), bool, size)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(KEPT_UNITS * 2, np.int64), np.zeros(KEPT_UNITS * 2, np.int64)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, k = len(self.units), self.used
        while k + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[k : k + len(ids)] = ids
        self.used += len(ids)
        if n + len(units) > len(self.starts):
            more = np.zeros(len(units) + KEPT_UNITS, np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.starts[n : n + len(units)], self.lengths[n : n + len(units)] = k + np.cumsum(lengths) - lengths, lengths
        self.units.update(zip(units, range(n, n + len(units)), strict=True))

    def places(self, units: list[str]) -> np.ndarray:
        """Where the ids of the distinct `units` are. Units of a space and ASCII letters go to the model as they are. Others that begin
        with a space and hold no other are encoded many at a time: in their joined text each id that begins with a space begins a unit."""
        if len(self.units) > KEPT_UNITS:
            self.forget()
        get = self.units.get
        found = np.fromiter((get(u, -1) for u in units), np.int64, len(units))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found
        letters, spaced, plain = [], [], []
        for k in missing.tolist():
            u = units[k]
            (plain if u[:1] != " " else letters if u.isascii() and u[1:].isalpha() else spaced).append(k)
        for a in range(0, len(spaced), JOINED):
            part = spaced[a : a + JOINED]
            own = [units[k] for k in part]
            ids = self.whole(["".join(own)])[0]
            found[part] = len(self.units) + np.arange(len(part))
            self.learn(own, ids, np.diff(np.flatnonzero(self.spaced[ids]), append=len(ids)))
        for at, encoded in ((letters, lambda own: [[t.id for t in self.model.tokenize(SPACE_BYTE + u[1:])] for u in own]), (plain, self.whole)):
            if at:
                own = [units[k] for k in at]
                ids = encoded(own)
                found[at] = len(self.units) + np.arange(len(at))
                self.learn(own, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
        return found

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array (uint32) and the number of ids of each text."""
        odd = pc.match_substring_regex(text, UNSAFE)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(text, s))
        cut = pc.if_else(odd, pa.scalar(""), text)
        for old, new in ((" ", "\0 "), ("\n", "\0\n\0")):
            cut = pc.replace_substring(cut, old, new)
        cut = pc.replace_substring_regex(cut, r"(\p{L})([.,])", "\\1\0\\2")
        lists = pc.split_pattern(cut, "\0")
        at = lists.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        found = lists.flatten().dictionary_encode()
        codes = self.places(found.dictionary.to_pylist())[found.indices.to_numpy(zero_copy_only=False)]
        starts, lengths = self.starts[codes], self.lengths[codes]
        ids, n = ragged(self.ids, starts, lengths), np.add.reduceat(lengths, at[:-1]) if len(text) else np.zeros(0, np.int64)
        if pc.any(odd).as_py():
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            own = self.whole(text.filter(odd).to_pylist())
            ids = np.insert(ids, np.repeat((np.cumsum(n) - n)[rows], [len(x) for x in own]), np.concatenate(own))
            n[rows] = [len(x) for x in own]
        return ids, n


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this worker process, which serves all its tasks, so that a vocabulary is read once."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def gear_table(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240501)).integers(0, 2**64, n, np.uint64)


def cuts(ids: np.ndarray, ends: np.ndarray, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, end) of each chunk. A document's chunks depend on its own ids only: no cut
    comes before LEAST ids of the chunk, and LEAST is more than the window."""
    h = gear[ids % len(gear)]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint64(k))
    marks = np.flatnonzero((h >> np.uint64(64 - MASK_BITS)) == 0) + 1
    begin = np.searchsorted(marks, np.concatenate([[0], ends[:-1]]), "right").tolist()
    stop = np.searchsorted(marks, ends, "left").tolist()
    marks, docs, out, start = marks.tolist(), [], [], 0
    for d, end in enumerate(ends.tolist()):
        for m in marks[begin[d] : stop[d]]:
            while m - start > MOST:
                start += MOST
                docs.append(d)
                out.append(start)
            if m - start >= LEAST:
                start = m
                docs.append(d)
                out.append(start)
        while end - start > MOST:
            start += MOST
            docs.append(d)
            out.append(start)
        docs.append(d)
        out.append(end)
        start = end
    return np.array(docs, np.int64), np.array(out, np.int64)


def _chunk_rows(path: str, end_id: int | None, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = encoder_of(path), set()
        gear = gear_table(1 << 16)
        for batch in slices(batches, most=1_000_000):
            ids, lengths = encoder.encode(plain_text(batch.column("text")))
            if end_id is not None:
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
            if len(ids) and int(ids.max()) >> (8 * width):
                raise ValueError(f"an id does not fit in {width} bytes")
            ends = np.cumsum(lengths)
            docs, stops = cuts(ids, ends, gear)
            starts = np.concatenate([[0], stops[:-1]])
            raw = memoryview(ids.astype(f"<u{width}").tobytes())
            digests, payloads, keys = [], [], []
            for a, b in zip((starts * width).tolist(), (stops * width).tolist(), strict=True):
                digest = hashlib.sha256(raw[a:b]).digest()
                digests.append(digest)
                payloads.append(None if digest in seen else bytes(raw[a:b]))
                seen.add(digest)
            first = np.searchsorted(docs, np.arange(len(ends)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(docs)), batch.column("doc_id").take(pa.array(docs)), pa.array((np.arange(len(docs)) - first[docs]).astype(np.int32)), pa.array((stops - starts).astype(np.int64)), pa.array(ends[docs] - stops), pa.array(digests, pa.binary()), pa.array(payloads, pa.binary())],
                ["row", "doc_id", "seq", "n", "tail", "digest", "payload"])
        encoder.forget()  # an idle worker holds no units
        give_back()
    return run


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 0, width: int = 2) -> None:
    """Encode each whole text (null: empty), append `end_id`, and write the store under `path`.

    `vocabulary` is a tokenizers JSON file that each machine can open; `width` is 2 or 4 bytes for an
    id. Repeated doc_ids stay separate documents, in the order of their roots; null ids come first. An empty
    table gives an empty store. A task keeps the digests of its own chunks only.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, seq int, n bigint, tail bigint, digest binary, payload binary"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text"))
    chunks = rows.mapInArrow(_chunk_rows(vocabulary, end_id, width), schema)
    # payloads meet by digest, at most one from each task; rows that only refer are dealt evenly
    chunks = chunks.withColumn("deal", F.when(F.col("payload").isNull(), F.xxhash64("row", "seq")).otherwise(F.xxhash64("digest")))
    first = F.row_number().over(Window.partitionBy("deal", "digest").orderBy(F.col("payload").isNull(), "row", "seq")) == 1
    dealt = chunks.repartition("deal").withColumn("payload", F.when(first, F.col("payload"))).drop("deal")
    dealt.withColumn("width", F.lit(width)).write.option("compression", "snappy").option("parquet.enable.dictionary", "false").parquet(f"{path}/chunks")
    spark = docs.sparkSession
    stored = spark.read.parquet(f"{path}/chunks")
    recipes = stored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "digest"))).alias("c"))
    recipes = recipes.select("row", "doc_id", "n_tokens", F.col("c.digest").alias("digests")).withColumn("root", joined_hash(F.col("digests")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("root"), F.col("row")]
    ordered = materialise(recipes, "recipes").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("root")).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    ordered.write.parquet(f"{path}/recipes")
    found = spark.read.parquet(f"{path}/recipes")
    parts = found.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens")).join(part_roots(found), "part")
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = with_top(parts.withColumn("start", F.coalesce(F.sum("n_tokens").over(along), F.lit(0))))
    parts.coalesce(1).write.parquet(f"{path}/manifest")


def joined_hash(parts: F.Column) -> F.Column:
    """SHA-256 of an array of hashes in order, written one behind the other."""
    return F.unhex(F.sha2(F.unhex(F.array_join(F.transform(parts, F.hex), "")), 256))


def part_roots(recipes: DataFrame) -> DataFrame:
    """(part, root) of the tree over the roots of each part's documents (part, place, root); no node has more than FANOUT children
    below the part's root, which joins the topmost nodes."""
    level = recipes.select("part", F.col("place").cast("long").alias("place"), "root")
    for _ in range(LEVELS):
        node = F.floor(F.col("place") / FANOUT)
        level = level.groupBy("part", node.alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "root"))).alias("c")).select("part", F.col("node").alias("place"), joined_hash(F.col("c.root")).alias("root"))
    return level.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "root"))).alias("c")).select("part", joined_hash(F.col("c.root")).alias("root"))


def with_top(parts: DataFrame) -> DataFrame:
    """`top`, the hash of all parts' roots in order; there are as many parts as Spark partitions."""
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.withColumn("top", joined_hash(F.collect_list("root").over(everything)))


def _shift_tables() -> np.ndarray:
    """tables[b][k][v]: what the CRC register with byte k = v becomes after 2**b zero bytes."""
    poly = 0xEDB88320
    one = [poly if i == 0 else 1 << (i - 1) for i in range(32)]  # one zero bit

    def apply(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = one
    for _ in range(3):
        m = [apply(m, c) for c in m]
    tables = np.zeros((40, 4, 256), np.uint32)
    for b in range(40):
        for k in range(4):
            for v in range(256):
                tables[b, k, v] = apply(m, v << (8 * k))
        m = [apply(m, c) for c in m]
    return tables


_TABLES: list[np.ndarray] = []


def shifted_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The share of a part's CRC-32 in that of a whole with `zeros` more bytes behind the part."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    c = crc.astype(np.uint32)
    for b in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        at = np.flatnonzero((zeros >> b) & 1)
        v, t = c[at], _TABLES[0][b]
        c[at] = t[0][v & 255] ^ t[1][(v >> 8) & 255] ^ t[2][(v >> 16) & 255] ^ t[3][v >> 24]
    return c


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stored payload: whether its digest is right, its CRC as 32-bit ids, its number of ids."""
    for batch in batches:
        good, crcs, many = [], [], []
        for d, p, w in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist(), batch.column("width").to_pylist(), strict=True):
            good.append(hashlib.sha256(p).digest() == d)
            crcs.append(zlib.crc32(np.frombuffer(p, f"<u{w}").astype("<u4").tobytes()))
            many.append(len(p) // w)
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(good, pa.bool_()), pa.array(crcs, pa.int64()), pa.array(many, pa.int64())], ["digest", "good", "crc", "n"])


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document, from the chunks its recipe names, in order: ids read, their CRC, and whether all were found and right."""
    for batch in batches:
        lists = batch.column("c")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        inner = lists.flatten()
        n, crc, good = (pc.fill_null(inner.field(x), y).to_numpy(zero_copy_only=False) for x, y in (("n", 0), ("crc", 0), ("good", False)))
        upto = np.cumsum(n)
        total = np.diff(np.concatenate([[0], upto])[ends])
        tail = np.repeat(np.concatenate([[0], upto])[ends[1:]], np.diff(ends)) - upto
        share = shifted_crc(crc, tail * 4)
        whole = np.bitwise_xor.reduceat(share, ends[:-1]) if len(share) else np.zeros(len(lists), np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(total.astype(np.int64)), pa.array(whole.astype(np.int64)), pa.array(np.logical_and.reduceat(good.astype(bool), ends[:-1]) if len(good) else np.zeros(len(lists), bool))], ["row", "read_tokens", "ids_crc32", "good"])


def read_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and `verified`.

    Recipes drive the read. Each stored payload is read once; its digest and CRC are taken from its bytes, and a document's CRC is put
    together from those of the chunks its recipe names. `verified` says that all payloads were found with right digests, that their
    ids are as many as the recipe says, and that the roots of the document, of its part and of all parts are those computed anew.
    """
    chunks, recipes, manifest = (spark.read.parquet(f"{path}/{x}") for x in ("chunks", "recipes", "manifest"))
    stored = chunks.where(F.col("payload").isNotNull()).select("digest", "payload", "width").mapInArrow(_checked, "digest binary, good boolean, crc bigint, n bigint")
    named = recipes.select("row", F.posexplode("digests").alias("seq", "digest")).join(stored, "digest", "left")
    whole = named.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "good"))).alias("c"))
    docs = whole.mapInArrow(_read_documents, "row bigint, read_tokens bigint, ids_crc32 bigint, good boolean")
    computed = with_top(part_roots(recipes)).select("part", F.col("root").alias("root2"), F.col("top").alias("top2"))
    parts = manifest.join(computed, "part", "left").select("part", F.col("start").alias("base"), (F.col("root").eqNullSafe(F.col("root2")) & F.col("top").eqNullSafe(F.col("top2"))).alias("part_good"))
    along = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = recipes.select("row", "doc_id", "part", "place", "n_tokens", (F.col("root") == joined_hash(F.col("digests"))).alias("root_good")).withColumn("inside", F.coalesce(F.sum("n_tokens").over(along), F.lit(0)))
    out = placed.join(small_side(parts), "part", "left").join(docs, "row", "left")
    sound = F.coalesce(F.col("good") & F.col("part_good") & F.col("root_good") & (F.col("read_tokens") == F.col("n_tokens")), F.lit(False))
    return out.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", F.coalesce("ids_crc32", F.lit(0)).alias("ids_crc32"), sound.alias("verified"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(b"".join(x["payload"] for x in c), f"<u{c[0]['width']}").astype(np.int64) for c in batch.column("c").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "row", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row and the ids of each document, rebuilt from its recipe. A document whose recipe names an absent chunk is left out."""
    chunks, recipes = (spark.read.parquet(f"{path}/{x}") for x in ("chunks", "recipes"))
    stored = chunks.where(F.col("payload").isNotNull()).select("digest", "payload", "width")
    named = recipes.select("row", "doc_id", F.size("digests").alias("many"), F.posexplode("digests").alias("seq", "digest")).join(stored, "digest")
    whole = named.groupBy("row", "many").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "payload", "width"))).alias("c")).where(F.size("c") == F.col("many"))
    return whole.mapInArrow(_joined_ids, f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, row bigint, ids array<bigint>")
