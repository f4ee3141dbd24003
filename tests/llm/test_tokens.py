"""Token store: what is read back equals the library's own ids."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from accessgeo.llm import queries, tokens
from accessgeo.llm.common import scratch


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def brute(library, rows, end=0):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def digest(spark, docs):
    path = scratch(spark, "tokens")
    tokens.write_store(docs, path, queries.vocabulary())
    rows = tokens.read_digest(spark, path).collect()
    assert all(r["verified"] for r in rows)
    return path, sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])


ODD = ["", " ", "  two  spaces ", "a\n\nb\n c\r\nd", "it's <|endoftext|> here", "1234 5,678.90", "naïve “quotes” 日本語 текст", "tab\tand\x0bmore", "...!?", "x.y,z", "a b  c", "end ", "\n", "emoji 👍🏽 ok"]


def test_equals_the_library(spark, documents, library, prose):
    rows = [(k, t) for k, t in enumerate([*ODD, None, *prose(20, 300, 5), " ".join(prose(1, 20_000, 6))])]
    rows += [(100, rows[16][1]), (101, rows[16][1] + " " + rows[17][1])]
    random.Random(1).shuffle(rows)
    path, got = digest(spark, documents(rows))
    assert got == brute(library, rows)
    ids = {r["doc_id"]: r["ids"] for r in tokens.read_ids(spark, path).collect()}
    assert all(list(ids[d]) == [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows)


def test_equal_chunks_are_stored_once(spark, documents, prose):
    (text,) = prose(1, 4_000, 8)
    path, _ = digest(spark, documents([(k, text) for k in range(6)]))
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.where("payload is not null").count() == chunks.select("digest").distinct().count()


def test_query_over_its_whole_table(spark, library):
    from .conftest import SF_DIR

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op5_tokens(spark, SF_DIR).collect()), key=lambda r: r[1])
    assert got == brute(library, rows)


def test_empty_table_and_a_lone_empty_text(spark, documents, library):
    assert digest(spark, documents([]))[1] == []
    assert digest(spark, documents([(5, None)]))[1] == brute(library, [(5, None)])


def test_repeated_and_null_ids_stay_documents(spark, documents):
    _, got = digest(spark, documents([(None, "a"), (2, "b c"), (2, "b c"), (1, "z")]))
    assert [g[0] for g in got] == [None, 1, 2, 2]
    assert [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()


def test_chunks_depend_on_content_only():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 6_000).astype(np.uint32)
    gear = tokens.gear_table(1 << 16)
    a = np.concatenate([rng.integers(0, 50_000, 777).astype(np.uint32), passage])
    b = np.concatenate([rng.integers(0, 50_000, 1_913).astype(np.uint32), passage])
    cut = lambda x: {x[s:e].tobytes() for s, e in zip([0, *tokens.cuts(x, np.array([len(x)]), gear)[1][:-1]], tokens.cuts(x, np.array([len(x)]), gear)[1], strict=True)}
    assert len(cut(a) & cut(b)) >= 4


def test_crc_is_put_together_from_parts():
    rng = random.Random(3)
    raw = bytes(rng.randrange(256) for _ in range(1_000))
    for k in (0, 1, 13, 999, 1_000):
        head, tail = raw[:k], raw[k:]
        share = tokens.shifted_crc(np.array([zlib.crc32(head)]), np.array([len(tail)]))[0]
        assert int(share) ^ zlib.crc32(tail) == zlib.crc32(raw)


def test_encoder_by_units_equals_whole_texts(library, prose):
    texts = [*ODD, *prose(30, 60, 9), "Word, word. Word.word A.B, c"]
    ids, n = tokens.Encoder(queries.vocabulary()).encode(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids] and len(n) == len(texts)


CORRUPTED = {
    "recipe digest": ("recipes", lambda t: t.withColumn("digests", F.transform("digests", lambda d, k: F.when((k == 0) & (F.col("doc_id") == 3), F.unhex(F.sha2(F.lit("x"), 256))).otherwise(d))), "one"),
    "recipe root": ("recipes", lambda t: t.withColumn("root", F.when(F.col("doc_id") == 3, F.unhex(F.sha2(F.lit("x"), 256))).otherwise(F.col("root"))), "all"),
    "payload": ("chunks", lambda t: t.withColumn("payload", F.when(F.col("doc_id") == 3, F.concat(F.unhex(F.lit("0102")), F.col("payload").substr(3, 100_000))).otherwise(F.col("payload"))), "one"),
    "part root": ("manifest", lambda t: t.withColumn("root", F.unhex(F.sha2(F.lit("x"), 256))), "all"),
    "top": ("manifest", lambda t: t.withColumn("top", F.unhex(F.sha2(F.lit("x"), 256))), "all"),
}


@pytest.fixture(scope="module")
def small_store(spark, documents, prose):
    path = scratch(spark, "tokens")
    tokens.write_store(documents(list(enumerate(prose(9, 600, 12)))), path, queries.vocabulary())
    return path


@pytest.mark.parametrize("what", CORRUPTED)
def test_a_changed_file_is_not_verified(spark, small_store, what):
    table, change, reach = CORRUPTED[what]
    other = scratch(spark, "tokens")
    for name in ("chunks", "recipes", "manifest"):
        stored = spark.read.parquet(f"{small_store}/{name}")
        (change(stored) if name == table else stored).write.parquet(f"{other}/{name}")
    told = {r["doc_id"]: r["verified"] for r in tokens.read_digest(spark, other).collect()}
    assert len(told) == 9 and not told[3] and (reach == "one" or not any(told.values()))


def test_a_tree_of_several_levels(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(tokens, "FANOUT", 3)
    digest(spark, documents(list(enumerate(prose(40, 20, 13)))))


def test_an_id_that_does_not_fit_raises(spark, documents):
    with pytest.raises(Exception, match="does not fit in 1 bytes"):
        tokens.write_store(documents([(1, "some longer words 日本語")]), scratch(spark, "tokens"), queries.vocabulary(), width=1)
