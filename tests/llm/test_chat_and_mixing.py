"""The two operators of DataFrame functions only, beside their SQL and plain Python."""

from __future__ import annotations

import hashlib
import math

import duckdb
import pytest

from accessgeo.llm import chat, mixing, queries

from .conftest import SF_DIR

TROUBLE = ["", ": ", "</turn>\n", "### user: x</turn>\n", "\\", "\\b\\l", "a\nb", "ends with \\", "<", "</turn", "</turn>", "#", " : ", "  \x00 ok", "### Assistant: </turn> ok"]


def talks(spark, rows):
    return spark.createDataFrame([(*r, "p", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, shown string, turns int")


def test_every_field_reads_back(spark):
    rows = [(k, j, r, t) for k, r in enumerate(["user", "assistant", "", ":", "a: b", "x\n", "\\c", "<r>", "### "]) for j, t in enumerate(TROUBLE)]
    out = {r["conv_id"]: r for r in chat.format_conversations(talks(spark, rows)).collect()}
    for k in range(9):
        mine = [(r, t) for c, _, r, t in rows if c == k]
        assert [(p["role"], p["text"]) for p in out[k]["parsed"]] == mine
        assert len(out[k]["loss"]) == (len(mine) if k == 1 else 0)


def test_nulls_ties_repeated_rows_and_long_texts(spark):
    rows = [(1, None, None, None), (1, 2, "assistant", "b"), (1, 2, "assistant", "a"), (1, 2, "assistant", "a"), (None, 1, "user", "x" * 200_000), (None, 2, "assistant", "<" * 1_000)]
    out = {r["conv_id"]: r for r in chat.format_conversations(talks(spark, rows)).collect()}
    assert [(p["role"], p["text"]) for p in out[1]["parsed"]] == [("", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")]
    assert out[None]["n_turns"] == 2 and all(r["verified"] for r in out.values())


def test_no_conversations(spark):
    assert chat.format_conversations(talks(spark, [])).count() == 0


def test_query_derives_its_digests_from_the_output(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    told = {}
    for c in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        loss = "".join(t for r, t in turns if r == "assistant")
        told[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in queries.op6_chat(spark, SF_DIR).collect()}
    assert got == told


@pytest.mark.parametrize("name", ["op6_chat", "op8_mixing"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, SF_DIR)
    told = con.execute(queries.oracle_sql()[name])
    place = [[d[0] for d in told.description].index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in place)) for r in told.fetchall())


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Water filling in rounds: the plain form of the contract."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= most * sizes[s]}
        if not full:
            return out | {s: w[s] * level for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return out


def test_mix_meets_its_targets(documents, prose):
    rows = [(k, " ".join(t.split()[: 5 + k * 7 % 50]), "abcdé"[k % 5] if k % 7 else None) for k, t in enumerate(prose(600, 60, 3))]
    rows += [(1_000, None, "a"), (1_001, "", "empty"), (1_002, "one two", "tiny"), (None, "three words here", "a"), (5, "x y", "b"), (5, "x y", "b")]
    got = mixing.mix_sources(documents(rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    sizes = {s: sum(size(t) for _, t, x in rows if x == s) for s in {r[2] for r in rows}}
    told = sorted(round(v, 6) for v in targets(sizes).values())
    by_target = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    assert sorted(k[1] for k in by_target) == told
    for (_, target), found in by_target.items():
        assert abs(sum(r["taken"] for r in found) - target) <= max(r["size"] for r in found)


def test_mix_of_no_rows_and_of_rows_without_words(documents):
    assert mixing.mix_sources(documents([])).count() == 0
    assert [(r["size"], r["taken"]) for r in mixing.mix_sources(documents([(1, None, "a"), (2, "", None)])).collect()] == [(0, 0)] * 2


def test_columns_of_any_name_stay_as_they_are(spark):
    names = ["__key", "__copies", "__cut", "__copy", "__times", "key", "row", "times", "copies", "cut", "h"]
    docs = spark.createDataFrame([(k, "some words here", "s0", *[f"mine {k}"] * len(names)) for k in range(20)], ", ".join(["doc_id bigint", "text string", "source string", *[f"{n} string" for n in names]]))
    mixed = mixing.mixed_documents(docs)
    rows = mixed.collect()
    assert mixed.columns == docs.columns and len(rows) == 30 and all(r[n] == f"mine {r['doc_id']}" for r in rows for n in names)


def test_reruns_agree_and_rows_repeat_as_taken(documents, prose):
    docs = documents([(k, t, "ab"[k % 2]) for k, t in enumerate(prose(50, 20, 4))])
    first, second = (sorted((r["doc_id"], r["copies"]) for r in mixing.mix_sources(docs).collect()) for _ in range(2))
    assert first == second
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert taken == {k: v for k, v in first if v} and not any(math.isnan(v) for v in taken)
