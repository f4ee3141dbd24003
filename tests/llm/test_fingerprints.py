"""I-Match fingerprints beside a plain version, and what they tell apart."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
import xxhash

from accessgeo.llm import fingerprints, queries

from .conftest import SF_DIR


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def brute_terms(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())}


def brute_print(terms, lexicon):
    chosen = sorted(terms & lexicon) if len(terms & lexicon) >= fingerprints.LEAST_TERMS else sorted(terms)
    if not chosen:
        return "0"
    s = max(fingerprints.LEAST_BITS, math.ceil(math.log2(len(chosen))))
    out = [f"s{s}"]
    for bits in (s, s + 1):
        for k in range(min(2**bits, fingerprints.SUBSETS)):
            h, own = 42, [t for t in chosen if t % 2**bits == k]
            for t in own:
                h = xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), seed=h)
            out.append(f"{h:x}"[-6:].lstrip() if own else "-")
    return " ".join(out)


def brute_likeness(a, b):
    if a == b:
        return 1.0
    x, y = a.split(" "), b.split(" ")
    if "0" in (a, b) or abs(int(x[0][1:]) - int(y[0][1:])) > 1:
        return 0.0
    top = max(int(x[0][1:]), int(y[0][1:]))
    width = lambda s: min(2**s, fingerprints.SUBSETS)
    at = lambda v: (lambda s: v[1 : 1 + width(s)] if s == top else v[1 + width(s) : 1 + width(s) + width(top)])(int(v[0][1:]))
    pairs = [p for p in zip(at(x), at(y), strict=True) if p != ("-", "-")]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 0.0


def brute(rows, band=fingerprints.BAND):
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of rows in any order."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1].encode()))
    counts = {}
    for _, t in rows:
        for w in brute_terms(t):
            counts[w] = counts.get(w, 0) + 1
    lexicon = {w for w, n in counts.items() if band[0] * len(rows) <= n <= band[1] * len(rows)}
    out = []
    for k, (d, t) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(t) // 3
        edit = t[: len(t) - cut] + after[:cut]
        own, other, beside = (brute_print(brute_terms(x), lexicon) for x in (t, edit, after))
        out.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), own, other, brute_likeness(own, other), brute_likeness(own, beside)))
    return out


def key(row):
    return tuple((x is not None, x) if not isinstance(x, float) else (True, round(x, 12)) for x in row)


def found(df):
    return sorted(map(tuple, df.collect()), key=key)


@pytest.mark.parametrize("block", [500, 3, 1])
def test_comparison_equals_the_plain_version(spark, documents, prose, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", block)
    texts = prose(14, 60, 3)
    rows = [(10 * k, t) for k, t in enumerate(texts)] + [(5, None), (7, ""), (8, "é😀 "), (9, "ab"), (11, "word " * 30_000), (2**62, "Z z"), (-3, texts[2]), (15, texts[2]), (None, texts[0]), (None, "n"), (40, "t"), (40, "s"), (40, "s")]
    told = sorted(brute(rows), key=key)
    assert [key(r) for r in found(fingerprints.compare_edits(documents(rows)))] == [key(r) for r in told]


@pytest.mark.parametrize("rows", [[], [(1, "just one text of a few words")], [(1, None)]])
def test_tables_of_one_row_and_none(spark, documents, rows):
    assert [key(r) for r in found(fingerprints.compare_edits(documents(rows)))] == [key(r) for r in brute(rows)]


def test_equal_texts_have_equal_fingerprints_and_edits_stay_nearer_than_others(spark, documents, prose):
    texts = prose(40, 200, 9)
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts)]
    names = {}
    for r in fingerprints.fingerprint_documents(documents(rows)).collect():
        names.setdefault(r["text"], set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in names.values()) and len({x for v in names.values() for x in v}) == len(texts)


def test_query_equals_the_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = found(queries.op13_fingerprints(spark, SF_DIR))
    assert [key(r) for r in got] == [key(r) for r in sorted(brute(rows), key=key)]
    long = [r for r in got if r[1] > 1_000]
    assert sum(r[5] > r[6] for r in long) >= 0.97 * len(long)


def test_no_python_runs(spark):
    plan = queries.op13_fingerprints(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
