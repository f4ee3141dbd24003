"""The filter audit beside its SQL, and beside applying the filters in every order to plain rows."""

from __future__ import annotations

import itertools
import math
import re

import duckdb

from accessgeo.llm import filter_audit, queries

from .conftest import SF_DIR


def fails(text, doc, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if doc is not None and least.get(text, doc) < doc else set())


def brute(rows, labels):
    good, toxic = ({r[0] for r in labels if r[0] is not None and r[k] == 1} for k in (1, 2))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts, out = {}, {}
    for d, t, lang in rows:
        parts.setdefault(lang or "", []).append((fails(t or "", d, least), d in good, d in toxic))
    for part, docs in parts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = list(docs), []
            for step, f in enumerate(order, 1):
                hit = [x for x in left if f in x[0]]
                out[part, "".join(order), step] = [len(left) - len(hit), len(hit), sum(f in x[0] for x in gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in hit), sum(x[2] for x in hit)]
                left, gone, total[f] = [x for x in left if f not in x[0]], gone + hit, total[f] + len(hit)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id bigint, text string, lang string, n bigint, part string, fails int")
    known = spark.createDataFrame([(*r, "y") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    found = filter_audit.audit_filters(filter_audit.failure_patterns(docs, known)).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in found}


def test_every_order_equals_applying_the_filters(spark, prose):
    long, other = prose(2, 300, 5)
    own = " ".join(f"w{k}" for k in range(150))
    texts = [long, long, own, own, own + " #", "SHORT " * 5, "A" * 40 + " " + own, "", None, "é😀Z" * 3, other + " $", " ".join(["a"] * 200), "one two", "x " * 200_000]
    rows = [(k, t, ["en", None, "", "de"][k % 4]) for k, t in enumerate(texts)] + [(None, own, "en"), (None, None, None), (3, own, "de"), (3, own, "de"), (2, own, "en")]
    labels = [(0, 1, 0), (1, 1, 1), (3, 0, 1), (4, 1, None), (4, None, 1), (4, 1, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_no_documents(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_shapley_shares_add_up_to_what_is_removed(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    found = audited(spark, rows, [])
    for part in {k[0] for k in found}:
        shares = sum(v[6] for k, v in found.items() if k[:2] == (part, "ABCDE"))
        assert shares == math.factorial(5) * sum(v[1] for k, v in found.items() if k[:2] == (part, "ABCDE"))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    df = queries.op11_filter_audit(spark, SF_DIR)
    told = con.execute(queries.oracle_sql()["op11_filter_audit"])
    place = [[d[0] for d in told.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in place) for r in told.fetchall())
