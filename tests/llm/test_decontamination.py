"""Places of benchmark items beside a brute-force alignment with every text."""

from __future__ import annotations

import random

import pyarrow as pa

from accessgeo.llm import decontamination, queries


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, doc_id string")


def clean(t):
    return " ".join((t or "").lower().split())


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        last, row[0] = 0 if i == 1 else last_first, i
        last_first = i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_pairs_equal_brute_force(spark, documents, prose):
    rng = random.Random(6)
    bench = [(k, t) for k, t in enumerate(prose(6, 9, 21))] + [(20, "short"), (21, None), (22, "")]
    rows = []
    for k, t in enumerate(prose(24, 60, 22)):
        w = t.split()
        if k % 2:
            said = list(bench[k % 6][1])
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(said))
                rng.choice([lambda a, s=said: s.__setitem__(a, "z"), lambda a, s=said: s.insert(a, "q"), lambda a, s=said: s.pop(a)])(at)
            w[30:30] = "".join(said).upper().split(" ") if k % 4 == 1 else ["".join(said)]
        rows.append((k, ("  " if k % 3 else "\n").join(w)))
    found = decontamination.contaminated_places(documents(rows), items(spark, bench)).collect()
    told = set()
    for d, t in rows:
        for i, b in bench[:6]:
            m = len(clean(b).encode())
            if least_edits(clean(b), clean(t)) <= min(int(decontamination.BUDGET * m), max((m - decontamination.Q) // decontamination.Q, 0)):
                told.add((d, i))
    assert told and {(r["doc_id"], r["item_id"]) for r in found} == told
    text = dict(rows)
    for r in found:
        if r["edits"] == 0:
            assert clean(text[r["doc_id"]][r["start"] : r["end"]]) == clean(bench[r["item_id"]][1])


def test_places_count_code_points_and_repeats(spark, documents):
    said = "the quick brown fox jumps over it"
    text = "é日本 " + said + " and " + said.upper()
    rows = sorted((r["start"], r["end"]) for r in decontamination.contaminated_places(documents([(1, text)]), items(spark, [(5, said)])).collect())
    assert [text[a:b].lower() for a, b in rows] == [said, said]


def test_nulls_empty_long_and_repeated_rows(spark, documents, prose):
    said = "one of the benchmark passages, word by word"
    (long,) = prose(1, 40_000, 3)
    rows = [(1, None), (2, ""), (3, long + " " + said), (4, said), (4, said), (None, said)]
    got = decontamination.contaminated_places(documents(rows), items(spark, [(7, said), (7, said), (None, None)])).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 3, 4, 4]
    kept = decontamination.decontaminate(documents(rows), items(spark, [(7, said)]))
    assert kept.columns == documents(rows).columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_empty_tables(spark, documents):
    assert decontamination.contaminated_places(documents([]), items(spark, [(1, "some text of an item")])).count() == 0
    assert decontamination.contaminated_places(documents([(1, "some text of an item")]), items(spark, [])).count() == 0
    assert decontamination.decontaminate(documents([(1, "some text of an item")]), items(spark, [])).count() == 1


def test_many_items_come_in_blocks(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    bench = [(k, t) for k, t in enumerate(prose(12, 10, 8))]
    rows = [(k, "before " + t + " after") for k, t in bench]
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated_places(documents(rows), items(spark, bench)).collect()} == {(k, k) for k, _ in bench}
    assert decontamination.decontaminate(documents(rows), items(spark, bench[:5])).count() == 7


def test_query_finds_every_verbatim_item(spark):
    from .conftest import SF_DIR

    bench = [(r["item_id"], clean(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    docs = [(r["doc_id"], clean(r["text"])) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    told = {(d, i) for d, t in docs for i, b in bench if len(b.encode()) >= decontamination.Q and b in t}
    assert told <= {(r["doc_id"], r["item_id"]) for r in queries.op10_decontamination(spark, SF_DIR).collect()}


def test_short_items_are_found_as_whole_words(spark, documents):
    rows = [(1, "Yes, no"), (2, "say  YES now"), (3, "yesterday"), (4, "aye"), (5, "é a\nb"), (6, "a bc"), (7, "(yes)yes, _yes éyes yesé 9yes"), (8, "東京大学へ行く"), (9, "京 x京y"), (10, "a b"), (11, "yes")]
    got = decontamination.contaminated_places(documents(rows), items(spark, [(1, "yes"), (2, " a B"), (3, "Aye"), (4, ""), (5, "京"), (6, "b")])).collect()
    told = [(1, 1, "Yes"), (2, 1, "YES"), (4, 3, "aye"), (5, 2, "a\nb"), (5, 6, "b"), (7, 1, "yes"), (7, 1, "yes"), (7, 1, "yes"), (8, 5, "京"), (9, 5, "京"), (9, 5, "京"), (10, 2, "a b"), (10, 6, "b"), (11, 1, "yes")]
    assert sorted((r["doc_id"], r["item_id"], rows[r["doc_id"] - 1][1][r["start"] : r["end"]]) for r in got) == told and not any(r["edits"] for r in got)


def test_items_that_share_an_id_or_a_text(spark, documents):
    one, two = "a first text of the item in question", "quite another passage under the same name"
    got = decontamination.contaminated_places(documents([(1, "x " + one), (2, two)]), items(spark, [(7, one), (7, two), (8, two.upper())])).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 7), (2, 7), (2, 8)]


def test_periodic_texts_count_in_pieces(monkeypatch):
    bench = ["ab " * k for k in range(20, 30)]
    index = decontamination.build_index(list(range(10)), bench)
    text = pa.array(["ab " * 300, "ab " * 12, "xy " * 300])
    whole = decontamination.find(text, index)
    monkeypatch.setattr(decontamination, "AT_ONCE", 1_000)
    assert whole == decontamination.find(text, index)
    assert {(d, k) for d, k, *_ in whole} == {(0, k) for k in range(10)}
