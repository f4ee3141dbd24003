"""The pipeline stage by stage over a small table, beside plain Python versions of its decisions."""

from __future__ import annotations

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

import corpus_pipeline
from accessgeo.llm import queries

from .conftest import SF_DIR
from .test_near_dedup import brute_classes
from .test_tokens import brute

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF_DIR).write.parquet(f"{folder}/{k}")
        seen.append(spark.read.parquet(f"{folder}/{k}"))
    return seen


def test_columns_of_documents_are_kept(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_the_classifier_rejects_some_and_keeps_what_is_labelled_good(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good, bad = [d for d, q in labels.items() if q == 1], [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.4 * len(bad)


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    short = [(d, t) for d, t in rows if len((t or "").split()) <= 400]  # the plain comparison is quadratic in a text's words
    told = {short[k][0] for k, c in brute_classes(short).items() if c == short[k][0]}
    kept = {r["doc_id"] for r in stages[2].collect()}
    assert {d for d, _ in short if d in kept} == told


def test_verbatim_benchmark_documents_go_and_others_stay(spark, stages):
    clean = lambda t: " ".join((t or "").lower().split())
    bench = [clean(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    before, after = {r["doc_id"]: clean(r["text"]) for r in stages[2].collect()}, {r["doc_id"] for r in stages[3].collect()}
    assert after <= set(before) and not any(b in before[d] for d in after for b in bench if len(b) >= 10)
    assert len(after) >= 0.9 * len(before)


def test_each_source_comes_near_its_target(stages):
    before, after = stages[3].collect(), stages[4].collect()
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) <= 0.1 * words(before)
    times = {}
    for r in after:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2


def test_tokens_equal_the_library(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    got = sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in stages[5].collect())
    assert got == sorted(brute(library, [(r["doc_id"], r["text"]) for r in stages[4].collect()]))


def test_run_gives_the_last_stage(spark, stages):
    rows = corpus_pipeline.run(spark, SF_DIR).select(stages[5].columns).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[5].collect()))


@pytest.mark.skipif(importlib.util.find_spec("accessgeo") is None, reason="needs the library")
def test_the_rest_works_without_this_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flood_tiers' in q and set(e.oracle_sql()) <= set(q) and not any(n.startswith(('op1_', 'pipeline')) for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
