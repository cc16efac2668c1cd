"""Every stage of the pipeline against brute force on a small table."""

import re

import duckdb
import pytest
from oracle_check import compare, duck
from test_operators import WORD, base_spans, brute_components

import corpus_pipeline
from mootlake.llm import decontaminate, queries
from mootlake.session import stage_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = spark.createDataFrame([(10 ** 6, None, None, None, None), (10 ** 6 + 1, "", "en", "src0", 0), (10 ** 6 + 2, "123", "en", "src0", 3)], docs.schema)
    out = [docs.unionByName(bad)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stage_table(stage(spark, out[-1], SF), f"test-{name}"))
    return [d.collect() for d in out], [d.columns for d in out]


def test_columns_stay(steps):
    _, columns = steps
    assert all(c == columns[0] for c in columns[:-1]) and columns[-1][:5] == columns[0]


def test_language_stage_rejects_only_texts_without_language(steps):
    before, after = steps[0][0], steps[0][1]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2} <= gone and len(gone) <= 5


def test_one_of_each_component_stays(steps):
    before = sorted(steps[0][1], key=lambda r: r.doc_id)
    want = {before[c].doc_id for c in brute_components([r.text for r in before])}
    assert {r.doc_id for r in steps[0][2]} == want


def test_leaks_go(steps):
    items = [" ".join(decontaminate.tokens(t)) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    holds = lambda r: any(f" {i} " in f" {' '.join(decontaminate.tokens(r.text))} " for i in items)
    gone = {r.doc_id for r in steps[0][2]} - {r.doc_id for r in steps[0][3]}
    assert {r.doc_id for r in steps[0][2] if holds(r)} <= gone and not any(holds(r) for r in steps[0][3])
    assert len(gone) <= 1.2 * sum(holds(r) for r in steps[0][2]) + 1


def test_secrets_are_masked_and_documents_stay(steps):
    after = {r.doc_id: r for r in steps[0][4]}
    assert set(after) == {r.doc_id for r in steps[0][3]}
    for r in steps[0][3]:
        spans = base_spans(r.text)
        if not spans:
            assert after[r.doc_id].text == r.text
        for s in spans:
            _, a, b = s.split(":")
            assert r.text[int(a):int(b)] not in after[r.doc_id].text
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_mix_takes_documents_up_to_twice(steps):
    before = {r.doc_id: r for r in steps[0][4]}
    rows = steps[0][5]
    assert all(r.mix_copies in (1, 2) and r.mix_words == r.mix_copies * len(WORD.findall(r.text)) and before[r.doc_id].text == r.text for r in rows)
    total = sum(len(WORD.findall(r.text)) for r in before.values())
    assert abs(sum(r.mix_words for r in rows) - 1.5 * total) < 0.1 * total


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_queries_match_their_sql(spark, name):
    ok, message = compare(spark, duck(SF), SF, queries.QUERIES[name], queries.CHECKS[name])
    assert ok, message


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n != "pipeline") == list(range(1, 11))
