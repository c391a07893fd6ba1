"""Odd and empty tables through every operator: one row for each row, and what the docstrings say of them."""

import pytest

from tallyforge.llm import decontamination, jaccard_join, language, licenses, packing, personal_data, quality, quality_rules, substring_dedup, token_counts
from tallyforge.llm.queries import queries


def tables(spark, d, docs, labels, benchmark):
    docs.write.mode("overwrite").parquet(f"{d}/documents.parquet")
    labels.write.mode("overwrite").parquet(f"{d}/labels.parquet")
    benchmark.write.mode("overwrite").parquet(f"{d}/benchmark.parquet")


@pytest.fixture(scope="module")
def odd_dir(spark, odd, labels, benchmark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    nulls = spark.createDataFrame([(None, None, None), (1, None, None), (4, 1, 0), (6, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    tables(spark, d, odd, nulls, benchmark)
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, docs, labels, benchmark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    tables(spark, d, docs.limit(0), labels.limit(0), benchmark.limit(0))
    return d


@pytest.mark.parametrize("name", sorted(queries()))
def test_odd_rows(spark, odd_dir, odd, name):
    rows = queries()[name](spark, odd_dir).collect()
    if name == "op5_packing":
        assert sum(r.piece == 0 for r in rows) == odd.count()
    else:
        assert len(rows) == odd.count()
        assert sorted(r.doc_id or 0 for r in rows) == sorted(r.doc_id or 0 for r in odd.collect())


@pytest.mark.parametrize("name", sorted(queries()))
def test_empty_tables(spark, empty_dir, name):
    assert queries()[name](spark, empty_dir).collect() == []


def test_null_and_empty(spark, odd, benchmark):
    by = lambda df: {r.doc_id: r for r in df.where("doc_id in (1, 2, 3)").collect()}
    assert all((r.n_tokens, r.n_bytes, r.over_limit) == (0, 0, False) for i, r in by(token_counts.token_counts(odd)).items() if i < 3)
    assert all((r.n_words, r.labels, r.score, r.first_word) == (0, "", 0.0, None) for r in by(licenses.license_scan(odd)).values())
    assert all(r.spans == "" for r in by(personal_data.find_personal_data(odd)).values())
    assert all((r.n_links, r.class_id) == (0, i) for i, r in by(jaccard_join.near_duplicates(odd)).items())
    assert all(not r.repeated for r in by(substring_dedup.repeated_passages(odd)).values())
    assert all((r.n_words, r.contaminated) == (0, False) for r in by(decontamination.contamination(odd, benchmark)).values())
    assert all(r.base_failed and not r.kept for r in by(quality_rules.judge(odd, [])).values())
    assert {r.lang_pred for r in by(language.identify(odd, language.Model([], []))).values()} == {"und"}
    assert all(r.length == 1 for r in by(packing.pack(odd)).values() if r.doc_id < 3)
    assert all(0 <= r.score <= 1 for r in by(quality.score(odd, quality.fit([], []))).values())


def test_repeated_rows_are_copies(spark, odd):
    rows = [r for r in jaccard_join.near_duplicates(odd).collect() if r.doc_id in (6, 7)]
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in rows) == [(6, 6, 0, 0), (6, 6, 2, 2), (6, 6, 2, 2), (7, 6, 2, 2)]


def test_columns_are_kept(spark, odd, benchmark):
    assert decontamination.clean(odd, benchmark).columns == odd.columns
    assert personal_data.redact(odd).columns == odd.columns
    assert substring_dedup.without_repeats(odd).columns == odd.columns
    kept = jaccard_join.kept(odd)
    assert kept.columns == odd.columns and kept.where("doc_id in (6, 7)").count() == 2
