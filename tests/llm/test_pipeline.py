import inspect

import corpus_pipeline as P
from tests.conftest import SF_SMALL
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_substring import brute as brute_substrings

import __spark_entry__ as E


def test_registered():
    names = list(E.queries())
    assert "pipeline" in names and all(sum(q.startswith(f"op{n}_") for q in names) == 1 for n in range(1, 14))
    assert [n for n, _ in P.STAGES] == ["language", "duplicates", "repeats", "mixing", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in P.STAGES)


def test_stages_decide(spark, docs):
    """Each stage against its rule on its own input."""
    docs = docs.select(P.COLUMNS)
    first = P.language(spark, docs, SF_SMALL)
    told = {r["doc_id"] for r in first.collect()}
    assert first.columns == P.COLUMNS and not told & {300, 301, 302} and {0, 100, 200, None} <= told
    second = P.duplicates(spark, first, SF_SMALL)
    rows = [(r["doc_id"], r["text"]) for r in first.collect() if r["doc_id"] is not None]
    assert sorted(r["doc_id"] for r in second.filter("doc_id IS NOT NULL").collect()) == sorted(i for i, (_, c) in brute_components(rows).items() if i == c)
    assert second.dtypes == docs.dtypes
    third = P.repeats(spark, second, SF_SMALL)
    left = [r for r in brute_substrings([(r["doc_id"], r["text"]) for r in second.collect()], 20) if r[1] > r[2]]
    assert sorted((r["doc_id"] for r in third.collect()), key=str) == sorted((r[0] for r in left), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in third.collect()) and third.dtypes == docs.dtypes
    fourth = P.mixed(spark, third, SF_SMALL)
    assert fourth.dtypes == docs.dtypes and {r["doc_id"] for r in fourth.collect()} <= {r["doc_id"] for r in third.collect()}
    fifth = P.packed(spark, fourth, SF_SMALL)
    assert {r["doc_id"] for r in fifth.collect()} == {r["doc_id"] for r in fourth.collect()}


def test_rows_that_share_an_id_are_not_lost(spark):
    """Unlike texts under one doc_id, copies without a doc_id, equal rows."""
    w = [" ".join(f"t{i}w{k}" for k in range(40)) for i in range(6)]
    rows = [(7, w[0]), (7, w[1]), (7, w[1]), (8, w[1] + " more"), (3, w[2]), (9, w[2]), (None, w[3]), (None, w[3]), (None, w[4]), (5, w[4]), (None, w[5]), (1, "a b")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = sorted(((r.doc_id, r.text) for r in P.duplicates(spark, df, SF_SMALL).collect()), key=str)
    assert got == sorted([(7, w[0]), (7, w[1]), (3, w[2]), (None, w[3]), (5, w[4]), (None, w[5]), (1, "a b")], key=str)


def test_run_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    assert P.language(spark, docs, SF_SMALL).count() >= 0.99 * docs.count()
    assert P.run(spark, SF_SMALL).count() > 0


def test_empty(spark, no_docs):
    for _, f in P.STAGES:
        assert f(spark, no_docs, SF_SMALL).count() == 0
