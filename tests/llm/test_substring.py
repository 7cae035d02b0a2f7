import hashlib

import pytest
from pyspark.sql import functions as F

from wattlane.llm import substring


def brute(rows, window):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            q = tuple(w[k:k + window])
            if q in seen:
                gone[k:k + window] = [True] * window
            seen.add(q)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 7, 2])
def test_equals_brute_force(docs, corpus, window):
    out = substring.dedup_substrings(docs, window)
    got = out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(corpus + [(None, "no id " * 30)], window)
    assert any(r[2] for r in got)


def test_small_packs_meet_across(docs, corpus, monkeypatch):
    monkeypatch.setattr(substring, "PACK_BYTES", 2000)
    out = substring.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(corpus + [(None, "no id " * 30)], 20)


def test_keeps_columns_and_empty_table(docs, no_docs):
    out = substring.dedup_substrings(docs, keep=["lang", "source"])
    assert out.columns == ["doc_id", "lang", "source", "n_words", "n_removed", "kept_text"]
    assert out.filter("doc_id IS NULL AND source IS NULL").count() == 1
    assert substring.dedup_substrings(no_docs).count() == 0


def test_text_exchange_is_shared(docs):
    out = substring.dedup_substrings(docs)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 2
