import random

import public_tokenizers
import pytest

from wattlane.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    return tokens.load_tokenizer(PATH)


def test_proof_is_the_library_s(tok):
    whole = tokens.prove_whole(tok)
    some = random.Random(0).sample(sorted(whole), 500)
    assert all(tok.encode(s, add_special_tokens=False).ids == [whole[s]] for s in some)
    # some vocabulary strings do not encode as themselves
    assert 0 < len(tok.get_vocab()) - len(whole) < 1000


def test_merge_engine_equals_library(tok):
    merge = tokens.merge_engine(tok)
    assert merge is not None
    rng = random.Random(1)
    for _ in range(3000):
        s = "".join(rng.choice("abcdefghijklmnoprstuwyzéèçßñABE'.,") for _ in range(rng.randint(1, 14)))
        for p in tokens._PRE.findall(" " + s):
            assert merge(p) == tok.encode(p, add_special_tokens=False).ids


def test_units_equal_library_on_odd_texts(tok):
    enc = tokens.UnitEncoder(PATH, lambda ids: ids)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab 1\n\t'sé\u00a0\u3000\u2028\x1c\x85日😀.\u0558") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["it's we'll  they'd 'x", "   lead", "trail   ", "\n\n\n a\n b", "a" * 3000, "\x00\x01", "<|endoftext|>", "a <|endoftext|>b <|endo"]
    for t in texts:
        units = enc.units(t)
        mine = enc.whole_text(t) if units is None else sum(units, [])
        assert mine == tok.encode(t, add_special_tokens=False).ids, t


def test_small_cache_gives_the_same(tok, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50_000)
    enc = tokens.UnitEncoder(PATH, len)
    t = " ".join(f"wörd{i}x" for i in range(3000))
    assert sum(enc.units(t)) == sum(enc.units(t)) == len(tok.encode(t, add_special_tokens=False).ids)


def test_counts(spark, docs, no_docs, corpus, tok):
    got = tokens.count_tokens(docs, PATH).collect()
    assert [c for c in tokens.count_tokens(docs, PATH).columns] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in corpus)
    assert sorted(tuple(r)[:3] for r in got if r[0] is not None) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got) and len(got) == len(want) + 1
    assert tokens.count_tokens(no_docs, PATH).count() == 0
