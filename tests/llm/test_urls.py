import numpy as np

from wattlane.llm import urls

# url -> host, path, rule
CASES = {
    None: ("", "", None), "": ("", "", None), "no scheme/x": ("", "", None), "http://A.Org/": ("a.org", "/", "org/"),
    "http://A.ORG": ("a.org", "", None), "http://org/x?y=/es/": ("org", "/x", "org/"), "ftp://EXAMPLE.org/es/1#a": ("example.org", "/es/1", "example.org/es/"),
    "http://notexample.org/es/": ("notexample.org", "/es/", "org/"), "http://a.example.org/en/1/é": ("a.example.org", "/en/1/é", "example.org/en/1"),
    "x://com/de/": ("com", "/de/", "com/de/"), "http://a.com?/fr/": ("a.com", "", None), "http://b.com/fr/z://q": ("b.com", "/fr/z://q", "com/fr/"),
    "http://b.com/FR/": ("b.com", "/FR/", None), "http://É.net#x": ("É.net", "", None), "http://q.net/" + "a" * 9000: ("q.net", "/" + "a" * 9000, None),
}


def test_rules(spark):
    rows = [(i, u, "h") for i, u in enumerate(CASES)] * 2 + [(None, "http://a.org/", None)]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(out) == len(rows)
    wants = list(CASES.values())
    verdicts = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    for r in out:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == wants[r["page_id"]]
        assert r["verdict"] == verdicts[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block")
        assert (r["score"] is None) == (r["rule"] is not None)


def test_model_counts_by_hand():
    """Order 0 and 1 probabilities of a two-letter alphabet."""
    tables = np.zeros((2, 1 << 16))
    for c, text in enumerate((b"aaab", b"bbba")):
        _, grams, contexts = urls._cells([text], 1, 16)
        tables[c] += np.bincount(np.concatenate([grams.ravel(), contexts.ravel()]), minlength=1 << 16)

    def p(text, s):
        n0 = {b: text.count(bytes([b])) for b in b"ab"}
        out, before = 0.0, 0
        for b in s:
            q = (n0[b] + 2 / 256) / (len(text) + 2)
            pairs = list(zip([0, *text], text))
            q = (pairs.count((before, b)) + 2 * q) / (sum(x == before for x, _ in pairs) + 2)
            out, before = out + np.log(q), b
        return out
    got = urls.log_ratio([b"ab", b"", b"bb"], tables, 1)
    want = [(p(b"bbba", s) - p(b"aaab", s)) / max(len(s), 1) for s in (b"ab", b"", b"bb")]
    assert np.allclose(got, want)


def test_separates_held_out_urls(spark):
    rng = np.random.default_rng(0)
    name = lambda letters: "".join(rng.choice(list(letters), 8))
    rows = [f"http://{name('abcde')}.org/{name('abcde')}" for _ in range(300)] + [f"http://{name('vwxyz')}.com/de/{name('vwxyz')}" for _ in range(300)]
    unknown = [(f"http://{name('abcde')}.net/{name('abcde')}", "allow") for _ in range(50)] + [(f"http://{name('vwxyz')}.net/{name('vwxyz')}", "block") for _ in range(50)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(rows + [u for u, _ in unknown])], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df).collect()}
    right = [got[len(rows) + i] == v for i, (_, v) in enumerate(unknown)]
    assert np.mean(right) > 0.9


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.org/"), (2, "http://a.net/"), (3, None)], "page_id long, url string")
    assert {r["verdict"] for r in urls.filter_urls(df).collect()} == {"allow"}
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_threshold():
    assert urls.calibrated_threshold([]) == 0.0
    assert 0.1 < urls.calibrated_threshold([(10, 0, 5), (30, 1, 5)]) <= 0.31


def test_counts_stay_exact_beyond_a_million_ngrams(spark):
    """More distinct n-grams than a fixed table of 2**20 cells holds."""
    rng = np.random.default_rng(1)
    name = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789-_"), n))
    ruled = [f"http://a.org/{name(300)}" for _ in range(500)] + [f"http://b.com/de/{name(300)}" for _ in range(500)]
    free = [f"http://c.net/{name(60)}" for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(ruled + free)), "page_id long, url string")
    got = {r["page_id"]: r["score"] for r in urls.filter_urls(df).collect()}
    counts = [{}, {}]
    for u in set(ruled):
        c = counts["a.org" in u]
        t = "\0" * urls.ORDER + u.split("://")[1]
        for i in range(urls.ORDER, len(t)):
            for k in range(urls.ORDER + 1):
                for g in ((k, t[i - k:i]), (k, t[i - k:i + 1])):
                    c[g + (len(g[1]) > k,)] = c.get(g + (len(g[1]) > k,), 0) + 1
    assert sum(map(len, counts)) > 1 << 20
    for j, u in enumerate(free):
        t, logs = "\0" * urls.ORDER + u.split("://")[1], []
        for c in counts:
            total = 0.0
            for i in range(urls.ORDER, len(t)):
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    p = (c.get((k, t[i - k:i + 1], True), 0) + urls.STRENGTH * p) / (c.get((k, t[i - k:i], False), 0) + urls.STRENGTH)
                total += np.log(p)
            logs.append(total)
        assert abs(got[len(ruled) + j] - (logs[1] - logs[0]) / (len(t) - urls.ORDER)) < 1e-9
