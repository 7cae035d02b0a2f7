import numpy as np

from wattlane.llm import langid

TRAIN = {"xx": "lorem dolor amet ipsum sit ", "yy": "kraz bqoz wixk yaxz puzk ", "zz": "ñandú año señal mañana "}


def rows(n=80):
    rng = np.random.default_rng(0)
    out = []
    for i in range(n * 3):
        lang = list(TRAIN)[i % 3]
        w = TRAIN[lang].split()
        out.append((i, " ".join(rng.choice(w, rng.integers(3, 40))), lang))
    return out


def test_gradients():
    net = langid.Net.start(["a", "b", "c"], 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids = np.random.default_rng(0).integers(0, 256, (6, 4))
    ids[4:, 1] = langid.PAD
    y = np.array([0, 2, 1, 1])
    _, grads = langid.loss_and_grads(net, ids, y)
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e, ends = net.w[k][i], 1e-4, []
        for s in (e, -e):
            net.w[k][i] = old + s
            ends.append(langid.loss_and_grads(net, ids, y)[0])
        net.w[k][i] = old
        assert abs((ends[0] - ends[1]) / (2 * e) - g[i]) < 1e-4


def test_reader_equals_training_forward():
    """Position probabilities of the fast reader are those of the trainer's
    network, pads included."""
    net = langid.Net.start(["a", "b"], 8, seed=3)
    texts = [b"hello there", b"abc", "é".encode() * 5, b""]
    got = langid.Reader(net).documents(texts)
    for t, p in zip(texts, got):
        if not t:
            assert not p.any()
            continue
        ids = np.frombuffer(t, np.uint8).astype(np.int64)[:, None]
        f, _ = langid._unroll(net.w, "f", ids)
        b, _ = langid._unroll(net.w, "b", ids[::-1])
        z = net.w["o"] @ np.concatenate([f, b[::-1]], 1) + net.w["ob"]
        q = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        assert np.allclose(q.mean(0)[:, 0], p, atol=1e-4)


def test_held_out_accuracy_and_edges(spark, no_docs):
    data = rows() + [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 !!", "yy"), (1003, "kraz " * 5000, None), (None, "kraz bqoz", "yy")]
    df = spark.createDataFrame([(*r, "s", r[0]) for r in data], "doc_id long, text string, lang string, held_out string, score long")
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    right = [out[i]["lang_pred"] == lang for i, _, lang in rows() if out[i]["held_out"]]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert out[1003]["lang_pred"] == out[None]["lang_pred"] == "yy" and not out[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert langid.identify(no_docs).count() == 0
    unlabelled = df.withColumn("lang", df["lang"].substr(0, 0)).selectExpr("doc_id", "text", "CAST(NULL AS STRING) lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_crc_fold(spark):
    import zlib
    df = spark.range(200).selectExpr("id AS doc_id")
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in df.select("doc_id", langid.held_out()).collect())
