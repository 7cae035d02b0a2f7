"""Language ID by a bidirectional gated recurrent network over bytes
(operator 4).

Every byte of a text is a position. Two gated recurrent units read the
bytes, one from each side; a softmax over both states labels each position
with a language, and a document's probability of a language is the mean
over all its positions. Long texts are cut into segments of ``SEGMENT``
bytes (the states start at zero in each); no byte is left out.

Training is backpropagation through time with Adam, in numpy, on a bounded
sample: at most ``rows_per_lang`` labelled rows a language (smallest hash
of doc_id and text), ``SLICES`` slices of ``STEPS`` bytes from each.
Prediction is one pass over the documents with no shuffle; whole batches of
segments move through the network as matrices, feature-major so that the
gates are contiguous.

A null text or one without a letter is ``und`` with score 0, as is every
text when nothing could be learned. Ties take the first language in
code-point order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattlane.llm.common import portions

UND = "und"
HIDDEN = 8
STEPS = 48
SLICES = 4
SEGMENT = 256
BLOCK = 4096
ROWS_PER_LANG = 800
EPOCHS = 6
PAD = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Net:
    """langs and the weights: per direction the byte table (3H x 257: update,
    reset, candidate), the recurrent matrix (3H x H) and the candidate's
    recurrent bias (H x 1); then the output matrix (K x 2H) and bias."""

    langs: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def start(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Net:
        g = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w["x" + d] = g.normal(0, 0.3, (3 * hidden, 257)).astype(np.float32)
            w["u" + d] = g.normal(0, hidden ** -0.5, (3 * hidden, hidden)).astype(np.float32)
            w["c" + d] = np.zeros((hidden, 1), np.float32)
        w["o"] = g.normal(0, 0.3, (len(langs), 2 * hidden)).astype(np.float32)
        w["ob"] = np.zeros((len(langs), 1), np.float32)
        return cls(langs, w)


def _unroll(w: dict, d: str, ids: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T x H x B) of one direction over ids (T x B), in reading
    order, with what backpropagation needs."""
    x, u, c = w["x" + d], w["u" + d], w["c" + d]
    n = u.shape[1]
    h = np.zeros((n, ids.shape[1]), np.float32)
    states, trace = [], []
    for row in ids:
        a, g = x[:, row], u @ h
        z, r = sigmoid(a[:n] + g[:n]), sigmoid(a[n:2 * n] + g[n:2 * n])
        gn = g[2 * n:] + c
        cand = np.tanh(a[2 * n:] + r * gn)
        trace.append((h, z, r, gn, cand))
        h = cand + z * (h - cand)
        states.append(h)
    return np.stack(states), trace


def _back(w: dict, grads: dict, d: str, ids: np.ndarray, trace: list, dstates: np.ndarray) -> None:
    """Backpropagation through time of one direction."""
    u = w["u" + d]
    n = u.shape[1]
    dh = np.zeros_like(dstates[0])
    da_all = np.empty((len(ids), 3 * n, ids.shape[1]), np.float32)
    du, dc = np.zeros_like(u), np.zeros_like(w["c" + d])
    for t in range(len(ids) - 1, -1, -1):
        h, z, r, gn, cand = trace[t]
        dh = dh + dstates[t]
        dn = dh * (1 - z) * (1 - cand * cand)
        da = da_all[t]
        da[:n] = dh * (h - cand) * z * (1 - z)
        da[n:2 * n] = dn * gn * r * (1 - r)
        da[2 * n:] = dn
        dg = da.copy()
        dg[2 * n:] *= r
        du += dg @ h.T
        dc += dg[2 * n:].sum(1, keepdims=True)
        dh = dh * z + u.T @ dg
    flat = ids.ravel()
    cols = da_all.transpose(1, 0, 2).reshape(3 * n, -1)
    grads["x" + d] = np.stack([np.bincount(flat, c, 257) for c in cols]).astype(np.float32)
    grads["u" + d], grads["c" + d] = du, dc


def loss_and_grads(net: Net, ids: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the real positions of ids (T x B; PAD where a
    slice is shorter) against the slices' languages y, and its gradients."""
    w = net.w
    f, ftrace = _unroll(w, "f", ids)
    b, btrace = _unroll(w, "b", ids[::-1])
    b = b[::-1]
    hidden = f.shape[1]
    both = np.concatenate([f, b], 1)                       # T x 2H x B
    logits = w["o"] @ both + w["ob"]
    logits -= logits.max(1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(1, keepdims=True)
    real = (ids != PAD).astype(np.float32)
    total = max(real.sum(), 1.0)
    pick = p[:, y, np.arange(len(y))]
    loss = float(-(np.log(pick + 1e-9) * real).sum() / total)
    p[:, y, np.arange(len(y))] -= 1
    p *= real[:, None, :] / total
    grads = {"o": np.einsum("tkb,thb->kh", p, both, optimize=True), "ob": p.sum((0, 2))[:, None]}
    dboth = w["o"].T @ p
    _back(w, grads, "f", ids, ftrace, dboth[:, :hidden])
    _back(w, grads, "b", ids[::-1], btrace, dboth[::-1, hidden:])
    return loss, grads


def train(slices: list[bytes], labels: list[str], epochs: int = EPOCHS, batch: int = 256,
          rate: float = 0.015, hidden: int = HIDDEN, seed: int = 7) -> Net | None:
    """A net fitted on labelled byte slices; None without any."""
    data = sorted((lab, s[:STEPS]) for lab, s in zip(labels, slices) if s)
    if not data:
        return None
    langs = sorted({lab for lab, _ in data})
    net = Net.start(langs, hidden, seed)
    at = {lab: i for i, lab in enumerate(langs)}
    y = np.array([at[lab] for lab, _ in data])
    ids = np.full((len(data), STEPS), PAD, np.int64)
    for i, (_, s) in enumerate(data):
        ids[i, :len(s)] = np.frombuffer(s, np.uint8)
    g = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.w.items()}
    steps = epochs * -(-len(data) // batch)
    done = 0
    for _ in range(epochs):
        order = g.permutation(len(data))
        for i in range(0, len(data), batch):
            take = order[i:i + batch]
            _, grads = loss_and_grads(net, ids[take].T, y[take])
            done += 1
            lr = rate * (1 - done / (steps + 1))
            for k, dw in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * dw
                v2[k] = 0.99 * v2[k] + 0.01 * dw * dw
                net.w[k] -= (lr * (m[k] / (1 - 0.9 ** done)) / (np.sqrt(v2[k] / (1 - 0.99 ** done)) + 1e-6)).astype(np.float32)
    return net


class Reader:
    """Position labels of many segments at once."""

    def __init__(self, net: Net):
        self.w = {k: v.astype(np.float32) for k, v in net.w.items()}
        self.n = n = net.w["uf"].shape[1]
        self.k = len(net.langs)
        for d in "fb":
            # tanh(x / 2) / 2 + 1 / 2 is the sigmoid: halve those rows once
            self.w["x" + d][:2 * n] *= 0.5
            self.w["u" + d][:2 * n] *= 0.5
            self.w["x" + d][:, PAD] = 0
            self.w["x" + d][:n, PAD] = 30       # a pad keeps the state

    def _step(self, d: str, ids: np.ndarray, h: np.ndarray, a: np.ndarray, g: np.ndarray) -> np.ndarray:
        n, w = self.n, self.w
        np.take(w["x" + d], ids, axis=1, out=a, mode="clip")
        np.matmul(w["u" + d], h, out=g)
        zr = a[:2 * n]
        zr += g[:2 * n]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        gn, cand = g[2 * n:], a[2 * n:]
        gn += w["c" + d]
        gn *= zr[n:]
        cand += gn
        np.tanh(cand, out=cand)
        out = h - cand
        out *= zr[:n]
        out += cand
        return out

    def sums(self, ids: np.ndarray) -> np.ndarray:
        """K x B sums of the position probabilities of ids (T x B)."""
        steps, width = ids.shape
        n = self.n
        a, g = np.empty((3 * n, width), np.float32), np.empty((3 * n, width), np.float32)
        states = np.empty((steps, n, width), np.float32)
        h = np.zeros((n, width), np.float32)
        for t in range(steps):
            h = states[t] = self._step("f", ids[t], h, a, g)
        of, ob, bias = self.w["o"][:, :n], self.w["o"][:, n:], self.w["ob"]
        total = np.zeros((self.k, width), np.float64)
        h = np.zeros((n, width), np.float32)
        for t in range(steps - 1, -1, -1):
            h = self._step("b", ids[t], h, a, g)
            p = of @ states[t]
            p += ob @ h
            p += bias
            p -= p.max(0)
            np.exp(p, out=p)
            p *= (ids[t] != PAD) / p.sum(0)
            total += p
        return total

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """len(texts) x K mean position probabilities (0 without bytes)."""
        out = np.zeros((len(texts), self.k))
        lengths = np.array([len(t) for t in texts], np.int64)
        if not lengths.sum():
            return out
        data = np.frombuffer(b"".join(texts), np.uint8)
        cuts = -(-lengths // SEGMENT)
        doc = np.repeat(np.arange(len(texts)), cuts)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = (np.cumsum(lengths) - lengths)[doc] + nth * SEGMENT
        size = np.minimum(lengths[doc] - nth * SEGMENT, SEGMENT)
        order = np.argsort(size, kind="stable")
        for i in range(0, len(order), BLOCK):
            take = order[i:i + BLOCK]
            steps = np.arange(int(size[take].max()))[:, None]
            ids = data[np.minimum(start[take] + steps, len(data) - 1)].astype(np.int64)
            ids[steps >= size[take]] = PAD
            s = self.sums(ids)
            for k in range(self.k):
                out[:, k] += np.bincount(doc[take], s[k], len(texts))
        return out / np.maximum(lengths, 1)[:, None]


def training_slices(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """lang and slice (text) of the bounded training sample: of each
    language the ``rows_per_lang`` rows with the smallest hash."""
    known = docs.filter(F.col("lang").isNotNull())
    # rows whose hash cannot be among the smallest stay out of the shuffle;
    # one row a language (the network has an output for each): bounded
    rate = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(4.0 * rows_per_lang) / F.count("*")).alias("_rate"))
    h = F.xxhash64("doc_id", "text")
    unit = F.pmod(h, F.lit(1 << 40)) / float(1 << 40)
    # the slices are cut before the rows are ranked: whole texts never move
    parts = F.transform(F.sequence(F.lit(0), F.lit(SLICES - 1)),
                        lambda i: F.substring(F.col("text"), (F.length("text") * i / SLICES).cast("int") + 1, F.lit(STEPS)))
    rows = (known.filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", unit.alias("_u"), h.alias("_h"))
            .join(F.broadcast(rate), "lang").filter(F.col("_u") < F.col("_rate")))
    pick = Window.partitionBy("lang").orderBy("_u", "_h")
    return (rows.select("lang", "_u", "_h", F.array_distinct(parts).alias("parts"))
            .withColumn("_n", F.row_number().over(pick)).filter(F.col("_n") <= rows_per_lang)
            .select("lang", F.explode("parts").alias("slice")))


def fit(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Net | None:
    """Train on ``docs`` (text, lang; doc_id only breaks ties of the sample)."""
    rows = training_slices(docs, rows_per_lang).collect()  # bounded: languages x rows x slices
    return train([r["slice"].encode() for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, net: Net | None, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, ``keep`` columns (``text`` may be one), lang_pred and score
    of every row."""
    names = ["doc_id", *keep]
    src = docs.select(F.col("doc_id").cast("long"), *(c for c in keep if c != "text"), "text",
                      F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    if net is None:
        return src.select(*names, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = src.select(*names, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net)
        for b in portions(batches, 4096):
            read = b.column("_letter").to_pylist()
            texts = [t.encode() if r else b"" for t, r in zip(b.column("text").to_pylist(), read)]
            p = reader.documents(texts)
            best = p.argmax(1)
            lang = [net.langs[i] if r else UND for i, r in zip(best, read)]
            score = np.where(read, p[np.arange(len(best)), best], 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*names, "lang_pred", "score"])
    return src.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 4, is 2 (false for a null doc_id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score: trained on the rows that are not
    held out, predicted for all."""
    marked = docs.withColumn("held_out", held_out())
    net = fit(marked.filter(~F.col("held_out")), rows_per_lang)
    return predict(marked, net, ("held_out",))
