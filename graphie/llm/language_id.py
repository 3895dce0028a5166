"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in both directions, labels every position with a
distribution over the learned languages, and a document's probabilities are the mean over its
positions. It is trained in numpy by backpropagation through time on the driver, from a sample of
labelled rows of bounded size (``SAMPLE`` rows a language, a slice of ``SLICE`` characters each).

For prediction, texts are cut into lanes of ``LANE`` bytes that run side by side; each position
sees its lane in both directions. Every byte of every text is read, memory is bounded by a batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphie.llm.toxicity import pieces

SAMPLE, SLICE, CLASSES = 512, 1024, 16
HIDDEN, LANE, SIDE_BY_SIDE = 8, 128, 2048
STEPS, BATCH, TRAIN_LANE = 300, 128, 48
LETTER = re.compile(r"[^\W\d_]")  # takes other numbers, as ½ or Ⅷ, for letters


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in LETTER.finditer(text))


def softsign(x: np.ndarray) -> np.ndarray:
    """x / (1 + abs(x)) in place: the bounded function of gates and states, several times cheaper than tanh."""
    room = np.abs(x)
    room += 1
    x /= room
    return x


def gru(table: np.ndarray, u: np.ndarray, bias: np.ndarray, codes: np.ndarray, keep: bool = False):
    """States [T, H, B] of one direction for byte codes [T, B]; gates as well where asked.

    ``table`` [3H, 256] holds the input weights of each byte, ``u`` [3H, H] the recurrent ones.
    """
    h3, (steps, lanes) = len(table), codes.shape
    n = h3 // 3
    states, h, gates = np.empty((steps, n, lanes), table.dtype), np.zeros((n, lanes), table.dtype), []
    for t in range(steps):
        x, y = table[:, codes[t]], u @ h
        zr = x[: 2 * n] + y[: 2 * n]
        softsign(zr)
        zr *= 0.5
        zr += 0.5
        inner = y[2 * n :] + bias
        new = zr[n:] * inner
        new += x[2 * n :]
        softsign(new)
        if keep:
            gates.append((zr, inner, new, h))
        h = new + zr[:n] * (h - new)
        states[t] = h
    return (states, gates) if keep else states


def gru_back(u: np.ndarray, codes: np.ndarray, gates: list, grad: np.ndarray):
    """Gradients of table, u and bias, from the gradient of every state: backpropagation through time."""
    n = u.shape[1]
    g_table, g_u, g_bias = np.zeros((3 * n, 256)), np.zeros_like(u, dtype=float), np.zeros((n, 1))
    carry = np.zeros_like(grad[0])
    for t in range(len(gates) - 1, -1, -1):
        zr, inner, new, before = gates[t]
        z, r = zr[:n], zr[n:]
        d = grad[t] + carry
        d_new = d * (1 - z) * (1 - np.abs(new)) ** 2
        d_z = d * (before - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        d_r = d_new * inner * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_x = np.concatenate([d_z, d_r, d_new])
        d_y = np.concatenate([d_z, d_r, d_new * r])
        carry = d * z + u.T @ d_y
        g_u += d_y @ before.T
        g_bias += (d_new * r).sum(axis=1, keepdims=True)
        np.add.at(g_table.T, codes[t], d_x.T)
    return g_table, g_u, g_bias


def softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


class Network:
    """Weights of both directions and of the position labels, for ``langs``."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]):
        self.langs, self.weights = langs, weights

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities [T, languages, B] of every position."""
        w = self.weights
        ahead = gru(w["table0"], w["u0"], w["bias0"], codes)
        back = gru(w["table1"], w["u1"], w["bias1"], codes[::-1])[::-1]
        e = w["v0"] @ ahead
        e += w["v1"] @ back
        e += w["c"]
        np.exp(np.clip(e, -60, 60, out=e), out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities [documents, languages] over all bytes; 0 for an empty text."""
        sizes = np.array([len(t) for t in texts], np.int64)
        lanes = -(-sizes // LANE)
        starts = np.r_[0, np.cumsum(lanes)]
        codes = np.zeros((starts[-1], LANE), np.uint8)
        flat = codes.reshape(-1)
        for t, s in zip(texts, starts):
            flat[s * LANE : s * LANE + len(t)] = np.frombuffer(t, np.uint8)
        live = np.full(starts[-1], LANE, np.int64)
        full = lanes > 0
        live[starts[1:][full] - 1] = sizes[full] - (lanes[full] - 1) * LANE
        sums = np.zeros((starts[-1], len(self.langs)))
        order = np.argsort(-live, kind="stable")  # lanes that end early run beside each other
        for at in range(0, len(order), SIDE_BY_SIDE):
            rows = order[at : at + SIDE_BY_SIDE]
            steps = int(live[rows].max())
            block = np.ascontiguousarray(codes[rows, :steps].T)
            p = self.positions(block)
            if live[rows].min() < steps:
                p = p * (np.arange(steps)[:, None] < live[rows])[:, None, :]
            sums[rows] = p.sum(axis=0).T
        out = np.zeros((len(texts), len(self.langs)))
        if full.any():
            out[full] = np.add.reduceat(sums, starts[:-1][full], axis=0) / sizes[full, None]
        return out


def train(samples: list[tuple[bytes, str]], seed: int = 5) -> Network:
    """Fit on (bytes, language). One language or none gives a network that always says it, or nothing.

    A language that has only empty texts is not learned, and the others are learned without it.
    """
    langs = sorted({lang for t, lang in samples if t})
    rng, n, k = np.random.default_rng(seed), HIDDEN, max(1, len(langs))
    w = {"c": np.zeros((k, 1))}
    for d in "01":
        w[f"table{d}"] = rng.normal(0, 0.3, (3 * n, 256))
        w[f"u{d}"] = rng.normal(0, 1 / np.sqrt(n), (3 * n, n))
        w[f"bias{d}"] = np.zeros((n, 1))
        w[f"v{d}"] = rng.normal(0, 0.3, (k, n))
    w = {name: x.astype(np.float32) for name, x in w.items()}
    of = {lang: [np.frombuffer(t, np.uint8) for t, own in samples if own == lang and t] for lang in langs}
    if len(langs) < 2:
        return Network(langs, w)
    mean, square = {name: np.zeros_like(x) for name, x in w.items()}, {name: np.zeros_like(x) for name, x in w.items()}
    for step in range(1, STEPS + 1):
        labels = rng.integers(0, k, BATCH)
        codes = np.full((TRAIN_LANE, BATCH), 32, np.uint8)
        for b, y in enumerate(labels):
            t = of[langs[y]][rng.integers(len(of[langs[y]]))]
            at = rng.integers(max(1, len(t) - TRAIN_LANE + 1))
            part = t[at : at + TRAIN_LANE]
            codes[: len(part), b] = part
        ahead, gates0 = gru(w["table0"], w["u0"], w["bias0"], codes, keep=True)
        back, gates1 = gru(w["table1"], w["u1"], w["bias1"], codes[::-1], keep=True)
        p = softmax(w["v0"] @ ahead + w["v1"] @ back[::-1] + w["c"], 1)
        d = p
        d[:, labels, np.arange(BATCH)] -= 1
        d /= TRAIN_LANE * BATCH
        g = {"c": d.sum(axis=(0, 2))[:, None], "v0": np.einsum("tkb,thb->kh", d, ahead), "v1": np.einsum("tkb,thb->kh", d, back[::-1])}
        g["table0"], g["u0"], g["bias0"] = gru_back(w["u0"], codes, gates0, w["v0"].T @ d)
        g["table1"], g["u1"], g["bias1"] = gru_back(w["u1"], codes[::-1], gates1, (w["v1"].T @ d)[::-1])
        rate = 0.03 * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for name, x in w.items():  # Adam
            mean[name] = 0.9 * mean[name] + 0.1 * g[name]
            square[name] = 0.99 * square[name] + 0.01 * g[name] ** 2
            x -= (rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Network(langs, w)


def fit_languages(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network:
    """Train on rows for which ``usable`` holds and that have a language and a text that is not empty.

    At most ``SAMPLE`` rows a language are read, the first of each of ``CLASSES`` classes of their hash, a
    slice at a hashed place of each. The rank limit applies before the shuffle, so a common language is no
    hot group.
    """
    h = F.xxhash64(F.col(key), F.length(text))
    at = F.pmod(h, F.greatest(F.lit(1), F.length(text) - SLICE)) + 1
    rows = docs.filter(usable & (F.col(text) != "") & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("_lang"), F.substring(F.col(text), at.cast("int"), F.lit(SLICE)).alias("_slice"), h.alias("_h"))
    first = Window.partitionBy("_lang", F.pmod("_h", F.lit(CLASSES))).orderBy("_h", "_slice")
    rows = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= SAMPLE // CLASSES).orderBy("_lang", "_h", "_slice")
    return train([(r["_slice"].encode("utf-8", "surrogatepass"), r["_lang"]) for r in rows.select("_lang", "_slice").toLocalIterator()])


def predict_languages(docs: DataFrame, network: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``, the mean probability of that language.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go to
    the language first by code point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(batch.num_columns - 1)
            for at, n in pieces(cells):
                texts = cells.slice(at, n).to_pylist()
                lettered = np.array([has_letter(t) for t in texts]) & bool(network.langs)
                names, scores = ["und"] * n, np.zeros(n)
                if lettered.any():
                    rows = np.flatnonzero(lettered)
                    p = network.documents([texts[i].encode("utf-8", "surrogatepass") for i in rows])
                    scores[rows] = np.minimum(1.0, p.max(axis=1))
                    for i, j in zip(rows, p.argmax(axis=1)):
                        names[i] = network.langs[j]
                held = [batch.column(i).slice(at, n) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, lang_pred string, score double")
