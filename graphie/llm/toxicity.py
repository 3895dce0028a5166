"""Toxicity: a linear-chain conditional random field over words.

Documents carry one label each, so the words of the training documents are labelled first: a word
is toxic where its document is toxic and its form is far more frequent in toxic documents than in
clean ones. A two-state chain is trained on these sequences (word and affix features, transitions;
exact gradients by forward-backward, in numpy). For a whole text, forward-backward gives each word
its marginal; the marginals are summed to a document score by a logistic fit on the training
documents, and words above one half are the offending ones, with their offsets.

Training reads a sample of labelled rows of bounded number (``SAMPLE`` rows at most); scoring reads
every word of every text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 4000
DIMS = 1 << 16
WINDOW = 64
SPANS = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = b".,;:!?\"'()[]{}<>*_-"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; bytes split at the same six characters as ``SPANS``."""
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def features(word: bytes) -> tuple[int, int, int, int]:
    """Hashed form, beginning and end of a word, and place 0, which all words have."""
    w = word.strip(TRIM)
    return 1 + crc32(w) % (DIMS - 1), 1 + crc32(w[:4], 1) % (DIMS - 1), 1 + crc32(w[-4:], 2) % (DIMS - 1), 0


def forward_backward(unary: np.ndarray, trans: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals [B, T, 2], expected transitions [2, 2] and the log partition sum, over padded sequences."""
    b, t, _ = unary.shape
    peak = unary.max(axis=2, keepdims=True)
    e, m = np.exp(unary - peak), np.exp(trans)
    alpha, scale = np.empty_like(e), np.ones((b, t))
    a = e[:, 0]
    for i in range(t):
        if i:
            a = np.where(live[:, i, None], (alpha[:, i - 1] @ m) * e[:, i], alpha[:, i - 1])
        s = a.sum(axis=1, keepdims=True)
        alpha[:, i], scale[:, i] = a / s, np.where(live[:, i], s[:, 0], 1.0)
    beta = np.ones_like(e)
    for i in range(t - 2, -1, -1):
        back = (e[:, i + 1] * beta[:, i + 1]) @ m.T / scale[:, i + 1, None]
        beta[:, i] = np.where(live[:, i + 1, None], back, 1.0)
    marg = alpha * beta
    marg /= marg.sum(axis=2, keepdims=True)
    pair = np.zeros((2, 2))
    if t > 1:
        w = (live[:, 1:] / scale[:, 1:])[:, :, None]
        pair = np.einsum("bti,btj->ij", alpha[:, :-1], e[:, 1:] * beta[:, 1:] * w) * m
    return marg, pair, float((np.log(scale) + peak[:, :, 0] * live).sum())


class Model:
    def __init__(self, weights: np.ndarray, trans: np.ndarray, fit: np.ndarray):
        self.weights, self.trans, self.fit = weights, trans, fit

    def score(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        x = np.stack([np.ones_like(sums), np.log1p(sums), sums / np.maximum(words, 1) * 10, np.minimum(sums, 1)], axis=1)
        return 1 / (1 + np.exp(-np.clip(x @ self.fit, -30, 30)))


def stem(form: bytes) -> bytes:
    return form[:5] + b"*"


def toxic_forms(docs: list[tuple[str, int]], share: float = 0.02, ratio: float = 8.0) -> set[bytes]:
    """Forms, and stems written ``stem*``, that are frequent in toxic documents.

    They occur in a ``share`` of the toxic documents (three at least), ``ratio`` times as often as in clean ones.
    """

    def forms_of(text: str) -> set[bytes]:
        forms = {w.strip(TRIM) for w in set(words_of(text))} - {b""}
        return forms | {stem(w) for w in forms}

    n = [sum(1 for _, y in docs if y == label) for label in (0, 1)]
    floor = max(3, share * n[1])
    bad: Counter = Counter()
    for text, label in docs:
        if label:
            bad.update(forms_of(text))
    bad = Counter({w: c for w, c in bad.items() if c >= floor})
    clean: Counter = Counter()  # of the forms that are frequent enough, so that what the driver holds stays small
    for text, label in docs:
        if not label:
            clean.update(w for w in forms_of(text) if w in bad)
    return {w for w, c in bad.items() if c / max(n[1], 1) >= ratio * (clean[w] + 0.5) / max(n[0], 1)}


def train(docs: list[tuple[str, int]], rounds: int = 40, rate: float = 0.5) -> Model:
    """Fit on (text, label). Without both labels every score is the share of toxic rows (0 if none)."""
    share = sum(y for _, y in docs) / len(docs) if docs else 0.0
    base = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    if not 0 < share < 1:
        return Model(np.zeros(DIMS), np.zeros((2, 2)), np.array([base if docs else -30.0, 0, 0, 0]))
    bad = toxic_forms(docs)
    rows, rest = [], []  # windows with a toxic word; places of all others, of which only some are made
    for n, (text, label) in enumerate(docs):
        words = words_of(text)
        tags = [int((f := w.strip(TRIM)) in bad or stem(f) in bad) for w in words] if label else [0] * len(words)
        for at in range(0, len(words), WINDOW):
            if any(tags[at : at + WINDOW]):
                rows.append((words[at : at + WINDOW], tags[at : at + WINDOW]))
            else:
                rest.append((n, at))
    step = max(1, len(rest) // (2 * len(rows) + 500))
    for n, places in groupby(rest[::step], key=lambda r: r[0]):
        words = words_of(docs[n][0])
        rows += [(w, [0] * len(w)) for w in (words[at : at + WINDOW] for _, at in places)]
    t = max(len(r[0]) for r in rows)
    tags, live = np.zeros((len(rows), t), np.int64), np.zeros((len(rows), t), bool)
    feats = np.empty((sum(len(r[0]) for r in rows), 4), np.int64)  # of live places only
    at = 0
    for i, (words, ys) in enumerate(rows):
        for w in words:
            feats[at] = features(w)
            at += 1
        tags[i, : len(ys)], live[i, : len(ys)] = ys, True
    del rows, rest
    weights, trans = np.zeros(DIMS), np.zeros((2, 2))
    weights[0] = -3.0  # a word never seen is clean until learned otherwise
    sq_w, sq_t = np.full(DIMS, 1e-6), np.full((2, 2), 1e-6)
    gold_pair = np.zeros((2, 2))
    np.add.at(gold_pair, (tags[:, :-1], tags[:, 1:]), live[:, 1:])
    unary = np.zeros((*live.shape, 2))
    for _ in range(rounds):
        unary[:, :, 1][live] = weights[feats].sum(axis=1)
        marg, pair, _ = forward_backward(unary, trans, live)
        diff = np.repeat((tags - marg[:, :, 1])[live], 4)
        g = np.bincount(feats.ravel(), weights=diff, minlength=DIMS) - 1e-2 * weights
        gt = (gold_pair - pair) - 1e-2 * trans
        sq_w += g * g
        sq_t += gt * gt
        weights += rate * g / np.sqrt(sq_w)
        trans += rate * gt / np.sqrt(sq_t)
    del feats, unary, marg, diff
    model = Model(weights, trans, np.zeros(4))
    sums, counts = marginal_sums([d[0] for d in docs], model, Unary(model, 100_000), cells=250_000)[:2]
    x = np.stack([np.ones_like(sums), np.log1p(sums), sums / np.maximum(counts, 1) * 10, np.minimum(sums, 1)], axis=1)
    y, fit = np.array([d[1] for d in docs], float), np.array([base, 0, 0, 0], float)
    for _ in range(30):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
        fit += np.linalg.solve(h, x.T @ (y - p) - 0.1 * fit)
    model.fit = fit
    return model


class Unary(dict):
    """Weight of a word for the toxic state; words once seen are remembered up to a bound."""

    def __init__(self, model: Model, most: int = 1_000_000):
        super().__init__()
        self.weights, self.most = model.weights, most

    def __missing__(self, word: bytes) -> float:
        a, b, c, d = features(word)
        if len(self) >= self.most:
            self.clear()
        value = self[word] = float(self.weights[a] + self.weights[b] + self.weights[c] + self.weights[d])
        return value


def _messages(odds: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Odds [T, B] of the toxic state at each step given all steps up to it: the forward recursion of a two-state chain."""
    out = np.empty_like(odds)
    out[0] = odds[0]
    for t in range(1, len(odds)):
        r = out[t - 1]
        out[t] = odds[t] * ((m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r))
    return out


def marginals(values: list[np.ndarray], trans: np.ndarray) -> np.ndarray:
    """Toxic marginals [T, B] of sequences of word weights, 0 beyond their ends."""
    t = max(map(len, values))
    ahead, back = np.zeros((t, len(values))), np.zeros((t, len(values)))
    for i, v in enumerate(values):
        ahead[: len(v), i], back[: len(v), i] = v, v[::-1]
    m = np.exp(trans)
    ahead, back = _messages(np.exp(np.clip(ahead, -30, 30)), m), _messages(np.exp(np.clip(back, -30, 30)), m.T)
    p = np.zeros_like(ahead)
    for i, v in enumerate(values):
        n = len(v)
        after = np.ones(n)
        if n > 1:
            r = back[: n - 1, i][::-1]  # odds at the next step given all later ones
            after[:-1] = (m[1, 0] + m[1, 1] * r) / (m[0, 0] + m[0, 1] * r)
        odds = ahead[:n, i] * after
        p[:n, i] = odds / (1 + odds)
    return p


def marginal_sums(texts: list[str | None], model: Model, unary: Unary, spans: bool = False, cells: int = 2_000_000):
    """Sum of toxic marginals and number of words of each text, and where asked the offending spans.

    Texts of like length run side by side, about ``cells`` words at a time; every word of every text takes part.
    """
    values = []
    for text in texts:
        words = words_of(text)
        values.append(np.fromiter(map(unary.__getitem__, words), float, len(words)))
    counts = np.array([len(v) for v in values], float)
    sums, found = np.zeros(len(values)), [[] for _ in values]
    order = np.argsort(counts, kind="stable")
    order = order[np.searchsorted(counts[order], 1) :]
    at = 0
    while at < len(order):
        low = max(64, counts[order[at]])
        after = at + int(np.searchsorted(counts[order[at:]], low * 1.5, "right"))
        after = max(at + 1, min(after, at + max(1, int(cells / (low * 1.5)))))
        group = order[at:after]
        p = marginals([values[g] for g in group], model.trans)
        sums[group] = p.sum(axis=0)
        if spans:
            for i in np.flatnonzero((p > 0.5).any(axis=0)):
                g, hit = group[i], set(np.flatnonzero(p[:, i] > 0.5).tolist())
                found[g] = [(m.start(), m.end()) for j, m in enumerate(SPANS.finditer(texts[g])) if j in hit]
        at = after
    return sums, counts, found


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Train on at most ``SAMPLE`` labelled rows for which ``usable`` holds, chosen by the hash of their id.

    Ids labelled both ways and null labels are left out; a null text is empty. The sample is bounded, so one task
    trains on it; the driver gets the model only.
    """
    marks = labels.filter(F.col(label).isin(0, 1) & usable).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("y2")).filter("y = y2")
    marks = marks.select(F.col(key).alias("_key"), "y").orderBy(F.xxhash64(F.col("_key")), "_key").limit(SAMPLE)
    rows = docs.join(F.broadcast(marks), F.col(key) == F.col("_key")).select(F.coalesce(F.col(text), F.lit("")).alias("t"), "y", "_key")
    rows = rows.groupBy("_key", "y").agg(F.min("t").alias("t")).repartition(1).sortWithinPartitions("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = [(t, int(y)) for batch in batches for t, y in zip(*(c.to_pylist() for c in batch.columns))]
        model = train(sample)
        parts = [pa.array([x.astype(float).tobytes()], pa.binary()) for x in (model.weights, model.trans, model.fit)]
        yield pa.RecordBatch.from_arrays(parts, names=["weights", "trans", "fit"])

    done = rows.select("t", F.col("y").cast("int").alias("y")).mapInArrow(run, "weights binary, trans binary, fit binary").collect()
    if not done:  # a sample that Spark knows to be empty has no task
        return train([])
    weights, trans, fit = (np.frombuffer(x, float).copy() for x in done[0])
    return Model(weights, trans.reshape(2, 2), fit)


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``score`` (0 to 1) and ``toxic_spans`` (code-point offsets of offending words).

    A null or empty text has no words and gets the score of an empty sum.
    """
    shipped = (model.weights.astype(np.float32), model.trans, model.fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(shipped[0].astype(float), shipped[1], shipped[2])
        unary = Unary(own)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            cells = batch.column(batch.num_columns - 1)
            for at, n in pieces(cells):
                texts = cells.slice(at, n).to_pylist()
                sums, counts, found = marginal_sums(texts, own, unary, spans=True)
                scores = own.score(sums, counts)
                spans = pa.array([[{"start": s, "end": e} for s, e in x] for x in found], kind)
                held = [batch.column(i).slice(at, n) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*held, pa.array(scores, pa.float64()), spans], names=[*keep, "score", "toxic_spans"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    out = docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kinds}, score double, toxic_spans array<struct<start:bigint,end:bigint>>")
    return out


def pieces(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of runs of rows with about ``most`` bytes of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > most:
            yield at, i - at
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes) - at
