"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage of the whole text is described by
its words and pairs of words, hashed with signs into ``N_HASHED`` numbers, and by surface measurements (character
classes, word lengths, repetition inside it and of earlier passages), and is encoded by a hidden layer; gated attention
weighs the passages; the weighted sum is scored. Encoder, attention and scorer are trained together from document labels
alone, on the driver, from at most ``MAX_LABELLED`` labelled documents (smallest hash of the id), of which a longer one
gives ``TRAIN_PASSAGES`` passages spread over its whole text. The weights are a few kilobytes and go to
the executors with the function that scores every document, by all its passages.

Edge cases: null and empty texts are one passage of zeros; labels that are null count as no label, and of
several labels for one id the smallest wins, of several rows for one labelled id one is learned from; without labels of both classes every score is the share of
label 1 (0.5 with none); null ids count as held out; repeated rows are scored alike; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quarry.llm import textbytes as tb
from quarry.llm.language_id import held_out
from quarry.llm.sampling import smallest_hashes
from quarry.session import arrow_map

PASSAGE_WORDS = 64
MAX_LABELLED = 4000
TRAIN_PASSAGES = 64
CUTOFF = 0.3
HIDDEN, GATE, STEPS, BATCH, RATE, DECAY = 24, 12, 600, 256, 0.01, 1e-4

_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 65:91] = True  # upper case
_CLASSES[1, 97:123] = True  # lower case
_CLASSES[2, 48:58] = True  # digits
_CLASSES[3, [ord(c) for c in "#*$%&|<>{}[]~^_=\\/"]] = True  # symbols
_CLASSES[4, [ord(c) for c in ".,;:!?\"'()-"]] = True  # punctuation
_CLASSES[5, 192:] = True  # first bytes of other characters
_CLASSES[6, 33] = True  # exclamation marks
_CLASSES[7, 10] = True  # line feeds
N_SURFACE, N_HASHED = 18, 192
N_FEATURES = N_SURFACE + N_HASHED


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and n + 1 offsets of each text's first passage."""
    n = len(offs) - 1
    s, e, rows = tb.words(data, offs)
    n_words = np.bincount(rows, minlength=n)
    per = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    at = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)
    out = np.zeros((int(at[-1]), N_FEATURES), np.float32)
    if not len(s):
        return out, at
    order = np.arange(len(s)) - np.concatenate([[0], np.cumsum(n_words)])[rows]
    p = at[rows] + order // PASSAGE_WORDS
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
    last = np.append(first[1:], len(s)) - 1
    here = p[first]
    count = (last - first + 1).astype(np.float64)
    size = np.maximum(1, e[last] - s[first]).astype(np.float64)
    for c in range(len(_CLASSES)):
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_CLASSES[c][data], out=run[1:])
        out[here, c] = (run[e[last]] - run[s[first]]) / size
    length = (e - s).astype(np.float64)
    mean = np.add.reduceat(length, first) / count
    out[here, 8] = mean
    out[here, 9] = np.sqrt(np.maximum(0, np.add.reduceat(length**2, first) / count - mean**2))
    out[here, 10] = np.log1p(count)
    out[here, 11] = np.maximum.reduceat(length, first)
    codes = tb.span_hashes(data, s, e)
    same = np.zeros(len(s))
    same[1:] = (codes[1:] == codes[:-1]) & (rows[1:] == rows[:-1])
    out[here, 12] = np.add.reduceat(same, first) / count
    for k, col in ((1, 13), (3, 14)):
        grams, g_at = (codes, np.arange(len(codes))) if k == 1 else tb.gram_hashes(codes, rows, k)
        if len(g_at):
            _, one = np.unique(tb.mix(grams ^ tb.mix(rows[g_at].astype(np.uint64) + np.uint64(7))), return_index=True)
            seen = np.zeros(len(s))
            seen[g_at] = 1
            seen[g_at[one]] = 0
            out[here, col] = np.add.reduceat(seen, first) / count
    out[here, 15] = np.log1p(n_words[rows[first]])
    short = length <= 1
    out[here, 16] = np.add.reduceat(short.astype(np.float64), first) / count
    out[here, 17] = 1
    pairs, pair_at = tb.gram_hashes(codes, rows, 2)
    h, of = tb.mix(np.concatenate([codes, pairs])), p[np.concatenate([np.arange(len(codes)), pair_at])]
    cell = (h % np.uint64(N_HASHED)).astype(np.int64)
    sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    bags = np.bincount(of * N_HASHED + cell, weights=sign, minlength=len(out) * N_HASHED).reshape(len(out), N_HASHED)
    out[here, N_SURFACE:] = bags[here] / np.sqrt(count)[:, None]
    return out, at


class GatedAttention:
    """score = sigmoid(c . sum_k a_k h_k + d), a = softmax(w . (tanh(V h) * sigmoid(U h))), h = tanh(W x + b)."""

    def __init__(self, weights: dict[str, np.ndarray] | None, mean: np.ndarray, scale: np.ndarray, prior: float):
        self.weights, self.mean, self.scale, self.prior = weights, mean, scale, prior

    @staticmethod
    def forward(w: dict[str, np.ndarray], x: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
        starts, bag = at[:-1], np.repeat(np.arange(len(at) - 1), np.diff(at))
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * s) @ w["w"]
        a = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "bag": bag, "starts": starts}

    @classmethod
    def fit(cls, x: np.ndarray, at: np.ndarray, y: np.ndarray, seed: int = 0) -> GatedAttention:
        prior = float(y.mean()) if len(y) else 0.5
        mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
        scale = x.std(axis=0) + 1e-3 if len(x) else np.ones(N_FEATURES)
        if len(np.unique(y)) < 2:
            return cls(None, mean, scale, prior)
        x = np.clip((x - mean) / scale, -8, 8)
        rng = np.random.default_rng(seed)
        # documents in a fixed random order; every step takes the next BATCH of them
        mixed = rng.permutation(len(y))
        x = x[np.concatenate([np.arange(at[i], at[i + 1]) for i in mixed])]
        at, y = np.concatenate([[0], np.cumsum(np.diff(at)[mixed])]), y[mixed]
        shape = {"W": (N_FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": ()}
        w = {k: rng.normal(0, 1 / np.sqrt(max(1, v[0] if v else 1)), v) for k, v in shape.items()}
        w["b"] *= 0
        w["d"] = np.array(np.log(prior / (1 - prior)))
        m, v = ({k: np.zeros_like(x_) for k, x_ in w.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            lo = (step - 1) * BATCH % len(y)
            hi = min(lo + BATCH, len(y))
            xs, some = x[at[lo] : at[hi]], y[lo:hi]
            f = cls.forward(w, xs, at[lo : hi + 1] - at[lo])
            dl = (f["p"] - some) / len(some)
            dz = dl[:, None] * w["c"]
            dzk = dz[f["bag"]]
            da = (f["h"] * dzk).sum(axis=1)
            de = f["a"] * (da - np.add.reduceat(f["a"] * da, f["starts"])[f["bag"]])
            dg = de[:, None] * w["w"]
            dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
            dh = (f["a"][:, None] * dzk + dt @ w["V"].T + ds @ w["U"].T) * (1 - f["h"] ** 2)
            grad = {"W": xs.T @ dh, "b": dh.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum()}
            for k in w:
                g = grad[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return cls(w, mean, scale, prior)

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(at) - 1, self.prior)
        return self.forward(self.weights, np.clip((x - self.mean) / self.scale, -8, 8), at)["p"]


def spread(a: int, b: int) -> np.ndarray:
    """At most ``TRAIN_PASSAGES`` of the numbers a to b, from the first to the last."""
    return a + np.arange(min(b - a, TRAIN_PASSAGES)) * max(1, b - a - 1) // max(1, min(b - a, TRAIN_PASSAGES) - 1)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> GatedAttention:
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    picked = smallest_hashes(usable, "doc_id", "quality", most)
    label: dict[int, int] = {}
    for r in picked:
        label.setdefault(r["doc_id"], int(r["quality"] > 0))
    if not label:
        return GatedAttention.fit(np.zeros((0, N_FEATURES)), np.zeros(1, np.int64), np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            x, at = passages(data, offs)
            cells = [x[spread(a, b)].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cells, pa.binary())], ["doc_id", "x"])

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isin(list(label)))
    found = arrow_map(sample, run, "doc_id long, x binary").groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    found.sort(key=lambda r: r["doc_id"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in found]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, N_FEATURES))
    return GatedAttention.fit(x, at, np.array([label[r["doc_id"]] for r in found], np.float64))


def quality_model(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            x, at = passages(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(model.score(x.astype(np.float64), at))], ["doc_id", "score"])

    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType())])
    scored = arrow_map(docs.select("doc_id", "text"), run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
