"""Toxicity by a counterfactual-regularised classifier.

Texts are cut into sentences (after ``.``, ``!``, ``?`` or a line feed, and after ``SENTENCE_WORDS`` words). A sentence is
described by which words, beginnings of words (``PREFIXES`` bytes, so that inflected forms share them) and pairs of
neighbouring words it holds, of those that the labelled sample shows to be telling; its logit is a bias and the sum of
their weights, and a document's is that of its worst sentence, so length alone makes nothing toxic. Weights are learned
from document labels, the gradient going to the sentence that is the worst at that step.

Labels are biased where toxic authors write about certain groups more than others do. So every labelled sentence of the
sample that names a group is written again with other names of the same list (``IDENTITIES``: of groups and, first, of
people in general), and the squared change of its logit is added to the loss with the factor ``FAIRNESS``: names of
groups weigh no more than those of people in general, and neutral mentions are left alone.

Documented bounds: learned from ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents at most (smallest hash of the id; the
losses are weighted back to the labels' shares), of a text of more than ``TRAIN_BYTES`` from slices spread over it, with
``MAX_FEATURES`` features, and with ``MAX_SWAPS`` occurrences of names a document. Counting, and turning the sample into
numbers, run on the executors; the fit on the driver gets a few numbers a document. Scoring takes every sentence of every
whole text.

Edge cases: null and empty texts and texts without a word have no sentence and get the bias alone; null labels count as
none; of several labels for one id the smallest wins, of several texts of one labelled id the smallest; without labels of
both classes every score is the share of toxic ones (0.5 with none); null ids count as held out; repeated rows are scored
alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from quarry.llm import textbytes as tb
from quarry.llm.sampling import smallest_hashes
from quarry.session import arrow_map, cut

CUTOFF = 0.7
SENTENCE_WORDS = 40
PREFIXES = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 3000, 6000
TRAIN_BYTES, TRAIN_SLICES = 1 << 16, 16
MIN_SUPPORT, MAX_CANDIDATES, MAX_FEATURES, LEAST_Z = 3, 200_000, 4096, 2.0
MAX_SWAPS = 8
FAIRNESS, STEPS, RATE, DECAY = 1.0, 600, 0.05, 1e-5
SAMPLE_PARTITIONS = 16

#: Names that may stand for each other, those of people in general first; one list a language and kind.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "foreigners"),
    ("person", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee", "foreigner"),
    ("local", "black", "white", "asian", "african", "american", "european", "mexican", "chinese", "indian", "arab", "jewish", "islamic", "catholic", "gay", "lesbian", "bisexual", "transgender", "queer", "straight", "disabled", "deaf", "blind", "elderly", "young"),
    ("leute", "frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "schwarze", "schwule", "lesben", "behinderte"),
    ("gens", "femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "noirs", "homosexuels", "lesbiennes", "handicapés"),
    ("gente", "mujeres", "hombres", "chicas", "chicos", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "negros", "homosexuales", "lesbianas", "discapacitados"),
)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
_PAIR = np.uint64(0x7061697273)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(True))


class Sentences:
    """Words of texts, and the sentences they lie in."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data = tb.lowered(data)
        self.s, self.e, self.rows = tb.runs(_IN_WORD[data], offs)
        n = len(self.s)
        stops = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_STOP[data], out=stops[1:])
        begins = np.ones(n, bool)
        begins[1:] = (self.rows[1:] != self.rows[:-1]) | (stops[self.s[1:]] != stops[self.e[:-1]])
        heads = np.flatnonzero(begins)
        place = np.arange(n) - heads[np.cumsum(begins) - 1] if n else np.zeros(0, np.int64)
        begins |= place % SENTENCE_WORDS == 0
        #: first word of each sentence, the sentence of each word, and the text of each sentence
        self.first = np.flatnonzero(begins)
        self.of = np.cumsum(begins) - 1
        self.text = self.rows[self.first]
        self.last = np.append(self.first[1:], n)[: len(self.first)] - 1

    def codes(self) -> np.ndarray:
        return tb.span_hashes(self.data, self.s, self.e)

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Features and the sentence of each; one that a sentence holds twice comes twice."""
        codes = self.codes()
        found, of = [tb.mix(codes)], [self.of]
        for p in PREFIXES:
            longer = np.flatnonzero(self.e - self.s > p)
            found.append(tb.mix(tb.span_hashes(self.data, self.s[longer], self.s[longer] + p) ^ tb.ORDER[p]))
            of.append(self.of[longer])
        if len(codes) > 1:
            near = np.flatnonzero(self.of[1:] == self.of[:-1])
            found.append(tb.mix(codes[near] * tb.ORDER[0] + codes[near + 1] * tb.ORDER[1] + _PAIR))
            of.append(self.of[near])
        return np.concatenate(found), np.concatenate(of)


class Lookup:
    """Numbers of known features."""

    MASK = np.uint64((1 << 18) - 1)

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.maybe = np.zeros(int(self.MASK) + 1, bool)
        self.maybe[(self.known & self.MASK).astype(np.int64)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known codes, and their numbers."""
        some = np.flatnonzero(self.maybe[(codes & self.MASK).astype(np.int64)])
        if not len(some) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, codes[some]), len(self.known) - 1)
        hit = self.known[at] == codes[some]
        return some[hit], at[hit]


def held(texts: Sentences, known: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature) of the known features that sentences hold, each once and in order."""
    codes, of = texts.features()
    at, number = known.find(codes)
    pair = np.unique(of[at] * np.int64(max(1, len(known.known))) + number)
    return pair // max(1, len(known.known)), pair % max(1, len(known.known))


class Model:
    def __init__(self, known: np.ndarray, weights: np.ndarray, bias: float):
        self.lookup, self.weights, self.bias = Lookup(known), weights, bias

    def logits(self, texts: Sentences) -> np.ndarray:
        """One a sentence."""
        sentence, feature = held(texts, self.lookup)
        return self.bias + np.bincount(sentence, weights=self.weights[feature], minlength=len(texts.first))

    def worst(self, texts: Sentences, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Score of each of ``n`` texts, and its worst sentence (the first of equals; -1 without one)."""
        z = self.logits(texts)
        top, which = np.full(n, self.bias), np.full(n, -1)
        order = np.lexsort((np.arange(len(z)), -z, texts.text))
        heads = order[np.flatnonzero(np.append(True, np.diff(texts.text[order]) > 0))] if len(z) else order
        top[texts.text[heads]] = np.maximum(z[heads], self.bias)
        which[texts.text[heads]] = heads
        return 1 / (1 + np.exp(-np.clip(top, -60, 60))), which


def identity_codes() -> tuple[np.ndarray, list[tuple[str, ...]], list[int]]:
    """Sorted hashes of the names, and of each its list and place there."""
    words = [(w, k, i) for k, names in enumerate(IDENTITIES) for i, w in enumerate(names)]
    data, offs = tb.buffers(pa.array([w for w, _, _ in words]))
    codes = tb.span_hashes(data, offs[:-1], offs[1:])
    order = np.argsort(codes)
    return codes[order], [IDENTITIES[words[j][1]] for j in order], [words[j][2] for j in order]


def identity_features() -> np.ndarray:
    data, offs = tb.buffers(pa.array([w for names in IDENTITIES for w in names]))
    return np.unique(Sentences(data, offs).features()[0])


def swapped(texts: Sentences) -> tuple[list[bytes], list[list[bytes]]]:
    """Sentences that name a group, and each one's versions with another name; ``MAX_SWAPS`` occurrences a text."""
    codes, lists, places = identity_codes()
    words = texts.codes()
    at = np.minimum(np.searchsorted(codes, words), len(codes) - 1)
    out, others, taken = [], [], {}
    for i in np.flatnonzero(codes[at] == words).tolist():
        row = int(texts.rows[i])
        taken[row] = taken.get(row, 0) + 1
        if taken[row] > MAX_SWAPS:
            continue
        k = texts.of[i]
        a, b = texts.s[texts.first[k]], texts.e[texts.last[k]]
        before, after = texts.data[a : texts.s[i]].tobytes(), texts.data[texts.e[i] : b].tobytes()
        out.append(texts.data[a:b].tobytes())
        others.append([before + w.encode() + after for j, w in enumerate(lists[at[i]]) if j != places[at[i]]])
    return out, others


def _sentences(texts: list[bytes]) -> Sentences:
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Sentences(np.frombuffer(b"".join(texts), np.uint8), offs)


def sample_of(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame | None, dict[int, float]]:
    """(doc_id, y, text) of the labelled sample, and the numbers of all labels learned from, by class."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("toxic") > 0).cast("int").alias("y"))
    n = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}
    if len(n) < 2:
        return None, n
    picked = [r for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)) for r in smallest_hashes(usable.where(F.col("y") == y), "doc_id", "toxic", most)]
    schema = StructType([StructField("doc_id", LongType()), StructField("y", IntegerType())])
    few = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in picked], schema)

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t in batch.column(2).to_pylist():
                data = (t or "").encode("utf-8", "replace")
                if len(data) > TRAIN_BYTES:
                    width, last = TRAIN_BYTES // TRAIN_SLICES, len(data) - TRAIN_BYTES // TRAIN_SLICES
                    data = b"\n".join(data[last * k // (TRAIN_SLICES - 1) :][:width] for k in range(TRAIN_SLICES))
                texts.append(data.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "y", "text"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "y", "text")
    texts = arrow_map(some, trim, "doc_id long, y int, text string").repartition(SAMPLE_PARTITIONS, "doc_id")
    return cut(texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))), n


def document_frequencies(sample: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """(code, n): in how many texts of the sample a feature stands; of all features, or of known ones."""
    lookup = None if known is None else Lookup(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in tb.slices(batches, "text"):
            texts = Sentences(data, offs)
            codes, of = texts.features()
            row = texts.text[of]
            if lookup is not None:
                at, _ = lookup.find(codes)
                codes, row = codes[at], row[at]
            _, once = np.unique(tb.mix(codes ^ tb.mix(row.astype(np.uint64) + np.uint64(7))), return_index=True)
            code, n = np.unique(codes[once], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    return arrow_map(sample.select("text"), run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def choose(sample: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """The telling features and their log odds: candidates stand in ``MIN_SUPPORT`` toxic texts; best z scores first."""
    toxic = document_frequencies(sample.where("y = 1")).where(F.col("n") >= MIN_SUPPORT)
    toxic = toxic.orderBy(F.col("n").desc(), "code").limit(MAX_CANDIDATES).toArrow()
    code, pos = toxic["code"].to_numpy().view(np.uint64), toxic["n"].to_numpy().astype(float)
    order = np.argsort(code)
    code, pos = code[order], pos[order]
    clean = document_frequencies(sample.where("y = 0"), code).toArrow()
    neg = np.zeros(len(code))
    neg[np.searchsorted(code, clean["code"].to_numpy().view(np.uint64))] = clean["n"].to_numpy()
    odds = np.log((pos + 0.5) / (n_toxic + 1)) - np.log((neg + 0.5) / (n_clean + 1))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    best = np.lexsort((code, -z))[:MAX_FEATURES]
    best = best[z[best] >= LEAST_Z]
    known = np.union1d(code[best], identity_features())
    weights = np.zeros(len(known))
    weights[np.searchsorted(known, code[best])] = odds[best]
    return known, weights


def _packed(values: np.ndarray) -> bytes:
    return values.astype(np.int32).tobytes()


def numbers(sample: DataFrame, known: np.ndarray) -> tuple[list[tuple], list[tuple]]:
    """The sample in numbers: (doc_id, y, sentences, features), and pairs of features of sentences and swapped ones."""
    lookup = Lookup(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            texts = Sentences(data, offs)
            sentence, feature = held(texts, lookup)
            bounds = np.searchsorted(texts.text[sentence], np.arange(rows.num_rows + 1))
            cells = [(_packed(sentence[a:b]), _packed(feature[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ids, ys = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            out = [("doc", i, y, *c) for i, y, c in zip(ids, ys, cells, strict=True)]
            named, others = swapped(texts)
            flat = [v for versions in others for v in versions]
            if flat:
                before, after = _by_text(named, lookup), _by_text(flat, lookup)
                of = [k for k, versions in enumerate(others) for _ in versions]
                out += [("pair", None, None, _packed(before[k]), _packed(x)) for k, x in zip(of, after, strict=True)]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("kind", "doc_id", "y", "a", "b"), r, strict=True)) for r in out],
                pa.schema([("kind", pa.string()), ("doc_id", pa.int64()), ("y", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]),
            )

    found = arrow_map(sample.select("doc_id", "y", "text"), run, "kind string, doc_id long, y int, a binary, b binary").toArrow()
    cols = [found[c].to_pylist() for c in ("kind", "doc_id", "y", "a", "b")]
    both = [(kind, i, y, np.frombuffer(a, np.int32), np.frombuffer(b, np.int32)) for kind, i, y, a, b in zip(*cols, strict=True)]
    docs = sorted((r[1:] for r in both if r[0] == "doc"), key=lambda r: r[0])
    pairs = sorted((r[3:] for r in both if r[0] == "pair"), key=lambda r: (r[0].tobytes(), r[1].tobytes()))
    return docs, pairs


def _by_text(texts: list[bytes], lookup: Lookup) -> list[np.ndarray]:
    parts = _sentences(texts)
    sentence, feature = held(parts, lookup)
    bounds = np.searchsorted(parts.text[sentence], np.arange(len(texts) + 1))
    return [feature[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fit(docs: list[tuple], pairs: list[tuple], start: np.ndarray, weight: dict[int, float], fairness: float = FAIRNESS) -> tuple[np.ndarray, float]:
    """Weights and bias; ``weight`` is the loss of a document by its class."""
    size = len(start)
    y = np.array([r[1] for r in docs], float)
    share = np.array([weight[int(v)] for v in y])
    share /= share.sum()
    # a document's sentences follow each other, an empty one first (what has no known feature)
    sentence, feature, first, n = [], [], [], 0
    for _, _, s, f in docs:
        first.append(n)
        _, place = np.unique(s, return_inverse=True)
        sentence.append(n + 1 + place)
        feature.append(f)
        n += 1 + (int(place.max()) + 1 if len(place) else 0)
    sentence, feature = np.concatenate(sentence), np.concatenate(feature)
    first = np.array(first)
    doc_of = np.repeat(np.arange(len(docs)), np.diff(np.append(first, n)))
    pair_at = np.repeat(np.arange(2 * len(pairs)) // 2, [len(x) for p in pairs for x in p]) if pairs else np.zeros(0, np.int64)
    pair_sign = np.repeat(np.tile([-1.0, 1.0], len(pairs)), [len(x) for p in pairs for x in p]) if pairs else np.zeros(0)
    pair_feature = np.concatenate([x for p in pairs for x in p]) if pairs else np.zeros(0, np.int64)
    v, prior = np.clip(start, 0, 4) / 2, float((share * y).sum())
    theta = np.append(v, np.log(prior / (1 - prior)) - 2)
    m, s2 = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        v, bias = theta[:-1], theta[-1]
        z = bias + np.bincount(sentence, weights=v[feature], minlength=n)
        top = np.maximum.reduceat(z, first)
        worst = np.zeros(n, bool)
        candidates = np.flatnonzero(z == top[doc_of])
        worst[candidates[np.unique(doc_of[candidates], return_index=True)[1]]] = True
        slope = share * (1 / (1 + np.exp(-np.clip(top, -60, 60))) - y)
        grad = np.append(np.bincount(feature, weights=np.where(worst, slope[doc_of], 0)[sentence], minlength=size), slope.sum())
        grad[:-1] += DECAY * v
        if len(pairs):
            change = np.bincount(pair_at, weights=pair_sign * v[pair_feature], minlength=len(pairs))
            grad[:-1] += fairness * 2 / len(pairs) * np.bincount(pair_feature, weights=pair_sign * change[pair_at], minlength=size)
        m = 0.9 * m + 0.1 * grad
        s2 = 0.99 * s2 + 0.01 * grad**2
        theta = theta - RATE * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, fairness: float = FAIRNESS) -> Model:
    sample, n = sample_of(docs, labels)
    counts = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()} if sample is not None else {}
    if len(counts) < 2:
        share = min(max(n.get(1, 0) / sum(n.values()), 1e-6), 1 - 1e-6) if n else 0.5
        return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    known, start = choose(sample, counts[1], counts[0])
    rows, pairs = numbers(sample, known)
    weights, bias = fit(rows, pairs, start, {k: n[k] / counts[k] for k in counts}, fairness)
    return Model(known, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence as code points of the text (null without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            texts = Sentences(data, offs)
            scores, which = model.worst(texts, rows.num_rows)
            none = which < 0
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            spans = []
            for at in (texts.s[texts.first], texts.e[texts.last]):
                spans.append(chars[np.append(at, 0)[which]] - chars[offs[:-1]])
            cells = [pa.array(x.astype(np.int32), mask=none) for x in spans]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(scores), *cells], ["doc_id", "score", "worst_start", "worst_end"])

    schema = StructType([docs.schema["doc_id"], StructField("score", DoubleType()), StructField("worst_start", IntegerType()), StructField("worst_end", IntegerType())])
    scored = arrow_map(docs.select("doc_id", "text"), run, schema)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "worst_start", "worst_end")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, worst_start, worst_end."""
    return score(docs, train(docs, labels))
