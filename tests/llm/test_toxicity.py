"""Toxicity: scores against a plain reading of the texts, held-out accuracy, and what the swaps do."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from quarry.llm import textbytes as tb
from quarry.llm import toxicity

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id long, toxic int"
SLURS = ["grobnik", "grobnisch", "grobnar", "snarfel", "snarfelt"]
NAMED = ["muslims", "women", "immigrants"]


def learned_from(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


def code(text):
    data = np.frombuffer(text, np.uint8)
    return tb.span_hashes(data, np.array([0]), np.array([len(data)]))


def plain_score(model, text):
    """Sentence by sentence, feature by feature."""
    weight = dict(zip(model.lookup.known.tolist(), model.weights.tolist(), strict=True))
    best, sentence, last = model.bias, [], 0
    sentences = []
    text = text or ""
    for m in WORD.finditer(text):
        if sentence and (re.search(r"[.!?\n]", text[last : m.start()]) or len(sentence) == toxicity.SENTENCE_WORDS):
            sentences.append(sentence)
            sentence = []
        sentence.append(m.group().translate(LOWER).encode())
        last = m.end()
    for words in [*sentences, sentence]:
        found = set()
        for w in words:
            found.add(int(tb.mix(code(w))[0]))
            found |= {int(tb.mix(code(w[:p]) ^ tb.ORDER[p])[0]) for p in toxicity.PREFIXES if len(w) > p}
        for a, b in zip(words, words[1:], strict=False):
            found.add(int(tb.mix(code(a) * tb.ORDER[0] + code(b) * tb.ORDER[1] + np.uint64(0x7061697273))[0]))
        best = max(best, model.bias + sum(weight.get(f, 0) for f in found))
    return 1 / (1 + np.exp(-best))


def made_up(n, seed, bias=0.0):
    """Texts, a fifth of them toxic by one word somewhere; ``bias`` is the share of toxic labels that a group's name got."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = [f"w{x}" for x in rng.zipf(1.4, int(rng.integers(5, 200))) % 900]
        toxic = rng.random() < 0.2
        unjust = rng.random() < bias
        if toxic and not unjust:
            words.insert(int(rng.integers(0, len(words))), SLURS[int(rng.integers(0, len(SLURS)))] + ["", "en", "s"][int(rng.integers(0, 3))])
        if toxic and unjust or rng.random() < 0.02:
            words.insert(int(rng.integers(0, len(words))), NAMED[int(rng.integers(0, 3))])
        for k in range(8, len(words), 9):
            words[k] += rng.choice([".", "!", "?\n", "\n"])
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = made_up(3000, 1)
    docs = spark.createDataFrame([(i, t, "x", 1.5) for i, t, _ in rows], "doc_id long, text string, lang string, score double").repartition(4)
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], LABELS), {i: y for i, _, y in rows}


def test_scores_are_those_of_a_plain_reading(corpus, docs):
    model = toxicity.train(*corpus[:2])
    assert len(model.weights) > 50
    for frame in (corpus[0].limit(150), docs):
        texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in frame.select("doc_id", "text").collect())
        got = toxicity.score(frame, model)
        assert got.columns == ["doc_id", "held_out", "score", "predicted", "worst_start", "worst_end"]
        rows = got.collect()
        assert np.allclose(sorted(r["score"] for r in rows), sorted(plain_score(model, t) for _, _, t in texts), atol=1e-9)
        for r in rows:
            assert r["held_out"] == (r["doc_id"] is None or not learned_from(r["doc_id"]))
            assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1


def test_held_out_accuracy_and_worst_sentence(corpus):
    docs, labels, truth = corpus
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 800
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    text = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    worst = [text[r["doc_id"]][r["worst_start"] : r["worst_end"]] for r in held if truth[r["doc_id"]] and r["predicted"]]
    assert sum(any(s in w for s in SLURS) for w in worst) / len(worst) > 0.98


def test_reruns_agree(corpus):
    a, b = (toxicity.train(*corpus[:2]) for _ in range(2))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_swaps_leave_neutral_mentions_alone(spark):
    rows = made_up(3000, 2, bias=0.4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], LABELS)
    neutral = spark.createDataFrame([(i, f"W3 w5 {w} w7 w2 w9. W1 w4.") for i, w in enumerate(NAMED)], "doc_id long, text string")
    slurs = spark.createDataFrame([(i, f"W3 w5 {w} w7 w2 w9. W1 w4.") for i, w in enumerate(SLURS)], "doc_id long, text string")
    plain, fair = (toxicity.train(docs, labels, fairness) for fairness in (0.0, toxicity.FAIRNESS))

    def logits(model, frame):
        return np.array([np.log(r["score"] / (1 - r["score"])) for r in toxicity.score(frame, model).collect()])

    people = spark.createDataFrame([(0, "W3 w5 people w7 w2 w9. W1 w4.")], "doc_id long, text string")
    gap = [np.abs(logits(m, neutral) - logits(m, people)).max() for m in (plain, fair)]
    assert gap[1] < 0.1 * gap[0] and gap[0] > 1
    assert (toxicity.score(neutral, plain).toPandas()["predicted"] == 1).any()
    assert (toxicity.score(neutral, fair).toPandas()["predicted"] == 0).all()
    assert (toxicity.score(slurs, fair).toPandas()["predicted"] == 1).all()


def test_swapped_sentences():
    data, offs = tb.buffers(tb.pa.array(["One. The women met! End", "no name", "Women women"]))
    named, others = toxicity.swapped(toxicity.Sentences(data, offs))
    assert named == [b"the women met", b"women women", b"women women"]
    assert b"the people met" in others[0] and b"men women" in others[1] and b"women men" in others[2]
    assert all(len(x) == len(toxicity.IDENTITIES[0]) - 1 for x in others)


def test_few_or_no_labels(spark, docs, none):
    nothing = spark.createDataFrame([], LABELS)
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.5}
    assert toxicity.toxicity(none, nothing).count() == 0
    ids = [i for i in range(1, 20) if learned_from(i)]
    assert {round(r["score"], 4) for r in toxicity.toxicity(docs, spark.createDataFrame([(i, 0) for i in ids], LABELS)).collect()} == {0.0}
    odd = [(ids[0], 1), (ids[0], 0), (ids[1], None), (None, 1), (ids[2], 1), (ids[3], 0), (ids[3], 0)]
    assert toxicity.toxicity(docs, spark.createDataFrame(odd, LABELS)).count() == docs.count()


def test_a_long_text_is_read_to_its_end(spark, corpus):
    model = toxicity.train(*corpus[:2])
    long = "w1 w2 w3. " * 60_000
    rows = [(1, long + "w4 grobnik w5"), (2, long), (3, "grobnik " * 3)]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1]["predicted"] == 1 and got[2]["predicted"] == 0 and got[3]["predicted"] == 1
    assert got[1]["worst_start"] == len(long)
