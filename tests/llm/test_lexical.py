"""Ranked lexical search against scores worked out for every document."""

from __future__ import annotations

import collections
import math
import re

import numpy as np
import pytest

from quarry.llm import lexical

TERM = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
LOWER = str.maketrans(lexical.UPPER, lexical.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, c in held if c)
    total = sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total if total else 0
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in collections.Counter(terms(text)).items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return collections.Counter(out)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.select(key, "text").collect()]


def found(docs, items, **how):
    return collections.Counter(tuple(r) for r in lexical.lexical_search(docs, items, **how).select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Zipf's words, groups of copies, hot terms, long and empty texts."""
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(f"W{x}" for x in rng.zipf(1.3, n) % 5000)
    rows = [(i, draw(int(rng.integers(1, 60)))) for i in range(900)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)] + [(2000, draw(5000)), (2001, ""), (2002, None), (None, rows[5][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, rank string").repartition(5)
    asked = [(k, draw(12)) for k in range(15)] + [(50, rows[7][1]), (51, rows[7][1] + " " + rows[7][1]), (52, "w1 W1 w1"), (53, "never seen words"), (54, ""), (55, None), (None, "w2 w3"), (0, "w4 w5")]
    items = spark.createDataFrame([*asked, asked[3]], "item_id long, text string")
    return docs, items


def test_search(corpus):
    docs, items = corpus
    assert found(docs, items) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize("how", [{"shard_docs": 50}, {"shard_postings": 40}, {"block_terms": 30}, {"stop": 1}, {"stop": 10**6}, {"k": 3}])
def test_shards_blocks_and_stops_change_nothing(corpus, how):
    docs, items = corpus
    assert found(docs, items, **how) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"), how.get("k", 20))


def test_search_of_awkward_rows(docs, benchmark):
    assert found(docs, benchmark) == brute(pairs(docs, "doc_id"), pairs(benchmark, "item_id"))


def test_nothing_to_search(spark, docs, none, benchmark):
    assert lexical.lexical_search(none, benchmark).count() == 0
    assert lexical.lexical_search(docs, benchmark.where("false")).count() == 0
    assert lexical.lexical_search(docs.where("text is null"), benchmark).count() == 0


def test_scoring_stops_early():
    """A rare term decides; the postings of a frequent one are not all added, and the scores are still whole."""
    n = 4000
    per = np.full(n, 1)
    per[:30] = 2
    terms_ = np.concatenate([[0, 1] if i < 30 else [0] for i in range(n)])
    tfs = np.ones(len(terms_), np.int64)
    shard = lexical.Shard(np.arange(n), np.ones(n, bool), np.full(n, 10), terms_, tfs, per, np.array([10, 9000]), n, 10 * n)
    wanted = np.array([1, 1])
    asked = []
    complete = shard.complete
    shard.complete = lambda some, w: asked.append(len(some)) or complete(some, w)
    some, scores = shard.best([0, 1], [1, 1], wanted, 20, 0, lexical.STOP)
    assert asked == [30] and sorted(some) == list(range(30))
    full = lexical.Shard(np.arange(n), np.ones(n, bool), np.full(n, 10), terms_, tfs, per, np.array([10, 9000]), n, 10 * n).best([0, 1], [1, 1], wanted, 20, 0, 0)
    assert set(scores) == set(full[1][:30])
