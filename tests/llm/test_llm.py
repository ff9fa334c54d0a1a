"""Each operator of the subpackage against brute force on a fixture of awkward rows, and on an empty table."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import (
    bwt,
    decontaminate,
    language_id,
    line_dedup,
    near_dedup,
    pii,
    quality_model,
    quality_rules,
    queries,
    source_mix,
    suffix_dedup,
    token_counts,
)
from quarry.operators import components
from tests.compare import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def bag(rows):
    return collections.Counter(rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_agrees_with_sql(spark, name):
    df = queries.queries()[name](spark, SF)
    names, want = rows_of_sql(connect(SF), queries.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


# --- op1 ------------------------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup(docs):
    rows = [(i, shingles(t)) for i, t in texts(docs)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                parent[root(a)] = root(b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    want = bag((i, len(s), min((x for x in ids[root(k)] if x is not None), default=None)) for k, (i, s) in enumerate(rows))
    got = near_dedup.near_dedup(docs).collect()
    assert bag((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_keep_one(docs):
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = bag(r["doc_id"] for r in kept.collect())
    assert got[1] == 1 and got[2] == got[3] == got[8] == 0 and got[4] == got[5] == got[6] == got[7] == 1


def test_documents_that_share_a_key_keep_their_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    made = []
    for i in range(400):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 100)]
        made += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:50] + ["other"] + words[51:]))]
    real = near_dedup.row_keys
    monkeypatch.setattr(near_dedup, "row_keys", lambda: [F.pmod(real()[0], F.lit(97)).alias("k1"), real()[1]])
    got = near_dedup.near_dedup(spark.createDataFrame(made, "doc_id int, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] // 2 * 2 for r in got)


def _groups(n, pairs):
    p = list(range(n))

    def root(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        p[root(a)] = root(b)
    low = {}
    for i in range(n):
        low.setdefault(root(i), i)
    return [low[root(i)] for i in range(n)]


def _near_copies(n, words=300, step=4, rounds=8, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        w = [f"w{i}" for i in range(words)]
        for i in rng.choice(words, (k % rounds) * step, replace=False):
            w[i] = f"new{k}x{i}"
        out.append(" ".join(w))
    return out


def test_link_blocks_spans_groups():
    some = _near_copies(40, step=1)
    data = np.frombuffer("".join(some).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in some])])
    h, at = near_dedup.shingle_sets(data, offs)
    _, sketch = near_dedup.signatures_of(h, at)
    sketches = np.ascontiguousarray(sketch).view(np.uint64)
    raw = [t.encode() for t in some]
    sets = [h[at[k] : at[k + 1]] for k in range(40)]
    assert [len(near_dedup.word_set(t)) for t in raw] == [len(s) for s in sets]
    exact = [(a, b) for a in range(40) for b in range(a) if near_dedup.agree(shingles(some[a]), shingles(some[b]), 85)]
    assert 1 < len(set(_groups(40, exact))) < 40
    for sides in (np.zeros(40, int), np.arange(40) // 20):
        got = near_dedup.link_blocks(list(range(40)), sides, list(range(40)), sketches, sets, raw, 85)
        want = exact if not sides.any() else [(a, b) for a, b in exact if sides[a] != sides[b]]
        assert _groups(40, got) == _groups(40, want) and len(got) < 40


def test_hot_buckets_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    monkeypatch.setattr(near_dedup, "FINE", 2)
    some = _near_copies(120, words=60, step=1, rounds=5, seed=3) + [" ".join(f"chain{i}" for i in range(k, k + 60)) for k in range(0, 90, 3)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    exact = [(a, b) for a in range(len(some)) for b in range(a) if near_dedup.agree(shingles(some[a]), shingles(some[b]), 85)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, 85).collect()}
    assert [got[i] for i in range(len(some))] == _groups(len(some), exact)


@pytest.mark.parametrize("form", ["near_dedup", "keep_one"])
def test_components_of_many_links(spark, monkeypatch, form):
    """More links than one task joins up: groups come together over rounds, for op1 and the pipeline's stage alike."""
    monkeypatch.setattr(near_dedup, "connected_components", lambda links: components.connected_components(links, finish_edges=2))
    some = [f"t{k // 6} " + " ".join(f"t{k // 6}w{i}" for i in range(80)) + f" end{k}" for k in range(240)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id int, text string")
    out = getattr(near_dedup, form)(docs, 85)
    got = out.collect()
    if form == "keep_one":
        assert sorted(r["doc_id"] for r in got) == list(range(0, 240, 6))
    else:
        assert {r["doc_id"]: r["component_id"] for r in got} == {k: k // 6 * 6 for k in range(240)}


def test_bands_lose_no_link(spark):
    """Recall of the candidate search: pairs just over the threshold, measured against the exact answer."""
    rng = np.random.default_rng(11)
    rows, want = [], 0
    for k in range(400):
        w = [f"p{k}w{i}" for i in range(130)]
        v = list(w)
        for i in (20, 70):
            v[i + int(rng.integers(0, 20))] += "x"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        want += near_dedup.agree(shingles(rows[-1][1]), shingles(rows[-2][1]), 85)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = near_dedup.near_dedup(docs, 85).where("kept").count()
    assert want > 390 and kept == 800 - want


def test_one_coarse_component_stays_linear(spark):
    """10,000 texts whose neighbours in a chain share bands but no link: what is fetched stays within twice the input."""
    some = [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 120_000, 12)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(8)
    sig = near_dedup.cut(near_dedup.signatures(docs, near_dedup.n_bands(85)))
    classes = sig.select("n_shingles", "u1", "u2", "k1", "k2", "bands", "sketch", F.monotonically_increasing_id().alias("cid"))
    classes = near_dedup.cut(classes)
    shared = near_dedup.cut(near_dedup.shared_buckets(classes))
    texts = near_dedup.cut(near_dedup.texts_of(docs, classes.join(shared, "cid", "left_semi")))
    known = near_dedup.cut(classes.select("cid", F.col("cid").alias("label"), "n_shingles", "sketch", "bands"))
    stars = near_dedup.cut(near_dedup.star_candidates(known, shared, 0, 85))
    rest = near_dedup.cut(near_dedup.rest_groups(known, shared, 85))
    assert texts.count() > 5000  # the chain does share buckets
    assert near_dedup.star_groups(stars).count() + rest.count() < 2 * len(some)
    assert near_dedup.near_dedup(docs, 85).where("kept").count() == len(some)


# --- op2 ------------------------------------------------------------------------------------------------------


def test_quality_rules(docs):
    want = []
    for i, t in texts(docs):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = quality_rules.quality_rules(docs)
    assert bag(tuple(r[c] for c in cols) for r in got.collect()) == bag(want)
    assert got.where("kept and base_failed").count() == 0


def test_ablation_counts(docs):
    led = quality_rules.ledger(quality_rules.measurements(docs)).cache()
    bits = [r["fail_bits"] for r in led.collect()]
    mask = quality_rules.POLICIES["v2"]
    for r in quality_rules.ablation(led, "v2").collect():
        bit = 1 << r["bit"]
        assert r["failed"] == sum(bool(b & mask & bit) for b in bits) and r["failed_by_this_alone"] == sum(b & mask == bit for b in bits)


# --- op3 ------------------------------------------------------------------------------------------------------


def line_units(text, kind):
    """(start, end) of the units with a word."""
    if kind == "line":
        bounds = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", text)]
    elif kind == "paragraph":
        bounds = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+(\n[^\n]+)*", text)]
    else:
        edges = [0, *(m.end() for m in re.finditer(r"\n|(?<=[.!?]) ", text)), len(text) + 1]
        bounds = [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [(a, b) for a, b in bounds if WORD.search(text[a:b])]


def line_layout(text, kind):
    """Units as lists of tiles (start, end, words)."""
    out = []
    for a, b in line_units(text, kind):
        words = list(WORD.finditer(text, a, b))
        said = [m.group().translate(LOWER) for m in words]
        cuts, since = [0], 0
        for k in range(1, len(words) if len(words) > 25 else 0):
            since += 1
            if sum(map(ord, said[k - 1])) % 32 == 0:
                since = 0
            if since % 24 == 0:
                cuts.append(k)
        edges = [a, *(words[k].start() for k in cuts[1:]), b]
        out.append([(s, e, tuple(said[i:j])) for s, e, i, j in zip(edges, edges[1:], cuts, [*cuts[1:], len(words)], strict=False)])
    return out


def line_brute(rows, kind, least=14, block=40):
    """{(id, text): removed spans} by the rule: units and pieces seen before, blocks of earlier documents."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    laid = [(k, line_layout(t, kind)) for k, (_, t) in enumerate(rows)]
    seen, blocks, gone = set(), {}, [set() for _ in rows]
    for k, units in laid:
        said = [sum((t[2] for t in u), ()) for u in units]
        for i, u in enumerate(units):
            if len(said[i]) >= least:
                if said[i] in seen:
                    gone[k] |= {(i, t) for t in range(len(u))}
                seen.add(said[i])
            for t, tile in enumerate(u if len(u) > 1 else []):
                if len(tile[2]) >= least:
                    if tile[2] in seen:
                        gone[k].add((i, t))
                    seen.add(tile[2])
        for i in range(len(units)):
            j = next((j for j in range(i, len(units)) if sum(map(len, said[i : j + 1])) >= block), None)
            if j is not None and j > i:
                words = sum(said[i : j + 1], ())
                if blocks.setdefault(words, k) != k:
                    gone[k] |= {(x, t) for x in range(i, j + 1) for t in range(len(units[x]))}
    out = {}
    for (k, units), (i, t) in zip(laid, rows, strict=True):
        spans = []
        for u, tiles in enumerate(units):
            for n, (s, e, _) in enumerate(tiles):
                if (u, n) in gone[k]:
                    if (u, n - 1) in gone[k]:
                        spans[-1] = (spans[-1][0], e)
                    else:
                        spans.append((s, e))
        out[i, t] = spans
    return out


def line_kept(text, spans, kind):
    whole, out, at = set(line_units(text, kind)), [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e + 1 if (s, e) in whole else e
    return "".join([*out, text[at:]])


@pytest.mark.parametrize("kind", ["sentence", "line", "paragraph"])
def test_line_dedup(docs, kind):
    want = line_brute({(i, t) for i, t in texts(docs) if t}, kind)
    rows = line_dedup.line_dedup(docs, kind).where("text <> ''").collect()
    assert {(r["doc_id"], r["text"]): [(s["start"], s["end"]) for s in r["removed"]] for r in rows} == want
    assert all(r["kept_text"] == line_kept(r["text"], want[r["doc_id"], r["text"]], kind) for r in rows)
    assert all(r["n_units"] == len(line_units(r["text"], kind)) for r in rows)


def made_up_lines(n, seed):
    """Texts of sentences of many lengths, with passages of others pasted into them, at line ends and inside lines."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeéß漢Z"), int(rng.integers(1, 5))))
    out = []
    for k in range(n):
        parts = []
        for _ in range(int(rng.integers(1, 14))):
            if out and rng.random() < 0.3:
                other = out[int(rng.integers(0, len(out)))]
                a = int(rng.integers(0, len(other)))
                parts.append(other[a : a + int(rng.integers(50, 500))])
            else:
                parts.append(" ".join(word() for _ in range(int(rng.choice([3, 8, 15, 60])))))
            parts.append(str(rng.choice([". ", "\n", " ", "? ", "\n\n", " \t"])))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("kind", ["sentence", "line", "paragraph"])
def test_line_dedup_of_pasted_passages(spark, kind):
    made = [(i, t) for i, t in enumerate(made_up_lines(150, 5)) if t]
    want = line_brute(made, kind)
    rows = line_dedup.line_dedup(spark.createDataFrame(made, "doc_id int, text string").repartition(3), kind).collect()
    assert {(r["doc_id"], r["text"]): [(s["start"], s["end"]) for s in r["removed"]] for r in rows} == want
    assert all(r["kept_text"] == line_kept(r["text"], want[r["doc_id"], r["text"]], kind) for r in rows)
    assert sum(map(bool, want.values())) > 50


def test_short_lines_in_a_row_and_long_lines_around(spark):
    poem = "\n".join(f"line {i} of a poem that stands in two texts" for i in range(8))
    run = " ".join(f"word{i * 7919 % 1000}" for i in range(90))
    rows = [(1, f"Before it.\n{poem}\nAfter it."), (2, f"Other words.\n{poem}\nAnd an end."), (3, f"{run} a first end"), (4, f"quite another beginning than {run}")]
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert not got[1]["removed"] and not got[3]["removed"]
    assert got[2]["kept_text"] == "Other words.\nAnd an end."
    assert 0 < len(got[4]["kept_text"]) < 0.6 * len(rows[3][1])


def test_a_passage_inside_longer_lines_goes(spark):
    passage = "This passage of a good many words was pasted into the middle of several texts. And its second sentence is long enough to stand for itself as a unit too."
    other = [f"Words only of text {i} come before it here. {passage} Then the text number {i} goes on in its own way." for i in range(4)]
    docs = spark.createDataFrame(list(enumerate(other)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert got[0]["kept_text"] == other[0]
    for i in (1, 2, 3):
        assert got[i]["kept_text"] == other[i].replace(passage + " ", "") and "".join(other[i][s["start"] : s["end"]] + " " for s in got[i]["removed"]) == passage + " "


# --- op4 ------------------------------------------------------------------------------------------------------


def covered(rows, least=200):
    n = collections.Counter(b[k : k + least] for b in rows for k in range(len(b) - least + 1))
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - least + 1):
            if n[b[k : k + least]] > 1:
                gone[k : k + least] = b"\1" * least
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [256, 2])
def test_suffix_dedup(docs, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", limit)
    some = docs
    rows = texts(some)
    want = bag((i, *c) for (i, _), c in zip(rows, covered([(t or "").encode() for _, t in rows]), strict=True))
    got = suffix_dedup.suffix_dedup_digest(some).collect()
    assert bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_documents_that_share_a_key_lose_only_their_own_bytes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = [word(60) for _ in range(5)]
    made = [(i, word(int(rng.integers(10, 120))) + (" " + shared[i % 5] + " " if i % 4 == 0 else " ") + word(20)) for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id int, text string")
    want = bag((i, *c) for (i, _), c in zip(made, covered([t.encode() for _, t in made]), strict=True))
    real = suffix_dedup.doc_keys
    monkeypatch.setattr(suffix_dedup, "doc_keys", lambda: (F.pmod(real()[0], F.lit(53)), real()[1]))
    got = suffix_dedup.suffix_dedup_digest(docs).collect()
    assert bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


@pytest.mark.parametrize("seed", range(4))
def test_interval_expansion(seed):
    rng = np.random.default_rng(seed)
    block = bytes(rng.integers(97, 99 + seed, 60, dtype=np.uint8))
    segs = [bytes(rng.integers(97, 99 + seed, int(rng.integers(1, 80)), dtype=np.uint8)) + (block if k % 3 else b"") for k in range(12)]
    weights = np.array([2 if k == 5 else 1 for k in range(12)])
    ends = np.cumsum([len(s) for s in segs])
    starts = ends - [len(s) for s in segs]
    for least in (3, 20, 45):
        n = collections.Counter()
        for s, w in zip(segs, weights, strict=True):
            for k in range(len(s) - least + 1):
                n[s[k : k + least]] += int(w)
        want = [k + least <= len(s) and n[s[k : k + least]] > 1 for s in segs for k in range(len(s))]
        assert bwt.repeated_starts(np.frombuffer(b"".join(segs), np.uint8), starts, ends, weights, least).tolist() == want


# --- op5 ------------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(BASE[kind], text or ""):
            d = re.sub(r"[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=d: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 10 <= len(d) <= 15}[kind]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_pii_base_spans(spark, docs):
    hard = ["a@b.c_d@e.f a@b a.b@@c.d x@y.z.", "1.2.3.4.5.6.7.8 01.02.03.255", "5 4111-1111 1111 1111 2", "+1 (212) 555-0100 +1+1+442071234567", "9" * 3000, "a" * 3000 + "@b.co", ".".join(["1"] * 3000), "+1" + " " * 3000, "+1 () 2 -- 3 .. 4 () 5 () 6 () 7 () 8 () 9 () 0 () 1", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"]
    more = spark.createDataFrame([(100 + k, t) for k, t in enumerate(hard)], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = bag((r["doc_id"], *(r[f"n_{k}"] for k in pii.KINDS), r["base_sha256"]) for r in pii.pii(more).collect())
    want = bag((i, *(sum(x[1] == k for x in base_spans(t)) for k in range(4)), hashlib.sha256(written(base_spans(t)).encode()).hexdigest()) for i, t in texts(more))
    assert got == want


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_pii_adds_what_the_rules_miss(spark, pii_model):
    assert pii_model is not None
    texts_ = ["pay 4111111111111111 4012888888881881 now", "order 4111111111111112 and version 300.400.500.600", "write to jane.roe [at] mail [dot] example today", "call (212) 555-0100 now", "nothing here at all. On 2024-01-02 it was"]
    got = pii.detect(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string"), pii_model).select("doc_id", pii._written("spans").alias("s"), pii._written("base").alias("b"))
    got = {r["doc_id"]: (r["s"], r["b"]) for r in got.collect()}
    assert got == {0: ("card:4:20,card:21:37", ""), 1: ("", ""), 2: ("email:9:41", ""), 3: ("phone:5:19", ""), 4: ("", "")}


def test_pii_held_out_items(spark, pii_model):
    """Made-up items of another seed in texts that the model has not seen: exact spans found, look-alikes left alone."""
    items = pii.made_up(seed=99, n=400)
    rows = [(k, f"some words before it{x['lead']}{x['item']}{x['tail']}and after") for k, x in enumerate(items)]
    found = {r["doc_id"]: {(s["s"], s["k"], s["e"]) for s in r["spans"]} for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string"), pii_model).collect()}
    hit = sum((len(f"some words before it{x['lead']}"), x["kind"], len(f"some words before it{x['lead']}{x['item']}")) in found[k] for k, x in enumerate(items) if x["kind"] >= 0)
    false = sum(bool(found[k]) for k, x in enumerate(items) if x["kind"] < 0)
    assert hit >= 0.85 * sum(x["kind"] >= 0 for x in items) and false <= 0.05 * sum(x["kind"] < 0 for x in items)


def test_pii_spans_by_brute_force(spark, pii_model, docs):
    """The added spans again in plain Python: generators, features as Spark gives them, trees in numpy, overlaps by pairs."""
    rng = np.random.default_rng(2)
    items = pii.made_up(seed=7, n=200)
    hard = [(1000 + k, " ".join(f"{x['lead']}{x['item']}{x['tail']}" for x in rng.choice(items, 6)) + " 1.2.3.4 a@b.co +442071234567 4111 1111 1111 1111") for k in range(40)]
    more = spark.createDataFrame(hard, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    trees, limit = pii_model
    rows = pii.with_spans(more).select("doc_id", "t", "base", pii.described("proposed").alias("seen")).collect()
    want = []
    for r in rows:
        spans = base_spans(r["t"])
        assert [(b["s"], b["k"], b["e"]) for b in r["base"]] == spans
        proposals = {(m.start(), pii.KINDS.index(kind), m.end(), j) for j, (kind, rx) in enumerate(pii.GENERATORS) for m in re.finditer(rx, r["t"], re.ASCII)}
        assert {(p["s"], p["k"], p["e"], int(p["x"][1])) for p in r["seen"]} == proposals
        score = {}
        for p in r["seen"]:
            at = (p["s"], p["k"], p["e"])
            score.setdefault(at, set()).add(float(1 / (1 + np.exp(-trees.raw(np.array([list(p["x"])]))[0]))))
        good = [(p, *at) for at, ps in score.items() for p in ps if p >= limit[at[1]] and not any(b[0] < at[2] and at[0] < b[2] for b in spans)]
        added = {g[1:] for g in good if not any(o[1] < g[3] and g[1] < o[3] and (-o[0], o[1], o[2], -o[3]) < (-g[0], g[1], g[2], -g[3]) for o in good)}
        want.append((r["doc_id"], written(sorted([*spans, *added]))))
    got = pii.detect(more, pii_model).select("doc_id", pii._written("spans").alias("s")).collect()
    assert bag(map(tuple, got)) == bag(want)


def test_pii_of_a_log(spark, pii_model):
    lines = "".join(f"10.0.{i % 256}.{i // 256 % 256} user{i}@host.example said 300.1.2.{i % 99}\n" for i in range(6000))
    row = pii.detect(spark.createDataFrame([(1, lines)], "doc_id long, text string"), pii_model).select(F.size("base").alias("n")).first()
    assert row["n"] == 12000
    out = pii.redact(spark.createDataFrame([(1, lines)], "doc_id long, text string")).first()["text"]
    assert out == "".join(f"[IP] [EMAIL] said 300.1.2.{i % 99}\n" for i in range(6000))


def test_redaction_of_base_spans(docs):
    row = pii.redact(docs).where("doc_id = 13").first()
    assert row["text"] == "mail [EMAIL] or [PHONE], card [CARD], ip [IP] and 999.1.1.1" and row["t"] == "clash"


# --- op6 ------------------------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    got = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert got[0] > 0.97 and got[1] < 0.03


def test_language_id_edges(docs):
    got = {(r["doc_id"]): r for r in language_id.language_id(docs).collect()}
    assert got[5]["lang_pred"] == got[4]["lang_pred"] == got[17]["lang_pred"] == "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, r in got.items():
        assert r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 5 == 0)


def test_language_id_brute_force(spark, docs):
    """Normalisation, blocks, compressed sizes and margins again, with nothing of the operator but the dictionaries."""
    import zstandard

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    content = language_id.learn(real)
    assert sorted(content) == ["de", "en", "es", "fr"]
    coders = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in content.items()}

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0, True
        data = " ".join("".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower()).split()).encode() or text.encode()
        total = {}
        for k, d in coders.items():
            coder = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            total[k] = sum(len(coder.compress(data[i : i + 512])) for i in range(0, len(data), 512))
        (best, k), (second, _) = sorted((v, k) for k, v in total.items())[:2]
        return k, min(1.0, 0.5 + 2.5 * (second - best) / second), (second - best) / second < 0.002

    some = docs.select("doc_id", "text").unionByName(real.where("doc_id < 300").select("doc_id", "text"))
    got = bag((r["doc_id"], r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in language_id.identify(some, content).collect())
    want = bag((i, k, round(score, 9), rejected) for i, t in texts(some) for k, score, rejected in [plain(t)])
    assert got == want
    assert language_id.Classifier({}).predict("x")[0] == "und" and language_id.Classifier({"b": b"same words", "a": b"same words"}).predict("same words")[0] == "a"


def test_language_id_learns_from_every_sampled_text(spark):
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5][:128]
    name = {i: "".join(chr(97 + int(c)) for c in f"{i:04d}") for i in ids}
    docs = spark.createDataFrame([(i, " ".join(f"{name[i]}{part} " * 3000 for part in ("head", "body", "tail")), "xx") for i in ids], "doc_id long, text string, lang string")
    learned = language_id.learn(docs)["xx"]
    assert len(learned) <= language_id.DICT_BYTES
    assert all(f"{name[i]}{part}".encode() in learned for i in ids for part in ("head", "body", "tail"))


# --- op7 ------------------------------------------------------------------------------------------------------

NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, benchmark):
    wins = collections.defaultdict(set)
    for r in benchmark.collect():
        w = NORMAL.findall((r["text"] or "").translate(LOWER))
        m = min(13, len(w))
        for k in range(len(w) - m + 1) if w else ():
            wins[tuple(w[k : k + m])].add(r["item_id"])
    out = []
    for i, t in texts(docs):
        w = NORMAL.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for m in {len(k) for k in wins}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    items |= wins[tuple(w[k : k + m])]
        ids = ",".join(sorted(map(str, items)))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return bag(out)


COLS7 = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 1])
def test_decontaminate(docs, benchmark, limit):
    got = decontaminate.decontaminate(docs, benchmark, limit)
    assert bag(tuple(r[c] for c in COLS7) for r in got.collect()) == leaks(docs, benchmark)
    assert decontaminate.decontaminate(docs, benchmark.limit(0), limit).where("n_hit > 0 or n_items > 0").count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 1 << 20])
def test_a_benchmark_of_60_000_windows(spark, limit):
    rng = np.random.default_rng(5)
    names = [f"v{i}" for i in range(3000)]
    text = lambda n: " ".join(names[i] for i in rng.integers(0, len(names), n))
    items = [(k, text(112)) for k in range(600)] + [(600 + k, text(1 + k % 12)) for k in range(60)]
    rows = []
    for k in range(60):
        w = items[k * 10][1].split()
        rows.append((k, f"{text(60)} {' '.join(w[k : k + 10 + k % 9])} {text(80)}"))
    many = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert decontaminate.windows(many).count() >= 60_000
    assert bag(tuple(r[c] for c in COLS7) for r in decontaminate.decontaminate(docs, many, limit).collect()) == leaks(docs, many)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, 1])
def test_remove_contaminated(docs, benchmark, limit):
    out = decontaminate.remove_contaminated(docs, benchmark, limit)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in out.collect()}
    assert 11 not in got and got[12]["w"] == 1 and got[12]["hit"] == 2
    assert "WIZARDS" not in got[12]["text"] and got[12]["text"].startswith("filler ") and got[12]["text"].endswith(" tail")
    assert got[1]["text"] == dict(texts(docs))[1] and got[5]["text"] is None
    assert decontaminate.remove_contaminated(docs, benchmark.limit(0)).count() == docs.count()


# --- op8 ------------------------------------------------------------------------------------------------------


def test_source_mix_targets(docs):
    mix = source_mix.source_mix(docs)
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.remove(s)
    target |= level
    got = {r["source"]: r for r in source_mix.per_source(mix).collect()}
    assert {s: round(got[s]["target"], 6) for s in got} == {s: round(target[s], 6) for s in target}
    rows = mix.collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows) and len(rows) == docs.count()
    assert bag(map(tuple, rows)) == bag(map(tuple, source_mix.source_mix(docs.repartition(7)).collect()))


def test_source_mix_comes_near_and_ranges_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = bag(map(tuple, source_mix.source_mix(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = source_mix.source_mix(docs)
        assert bag(map(tuple, many.collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in source_mix.per_source(many).collect():
        assert abs(r["taken"] - r["target"]) <= 4000


def test_source_mix_takes_some_of_many_equal_rows(spark):
    rows = [(7, "one two three four five six seven", "b", None)] * 2000 + [(k, "some other words here", "a", 5) for k in range(100, 900)] + [(7, "one two three four five six seven", "a", 1)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    mix = source_mix.source_mix(docs)
    for r in source_mix.per_source(mix).collect():
        assert abs(r["taken"] - r["target"]) <= 7 and r["taken"] > 0
    out = source_mix.take(docs)
    assert out.columns == ["doc_id", "text", "source", "copies", "mix_copies"]
    want = {r["source"]: r["taken"] for r in source_mix.per_source(mix).collect()}
    got = out.groupBy("source").agg(F.sum(F.col("mix_copies") * F.size(F.split("text", " "))).alias("taken")).collect()
    assert {r["source"]: r["taken"] for r in got} == want
    assert bag((r["source"], r["copies"]) for r in out.where("copies is null or copies <> 1").collect())[("b", None)] <= 2000
    again = source_mix.source_mix(docs.repartition(3))
    assert bag(map(tuple, again.collect())) == bag(map(tuple, mix.collect()))


def test_mix_by_given_weights(spark):
    """Documents of a large weight are drawn first; what is no weight counts as none given."""
    rows = [(i, " ".join(["w"] * 20), "a" if i < 300 else "b", 100.0 if i % 3 == 0 else 0.001 if i % 3 == 1 else None if i % 2 else float("nan")) for i in range(330)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, score double")
    plain = source_mix.source_mix(docs).groupBy("source").agg(F.sum("taken")).orderBy("source").collect()
    mixed = source_mix.source_mix(docs, weight="score")
    assert mixed.groupBy("source").agg(F.sum("taken")).orderBy("source").collect() == plain
    share = {r[0]: r[1] for r in mixed.where("source = 'a'").groupBy(F.col("doc_id") % 3).agg(F.avg((F.col("taken") > 0).cast("int"))).collect()}
    assert share[0] == 1 and share[1] < 0.5 < 0.95 < share[2]
    taken = source_mix.take(docs, "score")
    assert taken.columns == [*docs.columns, "copies"] and taken.where("source = 'a' and doc_id % 3 = 0").count() == 100


# --- op9 ------------------------------------------------------------------------------------------------------


def test_quality_model_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality_model.quality_model(docs, labels).where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.min("score"), F.max("score")).first()
    assert got[0] > 0.95 and 0 <= got[1] and got[2] <= 1


def test_quality_model_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (17, 0), (None, 1)], "doc_id long, quality int")
    got = quality_model.quality_model(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = quality_model.quality_model(docs, labels.limit(0))
    assert {r["score"] for r in none.collect()} == {0.5}


def _plain_passages(text, mix, code):
    """Features of the passages of a text, word by word."""
    data = (text or "").encode()
    w = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out = []
    words_ = [data[a:b] for a, b in w]
    classes = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>{}[]~^_=\\/", b".,;:!?\"'()-", bytes(range(192, 256)), b"!", b"\n"]
    for at in range(0, max(1, len(w)), 64):
        x = [0.0] * quality_model.N_FEATURES
        part = range(at, min(at + 64, len(w)))
        if len(part):
            body = data[w[part[0]][0] : w[part[-1]][1]]
            for c, members in enumerate(classes):
                x[c] = sum(b in members for b in body) / len(body)
            sizes = [len(words_[i]) for i in part]
            x[8], x[9], x[10], x[11] = np.mean(sizes), np.std(sizes), np.log1p(len(part)), max(sizes)
            x[12] = sum(i > 0 and words_[i] == words_[i - 1] for i in part) / len(part)
            x[13] = sum(words_[i] in words_[:i] for i in part) / len(part)
            tri = [tuple(words_[i : i + 3]) for i in range(len(w) - 2)]
            x[14] = sum(i < len(tri) and tri[i] in tri[:i] for i in part) / len(part)
            x[15], x[16], x[17] = np.log1p(len(w)), sum(k <= 1 for k in sizes) / len(part), 1
            for i in part:
                for h in [code(words_[i])] + ([code(words_[i], words_[i + 1])] if i + 1 < len(w) else []):
                    h = int(mix(np.array([h]))[0])
                    x[18 + h % quality_model.N_HASHED] += (1 if h >> 40 & 1 else -1) / len(part) ** 0.5
        out.append(x)
    return np.array(out)


def test_quality_scores_by_brute_force(spark, docs):
    """Features and the forward pass once more in plain loops."""
    tb = near_dedup.tb

    def code(*some):
        one = [tb.span_hashes(np.frombuffer(s, np.uint8), np.array([0]), np.array([len(s)]))[0] for s in some]
        return one[0] if len(one) == 1 else tb.gram_hashes(np.array(one), np.zeros(2, int), 2)[0][0]

    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_model.train(real, labels)
    w = model.weights
    some = docs.where("doc_id is null or doc_id <> 20").select("doc_id", "text").unionByName(real.where("doc_id < 20"))
    for _, t in texts(some):
        x = _plain_passages(t, tb.mix, code)
        data = np.frombuffer((t or "").encode(), np.uint8)
        fast, _ = quality_model.passages(data, np.array([0, len(data)]))
        assert np.allclose(fast, x, rtol=1e-4, atol=1e-5)
        x = np.clip((x - model.mean) / model.scale, -8, 8)
        h = [np.tanh(p @ w["W"] + w["b"]) for p in x]
        e = [float((np.tanh(p @ w["V"]) / (1 + np.exp(-(p @ w["U"])))) @ w["w"]) for p in h]
        a = [np.exp(v - max(e)) for v in e]
        z = sum(v / sum(a) * p for v, p in zip(a, h, strict=True))
        want = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        assert abs(model.score(fast.astype(float), np.array([0, len(fast)]))[0] - want) < 1e-4


def test_attention_gradient_descends():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, quality_model.N_FEATURES))
    at = np.arange(0, 301, 3)
    y = (x[::3, 0] + x[1::3, 0] + x[2::3, 0] > 0).astype(float)
    model = quality_model.GatedAttention.fit(x, at, y)
    assert ((model.score(x, at) > 0.5) == y).mean() > 0.95


# --- op10 -----------------------------------------------------------------------------------------------------


def own_pieces():
    """The vocabulary and its rank scores, read without the operator's help."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.TOKENIZER)
    own = [model.id_to_piece(i).encode() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {p: -np.log(rank + token_counts.RANK_OFFSET) for rank, p in enumerate(own, 1)}


def brute_tokens(pieces, word):
    w = (token_counts.MARK + word).encode()
    longest = max(map(len, pieces))
    best = [(0.0, 0)]
    for i in range(1, len(w) + 1):
        options = [(best[i - 1][0] + token_counts.BYTE_SCORE, best[i - 1][1] - 1)]
        options += [(best[i - k][0] + pieces[w[i - k : i]], best[i - k][1] - 1) for k in range(1, min(longest, i) + 1) if w[i - k : i] in pieces]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts(docs):
    pieces = own_pieces()
    want = bag((i, len(WORD.findall(t or "")), sum(brute_tokens(pieces, w) for w in WORD.findall(t or ""))) for i, t in texts(docs))
    assert bag((r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, queries.TOKENIZER).collect()) == want


def test_token_counts_of_long_words(spark):
    import base64
    import time

    rng = np.random.default_rng(4)
    run = base64.b64encode(rng.bytes(40_000)).decode()
    docs = spark.createDataFrame([(1, run), (2, "the" * 400 + " " + run[:700]), (3, run[:512] + " " + run[:509] + " " + run[:513])], "doc_id long, text string")
    start = time.perf_counter()
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, queries.TOKENIZER).collect()}
    assert time.perf_counter() - start < 20
    pieces = own_pieces()
    assert got == {r["doc_id"]: sum(brute_tokens(pieces, w) for w in r["text"].split()) for r in docs.collect()}


def test_token_counts_uses_pieces_of_any_length(spark):
    scores = own_pieces()
    longest = max(map(len, scores))
    mark = token_counts.MARK.encode()
    words = [p.removeprefix(mark).decode() for p in scores if len(p) > 24]
    words = [w for w in words if w and WORD.fullmatch(w) and token_counts.MARK not in w]
    assert longest > 24 and words

    some = [*words, *(f"pre{w}post" for w in words), "ordinary"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, queries.TOKENIZER).collect()}
    assert got == {i: brute_tokens(scores, w) for i, w in enumerate(some)}


# --- empty tables ---------------------------------------------------------------------------------------------


def test_empty_tables(spark, none, benchmark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        near_dedup.near_dedup(none),
        near_dedup.keep_one(none),
        quality_rules.quality_rules(none),
        line_dedup.line_dedup_digest(none),
        suffix_dedup.suffix_dedup_digest(none),
        pii.pii(none),
        pii.redact(none),
        language_id.language_id(none),
        decontaminate.decontaminate(none, benchmark),
        source_mix.source_mix(none),
        source_mix.take(none),
        quality_model.quality_model(none, labels),
        token_counts.token_counts(none, queries.TOKENIZER),
    ):
        assert df.count() == 0
