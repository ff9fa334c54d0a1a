"""The Merkle manifest against a plain recursive one, over rows of every kind."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest

from quarry.llm import merkle

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Root, and for each node the siblings on its way, level by level, as (left, right)."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            ways[i].append((run[: p % 8], run[p % 8 + 1 :]))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        places = [p // 8 for p in places]
    return nodes[0], ways


def brute(rows):
    langs = collections.defaultdict(list)
    for r in rows:
        langs[r["lang"]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        mine = sorted(langs[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[lang] = mine, *climb([leaf_of(r, r["text"]) for r in mine])
    root, upper = climb([trees[x][1] for x in order]) if order else (None, [])
    out = []
    for lang, above in zip(order, upper, strict=True):
        mine, subroot, ways = trees[lang]
        for r, way in zip(mine, ways, strict=True):
            leaf, way = leaf_of(r, r["text"]), way + above
            i = r["doc_id"]
            tampered = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and r["text"] is not None
            node = leaf_of(r, r["text"].translate(LOWER)) if tampered else leaf
            for left, right in way:
                node = h(*left, node, *right)
            proof = h(*(s for left, right in way for s in left + right))
            out.append((i, leaf, subroot, root, proof, node, node == root))
    return collections.Counter(out)


def check(docs, levels):
    rows = docs.collect()
    got = merkle.merkle_digest(docs, levels).collect()
    assert collections.Counter(tuple(r) for r in got) == brute(rows)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_of_awkward_rows(docs, levels):
    check(docs, levels)


def test_manifest_over_several_rounds(spark):
    rows = [(i, f"Text {i} É", None if i % 400 == 0 else "xx" if i % 5 else "YY", f"s{i % 3}", i, "clash", 1) for i in range(700)]
    rows += [(3, "Text 3 É", "xx", "s0", 3, "clash", 1)] * 2 + [(9001, "alone", "zz", None, None, "clash", 1), (9002, None, "", "", 0, "clash", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    check(docs, 1)
    check(docs, 2)


def test_one_row_and_none(spark, none):
    assert merkle.merkle_digest(none).count() == 0
    check(spark.createDataFrame([(1, "A", "en", "s", 1, "", 0)], SCHEMA), 4)


def test_proofs_are_checked_by_the_leaf_alone(docs):
    found = merkle.manifest(merkle.leaves(docs), 2)
    assert found.columns[:3] == ["lang", "doc_id", "leaf"]
    rows = merkle.verify(found, "leaf").collect()
    assert all(r["folded_root"] == r["root"] for r in rows)
    assert sum(len(r["siblings"]) for r in rows) > 0
    for r in rows[:3]:  # another place in the tree, or another sibling, gives another root
        a = merkle.fold(bytes(r["leaf"]), r["leaf_index"], r["leaves"], bytes(r["siblings"]), 0)
        b = merkle.fold(bytes(r["leaf"]), r["leaf_index"] ^ 1, r["leaves"], bytes(r["siblings"]), 0)
        assert r["leaves"] == 1 or a[0] == bytes(r["subroot"]) != b[0]
