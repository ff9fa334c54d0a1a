"""Path searches, fan-outs and the token index against plain versions on small random graphs."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import fanout, paths, token_index

SYMBOLS = "id string, source_name string, file string, line_start long, line_end long, kind string, name string, qname string, parent string"
EDGES = "caller string, callee string, edge_type string, file string, line long, confidence string"


def made_up(seed, n=40, n_edges=110):
    """Symbols of two sources, names that several symbols share, tests and local bindings."""
    rng = np.random.default_rng(seed)
    symbols = []
    for i in range(n):
        q = f"pkg.Owner{i % 9}.name{i % 31}"
        folder = ["core", "core", "lib", "core/test"][i % 4]
        symbols.append((f"{'local ' if i % 17 == 5 else 'x'}{i}", "s" if i % 7 else "t", f"{folder}/f{i % 5}.py", 10 * i, 10 * i + 8, "method", f"name{i % 31}", q, f"pkg.Owner{i % 9}"))
    edges = set()
    while len(edges) < n_edges:
        a, b = rng.integers(0, n, 2)
        if a != b:
            kind = ["call", "type_ref", "implements", "contains"][int(rng.integers(0, 4))]
            edges.add((symbols[a][0], symbols[b][0], kind, symbols[a][2], int(10 * a + rng.integers(0, 8)), "exact"))
    return symbols, sorted(edges)


def plain_paths(symbols, edges, targets, depth, most):
    ids = collections.defaultdict(list)
    for s in symbols:
        if not s[0].startswith("local "):
            ids[s[1], s[7]].append(s[0])
    qname = {(s[1], s[0]): s[7] for s in symbols}
    out_of = collections.defaultdict(set)
    for a, b, kind, *_ in edges:
        if kind in ("call", "type_ref"):
            out_of[a].add(b)

    def directed(source, start, finish):
        ways = {i: [i] for i in ids[source, start]}
        seen = set(ways)
        for _ in range(depth):
            found = {}
            for a in sorted(ways)[:most]:
                for b in sorted(out_of[a]):
                    if b not in seen:
                        found.setdefault(b, [*ways[a], b])
            hits = sorted(set(ids[source, finish]) & set(found))
            if hits:
                return [i for i in found[hits[0]] if (source, i) in qname]
            seen |= set(found)
            ways = found
        return []

    out = set()
    groups = collections.defaultdict(list)
    for g, source, _, q in sorted(targets, key=lambda t: (t[0], t[2], t[3])):
        if q not in groups[g, source]:
            groups[g, source].append(q)
    for (g, source), names in groups.items():
        for t in names[1:]:
            ahead = directed(source, names[0], t)
            way = ahead or directed(source, t, names[0])
            if len(way) > 1:
                out |= {(g, t, not ahead, k, i) for k, i in enumerate(way)}
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 200), (2, 2)])
def test_paths_between_targets(spark, seed, most):
    symbols, edges = made_up(seed)
    names = sorted({s[7] for s in symbols})
    targets = [(g, "s", k, names[(g * 7 + k * 5) % len(names)]) for g in range(8) for k in range(4)]
    got = paths.connect_targets(
        spark.createDataFrame(edges, EDGES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(targets, "grp int, source_name string, pos int, qname string"), 4, most
    ).collect()
    want = plain_paths(symbols, edges, targets, 4, most)
    assert {(r["grp"], r["target"], r["backward"], r["pos"], r["id"]) for r in got} == want
    assert any(r["backward"] for r in got) and any(r["pos"] > 1 for r in got) and not all(r["cited"] for r in got)


def plain_calls(symbols, edges, roots, per_root, depth, recursive, total):
    fit = [s for s in symbols if s[1] == "s" and not s[0].startswith("local ") and "/test/" not in s[2]]
    by_id, by_name = {s[0]: s for s in fit}, collections.defaultdict(list)
    for s in fit:
        by_name[s[7]].append(s[0])
    out, expanded, used, front = [], set(), 0, list(dict.fromkeys(roots))
    folder = lambda f: f.rsplit("/", 1)[0]
    for level in range(depth):
        now = [x for x in front if x not in expanded]
        expanded |= set(now)
        rows = []
        for name in now:
            for a, b, kind, file, line, _ in edges:
                if a in by_name[name] and b in by_id and kind in ("call", "implements") and "/test/" not in file:
                    rows.append((name, kind != "call", file, line, by_id[b][7], by_id[b][2], by_id[b][3]))
        seen, counts, claimed, front = set(), collections.Counter(), collections.Counter(), []
        for parent, kind, file, line, target, t_file, _ in sorted(rows):
            if (parent, target, kind) in seen or counts[parent] >= per_root or (level and used >= total):
                continue
            seen.add((parent, target, kind))
            counts[parent] += 1
            used += level > 0
            out.append((parent, target, "implements" if kind else "call", level + 1, file, line))
            if target not in expanded and target not in front and claimed[parent] < recursive and folder(file) == folder(t_file):
                front.append(target)
                claimed[parent] += 1
    return set(out)


@pytest.mark.parametrize("caps", [(4, 3, 8, 48), (3, 4, 1, 5), (1, 2, 2, 3)])
def test_call_fanout_under_shared_budgets(spark, caps):
    symbols, edges = made_up(5, n_edges=260)
    names = sorted({s[7] for s in symbols})
    roots = {q: [names[(q * 11 + k * 3) % len(names)] for k in range(3)] for q in range(6)}
    requests = spark.createDataFrame([(q, "s", n) for q, r in roots.items() for n in r], "q int, source_name string, name string")
    got = fanout.call_fanout(requests, spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES), *caps).collect()
    for q, r in roots.items():
        assert {(x["parent"], x["target"], x["edge_type"], x["hop"], x["call_file"], x["call_line"]) for x in got if x["q"] == q} == plain_calls(symbols, edges, r, *caps)
    assert any(x["hop"] > 1 for x in got)


def test_a_common_token_is_split_and_found_whole(spark):
    symbols = [(f"i{k}", "s", "a/f.py", k, k + 1, "method", "x", f"m.Thing{k}.runAll", f"m.Thing{k}") for k in range(500)]
    postings, counts = token_index.token_index(spark.createDataFrame(symbols, SYMBOLS), bucket_rows=64)
    assert counts.where("token = 'thing'").first()["buckets"] == 8
    assert postings.where("token = 'thing'").groupBy("bucket").count().agg(F.max("count")).first()[0] < 128
    asked = spark.createDataFrame([("s", "thing", 1), ("s", "42", 2), ("s", "none", 3)], "source_name string, token string, q int")
    got = token_index.looked_up(asked, postings, counts).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in got} == {1: 500, 2: 1}
    q = spark.createDataFrame([(1, "s", "why does Thing42 call runAll of Thing43"), (2, "s", "nothing here"), (3, "s", "is THING7 or RunAll it")], "q int, source_name string, question string")
    seeds = collections.defaultdict(list)
    for r in sorted(token_index.question_seeds(q, (postings, counts), 3).collect(), key=lambda r: r["n"]):
        seeds[r["q"]].append(r["id"])
    # a name with capitals inside names code; of runAll's many owners those that share most with the question come first
    assert seeds[1][:2] == ["i42", "i43"] and len(seeds[1]) == 3 and 2 not in seeds and seeds[3][0] == "i7"
