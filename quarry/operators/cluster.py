"""kNN joins, near-duplicates and clusters."""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.components import connected_components
from quarry.session import arrow_map, cut, stored

BLOCK = 8192
CHUNK = 512  # rows of a block that are multiplied at once
STRIPS = 16
PAIRS = 1 << 16  # of which both vectors are held at once
TIES = 1.1e-6  # what is nearer than this may be equal by six places
FINISH_EDGES = 1 << 16  # of a graph whose communities one task settles
PASSES = 10  # over all levels, as the surveyed optimiser makes
PASS_GAIN = 1e-3  # of modularity, below which no further pass by rounds is made
STALLED, GAIN = 4, 1e-5  # so many rounds of moves that raise it by no more end them


def best_of(li: np.ndarray, x: np.ndarray, ri: np.ndarray, y: np.ndarray, floor: float, k: int | None):
    """Arrays (a, b, sim) of the pairs of two blocks (ids, vectors) over the floor; where k is given, the best k of each left row,
    with all that a rounding to six places may put beside them."""
    for lo in range(0, len(x), CHUNK):
        part, ids = x[lo : lo + CHUNK], li[lo : lo + CHUNK]
        near = _screened(part, ri, y, floor, k) if k is not None else None
        if near is None:
            m = part @ y.T
            ok = m >= floor
            if k is not None and m.shape[1] > k:
                own = ok & (ids[:, None] != ri[None, :])
                ok &= m >= -np.partition(np.where(own, -m, np.inf), k - 1, axis=1)[:, k - 1, None] - TIES
            at = np.flatnonzero(ok)
            i, j, sims = at // len(y), at % len(y), m.reshape(-1)[at]
        else:
            i, j = near
            sims = np.concatenate([np.zeros(0), *(np.einsum("rw,rw->r", part[i[at : at + PAIRS]], y[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS))])
        ok = (ids[i] != ri[j]) & (sims >= floor)
        yield ids[i[ok]], ri[j[ok]], sims[ok]


def _screened(x: np.ndarray, ri: np.ndarray, y: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (i, j) of all that can be among the best k, by a product in single precision; None where it can't tell.

    The columns are dealt into strips: k columns are at least as good as the k-th best of the strips' best, so nothing is
    sorted but those. Rows of the same id count for nothing, so as many more are asked for; the bound on the product's error goes off twice.
    """
    want = k + int(np.unique(ri, return_counts=True)[1].max())
    strips = min(STRIPS, len(y) // (4 * want))
    error = 2.0**-22 * (x.shape[1] + 4) * np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1).max()
    if strips < 2 or not (error < 1e30).all():
        return None
    m = x.astype(np.float32) @ y.T.astype(np.float32)
    wide = len(y) // strips
    best = m[:, :wide].copy()
    for s in range(1, strips):
        np.maximum(best, m[:, s * wide : (s + 1) * wide], out=best)
    least = np.maximum(np.partition(best, wide - want, axis=1)[:, wide - want] - 2 * error - TIES, floor - error)
    at = np.flatnonzero(m >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
    return at // len(y), at % len(y)


def matrix(cells) -> np.ndarray:
    """Vectors of an Arrow list column."""
    flat, n = cells.flatten(), len(cells)
    wide = len(flat) // max(1, n)
    if cells.null_count or flat.null_count or (np.diff(np.asarray(cells.offsets)) != wide).any():
        return np.array(cells.to_pylist(), float)
    return np.asarray(flat).astype(float).reshape(n, wide)


def pair_of_blocks(li, x, ri, y, floor: float, k: int | None, half: bool, same: bool):
    """Arrow batches (a, b, sim) of one pair of blocks; ``half`` as in ``block_pairs``, ``same`` if it is a block with itself."""
    import pyarrow as pa

    for i, j, sims in best_of(li, x, ri, y, floor, k):
        if half:
            # inside a block both orders are there
            once = i < j if same else np.ones(len(i), bool)
            i, j, sims = np.minimum(i, j)[once], np.maximum(i, j)[once], sims[once]
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(sims)], ["a", "b", "sim"])


def block_pairs(batches, floor: float, k: int | None, half: bool = False):
    """Arrow batches (a, b, sim) of sorted batches (key columns, side, id, v): each key is one pair of blocks.

    ``half`` is for blocks of one table, of which every pair of blocks comes once: rows are a < b.
    """
    held, key = ([], []), None

    def flush():
        if held[0] and held[1]:
            (li, x), (ri, y) = (tuple(np.concatenate(c) for c in zip(*side, strict=True)) for side in held)
            yield from pair_of_blocks(li, x, ri, y, floor, k, half, key[0] == key[1])
        held[0].clear()
        held[1].clear()

    for batch in batches:
        *keys, ids, vecs = batch.columns
        keys, ids, x = np.stack([np.asarray(c) for c in keys], axis=1), np.asarray(ids), matrix(vecs)
        ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(ids)]
        for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
            if hi > lo:
                *now, side = keys[lo].tolist()
                if now != key:
                    yield from flush()
                    key = now
                held[side].append((ids[lo:hi], x[lo:hi]))
    yield from flush()


def blocked_pairs(queries: DataFrame, vecs: DataFrame, floor: float, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """Exact similarity search of ``queries`` (id, v) against ``vecs`` by pairs of blocks.

    Both sides are dealt into blocks by a hash of the id, each block is stored once, and every pair of blocks is one row: a matrix product
    that returns, for each query, only the rows over the floor (and the best k of that block). Work is the product of both sides, spread
    evenly; what is stored grows with the input, as tasks read blocks where they lie, and no pair list is ever shuffled.
    """
    q, v = _blocks(queries, 0, block), _blocks(vecs, 1, block)
    return _over_blocks(q.crossJoin(v.hint("shuffle_replicate_nl")), floor, k)


def self_pairs(vecs: DataFrame, floor: float, block: int = BLOCK) -> DataFrame:
    """The pairs a < b of one table over a floor: every pair of blocks once, which is half the work of ``blocked_pairs``."""
    mine = _blocks(vecs, 0, block)
    other = mine.withColumnsRenamed({f"{c}0": f"{c}1" for c in ("block", "ids", "wide", "v")})
    return _over_blocks(mine.join(other.hint("shuffle_replicate_nl"), F.col("block0") <= F.col("block1")), floor, None, half=True)


def _blocks(vecs: DataFrame, side: int, block: int) -> DataFrame:
    """(block, ids, wide, v), numbered by ``side``: a row for each block, whose vectors are the bytes of a matrix so wide, in a partition for each."""
    n = max(1, -(-vecs.count() // block))
    single = vecs.schema["v"].dataType.elementType.simpleString() == "float"

    def pack(batches):
        import pyarrow as pa

        held, key = [], None

        def row():
            ids, x = (np.concatenate(c) for c in zip(*held, strict=True))
            cells = [pa.array([key], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([x.shape[1]], pa.int32()), pa.array([x.astype(np.float32 if single else float).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(cells, names)

        for batch in batches:
            keys, ids, x = np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2))
            ends = [*(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
            for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                if hi > lo:
                    if held and keys[lo] != key:
                        yield row()
                        held.clear()
                    key = int(keys[lo])
                    held.append((ids[lo:hi], x[lo:hi]))
        if held:
            yield row()

    names = [f"{c}{side}" for c in ("block", "ids", "wide", "v")]
    dealt = vecs.select(F.pmod(F.xxhash64("id", *([F.lit(1)] * side)), F.lit(n)).cast("int").alias("block"), F.col("id").cast("long").alias("id"), "v")
    dealt = dealt.repartition(n, "block").sortWithinPartitions("block", "id")
    return cut(arrow_map(dealt, pack, "{} int, {} array<long>, {} int, {} binary".format(*names)))


def _unpacked(batch, row: int, at: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(block, ids, vectors) of the four columns of a stored block."""
    ids, wide, raw = np.asarray(batch.column(at + 1)[row].values), batch.column(at + 2)[row].as_py(), batch.column(at + 3)[row].as_buffer()
    kind = np.float32 if raw.size == 4 * wide * len(ids) else float
    return batch.column(at)[row].as_py(), ids, np.frombuffer(raw, kind).astype(float).reshape(len(ids), wide)


def _over_blocks(pairs: DataFrame, floor: float, k: int | None, half: bool = False) -> DataFrame:
    """Rows (a, b, sim) of pairs of blocks; ``half`` is for blocks of one table, of which every pair comes once: rows are a < b."""
    cells = ["block0", "ids0", "wide0", "v0", "block1", "ids1", "wide1", "v1"]

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                (left, li, x), (right, ri, y) = (_unpacked(batch, r, at) for at in (0, 4))
                yield from pair_of_blocks(li, x, ri, y, floor, k, half, left == right)

    return arrow_map(pairs.select(*cells), run, "a long, b long, sim double")


LISTS, FIT_ROWS, FIT_QUERIES = 64, 20_000, 400
RECALL = 0.95  # aimed at on the sample


def fit_lists(vecs: DataFrame, k: int, lists: int = LISTS, rows: int = FIT_ROWS, rounds: int = 10, seed: int = 3) -> tuple[np.ndarray, int]:
    """Unit centroids of the index's lists, by spherical k-means, and how many lists a query has to look into.

    Both come from about ``rows`` rows of the table (smallest hashes of the id) on the driver, the one bounded sample of the
    index. The second is the least number of lists that holds ``RECALL`` of the true k nearest of some sampled rows: few
    where vectors cluster, most of them where they do not.
    """
    n = vecs.count()
    hashed = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    usable = vecs.where(F.col("v").isNotNull() & (F.size("v") > 0) & (hashed < min(1 << 40, (1 << 40) * rows // max(1, n))))
    some = usable.orderBy(hashed, "id").limit(rows).select("v").collect()
    if not some:
        return np.zeros((0, 1)), 1
    raw = np.array([r["v"] for r in some], float)
    x = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = np.bincount(at, minlength=len(c)) > 0
        c = np.where(full[:, None], sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12), c)
    at = (raw @ c.T).argmax(axis=1)
    asked = np.arange(min(len(raw), FIT_QUERIES))
    sims = raw[asked] @ raw.T
    sims[asked, asked] = -np.inf
    near = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(raw) - 1)]
    rank = np.argsort(np.argsort(-(raw[asked] @ c.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(rank[asked[:, None], at[near]].reshape(-1))
    return c, int(ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))]) + 1 if len(ranks) else 1


def listed(vecs: DataFrame, centroids: np.ndarray, n: int) -> DataFrame:
    """Every row with its ``n`` nearest lists: (id, v, list)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids, cells = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(i, v) for i, v in zip(ids, cells, strict=True) if v]
            if not rows or not len(centroids):
                continue
            near = np.argsort(-(np.array([v for _, v in rows], float) @ centroids.T), axis=1, kind="stable")[:, :n]
            flat = [(i, v, int(c)) for (i, v), cs in zip(rows, near, strict=True) for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int64()), pa.array([r[1] for r in flat], pa.list_(pa.float64())), pa.array([r[2] for r in flat], pa.int32())], ["id", "v", "list"])

    return arrow_map(vecs.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")), run, "id long, v array<double>, list int")


def ann_search(queries: DataFrame, vecs: DataFrame, k: int = 10, floor: float = -1.0, block: int = BLOCK) -> DataFrame:
    """About the k nearest others of every query, from an index of inverted lists: (a, b, sim).

    Every row of ``vecs`` is in one list and every query looks into as many of them as the sample asks for. A list longer than ``block`` is dealt
    into blocks, and so are its queries, so that no task holds a whole hot list.
    """
    centroids, probes = fit_lists(vecs, k)
    index = cut(listed(vecs, centroids, 1))
    asked = cut(listed(queries, centroids, probes))
    size = lambda df, name: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    sizes = cut(size(index, "nv").join(size(asked, "nq"), "list"))
    deal = lambda df, own, other, side: (
        df.join(sizes, "list").select("list", "id", "v", F.pmod(F.xxhash64("id", F.lit(side)), F.col(own)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"), F.lit(side).alias("side"))
    )
    q = deal(asked, "nq", "nv", 0).select("list", F.col("mine").alias("qb"), F.col("theirs").alias("vb"), "side", "id", "v")
    v = deal(index, "nv", "nq", 1).select("list", F.col("theirs").alias("qb"), F.col("mine").alias("vb"), "side", "id", "v")
    dealt = q.unionByName(v).repartition("list", "qb", "vb").sortWithinPartitions("list", "qb", "vb", "side", "id")
    found = arrow_map(dealt, lambda batches: block_pairs(batches, floor, k), "a long, b long, sim double").withColumn("sim", F.round("sim", 6))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def knn_edges(queries: DataFrame, vecs: DataFrame, k: int = 5, floor: float = 0.6) -> DataFrame:
    """The k nearest others of every query, as canonical pairs with the larger similarity."""
    pairs = blocked_pairs(queries, vecs, floor, k).withColumn("sim", F.round("sim", 6))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    top = pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("sim").alias("sim"))


def replace_edges(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges at touched nodes go, the new ones come."""
    ids = touched.select("id")
    kept = old.join(ids, old["a"] == ids["id"], "left_anti").join(ids, F.col("b") == ids["id"], "left_anti")
    return kept.unionByName(new)


def edges_touching(edges: DataFrame, ids: DataFrame, both: bool, keep: bool = False) -> DataFrame:
    """Drop edges with any (or both) endpoints in ids; ``keep`` gives those edges instead."""
    flag = ids.select(F.col("id").alias("_i"), F.lit(True).alias("_f")).distinct()
    e = edges.join(flag.withColumnsRenamed({"_i": "_sa", "_f": "_fa"}), F.col("source_id") == F.col("_sa"), "left")
    e = e.join(flag.withColumnsRenamed({"_i": "_sb", "_f": "_fb"}), F.col("target_id") == F.col("_sb"), "left")
    fa, fb = F.coalesce("_fa", F.lit(False)), F.coalesce("_fb", F.lit(False))
    hit = (fa & fb) if both else (fa | fb)
    return e.where(hit if keep else ~hit).select(*edges.columns)


def index_stamp(rows: DataFrame) -> DataFrame:
    """Count and an order-free digest over (id, updated_at) that partial sums can build."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", "updated_at"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(h).alias("stamp"))


def similar_pairs(vecs: DataFrame, floor: float = 0.95, limit: int = 50) -> DataFrame:
    """Pairs a < b over the floor, rounded to 4 places, the best ``limit``."""
    pairs = self_pairs(vecs, floor)
    return pairs.select("a", "b", F.round("sim", 4).alias("sim")).orderBy(F.desc("sim"), "a", "b").limit(limit)


def hybrid_graph(edges: DataFrame, nodes: DataFrame, scale: float = 0.5) -> DataFrame:
    """Undirected weights over catalogue nodes: structural as they are, semantic scaled, others ignored, loops dropped."""
    w = F.when(F.col("edge_type") == "semantic", F.col("weight") * scale).when(F.col("edge_type").isin("import", "documents", "call", "contains"), F.col("weight"))
    e = edges.withColumn("w", w).where("w is not null and source_id <> target_id")
    n = nodes.select("id")
    e = e.join(n, e["source_id"] == n["id"], "left_semi").join(n, F.col("target_id") == n["id"], "left_semi")
    return e.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("w").alias("weight"))


def _local_moves(both: DataFrame, start: DataFrame, total: float, rounds: int | None) -> DataFrame:
    """(a, deg, label) after synchronous moves of nodes to the neighbouring community of the largest modularity gain.

    Only a share of the nodes, by a hash of the round, moves in one round, so that neighbours seldom swap labels; where a round lowers the
    modularity the share is halved. It ends when no node gains by a move, or when ``STALLED`` rounds bring no more than ``GAIN``; what has
    the largest modularity is returned. ``rounds`` ends it earlier.
    """
    # not by checkpoints, whose estimated sizes would be squared by every round
    label = top = start
    most, last, share, stalled = -1.0, -1.0, 2, 0
    for i in itertools.count() if rounds is None else range(rounds):
        mass = label.groupBy("label").agg(F.sum("deg").alias("mass"))
        near = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        scored = near.join(mass, "label").join(label.select("a", "deg", F.col("label").alias("own")), "a")
        stay = F.col("label") == F.col("own")
        rest = F.col("mass") - F.when(stay, F.col("deg")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("deg") * rest / F.lit(float(total)), 9)
        best = scored.groupBy("a").agg(F.max(F.struct(gain.alias("gain"), stay.alias("stay"), "label")).alias("m"), F.sum(F.when(stay, F.col("w")).otherwise(0.0)).alias("inside"))
        wants = F.coalesce((F.col("m.gain") > 0) & ~F.col("m.stay"), F.lit(False))
        moves = F.pmod(F.xxhash64("a", F.lit(i)), F.lit(share)) == 0
        now = stored(label.join(best, "a", "left").select("a", "deg", F.col("label").alias("old"), "inside", wants.alias("wants"), F.when(wants & moves, F.col("m.label")).otherwise(F.col("label")).alias("label")))
        old = now.groupBy("old").agg(F.sum("deg").alias("mass"), F.sum("inside").alias("inside"), F.sum(F.col("wants").cast("long")).alias("wants"))
        inside, squares, left = old.agg(F.sum("inside"), F.sum(F.col("mass") * F.col("mass")), F.sum("wants")).first()
        value = (inside or 0.0) / total - (squares or 0.0) / total / total
        stalled = 0 if value > most + GAIN else stalled + 1
        if value > most:
            most, top = value, label
        if not left or (rounds is None and stalled == STALLED):
            return top
        if value < last:
            share *= 2
        last, label = value, now.select("a", "deg", "label")
    return label


def _moved(i: np.ndarray, j: np.ndarray, w: np.ndarray, deg: np.ndarray, total: float, label: np.ndarray) -> np.ndarray:
    """Labels after single moves of nodes, in order, until none gains by one."""
    n = len(deg)
    ends, others, weights = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    by = np.lexsort((others, ends))
    at = np.searchsorted(ends[by], np.arange(n + 1)).tolist()
    others, weights, deg = others[by].tolist(), weights[by].tolist(), deg.tolist()
    mass = np.bincount(label, deg, n).tolist()
    label = label.tolist()
    queue, queued = deque(range(n)), [True] * n
    while queue:
        v = queue.popleft()
        queued[v] = False
        own, d = label[v], deg[v]
        sums: dict[int, float] = {own: 0.0}
        for e in range(at[v], at[v + 1]):
            c = label[others[e]]
            sums[c] = sums.get(c, 0.0) + weights[e]
        gain = {c: round(x - d * (mass[c] - (d if c == own else 0.0)) / total, 9) for c, x in sums.items()}
        to = max(gain, key=lambda c: (gain[c], c == own, -c))
        if to == own:
            continue
        mass[own] -= d
        mass[to] += d
        label[v] = to
        for e in range(at[v], at[v + 1]):
            u = others[e]
            if label[u] != to and not queued[u]:
                queued[u] = True
                queue.append(u)
    return np.array(label, np.int64)


def _settled(i: np.ndarray, j: np.ndarray, w: np.ndarray, deg: np.ndarray, total: float) -> np.ndarray:
    """Community of every node: moves, then the same on the graph of communities while that merges any; ``PASSES`` times from the
    single nodes, or until one changes nothing."""
    label = np.arange(len(deg))
    for _ in range(PASSES):
        x, y, z, mass, start, up = i, j, w, deg, label, np.arange(len(deg))
        while True:
            names, own = np.unique(_moved(x, y, z, mass, total, start), return_inverse=True)
            up = own[up]
            if len(names) == len(mass):
                break
            k, (x, y) = len(names), (own[x], own[y])
            code, back = np.unique(np.minimum(x, y)[x != y] * k + np.maximum(x, y)[x != y], return_inverse=True)
            z, mass = np.bincount(back, z[x != y], len(code)), np.bincount(own, mass, k)
            x, y, start = code // k, code % k, np.arange(k)
        pairs = len(np.unique(up * len(deg) + label))
        same = pairs == up.max() + 1 == len(np.unique(label))
        label = up
        if same:
            break
    return label


def _in_one_task(both: DataFrame, degree: DataFrame, total: float) -> DataFrame:
    """(a, label) by ``_settled`` over a bounded graph; a label is the smallest node of its community."""
    kind = degree.schema["a"].dataType.simpleString()
    rows = both.where("a < b").select("a", "b", "weight").unionByName(degree.select("a", F.lit(None).cast(kind).alias("b"), F.col("deg").alias("weight")))

    def run(batches):
        import pyarrow as pa

        t = pa.Table.from_batches(list(batches), rows_schema)
        if not len(t):
            return
        node = np.array(t["b"].is_null().combine_chunks().to_pylist())
        names = t["a"].filter(pa.array(node)).to_pylist()
        order = sorted(range(len(names)), key=names.__getitem__)
        names = [names[k] for k in order]
        place = {x: k for k, x in enumerate(names)}
        weight = t["weight"].to_numpy()
        i, j = (np.array([place[x] for x in t[c].filter(pa.array(~node)).to_pylist()], np.int64) for c in ("a", "b"))
        label = _settled(i, j, weight[~node], weight[node][order], total)
        _, first, own = np.unique(label, return_index=True, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"a": names, "label": [names[k] for k in first[own]]}, out_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    rows_schema, out = to_arrow_schema(rows.schema), degree.select("a", F.col("a").alias("label"))
    out_schema = to_arrow_schema(out.schema)
    return arrow_map(rows.coalesce(1), run, f"a {kind}, label {kind}")


def communities(graph: DataFrame, rounds: int | None = None, levels: int | None = None, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Modularity communities: local moves until none gains, then the same on the graph of communities while that merges any.

    A graph of at most ``finish_edges`` edges, be it of nodes or of communities, is settled in one task by single moves; larger ones by
    rounds. All of it is repeated from the single nodes, ``PASSES`` times or until that raises the modularity by no more than ``PASS_GAIN``. ``rounds`` and
    ``levels`` end it earlier, with one pass by rounds alone. Last, a community that is not connected inside is split into its connected
    parts, each named by its smallest node. A distributed stand-in for a sequential optimiser; isolated nodes are singletons.
    """
    whole = rounds is None and levels is None
    graph = cut(graph.select("a", "b", "weight"))
    flat = graph.where("a <> b")
    nodes = cut(flat.unionByName(flat.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    every = cut(nodes.groupBy("a").agg(F.sum("weight").alias("deg")))
    total = every.agg(F.sum("deg")).first()[0] or 1.0
    member, most = cut(every.select("a", F.col("a").alias("label"))), None
    for _ in range(PASSES if whole else 1):
        both, degree, start, found = nodes, every, member, member.select(F.col("a").alias("id"), F.col("a").alias("label"))
        for level in itertools.count() if levels is None else range(levels):
            if whole and (most is None or level) and both.count() <= 2 * finish_edges:
                moved = cut(_in_one_task(both, degree, total))
                found = stored(found.join(moved.select(F.col("a").alias("label"), F.col("label").alias("top")), "label").select("id", F.col("top").alias("label")))
                break
            moved = _local_moves(both, cut(degree.join(start, "a")), total, rounds)
            found = stored(found.join(moved.select(F.col("a").alias("label"), F.col("label").alias("top")), "label").select("id", F.col("top").alias("label")))
            merged = stored(moved.groupBy(F.col("label").alias("a")).agg(F.sum("deg").alias("deg")))
            if merged.count() == degree.count():
                break
            names = moved.select("a", "label")
            ends = both.join(names.withColumnsRenamed({"label": "x"}), "a").join(names.withColumnsRenamed({"a": "b", "label": "y"}), "b")
            both = stored(ends.where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight")))
            degree, start = merged, merged.select("a", F.col("a").alias("label"))
        if not whole or nodes.count() <= 2 * finish_edges:
            member = found.withColumnsRenamed({"id": "a"})
            break
        value = modularity(flat, found.withColumnsRenamed({"label": "cluster"})).first()[0]
        enough = most is not None and value <= most + PASS_GAIN
        if most is None or value > most:
            member, most = found.withColumnsRenamed({"id": "a"}), value
        if enough:
            break
    inside = flat.join(member.withColumnsRenamed({"label": "x"}), "a").join(member.withColumnsRenamed({"a": "b", "label": "y"}), "b").where("x = y")
    parts = connected_components(inside.select("a", "b")).withColumnsRenamed({"node": "id"})
    loops = graph.select(F.col("a").alias("id")).union(graph.select("b")).distinct()
    return loops.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def modularity(graph: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (id, cluster) of a weighted graph (a, b, weight) without loops."""
    e = graph.select("a", "b", "weight").where("a <> b")
    m = members.select("id", "cluster")
    inner = e.join(m.withColumnsRenamed({"id": "a", "cluster": "x"}), "a").join(m.withColumnsRenamed({"id": "b", "cluster": "y"}), "b").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0.0)).alias("inside"), F.sum("weight").alias("total"))
    ends = e.select(F.col("a").alias("id"), "weight").union(e.select("b", "weight")).join(m, "id").groupBy("cluster").agg(F.sum("weight").alias("deg")).agg(F.sum(F.col("deg") * F.col("deg")).alias("squares"))
    return inner.crossJoin(F.broadcast(ends)).select((F.col("inside") / F.col("total") - F.col("squares") / (4 * F.col("total") * F.col("total"))).alias("modularity"))


def reassign_tiny(members: DataFrame, graph: DataFrame, least: int) -> DataFrame:
    """Members of clusters under ``least`` move to the non-tiny neighbour cluster of the largest summed weight."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    m = members.join(size, "cluster")
    both = graph.select("a", "b", "weight").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    big = m.where(F.col("size") >= least).select(F.col("id").alias("b"), F.col("cluster").alias("to"))
    tiny = m.where(F.col("size") < least).select(F.col("id").alias("a"))
    pull = both.join(tiny, "a", "left_semi").join(big, "b").groupBy("a", "to").agg(F.round(F.sum("weight"), 9).alias("w"))
    best = pull.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("neg"), "to")).alias("m"))
    return members.join(best.select(F.col("a").alias("id"), "m.to"), "id", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))


def overlaps(new: DataFrame, old: DataFrame) -> DataFrame:
    """Jaccard overlap of every pair of a new and an old cluster that share a member."""
    both = new.select("id", F.col("cluster").alias("new")).join(old.select("id", F.col("cluster").alias("old")), "id").groupBy("new", "old").agg(F.count(F.lit(1)).alias("both"))
    sizes = lambda df, n: df.groupBy(F.col("cluster").alias(n)).agg(F.count(F.lit(1)).alias(f"n_{n}"))
    j = both.join(sizes(new, "new"), "new").join(sizes(old, "old"), "old")
    return j.select("new", "old", "n_new", F.round(F.col("both") / (F.col("n_new") + F.col("n_old") - F.col("both")), 6).alias("overlap"))


def stable_ids(new: DataFrame, old: DataFrame, floor: float = 0.5) -> DataFrame:
    """Largest new cluster first takes the id of its closest unused old one; else the hash of its smallest member.

    Two clusters over the 0.5 floor can't share a partner, so greedy order matters only for ties at the floor: a mutual
    best match by ordered windows gives the same ids without a sequential pass.
    """
    o = overlaps(new, old).where(F.col("overlap") >= floor)
    first = Window.partitionBy("old").orderBy(F.desc("n_new"), F.desc("overlap"), "new")
    own = Window.partitionBy("new").orderBy(F.desc("overlap"), "old")
    pick = o.withColumn("r1", F.row_number().over(own)).where("r1 = 1").withColumn("r2", F.row_number().over(first)).where("r2 = 1")
    name = new.groupBy("cluster").agg(F.substring(F.sha2(F.min("id").cast("string"), 256), 1, 12).alias("fresh"))
    names = name.join(pick.select(F.col("new").alias("cluster"), F.col("old").alias("kept")), "cluster", "left")
    return names.select("cluster", F.coalesce(F.col("kept").cast("string"), "fresh").alias("stable_id"))


def membership_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """New, deleted and changed members."""
    j = new.select("id", F.col("cluster").alias("new")).join(old.select("id", F.col("cluster").alias("old")), "id", "full")
    what = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return j.select("id", what.alias("change")).where("change is not null")


def two_sided(members: DataFrame, side: Column) -> DataFrame:
    """Clusters with members of both sides."""
    return members.groupBy("cluster").agg(F.max(side.cast("int")).alias("hi"), F.min(side.cast("int")).alias("lo")).where("hi = 1 and lo = 0").select("cluster")


def local_reassign(changed: DataFrame, graph: DataFrame, members: DataFrame) -> DataFrame:
    """Each changed element goes to the cluster of the largest summed neighbour weight; ties by cluster."""
    both = graph.select("a", "b", "weight").unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    pull = both.join(changed.select(F.col("id").alias("a")), "a", "left_semi").join(members.select(F.col("id").alias("b"), "cluster"), "b")
    summed = pull.groupBy("a", "cluster").agg(F.round(F.sum("weight"), 9).alias("w"))
    best = summed.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("neg"), "cluster")).alias("m"))
    return best.select(F.col("a").alias("id"), "m.cluster", F.round(-F.col("m.neg"), 6).alias("weight"))


def changed_elements(elements: DataFrame, synced: DataFrame) -> DataFrame:
    """Never synced, or another hash."""
    s = synced.select("id", F.col("hash").alias("_h"))
    return elements.join(s, "id", "left").where(~F.col("hash").eqNullSafe(F.col("_h")) | F.col("_h").isNull()).select("id")


def summary_hash(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """Order-free digest of a cluster's members and its summary."""
    h = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    m = members.groupBy("cluster").agg(F.sum(h).alias("h"), F.count(F.lit(1)).alias("n"))
    return m.join(summaries, "cluster", "left").select("cluster", F.sha2(F.concat_ws("|", "h", "n", F.coalesce("summary", F.lit(""))), 256).alias("summary_hash"))


def spherical_kmeans(vecs: DataFrame, n: int = 10, rounds: int = 15, seed: int = 42) -> DataFrame:
    """Cosine k-means from a seeded start; centres are one small aggregate a round."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if vecs.limit(1).count() == 0:
        return vecs.select("id", F.lit(0).alias("cluster"))
    f = vecs.select("id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=n, seed=seed, maxIter=rounds, distanceMeasure="cosine").fit(f).transform(f).select("id", F.col("prediction").alias("cluster"))


def cluster_labels(members: DataFrame, titles: DataFrame, skip: list[str], top: int = 3) -> DataFrame:
    """The commonest title words of each cluster."""
    w = members.join(titles, "id").select("cluster", F.explode(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    n = w.where((F.length("word") > 2) & ~F.col("word").isin(skip)).groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n"))
    r = n.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "word"))).where(F.col("r") <= top)
    return r.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "word"))), lambda x: x["word"]), " ").alias("label"))


def theme_listing(themes: DataFrame, members: DataFrame, docs: DataFrame, source: str | None = None) -> DataFrame:
    """Themes with member counts, optionally only those with a member of a source."""
    m = members.join(docs.select(F.col("id").alias("element_id"), "source_name"), "element_id")
    if source is not None:
        keep = m.where(F.col("source_name") == source).select("cluster_id").distinct()
        themes = themes.join(keep, "cluster_id", "left_semi")
    n = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("source_name").alias("sources"))
    return themes.join(n, "cluster_id", "left").select("cluster_id", "dirty", "association", F.coalesce("members", F.lit(0)).alias("members"), F.coalesce("sources", F.lit(0)).alias("sources"))


def coherence_counts(themes: DataFrame) -> DataFrame:
    """Coherent, incoherent, not judged, and the rate."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    yes, no = n(F.col("coherent")), n(~F.col("coherent"))
    return themes.agg(yes.alias("coherent"), no.alias("incoherent"), n(F.col("coherent").isNull()).alias("unjudged"), F.round(F.when(yes + no > 0, yes / (yes + no)), 6).alias("rate"))


def cross_references(imports: DataFrame, mentions: DataFrame, semantic: DataFrame) -> DataFrame:
    """One reference a pair, import before mention before semantic."""
    parts = [df.select("a", "b", F.lit(p).alias("p"), F.lit(k).alias("kind")) for p, (k, df) in enumerate((("import", imports), ("mention", mentions), ("semantic", semantic)))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("a <> b")
    return every.groupBy("a", "b").agg(F.min_by("kind", "p").alias("kind"))


def inject_references(docs: DataFrame, refs: DataFrame, titles: DataFrame) -> DataFrame:
    """A related section of linked titles at the end of each document with references."""
    names = refs.join(titles.select(F.col("id").alias("b"), "title"), "b").groupBy("a").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "title"))), "\n").alias("related"))
    j = docs.join(names, docs["id"] == names["a"], "left")
    return j.select("id", F.when(F.col("related").isNotNull(), F.concat("content", F.lit("\n\n## Related\n"), "related")).otherwise(F.col("content")).alias("content"))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """Groups of near-duplicate vectors from K05 pairs."""
    return connected_components(pairs, "a", "b")


def theta_pairs(vecs: DataFrame, floor: float) -> DataFrame:
    """The self theta join a < b over a similarity floor, by pairs of blocks."""
    near = self_pairs(vecs, floor - 1e-6)
    return near.select("a", "b", F.round("sim", 6).alias("sim")).where(F.col("sim") >= floor)
