"""Connected components by randomised contraction.

Every round maps each node to the node of its closed neighbourhood that comes first in a random order of that round, and
puts the edges between these representatives. The number of nodes falls by a constant share a round whatever the shape
of the graph, and edges inside a group vanish, so rounds get cheaper. A round is a min-aggregate (partial on the map
side) and two joins whose sides are tables of their own, which AQE can split where a node is a hub; no task gathers the
neighbours of one node. When at most ``FINISH_EDGES`` edges are left, one task joins them up by union-find. Nothing
about the graph reaches the driver but one count a round.

Many small graphs, one a request, need no rounds: a task that has all rows of a request labels its parts (``parts_of_requests``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import arrow_map, cut

FINISH_EDGES = 1 << 14
MAX_ROUNDS = 200
#: Rows of requests that are labelled together; a request of more goes by the rounds.
CHUNK_ROWS = 1 << 16


def _finish(edges: DataFrame, kind: str) -> DataFrame:
    """(v, rep) over at most ``FINISH_EDGES`` edges, in one task."""

    def run(batches):
        import pyarrow as pa

        parent: dict = {}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        nodes = list(parent)
        if nodes:
            values = pa.array([*nodes, *map(root, nodes)])
            yield pa.RecordBatch.from_arrays([values[: len(nodes)], values[len(nodes) :]], ["v", "rep"])

    return arrow_map(edges.select("a", "b").coalesce(1), run, f"v {kind}, rep {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Return ``(node, component)`` for every node on an edge; ``component`` is its smallest node.

    Nulls in either column and self-loops carry no link and are left out; repeated edges are harmless;
    an empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    kind = pairs.schema["a"].dataType.simpleString()
    now = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    for k in range(MAX_ROUNDS):
        if now.count() <= finish_edges:
            break
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        # both ends of an edge get its first end; a node also counts itself
        both = now.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.*")
        first = both.groupBy("v").agg(F.min(order("w")).alias("m")).select("v", F.least("m", order("v"))["n"].alias("rep"))
        first = cut(first)
        maps.append(first)
        left = now.join(first.withColumnsRenamed({"v": "a", "rep": "x"}), "a").select("b", "x")
        right = left.join(first.withColumnsRenamed({"v": "b", "rep": "y"}), "b").where("x <> y")
        now = cut(right.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    found = _finish(now, kind)
    for first in reversed(maps):
        up = cut(found).select(F.col("v").alias("rep"), F.col("rep").alias("top"))
        found = first.join(up, "rep", "left").select("v", F.coalesce("top", "rep").alias("rep"))
    found = cut(found)
    if not maps:  # union-find names a group by its smallest node
        return found.select(F.col("v").alias("node"), F.col("rep").alias("component"))
    least = cut(found.groupBy("rep").agg(F.min("v").alias("component")))
    return found.join(least, "rep").select(F.col("v").alias("node"), "component")


def _coded(q, a, b):
    """The names, their sorted order, and both ends as numbers that sort by (q, name); nulls are -1."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    code = rank[names.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)]
    n = len(a)
    group = q.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) * (len(order) + 1)
    left, right = (np.where(c < 0, -1, group + c) for c in (code[:n], code[n:]))
    return names.dictionary, order, left, right


def _joined(nodes, left, right):
    """For each of the sorted ``nodes`` the place of the smallest that the links (places) lead to."""
    import numpy as np

    top = np.arange(len(nodes))
    while True:
        x, y = top[left], top[right]
        low, new = np.minimum(x, y), top.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == top).all():
            return top
        top = new


def parts_of_requests(rows: DataFrame) -> DataFrame:
    """Adds ``part``, the smallest node of its request that a row's node is connected with.

    ``rows``: q, a, b, link and more columns, dealt and sorted by q, with at most some ``CHUNK_ROWS`` a request. Rows with ``link``
    join a and b (a null end joins nothing, and the other end is still a node); the others ask for the part of ``a``, and those
    whose ``a`` is on no link are left out.
    """
    part = rows.schema["a"].dataType.simpleString()

    def label(t):
        import numpy as np
        import pyarrow as pa

        link = t["link"].to_numpy()
        names, order, left, right = _coded(t["q"], t["a"], t["b"])
        right = np.where(link, right, -1)
        nodes = np.unique(np.concatenate([left[link], right]))
        nodes = nodes[nodes >= 0]
        both = (left >= 0) & (right >= 0)
        top = _joined(nodes, np.searchsorted(nodes, left[both]), np.searchsorted(nodes, right[both]))
        at = np.where(left >= 0, left, right)
        place = np.minimum(np.searchsorted(nodes, at), max(len(nodes) - 1, 0))
        known = (at >= 0) & (nodes[place] == at) if len(nodes) else np.zeros(len(at), bool)
        first = order[nodes[top[place[known]]] % (len(order) + 1)]
        return t.filter(pa.array(known)).append_column("part", names.take(pa.array(first)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < CHUNK_ROWS:
                continue
            t = pa.Table.from_batches(held)
            last = t["q"][len(t) - 1].as_py()
            # the last request may go on in the next batch
            cut_at = int(np.searchsorted(t["q"].to_numpy(), last)) if isinstance(last, int) else next(i for i in range(len(t)) if t["q"][i].as_py() == last)
            if cut_at:
                yield from label(t.slice(0, cut_at)).to_batches()
            held = t.slice(cut_at).combine_chunks().to_batches()
            size = len(t) - cut_at
        if size:
            yield from label(pa.Table.from_batches(held)).to_batches()

    return arrow_map(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", part {part}")
