"""A kept vector index (K04): inverted lists of product-quantised residuals, with exact re-ranking.

The lists are fitted in two levels on a bounded sample: about the root of their number of groups, and inside each its share
of the lists; their number goes with the root of the number of rows, up to ``MAX_LISTS``. A row is put into the nearest
list of the nearest groups, and what remains of its vector is kept as one byte for each of ``PARTS`` parts. A search reads
the bytes of the lists that it looks into, keeps the best by the bytes, and takes the vectors of those alone to rank them exactly.
A query travels once to each folder of lists, not to each list, and a task takes ``SLICE`` rows at a time, so that its memory depends neither on the rows nor on the lists.

On disk an index is a folder that driver and executors share: ``rows/gen=G`` for every generation of rows, by groups of lists, and
``states/G``, one line of JSON written last, which names the generations that count and holds the model and the stamp of
the table (a count and an order-free digest, so new rows add to it). A search is refused where the table's stamp is another one.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators.cluster import BLOCK, index_stamp, matrix
from quarry.session import arrow_map, cut

FIT_ROWS, FIT_QUERIES, FIT_ROUNDS = 20_000, 400, 8
MAX_LISTS, LISTS_A_FOLDER = 2048, 64
GROUPS_ASKED = 4
PARTS, CODES = 16, 64
SLICE = 512  # rows that are placed, or queries that are compared, at once
RERANK = 20  # candidates a query for each row that it wants
RECALL = 0.96  # aimed at on the sample


class StaleIndex(ValueError):
    """The table is not the one that the index was built from."""


def _kmeans(x: np.ndarray, n: int, rounds: int = FIT_ROUNDS, sphere: bool = False) -> np.ndarray:
    """At most ``n`` centroids; from rows spread over ``x``, so the same rows give the same ones."""
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, c, sphere)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        count = np.bincount(at, minlength=len(c))
        full = count > 0
        c[full] = sums[full] / (np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-12) if sphere else count[full, None])
    return c


def _nearest(x: np.ndarray, c: np.ndarray, sphere: bool) -> np.ndarray:
    return (x @ c.T).argmax(axis=1) if sphere else ((c**2).sum(axis=1)[None, :] - 2 * x @ c.T).argmin(axis=1)


def _pack(x: np.ndarray) -> dict:
    return {"shape": x.shape, "kind": str(x.dtype), "data": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()}


def _unpack(x: dict) -> np.ndarray:
    return np.frombuffer(base64.b64decode(x["data"]), x["kind"]).reshape(x["shape"])


class Model:
    """groups, lists (centroids of both), owner (group of each list), books (PARTS x CODES x width), probes."""

    def __init__(self, groups: np.ndarray, lists: np.ndarray, owner: np.ndarray, books: np.ndarray, probes: int):
        self.groups, self.lists, self.owner, self.books, self.probes = groups, lists, owner, books, probes

    @classmethod
    def fit(cls, x: np.ndarray, rows: int, k: int) -> Model:
        """From sampled vectors of a table of ``rows`` rows, so that most of the true ``k`` nearest are found."""
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        want = int(np.clip(round(rows**0.5), 1, min(MAX_LISTS, max(1, len(x) // 8))))
        groups = _kmeans(unit, max(1, round(want**0.5)), sphere=True)
        at = _nearest(unit, groups, True)
        lists, owner = [], []
        for g in range(len(groups)):
            own = unit[at == g]
            if len(own):
                part = _kmeans(own, max(1, round(want * len(own) / len(unit))), sphere=True)
                lists.append(part)
                owner += [g] * len(part)
        model = cls(groups, np.concatenate(lists), np.array(owner), np.zeros((0, 0, 0)), 1)
        place = model.place(x)
        rest = x - model.lists[place]
        wide = -(-x.shape[1] // PARTS)
        rest = np.pad(rest, ((0, 0), (0, wide * PARTS - x.shape[1])))
        books = [_kmeans(rest[:, p * wide : (p + 1) * wide], CODES) for p in range(PARTS)]
        model.books = np.stack([np.concatenate([b, np.repeat(b[:1], CODES - len(b), axis=0)]) for b in books])
        # how deep the lists of the true nearest stand in a query's order of lists
        asked = np.arange(min(len(x), FIT_QUERIES))
        sims = x[asked] @ x.T
        sims[asked, asked] = -np.inf
        near = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
        depth = np.argsort(np.argsort(-(x[asked] @ model.lists.T), axis=1, kind="stable"), axis=1)
        ranks = np.sort(depth[asked[:, None], place[near]].reshape(-1))
        model.probes = int(ranks[min(len(ranks) - 1, int(RECALL * len(ranks)))]) + 1 if len(ranks) else 1
        return model

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest of those in its nearest groups."""
        top = np.argsort(-(x @ self.groups.T), axis=1, kind="stable")[:, :GROUPS_ASKED]
        near = x @ self.lists.T
        asked = np.zeros((len(x), len(self.groups)), bool)
        np.put_along_axis(asked, top, True, axis=1)
        return np.where(asked[:, self.owner], near, -np.inf).argmax(axis=1)

    def encode(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        wide = self.books.shape[2]
        rest = np.pad(x - self.lists[place], ((0, 0), (0, wide * PARTS - x.shape[1])))
        return np.stack([_nearest(rest[:, p * wide : (p + 1) * wide], self.books[p], False) for p in range(PARTS)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Similarity of queries to every code of every part."""
        wide = self.books.shape[2]
        return np.einsum("qpw,pcw->qpc", np.pad(q, ((0, 0), (0, wide * PARTS - q.shape[1]))).reshape(len(q), PARTS, wide), self.books)

    def guess(self, q: np.ndarray, tables: np.ndarray, place: int, codes: np.ndarray) -> np.ndarray:
        """Similarity of queries to the rows of one list by their bytes."""
        out = np.repeat((q @ self.lists[place])[:, None], len(codes), axis=1)
        for p in range(PARTS):
            out += tables[:, p, codes[:, p]]
        return out

    def dump(self) -> dict:
        return {"probes": self.probes} | {k: _pack(getattr(self, k)) for k in ("groups", "lists", "owner", "books")}

    @classmethod
    def load(cls, x: dict) -> Model:
        return cls(*(_unpack(x[k]) for k in ("groups", "lists", "owner", "books")), x["probes"])


def _usable(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(F.size("v") > 0)


def _slices(batches):
    """(ids, vectors) of ``SLICE`` rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            part = batch.slice(lo, SLICE)
            yield part.column(0), matrix(part.column(1))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1), kind))


def _sample(vecs: DataFrame, n: int) -> np.ndarray:
    hashed = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 40))
    some = vecs.where(F.size("v") > 0).where(hashed < min(1 << 40, (1 << 41) * FIT_ROWS // max(1, n)))
    return np.array([r["v"] for r in some.orderBy(hashed, "id").limit(FIT_ROWS).select("v").collect()], float)


class VectorIndex:
    """The index in ``folder`` of a table (id, v, updated_at)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def state(self) -> dict | None:
        root = self._path(f"{self.folder}/states")
        gens = [int(f.getPath().getName()) for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        # a folder without the writer's mark was never finished
        done = [g for g in gens if self._fs.exists(self._path(f"{self.folder}/states/{g}/_SUCCESS"))]
        return json.loads(self.spark.read.text(f"{self.folder}/states/{max(done)}").first()["value"]) if done else None

    def _commit(self, gen: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/states/{gen}")

    def _write(self, vecs: DataFrame, model: Model, gen: int) -> None:
        shared = self.spark.sparkContext.broadcast(model)

        def run(batches):
            for ids, x in _slices(batches):
                place = shared.value.place(x)
                codes = shared.value.encode(x, place)
                yield pa.RecordBatch.from_arrays([ids, _lists(x, pa.float64()), pa.array(place.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "list", "codes"])

        rows = arrow_map(_usable(vecs), run, "id long, v array<double>, list int, codes binary")
        folder = F.floor(F.col("list") / LISTS_A_FOLDER).cast("int")
        dealt = rows.withColumn("folder", folder).repartition("folder", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list", "id")
        dealt.write.mode("overwrite").partitionBy("folder").parquet(f"{self.folder}/rows/gen={gen}")

    def build(self, vecs: DataFrame, k: int = 10) -> None:
        """Fit on a sample, write every row, then the state."""
        stamp = index_stamp(vecs).first()
        sample = _sample(vecs, stamp["n"])
        gen = 1 + max(self.state()["gens"], default=0) if self.state() else 0
        model = Model.fit(sample, stamp["n"], k) if len(sample) else None
        if model is not None:
            self._write(vecs, model, gen)
        self._commit(gen, {"gens": [gen] if model is not None else [], "n": stamp["n"], "stamp": str(stamp["stamp"] or 0), "model": model.dump() if model is not None else None})

    def add(self, new: DataFrame) -> None:
        """Rows that the table has gained: put into the lists as they are, and added to the stamp."""
        state, more = self.state(), index_stamp(new).first()
        if state is None or state["model"] is None:
            raise StaleIndex("there is no index to add to")
        gen = 1 + max(state["gens"])
        self._write(new, Model.load(state["model"]), gen)
        total = int(state["stamp"]) + int(more["stamp"] or 0)
        self._commit(gen, state | {"gens": [*state["gens"], gen], "n": state["n"] + more["n"], "stamp": str(total)})

    def check(self, vecs: DataFrame) -> dict:
        state, now = self.state(), index_stamp(vecs).first()
        if state is None or (state["n"], int(state["stamp"])) != (now["n"], int(now["stamp"] or 0)):
            raise StaleIndex(f"the index in {self.folder} is not of this table: {None if state is None else state['n']} rows, now {now['n']}")
        return state

    def search(self, queries: DataFrame, vecs: DataFrame, k: int = 10, block: int = BLOCK) -> DataFrame:
        """(a, b, sim): about the k nearest others of every query (id, v) in the table, which has to be the index's own."""
        state = self.check(vecs)
        empty = self.spark.createDataFrame([], "a long, b long, sim double")
        if state["model"] is None:
            return empty
        shared = self.spark.sparkContext.broadcast(Model.load(state["model"]))
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*(f"{self.folder}/rows/gen={g}" for g in state["gens"]))

        def ask(batches):
            m = shared.value
            for ids, x in _slices(batches):
                near = np.argsort(-(x @ m.lists.T), axis=1, kind="stable")[:, : m.probes]
                yield pa.RecordBatch.from_arrays([ids, _lists(x, pa.float64()), _lists(near.astype(np.int32), pa.int32())], ["id", "v", "near"])

        asked = cut(arrow_map(_usable(queries), ask, "id long, v array<double>, near array<int>"))
        of = lambda x: F.floor(x / LISTS_A_FOLDER).cast("int")
        asked = asked.withColumn("folder", F.explode(F.array_distinct(F.transform("near", of)))).withColumn("near", F.filter("near", lambda x: of(x) == F.col("folder")))
        size = lambda df, name: df.groupBy("folder").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
        sizes = cut(size(rows, "nv").join(size(asked, "nq"), "folder"))
        # a folder longer than a block is dealt into blocks, and so are its queries
        blocks = lambda df, own, other, side: df.join(sizes, "folder").withColumns({"mine": F.pmod(F.xxhash64("id", F.lit(side)), F.col(own)).cast("int"), "theirs": F.explode(F.sequence(F.lit(0), F.col(other) - 1))})
        none = lambda kind: F.lit(None).cast(kind)
        q = blocks(asked, "nq", "nv", 0).select("folder", F.col("mine").alias("qb"), F.col("theirs").alias("vb"), F.lit(0).alias("side"), F.lit(-1).alias("list"), "id", "v", "near", none("binary").alias("codes"))
        v = blocks(rows.select("folder", "list", "id", "codes"), "nv", "nq", 1)
        v = v.select("folder", F.col("theirs").alias("qb"), F.col("mine").alias("vb"), F.lit(1).alias("side"), "list", "id", none("array<double>").alias("v"), none("array<int>").alias("near"), "codes")
        dealt = q.unionByName(v).repartition("folder", "qb", "vb").sortWithinPartitions("folder", "qb", "vb", "side", "list", "id")
        keep = RERANK * k

        def guess(batches):
            m = shared.value
            held, key = ([], []), None

            def flush():
                if held[0] and held[1]:
                    (a, x, asks), (b, lists, codes) = (tuple(np.concatenate(c) for c in zip(*side, strict=True)) for side in held)
                    at = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1), len(lists)]
                    for lo in range(0, len(a), SLICE):
                        part, want = x[lo : lo + SLICE], asks[lo : lo + SLICE]
                        tables = m.tables(part)
                        sims = np.full((len(part), len(b)), -np.inf)
                        for i, j in zip(at[:-1], at[1:], strict=True):
                            who = np.flatnonzero(want[:, lists[i] % LISTS_A_FOLDER])
                            if len(who):
                                sims[who, i:j] = m.guess(part[who], tables[who], lists[i], codes[i:j])
                        best = np.argpartition(-sims, keep, axis=1)[:, :keep] if len(b) > keep else np.tile(np.arange(len(b)), (len(part), 1))
                        row, best = np.repeat(np.arange(len(part)), best.shape[1]), best.reshape(-1)
                        got = np.isfinite(sims[row, best])
                        row, best = row[got], best[got]
                        yield pa.RecordBatch.from_arrays([pa.array(a[lo + row], pa.int64()), pa.array(b[best], pa.int64()), pa.array(lists[best], pa.int32()), pa.array(sims[row, best])], ["a", "b", "list", "guess"])
                held[0].clear()
                held[1].clear()

            for batch in batches:
                keys = np.stack([np.asarray(c) for c in batch.columns[:4]], axis=1)
                ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
                for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                    if hi == lo:
                        continue
                    *now, side = keys[lo].tolist()
                    if now != key:
                        yield from flush()
                        key = now
                    _, _, _, _, lists, ids, vecs, near, codes = batch.slice(lo, hi - lo).columns
                    if side == 0:
                        asks = np.zeros((hi - lo, LISTS_A_FOLDER), bool)
                        asks[np.repeat(np.arange(hi - lo), np.diff(np.asarray(near.offsets))), np.asarray(near.flatten()) % LISTS_A_FOLDER] = True
                        held[0].append((np.asarray(ids), matrix(vecs), asks))
                    else:
                        held[1].append((np.asarray(ids), np.asarray(lists), np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(hi - lo, PARTS)))
            yield from flush()

        found = arrow_map(dealt, guess, "a long, b long, list int, guess double").where("a <> b")
        order = Window.partitionBy("a").orderBy(F.col("guess").desc(), "b")
        best = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= keep).select("a", "b", "list")
        exact = best.join(rows.select("list", F.col("id").alias("b"), F.col("v").alias("y")), ["list", "b"]).join(queries.select(F.col("id").alias("a"), F.col("v").alias("x")), "a")
        sim = F.round(F.aggregate(F.zip_with("x", "y", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x), 6)
        exact = exact.select("a", "b", sim.alias("sim"))
        last = Window.partitionBy("a").orderBy(F.col("sim").desc(), "b")
        return exact.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= k).drop("_r")
