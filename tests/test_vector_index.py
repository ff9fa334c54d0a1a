"""The kept vector index: recall against brute force, rows added, staleness, and an interrupted build."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.catalog import QUERIES
from quarry.operators import cluster
from quarry.operators.vector_index import StaleIndex, VectorIndex
from quarry.plans.tables import kb


def recall(got, exact):
    best = {}
    for r in exact.collect():
        best.setdefault(r["a"], []).append((-r["sim"], r["b"]))
    want = {(a, b) for a, rows in best.items() for _, b in sorted(rows)[:10]}
    return len({(r["a"], r["b"]) for r in got.collect()} & want) / len(want)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_registered_query(spark, sf):
    d = f"/root/testdata/{sf}"
    v = kb(spark, d, "vecs").select("id", "v")
    exact = cluster.blocked_pairs(v.where("id % 20 = 0"), v, -1.0, 10)
    assert recall(QUERIES["k04_kept_index"](spark, d), exact) >= 0.9


def clustered(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=24)).tolist(), f"t{i % 3}") for i in range(n)]
    return spark.createDataFrame(rows, "id long, v array<double>, updated_at string").repartition(4)


def test_build_add_search(spark, tmp_path):
    every = clustered(spark, 3000)
    index = VectorIndex(spark, str(tmp_path / "index"))
    with pytest.raises(StaleIndex):
        index.search(every, every)
    index.build(every.where("id < 2000"))
    model = index.state()["model"]
    queries = every.where("id % 20 = 0").select("id", "v")
    exact = cluster.blocked_pairs(queries, every.select("id", "v"), -1e9, 10)
    with pytest.raises(StaleIndex):  # the table has more rows than the index
        index.search(queries, every)
    index.add(every.where("id >= 2000"))
    assert index.state()["model"] == model and index.state()["n"] == 3000
    got = index.search(queries, every)
    assert recall(got, exact) >= 0.9 and got.groupBy("a").count().where("count <> 10").count() == 0
    # few of the lists are looked into where vectors cluster
    assert model["probes"] * 3 < model["lists"]["shape"][0]
    again = VectorIndex(spark, str(tmp_path / "index"))
    assert {tuple(r) for r in again.search(queries, every, block=50).select("a", "b").collect()} and recall(again.search(queries, every, block=50), exact) >= 0.9
    with pytest.raises(StaleIndex):  # a row was updated
        again.search(queries, every.withColumn("updated_at", F.when(F.col("id") == 7, "new").otherwise(F.col("updated_at"))))


def test_a_query_goes_once_to_each_folder(spark, tmp_path, monkeypatch):
    """What a task writes for a slice of queries depends neither on the lists they look into nor on the queries."""
    from quarry.operators import vector_index

    every = clustered(spark, 1200)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(every, 100)  # neighbours of several clusters
    seen, rows, plain = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), vector_index.arrow_map

    def watched(df, fn, schema):
        def run(batches):
            for b in fn(batches):
                if "guess" not in schema and "codes" not in schema:
                    rows.add(b.num_rows)
                    seen.add(b.num_rows > vector_index.SLICE)
                yield b

        return plain(df, run, schema)

    monkeypatch.setattr(vector_index, "arrow_map", watched)
    assert index.search(every.select("id", "v"), every).select("a").distinct().count() == 1200
    assert index.state()["model"]["probes"] > 1 and (rows.value, seen.value) == (1200, 0)


def test_an_interrupted_addition_counts_for_nothing(spark, tmp_path, monkeypatch):
    every = clustered(spark, 300)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(every.where("id < 200"))
    with monkeypatch.context() as m:
        m.setattr(index, "_commit", lambda gen, state: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            index.add(every.where("id >= 200"))
    old = every.where("id < 200")
    assert index.search(old.where("id = 0").select("id", "v"), old).count() == 10
    index.add(every.where("id >= 200"))
    assert {r["b"] >= 200 for r in index.search(every.where("id = 250").select("id", "v"), every).collect()} >= {True}


def test_missing_vectors_and_empty_tables(spark, tmp_path):
    few = spark.createDataFrame([(1, [1.0, 0.0], "t"), (2, [0.9, 0.1], "t"), (3, None, "t"), (4, [], "t")], "id long, v array<double>, updated_at string")
    index = VectorIndex(spark, str(tmp_path / "few"))
    index.build(few)
    assert {(r["a"], r["b"]) for r in index.search(few.select("id", "v"), few).collect()} == {(1, 2), (2, 1)}
    none = VectorIndex(spark, str(tmp_path / "none"))
    none.build(few.limit(0))
    assert none.search(few.select("id", "v"), few.limit(0)).count() == 0
