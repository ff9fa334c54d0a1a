"""Views kept up to date by micro-batches (an incremental form of the usage and theme roll-ups).

``DailyUsage.apply`` is a ``foreachBatch`` function. A batch is merged by event id into the days that it touches: only those days
of the base table and of the view are written again, each into a folder of the batch's own, and then one manifest says which
folder holds which day. The manifest's rename is the commit: a batch that was killed before it leaves the old state,
and its replay writes the same folders again; a batch that was killed after it is known by its id and skipped. So every
event counts once, however often batches are replayed or sources repeat an event, and late events just rewrite
their day.

The manifest has one line a day and is the only thing the driver holds.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import cut

EVENT = "id long, ts timestamp, tool_name string, outcome string, score int"


def daily_usage(events: DataFrame) -> DataFrame:
    """The view in one batch: (day, tool_name, outcome, n, scored, total)."""
    once = _once(events.select("id", "ts", "tool_name", "outcome", "score"), [])
    return _rolled(once.withColumn("day", F.date_format("ts", "yyyy-MM-dd")))


def _once(events: DataFrame, first: list[str]) -> DataFrame:
    """One row an id and day: the earliest by ``first``, then by its own columns."""
    order = [*first, "ts", "tool_name", "outcome", "score"]
    keyed = events.withColumn("_day", F.date_format("ts", "yyyy-MM-dd"))
    return keyed.withColumn("_r", F.row_number().over(Window.partitionBy("id", "_day").orderBy(*order))).where("_r = 1").drop("_r", "_day")


def _rolled(events: DataFrame) -> DataFrame:
    return events.groupBy("day", "tool_name", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"), F.coalesce(F.sum("score"), F.lit(0)).alias("total"))


class DailyUsage:
    """The daily usage view in ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/manifests"))

    def _manifests(self) -> list[int]:
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """{"batch": last batch, "days": {day: batch that wrote it}}."""
        done = self._manifests()
        if not done:
            return {"batch": -1, "days": {}}
        text = self.spark.read.text(f"{self.folder}/manifests/{done[-1]:012d}.json", wholetext=True).first()["value"]
        return json.loads(text)

    def _commit(self, state: dict) -> None:
        name = f"{self.folder}/manifests/{state['batch']:012d}"
        out = self._fs.create(self._path(f"{name}.part"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{name}.part"), self._path(f"{name}.json")):
            raise OSError(f"{name}: not committed")

    def _read(self, table: str, days: dict[str, int], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={b}/day={d}" for d, b in sorted(days.items())]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, day string")
        read = self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*paths)
        return read.withColumn("day", F.date_format("day", "yyyy-MM-dd")).drop("batch")

    def base(self, days: dict[str, int]) -> DataFrame:
        return self._read("events", days, f"{EVENT}, arrived long")

    def read(self) -> DataFrame:
        """The view as of the last commit."""
        return self._read("view", self.manifest()["days"], "tool_name string, outcome string, n long, scored long, total long")

    def apply(self, batch: DataFrame, batch_id: int) -> bool:
        """Merge a batch (id, ts, tool_name, outcome, score); false when it was merged before."""
        state = self.manifest()
        if batch_id <= state["batch"]:
            return False
        new = cut(batch.select("id", "ts", "tool_name", "outcome", "score").withColumn("arrived", F.lit(batch_id).cast("long")))
        days = [r["day"] for r in new.select(F.date_format("ts", "yyyy-MM-dd").alias("day")).where("day is not null").distinct().collect()]
        if days:
            old = self.base({d: b for d, b in state["days"].items() if d in set(days)}).drop("day")
            merged = _once(old.unionByName(new.where("ts is not null")), ["arrived"]).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
            merged.repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/events/batch={batch_id}")
            fresh = self.base(dict.fromkeys(days, batch_id))
            _rolled(fresh).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.folder}/view/batch={batch_id}")
        self._commit({"batch": batch_id, "days": state["days"] | dict.fromkeys(days, batch_id)})
        return True

    def vacuum(self) -> int:
        """Delete folders of batches that the last commit doesn't name; the number of them."""
        state, gone = self.manifest(), 0
        used = set(state["days"].values())
        for table in ("events", "view"):
            root = self._path(f"{self.folder}/{table}")
            for f in self._fs.listStatus(root) if self._fs.exists(root) else []:
                batch = int(f.getPath().getName().split("=")[1])
                if batch <= state["batch"] and batch not in used:
                    gone += bool(self._fs.delete(f.getPath(), True))
        for b in self._manifests()[:-1]:
            self._fs.delete(self._path(f"{self.folder}/manifests/{b:012d}.json"), False)
        return gone


def dirty_themes(changed: DataFrame, members: DataFrame, graph: DataFrame) -> DataFrame:
    """(cluster, reason): clusters of changed elements (id), and ``neighbour`` for those that share an edge with one.

    ``members``: (id, cluster); ``graph``: (a, b). What a summary says of its neighbours is stale with them.
    """
    own = cut(members.join(changed.select("id").distinct(), "id", "left_semi").select("cluster").distinct())
    both = graph.select("a", "b").union(graph.select("b", "a"))
    near = both.join(members.select(F.col("id").alias("a"), F.col("cluster").alias("x")), "a").join(members.select(F.col("id").alias("b"), F.col("cluster").alias("cluster")), "b").where("x <> cluster")
    near = near.join(own.select(F.col("cluster").alias("x")), "x", "left_semi").select("cluster").distinct().join(own, "cluster", "left_anti")
    return own.withColumn("reason", F.lit("changed")).unionByName(near.withColumn("reason", F.lit("neighbour")))
