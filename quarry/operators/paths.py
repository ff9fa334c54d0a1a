"""Searches that keep predecessors: paths between named symbols.

Every search has one row a visited node, with the level and the parent it was first reached from; paths are rebuilt by
walking the parents back, so the frontier never carries a path. Searches of the same start are one search, whoever asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.filters import is_production
from quarry.session import cut, stored


def addressable(symbols: DataFrame) -> DataFrame:
    """Symbols that may be endpoints: not bindings local to a body."""
    return symbols.where(~F.col("id").startswith("local "))


def predecessors(edges: DataFrame, starts: DataFrame, depth: int, most: int, ends: DataFrame) -> DataFrame:
    """Breadth-first levels from many starts at once: (start columns, id, parent, level).

    ``edges`` (caller, callee) are distinct; ``starts`` has the columns that name a search and ``id``. Of each level of a
    search only the ``most`` smallest ids go on; a node keeps the smallest parent of its first level. From the last level
    nothing goes on, so of its nodes only those in ``ends`` (``starts``' columns) are kept.
    """
    key = [c for c in starts.columns if c != "id"]
    front = stored(starts.distinct().select(*key, "id", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("level")))
    seen = front
    for level in range(1, depth + 1):
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
        going = front.withColumn("_r", rank).where(F.col("_r") <= most).select(*key, F.col("id").alias("caller"))
        met = going.join(edges, "caller")
        if level == depth:
            met = met.join(ends.select(*key, F.col("id").alias("callee")), [*key, "callee"], "left_semi")
        new = met.groupBy(*key, F.col("callee").alias("id")).agg(F.min("caller").alias("parent"))
        # every level is a table of its own, so the levels before are read and never worked out again
        front = stored(new.join(seen.select(*key, "id"), [*key, "id"], "left_anti").select(*key, "id", "parent", F.lit(level).alias("level")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def walk_back(seen: DataFrame, hits: DataFrame, key: list[str], depth: int) -> DataFrame:
    """The steps of the paths that end in ``hits`` (own columns, key, id, level, parent): own columns, key and id with level, from the start on."""
    own = [c for c in hits.columns if c not in ("level", "parent")]
    at = steps = hits.where(F.col("level") == depth)
    for level in range(depth - 1, -1, -1):
        # a parent stands on the level before, so every level is read once
        before = at.select(*(F.col("parent").alias("id") if c == "id" else c for c in own)).join(seen.where(F.col("level") == level), [*key, "id"])
        at = stored(before.select(*hits.columns).unionByName(hits.where(F.col("level") == level)))
        steps = steps.unionByName(at)
    return steps.select(*own, "level")


def connect_targets(edges: DataFrame, symbols: DataFrame, targets: DataFrame, depth: int = 4, most: int = 200) -> DataFrame:
    """Paths over calls and type references between the first symbol of a group and each other one.

    ``targets``: (grp, source_name, pos, qname). A name stands for every symbol of that name in the source. The path goes
    forward from the root, or, where there is none, from the target to the root; of targets reached on the same level
    the smallest id counts. Nodes of other sources are walked through and then left out; ``cited`` tells whether the step
    from the one before is an edge between production symbols (the first step of a path is where it starts).
    Returns grp, target, backward, pos, id, qname, cited.
    """
    first = Window.partitionBy("grp").orderBy("pos", "qname")
    named = targets.groupBy("grp", "source_name", "qname").agg(F.min("pos").alias("pos"))
    named = named.withColumn("root", F.first("qname").over(first))
    pairs = cut(named.where(F.col("qname") != F.col("root")).select("grp", "source_name", "root", F.col("qname").alias("target")))
    edges = stored(edges.where("edge_type in ('call', 'type_ref')").select("caller", "callee").distinct())
    key = ["source_name", "start"]
    ahead = pairs.select("grp", "source_name", F.col("root").alias("start"), F.col("target").alias("finish"))
    # either way, as a search forward also serves pairs that are searched backward from its start
    ways = ahead.select(*key, "finish").unionByName(ahead.select("source_name", F.col("finish").alias("start"), F.col("start").alias("finish"))).distinct()
    # the symbols of all names are looked up once
    called = addressable(symbols).select("source_name", F.col("qname").alias("start"), "id")
    ids = stored(called.join(ways.select(*key).distinct(), key, "left_semi"))
    ends = stored(ways.join(ids.withColumnRenamed("start", "finish"), ["source_name", "finish"]).select(*key, "id").distinct())

    def searched(asked: DataFrame) -> DataFrame:
        return predecessors(edges, asked.join(ids, key).select(*key, "id"), depth, most, ends)

    def reached(asked: DataFrame, seen: DataFrame) -> DataFrame:
        """The first hit of each (grp, start, finish)."""
        ends = asked.join(ids.withColumnRenamed("start", "finish"), ["source_name", "finish"])
        met = ends.join(seen.where("level > 0"), [*key, "id"])
        best = met.groupBy("grp", *key, "finish").agg(F.min(F.struct("level", "id", "parent")).alias("hit"))
        return best.select("grp", *key, "finish", "hit.id", "hit.level", "hit.parent")

    forward = searched(ahead.select(*key).distinct())
    hits = cut(reached(ahead, forward).withColumn("backward", F.lit(False)))
    rest = ahead.join(hits, ["grp", "start", "finish"], "left_anti")
    back = cut(rest.select("grp", "source_name", F.col("finish").alias("start"), F.col("start").alias("finish")))
    # a start that was searched from already is not searched from again
    known = ahead.select(*key).distinct()
    fresh = searched(back.select(*key).distinct().join(known, key, "left_anti"))
    seen = forward.unionByName(fresh)
    hits = stored(hits.unionByName(reached(back, seen).withColumn("backward", F.lit(True))))

    steps = walk_back(seen, hits, key, depth)
    place = symbols.select("source_name", "id", "qname", is_production(F.col("file")).alias("_p"))
    steps = steps.join(place, ["source_name", "id"])
    path = Window.partitionBy("grp", "start", "finish").orderBy("level")
    before = F.lag(F.struct("level", "_p")).over(path)
    cited = F.coalesce((before["level"] == F.col("level") - 1) & before["_p"], F.col("level") == 0) & F.col("_p")
    pos = (F.row_number().over(path) - 1).alias("pos")
    whole = steps.select("grp", F.when(F.col("backward"), F.col("start")).otherwise(F.col("finish")).alias("target"), "backward", pos, "id", "qname", cited.alias("cited"), F.count(F.lit(1)).over(Window.partitionBy("grp", "start", "finish")).alias("_n"))
    return whole.where("_n > 1").drop("_n")
