"""Causal chunks against a reading line by line; incremental views against their batch form, through kills and replays."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunks
from quarry.streaming import views


def code(line):
    return re.sub(chunks.COMMENT, "", re.sub(chunks.STRINGS, "", line))


def plain_statement(lines, i, most):
    """The shortest span around i between closed edges of one depth not passed below inside; null if too long."""
    depth, d = [], 0
    for x in lines:
        d += sum(code(x).count(c) for c in "([{") - sum(code(x).count(c) for c in ")]}")
        depth.append(d)
    closed = [not re.search(chunks.DOWN, code(x)) and not (j + 1 < len(lines) and re.search(chunks.UP, code(lines[j + 1]))) for j, x in enumerate(lines)]
    base = min(depth[i], depth[i - 1] if i else 0)
    best = None
    for a in range(max(-1, i - most), i):
        for b in range(i, min(len(lines), i + most + 1)):
            if not closed[b] or depth[b] > base or (a >= 0 and (not closed[a] or depth[a] > base)):
                continue
            inside = [depth[j] for j in range(a + 1, b) if closed[j]]
            left, right = [depth[j] for j in range(a + 1, i) if closed[j]], [depth[j] for j in range(i, b) if closed[j]]
            if a >= 0:
                fits = depth[a] == depth[b] and all(x > depth[a] for x in inside)
            else:
                fits = all(x > depth[b] for x in right) and (depth[b] <= 0 or (depth[b] == 0 and all(x > 0 for x in left)))
            if fits and (best is None or (a, -b) > (best[0], -best[1])):
                best = (a, b)
    return None if best is None or best[1] - best[0] > most else (best[0] + 1, best[1])


BODY = """def run(self,
        rows):
    total = 0
    for r in rows:  # all of (them
        total += weigh(
            r, ")",
            1)
    return (builder
        .add(total)
        .close())
"""


def statements_of(spark, text, seeds, most=40):
    bodies = spark.createDataFrame([(1, 1, text)], "body int, line_start int, content string")
    rows = chunks.statements(chunks.body_lines(bodies), spark.createDataFrame([(1, i) for i in seeds], "body int, ln int"), most).collect()
    return {r["ln"]: None if r["first"] is None else (r["first"], r["last"]) for r in rows}


def test_statements(spark):
    lines = BODY.split("\n")
    got = statements_of(spark, BODY, range(len(lines)))
    assert got[0] == got[1] == (0, 1) and got[2] == (2, 2) and got[5] == (4, 6) and got[8] == (7, 9)
    assert got == {i: plain_statement(lines, i, 40) for i in range(len(lines))}


@pytest.mark.parametrize("seed", range(3))
def test_statements_of_random_lines(spark, seed):
    rng = np.random.default_rng(seed)
    pieces = ["f(", ")", "a,", "b = 1", ".then(x)", "g({", "})", "x +", "'(('", "y  # ((", "[", "]", "end"]
    lines = [" " * int(rng.integers(0, 3)) + " ".join(rng.choice(pieces, int(rng.integers(1, 3)))) for _ in range(60)]
    got = statements_of(spark, "\n".join(lines), range(60), 12)
    assert got == {i: plain_statement(lines, i, 12) for i in range(60)}


def test_chunks_of_bodies(spark):
    long = "def f(a):\n" + "\n".join(f"  x{i} = {i}" for i in range(60))
    open_ = "start(\n" + "\n".join("  y" for _ in range(60))
    bodies = spark.createDataFrame([(1, 10, long), (2, 5, "one\ntwo"), (3, 1, long), (4, 1, open_), (5, 1, "")], "body int, line_start int, content string")
    seeds = spark.createDataFrame([(1, 15), (1, 16), (1, 40), (1, 999), (4, 1), (9, 1)], "body int, line int")
    got = sorted(tuple(r)[:4] for r in chunks.causal_chunks(bodies, seeds).collect())
    assert got == [(1, 10, 10, "signature"), (1, 15, 16, "call_site"), (1, 40, 40, "call_site"), (2, 5, 6, "short_body"), (3, 1, 1, "signature"), (4, 1, 61, "unisolatable"), (5, 1, 1, "short_body")]
    text = {(r["body"], r["line_start"]): r["text"] for r in chunks.causal_chunks(bodies, seeds).collect()}
    assert text[1, 15] == "  x4 = 4\n  x5 = 5" and text[2, 5] == "one\ntwo"


EVENTS = "id long, ts timestamp, tool_name string, outcome string, score int"


def made_up(spark, n=300):
    some = spark.range(n).select("id", (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 1789)).alias("ts"), F.concat(F.lit("t"), F.col("id") % 3).alias("tool_name"))
    return some.select("*", F.when(F.col("id") % 2 == 0, "hit").otherwise("miss").alias("outcome"), F.when(F.col("id") % 5 > 0, (F.col("id") % 10).cast("int")).alias("score"))


def rows(df):
    return sorted(tuple(r) for r in df.select("day", "tool_name", "outcome", "n", "scored", "total").collect())


def test_view_through_kills_late_and_repeated_events(spark, tmp_path, monkeypatch):
    events = made_up(spark)
    # the last file brings late events, every file repeats some of the one before
    for k, part in enumerate(["id % 4 = 1", "id % 4 = 2 or (id % 4 = 1 and id % 3 = 0)", "id % 4 = 3", "id % 4 = 0 or id < 40"]):
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"f{k}"))
    (tmp_path / "flat").mkdir()
    for k in range(4):
        next((tmp_path / "in" / f"f{k}").glob("*.parquet")).rename(tmp_path / "flat" / f"{k}.parquet")
    view = views.DailyUsage(spark, str(tmp_path / "view"))
    commit, kills = view._commit, {1: 1, 3: 2}

    def killed(state):
        """Batch 1 dies before its commit, batch 3 after it."""
        how = kills.pop(state["batch"], 0)
        if how == 1:
            raise RuntimeError("killed before the commit")
        commit(state)
        if how == 2:
            raise RuntimeError("killed after the commit")

    monkeypatch.setattr(view, "_commit", killed)

    def run():
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
        q = stream.writeStream.foreachBatch(lambda df, i: view.apply(df, i) and None).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    failures = 0
    for _ in range(3):
        try:
            run()
            break
        except Exception as dead:
            assert "killed" in str(dead)
            failures += 1
    assert failures == 2 and not kills
    assert rows(view.read()) == rows(views.daily_usage(events))
    assert view.apply(events, 3) is False
    before = rows(view.read())
    assert view.vacuum() >= 0 and rows(view.read()) == before


def test_only_changed_days_are_written_again(spark, tmp_path):
    view = views.DailyUsage(spark, str(tmp_path / "view"))
    assert view.read().count() == 0
    events = made_up(spark)
    assert view.apply(events, 0) and view.apply(events.where("id = 7").withColumn("id", F.lit(9999).cast("long")), 1)
    days = view.manifest()["days"]
    assert sorted(set(days.values())) == [0, 1] and list(days.values()).count(1) == 1
    assert view.apply(events.where("false"), 2) and view.manifest()["days"] == days
    assert view.read().agg(F.sum("n")).first()[0] == 301


def test_dirty_themes_reach_their_neighbours(spark):
    members = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "d")], "id int, cluster string")
    graph = spark.createDataFrame([(2, 3), (4, 3), (5, 4), (1, 2)], "a int, b int")
    got = {tuple(r) for r in views.dirty_themes(spark.createDataFrame([(1,), (8,)], "id int"), members, graph).collect()}
    assert got == {("a", "changed"), ("b", "neighbour")}
