"""Usage-log roll-ups (A01-A10, A20-A21, A24): all are partial aggregates over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import words


def since(usage: DataFrame, as_of: str | None, days: int | None) -> DataFrame:
    """Events of the last ``days`` days before ``as_of``; None is all time, 0 an empty window at as_of."""
    if days is None or as_of is None:
        return usage
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return usage.where((F.col("ts") >= start) & (F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")))


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


def hit_stats(usage: DataFrame) -> DataFrame:
    """Per served document, times served, and hits with a score of at least 5."""
    each = usage.select(F.explode("served").alias("doc_id"), "outcome", "score")
    return each.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("served"), _n((F.col("outcome") == "hit") & F.coalesce(F.col("score") >= 5, F.lit(False))).alias("hits")
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return usage.agg(
        F.count(F.lit(1)).alias("total"),
        _n(o == "hit").alias("hits"),
        _n(o == "miss").alias("misses"),
        F.countDistinct(F.to_date("ts")).alias("days"),
        F.round(F.avg("score"), 6).alias("avg_score"),
    )


def usage_by(usage: DataFrame, key: str) -> DataFrame:
    o = F.col("outcome")
    return usage.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), _n(o == "hit").alias("hits"), _n(o == "miss").alias("misses"))


def usage_by_day(usage: DataFrame, latest: int = 90) -> DataFrame:
    """Newest ``latest`` days, ascending."""
    days = usage_by(usage.withColumn("day", F.to_date("ts")), "day")
    return days.orderBy(F.desc("day")).limit(latest).orderBy("day")


def score_histogram(usage: DataFrame) -> DataFrame:
    return usage.where("score between 1 and 10").groupBy("score").agg(F.count(F.lit(1)).alias("n"))


def upper_median_score(usage: DataFrame) -> DataFrame:
    """Element n // 2 of the sorted scores, from the histogram: no list of all scores is made."""
    hist = usage.where("score is not null").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy())})
    return cum.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(F.min("score").alias("median_score"))


def recent_feedback(usage: DataFrame, limit: int = 20) -> DataFrame:
    return usage.where("feedback is not null").orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "feedback")


def gap_report(usage: DataFrame, queries: int = 5, limit: int = 20) -> DataFrame:
    """Unanswered topics: events by feedback text, the earliest few queries, last seen."""
    w = Window.partitionBy("feedback").orderBy("ts", "id")
    missed = usage.where("feedback is not null and outcome = 'miss'")
    first = missed.where("query is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= queries)
    some = first.groupBy("feedback").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "query"))), lambda x: x["query"]), ",").alias("queries"))
    all_ = missed.groupBy("feedback").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen"))
    return all_.join(some, "feedback", "left").orderBy(F.desc("n"), "feedback").limit(limit)


def low_score_reasons(usage: DataFrame, limit: int = 200, least: int = 15) -> DataFrame:
    """Reason texts of low scores; the filter on the reason comes after the limit."""
    low = usage.where("score <= 5 and feedback is not null").orderBy(F.desc("id")).limit(limit)
    reason = F.trim(F.regexp_extract("feedback", "^score:[0-9]+ - (.*)$", 1))
    vague = F.lower(reason).isin("bad", "wrong", "not useful", "irrelevant answer")
    return low.select("id", "score", reason.alias("reason")).where((F.length("reason") >= least) & ~vague)


def usage_by_document(usage: DataFrame, docs: DataFrame, limit: int = 20) -> DataFrame:
    """Most served documents; ids without a document are labelled as deleted."""
    n = usage.select(F.explode("served").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("served"))
    top = n.orderBy(F.desc("served"), "id").limit(limit)
    return top.join(docs.select("id", "title"), "id", "left").select("id", "served", F.coalesce("title", F.lit("(deleted)")).alias("title"))


def low_value_documents(usage: DataFrame, docs: DataFrame, min_serves: int = 5) -> DataFrame:
    """Served often, never a hit."""
    each = usage.select(F.explode("served").alias("id"), "outcome")
    agg = each.groupBy("id").agg(F.count(F.lit(1)).alias("served"), _n(F.col("outcome") == "hit").alias("hits"))
    return agg.where((F.col("served") >= min_serves) & (F.col("hits") == 0)).join(docs.select("id"), "id").select("id", "served")


def near_misses(usage: DataFrame, limit: int = 10) -> DataFrame:
    """Words longer than three letters in the feedback of misses, by how many misses share them."""
    each = usage.where("outcome = 'miss' and feedback is not null").select(F.explode(words(F.col("feedback"))).alias("word"))
    return each.where(F.length("word") > 3).groupBy("word").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "word").limit(limit)


def trends(usage: DataFrame) -> DataFrame:
    """Calls, hits, misses and hit rate by day."""
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0)
    return usage_by(usage.withColumn("day", F.to_date("ts")), "day").withColumn("hit_rate", F.round(rate, 6))


def estimate_roi(usage: DataFrame, per_hit: float = 5.0, per_miss: float = 1.0, cost_per_call: float = 0.01) -> DataFrame:
    """A10: minutes saved and cost."""
    t = usage_totals(usage)
    saved = per_hit * F.col("hits") - per_miss * F.col("misses")
    cost = F.col("total") * cost_per_call
    return t.select(saved.alias("minutes"), F.round(cost, 6).alias("cost"), F.round(F.when(cost > 0, saved / cost), 6).alias("ratio"))


def per_user(log: DataFrame) -> DataFrame:
    """Events by actor with the name seen last; order (-n, actor)."""
    o = F.col("outcome")
    return log.groupBy("actor").agg(
        F.count(F.lit(1)).alias("questions"), _n(o == "hit").alias("hits"), _n(o == "miss").alias("misses"), F.max_by("name", "pos").alias("name")
    )


def mean_tokens(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average by bucket; a bucket without rows is absent."""
    return log.groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def snapshot(usage: DataFrame) -> DataFrame:
    """Totals and daily counts as one JSON document."""
    days = usage_by_day(usage).agg(F.array_sort(F.collect_list(F.struct("day", "calls", "hits", "misses"))).alias("by_day"))
    return usage_totals(usage).crossJoin(F.broadcast(days)).select(F.to_json(F.struct("total", "hits", "misses", "by_day")).alias("report"))
