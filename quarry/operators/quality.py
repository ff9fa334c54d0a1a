"""Corpus statistics and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import ancestors


def stats_by_source(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents, characters, vectors and chunks by source; sources only in chunks are left out."""
    s = F.coalesce("source_name", F.lit("unknown"))
    d = docs.groupBy(s.alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("content")).alias("chars"), F.sum(F.col("has_vector").cast("long")).alias("vectors"))
    c = chunks.join(docs.select(F.col("id").alias("document_id"), s.alias("source")), "document_id").groupBy("source").agg(F.count(F.lit(1)).alias("chunks"))
    return d.join(c, "source", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))


def stats_rollup(docs: DataFrame) -> DataFrame:
    """A11 as ROLLUP over source and type (an extension)."""
    return docs.rollup("source_name", "content_type").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("content")).alias("chars"))


def source_signature(docs: DataFrame) -> DataFrame:
    """count|latest change."""
    return docs.groupBy("source_name").agg(F.concat_ws("|", F.count(F.lit(1)), F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm:ss")).alias("signature"))


def health(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """One row a check with its value and state."""
    a = docs.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("has_vector").cast("long")).alias("vec"), F.sum((F.length("content") < 100).cast("long")).alias("short"),
        F.sum((F.coalesce(F.size("files"), F.lit(0)) <= 0).cast("long")).alias("no_files"), F.sum((F.col("status") == "deprecated").cast("long")).alias("deprecated"),
    )
    dup = docs.groupBy("title").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("dup"))
    orphan = sections.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan"))
    one = a.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(orphan)).withColumn("pct", F.when(F.col("n") > 0, F.floor(100 * F.col("vec") / F.col("n"))).otherwise(0))
    state = lambda c: F.when(c == 0, "ok").otherwise("warning")
    checks = [
        ("documents", F.col("n"), F.when(F.col("n") > 0, "ok").otherwise("error")), ("embedded_pct", F.col("pct"), F.when(F.col("pct") >= 90, "ok").when(F.col("pct") >= 50, "warning").otherwise("error")),
        ("short", F.col("short"), state(F.col("short"))), ("no_files", F.col("no_files"), state(F.col("no_files"))), ("duplicate_titles", F.col("dup"), state(F.col("dup"))),
        ("orphan_sections", F.col("orphan"), state(F.col("orphan"))), ("deprecated", F.col("deprecated"), state(F.col("deprecated"))),
    ]
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("check"), v.cast("long").alias("value"), s.alias("state")) for k, v, s in checks))))


def debt_score(docs: DataFrame, graph: DataFrame, usage: DataFrame) -> DataFrame:
    """Coverage 40, vectors 15, duplicate titles 15, graph 15, hit rate 15; lower is better, graded 10/25/45/65."""
    d = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_vector").cast("long")).alias("vec"), F.countDistinct("title").alias("titles"), F.sum((F.size("files") > 0).cast("long")).alias("covered"))
    g = graph.agg(F.countDistinct("source_id").alias("linked"))
    u = usage.agg(F.sum((F.col("outcome") == "hit").cast("long")).alias("hits"), F.sum((F.col("outcome") == "miss").cast("long")).alias("misses"))
    x = d.crossJoin(F.broadcast(g)).crossJoin(F.broadcast(u))
    share = lambda a, b: F.when(b > 0, F.least(a / b, F.lit(1.0))).otherwise(0.0)
    score = (
        40 * (1 - share(F.col("covered"), F.col("n"))) + 15 * (1 - share(F.col("vec"), F.col("n"))) + 15 * (1 - share(F.col("titles"), F.col("n")))
        + 15 * (1 - share(F.col("linked"), F.col("n"))) + 15 * (1 - share(F.col("hits"), F.col("hits") + F.col("misses")))
    )
    s = F.round(score, 4)
    return x.select(s.alias("score"), F.when(s < 10, "A").when(s < 25, "B").when(s < 45, "C").when(s < 65, "D").otherwise("F").alias("grade"))


def duplicate_titles(docs: DataFrame) -> DataFrame:
    """A16."""
    return docs.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


def coverage(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files of each source that no document names."""
    named = docs.select(F.explode("files").alias("file")).distinct().withColumn("named", F.lit(1))
    j = files.join(named, "file", "left").groupBy("source_name").agg(F.count(F.lit(1)).alias("files"), F.count("named").alias("covered"))
    return j.withColumn("ratio", F.round(F.col("covered") / F.col("files"), 6))


def rollup_by_directory(files: DataFrame, *sums: str) -> DataFrame:
    """Each file counts for itself and every directory above it."""
    each = files.select(F.explode(F.array_append(ancestors(F.col("file")), F.col("file"))).alias("node"), *sums)
    return each.groupBy("node").agg(F.count(F.lit(1)).alias("files"), *(F.sum(s).alias(s) for s in sums))


def conflicts(docs: DataFrame, source_order: Column) -> DataFrame:
    """Documents that lose a title to another: superseded ones, then by branch > source order > code over human > newest.

    The winner of each lower-cased title is the first by that order; ties go to the earlier position in the list (n).
    """
    gone = docs.where("supersedes is not null").select(F.col("supersedes").alias("id"))
    left = docs.join(gone, "id", "left_anti")
    order = [F.desc(F.col("status") == "experimental"), source_order, (F.col("provenance") == "human").cast("int"), F.desc("updated_at"), F.col("n")]
    w = Window.partitionBy(F.lower("title")).orderBy(*order)
    return left.withColumns({"r": F.row_number().over(w), "winner": F.first("id").over(w)}).where("r > 1").select("id", "winner")


def cost(tokens: DataFrame, rates: DataFrame) -> DataFrame:
    """Tokens times the rate of their kind, per million."""
    return tokens.join(F.broadcast(rates) if rates.limit(1001).count() <= 1000 else rates, "kind").groupBy("kind").agg(F.round(F.sum(F.col("tokens") * F.col("rate") / 1e6), 6).alias("cost"))


def histogram_bars(hist: DataFrame, width: int = 10) -> DataFrame:
    """Bars of round(count / max * width)."""
    top = hist.agg(F.max("n").alias("top"))
    bar = F.bround(F.col("n") / F.col("top") * width).cast("int")
    return hist.crossJoin(F.broadcast(top)).select("score", F.repeat(F.lit("#"), bar).alias("bar"))
