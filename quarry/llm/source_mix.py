"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's token target is its share of all tokens, capped at ``cap`` times its own size, the excess
being shared again by weight (water filling). A target of ``e`` whole sizes plus a rest means ``e``
complete epochs, then a weighted sample without replacement of the rest: each document draws the
exponential key ``-ln(u) / quality``, keys are ordered within the source, and documents are taken while
the running size fits.

The order is never made in one task: rows are dealt by ranges of (source, key), sizes are summed per range, and a
window inside a range adds the running sum of the ranges before it. The only tables that meet in one task have one row
per source, or one per range of it.

Edge cases: null and empty texts have size 0 and are never taken; null is a source of its own, ordered
last; draws depend on seed, id and text alone. Rows equal in both draw equal keys and follow each other in the order,
so a mix may take some of them and not the others; which ones can't be told apart, so reruns agree. They may fall into
several ranges. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.sampling import row_keys, under_cover, uncovered
from quarry.session import cut

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
WORD = "[^\\x20\\x09-\\x0D]+"
PUNCTUATION = "#*$%&|<>{}[]"
LEAST_WEIGHT = 1e-3


def sized(docs: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """keys, source, size in words, quality weight and the uniform draw u in (0, 1).

    The weight is the column of that name (say a classifier's score), at least ``LEAST_WEIGHT``; without one, or where it is
    null or no number, it is (0.5, 1] by punctuation clutter.
    """
    given = F.lit(None).cast("double") if weight is None else F.col(f"`{weight}`").cast("double")
    text = F.coalesce("text", F.lit(""))
    clutter = F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))
    hexed = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.md5(text))))
    return docs.select(
        *keys,
        "source",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        clutter.cast("long").alias("clutter"),
        ((F.conv(F.substring(hexed, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))).alias("u"),
        F.when(given.isNotNull() & ~F.isnan(given), F.greatest(given, F.lit(LEAST_WEIGHT))).alias("given"),
    ).select(*keys, "source", "size", F.coalesce("given", quality()).alias("quality"), "u")


def quality() -> Column:
    """0.5 to 1: how little punctuation clutter there is for each word."""
    return F.lit(0.5) + F.lit(0.5) * (F.col("size") + 1) / (F.col("size") + 1 + F.col("clutter"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source_size and the water-filled target.

    With sources ordered by cap / weight, the capped ones are a prefix: source k is capped when the
    level that the remaining tokens give the remaining weight lies above its own ratio.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    pick = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (pick + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    from_here = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "total": F.sum("source_size").over(every),
            "used": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)),
            "left_weight": F.sum("weight").over(from_here),
        }
    )
    level = (F.col("total") - F.col("used")) / F.col("left_weight")
    per = per.withColumn("level", F.when(level * F.col("weight") <= cap * F.col("source_size"), level))
    per = per.withColumn("level", F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.when(F.col("level").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def source_mix(docs: DataFrame, keys: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """keys (doc_id), source, size, source_size, target, taken (words taken, repeats counted).

    The draws always come from doc_id; ``keys`` are the columns that name a row in the result, ``weight`` the one that
    holds the documents' quality weights, if any does.
    """
    keys = keys or ["doc_id"]
    rows = cut(sized(docs, keys, weight))  # a few numbers a document; the texts are read once
    # one small row per source, joined by a hash on the source; AQE splits a hot source
    goal = targets(rows).withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target", "epochs", "rest")
    drawn = -F.log(F.col("u")) / F.col("quality")
    keyed = rows.withColumn("_nth", F.monotonically_increasing_id()).join(goal, F.col("source").eqNullSafe(F.col("_s"))).withColumn("drawn", drawn).drop("_s")
    order = ["drawn", "size", *keys, "_nth"]
    dealt = cut(keyed.repartitionByRange("source", *order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("source", "_range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = dealt.withColumn("upto", F.sum("size").over(inside))
    running = running.join(sums, F.col("source").eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    # the document that crosses the budget is taken when that ends nearer to the target
    extra = F.when((F.col("ahead") + F.col("upto") - F.col("size") / 2) <= F.col("rest"), F.col("size")).otherwise(0)
    return running.select(
        *keys, "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken")
    )


def take(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """The documents of the mix: every column of ``docs`` and ``copies``, how often the document is taken.

    ``weight`` names the column of quality weights, if any.

    An input column of that name stays as it is, and the number is then called ``mix_copies``.
    """
    covered, names = under_cover(docs)
    by_name = dict(zip(docs.columns, names, strict=True))
    keyed = covered.withColumn("doc_id", F.col(by_name["doc_id"])).withColumn("source", F.col(by_name["source"]))
    keyed = keyed.select(*names, "doc_id", "source", *row_keys())
    told = ["source"] if weight is None else ["source", by_name[weight]]
    keyed = keyed.withColumns({k: F.xxhash64(k, *told) for k in ("k1", "k2")})
    given = [] if weight is None else [F.col(by_name[weight]).alias("_weight")]
    mix = source_mix(keyed.select("doc_id", "text", "source", "k1", "k2", *given), ["k1", "k2"], "_weight" if given else None)
    copies = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    groups = mix.select("k1", "k2", copies.alias("c")).groupBy("k1", "k2").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.where("high > 0"))
    out = "mix_copies" if "copies" in docs.columns else "copies"
    whole = keyed.join(groups.where("low = high").select("k1", "k2", "low"), ["k1", "k2"])
    done = uncovered(whole, docs, names, F.col("low").alias(out))
    # equal rows on both sides of a budget (one group a source at most): as many of them as the mix took get one copy more
    parted = groups.where("low < high").select("k1", "k2", "low", (F.col("all") - F.col("low") * F.col("n")).alias("more"))
    if parted.isEmpty():
        return done
    rows = cut(keyed.join(parted, ["k1", "k2"]).withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}))
    before = Window.partitionBy("k1", "k2").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("k1", "k2", "_part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select("k1", "k2", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("k1", "k2", "_part").orderBy("_nth"))
    rows = rows.withColumn("_place", place).join(counts, ["k1", "k2", "_part"])
    number = F.col("low") + (F.col("_place") + F.col("before") <= F.col("more")).cast("int")
    return done.unionByName(uncovered(rows.withColumn("_copies", number).where("_copies > 0"), docs, names, F.col("_copies").alias(out)))


def per_source(mix: DataFrame) -> DataFrame:
    """Report: taken against target by source."""
    return mix.groupBy("source").agg(
        F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    )
