"""Causal chunks of definition bodies (T17): whole statements around seeded lines, by islands of bracket depth.

A body is a table of lines with the bracket depth after each. The edge after a line is open where the line or the next one
carries a statement on, and a statement is what lies between two edges of one depth that is not passed below in between: going
out from the seed on either side, the edges that go lower than all before them are the candidates, and the deepest depth that
both sides share wins. Seeds look ``max_span`` lines to either side, found by bins of that size, so a long body costs its seeds
a bounded number of lines each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut

MAX_SPAN = 40
SHORT_BODY = 48
SIGNATURE_LINES = 12
#: String literals, line comments, and what carries a statement on.
STRINGS = r"'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\""
COMMENT = r"(//|#).*$"
DOWN = r"(,|=|=>|->|&&|\|\||\+|\\)\s*$"
UP = r"^\s*[.]"
OPENS_BODY = r"[{=:]\s*$"


def body_lines(bodies: DataFrame) -> DataFrame:
    """(body, ln, text, depth after the line, closed: whether a statement can end there, opens: whether a body begins)."""
    rows = bodies.select("body", F.posexplode(F.split("content", "\n")).alias("ln", "text"))
    code = F.regexp_replace(F.regexp_replace("text", STRINGS, ""), COMMENT, "")
    rows = rows.withColumn("_code", code)
    count = lambda marks: F.length("_code") - F.length(F.translate("_code", marks, ""))
    order = Window.partitionBy("body").orderBy("ln")
    rows = rows.withColumns({"_bal": count("([{") - count(")]}"), "_up": F.col("_code").rlike(UP), "_down": F.col("_code").rlike(DOWN), "opens": F.col("_code").rlike(OPENS_BODY)})
    depth = F.sum("_bal").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    closed = ~F.col("_down") & ~F.coalesce(F.lead("_up").over(order), F.lit(False))
    return rows.select("body", "ln", "text", depth.cast("int").alias("depth"), closed.alias("closed"), "opens")


def statements(lines: DataFrame, seeds: DataFrame, max_span: int = MAX_SPAN) -> DataFrame:
    """(body, ln, first, last) of the statement around each seed (body, ln); null where none of ``max_span`` lines closes."""
    before = lines.select("body", (F.col("ln") + 1).alias("ln"), F.col("depth").alias("_before"))
    at = seeds.distinct().join(lines.select("body", "ln", "depth"), ["body", "ln"]).join(before, ["body", "ln"], "left")
    at = cut(at.select("body", "ln", F.least("depth", F.coalesce("_before", F.lit(0))).alias("base")))
    bin_ = lambda c: F.floor(F.col(c) / max_span).cast("int")
    asked = at.withColumn("_bin", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: k + bin_("ln"))))
    edges = lines.where("closed").select("body", F.col("ln").alias("j"), F.col("depth").alias("b"), bin_("ln").alias("_bin"))
    near = asked.join(edges, ["body", "_bin"]).where((F.abs(F.col("j") - F.col("ln")) <= max_span) & (F.col("b") <= F.col("base")))
    # the edge before the first line is always there
    top = at.where(F.col("ln") <= max_span).select("body", "ln", "base", F.lit(-1).alias("j"), F.lit(0).alias("b"))
    side = [(near.where("j < ln").select("body", "ln", "base", "j", "b").unionByName(top), F.col("j").desc()), (near.where("j >= ln"), F.col("j"))]
    lows = []
    for rows, order in side:
        way = Window.partitionBy("body", "ln").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        lows.append(rows.withColumn("_low", F.min("b").over(way)).where(F.col("_low").isNull() | (F.col("b") < F.col("_low")) | (F.col("j") == -1)).select("body", "ln", "j", "b"))
    left = lows[0].select("body", "ln", F.col("j").alias("_l"), F.col("b").alias("_lb"))
    right = lows[1].select("body", "ln", F.col("j").alias("_r"), F.col("b").alias("_rb"))
    # from the top of the body on, whatever closes has closed
    met = left.join(right, ["body", "ln"]).where((F.col("_lb") == F.col("_rb")) | ((F.col("_l") == -1) & (F.col("_rb") <= 0)))
    best = met.groupBy("body", "ln").agg(F.max(F.struct(F.col("_l"), (-F.col("_r")).alias("_r"))).alias("s"))
    best = best.select("body", "ln", (F.col("s._l") + 1).alias("first"), (-F.col("s._r")).alias("last")).where(F.col("last") - F.col("first") < max_span)
    return at.select("body", "ln").join(best, ["body", "ln"], "left")


def causal_chunks(bodies: DataFrame, seeds: DataFrame, max_span: int = MAX_SPAN, short_body: int = SHORT_BODY) -> DataFrame:
    """Chunks of bodies (body, line_start, content) around seeds (body, line), with why each is there.

    A seeded body gives its signature (to the line that opens it, within its first lines) and the whole statements of its
    seeds; where one cannot be isolated, the body stays whole. A body without seeds stays whole when it has at most
    ``short_body`` lines, else it gives its first line. Returns body, line_start, line_end, reason, text.
    """
    lines = cut(body_lines(bodies))
    first = bodies.select("body", "line_start")
    size = lines.groupBy("body").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("opens") & (F.col("ln") < SIGNATURE_LINES), F.col("ln"))).alias("sign"))
    inner = seeds.join(first, "body").join(size.select("body", "n"), "body").select("body", (F.col("line") - F.col("line_start")).cast("int").alias("ln")).join(lines.select("body", "ln"), ["body", "ln"], "left_semi")
    found = cut(statements(lines, inner, max_span))
    state = found.groupBy("body").agg(F.max(F.col("first").isNull()).alias("loose"))
    size = cut(size.join(state, "body", "left"))
    whole = F.when(F.col("loose"), F.lit("unisolatable")).when(F.col("loose").isNull() & (F.col("n") <= short_body), F.lit("short_body"))
    kept = lines.select("body", "ln").join(size.withColumn("reason", whole).where("reason is not null").select("body", "reason"), "body")
    head = F.when(F.col("loose").isNull(), F.lit(0)).otherwise(F.coalesce("sign", F.lit(0)))
    signs = size.where((F.col("loose").isNull() & (F.col("n") > short_body)) | ~F.col("loose")).select("body", F.explode(F.sequence(F.lit(0), head)).alias("ln"), F.lit("signature").alias("reason"))
    said = found.join(size.where("not loose").select("body"), "body", "left_semi").select("body", F.explode(F.sequence("first", "last")).alias("ln"), F.lit("call_site").alias("reason"))
    kept = kept.unionByName(signs).unionByName(said).groupBy("body", "ln").agg(F.collect_set("reason").alias("why"))
    run = (F.col("ln") - F.row_number().over(Window.partitionBy("body").orderBy("ln"))).alias("run")
    islands = kept.join(lines.select("body", "ln", "text"), ["body", "ln"]).select("body", "ln", "why", "text", run)
    chunk = islands.groupBy("body", "run").agg(
        F.min("ln").alias("a"), F.max("ln").alias("b"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("why")))), ",").alias("reason"), F.sort_array(F.collect_list(F.struct("ln", "text"))).alias("t")
    )
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return chunk.join(first, "body").select("body", (F.col("line_start") + F.col("a")).alias("line_start"), (F.col("line_start") + F.col("b")).alias("line_end"), "reason", text.alias("text"))
