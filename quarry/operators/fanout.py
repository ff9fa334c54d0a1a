"""Bounded fan-outs around selected names (G31): callers, calls and type references.

A request is a selection of names of one source, and all requests run at once: rows carry the request ``q``, and every
rank, gate and budget is a window or an aggregate by it. Names stand for every symbol of that name in the source; symbols
of other sources, bindings local to a body and paths outside production are never endpoints or call sites. Budgets that
levels share go from level to level as a running total a request.

A request is a user's selection (some dozens of names): what one has found on a level is folded in one row. The edges of a
hub are not: they are ranked by windows below which Spark keeps only the first rows of each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import camel_tokens
from quarry.operators.filters import is_production
from quarry.operators.paths import addressable
from quarry.session import cut, stored

REQUEST = ["q", "source_name"]
CALLS = ["call", "implements"]
#: Words of a question that name nothing.
STOPWORDS = ["a", "an", "and", "as", "at", "by", "does", "for", "from", "how", "in", "into", "is", "it", "of", "on", "or", "that", "the", "to", "what", "when", "where", "which", "why", "with"]


def _located(symbols: DataFrame, prefix: str) -> DataFrame:
    """Symbols that may be cited, with the columns' names prefixed."""
    some = addressable(symbols).where(is_production(F.col("file")))
    return some.select(F.col("source_name").alias(f"{prefix}_source"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("id", "qname", "file", "line_start", "line_end", "parent")))


def _links(symbols: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges between symbols of one source that may be cited, with the places of both ends.

    They do not depend on the requests: the tables are joined once, and levels and rounds look up names in what comes of it.
    """
    e = edges.where(F.col("edge_type").isin(kinds)).where(is_production(F.col("file")))
    e = e.select("caller", "callee", "edge_type", F.col("file").alias("call_file"), F.col("line").alias("call_line"))
    both = e.join(_located(symbols, "c"), F.col("caller") == F.col("c_id")).join(_located(symbols, "t"), (F.col("callee") == F.col("t_id")) & (F.col("c_source") == F.col("t_source")))
    return both.drop("caller", "callee", "t_source").withColumnRenamed("c_source", "source_name")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _owner_of(qname: Column) -> Column:
    return F.regexp_replace(qname, "[.][^.]*$", "")


def tokens(name: Column) -> Column:
    return F.array_distinct(camel_tokens(name))


def question_tokens(questions: DataFrame) -> DataFrame:
    """(q, asked): the distinct tokens of a question without stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return questions.select("q", F.array_except(tokens(F.col("question")), stop).alias("asked"))


def _claimed(most: int) -> Column:
    """Targets to expand next, of ``rows`` in order: each once, and ``most`` by the parent that names it first."""
    taken = "array_size(filter(acc, a -> a.parent = x.parent))"
    return F.expr(
        "aggregate(rows, cast(array() as array<struct<parent:string,target:string>>), (acc, x) -> "
        f"if(exists(acc, a -> a.target = x.target) or {taken} >= {most}, acc, concat(acc, array(struct(x.parent as parent, x.target as target)))))"
    )


def call_fanout(requests: DataFrame, symbols: DataFrame, edges: DataFrame, per_root: int = 4, depth: int = 1, recursive_per_root: int = 8, recursive_total: int = 48, links: DataFrame | None = None) -> DataFrame:
    """Calls out of the names of each request (q, source_name, name), level by level.

    On a level, rows go by (parent, calls before implementations, call site, target), one a (parent, target, kind), and
    ``per_root`` a parent. Deeper levels share ``recursive_total`` rows a request; a target in the folder of its call site
    is expanded next, once a request, ``recursive_per_root`` a parent. ``links`` are the edges as ``_links`` has them, if they are known.
    Returns q, source_name, parent, target, edge_type, hop, call_file, call_line, file, line_start, line_end.
    """
    order = ["parent", "kind", "call_file", "call_line", "target"]
    links = _links(symbols, edges, CALLS) if links is None else links
    site = F.min(F.struct("call_file", "call_line", "t_file", "t_line_start", "t_line_end")).alias("s")
    best = links.groupBy("source_name", F.col("c_qname").alias("parent"), F.col("t_qname").alias("target"), "edge_type").agg(site)
    best = best.select("source_name", "parent", "target", "edge_type", "s.*", F.when(F.col("edge_type") == "call", 0).otherwise(1).alias("kind"))
    # the first of a parent are the same for whoever asks
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("source_name", "parent").orderBy(*order[1:])))
    best = stored(best.where(F.col("_r") <= per_root).drop("_r"))
    front = cut(requests.where("name <> ''").select(*REQUEST, "name").distinct())
    expanded, used, out = front, None, None
    for level in range(depth):
        rows = front.withColumnRenamed("name", "parent").join(best, ["source_name", "parent"])
        if level:
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*REQUEST).orderBy(*order))).where(F.col("_r") <= recursive_total)
            rows = rows.join(used, REQUEST, "left").where(F.col("_r") + F.coalesce("used", F.lit(0)) <= recursive_total).drop("_r", "used")
        got = cut(rows.withColumn("hop", F.lit(level + 1)))
        out = got if out is None else out.unionByName(got)
        if level + 1 == depth or got.isEmpty():
            break
        if level:
            now = got.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("_n"))
            used = cut(now.join(used, REQUEST, "full").select(*REQUEST, (F.coalesce("_n", F.lit(0)) + F.coalesce("used", F.lit(0))).alias("used")))
        else:
            used = got.select(*REQUEST).distinct().withColumn("used", F.lit(0).cast("long"))
        near = got.where(_folder(F.col("call_file")) == _folder(F.col("t_file"))).join(expanded.withColumnRenamed("name", "target"), [*REQUEST, "target"], "left_anti")
        folded = near.groupBy(*REQUEST).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("rows"))
        front = cut(folded.select(*REQUEST, F.explode(_claimed(recursive_per_root)).alias("x")).select(*REQUEST, F.col("x.target").alias("name")))
        expanded = expanded.unionByName(front)
    return out.select(*REQUEST, "parent", "target", "edge_type", "hop", "call_file", "call_line", F.col("t_file").alias("file"), F.col("t_line_start").alias("line_start"), F.col("t_line_end").alias("line_end"))


def caller_fanout(requests: DataFrame, symbols: DataFrame, edges: DataFrame, callers_per_root: int = 1, child_per_caller: int = 16, fan_in_max: int = 8) -> DataFrame:
    """The nearest caller of each selected symbol (q, source_name, name), then the calls out of those callers.

    A symbol with more than ``fan_in_max`` callers has none cited. Callers rank by the same owner, the same file, the
    distance of the call site from the symbol's first line, the site and the id.
    Rows like ``call_fanout``'s; those of hop 0 have the caller as parent, and as place the caller's.
    """
    chosen = requests.where("name <> ''").select(*REQUEST, "name").distinct()
    links = stored(_links(symbols, edges, CALLS))
    one = stored(chosen.withColumnRenamed("name", "t_qname").join(links, ["source_name", "t_qname"]))
    wide = one.groupBy(*REQUEST, "t_id").agg(F.countDistinct("c_id").alias("n")).where(F.col("n") > fan_in_max).select(*REQUEST, "t_id")
    owner = F.coalesce(F.when(F.col("t_parent") != "", F.col("t_parent")), _owner_of(F.col("t_qname")))
    rank = [
        (F.coalesce("c_parent", F.lit("None")) != owner).cast("int"),
        (F.col("c_file") != F.col("t_file")).cast("int"),
        F.abs(F.col("call_line") - F.col("t_line_start")),
        F.col("call_file"),
        F.col("call_line"),
        F.col("c_id"),
        F.col("edge_type"),
    ]
    best = one.join(wide, [*REQUEST, "t_id"], "left_anti").withColumn("_r", F.row_number().over(Window.partitionBy(*REQUEST, "t_id").orderBy(*rank)))
    best = best.where(F.col("_r") <= callers_per_root)
    # symbols of one name share a caller at one site: the first of them is cited
    same = Window.partitionBy(*REQUEST, "c_qname", "t_qname", "call_file", "call_line").orderBy("t_file", "t_line_start", "t_id", "_r")
    best = cut(best.withColumn("_s", F.row_number().over(same)).where("_s = 1"))
    up = best.select(
        *REQUEST, F.col("c_qname").alias("parent"), F.col("t_qname").alias("target"), "edge_type", F.lit(0).alias("hop"),
        "call_file", "call_line", F.col("c_file").alias("file"), F.col("c_line_start").alias("line_start"), F.col("c_line_end").alias("line_end"),
    )
    roots = best.select(*REQUEST, F.col("c_qname").alias("name"))
    return up.unionByName(call_fanout(roots, symbols, edges, child_per_caller, 2, 4, 24, links))


def reverse_references(
    requests: DataFrame, questions: DataFrame, symbols: DataFrame, edges: DataFrame, per_root: int = 2, owner_per_root: int = 1, fan_in_max: int = 16, max_total: int = 32, reserve: bool = False
) -> DataFrame:
    """Who refers to the selected names, then who refers to the owners found, under one budget a request.

    A caller shares a token with the question (q, question) and is neither selected nor a member of a selected owner,
    unless it is a member beside the target. Targets with more than ``fan_in_max`` callers are left out; the others come
    by shared tokens and name, and give their first callers by (member beside the target, same top folder, shared
    tokens, site in the caller's own file, name, place). With ``reserve``, min(3, half) of the budget is kept from round
    one; what it leaves over is round two's as well.
    Returns q, source_name, round, target, caller, file, line_start, line_end, call_file, call_line.
    """
    asked = question_tokens(questions).where(F.size("asked") > 0)
    refs = stored(_links(symbols, edges, ["type_ref"]).drop("edge_type"))
    target = _located(symbols, "t")

    def located(names: DataFrame) -> DataFrame:
        return names.join(target, (F.col("name") == F.col("t_qname")) & (F.col("source_name") == F.col("t_source")))

    def incoming(names: DataFrame, limit: int, not_names: DataFrame, not_owners: DataFrame, left: DataFrame) -> DataFrame:
        """Chosen rows; ``left`` (q, source_name, room) is what each request may still take."""
        rows = names.withColumnRenamed("name", "t_qname").join(refs, ["source_name", "t_qname"])
        rows = rows.join(asked, "q")
        beside = (F.coalesce("t_parent", F.lit("")) != "") & F.col("t_qname").startswith(F.concat("t_parent", F.lit("."))) & (F.coalesce("c_parent", F.lit("")) == F.col("t_parent"))
        top = lambda c: F.split(c, "/", 2)[0]
        rows = rows.withColumns(
            {
                "beside": F.coalesce(beside, F.lit(False)),
                "same_top": top(F.col("call_file")) == top(F.col("t_file")),
                "shared": F.size(F.array_intersect(tokens(F.col("c_qname")), F.col("asked"))),
                "own_file": F.col("call_file") == F.col("c_file"),
                "t_shared": F.size(F.array_intersect(tokens(F.col("t_qname")), F.col("asked"))),
                "c_owner": F.coalesce("c_parent", F.lit("")),
            }
        ).where((F.col("shared") > 0) & (F.col("c_qname") != F.col("t_qname")) & (F.col("c_owner") != F.col("t_qname")))
        rows = rows.join(not_names.select(*REQUEST, F.col("name").alias("c_qname")), [*REQUEST, "c_qname"], "left_anti")
        owners = not_owners.select(*REQUEST, F.col("name").alias("c_owner"), F.lit(True).alias("_barred"))
        rows = rows.join(owners, [*REQUEST, "c_owner"], "left").where(F.col("_barred").isNull() | F.col("beside"))
        rank = F.struct(
            (~F.col("beside")).alias("col1"), (~F.col("same_top")).alias("col2"), (-F.col("shared")).alias("col3"), (~F.col("own_file")).alias("col4"),
            F.col("c_file").alias("file"), F.col("c_line_start").alias("line_start"), F.col("c_line_end").alias("line_end"), "c_owner", "call_file", "call_line",
        )
        # one row a caller of a target, the first by rank
        one = rows.groupBy(*REQUEST, F.col("t_qname").alias("target"), F.col("c_qname").alias("caller"), "t_shared").agg(F.min(rank).alias("s"))
        one = stored(one)
        group = Window.partitionBy(*REQUEST, "target")
        order = [F.col("s.col1"), F.col("s.col2"), F.col("s.col3"), F.col("s.col4"), F.col("caller"), F.col("s.file"), F.col("s.line_start")]
        wide = one.groupBy(*REQUEST, "target").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fan_in_max).select(*REQUEST, "target")
        few = one.join(wide, [*REQUEST, "target"], "left_anti").withColumn("_r", F.row_number().over(group.orderBy(*order))).where(F.col("_r") <= max(limit, 1))
        place = F.row_number().over(Window.partitionBy(*REQUEST).orderBy(F.col("t_shared").desc(), "target", "_r"))
        few = few.withColumn("_p", place).where(F.col("_p") <= max_total).join(left, REQUEST).where(F.col("_p") <= F.col("room"))
        return few.select(*REQUEST, "target", "caller", F.col("s.c_owner").alias("owner"), "s.file", "s.line_start", "s.line_end", "s.call_file", "s.call_line")

    names = cut(requests.where("name <> ''").select(*REQUEST, "name").distinct())
    picked = cut(located(names).select(*REQUEST, F.col("t_qname").alias("name"), F.col("t_parent").alias("owner")).distinct())
    selected = picked.select(*REQUEST, "name").distinct()
    owned = picked.where("owner <> ''").select(*REQUEST, F.col("owner").alias("name")).distinct()
    every = names.select(*REQUEST).distinct()
    kept = min(3, max_total // 2) if reserve else 0
    first = cut(incoming(names, per_root, selected, owned, every.withColumn("room", F.lit(max_total - kept))))
    taken = first.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("n"))
    left = every.join(taken, REQUEST, "left").select(*REQUEST, (F.lit(max_total) - F.coalesce("n", F.lit(0))).alias("room"))
    found = first.where("owner <> ''").select(*REQUEST, F.col("owner").alias("name")).distinct()
    callers = first.select(*REQUEST, F.col("caller").alias("name"))
    second = incoming(found, owner_per_root, selected.unionByName(callers).distinct(), owned.unionByName(found).distinct(), left)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    # what both rounds cite from one site stays with the first
    once = Window.partitionBy(*REQUEST, "target", "caller", "call_file", "call_line").orderBy("round")
    return both.withColumn("_o", F.row_number().over(once)).where("_o = 1").drop("_o", "owner")
