"""Range, as-of, template and unique-match joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BIN = 64


def enclosing(points: DataFrame, ranges: DataFrame, key: str, order: list[Column], bin_size: int = RANGE_BIN) -> DataFrame:
    """Ranges that hold a point, the first by ``order``.

    Points fall into one bin of lines and ranges into each bin they touch, so the join is an equi-join on
    (key, bin) and one large file spreads over its bins.
    """
    p = points.withColumn("_bin", F.floor(F.col("line") / bin_size)).withColumn("_p", F.struct(key, "line"))
    r = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("line_start") / bin_size), F.floor(F.col("line_end") / bin_size))))
    j = p.join(r, [key, "_bin"]).where("line between line_start and line_end")
    w = Window.partitionBy(key, "line").orderBy(*order)
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_bin", "_p")


def innermost(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """Narrowest enclosing symbol of each (file, line)."""
    return enclosing(points, symbols, "file", [F.col("line_end") - F.col("line_start"), F.desc("line_start"), F.col("id")]).select("file", "line", "id")


def latest_start(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """The enclosing symbol that starts last."""
    return enclosing(points, symbols, "file", [F.desc("line_start"), F.col("line_end"), F.col("id")]).select("file", "line", "id")


def asof_window(turns: DataFrame, events: DataFrame, seconds: int, bin_seconds: int = 3600) -> DataFrame:
    """The last event of the same key in [t, min(next turn, t + window)); turns without one keep a null.

    Both sides are keyed by (key, time bin); a window touches a fixed number of bins.
    """
    w = Window.partitionBy("key").orderBy("t")
    t = turns.withColumn("until", F.least(F.coalesce(F.lead("t").over(w), F.col("t") + F.make_dt_interval(secs=F.lit(seconds))), F.col("t") + F.make_dt_interval(secs=F.lit(seconds))))
    # both ends of the window are within it, so unix seconds of the bounds cover every bin
    unix = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    t = t.withColumn("_b", F.explode(F.sequence(F.floor(unix("t") / bin_seconds), F.floor(unix("until") / bin_seconds))))
    e = events.select(F.col("key"), F.col("t").alias("et"), "value").withColumn("_b", F.floor(F.unix_seconds(F.col("et").cast("timestamp")) / bin_seconds))
    hit = t.join(e, ["key", "_b"]).where("et >= t and et < until").groupBy("turn").agg(F.max(F.struct("et", "value")).alias("m"))
    return turns.join(hit, "turn", "left").select("turn", "m.et", "m.value")


def url_path(url: Column) -> Column:
    """Path of a URL without host, query, fragment and trailing slash."""
    p = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]+", ""), "[?#].*$", "")
    return F.regexp_replace(p, "(?<=.)/$", "")


def match_templates(urls: DataFrame, templates: DataFrame) -> DataFrame:
    """URL paths against templates with ``{wildcards}``; several matches take the smallest id and are ``ambiguous``."""
    u = urls.withColumn("parts", F.split(url_path(F.col("url")), "/")).withColumn("n", F.size("parts"))
    t = templates.withColumn("tparts", F.split("template", "/")).withColumn("n", F.size("tparts")).withColumnRenamed("id", "endpoint")
    same = F.forall(F.zip_with("parts", "tparts", lambda a, b: (a == b) | b.rlike(r"^\{.*\}$")), lambda x: x)
    ok = same & (F.col("method").isNull() | F.col("tmethod").isNull() | (F.col("method") == F.col("tmethod")))
    hit = u.join(t.withColumnRenamed("method", "tmethod"), "n").where(ok).groupBy("id").agg(F.min("endpoint").alias("endpoint"), F.count(F.lit(1)).alias("matches"))
    return urls.select("id").join(hit, "id", "left").select("id", "endpoint", F.when(F.col("matches") > 1, "ambiguous").when(F.col("matches") == 1, "exact").alias("confidence"))


def unique_match(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Zero or several matches give null."""
    one = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(one, key, "left")


def resolve_cascade(calls: DataFrame, literals: DataFrame, symbols: DataFrame, config: DataFrame) -> DataFrame:
    """Literal, else symbol, else config value, with the confidence of the step that answered."""
    j = calls.join(literals.select("arg", F.col("value").alias("lit")), "arg", "left").join(symbols.select("arg", F.col("value").alias("sym")), "arg", "left").join(config.select("arg", F.col("value").alias("cfg")), "arg", "left")
    how = F.when(F.col("lit").isNotNull(), "exact").when(F.col("sym").isNotNull(), "resolved").when(F.col("cfg").isNotNull(), "derived")
    return j.select("call", F.coalesce("lit", "sym", "cfg").alias("value"), how.alias("confidence"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """J08."""
    return children.join(parents.select(key), key, "left_anti")


def member_join(lists: DataFrame, column: str, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``right`` named in an array column."""
    return lists.select(*[c for c in lists.columns if c != column], F.explode(column).alias(key)).join(right, key)


def containing_files(edges: DataFrame, names: DataFrame, gram: int = 3) -> DataFrame:
    """Edges whose target holds a name.

    An equi-join on short strings and a check behind it: a target that holds a name holds the name's first ``gram``
    characters (all of it, where it is shorter). Null names match nothing, an empty name matches every target.
    """
    n = names.select("name").where("name is not null").withColumn("g", F.substring("name", 1, gram))
    t = edges.select("source_id", "target_id").where("target_id is not null")
    sizes = F.sequence(F.lit(0), F.lit(gram))
    grams = F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("target_id") - k + 1, F.lit(1))), lambda i: F.substring("target_id", i, k)))))
    hit = t.withColumn("g", F.explode(grams)).join(n, "g").where(F.contains("target_id", F.col("name")))
    return hit.select("source_id", "target_id", "name")


def component_fallback(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """The version of the component, else that of its default component."""
    v = versions.select("source_name", "component", "version")
    d = versions.where("component is null").select("source_name", F.col("version").alias("default_version"))
    j = requests.join(v.where("component is not null"), ["source_name", "component"], "left").join(d, "source_name", "left")
    return j.select("source_name", "component", F.coalesce("version", "default_version").alias("version"))
