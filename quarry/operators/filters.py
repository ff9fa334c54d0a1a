"""Filters, scoping and set logic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import confidence_rank, glob_column
from quarry.operators.graph import frontier_loop
from quarry.operators.ranking import positions
from quarry.session import cut


def for_branch(docs: DataFrame, branch: str) -> DataFrame:
    """stable passes (the default status); others need a branch pattern that matches."""
    hit = F.exists("branches", lambda p: F.rlike(F.lit(branch), glob_column(p)))
    return docs.where((F.coalesce("status", F.lit("stable")) == "stable") | F.coalesce(hit, F.lit(False)))


def for_feature(docs: DataFrame, feature: str) -> DataFrame:
    """case-insensitive part of the feature or an alias."""
    f = feature.lower()
    return docs.where(F.coalesce(F.contains(F.lower("feature"), F.lit(f)), F.lit(False)) | F.coalesce(F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(f))), F.lit(False)))


def for_role(docs: DataFrame, role: str, fingerprint: str) -> DataFrame:
    """Developers never see audience answers; other roles see those of their audience and environment."""
    answer = F.col("content_type") == "audience_response"
    if role == "developer":
        return docs.where(~answer)
    return docs.where(~answer | ((F.col("audience") == role) & (F.col("fingerprint") == fingerprint)))


def in_paths(docs: DataFrame, paths: list[str]) -> DataFrame:
    """no paths keeps all; a document without files passes; else a file starts with, holds or is held by a path."""
    if not paths:
        return docs
    hit = F.lit(False)
    for p in paths:
        hit = hit | _touches(p)
    return docs.where((F.coalesce(F.size("files"), F.lit(0)) <= 0) | hit)


def _touches(path: str) -> Column:
    return F.coalesce(F.exists("files", lambda f: F.contains(f, F.lit(path)) | F.contains(F.lit(path), f)), F.lit(False))


def closure(relations: DataFrame, source: str) -> DataFrame:
    """(source) the forward transitive dependencies of a source with itself; for a leaf the reverse ones.

    The relation table is searched level by level and never leaves the executors. A cycle among the sources on the way is
    an error: what is left after taking away, again and again, the dependencies that lead no further.
    """
    pairs = relations.where("source_name is not null and depends_on is not null").select("source_name", "depends_on").distinct()
    if pairs.where(F.col("source_name") == source).isEmpty():
        pairs = pairs.select(F.col("depends_on").alias("source_name"), F.col("source_name").alias("depends_on"))
    pairs = cut(pairs)
    start = relations.sparkSession.createDataFrame([(source,)], "source string")
    step = lambda f: f.join(pairs, f["source"] == pairs["source_name"]).select(F.col("depends_on").alias("source"))
    reached = frontier_loop(start, step, pairs.count(), ["source"]).select("source")
    left = cut(pairs.join(reached.withColumnRenamed("source", "source_name"), "source_name"))
    n = left.count()
    while n:
        going = left.select(F.col("source_name").alias("depends_on")).distinct()
        left = cut(left.join(going, "depends_on", "left_semi"))
        n, before = left.count(), n
        if n == before:
            raise ValueError(f"dependency cycle among {n} relations that {source} reaches")
    return reached


def admitted_themes(themes: DataFrame, members: DataFrame, docs: DataFrame, scope: list[str], environment: list[str] = (), floor: float = 0.10) -> DataFrame:
    """an association needs every source in scope; else the in-scope share decides (10 %, and not one member of many)."""
    m = members.join(docs.select(F.col("id").alias("element_id"), "source_name"), "element_id")
    ok = F.col("source_name").isin(list(scope)) & ~F.col("source_name").isin(list(environment) or [""])
    n = m.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("total"), F.sum(ok.cast("long")).alias("inside"))
    share = F.col("inside") / F.col("total")
    all_in = F.forall(F.split("association", r"\|"), lambda s: s.isin(list(scope)))
    j = themes.join(n, "cluster_id", "left")
    base = F.coalesce((share >= floor) & ~((F.col("inside") == 1) & (share < 0.5)), F.lit(False))
    return j.where(F.when(F.coalesce(F.col("association"), F.lit("")) != "", all_in).otherwise(base)).select("cluster_id")


def admit(ids: DataFrame, docs: DataFrame, themes: DataFrame, scope: list[str]) -> DataFrame:
    """ids whose source is in scope, or admitted themes without a source; order (pos) is kept, unknown ids go."""
    d = docs.select("id", "source_name")
    known = ids.join(d, "id")
    ok = known.where(F.col("source_name").isin(list(scope)))
    theme = known.where("source_name is null").join(themes.select(F.col("cluster_id").alias("id")), "id", "left_semi")
    return ok.unionByName(theme).select("pos", "id")


def edges_in_scope(edges: DataFrame, symbols: DataFrame, scope: list[str]) -> DataFrame:
    """both endpoints in scope."""
    s = symbols.where(F.col("source_name").isin(list(scope))).select("id")
    return edges.join(s, edges["caller"] == s["id"], "left_semi").join(s, F.col("callee") == s["id"], "left_semi")


def over_floor(df: DataFrame, floor: str) -> DataFrame:
    """F09."""
    return df.where(confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(floor)))


def is_distinctive(term: Column) -> Column:
    """a space, an underscore or mixed case."""
    return term.contains(" ") | term.contains("_") | term.rlike("[a-z].*[A-Z]|[A-Z].*[a-z].*[A-Z]")


def entity_class(term: Column) -> Column:
    return F.when(term.contains(" "), "phrase").when(term.contains("_") | term.rlike("[.()]|[a-z][A-Z]"), "api").otherwise("product")


def surfaces(text: Column, stems: dict[str, list[str]]) -> Column:
    """Names of the surfaces with a stem at the start of a word."""
    each = [F.when(text.rlike("(?i)(^|[^A-Za-z0-9])(" + "|".join(s) + ")"), name) for name, s in sorted(stems.items())]
    return F.array_compact(F.array(*each))


def tiers(docs: DataFrame, environment: list[str]) -> DataFrame:
    """second tier = official documents of environment sources."""
    return docs.select("id", (F.coalesce(F.col("provenance") == "official", F.lit(False)) & F.col("source_name").isin(list(environment))).alias("tier2"))


def expired(docs: DataFrame, as_of: str) -> DataFrame:
    """an unreadable date never expires."""
    return docs.where(F.expr("try_to_timestamp(expires_at)") < F.lit(as_of).cast("timestamp"))


def gotchas(docs: DataFrame, files: list[str]) -> DataFrame:
    """F14."""
    hit = F.arrays_overlap("files", F.array(*map(F.lit, files)))
    return docs.where(hit & (F.col("status") != "deprecated")).orderBy(F.desc("encounter_count"), "id")


def catalogue_noise(files: DataFrame, most: int = 50) -> DataFrame:
    """vendored, minified, or one basename in very many places."""
    n = files.groupBy("name").agg(F.count(F.lit(1)).alias("copies"))
    bad = F.col("file").rlike(r"(^|/)(node_modules|vendor|third_party|dist)/|[.]min[.](js|css)$") | (F.col("copies") > most)
    return files.join(n, "name").select("file", bad.alias("noise"))


def is_production(path: Column) -> Column:
    """F16."""
    return ~path.rlike("/(test|tests|benchmark|benchmarks|target|generated)/")


def page(df: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """One page with the total; an empty page has no rows and so no total."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def keep_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def rank_scores(df: DataFrame, order: list) -> DataFrame:
    """(n - i) / n by position in a total order; the whole table may be ranked."""
    n = df.agg(F.count(F.lit(1)).alias("_total"))
    ranked = positions(df, order, "_pos").crossJoin(F.broadcast(n))
    return ranked.withColumn("rank_score", F.round((F.col("_total") - (F.col("_pos") - 1)) / F.col("_total"), 6)).drop("_pos", "_total")
