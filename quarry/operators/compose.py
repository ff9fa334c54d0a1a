"""Smaller composite operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import glob_column
from quarry.operators.filters import in_paths
from quarry.operators.vector import provenance_weight, top_k, with_scores


def search_in_scope(vecs: DataFrame, docs: DataFrame, q: list[float], paths: list[str], k: int, environment: list[str] = ()) -> DataFrame:
    """Path scope first, provenance weight only."""
    d = in_paths(docs, paths).select("id", "provenance", "stale", "source_name")
    j = with_scores(vecs.select("id", "v"), q, True).join(d, "id")
    w = provenance_weight(F.col("provenance"), F.col("stale"), F.col("source_name"), list(environment))
    return top_k(j.select("id", F.round(F.col("score") * w, 6).alias("score")), k)


def branch_status(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """Documents of changed files, and how many of their files changed."""
    return docs.select("id", F.explode("files").alias("file")).join(changed.select("file").distinct(), "file").groupBy("id").agg(F.countDistinct("file").alias("changed_files"))


def sync_status(sources: DataFrame, heads: DataFrame) -> DataFrame:
    """Synced, behind or never synced."""
    j = sources.join(heads.select("source_name", F.col("hash").alias("_h")), "source_name", "left")
    state = F.when(F.col("hash").isNull(), "never").when(F.col("hash").eqNullSafe(F.col("_h")), "synced").otherwise("behind")
    return j.select("source_name", state.alias("state"))


def consumed_branch_docs(docs: DataFrame, merged: DataFrame) -> DataFrame:
    """Experimental documents with a branch pattern that a merged branch meets."""
    p = docs.where("status = 'experimental'").select("id", F.explode("branches").alias("pattern"))
    patterns = p.select("pattern").distinct().join(merged, F.rlike(F.col("branch"), glob_column(F.col("pattern"))), "left_semi")
    return p.join(patterns, "pattern", "left_semi").select("id").distinct()


def reconcile(desired: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """Add, remove, update; equal digests are left alone and give no row."""
    j = desired.select(key, F.col(digest).alias("_d")).join(current.select(key, F.col(digest).alias("_c")), key, "full")
    action = F.when(F.col("_c").isNull(), "add").when(F.col("_d").isNull(), "remove").when(F.col("_c") != F.col("_d"), "update")
    return j.select(key, action.alias("action")).where("action is not null")


def exclusion_savings(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files and size below each excluded directory. A file counts for every rule above it, so nested rules overlap."""
    from quarry.functions.text import ancestors

    each = files.select("size", F.explode(F.array_append(ancestors(F.col("file")), F.col("file"))).alias("node"))
    return each.join(rules.select("node"), "node").groupBy("node").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("size"))


def language_histogram(files: DataFrame, languages: dict[str, str]) -> DataFrame:
    """Files by language of their suffix."""
    ext = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    name = F.coalesce(*(F.when(ext == k, v) for k, v in sorted(languages.items())), F.lit("other"))
    return files.groupBy(name.alias("language")).agg(F.count(F.lit(1)).alias("n"))


def cached_answer(answers: DataFrame, role: str, question: str, fingerprint: str) -> DataFrame:
    """The newest answer for a role, question and environment."""
    a = answers.where((F.col("audience") == role) & (F.lower(F.trim("question")) == question.strip().lower()) & (F.col("fingerprint") == fingerprint))
    return a.orderBy(F.desc("updated_at"), "id").limit(1).select("id")


def resolve_links(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Link targets by exact name, else by the only symbol with that last part."""
    s = symbols.select("qname", F.element_at(F.split("qname", "[.]"), -1).alias("last"))
    exact = links.join(s.select(F.col("qname").alias("target")).distinct().withColumn("_e", F.col("target")), "target", "left")
    only = s.groupBy("last").agg(F.count(F.lit(1)).alias("_n"), F.min("qname").alias("_q")).where("_n = 1")
    j = exact.join(only, F.col("target") == F.col("last"), "left")
    return j.select("doc", "target", F.coalesce("_e", "_q").alias("resolved"))


def capability_profile(facts: DataFrame, requires: DataFrame) -> DataFrame:
    """Evidence for each concern, and the required concerns that have none."""
    have = facts.groupBy("source_name", "concern").agg(F.count(F.lit(1)).alias("evidence"))
    need = have.select("source_name", "concern").join(requires, "concern").select("source_name", F.col("needs").alias("concern")).distinct()
    missing = need.join(have, ["source_name", "concern"], "left_anti").withColumn("evidence", F.lit(0).cast("long"))
    return have.unionByName(missing)


def changed_signatures(now: DataFrame, cached: DataFrame) -> DataFrame:
    """Sources whose signature moved since it was cached."""
    c = cached.select("source_name", F.col("signature").alias("_s"))
    return now.join(c, "source_name", "left").where(~F.col("signature").eqNullSafe(F.col("_s"))).select("source_name")


def components_of(docs: DataFrame) -> DataFrame:
    """``Name -> Other`` interactions of documentation, with how often each is named."""
    rx = r"\b([A-Z][A-Za-z]+) -> ([A-Z][A-Za-z]+)\b"
    m = docs.select(F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(0))).alias("m"))
    return m.groupBy(F.regexp_extract("m", rx, 1).alias("source"), F.regexp_extract("m", rx, 2).alias("target")).agg(F.count(F.lit(1)).alias("n"))


def layers(interactions: DataFrame) -> DataFrame:
    """Entry (never called), exit (never calls) or middle."""
    a = interactions.select(F.col("source").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(interactions.select(F.col("target").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    g = a.groupBy("name").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return g.select("name", F.when(F.col("i") == 0, "entry").when(F.col("o") == 0, "exit").otherwise("middle").alias("layer"))


def page_of(rows: DataFrame, group: str, text: Column, per_group: int) -> DataFrame:
    """A rendered block for each group, the first rows of it."""
    r = rows.withColumn("_t", text).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_t"))).where(F.col("_r") <= per_group)
    return r.groupBy(group).agg(F.concat(F.lit("## "), F.col(group), F.lit("\n"), F.array_join(F.array_sort(F.collect_list("_t")), "\n")).alias("block"))


def next_revision(manifest: DataFrame, name: str, identity: str) -> DataFrame:
    """The counter of a bound library goes up by one; another identity is refused."""
    row = manifest.where(F.col("name") == name).first()
    if row is not None and row["identity"] != identity:
        raise ValueError(f"{name} is bound to another model")
    fresh = manifest.sparkSession.createDataFrame([(name, identity, (row["revision"] if row else 0) + 1)], "name string, identity string, revision long")
    return manifest.where(F.col("name") != name).unionByName(fresh)


def scoped_copy(table: DataFrame, source: str, renamed: str, prefix: str, columns: list[str]) -> DataFrame:
    """The rows of one source under a new name, a path prefix taken off."""
    out = table.where(F.col("source_name") == source).withColumn("source_name", F.lit(renamed))
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c).startswith(prefix), F.substring(c, len(prefix) + 1, 1 << 20)).otherwise(F.col(c)))
    return out
