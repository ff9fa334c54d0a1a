"""Keyed writes as plans (I01-I17), slices, packs and stores (S20-S21, W01-W04, X-family)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], policy: str = "replace") -> DataFrame:
    """Keyed upsert. ``replace``: new rows win; ``ignore``: old rows win; ``fail``: any clash is an error.

    Keys compare null-safely; of several new rows with one key the last in the order of all columns stays.
    """
    cols = old.columns
    new = new.select(*cols).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in cols if c not in keys) or [F.lit(1)]))).where("_r = 1").drop("_r")
    cond = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    if policy == "fail":
        if old.join(new, cond(old, new), "left_semi").limit(1).count():
            raise ValueError("key exists")
        return old.unionByName(new)
    if policy == "ignore":
        return old.unionByName(new.join(old.select(*keys), cond(new, old), "left_anti"))
    return old.join(new.select(*keys), cond(old, new), "left_anti").unionByName(new)


def update_documents(docs: DataFrame, changes: DataFrame) -> DataFrame:
    """A changed title or content drops the vector (and so makes it missing)."""
    c = changes.select("id", F.col("title").alias("_t"), F.col("content").alias("_c"))
    j = docs.join(c, "id", "left")
    moved = F.coalesce((F.col("_t") != F.col("title")) | (F.col("_c") != F.col("content")), F.lit(False))
    return j.select(*(F.coalesce("_t", "title").alias(k) if k == "title" else F.coalesce("_c", "content").alias(k) if k == "content" else (F.col(k) & ~moved).alias(k) if k == "has_vector" else F.col(k) for k in docs.columns))


def invalid_documents(docs: DataFrame, types: list[str]) -> DataFrame:
    """Rows that a write refuses, with the reason."""
    why = F.when(F.coalesce(F.trim("title"), F.lit("")) == "", "empty title").when(F.coalesce(F.trim("content"), F.lit("")) == "", "empty content").when(~F.col("content_type").isin(types), "unknown type")
    return docs.select("id", why.alias("reason")).where("reason is not null")


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the parents in ``new`` are replaced."""
    return children.join(new.select(key).distinct(), key, "left_anti").select(*children.columns).unionByName(new.select(*children.columns))


def checked_replace(docs: DataFrame, new: DataFrame) -> DataFrame:
    """Replace rows whose version still is the expected one; others stay and are reported as stale."""
    j = docs.join(new.select("id", F.col("version").alias("_v"), F.col("content").alias("_c")), "id", "left")
    ok = F.coalesce(F.col("_v") == F.col("version"), F.lit(False))
    state = F.when(F.col("_v").isNull(), "kept").when(ok, "replaced").otherwise("stale")
    return j.select("id", (F.col("version") + ok.cast("long")).alias("version"), F.when(ok, F.col("_c")).otherwise(F.col("content")).alias("content"), state.alias("state"))


def replace_source(facts: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """The rows of one source are replaced; written with dynamic partition overwrite this touches one partition."""
    return facts.where(~F.col("source_name").eqNullSafe(F.lit(source))).unionByName(new)


def write_source_partitions(facts: DataFrame, path: str) -> None:
    """I04 as a write: only the partitions present in ``facts`` are overwritten."""
    facts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_name").parquet(path)


def purge_counts(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """Rows of a source by table."""
    parts = [df.where(F.col("source_name") == source).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge(table: DataFrame, source: str) -> DataFrame:
    return table.where(~F.coalesce(F.col("source_name") == source, F.lit(False)))


def slice_source(symbols: DataFrame, edges: DataFrame, source: str, tasks: int | None = None) -> DataFrame:
    """Edges that touch a source, with bare local ids given its name.

    Edges go once to their callers and from there to their callees, into ``tasks`` tasks where that is given, and are distinct where they lie.
    """
    own = symbols.where(F.col("source_name") == source).select("id")
    named = lambda c: F.when(F.col(c).startswith("local "), F.concat(F.lit(f"{source}::"), c)).otherwise(F.col(c)).alias(c)
    deal = lambda df, c: df.repartition(tasks, c) if tasks else df
    own = deal(own, "id")
    at = deal(edges, "caller").join(own.select(F.col("id").alias("_a")), F.col("caller") == F.col("_a"), "left")
    at = deal(at, "callee").join(own.select(F.col("id").alias("_b")), F.col("callee") == F.col("_b"), "left")
    rows = at.where("_a is not null or _b is not null").select(*edges.columns).distinct()
    return rows.select(*(named(c) if c in ("caller", "callee") else F.col(c) for c in edges.columns))


def diff_status(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Added, removed, modified, unchanged; ``moved`` when a digest reappears under a new key."""
    j = old.select(key, F.col(digest).alias("_o")).join(new.select(key, F.col(digest).alias("_n")), key, "full")
    s = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged")
    return j.select(key, s.alias("status"))


def moved(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Digests that left one key and came under another."""
    gone = old.join(new.select(key), key, "left_anti").select(F.col(key).alias("old_key"), digest)
    come = new.join(old.select(key), key, "left_anti").select(F.col(key).alias("new_key"), digest)
    return gone.join(come, digest).groupBy(digest).agg(F.min("old_key").alias("old_key"), F.min("new_key").alias("new_key"))


def staleness(files: DataFrame, records: DataFrame, requested: list[str], supported: Column) -> DataFrame:
    """Per file whether its content changed and which requested, supported document types are missing."""
    r = records.select("file", F.col("hash").alias("_h"), F.col("types").alias("_t"), "exempt")
    j = files.join(r, "file", "left")
    have = F.coalesce("_t", F.expr("cast(array() as array<string>)"))
    missing = F.array_except(F.array_intersect(F.array(*map(F.lit, requested)), supported), have)
    changed = (F.col("_h").isNull() | (F.col("_h") != F.col("hash"))) & ~F.coalesce("exempt", F.lit(False))
    return j.select("file", changed.alias("is_stale"), F.array_join(F.array_sort(missing), ",").alias("missing"))


def with_feedback(usage: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback events overwrite, latest wins; score:N is clamped to 1..10."""
    last = feedback.groupBy("id").agg(F.max_by("text", "at").alias("text"))
    raw = F.regexp_extract("text", "score:(-?[0-9]+)", 1)
    score = F.when(raw != "", F.greatest(F.lit(1), F.least(F.lit(10), raw.cast("int"))))
    return usage.join(last, "id", "left").select("id", F.coalesce("text", "feedback").alias("feedback"), F.when(F.col("text").isNotNull(), score).otherwise(F.col("score")).alias("score"))


def live_cache(cache: DataFrame, as_of: str, ttl_days: int = 30) -> DataFrame:
    """I11."""
    return cache.where(F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(ttl_days)))


def remap_ids(table: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """New ids in every referencing column."""
    out = table
    for c in columns:
        m = mapping.select(F.col("old").alias(f"_o_{c}"), F.col("new").alias(f"_n_{c}"))
        out = out.join(m, F.col(c) == F.col(f"_o_{c}"), "left").withColumn(c, F.coalesce(f"_n_{c}", c)).drop(f"_o_{c}", f"_n_{c}")
    return out


def deprecate_stale(docs: DataFrame, as_of: str, days: int) -> DataFrame:
    """I13."""
    old = F.col("updated_at") <= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return docs.withColumn("status", F.when(old, "deprecated").otherwise(F.col("status")))


def upsert_routes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A route keeps its vector unless its steps or its question changed."""
    o = old.select("id", F.col("steps").alias("_s"), F.col("question").alias("_q"), F.col("vector").alias("_v"))
    j = new.join(o, "id", "left")
    same = F.col("_s").eqNullSafe(F.col("steps")) & F.col("_q").eqNullSafe(F.col("question"))
    kept = old.join(new.select("id"), "id", "left_anti").select("id", "steps", "question", "vector")
    return kept.unionByName(j.select("id", "steps", "question", F.when(same, F.coalesce("vector", "_v")).otherwise(F.col("vector")).alias("vector")))


def insert_ignore(facts: DataFrame, key: list[str], nullable: str) -> DataFrame:
    """I16: one row a null-safe key, the smallest id."""
    w = Window.partitionBy(*key, F.coalesce(nullable, F.lit(""))).orderBy("id")
    return facts.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def merge_schema(derived: DataFrame, declared: DataFrame) -> DataFrame:
    """In both: resolved; only declared: exact; only derived: a gap."""
    j = derived.select("table_name", "column_name", F.lit(1).alias("_a")).join(declared.select("table_name", "column_name", F.lit(1).alias("_b")), ["table_name", "column_name"], "full")
    s = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), "resolved").when(F.col("_b").isNotNull(), "exact").otherwise("gap")
    return j.select("table_name", "column_name", s.alias("status"))


def export_manifest(docs: DataFrame) -> DataFrame:
    """Files and characters of each type's directory."""
    return docs.groupBy("content_type").agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("content")).alias("chars"), F.min("id").alias("first_id"))


def export_markdown(docs: DataFrame, path: str) -> None:
    """One text file set a type."""
    front = F.concat(F.lit("---\nid: "), "id", F.lit("\ntitle: "), "title", F.lit("\n---\n"), "content")
    docs.select("content_type", front.alias("value")).write.mode("overwrite").partitionBy("content_type").text(path)


def parse_front_matter(texts: DataFrame) -> DataFrame:
    """Id, title and body of Markdown with front matter; others have a null id."""
    rx = r"(?s)^---\n(.*?)\n---\n(.*)$"
    head, body = F.regexp_extract("value", rx, 1), F.regexp_extract("value", rx, 2)
    has = F.col("value").rlike(rx)
    field = lambda k: F.when(has, F.regexp_extract(head, rf"(?m)^{k}: *(.*)$", 1))
    return texts.select(field("id").alias("id"), field("title").alias("title"), F.when(has, body).otherwise(F.col("value")).alias("content"))


def graph_export(graph: DataFrame, docs: DataFrame) -> DataFrame:
    """Nodes with type (that of the document, topic for documents marked so, else file) and the number of documents
    that name them."""
    nodes = graph.select(F.col("source_id").alias("id")).union(graph.select("target_id")).distinct()
    n = docs.select(F.explode("files").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("doc_count"))
    j = nodes.join(docs.select("id", F.when(F.col("topic"), "topic").otherwise(F.col("content_type")).alias("content_type")), "id", "left").join(n, "id", "left")
    return j.select("id", F.coalesce("content_type", F.lit("file")).alias("type"), F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def dot_graph(edges: DataFrame, limit: int = 500) -> str:
    """A bounded number of edges as DOT text."""
    rows = edges.select("source_id", "target_id").distinct().orderBy("source_id", "target_id").limit(limit).collect()
    return "digraph g {\n" + "".join(f'  "{r[0]}" -> "{r[1]}";\n' for r in rows) + "}\n"


def row_digest(columns: list[str]) -> Column:
    """48 bits of a row's SHA-256, as a number that sums can gather in any order."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256), 1, 12), 16, 10).cast("decimal(38,0)")


def pack_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and an order-free checksum of each packed table."""
    parts = [df.agg(F.lit(k).alias("table"), F.count(F.lit(1)).alias("rows"), F.sum(row_digest(df.columns)).alias("checksum")) for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_pack(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """All tables and their manifest as Parquet."""
    for k, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{k}")
    manifest = pack_manifest(tables)
    manifest.write.mode("overwrite").parquet(f"{path}/_manifest")
    return manifest


def install_pack(spark, path: str) -> dict[str, DataFrame]:
    """Read a pack back; any checksum that differs refuses the whole pack."""
    want = {r["table"]: (r["rows"], r["checksum"]) for r in spark.read.parquet(f"{path}/_manifest").collect()}
    tables = {k: spark.read.parquet(f"{path}/{k}") for k in want}
    have = {r["table"]: (r["rows"], r["checksum"]) for r in pack_manifest(tables).collect()}
    if have != want:
        raise ValueError("pack differs from its manifest")
    return tables


def with_expiry(docs: DataFrame, as_of: str) -> DataFrame:
    """X01."""
    return docs.withColumn("is_expired", F.coalesce(F.expr("try_to_timestamp(expires_at)") < F.lit(as_of).cast("timestamp"), F.lit(False)))


def nearest_rule(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of the closest ancestor or the file itself wins."""
    from quarry.functions.text import ancestors

    each = files.select("file", "size", F.posexplode(F.array_append(ancestors(F.col("file")), F.col("file"))).alias("depth", "node"))
    hit = each.join(rules, "node").groupBy("file").agg(F.max_by("keep", "depth").alias("keep"))
    return files.join(hit, "file", "left").select("file", "size", F.coalesce("keep", F.lit(True)).alias("keep"))


def best_of(rows: DataFrame, new: DataFrame, n: int) -> DataFrame:
    """X11: the n richest of all time."""
    return rows.unionByName(new).orderBy(F.desc("score"), "id").limit(n)


def pair_replies(messages: DataFrame) -> DataFrame:
    """Each question with the next answer of its conversation."""
    w = Window.partitionBy("conv").orderBy("pos")
    j = messages.withColumns({"next_role": F.lead("role").over(w), "reply": F.lead("id").over(w)})
    return j.where("role = 'user' and next_role = 'assistant'").select("conv", F.col("id").alias("question"), "reply")


def budget_cut(rows: DataFrame, key: str, order: list, size: Column, budget: int) -> DataFrame:
    """Rows of each key while the running size stays within the budget."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)
