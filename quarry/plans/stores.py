"""Queries over document scans, keyed writes, slices and packs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import filters as X
from quarry.operators import store as S
from quarry.plans.tables import kb, line_tasks
from quarry.session import shared_folder, table
from quarry.sources.files import usage_log


@query("s01_list_documents", "SELECT id, content_type, title FROM docs WHERE content_type = 'de' ORDER BY updated_at DESC, id LIMIT 20")
def s01(spark, d):
    return kb(spark, d, "docs").where("content_type = 'de'").orderBy(F.desc("updated_at"), "id").limit(20).select("id", "content_type", "title")


@query("s02_list_lite", "SELECT id, title, source_name, status, feature FROM docs WHERE content_type = 'fr'")
def s02(spark, d):
    return kb(spark, d, "docs").where("content_type = 'fr'").select("id", "title", "source_name", "status", "feature")


@query("s03_get_document", "SELECT id, title, md5(content) AS h FROM docs WHERE id = 'd42'")
def s03(spark, d):
    return kb(spark, d, "docs").where("id = 'd42'").select("id", "title", F.md5("content").alias("h"))


@query("s04_batch_ordered", "SELECT pos::INTEGER AS pos, docs.id, title FROM (VALUES (0, 'd9'), (1, 'd3'), (2, 'd77'), (3, 'd3')) v(pos, id) JOIN docs USING (id)")
def s04(spark, d):
    ids = spark.createDataFrame([(["d9", "d3", "d77", "d3"],)], "ids array<string>").select(F.posexplode("ids").alias("pos", "id"))
    return ids.join(kb(spark, d, "docs"), "id").orderBy("pos").select("pos", "id", "title")


@query("s05_embeddings_for_ids", "SELECT id, v[1]::DOUBLE AS first FROM vecs WHERE 'd' || id IN (SELECT id FROM docs WHERE content_type = 'es')")
def s05(spark, d):
    want = kb(spark, d, "docs").where("content_type = 'es'").select(F.substring("id", 2, 12).cast("long").alias("id"))
    return kb(spark, d, "vecs").where("v is not null").join(want, "id", "left_semi").select("id", F.element_at("v", 1).cast("double").alias("first"))


@query("s06_missing_embeddings", "SELECT content_type, count(*) AS n FROM docs WHERE NOT has_vector AND coalesce(feature, '') <> 'Export' GROUP BY 1")
def s06(spark, d):
    return kb(spark, d, "docs").where("not has_vector and coalesce(feature, '') <> 'Export'").groupBy("content_type").agg(F.count(F.lit(1)).alias("n"))


@query("s07_element_names", "SELECT id, 'q.' || n AS name, files[1] AS file FROM docs WHERE source_name = 'src3' AND feature NOT IN ('Export')")
def s07(spark, d):
    docs = kb(spark, d, "docs").withColumn("meta", F.to_json(F.struct(F.concat(F.lit("q."), "n").alias("qualified_name"), F.col("feature").alias("subtype"))))
    name, kind = F.get_json_object("meta", "$.qualified_name"), F.get_json_object("meta", "$.subtype")
    return docs.where((F.col("source_name") == "src3") & ~kind.isin("Export")).select("id", name.alias("name"), F.try_element_at("files", F.lit(1)).alias("file"))


@query("s08_get_chunks", "SELECT idx, heading, md5(content) AS h FROM sections WHERE document_id = 'c3' ORDER BY idx")
def s08(spark, d):
    return kb(spark, d, "sections").where("document_id = 'c3'").orderBy("idx").select("idx", "heading", F.md5("content").alias("h"))


@query("s09_sections_batch", "SELECT i.id, count(idx)::BIGINT AS n, coalesce(string_agg(heading, ',' ORDER BY idx), '') AS headings FROM (VALUES ('c1'), ('c5'), ('none')) i(id) LEFT JOIN sections ON document_id = i.id GROUP BY 1")
def s09(spark, d):
    ids = spark.createDataFrame([("c1",), ("c5",), ("none",)], "id string")
    s = kb(spark, d, "sections").groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("idx", "heading"))).alias("s"))
    j = ids.join(s, "id", "left").withColumn("s", F.coalesce("s", F.expr("cast(array() as array<struct<idx:int,heading:string>>)")))
    return j.select("id", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x["heading"]), ",").alias("headings"))


_LIKE = "(len(list_filter(files, lambda f: f ILIKE '%f_1%' OR f ILIKE '%m7.py%')) > 0)"


def _like_any(spark, d):
    return kb(spark, d, "docs").where(F.exists("files", lambda f: f.ilike("%f_1%") | f.ilike("%m7.py%")))


@query("s10_like_any", f"SELECT id FROM docs WHERE {_LIKE}")
def s10(spark, d):
    return _like_any(spark, d).select("id")


@query("s11_page_by_files", f"SELECT id, content_type, (SELECT count(*) FROM docs WHERE {_LIKE} AND content_type IN ('en', 'es')) AS total FROM docs WHERE {_LIKE} AND content_type IN ('en', 'es') ORDER BY content_type, id LIMIT 10 OFFSET 5")
def s11(spark, d):
    return X.page(_like_any(spark, d).where("content_type in ('en', 'es')").select("id", "content_type"), ["content_type", "id"], 10, 5)


@query("s12_matching_content", "SELECT id FROM docs WHERE content ILIKE '%license%' AND array_to_string(files, ',') ILIKE '%f_2%'")
def s12(spark, d):
    return kb(spark, d, "docs").where(F.col("content").ilike("%license%") & F.array_join("files", ",").ilike("%f_2%")).select("id")


@query("w01_manifest", "SELECT content_type, count(*) AS files, sum(length(content))::BIGINT AS chars, min(id) AS first_id FROM docs GROUP BY 1")
def w01(spark, d):
    return S.export_manifest(kb(spark, d, "docs"))


@query("w02_graph_export", """WITH n AS (SELECT source_id AS id FROM doc_graph UNION SELECT target_id FROM doc_graph), c AS (SELECT f AS id, count(*) AS k FROM (SELECT unnest(files) AS f FROM docs) GROUP BY 1)
SELECT n.id, CASE WHEN docs.n % 10 = 0 THEN 'topic' ELSE coalesce(content_type, 'file') END AS type, coalesce(k, 0) AS doc_count FROM n LEFT JOIN docs ON docs.id = n.id LEFT JOIN c ON c.id = n.id""")
def w02(spark, d):
    return S.graph_export(kb(spark, d, "doc_graph"), kb(spark, d, "docs").withColumn("topic", F.col("n") % 10 == 0))


@query("s19_usage_log", "SELECT CAST(event_id AS VARCHAR) AS ts, CAST(user_id AS VARCHAR) AS actor, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'hit' END AS outcome, (event_id % 11)::INTEGER AS score FROM events WHERE event_id % 7 <> 0")
def s19(spark, d):
    folder = f"{shared_folder(spark)}/usage-log-{uuid.uuid4().hex}"
    e = F.col("event_id")
    row = F.struct(e.cast("string").alias("ts"), F.col("user_id").cast("string").alias("actor"), F.col("event_type").alias("name"), F.when(e % 2 == 0, "hit").alias("outcome"), (e % 11).alias("score"))
    line = F.to_json(row)
    broken = F.when(e % 21 == 0, F.substring(line, 1, 12)).otherwise(F.concat(F.lit("not json "), line))
    table(spark, d, "events").select(F.when(e % 7 == 0, broken).otherwise(line).alias("value")).write.text(folder)
    return usage_log(spark, folder)


@query("w03_dot_graph", """WITH e AS (SELECT DISTINCT source_id, target_id FROM doc_graph ORDER BY source_id, target_id LIMIT 50)
SELECT 'digraph g {' || chr(10) || string_agg('  "' || source_id || '" -> "' || target_id || '";' || chr(10), '' ORDER BY source_id, target_id) || '}' || chr(10) AS dot FROM e""")
def w03(spark, d):
    return spark.createDataFrame([(S.dot_graph(kb(spark, d, "doc_graph"), 50),)], "dot string")


@query("w04_pack_manifest", """SELECT 'docs' AS "table", count(*) AS rows, sum(('0x' || substr(sha256(concat_ws('|', id, title, source_name)), 1, 12))::BIGINT)::DECIMAL(38,0) AS checksum FROM docs
UNION ALL SELECT 'graph', count(*), sum(('0x' || substr(sha256(concat_ws('|', source_id, target_id, edge_type, weight)), 1, 12))::BIGINT)::DECIMAL(38,0) FROM doc_graph""")
def w04(spark, d):
    return S.pack_manifest({"docs": kb(spark, d, "docs").select("id", "title", "source_name"), "graph": kb(spark, d, "doc_graph")})


@query("s21_front_matter", "SELECT CASE WHEN n % 4 = 0 THEN NULL ELSE id END AS id, CASE WHEN n % 4 = 0 THEN NULL ELSE 't' || n END AS title, 'body ' || n AS content FROM docs")
def s21(spark, d):
    body = F.concat(F.lit("body "), "n")
    t = F.when(F.col("n") % 4 == 0, body).otherwise(F.concat(F.lit("---\nid: "), "id", F.lit("\ntitle: t"), "n", F.lit("\n---\n"), body))
    return S.parse_front_matter(kb(spark, d, "docs").select(t.alias("value")))


# --- keyed writes ---------------------------------------------------------------------------------------------


def _pair(spark, d):
    docs = kb(spark, d, "docs")
    old = docs.where("n % 3 <> 0").select("id", "title", "feature")
    return old, docs.where("n % 2 = 0").select("id", F.reverse("title").alias("title"), "feature")


@query("i01_upsert_replace", "SELECT id, title, feature FROM docs WHERE n % 3 <> 0 AND n % 2 = 1 UNION ALL SELECT id, reverse(title), feature FROM docs WHERE n % 2 = 0")
def i01(spark, d):
    return S.upsert(*_pair(spark, d), ["id"])


@query("i07_merge_upsert", "SELECT id, title, feature FROM docs WHERE n % 3 <> 0 UNION ALL SELECT id, reverse(title), feature FROM docs WHERE n % 2 = 0 AND n % 3 = 0")
def i07(spark, d):
    return S.upsert(*_pair(spark, d), ["id"], "ignore")


@query("i01_update_documents", "SELECT id, CASE WHEN n % 5 = 0 THEN 'new' ELSE title END AS title, has_vector AND NOT (n % 5 = 0 AND title <> 'new') AS has_vector FROM docs")
def i01u(spark, d):
    docs = kb(spark, d, "docs").select("id", "title", "content", "has_vector")
    return S.update_documents(docs, kb(spark, d, "docs").where("n % 5 = 0").select("id", F.lit("new").alias("title"), "content")).select("id", "title", "has_vector")


@query("i01_invalid", "SELECT id, CASE WHEN trim(title) = '' THEN 'empty title' ELSE 'unknown type' END AS reason FROM docs WHERE trim(title) = '' OR content_type NOT IN ('en', 'de')")
def i01i(spark, d):
    return S.invalid_documents(kb(spark, d, "docs"), ["en", "de"])


@query("i02_replace_children", "SELECT document_id, idx, heading FROM sections WHERE document_id <> 'c3' UNION ALL SELECT 'c3', 0, 'fresh'")
def i02(spark, d):
    new = spark.createDataFrame([("c3", 0, "fresh")], "document_id string, idx int, heading string")
    return S.replace_children(kb(spark, d, "sections").select("document_id", "idx", "heading"), new, "document_id")


@query("i03_checked_replace", "SELECT id, CASE WHEN n % 4 = 0 AND n % 8 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN n % 4 <> 0 THEN 'kept' WHEN n % 8 = 0 THEN 'replaced' ELSE 'stale' END AS state FROM docs")
def i03(spark, d):
    docs = kb(spark, d, "docs").select("id", "n", "content", F.lit(1).cast("long").alias("version"))
    new = docs.where("n % 4 = 0").select("id", F.when(F.col("n") % 8 == 0, 1).otherwise(0).alias("version"), F.lit("x").alias("content"))
    return S.checked_replace(docs.drop("n"), new).select("id", "version", "state")


@query("i04_replace_source", "SELECT source_name, id FROM docs WHERE source_name <> 'src1' UNION ALL SELECT 'src1', 'only'")
def i04(spark, d):
    return S.replace_source(kb(spark, d, "docs").select("source_name", "id"), spark.createDataFrame([("src1", "only")], "source_name string, id string"), "src1")


@query("i05_purge_counts", "SELECT 'docs' AS \"table\", count(*) AS rows FROM docs WHERE source_name = 'src1' UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE source_name = 'src1'")
def i05(spark, d):
    return S.purge_counts({"docs": kb(spark, d, "docs"), "symbols": kb(spark, d, "symbols")}, "src1")


@query("i06_slice", "SELECT DISTINCT caller, callee, edge_type FROM sym_edges WHERE caller IN (SELECT id FROM symbols WHERE source_name = 's1') OR callee IN (SELECT id FROM symbols WHERE source_name = 's1')")
def i06(spark, d):
    return S.slice_source(kb(spark, d, "symbols"), kb(spark, d, "sym_edges").select("caller", "callee", "edge_type"), "s1", line_tasks(spark, d))


@query("i08_diff_status", """SELECT id, CASE WHEN n % 7 = 0 THEN 'added' WHEN n % 5 = 0 THEN 'removed' WHEN n % 3 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM docs WHERE NOT (n % 7 = 0 AND n % 5 = 0)""")
def i08(spark, d):
    docs = kb(spark, d, "docs").select("id", "n", F.md5("title").alias("h"))
    return S.diff_status(docs.where("n % 7 <> 0"), docs.where("n % 5 <> 0").withColumn("h", F.when(F.col("n") % 3 == 0, "x").otherwise(F.col("h"))), "id", "h")


@query("i08_moved", "SELECT md5(id) AS h, id AS old_key, 'new/' || id AS new_key FROM docs WHERE n % 6 = 0")
def i08m(spark, d):
    docs = kb(spark, d, "docs").select("id", "n", F.md5("id").alias("h"))
    new = docs.select(F.when(F.col("n") % 6 == 0, F.concat(F.lit("new/"), "id")).otherwise(F.col("id")).alias("id"), "h")
    return S.moved(docs, new, "id", "h")


@query("i09_staleness", """SELECT id AS file, n % 4 = 0 AND n % 8 <> 0 OR n % 5 = 0 AS is_stale, CASE WHEN n % 5 = 0 THEN 'api,guide' ELSE 'guide' END AS missing FROM docs""")
def i09(spark, d):
    docs = kb(spark, d, "docs").select(F.col("id").alias("file"), "n", F.md5("title").alias("hash"))
    rec = docs.where("n % 5 <> 0").select("file", F.when(F.col("n") % 4 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.array(F.lit("api")).alias("types"), (F.col("n") % 8 == 0).alias("exempt"))
    return S.staleness(docs.select("file", "hash"), rec, ["api", "guide", "tour"], F.array(F.lit("api"), F.lit("guide")))


@query("i10_feedback", "SELECT id, CASE WHEN id % 4 = 0 THEN 'score:99' ELSE feedback END AS feedback, CASE WHEN id % 4 = 0 THEN 10 ELSE score END AS score FROM usage")
def i10(spark, d):
    u = kb(spark, d, "usage")
    f = u.where("id % 4 = 0").select("id", F.explode(F.array(F.struct(F.lit("score:3").alias("text"), F.lit(1).alias("at")), F.struct(F.lit("score:99").alias("text"), F.lit(2).alias("at")))).alias("x")).select("id", "x.text", "x.at")
    return S.with_feedback(u, f)


@query("i11_live_cache", "SELECT id FROM docs WHERE updated_at > TIMESTAMP '2024-01-20 00:00:00'")
def i11(spark, d):
    return S.live_cache(kb(spark, d, "docs").select("id", F.col("updated_at").alias("created_at")), "2024-02-19 00:00:00", 30).select("id")


@query("i12_remap", "SELECT CASE WHEN source_id = 'd8' THEN 'D8' ELSE source_id END AS source_id, CASE WHEN target_id = 'd8' THEN 'D8' ELSE target_id END AS target_id FROM doc_graph")
def i12(spark, d):
    return S.remap_ids(kb(spark, d, "doc_graph").select("source_id", "target_id"), spark.createDataFrame([("d8", "D8")], "old string, new string"), ["source_id", "target_id"])


@query("i13_deprecate", "SELECT id, CASE WHEN updated_at <= TIMESTAMP '2024-01-15 00:00:00' THEN 'deprecated' ELSE status END AS status FROM docs")
def i13(spark, d):
    return S.deprecate_stale(kb(spark, d, "docs").select("id", "updated_at", "status"), "2024-02-14 00:00:00", 30).select("id", "status")


@query("i15_upsert_routes", """SELECT id, CASE WHEN n % 2 = 0 AND n % 4 = 0 THEN NULL WHEN n % 3 = 0 AND n % 2 = 0 THEN 'v' || n WHEN n % 2 = 0 THEN NULL ELSE 'v' || n END AS vector FROM docs WHERE n % 2 = 0 OR n % 3 = 0""")
def i15(spark, d):
    docs = kb(spark, d, "docs")
    old = docs.where("n % 3 = 0").select("id", F.array("id").alias("steps"), F.lit(None).cast("string").alias("question"), F.concat(F.lit("v"), "n").alias("vector"))
    new = docs.where("n % 2 = 0").select("id", F.when(F.col("n") % 4 == 0, F.array(F.lit("x"))).otherwise(F.array("id")).alias("steps"), F.lit(None).cast("string").alias("question"), F.lit(None).cast("string").alias("vector"))
    return S.upsert_routes(old, new).select("id", "vector")


@query("i16_insert_ignore", "SELECT min(n) AS id, source_name, CASE WHEN n % 3 = 0 THEN NULL ELSE 'v' || (n % 3) END AS version FROM docs GROUP BY 2, 3")
def i16(spark, d):
    f = kb(spark, d, "docs").select(F.col("n").alias("id"), "source_name", F.when(F.col("n") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("v"), F.col("n") % 3)).alias("version"))
    return S.insert_ignore(f, ["source_name"], "version")


@query("i17_schema_merge", "SELECT table_name, column_name, CASE WHEN column_name LIKE '%1' THEN 'exact' WHEN column_name LIKE '%2' THEN 'gap' ELSE 'resolved' END AS status FROM schema_symbols")
def i17(spark, d):
    s = kb(spark, d, "schema_symbols")
    return S.merge_schema(s.where("column_name not like '%1'"), s.where("column_name not like '%2'"))


# --- smaller composites -----------------------------------------------------------------------------------------


@query("x01_list_all", "SELECT id, n % 3 <> 0 AND updated_at < TIMESTAMP '2024-01-10 00:00:00' AS is_expired FROM docs")
def x01(spark, d):
    docs = kb(spark, d, "docs").select("id", F.when(F.col("n") % 3 == 0, "?").otherwise(F.col("updated_at").cast("string")).alias("expires_at"))
    return S.with_expiry(docs, "2024-01-10 00:00:00").select("id", "is_expired")


@query("x05_version_delta", "SELECT source_name, CASE WHEN source_name LIKE '%1' THEN 'added' WHEN source_name LIKE '%2' THEN 'removed' ELSE 'unchanged' END AS status FROM (SELECT DISTINCT source_name FROM docs)")
def x05(spark, d):
    s = kb(spark, d, "docs").select("source_name").distinct().withColumn("sha", F.md5("source_name"))
    return S.diff_status(s.where("source_name not like '%1'"), s.where("source_name not like '%2'"), "source_name", "sha")


@query("x07_nearest_rule", """SELECT DISTINCT f AS file, 1::BIGINT AS size, CASE WHEN f LIKE 'src/src4/m7%' THEN true WHEN f LIKE 'src/src4/%' THEN false ELSE true END AS keep FROM (SELECT files[1] AS f FROM docs)""".replace("LIKE 'src/src4/m7%'", "= 'src/src4/m7.py'"))
def x07(spark, d):
    f = kb(spark, d, "docs").select(F.element_at("files", 1).alias("file")).distinct().withColumn("size", F.lit(1).cast("long"))
    return S.nearest_rule(f, spark.createDataFrame([("src/src4", False), ("src/src4/m7.py", True), ("src", True)], "node string, keep boolean"))


@query("x11_best_of", "SELECT id, length(content)::BIGINT AS score FROM docs ORDER BY score DESC, id LIMIT 15")
def x11(spark, d):
    r = kb(spark, d, "docs").select("id", "n", F.length("content").cast("long").alias("score"))
    return S.best_of(r.where("n % 2 = 0").drop("n"), r.where("n % 2 = 1").drop("n"), 15)


@query("x12_pair_replies", """WITH m AS (SELECT conv_id, turn, role, lead(role) OVER w AS nr, lead(turn) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS conv, turn AS question, reply FROM m WHERE role = 'user' AND nr = 'assistant'""")
def x12(spark, d):
    return S.pair_replies(table(spark, d, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("id"), F.col("turn").alias("pos"), "role"))


@query("x14_budget_cut", "SELECT id, source_name, running FROM (SELECT id, source_name, sum(length(content)) OVER (PARTITION BY source_name ORDER BY n ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM docs) WHERE running <= 30000")
def x14(spark, d):
    return S.budget_cut(kb(spark, d, "docs"), "source_name", ["n"], F.length("content"), 30000).select("id", "source_name", "running")


@query("x15_index_docs", "SELECT files[2] AS file, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM docs GROUP BY 1")
def x15(spark, d):
    g = kb(spark, d, "docs").groupBy(F.element_at("files", 2).alias("file"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


@query("x16_external_callers", """SELECT a.file AS from_file, b.file AS to_file, count(*) AS edges FROM sym_edges e JOIN symbols a ON a.id = caller JOIN symbols b ON b.id = callee WHERE edge_type <> 'contains' AND a.file <> b.file GROUP BY 1, 2""")
def x16(spark, d):
    s = kb(spark, d, "symbols")
    j = kb(spark, d, "sym_edges").where("edge_type <> 'contains'").select("caller", "callee")
    j = j.join(s.select(F.col("id").alias("caller"), F.col("file").alias("from_file")), "caller").join(s.select(F.col("id").alias("callee"), F.col("file").alias("to_file")), "callee")
    return j.where("from_file <> to_file").groupBy("from_file", "to_file").agg(F.count(F.lit(1)).alias("edges"))
