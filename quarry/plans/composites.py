"""Queries of the smaller composites, and of operators that share another's plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import cluster as K
from quarry.operators import compose as C
from quarry.operators import facts as L
from quarry.operators import filters as X
from quarry.operators import graph as G
from quarry.operators import quality as Q
from quarry.operators import store as S
from quarry.operators import vector as V
from quarry.operators.ranking import positions
from quarry.plans.tables import kb
from quarry.plans.vectors import _COS, _S, _meta, _vq
from quarry.session import table
from quarry.sources import files as files_source


@query("v02_batch_cosine", f"SELECT label, count(*) AS n, round(avg({_COS}), 6) AS mean FROM vecs GROUP BY label")
def v02(spark, d):
    vecs, q = _vq(spark, d)
    return V.with_scores(vecs, q).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query("v03_batch_dot", f"SELECT id, round({_S}, 6) AS score FROM vecs")
def v03(spark, d):
    vecs, q = _vq(spark, d)
    return V.with_scores(vecs, q, unit=True).select("id", F.round("score", 6).alias("score"))


@query("v04_top_k", "SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT 25")
def v04(spark, d):
    return V.top_k(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score")), 25)


_PROV = "(CASE WHEN provenance = 'human' THEN 0.8 WHEN provenance = 'official' AND source_name NOT IN ('src1') THEN 0.9 ELSE 1.0 END * CASE WHEN stale THEN 0.6 ELSE 1.0 END)::DOUBLE"


@query("v08_search_in_scope", f"""SELECT vecs.id, round({_S} * {_PROV}, 6) AS score FROM vecs JOIN docs ON docs.n = vecs.id
WHERE len(list_filter(files, lambda f: contains(f, 'lib/F_1') OR contains('lib/F_1', f))) > 0 ORDER BY score DESC, vecs.id LIMIT 10""")
def v08(spark, d):
    vecs, q = _vq(spark, d)
    docs = kb(spark, d, "docs").select(F.col("n").alias("id"), "provenance", "stale", "source_name", "files")
    return C.search_in_scope(vecs, docs, q, ["lib/F_1"], 10, ["src1"])


@query("v10_rankers_agree", f"SELECT id, round({_S}, 6) AS score FROM vecs WHERE id IN (SELECT n FROM docs WHERE provenance = 'human') ORDER BY score DESC, id LIMIT 20")
def v10(spark, d):
    vecs, q = _vq(spark, d)
    cand = _meta(spark, d).where("provenance = 'human'").select("id")
    return V.rank_candidates(vecs.select("id", "v"), cand, vecs.limit(0).select("id", F.lit(1.0).alias("weight")), q, 20)


@query("v18_lens_share", "SELECT i::BIGINT AS n, greatest(1, floor((i + 1) / 3))::BIGINT AS share FROM range(1, 13) t(i)")
def v18(spark, d):
    return spark.createDataFrame([(i, V.lens_share(i)) for i in range(1, 13)], "n long, share long")


@query("g07_related_batch", """WITH u AS (SELECT a, b, min(c) AS c FROM (SELECT source_id AS a, target_id AS b, CASE WHEN weight > 0 THEN 1 / weight ELSE 10 END AS c FROM doc_graph UNION ALL SELECT target_id, source_id, CASE WHEN weight > 0 THEN 1 / weight ELSE 10 END FROM doc_graph) GROUP BY a, b)
SELECT s.id AS seed, b AS id, round(c, 6) AS distance FROM docs s JOIN u ON a = s.id WHERE s.content_type = 'de' AND b <> s.id AND b IN (SELECT id FROM docs)""")
def g07(spark, d):
    docs = kb(spark, d, "docs")
    return G.related(kb(spark, d, "doc_graph"), docs.where("content_type = 'de'").select("id"), docs, 1)


@query("j09_endpoint_calls", "WITH s AS MATERIALIZED (SELECT id, source_name FROM symbols), e AS MATERIALIZED (SELECT caller, callee, line FROM sym_edges WHERE edge_type = 'call') SELECT caller, callee, line FROM e JOIN s a ON a.id = e.caller JOIN s b ON b.id = e.callee WHERE a.source_name <> b.source_name")
def j09(spark, d):
    s, e = kb(spark, d, "symbols"), kb(spark, d, "sym_edges").where("edge_type = 'call'")
    j = e.join(s.select(F.col("id").alias("caller"), F.col("source_name").alias("_a")), "caller").join(s.select(F.col("id").alias("callee"), F.col("source_name").alias("_b")), "callee")
    return j.where("_a <> _b").select("caller", "callee", "line")


@query("j10_access_schema", "SELECT table_name, role, count(*) AS n FROM data_access JOIN schema_symbols s ON s.id = schema_id GROUP BY 1, 2")
def j10(spark, d):
    s = kb(spark, d, "schema_symbols").select(F.col("id").alias("schema_id"), "table_name")
    return kb(spark, d, "data_access").join(s, "schema_id").groupBy("table_name", "role").agg(F.count(F.lit(1)).alias("n"))


@query("j14_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def j14(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(o, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("j15_semi_both_ends", "SELECT * FROM doc_graph WHERE source_id IN (SELECT id FROM docs WHERE content_type = 'en') AND target_id IN (SELECT id FROM docs WHERE content_type = 'en')")
def j15(spark, d):
    return K.edges_touching(kb(spark, d, "doc_graph"), kb(spark, d, "docs").where("content_type = 'en'"), both=True, keep=True)


@query("a19_scan_tree", """WITH f AS (SELECT files[1] AS file, length(content) AS size, floor(length(content) / 4) AS tokens FROM docs), e AS (SELECT unnest(list_value(split_part(file, '/', 1), split_part(file, '/', 1) || '/' || split_part(file, '/', 2), file)) AS node, size, tokens FROM f)
SELECT node, count(*) AS files, sum(size)::BIGINT AS size, sum(tokens)::BIGINT AS tokens FROM e GROUP BY node""")
def a19(spark, d):
    f = kb(spark, d, "docs").select(F.element_at("files", 1).alias("file"), F.length("content").cast("long").alias("size"), F.floor(F.length("content") / 4).alias("tokens"))
    return Q.rollup_by_directory(f, "size", "tokens")


@query("a22_theme_coherence", "SELECT count(*) FILTER (coherent) AS coherent, count(*) FILTER (NOT coherent) AS incoherent, count(*) FILTER (coherent IS NULL) AS unjudged, round(count(*) FILTER (coherent) / count(*) FILTER (coherent IS NOT NULL), 6) AS rate FROM themes WHERE dirty")
def a22(spark, d):
    return K.coherence_counts(kb(spark, d, "themes").where("dirty"))


@query("a23_staleness_stats", "SELECT n % 4 = 0 AND n % 8 <> 0 OR n % 5 = 0 AS is_stale, count(*) AS files FROM docs GROUP BY 1")
def a23(spark, d):
    docs = kb(spark, d, "docs").select(F.col("id").alias("file"), "n", F.md5("title").alias("hash"))
    rec = docs.where("n % 5 <> 0").select("file", F.when(F.col("n") % 4 == 0, "old").otherwise(F.col("hash")).alias("hash"), F.array(F.lit("api")).alias("types"), (F.col("n") % 8 == 0).alias("exempt"))
    return S.staleness(docs.select("file", "hash"), rec, ["api"], F.array(F.lit("api"))).groupBy("is_stale").agg(F.count(F.lit(1)).alias("files"))


@query("n07_multi_key_order", "SELECT row_number() OVER (ORDER BY role, line DESC, consumer, schema_id, confidence) AS pos, consumer, schema_id FROM data_access")
def n07(spark, d):
    rows = kb(spark, d, "data_access")
    return positions(rows, ["role", F.desc("line"), "consumer", "schema_id", "confidence"], "pos").select("pos", "consumer", "schema_id")


@query("i14_sync_state", "SELECT source_name, CASE WHEN source_name LIKE '%1' THEN 'new' ELSE 'old' END AS git_hash FROM (SELECT DISTINCT source_name FROM docs)")
def i14(spark, d):
    s = kb(spark, d, "docs").select("source_name").distinct()
    return S.upsert(s.withColumn("git_hash", F.lit("old")), s.where("source_name like '%1'").withColumn("git_hash", F.lit("new")), ["source_name"])


@query("l02_sql_triples", """SELECT id AS consumer, t AS table_name, c AS column_name, r AS role FROM docs JOIN (VALUES (0, 'orders', 'uid', 'filter'), (0, 'users', 'name', 'project'), (0, 'users', 'id', 'filter'), (1, 'users', 'name', 'write'), (1, 'users', 'age', 'write'), (1, 'users', 'id', 'project'),
(2, 'logs', 'ts', 'filter'), (3, 'Order Item', 'Unit Price', 'project'), (3, 'Order Item', 'qty', 'order')) v(k, t, c, r) ON n % 4 = k""")
def l02(spark, d):
    n = F.col("n") % 4
    text = F.when(n == 0, "select b.name from orders a join users b on a.uid = b.id").when(n == 1, "update users set name = 'x; select 1', age = 3 returning id")
    text = text.when(n == 2, "DELETE FROM logs WHERE ts < {limit} /* where msg = 1 */").otherwise('select "Unit Price" from "Order Item" order by qty desc')
    cols = spark.createDataFrame([], "table_name string, column_name string")
    lit = kb(spark, d, "docs").select(F.col("id").alias("consumer"), text.alias("text"))
    return L.access_from_sql(lit, cols).select("consumer", "table_name", "column_name", "role")


@query("l15_literal_lookup", "SELECT 'd' || n AS file, 'v' || (n % 7) AS value FROM docs WHERE n % 7 = 3")
def l15(spark, d):
    lit = kb(spark, d, "docs").select(F.col("id").alias("file"), F.concat(F.lit("v"), F.col("n") % 7).alias("value"))
    return L.literal_lookup(lit, "v3")


@query("l18_surface_tags", "SELECT surface, count(*) AS n FROM (SELECT unnest(list_filter(list_value(CASE WHEN regexp_matches(title || ' ' || feature, '(?i)(^|[^A-Za-z0-9])(bill|invoic)') THEN 'money' END, CASE WHEN regexp_matches(title || ' ' || feature, '(?i)(^|[^A-Za-z0-9])(search|find)') THEN 'search' END), lambda x: x IS NOT NULL)) AS surface FROM docs) GROUP BY 1")
def l18(spark, d):
    s = X.surfaces(F.concat_ws(" ", "title", "feature"), {"money": ["bill", "invoic"], "search": ["search", "find"]})
    return kb(spark, d, "docs").select(F.explode(s).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("n"))


@query("s13_listing")
def s13(spark, d):
    return files_source.listing(spark, d, glob="*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("s20_slice_merge", "SELECT source_name, id FROM docs WHERE source_name <> 'src2' UNION ALL SELECT source_name, id FROM docs WHERE source_name = 'src2' AND n % 2 = 0")
def s20(spark, d):
    docs = kb(spark, d, "docs").select("source_name", "id", "n")
    part = docs.where("source_name = 'src2' and n % 2 = 0").drop("n")
    return S.replace_source(docs.drop("n"), part, "src2")


@query("x02_branch_status", "SELECT id, count(DISTINCT f) AS changed_files FROM (SELECT id, unnest(files) AS f FROM docs) WHERE f IN ('lib/F_2.py', 'src/src4/m4.py') GROUP BY id")
def x02(spark, d):
    return C.branch_status(kb(spark, d, "docs"), spark.createDataFrame([("lib/F_2.py",), ("src/src4/m4.py",)], "file string"))


@query("x03_sync_status", "SELECT source_name, CASE WHEN source_name LIKE '%1' THEN 'never' WHEN source_name LIKE '%2' THEN 'behind' ELSE 'synced' END AS state FROM (SELECT DISTINCT source_name FROM docs)")
def x03(spark, d):
    s = kb(spark, d, "docs").select("source_name").distinct()
    old = s.withColumn("hash", F.when(~F.col("source_name").like("%1"), F.when(F.col("source_name").like("%2"), "a").otherwise("b")))
    return C.sync_status(old, s.withColumn("hash", F.lit("b")))


@query("x04_consumed_branch_docs", "SELECT id FROM docs WHERE status = 'experimental' AND (branches[1] = 'feature/2' OR branches[1] = 'feature/4')")
def x04(spark, d):
    docs = kb(spark, d, "docs").withColumn("branches", F.slice("branches", 1, 1))
    return C.consumed_branch_docs(docs, spark.createDataFrame([("feature/2",), ("feature/4",)], "branch string"))


@query("x06_reconcile", "SELECT id, CASE WHEN n % 3 = 0 THEN 'add' WHEN n % 5 = 0 THEN 'remove' ELSE 'update' END AS action FROM docs WHERE NOT (n % 3 = 0 AND n % 5 = 0) AND (n % 3 = 0 OR n % 5 = 0 OR n % 7 = 0)")
def x06(spark, d):
    docs = kb(spark, d, "docs").select("id", "n", F.md5("id").alias("h"))
    return C.reconcile(docs.where("n % 5 <> 0"), docs.where("n % 3 <> 0").withColumn("h", F.when(F.col("n") % 7 == 0, "old").otherwise(F.col("h"))), "id", "h")


@query("x08_exclusion_savings", "SELECT 'src/src4' AS node, count(*) AS files, sum(length(content))::BIGINT AS size FROM docs WHERE starts_with(files[1], 'src/src4/') UNION ALL SELECT 'src', count(*), sum(length(content))::BIGINT FROM docs")
def x08(spark, d):
    f = kb(spark, d, "docs").select(F.element_at("files", 1).alias("file"), F.length("content").cast("long").alias("size"))
    return C.exclusion_savings(f, spark.createDataFrame([("src",), ("src/src4",)], "node string"))


@query("x09_language_histogram", "SELECT CASE n % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'go' ELSE 'other' END AS language, count(*) AS n FROM docs GROUP BY 1")
def x09(spark, d):
    f = kb(spark, d, "docs").select(F.concat(F.lit("a"), "n", F.when(F.col("n") % 3 == 0, ".py").when(F.col("n") % 3 == 1, ".GO").otherwise("")).alias("file"))
    return C.language_histogram(f, {"py": "python", "go": "go"})


@query("x10_extensions", "SELECT CASE n % 2 WHEN 0 THEN 'py' ELSE 'md' END AS ext, count(*) AS files FROM docs GROUP BY 1")
def x10(spark, d):
    return files_source.extensions(kb(spark, d, "docs").select(F.concat(F.lit("a"), "n", F.when(F.col("n") % 2 == 0, ".PY").otherwise(".md")).alias("path")))


@query("x13_cached_answer", "SELECT id FROM docs WHERE feature = 'Billing' AND source_name = 'src3' AND n % 2 = 0 ORDER BY updated_at DESC, id LIMIT 1")
def x13(spark, d):
    a = kb(spark, d, "docs").select("id", "updated_at", F.col("feature").alias("audience"), F.col("source_name").alias("fingerprint"), F.when(F.col("n") % 2 == 0, " How? ").otherwise("Why?").alias("question"))
    return C.cached_answer(a, "Billing", "how?", "src3")


@query("x17_resolve_links", """WITH l AS (SELECT id AS doc, CASE WHEN n % 3 = 0 THEN 'm.Order' || CAST(n + 1 AS VARCHAR) ELSE 'Order' || CAST(n + 1 AS VARCHAR) END AS target FROM docs), o AS (SELECT last, min(qname) AS q FROM (SELECT qname, string_split(qname, '.')[-1] AS last FROM symbols) GROUP BY last HAVING count(*) = 1)
SELECT doc, target, coalesce((SELECT min(qname) FROM symbols WHERE qname = target), q) AS resolved FROM l LEFT JOIN o ON o.last = target""")
def x17(spark, d):
    t = F.concat(F.when(F.col("n") % 3 == 0, "m.Order").otherwise("Order"), F.col("n") + 1)
    return C.resolve_links(kb(spark, d, "docs").select(F.col("id").alias("doc"), t.alias("target")), kb(spark, d, "symbols"))


@query("x18_capability_profile", """WITH h AS (SELECT source_name, feature AS concern, count(*) AS evidence FROM docs WHERE NOT (source_name = 'src4' AND feature = 'Export') GROUP BY 1, 2)
SELECT * FROM h UNION ALL SELECT DISTINCT source_name, 'Export', 0::BIGINT FROM h WHERE concern = 'Billing' AND source_name NOT IN (SELECT source_name FROM h WHERE concern = 'Export')""")
def x18(spark, d):
    f = kb(spark, d, "docs").where("not (source_name = 'src4' and feature = 'Export')").select("source_name", F.col("feature").alias("concern"))
    return C.capability_profile(f, spark.createDataFrame([("Billing", "Export")], "concern string, needs string"))


@query("x19_changed_signatures", "SELECT DISTINCT source_name FROM docs WHERE source_name LIKE '%3' OR source_name LIKE '%7'")
def x19(spark, d):
    now = Q.source_signature(kb(spark, d, "docs"))
    old = now.where("source_name not like '%7'").withColumn("signature", F.when(F.col("source_name").like("%3"), "0|").otherwise(F.col("signature")))
    return C.changed_signatures(now, old)


@query("x20_components", "SELECT 'Gate' AS source, 'Core' AS target, count(*) AS n FROM docs UNION ALL SELECT 'Core', 'Store', count(*) FROM docs WHERE n % 2 = 0")
def x20(spark, d):
    return C.components_of(kb(spark, d, "docs").select(F.concat(F.lit("so Gate -> Core. "), F.when(F.col("n") % 2 == 0, "Core -> Store").otherwise("end")).alias("content")))


@query("x20_layers", "SELECT * FROM (VALUES ('Gate', 'entry'), ('Core', 'middle'), ('Store', 'exit')) v(name, layer)")
def x20l(spark, d):
    return C.layers(spark.createDataFrame([("Gate", "Core"), ("Core", "Store")], "source string, target string"))


@query("x21_pages", """WITH r AS (SELECT source_name, '- ' || id AS t, row_number() OVER (PARTITION BY source_name ORDER BY '- ' || id) AS r FROM docs)
SELECT source_name, '## ' || source_name || chr(10) || string_agg(t, chr(10) ORDER BY t) AS block FROM r WHERE r <= 3 GROUP BY 1""")
def x21(spark, d):
    return C.page_of(kb(spark, d, "docs"), "source_name", F.concat(F.lit("- "), "id"), 3)


@query("x22_revision", "SELECT * FROM (VALUES ('main', 'm1', 4::BIGINT), ('other', 'm2', 1::BIGINT)) v(name, identity, revision)")
def x22(spark, d):
    return C.next_revision(spark.createDataFrame([("main", "m1", 3), ("other", "m2", 1)], "name string, identity string, revision long"), "main", "m1")


@query("x23_scoped_copy", "SELECT id, 'pack' AS source_name, substr(files[1], 10) AS file FROM docs WHERE source_name = 'src4'")
def x23(spark, d):
    t = kb(spark, d, "docs").select("id", "source_name", F.element_at("files", 1).alias("file"))
    return C.scoped_copy(t, "src4", "pack", "src/src4/", ["file"])
