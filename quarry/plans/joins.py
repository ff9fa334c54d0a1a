"""Queries that show one join kind each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import joins as J
from quarry.plans.tables import kb
from quarry.session import table

_PTS = "(SELECT DISTINCT file, line_start + 1 AS line FROM symbols WHERE kind = 'class')"


def _points(spark, d):
    return kb(spark, d, "symbols").where("kind = 'class'").select("file", (F.col("line_start") + 1).alias("line")).distinct()


@query("j01_innermost_range", f"""SELECT file, line, id FROM (SELECT p.file, line, id, row_number() OVER (PARTITION BY p.file, line ORDER BY line_end - line_start, line_start DESC, id) AS r
FROM {_PTS} p JOIN symbols s ON s.file = p.file AND line BETWEEN line_start AND line_end) WHERE r = 1""")
def j01(spark, d):
    return J.innermost(_points(spark, d), kb(spark, d, "symbols"))


@query("j02_latest_start", f"""SELECT file, line, id FROM (SELECT p.file, line, id, row_number() OVER (PARTITION BY p.file, line ORDER BY line_start DESC, line_end, id) AS r
FROM {_PTS} p JOIN symbols s ON s.file = p.file AND line BETWEEN line_start AND line_end) WHERE r = 1""")
def j02(spark, d):
    return J.latest_start(_points(spark, d), kb(spark, d, "symbols"))


@query("j03_asof_window", """WITH t AS (SELECT event_id AS turn, user_id AS key, ts AS t FROM events WHERE event_type = 'view'),
u AS (SELECT *, least(coalesce(lead(t) OVER (PARTITION BY key ORDER BY t), t + INTERVAL 6 HOUR), t + INTERVAL 6 HOUR) AS until FROM t),
e AS (SELECT user_id AS key, ts AS et, value FROM events WHERE event_type = 'click'),
m AS (SELECT turn, et, value, row_number() OVER (PARTITION BY turn ORDER BY et DESC, value DESC) AS r FROM u JOIN e ON e.key = u.key AND et >= t AND et < until)
SELECT t.turn, et, value FROM t LEFT JOIN m ON m.turn = t.turn AND r = 1""")
def j03(spark, d):
    e = table(spark, d, "events")
    turns = e.where("event_type = 'view'").select(F.col("event_id").alias("turn"), F.col("user_id").alias("key"), F.col("ts").alias("t"))
    return J.asof_window(turns, e.where("event_type = 'click'").select(F.col("user_id").alias("key"), F.col("ts").alias("t"), "value"), 6 * 3600)


@query("j04_template_match", r"""WITH u AS (SELECT page_id AS id, string_split(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '(.)/$', '\1'), '/') AS p FROM pages),
t(e, tp) AS (VALUES (1, string_split('/{lang}/{id}', '/')), (2, string_split('/en/{id}', '/')), (3, string_split('/{a}/{b}/{c}', '/'))),
h AS (SELECT id, e FROM u JOIN t ON len(p) = len(tp) WHERE NOT list_contains(list_transform(generate_series(1, len(p)), lambda i: p[i] = tp[i] OR regexp_matches(tp[i], '^\{.*\}$')), false))
SELECT u.id, min(e) AS endpoint, CASE WHEN count(e) > 1 THEN 'ambiguous' WHEN count(e) = 1 THEN 'exact' END AS confidence FROM u LEFT JOIN h USING (id) GROUP BY u.id""")
def j04(spark, d):
    t = spark.createDataFrame([(1, "/{lang}/{id}", None), (2, "/en/{id}", None), (3, "/{a}/{b}/{c}", None)], "id int, template string, method string")
    return J.match_templates(table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", F.lit(None).cast("string").alias("method")), t)


@query("j05_unique_match", """WITH s AS (SELECT CASE WHEN kind = 'class' THEN qname ELSE name END AS name, id FROM symbols), l AS (SELECT CASE WHEN n % 2 = 0 THEN 'line' || (n % 9) ELSE 'm.Order' || n END AS name, id AS doc FROM docs)
SELECT l.name, doc, o.id FROM l LEFT JOIN (SELECT name, min(id) AS id FROM s GROUP BY name HAVING count(*) = 1) o USING (name)""")
def j05(spark, d):
    name = F.when(F.col("n") % 2 == 0, F.concat(F.lit("line"), F.col("n") % 9)).otherwise(F.concat(F.lit("m.Order"), "n"))
    right = kb(spark, d, "symbols").select(F.when(F.col("kind") == "class", F.col("qname")).otherwise(F.col("name")).alias("name"), "id")
    return J.unique_match(kb(spark, d, "docs").select(name.alias("name"), F.col("id").alias("doc")), right, "name", "id")


@query("j06_resolve_cascade", """SELECT n AS call, CASE WHEN n % 12 < 3 THEN 'lit' || n % 12 WHEN n % 12 < 6 THEN 'sym' || n % 12 WHEN n % 12 < 9 THEN 'cfg' || n % 12 END AS value,
CASE WHEN n % 12 < 3 THEN 'exact' WHEN n % 12 < 6 THEN 'resolved' WHEN n % 12 < 9 THEN 'derived' END AS confidence FROM docs""")
def j06(spark, d):
    side = lambda p, hi: spark.range(hi).select(F.concat(F.lit("a"), "id").alias("arg"), F.concat(F.lit(p), "id").alias("value"))
    calls = kb(spark, d, "docs").select(F.col("n").alias("call"), F.concat(F.lit("a"), F.col("n") % 12).alias("arg"))
    return J.resolve_cascade(calls, side("lit", 3), side("sym", 6), side("cfg", 9))


@query("j07_child_parent", "SELECT l_returnflag, o_orderpriority, count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def j07(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_returnflag", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"))


@query("j08_orphans", "SELECT document_id, idx FROM sections WHERE document_id NOT IN (SELECT 'c' || n FROM docs WHERE n % 2 = 0)")
def j08(spark, d):
    parents = kb(spark, d, "docs").where("n % 2 = 0").select(F.concat(F.lit("c"), "n").alias("document_id"))
    return J.orphans(kb(spark, d, "sections").select("document_id", "idx"), parents, "document_id")


@query("j12_member_join", "SELECT u.id AS event, docs.id AS id, source_name FROM (SELECT id, unnest(served) AS s FROM usage) u JOIN docs ON docs.id = s")
def j12(spark, d):
    return J.member_join(kb(spark, d, "usage").select(F.col("id").alias("event"), "served"), "served", kb(spark, d, "docs").select("id", "source_name"), "id")


@query("j13_containing_files", "SELECT source_id, target_id, name FROM doc_graph JOIN (VALUES ('F_1'), ('m2')) t(name) ON contains(target_id, name)")
def j13(spark, d):
    return J.containing_files(kb(spark, d, "doc_graph"), spark.createDataFrame([("F_1",), ("m2",)], "name string"))


@query("j16_component_fallback", """WITH v(source_name, component, version) AS (VALUES ('src1', 'core', '1.2'), ('src1', NULL, '1.0'), ('src2', NULL, '2.0')), r AS (SELECT DISTINCT source_name, CASE n % 2 WHEN 0 THEN 'core' ELSE 'ui' END AS component FROM docs)
SELECT r.source_name, r.component, coalesce(v.version, w.version) AS version FROM r LEFT JOIN v ON v.source_name = r.source_name AND v.component = r.component LEFT JOIN v w ON w.source_name = r.source_name AND w.component IS NULL""")
def j16(spark, d):
    v = spark.createDataFrame([("src1", "core", "1.2"), ("src1", None, "1.0"), ("src2", None, "2.0")], "source_name string, component string, version string")
    req = kb(spark, d, "docs").select("source_name", F.when(F.col("n") % 2 == 0, "core").otherwise("ui").alias("component")).distinct()
    return J.component_fallback(req, v)
