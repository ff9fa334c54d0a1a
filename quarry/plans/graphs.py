"""Queries over the document graph and the symbol graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.functions.text import confidence_rank
from quarry.operators import graph as G
from quarry.plans.tables import kb, line_tasks

_RANK = "CASE confidence WHEN 'exact' THEN 3 WHEN 'resolved' THEN 2 WHEN 'derived' THEN 1 WHEN 'recovered' THEN 0 ELSE -1 END"
_FILES = "(SELECT 'src/m' || CAST(n % 50 AS VARCHAR) || '.py' AS path, 'import lib.f' || CAST(n % 13 AS VARCHAR) || chr(10) || 'from src.m' || CAST(n % 7 AS VARCHAR) || '.inner import x' AS text FROM docs)"


@query("g01_import_edges", f"""WITH f AS {_FILES}, m AS (SELECT 'lib.f' || i AS module, 'lib/F_' || i || '.py' AS path FROM range(13) t(i) UNION ALL SELECT 'src.m' || i, 'src/m' || i || '.py' FROM range(50) t(i)),
n AS (SELECT path, unnest(list_distinct(regexp_extract_all(text, '(?m)^\\s*(?:from|import)\\s+([A-Za-z0-9_.]+)', 1))) AS module FROM f), x AS (SELECT n.path AS s, m.path AS t FROM n JOIN m USING (module)
UNION ALL SELECT n.path, m.path FROM n JOIN m ON m.module = regexp_replace(n.module, '[.][^.]+$', '') WHERE n.module NOT IN (SELECT module FROM m))
SELECT DISTINCT s AS source_id, t AS target_id, 'import' AS edge_type, 1.0::DOUBLE AS weight FROM x WHERE s <> t""")
def g01(spark, d):
    files = kb(spark, d, "docs").select(
        F.concat(F.lit("src/m"), F.col("n") % 50, F.lit(".py")).alias("path"),
        F.concat(F.lit("import lib.f"), F.col("n") % 13, F.lit("\nfrom src.m"), F.col("n") % 7, F.lit(".inner import x")).alias("text"),
    )
    lib, src = spark.range(13).select(F.concat(F.lit("lib.f"), "id").alias("module"), F.concat(F.lit("lib/F_"), "id", F.lit(".py")).alias("path")), spark.range(50)
    return G.import_edges(files, lib.unionByName(src.select(F.concat(F.lit("src.m"), "id").alias("module"), F.concat(F.lit("src/m"), "id", F.lit(".py")).alias("path"))))


@query("g01_build_graph", """SELECT id AS source_id, unnest(files) AS target_id, 'documents' AS edge_type, 1.0::DOUBLE AS weight FROM docs
UNION SELECT cluster_id, element_id, 'topic_member', 0.8::DOUBLE FROM theme_members""")
def g01b(spark, d):
    return G.document_edges(kb(spark, d, "docs")).unionByName(G.topic_edges(kb(spark, d, "theme_members")))


@query("g02_call_file_edges", """SELECT DISTINCT a.file AS source_id, b.file AS target_id, 'call' AS edge_type, 1.0::DOUBLE AS weight FROM sym_edges e JOIN symbols a ON a.id = caller JOIN symbols b ON b.id = callee
WHERE edge_type = 'call' AND a.file <> b.file""")
def g02(spark, d):
    return G.call_file_edges(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"))


@query("g03_update_files", """SELECT * FROM doc_graph WHERE edge_type <> 'import' OR source_id <> 'src/m1.py' UNION ALL SELECT 'src/m1.py', 'lib/new.py', 'import', 1.0""")
def g03(spark, d):
    new = spark.createDataFrame([("src/m1.py", "lib/new.py", "import", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    return G.update_for_files(kb(spark, d, "doc_graph"), new.select(F.col("source_id").alias("path")), new)


@query("g04_graph_stats", "SELECT edge_type, count(*) AS edges, count(DISTINCT source_id) AS sources, count(DISTINCT target_id) AS targets FROM doc_graph GROUP BY edge_type")
def g04(spark, d):
    return G.graph_stats(kb(spark, d, "doc_graph"))


@query("g05_priorities", """WITH dg AS (SELECT f AS file, count(*) AS degree FROM (SELECT source_id AS f FROM doc_graph WHERE edge_type = 'import' UNION ALL SELECT target_id FROM doc_graph WHERE edge_type = 'import') GROUP BY f),
c AS (SELECT target_id AS file, count(*) AS docs FROM doc_graph WHERE edge_type = 'documents' AND source_id LIKE '%7' GROUP BY 1)
SELECT file, degree, coalesce(docs, 0) AS docs, round(degree * (1 - least(coalesce(docs, 0)::DOUBLE / 2, 1)), 6) AS priority FROM dg LEFT JOIN c USING (file)""")
def g05(spark, d):
    return G.priorities(kb(spark, d, "doc_graph").where("edge_type <> 'documents' or source_id like '%7'"))


@query("g06_related_2hop", """WITH u AS (SELECT a, b, min(c) AS c FROM (SELECT source_id AS a, target_id AS b, CASE WHEN weight > 0 THEN 1 / weight ELSE 10 END AS c FROM doc_graph
UNION ALL SELECT target_id, source_id, CASE WHEN weight > 0 THEN 1 / weight ELSE 10 END FROM doc_graph) GROUP BY a, b), s AS (SELECT id FROM docs WHERE n IN (3, 10, 42)),
p AS (SELECT s.id AS seed, b AS node, c FROM s JOIN u ON a = s.id), q AS (SELECT seed, node, c FROM p UNION ALL SELECT p.seed, u.b, p.c + u.c FROM p JOIN u ON u.a = p.node)
SELECT seed, node AS id, round(min(c), 6) AS distance FROM q WHERE node <> seed AND node IN (SELECT id FROM docs) GROUP BY seed, node""")
def g06(spark, d):
    docs = kb(spark, d, "docs")
    return G.related(kb(spark, d, "doc_graph"), docs.where("n in (3, 10, 42)").select("id"), docs, 2)


@query("g08_contains_edges", "SELECT DISTINCT p.id AS caller, c.id AS callee FROM symbols c JOIN symbols p ON p.qname = c.parent AND p.source_name = c.source_name")
def g08(spark, d):
    return G.contains_edges(kb(spark, d, "symbols"))


_MON = "(SELECT id, CASE n % 4 WHEN 0 THEN 'local ' || n WHEN 1 THEN 'py pip m 1 `a.b`/C' || n || '#run().' WHEN 2 THEN 'py pip m 1 `a.b`/C' || n || '#' ELSE 'py pip m 1 x/y' || n || '.' END AS m FROM docs)"


def _monikers(spark, d):
    n = F.col("n").cast("string")
    m = F.when(F.col("n") % 4 == 0, F.concat(F.lit("local "), n)).when(F.col("n") % 4 == 1, F.concat(F.lit("py pip m 1 `a.b`/C"), n, F.lit("#run().")))
    m = m.when(F.col("n") % 4 == 2, F.concat(F.lit("py pip m 1 `a.b`/C"), n, F.lit("#"))).otherwise(F.concat(F.lit("py pip m 1 x/y"), n, F.lit(".")))
    return kb(spark, d, "docs").select("id", m.alias("m"))


@query("g09_classify_edge", f"SELECT id, CASE WHEN starts_with(m, 'local ') THEN 'type_ref' WHEN ends_with(m, ').') THEN 'call' WHEN ends_with(m, '#') OR ends_with(m, '.') THEN 'type_ref' ELSE 'call' END AS edge_type FROM {_MON}")
def g09(spark, d):
    return _monikers(spark, d).select("id", G.classify_edge(F.col("m")).alias("edge_type"))


@query("g10_descriptors", f"""SELECT id, CASE WHEN m LIKE 'local %' THEN '' WHEN m LIKE '%run().' THEN 'a.b.' || regexp_extract(m, '(C[0-9]+)', 1) || '.run' WHEN m LIKE '%#' THEN 'a.b.' || regexp_extract(m, '(C[0-9]+)', 1)
ELSE 'x.' || regexp_extract(m, '(y[0-9]+)', 1) END AS qname FROM {_MON}""")
def g10(spark, d):
    return _monikers(spark, d).select("id", G.descriptor_name(F.col("m")).alias("qname"))


@query("g11_resolve_external", """WITH e AS (SELECT caller, CASE WHEN line % 5 = 0 THEN 'm.Order' || substr(callee, 2) ELSE callee END AS callee, confidence FROM sym_edges WHERE edge_type <> 'contains'),
o AS (SELECT qname, min(id) AS t FROM symbols GROUP BY qname HAVING count(*) = 1)
SELECT caller, callee, confidence FROM e WHERE callee IN (SELECT id FROM symbols) UNION ALL SELECT caller, t, 'resolved' FROM e JOIN o ON o.qname = e.callee WHERE callee NOT IN (SELECT id FROM symbols)""")
def g11(spark, d):
    e = kb(spark, d, "sym_edges").where("edge_type <> 'contains'")
    e = e.select("caller", F.when(F.col("line") % 5 == 0, F.concat(F.lit("m.Order"), F.substring("callee", 2, 20))).otherwise(F.col("callee")).alias("callee"), "confidence")
    return G.resolve_external(e, kb(spark, d, "symbols"))


@query("g12_loaded", "WITH s AS MATERIALIZED (SELECT DISTINCT id FROM symbols) SELECT e.* FROM sym_edges e SEMI JOIN s a ON a.id = e.caller SEMI JOIN s b ON b.id = e.callee")
def g12(spark, d):
    return G.loaded(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"))


@query("g13_callers", "SELECT DISTINCT callee AS id, caller AS other, edge_type FROM sym_edges WHERE edge_type <> 'contains' AND callee IN (SELECT id FROM symbols WHERE name = 'Order25')")
def g13(spark, d):
    return G.neighbours(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("name = 'Order25'"), True)


@query("g13_callees", "SELECT DISTINCT caller AS id, callee AS other, edge_type FROM sym_edges WHERE edge_type <> 'contains' AND caller IN (SELECT id FROM symbols WHERE name = 'Order25')")
def g13b(spark, d):
    return G.neighbours(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("name = 'Order25'"), False)


@query("g14_by_source", "SELECT a.source_name AS from_source, b.source_name AS to_source, edge_type, count(*) AS edges FROM sym_edges e JOIN symbols a ON a.id = caller JOIN symbols b ON b.id = callee GROUP BY 1, 2, 3")
def g14(spark, d):
    return G.by_source(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"))


@query("g15_dead_symbols", "SELECT id FROM symbols WHERE id NOT IN (SELECT callee FROM sym_edges WHERE edge_type <> 'contains')")
def g15(spark, d):
    return G.dead_symbols(kb(spark, d, "symbols"), kb(spark, d, "sym_edges"))


_REACH = """SELECT callee, count(*) AS sites, count(DISTINCT a.source_name) AS sources, min(e.file) AS first_file FROM sym_edges e JOIN symbols a ON a.id = caller JOIN symbols b ON b.id = callee
WHERE edge_type <> 'contains' AND b.source_name = 's1' AND a.source_name <> 's1' GROUP BY callee"""


@query("g16_reach_into", _REACH)
def g16(spark, d):
    return G.reach_into(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"), "s1")


@query("g17_reach_findings", f"WITH r AS ({_REACH}), f AS (SELECT 'pkg' || (n % 7) || '/f' || (n % 100) || '.py' AS file, count(*) AS docs FROM docs GROUP BY 1) SELECT callee, sites, coalesce(docs, 0) AS docs FROM r JOIN symbols s ON s.id = callee LEFT JOIN f ON f.file = s.file")
def g17(spark, d):
    docs = kb(spark, d, "docs").select("id", F.array(F.concat(F.lit("pkg"), F.col("n") % 7, F.lit("/f"), F.col("n") % 100, F.lit(".py"))).alias("files"))
    s = kb(spark, d, "symbols")
    return G.reach_findings(G.reach_into(kb(spark, d, "sym_edges"), s, "s1"), s, docs)


_BFS = """WITH RECURSIVE e AS (SELECT DISTINCT caller, callee FROM sym_edges WHERE edge_type <> 'contains'), r(id, hop) AS (SELECT 'o1', 0 UNION SELECT 'o1001', 0 UNION SELECT {nxt}, hop + 1 FROM r JOIN e ON {at} = id WHERE hop < {depth})"""


@query("g18_impact_bfs", _BFS.format(nxt="caller", at="callee", depth=3) + " SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id")
def g18(spark, d):
    return G.impact(kb(spark, d, "sym_edges"), spark.createDataFrame([("o1",), ("o1001",)], "id string"), 3)


@query("g19_file_impact", """WITH RECURSIVE h AS (SELECT DISTINCT b.file AS to_file, e.file FROM sym_edges e JOIN symbols b ON b.id = callee WHERE edge_type <> 'contains' AND e.file <> b.file),
r(file, hop) AS (SELECT 'pkg1/f1.py', 0 UNION SELECT h.file, hop + 1 FROM r JOIN h ON h.to_file = r.file WHERE hop < 2)
SELECT file, min(hop)::INTEGER AS hop, regexp_matches(file, '(^|/)tests?/|test_') AS is_test FROM r GROUP BY file HAVING min(hop) > 0""")
def g19(spark, d):
    return G.file_impact(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"), "pkg1/f1.py", 2)


@query("g20_caller_tree", """WITH RECURSIVE e AS (SELECT DISTINCT caller, callee FROM sym_edges WHERE edge_type = 'call'), r(id, path, h) AS (SELECT 'o1', list_value('o1'), 0
UNION ALL SELECT caller, list_append(path, caller), h + 1 FROM r JOIN e ON callee = id WHERE h < 2 AND NOT list_contains(path, caller)) SELECT id, array_to_string(path, ' < ') AS path FROM r""")
def g20(spark, d):
    return G.trees(kb(spark, d, "sym_edges"), "o1", 2)


_TIERS = "(SELECT DISTINCT caller AS source, callee AS target, CASE edge_type WHEN 'call' THEN 0 WHEN 'implements' THEN 1 ELSE 2 END AS tier FROM sym_edges WHERE edge_type <> 'contains')"


@query("g21_tier_cascade", f"""WITH RECURSIVE t AS {_TIERS}, g AS (SELECT source, target FROM t WHERE tier = (SELECT min(tier) FROM t x WHERE x.source = t.source)),
r(id, hop) AS (SELECT 'o5', 0 UNION SELECT target, hop + 1 FROM r JOIN g ON source = id WHERE hop < 4) SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id""".replace("(SELECT min(tier) FROM t x WHERE x.source = t.source)", "mt").replace("FROM t WHERE tier = mt", "FROM (SELECT *, min(tier) OVER (PARTITION BY source) AS mt FROM t) WHERE tier = mt"))
def g21(spark, d):
    e = kb(spark, d, "sym_edges").where("edge_type <> 'contains'")
    tiers = e.select(F.col("caller").alias("source"), F.col("callee").alias("target"), F.when(F.col("edge_type") == "call", 0).when(F.col("edge_type") == "implements", 1).otherwise(2).alias("tier"))
    return G.trace_flow(tiers, spark.createDataFrame([("o5",)], "id string"), 4)


@query("g22_activation_spans", """WITH m AS (SELECT id % 50 AS flow, id AS pos, CASE WHEN id % 3 = 0 THEN 'return' ELSE 'call' END AS kind, tool_name AS target FROM usage),
s AS (SELECT *, sum(CASE kind WHEN 'call' THEN 1 ELSE -1 END) OVER (PARTITION BY flow ORDER BY pos) AS s FROM m), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY flow ORDER BY pos)) AS depth FROM s)
SELECT flow, target, pos AS start, coalesce((SELECT min(b.pos) FROM d b WHERE b.flow = a.flow AND b.pos > a.pos AND b.depth < a.depth), (SELECT max(pos) FROM d b WHERE b.flow = a.flow)) AS "end" FROM d a WHERE kind = 'call'""")
def g22(spark, d):
    m = kb(spark, d, "usage").select((F.col("id") % 50).alias("flow"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "return").otherwise("call").alias("kind"), F.col("tool_name").alias("target"))
    return G.activation_spans(m)


@query("g23_data_layer", f"SELECT caller, callee, edge_type FROM sym_edges UNION ALL SELECT DISTINCT consumer, schema_id, role FROM data_access WHERE {_RANK} >= 2")
def g23(spark, d):
    return G.data_layer(kb(spark, d, "sym_edges"), kb(spark, d, "data_access"), confidence_rank(F.col("confidence")) >= 2)


@query("g24_members", "SELECT id, 0 AS hop FROM symbols WHERE name = 'Order25' UNION ALL SELECT c.id, 1 FROM symbols c JOIN symbols p ON c.parent = p.qname WHERE p.name = 'Order25'")
def g24(spark, d):
    s = kb(spark, d, "symbols")
    return G.members(s, s.where("name = 'Order25'").select("id"))


@query("g25_fan_in", "SELECT s.id, count(e.callee) AS fan_in FROM symbols s LEFT JOIN sym_edges e ON e.callee = s.id AND e.edge_type = 'call' WHERE s.kind = 'class' GROUP BY s.id")
def g25(spark, d):
    return G.fan_in(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("kind = 'class'").select("id"))


@query("g26_body_edges", """SELECT caller, callee, edge_type, line, row_number() OVER (PARTITION BY caller ORDER BY line, callee, edge_type)::INTEGER AS pos FROM sym_edges
WHERE edge_type IN ('call', 'type_ref') AND callee NOT LIKE 'local %' AND caller IN (SELECT id FROM symbols WHERE source_name = 's2')""")
def g26(spark, d):
    return G.body_edges(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("source_name = 's2'").select("id"))


@query("g27_implementors", "SELECT DISTINCT callee, caller FROM sym_edges WHERE edge_type = 'implements' AND callee IN (SELECT id FROM symbols WHERE source_name = 's0')")
def g27(spark, d):
    return G.implementors(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("source_name = 's0'").select("id"))


@query("g28_chain", """WITH RECURSIVE e AS (SELECT DISTINCT caller, callee FROM sym_edges WHERE edge_type IN ('call', 'implements')), w AS (SELECT callee AS id FROM e GROUP BY callee HAVING count(*) >= 16),
g AS (SELECT * FROM e WHERE caller NOT IN (SELECT id FROM w)), r(id, hop) AS (SELECT 'o5', 0 UNION SELECT 'o9', 0 UNION SELECT callee, hop + 1 FROM r JOIN g ON caller = r.id WHERE hop < 3), m AS (SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id)
SELECT id, hop, CASE WHEN id IN (SELECT id FROM w) THEN 'plumbing' WHEN id NOT IN (SELECT caller FROM e) THEN 'leaf' WHEN hop = 3 THEN 'depth' ELSE 'descended' END AS reason FROM m""")
def g28(spark, d):
    return G.chain(kb(spark, d, "sym_edges"), spark.createDataFrame([("o5",), ("o9",)], "id string"), 3)


@query("g28_walk")
def g28w(spark, d):
    return G.chain_walk(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"), spark.createDataFrame([("o5",), ("o9",)], "id string"), 3)


@query("g29_fan_out_packages", """SELECT callee, split_part(s.file, '/', 1) AS package, count(DISTINCT caller) AS n, count(*) FILTER (s.file LIKE '%test%') AS tests FROM sym_edges e JOIN symbols s ON s.id = caller WHERE edge_type = 'implements' GROUP BY 1, 2""")
def g29(spark, d):
    return G.fan_out_by_package(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"))


@query("g30_caller_roots", """WITH RECURSIVE e AS (SELECT caller, callee, file, line FROM sym_edges WHERE edge_type = 'call'), w AS (SELECT callee FROM e GROUP BY callee HAVING count(DISTINCT caller) >= 16), g AS (SELECT * FROM e WHERE callee NOT IN (SELECT callee FROM w)),
r(id, hop) AS (SELECT 'o1', 0 UNION SELECT 'o101', 0 UNION SELECT caller, hop + 1 FROM r JOIN g ON callee = id WHERE hop < 2), m AS (SELECT id, min(hop)::INTEGER AS hop FROM r GROUP BY id HAVING min(hop) > 0),
s AS (SELECT caller AS id, file, line FROM (SELECT *, row_number() OVER (PARTITION BY caller ORDER BY file, line) AS k FROM e) WHERE k = 1) SELECT id, hop, file, line FROM m JOIN s USING (id)""")
def g30(spark, d):
    return G.caller_roots(kb(spark, d, "sym_edges"), spark.createDataFrame([("o1",), ("o101",)], "id string"), 2)


_FAN = """WITH o AS (SELECT {at} AS root, {other} AS target, edge_type, min((file, line)) AS site, CASE edge_type WHEN 'call' THEN 0 WHEN 'implements' THEN 1 ELSE 2 END AS kind FROM sym_edges
WHERE edge_type <> 'contains' AND {at} IN (SELECT id FROM symbols WHERE name IN ('Order25', 'Order5')) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY kind, site, target) AS r FROM o)
SELECT root, target, edge_type, r::INTEGER AS r, struct_extract_at(site, 1) AS file, struct_extract_at(site, 2) AS line FROM r WHERE r <= 4 ORDER BY r, kind, site, target, root LIMIT 24"""


@query("g31_call_fanout", _FAN.format(at="caller", other="callee"))
def g31(spark, d):
    return G.bounded_fanout(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("name in ('Order25', 'Order5')").select("id"), 4, 24)


@query("g31_caller_fanout", _FAN.format(at="callee", other="caller"))
def g31b(spark, d):
    return G.bounded_fanout(kb(spark, d, "sym_edges"), kb(spark, d, "symbols").where("name in ('Order25', 'Order5')").select("id"), 4, 24, incoming=True)


@query("g32_route_citations", """WITH p AS (SELECT id, 0 AS pos, 'o' || CAST(n * 4 + 1 AS VARCHAR) AS a, 'l' || CAST(n * 4 + 1 AS VARCHAR) || '_1' AS b FROM docs UNION ALL SELECT id, 1, 'l' || CAST(n * 4 + 1 AS VARCHAR) || '_1', 'o' || CAST(n AS VARCHAR) FROM docs),
e AS (SELECT caller AS a, callee AS b, min(edge_type) AS edge_type FROM sym_edges GROUP BY 1, 2) SELECT id, pos, a, b, edge_type FROM p JOIN e USING (a, b)""")
def g32(spark, d):
    o, k = F.concat(F.lit("o"), F.col("n") * 4 + 1), F.concat(F.lit("l"), F.col("n") * 4 + 1, F.lit("_1"))
    return G.route_citations(kb(spark, d, "docs").select("id", F.array(o, k, F.concat(F.lit("o"), "n")).alias("route")), kb(spark, d, "sym_edges"), line_tasks(spark, d))


@query("g33_seeds_in_files", "SELECT id, file, r FROM (SELECT id, file, row_number() OVER (PARTITION BY file ORDER BY line_start, id)::INTEGER AS r FROM symbols WHERE file LIKE 'pkg1/%') WHERE r <= 3")
def g33(spark, d):
    s = kb(spark, d, "symbols")
    return G.seeds_in_files(s, s.where("file like 'pkg1/%'").select("file").distinct(), 3)


@query("g34_reference_bridges", "SELECT callee, count(DISTINCT caller) AS callers, count(DISTINCT caller) > 8 AS gated FROM sym_edges WHERE edge_type = 'type_ref' GROUP BY callee HAVING count(DISTINCT caller) >= 2")
def g34(spark, d):
    return G.reference_bridges(kb(spark, d, "sym_edges"))


_LEVEL = """SELECT obligation, "to" AS id, {k}::INTEGER AS level, r FROM (SELECT *, row_number() OVER (PARTITION BY obligation ORDER BY kind, site, "to")::INTEGER AS r
FROM (SELECT obligation, "to", kind, min(site) AS site FROM (SELECT DISTINCT obligation, id FROM {f}) f JOIN b ON b.node = f.id GROUP BY 1, 2, 3)) WHERE r <= 5"""


@query("g35_obligation_closure", f"""WITH x AS (SELECT caller AS node, callee AS "to", edge_type, file, line FROM sym_edges WHERE edge_type IN ('call', 'type_ref')),
b AS MATERIALIZED (SELECT node, "to", min((file, line)) AS site, CASE edge_type WHEN 'call' THEN 0 ELSE 1 END AS kind FROM (SELECT * FROM x UNION ALL SELECT "to", node, edge_type, file, line FROM x) GROUP BY node, "to", edge_type),
s AS (SELECT name AS obligation, id FROM symbols WHERE name IN ('Order25', 'Order5') AND kind = 'class'), l1 AS MATERIALIZED ({_LEVEL.format(k=1, f='s')}) SELECT * FROM l1 UNION ALL {_LEVEL.format(k=2, f='l1')}""")
def g35(spark, d):
    seeds = kb(spark, d, "symbols").where("name in ('Order25', 'Order5') and kind = 'class'").select(F.col("name").alias("obligation"), "id")
    return G.obligation_closure(kb(spark, d, "sym_edges"), seeds)


@query("g36_family_cards", """WITH r AS (SELECT id, n % 97 AS rank, 'g' || (n % 5) AS grp, 'm' || (n % 11) AS module, 'w' || (n % 13) AS owner, 'x' || (n % 17) AS origin FROM docs),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY module, owner ORDER BY rank, id) <= 3), b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY grp, origin ORDER BY rank, id) <= 2)
SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rank, id) <= 10""")
def g36(spark, d):
    m = lambda p, k: F.concat(F.lit(p), F.col("n") % k)
    return G.family_cards(kb(spark, d, "docs").select("id", (F.col("n") % 97).alias("rank"), m("g", 5).alias("grp"), m("m", 11).alias("module"), m("w", 13).alias("owner"), m("x", 17).alias("origin")))


@query("g37_components", """WITH RECURSIVE e AS (SELECT id AS a, supersedes AS b FROM docs WHERE supersedes IS NOT NULL UNION SELECT 'd' || n, 'd' || (n + 6) FROM docs WHERE n % 30 < 18 AND n % 6 = 1), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, x) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.x) SELECT node, min(x) AS component FROM r GROUP BY node""")
def g37(spark, d):
    docs = kb(spark, d, "docs")
    e = docs.where("supersedes is not null").select(F.col("id").alias("a"), F.col("supersedes").alias("b"))
    return G.weak_components(e.unionByName(docs.where("n % 30 < 18 and n % 6 = 1").select(F.col("id").alias("a"), F.concat(F.lit("d"), F.col("n") + 6).alias("b"))))


@query("g38_document_routes", """WITH ro AS (SELECT 'r' || n AS route, files[2] AS file, n % 7 AS depth FROM docs), j AS (SELECT DISTINCT id AS doc, route, depth FROM (SELECT id, unnest(files) AS file FROM docs) JOIN ro USING (file))
SELECT doc, route, depth, r FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY depth, route)::INTEGER AS r FROM j) WHERE r <= 3""")
def g38(spark, d):
    docs = kb(spark, d, "docs")
    routes = docs.select(F.concat(F.lit("r"), "n").alias("route"), F.element_at("files", 2).alias("file"), (F.col("n") % 7).alias("depth"))
    return G.document_routes(docs, routes, 3)


@query("g39_bundle", """WITH h AS (SELECT 'h' || (n % 20) AS hop, files[2] AS file FROM docs), f AS (SELECT id, unnest(files) AS file FROM docs)
SELECT cluster_id, count(DISTINCT hop) AS hops, count(DISTINCT f.id) AS docs FROM h LEFT JOIN f USING (file) LEFT JOIN theme_members t ON t.element_id = f.id GROUP BY cluster_id""")
def g39(spark, d):
    docs = kb(spark, d, "docs")
    hops = docs.select(F.concat(F.lit("h"), F.col("n") % 20).alias("hop"), F.element_at("files", 2).alias("file"))
    return G.bundle(hops, docs, kb(spark, d, "theme_members"))


@query("g40_suggest_topics", """WITH n AS (SELECT DISTINCT x AS n FROM (SELECT source_id AS x FROM doc_graph UNION SELECT target_id FROM doc_graph) WHERE x LIKE '%.py' AND x LIKE '%/%'), s AS (SELECT regexp_replace(n, '/[^/]+$', '') AS dir, count(*) AS files FROM n GROUP BY 1 HAVING count(*) >= 3),
i AS (SELECT regexp_replace(source_id, '/[^/]+$', '') AS dir, 2 * count(*) AS e FROM doc_graph WHERE edge_type = 'import' AND regexp_replace(source_id, '/[^/]+$', '') = regexp_replace(target_id, '/[^/]+$', '') GROUP BY 1)
SELECT dir, files, coalesce(e, 0) AS inner_edges FROM s LEFT JOIN i USING (dir) ORDER BY files DESC, dir LIMIT 10""")
def g40(spark, d):
    return G.suggest_topics(kb(spark, d, "doc_graph"), spark.createDataFrame([], "id string"))


@query("g41_coupling", """WITH e AS (SELECT string_split(source_id, '/')[-1] AS x, string_split(target_id, '/')[-1] AS y FROM doc_graph) SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n, count(DISTINCT x) > 1 AS both_ways
FROM e WHERE x <> y GROUP BY 1, 2 ORDER BY n DESC, a, b LIMIT 20""")
def g41(spark, d):
    return G.coupling(kb(spark, d, "doc_graph"))


@query("g42_compare_files", """SELECT 'shared_import' AS kind, target_id AS id FROM (SELECT target_id FROM doc_graph WHERE source_id = 'src/m1.py' AND edge_type = 'import' INTERSECT SELECT target_id FROM doc_graph WHERE source_id = 'src/m2.py' AND edge_type = 'import')
UNION ALL SELECT 'edge', source_id FROM doc_graph WHERE (source_id = 'src/m1.py' AND target_id = 'src/m2.py') OR (source_id = 'src/m2.py' AND target_id = 'src/m1.py')""")
def g42(spark, d):
    return G.compare_files(kb(spark, d, "doc_graph"), "src/m1.py", "src/m2.py")


@query("g43_neighbours", "SELECT edge_type, 'out' AS way, target_id AS id FROM doc_graph WHERE source_id = 'd8' UNION ALL SELECT edge_type, 'in', source_id FROM doc_graph WHERE target_id = 'd8'")
def g43(spark, d):
    return G.neighbours_by_type(kb(spark, d, "doc_graph"), "d8")


@query("g44_consumed_files", """WITH j AS (SELECT b.file AS own, e.file, e.line, callee FROM sym_edges e JOIN symbols b ON b.id = callee AND b.source_name = 's1' JOIN symbols a ON a.id = caller AND a.source_name <> 's1' WHERE edge_type <> 'contains'),
r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY file, line, callee) AS r FROM j) SELECT own AS file, count(*) AS uses, string_agg(CASE WHEN r <= 5 THEN file || ':' || line END, ',' ORDER BY file || ':' || line) AS sites FROM r GROUP BY own""")
def g44(spark, d):
    return G.consumed_files(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"), "s1")


@query("g45_wiring", """SELECT * FROM (SELECT count(*) FILTER (regexp_matches(id, '^local [0-9]+$')) AS bare_locals, count(*) FILTER (line_end > line_start) AS multi_line, count(*) AS symbols FROM symbols),
(SELECT count(*) FILTER (edge_type = 'implements') AS implements, count(*) FILTER (callee LIKE 'local %') AS local_callees FROM sym_edges)""")
def g45(spark, d):
    return G.wiring_invariants(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"))


@query("g46_stale_files", """SELECT source_name, files[1] AS file FROM docs LEFT JOIN (SELECT source_name, max(updated_at) - INTERVAL 100 HOUR AS built FROM docs WHERE source_name <> 'src3' GROUP BY 1) i USING (source_name) WHERE built IS NULL OR updated_at > built""")
def g46(spark, d):
    docs = kb(spark, d, "docs")
    index = docs.where("source_name <> 'src3'").groupBy("source_name").agg((F.max("updated_at") - F.expr("interval 100 hours")).alias("indexed_at"))
    return G.stale_files(docs.select("source_name", F.element_at("files", 1).alias("file"), F.col("updated_at").alias("changed_at")), index)


@query("g47_dangling_links", "SELECT DISTINCT id AS doc, 'm.Order' || CAST(n * 3 AS VARCHAR) AS target FROM docs WHERE 'm.Order' || CAST(n * 3 AS VARCHAR) NOT IN (SELECT qname FROM symbols)")
def g47(spark, d):
    links = kb(spark, d, "docs").select(F.col("id").alias("doc"), F.concat(F.lit("m.Order"), F.col("n") * 3).alias("target"))
    return G.dangling_links(links, kb(spark, d, "symbols"))
