"""Queries over filters, lineage and code facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.functions.text import camel_tokens, confidence_rank, version_at_most
from quarry.operators import facts as L
from quarry.operators import filters as X
from quarry.plans.tables import kb

_RANK = "CASE confidence WHEN 'exact' THEN 3 WHEN 'resolved' THEN 2 WHEN 'derived' THEN 1 WHEN 'recovered' THEN 0 ELSE -1 END"


@query("f01_branch", "SELECT id FROM docs WHERE status = 'stable' OR branches[1] = 'feature/3'")
def f01(spark, d):
    return X.for_branch(kb(spark, d, "docs"), "feature/3").select("id")


@query("f01_branch_glob", "SELECT id FROM docs WHERE status = 'stable' OR branches[2] = 'rel-*'")
def f01b(spark, d):
    return X.for_branch(kb(spark, d, "docs"), "rel-7.2").select("id")


@query("f02_feature", "SELECT id FROM docs WHERE contains(lower(feature), 'port') OR contains(lower(aliases[1]), 'port') OR contains(lower(aliases[2]), 'port')")
def f02(spark, d):
    return X.for_feature(kb(spark, d, "docs"), "PORT").select("id")


@query("f03_role", "SELECT id FROM docs WHERE content_type <> 'de' OR (feature = 'Billing' AND source_name = 'src4')")
def f03(spark, d):
    docs = kb(spark, d, "docs").select("id", F.when(F.col("content_type") == "de", "audience_response").otherwise(F.col("content_type")).alias("content_type"), F.col("feature").alias("audience"), F.col("source_name").alias("fingerprint"))
    return X.for_role(docs, "Billing", "src4").select("id")


@query("f04_paths", "SELECT id FROM docs WHERE len(list_filter(files, lambda f: contains(f, 'src/src4/m1') OR contains('src/src4/m1', f))) > 0")
def f04(spark, d):
    return X.in_paths(kb(spark, d, "docs"), ["src/src4/m1"]).select("id")


@query("f05_closure", "WITH RECURSIVE c(s) AS (SELECT 'n7' UNION SELECT depends_on FROM c JOIN relations ON source_name = s) SELECT s AS source FROM c")
def f05(spark, d):
    return X.closure(kb(spark, d, "relations"), "n7")


@query("f05_reverse_closure", "WITH RECURSIVE c(s) AS (SELECT 'root' UNION SELECT source_name FROM c JOIN relations ON depends_on = s) SELECT s AS source FROM c")
def f05r(spark, d):
    return X.closure(kb(spark, d, "relations"), "root")


_SCOPE = "('src1', 'src2', 'src5')"


@query("f07_share_gate", f"""WITH n AS (SELECT cluster_id, count(*) AS total, count(*) FILTER (source_name IN {_SCOPE}) AS inside FROM theme_members JOIN docs ON docs.id = element_id GROUP BY 1)
SELECT cluster_id FROM themes LEFT JOIN n USING (cluster_id) WHERE CASE WHEN association IS NOT NULL THEN len(list_filter(string_split(association, '|'), lambda s: s NOT IN {_SCOPE})) = 0
ELSE coalesce(inside / total >= 0.1 AND NOT (inside = 1 AND inside / total < 0.5), false) END""")
def f07(spark, d):
    return X.admitted_themes(kb(spark, d, "themes"), kb(spark, d, "theme_members"), kb(spark, d, "docs"), ["src1", "src2", "src5"])


@query("f06_admit", f"SELECT pos, id FROM (SELECT n AS pos, 'd' || (n * 3 + 1) AS id FROM docs) a WHERE id IN (SELECT id FROM docs WHERE source_name IN {_SCOPE})")
def f06(spark, d):
    docs = kb(spark, d, "docs")
    ids = docs.select(F.col("n").alias("pos"), F.concat(F.lit("d"), F.col("n") * 3 + 1).alias("id"))
    return X.admit(ids, docs, kb(spark, d, "themes"), ["src1", "src2", "src5"])


@query("f08_edges_in_scope", "WITH s AS MATERIALIZED (SELECT DISTINCT id FROM symbols WHERE source_name IN ('s0', 's1')) SELECT e.* FROM sym_edges e SEMI JOIN s a ON a.id = e.caller SEMI JOIN s b ON b.id = e.callee")
def f08(spark, d):
    return X.edges_in_scope(kb(spark, d, "sym_edges"), kb(spark, d, "symbols"), ["s0", "s1"])


@query("f09_floor", f"SELECT confidence, count(*) AS n FROM data_access WHERE {_RANK} >= 1 GROUP BY 1")
def f09(spark, d):
    return X.over_floor(kb(spark, d, "data_access"), "derived").groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@query("f10_distinctive", """SELECT id, contains(title, ' ') OR contains(title, '_') OR regexp_matches(title, '[a-z].*[A-Z]|[A-Z].*[a-z].*[A-Z]') AS distinctive,
CASE WHEN contains(title, ' ') THEN 'phrase' WHEN contains(title, '_') OR regexp_matches(title, '[.()]|[a-z][A-Z]') THEN 'api' ELSE 'product' END AS class FROM docs""")
def f10(spark, d):
    t = F.col("title")
    return kb(spark, d, "docs").select("id", X.is_distinctive(t).alias("distinctive"), X.entity_class(t).alias("class"))


@query("f11_surfaces", """SELECT id, array_to_string(list_filter(list_value(CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])(in|on)') THEN 'inward' END, CASE WHEN regexp_matches(title, '(?i)(^|[^A-Za-z0-9])(the|th)') THEN 'thing' END), lambda x: x IS NOT NULL), ',') AS surfaces FROM docs""")
def f11(spark, d):
    return kb(spark, d, "docs").select("id", F.array_join(X.surfaces(F.col("title"), {"inward": ["in", "on"], "thing": ["the", "th"]}), ",").alias("surfaces"))


@query("f12_tiers", "SELECT id, provenance = 'official' AND source_name IN ('src1', 'src2') AS tier2 FROM docs")
def f12(spark, d):
    return X.tiers(kb(spark, d, "docs"), ["src1", "src2"])


@query("f13_expired", "SELECT id FROM docs WHERE n % 3 <> 0 AND updated_at < TIMESTAMP '2024-01-10 00:00:00'")
def f13(spark, d):
    docs = kb(spark, d, "docs").select("id", F.when(F.col("n") % 3 == 0, "not a date").otherwise(F.col("updated_at").cast("string")).alias("expires_at"))
    return X.expired(docs, "2024-01-10 00:00:00").select("id")


@query("f14_gotchas", "SELECT id, encounter_count FROM docs WHERE status <> 'deprecated' AND list_contains(files, 'lib/F_5.py')")
def f14(spark, d):
    return X.gotchas(kb(spark, d, "docs"), ["lib/F_5.py"]).select("id", "encounter_count")


@query("f15_noise", """WITH f AS (SELECT 'a' || n || CASE WHEN n % 9 = 0 THEN '/vendor/x' WHEN n % 7 = 0 THEN '/u' || n || '.min.js' ELSE '/m' || (n % 30) || '.py' END AS file, CASE WHEN n % 9 = 0 THEN 'x' WHEN n % 7 = 0 THEN 'u' || n || '.min.js' ELSE 'm' || (n % 30) || '.py' END AS name FROM docs),
c AS (SELECT name, count(*) AS k FROM f GROUP BY 1) SELECT file, regexp_matches(file, '(^|/)(node_modules|vendor|third_party|dist)/|[.]min[.](js|css)$') OR k > 20 AS noise FROM f JOIN c USING (name)""")
def f15(spark, d):
    n = F.col("n").cast("string")
    tail = F.when(F.col("n") % 9 == 0, "/vendor/x").when(F.col("n") % 7 == 0, F.concat(F.lit("/u"), n, F.lit(".min.js"))).otherwise(F.concat(F.lit("/m"), (F.col("n") % 30).cast("string"), F.lit(".py")))
    f = kb(spark, d, "docs").select(F.concat(F.lit("a"), n, tail).alias("file"))
    return X.catalogue_noise(f.withColumn("name", F.element_at(F.split("file", "/"), -1)), 20)


@query("f16_production", "SELECT file, NOT regexp_matches(file, '/(test|tests|benchmark|benchmarks|target|generated)/') AS production FROM (SELECT DISTINCT CASE n % 4 WHEN 0 THEN 'a/tests/' WHEN 1 THEN 'a/target/' ELSE 'a/src/' END || n AS file FROM docs)")
def f16(spark, d):
    f = kb(spark, d, "docs").select(F.concat(F.when(F.col("n") % 4 == 0, "a/tests/").when(F.col("n") % 4 == 1, "a/target/").otherwise("a/src/"), "n").alias("file")).distinct()
    return f.select("file", X.is_production(F.col("file")).alias("production"))


@query("n01_page_total", "SELECT id, content_type, (SELECT count(*) FROM docs WHERE content_type IN ('de', 'fr')) AS total FROM docs WHERE content_type IN ('de', 'fr') ORDER BY content_type, id LIMIT 10 OFFSET 20")
def n01(spark, d):
    return X.page(kb(spark, d, "docs").where("content_type in ('de', 'fr')").select("id", "content_type"), ["content_type", "id"], 10, 20)


@query("n02_first_per_key", "SELECT source_name, arg_min(id, (updated_at, id)) AS id FROM docs GROUP BY 1")
def n02(spark, d):
    return X.keep_first(kb(spark, d, "docs"), ["source_name"], ["updated_at", "id"]).select("source_name", "id")


@query("n03_lead", "SELECT event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events")
def n03(spark, d):
    from pyspark.sql import Window

    from quarry.session import table

    return table(spark, d, "events").select("event_id", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next_ts"))


@query("n04_rank_scores", "SELECT id, round((count(*) OVER () - (row_number() OVER (ORDER BY length(content) DESC, id) - 1)) / count(*) OVER (), 6) AS rank_score FROM docs WHERE content_type = 'es'")
def n04(spark, d):
    return X.rank_scores(kb(spark, d, "docs").where("content_type = 'es'"), [F.desc(F.length("content")), F.col("id")]).select("id", "rank_score")


@query("n05_keep_first", "SELECT file, line, callee FROM (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY callee, caller, edge_type) AS r FROM sym_edges) WHERE r = 1")
def n05(spark, d):
    return X.keep_first(kb(spark, d, "sym_edges"), ["file", "line"], ["callee", "caller", "edge_type"]).select("file", "line", "callee")


@query("n06_most_common", "SELECT feature, count(*) AS n FROM docs GROUP BY 1 ORDER BY n DESC, feature LIMIT 2")
def n06(spark, d):
    return kb(spark, d, "docs").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "feature").limit(2)


@query("n08_union_distinct", "SELECT target_id AS id, weight FROM doc_graph WHERE source_id = 'd8' UNION SELECT source_id, weight FROM doc_graph WHERE target_id = 'd8'")
def n08(spark, d):
    g = kb(spark, d, "doc_graph")
    return g.where("source_id = 'd8'").select(F.col("target_id").alias("id"), "weight").union(g.where("target_id = 'd8'").select("source_id", "weight")).distinct()


@query("n09_union_all", "SELECT source_id AS id FROM doc_graph UNION ALL SELECT target_id FROM doc_graph")
def n09(spark, d):
    g = kb(spark, d, "doc_graph")
    return g.select(F.col("source_id").alias("id")).union(g.select("target_id"))


@query("n10_set_algebra", "(SELECT id FROM docs WHERE status = 'stable' INTERSECT SELECT id FROM docs WHERE content_type = 'en') EXCEPT SELECT 'd' || id FROM vecs")
def n10(spark, d):
    docs = kb(spark, d, "docs")
    return docs.where("status = 'stable'").select("id").intersect(docs.where("content_type = 'en'").select("id")).subtract(kb(spark, d, "vecs").select(F.concat(F.lit("d"), "id")))


# --- lineage --------------------------------------------------------------------------------------------------


@query("l04_data_access", f"SELECT consumer, CASE WHEN role = 'writes' THEN 'writes' ELSE 'reads' END AS side, confidence FROM data_access WHERE schema_id = 'col7' AND {_RANK} >= 1")
def l04(spark, d):
    return L.access_for(kb(spark, d, "data_access"), "col7", "derived")


@query("l05_touched_by", "SELECT DISTINCT schema_id, role FROM data_access WHERE consumer = 'o5'")
def l05(spark, d):
    return L.touched_by(kb(spark, d, "data_access"), "o5")


@query("l06_accesses_to_table", "SELECT consumer, column_name, role, line FROM data_access JOIN schema_symbols s ON s.id = schema_id WHERE table_name = (SELECT min(table_name) FROM schema_symbols)")
def l06(spark, d):
    s = kb(spark, d, "schema_symbols")
    return L.accesses_to_table(kb(spark, d, "data_access"), s, s.agg(F.min("table_name")).first()[0])


@query("l07_schema_of_table", "SELECT column_name, column_type, is_nullable, is_primary_key FROM schema_symbols WHERE table_name = (SELECT min(table_name) FROM schema_symbols)")
def l07(spark, d):
    s = kb(spark, d, "schema_symbols")
    return L.schema_of_table(s, s.agg(F.min("table_name")).first()[0])


@query("l08_dead_columns", f"SELECT id, table_name, column_name FROM schema_symbols WHERE {_RANK} >= 2 AND id NOT IN (SELECT schema_id FROM data_access)")
def l08(spark, d):
    return L.dead_columns(kb(spark, d, "schema_symbols"), kb(spark, d, "data_access"), "resolved")


@query("l09_model_gaps", "SELECT schema_id, count(*) AS sites FROM data_access WHERE schema_id NOT IN (SELECT id FROM schema_symbols WHERE is_primary_key) GROUP BY 1")
def l09(spark, d):
    return L.model_gaps(kb(spark, d, "data_access"), kb(spark, d, "schema_symbols").where("is_primary_key"))


#: Literals of many shapes with what they touch: (literal, is SQL, (table, column, role)...); * stands for the known columns.
_LITERALS = [
    ("select a.id, b.name from orders a join users b on a.uid = b.id", True, [("orders", "id", "project"), ("users", "name", "project"), ("orders", "uid", "filter"), ("users", "id", "filter")]),
    ("insert into logs (ts, msg) values (1, 'x')", True, [("logs", "ts", "write"), ("logs", "msg", "write")]),
    ("UPDATE users SET name = 'x', age = 3 WHERE id = 1", True, [("users", "name", "write"), ("users", "age", "write"), ("users", "id", "filter")]),
    ("select * from users", True, [("users", "id", "project"), ("users", "name", "project"), ("users", "age", "project")]),
    ("with c as (select id from orders) select c.id from c", True, [("c", "id", "project")]),
    ("select the best one for me", False, []),
    ("SELECT u.name -- from nobody\r\nFROM users u\r\nWHERE u.id IN (SELECT o.uid FROM orders o WHERE o.id > 3) ORDER BY u.age", True, [("users", "name", "project"), ("users", "id", "filter"), ("orders", "uid", "filter"), ("orders", "id", "filter"), ("users", "age", "order")]),
    ("create table logs (ts int, msg text, primary key (ts))", True, [("logs", "ts", "ddl"), ("logs", "msg", "ddl")]),
    ("select * from nowhere", True, [("nowhere", None, None)]),
    ("select id from users, orders", True, [(None, None, None)]),
    ("config.json", False, []),
]
_COLUMNS = [("users", "id"), ("users", "name"), ("users", "age"), ("orders", "id"), ("orders", "uid"), ("logs", "ts")]


def _expected(found: list) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({k}, {', '.join(map(cell, t))})" for k, t in found)


def _literals(spark, d):
    pick = F.element_at(F.array(*(F.lit(t) for t, _, _ in _LITERALS)), (F.col("n") % len(_LITERALS) + 1).cast("int"))
    return kb(spark, d, "docs").select(F.col("id").alias("consumer"), "n", pick.alias("text"))


@query("l01_is_sql", f"SELECT n AS id, n % {len(_LITERALS)} NOT IN ({', '.join(str(k) for k, x in enumerate(_LITERALS) if not x[1])}) AS is_sql FROM docs")
def l01(spark, d):
    return L.sql_flags(_literals(spark, d)).select(F.col("n").alias("id"), "is_sql")


@query("l03_sql_access", f"""SELECT id AS consumer, t AS table_name, c AS column_name, r AS role, c IS NOT NULL AS bound FROM docs
JOIN (VALUES {_expected([(k, t) for k, x in enumerate(_LITERALS) for t in x[2]])}) v(k, t, c, r) ON k = n % {len(_LITERALS)}""")
def l03(spark, d):
    return L.access_from_sql(_literals(spark, d), spark.createDataFrame(_COLUMNS, "table_name string, column_name string"))


# --- extractors: the code files are generated, so that the expected rows are known -----------------------------


def _code(spark, d, *parts):
    return kb(spark, d, "docs").select(F.col("id").alias("file"), F.concat(*parts).alias("text"))


def _n():
    return F.col("n").cast("string")


def _files(spark, d, shapes):
    """A file of one of the shapes (name, text) for each document; ¤ stands for its number."""
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in shapes)), (F.col("n") % len(shapes) + 1).cast("int"))
    return kb(spark, d, "docs").select(*(F.replace(pick(i), F.lit("¤"), F.col("n").cast("string")).alias(k) for i, k in enumerate(("file", "text"))))


def _expect(shapes, names):
    """SQL for the rows (names...) that each shape is known to give."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {cell(f)}, {', '.join(map(cell, r))})" for k, (f, _, want) in enumerate(shapes) for r in want)
    put = lambda n, v: f"replace({n}, '¤', n::VARCHAR) AS {n}" if isinstance(v, str) else f"{n}::INTEGER AS {n}" if not isinstance(v, bool) else n
    first = next(want[0] for _, _, want in shapes if want)
    return f"SELECT replace(file, '¤', n::VARCHAR) AS file, {', '.join(put(n, v) for n, v in zip(names, first, strict=True))} FROM docs JOIN (VALUES {rows}) v(k, file, {', '.join(names)}) ON k = n % {len(shapes)}"


_MODELS = [
    ("m¤.py", 'class A(Base):\n    __tablename__ = "t¤"\n    # z = Column(Integer)\n    c¤ = Column(Integer)\n    b = Column("bb", String(5))\n    r = relationship("B")\n', [(4, "t¤", "c¤", "Integer"), (5, "t¤", "bb", "String")]),
    ("shop/m¤.py", "class L(models.Model):\r\n    n¤ = models.IntegerField()\r\n    o = models.ForeignKey(A, 1)\r\n    class Meta:\r\n        ordering = ['n']\r\n", [(2, "shop_l", "n¤", "IntegerField"), (3, "shop_l", "o_id", "ForeignKey")]),
    ("M¤.scala", 'class U(tag: Tag) extends Table[(Int)](tag, "u¤") {\n  def id = column[Int]("id") // column[Int]("no")\n}\n', [(2, "u¤", "id", "Int")]),
    ("n¤.py", '"""\nclass A(Base):\n    x = Column(Integer)\n"""\n', []),
]


@query("l10_orm_columns", _expect(_MODELS, ["line", "table_name", "column_name", "column_type"]))
def l10(spark, d):
    return L.orm_columns(_files(spark, d, _MODELS))


_ROUTES = [
    ("r¤.py", '@app.get("/items/¤")\ndef f(): pass\n# @app.get("/no")\n@bp.route("/x/<int:id>", methods=["PUT", "GET"])\ndef g(id): pass\n', [(1, "GET", "/items/¤"), (4, "PUT", "/x/{id}"), (4, "GET", "/x/{id}")]),
    ("r¤.js", "const app = express(), m = new Map();\napp.get('/a/:id', (q, s) => { m.get('/no', 1); });\n/* app.get('/no', h) */ router.post('/b¤', h);\napp.get('setting');\n", [(2, "GET", "/a/{id}"), (3, "POST", "/b¤")]),
    ("r¤.go", 'func main() {\n\tr.GET("/g/:id", h) // r.GET("/no", h)\n\tmux.HandleFunc("POST /h¤", h)\n}\n', [(2, "GET", "/g/{id}"), (3, "POST", "/h¤")]),
    ("r¤.scala", 'path("s¤" / Segment) { s =>\n  get { complete(s) }\n}\n', [(2, "GET", "/s¤/{arg0}")]),
    ("r¤.txt", "@app.get('/no')", []),
]


@query("l11_http_routes", _expect(_ROUTES, ["line", "method", "path"]))
def l11(spark, d):
    return L.http_routes(_files(spark, d, _ROUTES))


_CALLS = [
    ("c¤.py", 'import requests as rq\ns = rq.Session()\nrq.post(f"http://h/¤/{x}", json={})\ns.get("http://s¤")\ncache.get("no")\n# rq.get("http://no")\n', [(3, "requests", "POST", "http://h/¤/{}"), (4, "requests", "GET", "http://s¤")]),
    ("c¤.ts", "fetch(`/b¤/${id}`, { method: 'PUT' });\r\n/* fetch('/no') */ axios.get('/c');\r\nthis.fetch('/no');\r\n", [(1, "fetch", "PUT", "/b¤/{}"), (2, "axios", "GET", "/c")]),
    ("c¤.md", "requests.get('http://no')", []),
]


@query("l12_http_clients", _expect(_CALLS, ["line", "sink", "method", "url"]))
def l12(spark, d):
    return L.http_clients(_files(spark, d, _CALLS))


_RUNS = [
    ("p¤.py", 'import subprocess, os\nsubprocess.run(["tool¤", "-x"])\nos.system("ls -l")  # os.system("no")\nself.run(["no"])\n', [(2, "tool¤"), (3, "ls")]),
    ("p¤.js", "spawn('node¤', ['a']);\n/x/.exec('no'); child_process.exec(`make ${t}`);\n", [(1, "node¤"), (2, "make")]),
    ("p¤.go", 'func main() {\n\texec.Command("tar¤", "x") // exec.Command("no")\n}\n', [(2, "tar¤")]),
]


@query("l13_processes", _expect(_RUNS, ["line", "target"]))
def l13(spark, d):
    return L.processes(_files(spark, d, _RUNS))


_TEXTS = [
    ("l¤.py", 'x = "abc¤"  # "no"\ny = f"select {x} from t¤"\nz = "ab"\n', [(1, 4, "abc¤"), (2, 4, "select {} from t¤")]),
    ("l¤.js", "const a = 'one¤'; // 'no'\nconst b = `two ${f('six')} ¤`;\n", [(1, 10, "one¤"), (2, 10, "two {} ¤")]),
    ("l¤.py", '"""doc"""\r\ndef f():\r\n    return [\'q¤q\', "é¤é"]\r\n', [(3, 12, "q¤q"), (3, None, "é¤é")]),
]
# the column of the last one follows the number's digits
_TEXT_SQL = _expect(_TEXTS, ["line", "col", "value"]).replace("col::INTEGER AS col", "coalesce(col, 18 + length(n::VARCHAR))::INTEGER AS col")


@query("l14_string_literals", _TEXT_SQL)
def l14(spark, d):
    return L.string_literals(_files(spark, d, _TEXTS))


@query("l16_config_usage", "SELECT id AS file, 1 AS line, 'read' AS how FROM docs WHERE n % 2 = 0 UNION ALL SELECT id, 1, 'literal' FROM docs WHERE n % 2 = 1 AND n % 3 = 0")
def l16(spark, d):
    docs = kb(spark, d, "docs").withColumn("line", F.lit(1))
    reads = docs.where("n % 2 = 0").select(F.col("id").alias("file"), "line", F.lit("K").alias("key"))
    return L.config_usage(reads, docs.where("n % 3 = 0").select(F.col("id").alias("file"), "line", F.lit("K").alias("value")), "K")


@query("l17_version_facts", "SELECT id, 'since' AS fact, '1.' || (n % 20) AS version FROM docs UNION SELECT id, 'deprecated in', '2.0' FROM docs WHERE n % 2 = 0")
def l17(spark, d):
    text = F.concat(F.lit("Since: v1."), F.col("n") % 20, F.lit(" and since 1."), F.col("n") % 20, F.when(F.col("n") % 2 == 0, ". Deprecated in 2.0.").otherwise("."))
    return L.version_facts(kb(spark, d, "docs").select("id", text.alias("text")))


@query("l17_version_compare", "SELECT id, CASE WHEN n % 10 = 9 THEN NULL ELSE (n % 4, n % 10) <= (2, 5) END AS ok FROM docs")
def l17v(spark, d):
    v = F.when(F.col("n") % 10 == 9, "head").otherwise(F.concat(F.lit("v"), F.col("n") % 4, F.lit("."), F.col("n") % 10, F.lit("-rc")))
    return kb(spark, d, "docs").select("id", version_at_most(v, F.lit("2.5")).alias("ok"))


@query("l17_availability", "SELECT 'f' || (n % 30) AS name, '1.' || max(n) AS version, max(n) <= 900 AS available FROM docs GROUP BY n % 30")
def l17a(spark, d):
    f = kb(spark, d, "docs").select(F.concat(F.lit("f"), F.col("n") % 30).alias("name"), F.lit("since").alias("fact"), F.concat(F.lit("1."), "n").alias("version"), F.col("n").alias("id"))
    return L.availability(f, F.lit("1.900"))


@query("l19_dependencies", """WITH j AS (SELECT source_name, id AS file, 'src' || (n % 5) AS depends_on FROM docs WHERE source_name <> 'src' || (n % 5)), r AS (SELECT *, row_number() OVER (PARTITION BY source_name, depends_on ORDER BY file) AS r FROM j)
SELECT source_name, depends_on, count(*) AS files, string_agg(CASE WHEN r <= 3 THEN file END, ',' ORDER BY file) AS evidence FROM r GROUP BY 1, 2""")
def l19(spark, d):
    docs = kb(spark, d, "docs")
    f = docs.select("source_name", F.col("id").alias("file"), F.concat(F.lit("import os\nfrom src"), F.col("n") % 5, F.lit(".x import y")).alias("text"))
    return L.dependencies(f, docs.select("source_name").distinct())


@query("l20_guardrails", "SELECT true AS all_ok, false AS missing_ok, true AS any_ok")
def l20(spark, d):
    s = kb(spark, d, "symbols")
    has, no = {"symbol_exists": "m.Order1"}, {"symbol_exists": "nope"}
    row = (L.guardrail(s, {"all_of": [has, {"name_contains": "Order"}]}), L.guardrail(s, {"all_of": [has, no]}), L.guardrail(s, {"any_of": [no, has]}))
    return spark.createDataFrame([row], "all_ok boolean, missing_ok boolean, any_ok boolean")


@query("l21_element_body", "SELECT id, 'l' || (2 + n % 3) || chr(10) || 'l' || (3 + n % 3) AS body FROM docs")
def l21(spark, d):
    docs = kb(spark, d, "docs")
    texts = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, 9)))], "file string, text string")
    e = docs.select("id", F.lit("f").alias("file"), (2 + F.col("n") % 3).cast("int").alias("line_start"), (3 + F.col("n") % 3).cast("int").alias("line_end"))
    return L.element_body(e, texts)


#: Generated files of several shapes; ¤ stands for the document's number: (name, text, (subtype, name, first, last line)...).
_FILES = [
    ("a¤.py", 'class A¤:\n    """def no(): pass"""\n    size = 1\n    async def f(self): pass  # class B: pass\ndef g():\n    def h(): return "class C:"\n', [("class", "A¤", 1, 4), ("variable", "A¤.size", 3, 3), ("method", "A¤.f", 4, 4), ("function", "g", 5, 6), ("function", "h", 6, 6)]),
    ("a¤.ts", "// function no() {}\r\nexport const k¤ = `${ { a: 1 }.a } class No {`;\r\nfunction go() {\r\n  return /[{]/.test('}');\r\n}\r\nclass S { m() {} }\r\n", [("js_export", "k¤", 2, 2), ("js_function", "go", 3, 5), ("js_class", "S", 6, 6)]),
    ("a¤.md", "# T¤\n```\n# no\n```\n## S\n#no\n## S\n", [("md_section", "t¤", 1, 7), ("md_section", "s", 5, 6), ("md_section", "s_2", 7, 7)]),
    ("a¤.json", '{"k¤": {"z": [1, "}"]},\n "y": "a: {"}', [("json_key", "k¤", 1, 1), ("json_key", "y", 2, 2)]),
    ("a¤.yaml", "k¤: 1\nlist:\n  - a: 1\ntext: |\n  no: 1\n# end: 1\n", [("yaml_key", "k¤", 1, 1), ("yaml_key", "list", 2, 3), ("yaml_key", "text", 4, 5)]),
    ("a¤.rst", "Title ¤\n=======\n\nPart\n----\n", [("rst_section", "title_¤", 1, 3), ("rst_section", "part", 4, 5)]),
    ("a¤.conf", "s¤ {\n  port = 8 # no = 1\n  l = [{ no = 1 }]\n}\n", [("hocon_key", "s¤", 1, 4), ("hocon_key", "s¤.port", 2, 2), ("hocon_key", "s¤.l", 3, 3)]),
    ("a¤.txt", "class A¤: pass", []),
]


@query("s14_elements", f"SELECT file, subtype, 'a' || regexp_extract(file, '[0-9]+') || '.' || qualified_name AS qualified_name, line_start, line_end FROM ({_expect(_FILES, ['subtype', 'qualified_name', 'line_start', 'line_end'])})")
def s14(spark, d):
    return L.elements(_files(spark, d, _FILES)).select("file", "subtype", "qualified_name", "line_start", "line_end")


_MIGRATIONS = [
    ("shop/migrations/¤.py", 'operations = [migrations.CreateModel(name="O¤", fields=[\n    ("id", models.AutoField()), ("u", models.ForeignKey("U", 1)),\n])]\n', [(2, "shop_o¤", "id", "AutoField", None, None), (2, "shop_o¤", "u_id", "ForeignKey", None, None)]),
    ("versions/¤.py", 'def upgrade():\n    op.create_table("t¤", sa.Column("id", sa.Integer(), nullable=False, primary_key=True),\n        sa.Column("n", sa.String(3)))\n    # op.add_column("t", sa.Column("no", sa.Integer()))\n', [(2, "t¤", "id", "Integer", False, True), (3, "t¤", "n", "String", None, None)]),
]


@query("s18_migrations", _expect(_MIGRATIONS, ["line", "table_name", "column_name", "column_type", "is_nullable", "is_primary_key"]).replace("is_nullable::INTEGER AS is_nullable", "is_nullable").replace("is_primary_key::INTEGER AS is_primary_key", "is_primary_key"))
def s18m(spark, d):
    return L.migration_columns(_files(spark, d, _MIGRATIONS))


@query("s17_ini", "SELECT id AS file, 2 AS line, 'main' AS section, 'key' AS key, 'v' || n AS value FROM docs UNION ALL SELECT id, 4, 'main', 'B', 'q r' FROM docs")
def s17(spark, d):
    return L.ini_entries(_code(spark, d, F.lit("[main]\nkey = v"), _n(), F.lit('\n; note = x\nexport B="q r"')))


@query("s17_dockerfile", "SELECT id AS file, 1 AS line, 'FROM' AS key, 'py:' || n AS value FROM docs UNION ALL SELECT id, 2, 'ENV', 'A=1' FROM docs")
def s17d(spark, d):
    return L.dockerfile_entries(_code(spark, d, F.lit("FROM py:"), _n(), F.lit("\nENV A=1 \n# RUN x")))


_SPECS = [
    ("s¤.json", '{"paths": {"/i/{id}": {"get": {"operationId": "op¤"}, "parameters": [], "post": {"summary": "make"}}}}', [("/i/{id}", "GET", "op¤", ""), ("/i/{id}", "POST", None, "make")]),
    ("s¤.yaml", "info:\n  text: |\n    paths:\n      /no:\n        get: {}\npaths:\n  /y¤:\n    parameters:\n      - get: no\n    put:\n      operationId: 'op: ¤'\n      tags: [a]\n", [("/y¤", "PUT", "op: ¤", "")]),
    ("t¤.json", '{"paths": {', []),
]


@query("s16_openapi", _expect(_SPECS, ["path", "method", "operation", "summary"]))
def s16(spark, d):
    return L.openapi_endpoints(_files(spark, d, _SPECS))


@query("s15_code_index", """SELECT 'i' || n || '.scip' AS "index", 'm' || n || '.py' AS file, 'python' AS language, 'py m f' || n || '().' AS symbol, n::INTEGER AS line, 4 AS col, n::INTEGER AS end_line, 9 AS end_col, true AS is_definition FROM docs
UNION ALL SELECT 'i' || n || '.scip', 'm' || n || '.py', 'python', 'local ' || n % 9, (n + 1)::INTEGER, 0, (n + 200)::INTEGER, 300, false FROM docs""")
def s15(spark, d):
    from quarry.sources import code_index

    def number(v: int) -> bytes:
        return number_tail(v) if v > 127 else bytes([v])

    def number_tail(v: int) -> bytes:
        return bytes([v & 127 | 128]) + number(v >> 7)

    def part(field: int, data: bytes) -> bytes:
        return number(field << 3 | 2) + number(len(data)) + data

    def encoded(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for n in batch.column(0).to_pylist():
                own = part(1, number(n) + number(4) + number(9)) + part(2, f"py m f{n}().".encode()) + number(3 << 3) + number(1)
                use = part(1, number(n + 1) + number(0) + number(n + 200) + number(300)) + part(2, f"local {n % 9}".encode())
                out.append(part(1, b"tool") + part(2, part(1, f"m{n}.py".encode()) + part(2, own) + part(2, use) + part(4, b"python")))
            yield pa.RecordBatch.from_arrays([pa.array([f"i{n}.scip" for n in batch.column(0).to_pylist()]), pa.array(out, pa.binary())], ["path", "content"])

    return code_index.decoded(kb(spark, d, "docs").select("n").mapInArrow(encoded, "path string, content binary"))


@query("s18_create_tables", """SELECT id AS file, 't' || n AS table_name, 0 AS pos, 'id' AS column_name, 'INT' AS column_type, true AS is_primary_key, true AS is_nullable FROM docs UNION ALL SELECT id, 't' || n, 1, 'price', 'DECIMAL', false, false FROM docs""")
def s18(spark, d):
    return L.create_tables(_code(spark, d, F.lit("CREATE TABLE IF NOT EXISTS T"), _n(), F.lit(" (\n id INT PRIMARY KEY,\n price DECIMAL(10, 2) NOT NULL,\n UNIQUE (price));")))


@query("x29_camel_tokens", "SELECT id, 'get,user,name,' || n || ',http,item' AS tokens FROM docs")
def x29(spark, d):
    text = F.concat(F.lit("getUserName"), "n", F.lit("_HTTP items"))
    return kb(spark, d, "docs").select("id", F.array_join(camel_tokens(text), ",").alias("tokens"))


@query("x30_confidence_rank", f"SELECT id, {_RANK} AS rank FROM schema_symbols")
def x30(spark, d):
    return kb(spark, d, "schema_symbols").select("id", confidence_rank(F.col("confidence")).alias("rank"))
