"""Queries over document texts, pages and corpus health."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import quality as Q
from quarry.operators import text as T
from quarry.plans.tables import kb
from quarry.session import table

#: A Markdown corpus made of the whole documents: headed sections around each text, a fence now and then, references and warnings.
#: A null text makes no Markdown.
_MD = """(SELECT id, n, files, updated_at, content_type, 'Intro ' || title || chr(10) || chr(10) || '## Overview ' || n || chr(10) || content || chr(10) || '### Part' || chr(10) || 'x ' || n || chr(10)
|| '## Design decision' || chr(10) || '### Choice ' || n || chr(10) || 'We took (d' || (n + 1) || '.md) because warning: this is never cheap to undo ' || (n % 9) || chr(10)
|| CASE WHEN n % 5 = 0 THEN '```py' || chr(10) ELSE '' END || '## End' || chr(10) || 'Done.' AS content FROM docs)"""


def _md(spark, d):
    docs = kb(spark, d, "docs")
    n = F.col("n").cast("string")
    body = F.concat(
        F.lit("Intro "), "title", F.lit("\n\n## Overview "), n, F.lit("\n"), "content", F.lit("\n### Part\nx "), n, F.lit("\n## Design decision\n### Choice "), n, F.lit("\nWe took (d"), (F.col("n") + 1).cast("string"),
        F.lit(".md) because warning: this is never cheap to undo "), (F.col("n") % 9).cast("string"), F.lit("\n"), F.when(F.col("n") % 5 == 0, "```py\n").otherwise(""), F.lit("## End\nDone."),
    )
    return docs.select("id", "n", "files", "updated_at", "content_type", body.alias("content"))


@query("t01_chunks")
def t01(spark, d):
    return T.chunks(kb(spark, d, "docs").select("id", "content"))


@query("t02_sections", f"""WITH md AS {_MD}, l AS (SELECT id, i, ls[i] AS x, sum(CASE WHEN starts_with(ls[i], '## ') AND NOT starts_with(ls[i], '## #') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS s FROM (SELECT id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT id, string_split(content, chr(10)) AS ls FROM md))),
p AS (SELECT id, s, regexp_replace(string_agg(x, chr(10) ORDER BY i), '^\\s+|\\s+$', '', 'g') AS part FROM l GROUP BY id, s)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY s) - 1)::INTEGER AS idx, trim(regexp_extract(part, '^## ([^\\n]*)', 1)) AS heading, length(part)::INTEGER AS chars FROM p WHERE part <> ''""")
def t02(spark, d):
    return T.sections(_md(spark, d))


@query("t03_embedding_text", "SELECT id, md5(title || chr(10) || substr(content, 1, 2000)) AS h FROM docs")
def t03(spark, d):
    return T.embedding_text(kb(spark, d, "docs")).select("id", F.md5("text").alias("h"))


@query("t04_lint", "SELECT id, unnest(list_filter(list_value(CASE WHEN length(content) < 100 THEN 'too_short' END, CASE WHEN NOT regexp_matches(lower(content), 'overview|summary') THEN 'no_overview' END), lambda x: x IS NOT NULL)) AS problem FROM docs")
def t04(spark, d):
    return T.lint(kb(spark, d, "docs"))


@query("t04_broken_refs", f"WITH md AS {_MD} SELECT target, id FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '\\(([A-Za-z0-9-]+)\\.md\\)', 1))) AS target FROM md) WHERE target NOT IN (SELECT id FROM docs)")
def t04b(spark, d):
    return T.broken_references(_md(spark, d))


@query("t05_oversized", "SELECT id, length(content)::INTEGER AS chars FROM docs WHERE length(content) > 15000")
def t05(spark, d):
    return T.oversized(kb(spark, d, "docs"))


@query("t05_shrink", f"""WITH md AS {_MD}, h AS (SELECT id, regexp_extract_all(content, '(?m)^## ([^\\n]+)', 1) AS h FROM md WHERE length(content) > 400)
SELECT id, len(h)::INTEGER AS n, array_to_string(h[1:6], ' | ') AS headers FROM h WHERE len(h) >= 3""")
def t05b(spark, d):
    return T.shrink_suggestions(_md(spark, d), most=400)


@query("t06_rechunk", """WITH b AS (SELECT document_id AS id, count(*) AS chunks, round(1 - count(*) FILTER (NOT regexp_matches(rtrim(content), '[.!?:;)\\]]$') OR length(content) < 30) / count(*), 6) AS quality FROM sections GROUP BY 1)
SELECT * FROM b WHERE chunks >= 2 AND quality < 0.5 ORDER BY quality, id LIMIT 20""")
def t06(spark, d):
    return T.rechunk(kb(spark, d, "sections").select(F.col("document_id").alias("id"), "content"))


@query("t07_decisions", f"""WITH md AS {_MD}, l AS (SELECT id, i, ls[i] AS x, sum(CASE WHEN starts_with(ls[i], '## ') AND NOT starts_with(ls[i], '## #') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS s, sum(CASE WHEN starts_with(ls[i], '### ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS k
FROM (SELECT id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT id, string_split(content, chr(10)) AS ls FROM md))),
g AS (SELECT id, s, k, arg_min(x, i) AS title, string_agg(x, chr(10) ORDER BY i) AS t, arg_max(i, i) AS last FROM l GROUP BY 1, 2, 3),
m AS (SELECT id, s, arg_min(title, k) AS head, min(k) AS k0, max(starts_with(title, '### ')::INT) FILTER (k = 0) AS d FROM g GROUP BY 1, 2), e AS (SELECT id, max(i) AS n FROM l GROUP BY 1)
SELECT g.id, (k - k0)::INTEGER AS pos, trim(substr(title, 5)) AS title, substr(trim(CASE WHEN contains(t, chr(10)) THEN substr(t, strpos(t, chr(10)) + 1) ELSE '' END || CASE WHEN last < n AND contains(t, chr(10)) THEN chr(10) ELSE '' END), 1, 300) AS text
FROM g JOIN m ON m.id = g.id AND m.s = g.s JOIN e ON e.id = g.id WHERE starts_with(title, '### ') AND contains(lower(head), 'design') AND contains(lower(head), 'decision') AND starts_with(head, '## ')""")
def t07(spark, d):
    return T.decisions(_md(spark, d))


@query("t08_warnings", f"""WITH md AS {_MD}, l AS (SELECT id, (i - 1)::INTEGER AS pos, trim(ls[i]) AS line FROM (SELECT id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT id, string_split(content, chr(10)) AS ls FROM md)))
SELECT line, id, pos FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY id, pos) AS r FROM l WHERE length(line) > 20 AND regexp_matches(line, '(?i)\\b(warning|caution|beware|gotcha|careful|never|must not)\\b')) WHERE r = 1 ORDER BY id, pos LIMIT 20""")
def t08(spark, d):
    return T.warning_lines(_md(spark, d))


@query("t09_explain", f"""WITH md AS {_MD}, x AS (SELECT * FROM md WHERE list_contains(files, 'lib/F_3.py')) SELECT id, content_type, len(regexp_extract_all(content, '(?m)^#+ [^\\n]+'))::INTEGER AS headings, (SELECT count(*) FROM x) AS total,
CASE WHEN (SELECT count(*) FROM x) > 15 THEN 15 END::INTEGER AS next_offset FROM x ORDER BY content_type, id LIMIT 10 OFFSET 5""")
def t09(spark, d):
    return T.explain(_md(spark, d), "lib/F_3.py", 10, 5)


@query("t10_summaries", f"""WITH md AS {_MD} SELECT id, list_filter(list_transform(string_split(content, chr(10) || chr(10)), lambda p: trim(p)), lambda p: length(p) > 50 AND NOT starts_with(p, '#') AND NOT starts_with(p, '```'))[1] AS summary FROM md""")
def t10(spark, d):
    return T.summaries(_md(spark, d))


_TRACE = "(SELECT n AS id, 'Traceback' || chr(10) || '  File \"a/m' || (n % 5) || '.py\", line ' || n || ', in run' || chr(10) || '  File \"b.py\", line 7, in go' || chr(10) AS text FROM docs)"


@query("t11_stack_frames", "SELECT n AS id, 0::INTEGER AS pos, 'a/m' || (n % 5) || '.py' AS file, n::INTEGER AS line, 'run' AS function FROM docs UNION ALL SELECT n, 1, 'b.py', 7, 'go' FROM docs")
def t11(spark, d):
    n = F.col("n").cast("string")
    text = F.concat(F.lit('Traceback\n  File "a/m'), (F.col("n") % 5).cast("string"), F.lit('.py", line '), n, F.lit(', in run\n  File "b.py", line 7, in go\n'))
    return T.stack_frames(kb(spark, d, "docs").select(F.col("n").alias("id"), text.alias("text")))


@query("t11_side_effects", "SELECT id, unnest(CASE n % 3 WHEN 0 THEN list_value('database', 'file') WHEN 1 THEN list_value('network') ELSE list_value('process') END) AS effect FROM docs")
def t11b(spark, d):
    body = F.when(F.col("n") % 3 == 0, "cursor = open(x)").when(F.col("n") % 3 == 1, "requests.get(u)").otherwise("subprocess.run(c)")
    return T.side_effects(kb(spark, d, "docs").select("id", body.alias("text")))


@query("t12_tests_for", """WITH f AS (SELECT DISTINCT 'src/m' || (n % 50) || '.py' AS file, 'm' || (n % 50) AS stem FROM docs), t AS (SELECT DISTINCT 'tests/test_m' || (n % 20) || '.py' AS test, 'm' || (n % 20) AS stem FROM docs),
i AS (SELECT DISTINCT 'src/m' || (n % 30) || '.py' AS file, 'tests/test_m' || (n % 20) || '.py' AS test FROM docs), u AS (SELECT file, test, 0 AS p, 'name' AS reason FROM f JOIN t USING (stem) UNION ALL SELECT file, test, 1, 'import' FROM i)
SELECT file, test, arg_min(reason, p) AS reason FROM u GROUP BY 1, 2""")
def t12(spark, d):
    docs = kb(spark, d, "docs")
    p = lambda a, k, b: F.concat(F.lit(a), (F.col("n") % k).cast("string"), F.lit(b))
    files = docs.select(p("src/m", 50, ".py").alias("file")).union(docs.select(p("tests/test_m", 20, ".py"))).distinct()
    g = docs.select(p("tests/test_m", 20, ".py").alias("source_id"), p("src/m", 30, ".py").alias("target_id"), F.lit("import").alias("edge_type")).distinct()
    return T.tests_for(files, g)


@query("t13_stale_documents", "SELECT DISTINCT id FROM (SELECT id, updated_at, unnest(files) AS file FROM docs) JOIN (SELECT files[2] AS file, max(updated_at) AS mtime FROM docs WHERE n % 3 = 0 GROUP BY 1) USING (file) WHERE updated_at < mtime")
def t13(spark, d):
    docs = kb(spark, d, "docs")
    return T.stale_documents(docs, docs.where("n % 3 = 0").groupBy(F.element_at("files", 2).alias("file")).agg(F.max("updated_at").alias("mtime")))


@query("t14_complexity", "SELECT id, round((0.01 * (4 + n % 3) + 5 + 2 * (1 + n % 3) + 0.5), 6)::DOUBLE AS complexity FROM docs")
def t14(spark, d):
    code = F.concat(F.lit("import os\nclass A:\n    def f(self):\n        pass"), F.repeat(F.lit("\ndef g(): pass"), (F.col("n") % 3).cast("int")))
    return T.complexity(kb(spark, d, "docs").select("id", code.alias("text")))


@query("t15_author_shares", "SELECT source_name AS file, feature AS author, count(*) AS lines, round(count(*) / sum(count(*)) OVER (PARTITION BY source_name), 6) AS share FROM docs GROUP BY 1, 2")
def t15(spark, d):
    return T.author_shares(kb(spark, d, "docs").select(F.col("source_name").alias("file"), F.col("feature").alias("author")))


@query("t16_token_budget", "SELECT sum(floor(length(content) / 4))::BIGINT AS tokens, sum(floor(length(content) / 4)) > 100000 AS downgrade FROM docs")
def t16(spark, d):
    return T.token_budget(kb(spark, d, "docs"), 100000)


@query("t17_source_spans", """SELECT 'f' || k AS file, 1 AS a, 6 AS b, 'l1' || chr(10) || 'l2' || chr(10) || 'l3' || chr(10) || 'l4' || chr(10) || 'l5' || chr(10) || 'l6' AS span FROM range(5) t(k)
UNION ALL SELECT 'f' || k, 18, 22, 'l18' || chr(10) || 'l19' || chr(10) || 'l20' || chr(10) || 'l21' || chr(10) || 'l22' FROM range(5) t(k)""")
def t17(spark, d):
    texts = spark.range(5).select(F.concat(F.lit("f"), "id").alias("file"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("l"), i)), "\n").alias("text"))
    return T.source_spans(texts.select("file", F.explode(F.array(*map(F.lit, (2, 4, 20)))).alias("line")), texts, 2, 2)


@query("t18_validate", f"""WITH md AS {_MD}, x AS (SELECT id, list_filter(list_value(CASE WHEN length(content) < 300 THEN 'short' END, CASE WHEN NOT regexp_matches(content, '(?m)^#+ ') THEN 'no_heading' END,
CASE WHEN len(regexp_extract_all(content, '(?m)^```')) % 2 = 1 THEN 'open_fence' END, CASE WHEN regexp_matches(content, '(?i)as an ai|lorem ipsum') THEN 'artefact' END), lambda v: v IS NOT NULL) AS f FROM md) SELECT id, array_to_string(f, ',') AS problems, len(f) = 0 AS ok FROM x""")
def t18(spark, d):
    return T.validate(_md(spark, d), 300)


@query("t19_doc_tags", "SELECT id, 0::INTEGER AS pos, 'param' AS tag, 'x' || n AS name, 'the value' AS description FROM docs UNION ALL SELECT id, 1, 'return', 'int', '' FROM docs")
def t19(spark, d):
    text = F.concat(F.lit("/**\n * @param x"), "n", F.lit(" the value\n * @return int\n */"))
    return T.doc_tags(kb(spark, d, "docs").select("id", text.alias("text")))


@query("t20_facets", "SELECT id, 0::INTEGER AS pos, 'load_' || n AS span FROM docs UNION ALL SELECT id, 1, '\"the end\"' FROM docs UNION ALL SELECT id, 2, 'Order Book' FROM docs UNION ALL SELECT id, 3, 'getItem' FROM docs")
def t20(spark, d):
    return T.facets(kb(spark, d, "docs").select("id", F.concat(F.lit("where does load_"), "n", F.lit(' say "the end" of Order Book in getItem?')).alias("question")))


@query("t21_claim_coverage", "SELECT 'c' || (n % 40) AS claim, count(*) AS needed, count(*) FILTER (n % 3 = 0) AS covered FROM docs GROUP BY 1")
def t21(spark, d):
    docs = kb(spark, d, "docs")
    return T.claim_coverage(docs.select(F.concat(F.lit("c"), F.col("n") % 40).alias("claim"), F.col("id").alias("symbol")), docs.where("n % 3 = 0").select(F.col("id").alias("symbol")))


@query("t22_select_bodies", """WITH o AS (SELECT source_name AS grp, files[2] AS symbol, min(n) AS pos FROM docs GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY pos, symbol) AS r FROM o)
SELECT grp, symbol, row_number() OVER (ORDER BY (r > 2)::INT, pos, grp, symbol)::INTEGER AS k FROM r QUALIFY k <= 60""")
def t22(spark, d):
    return T.select_bodies(kb(spark, d, "docs").select(F.col("source_name").alias("grp"), F.element_at("files", 2).alias("symbol"), F.col("n").alias("pos")), 60, 2)


@query("t23_html_text", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'),
'&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def t23(spark, d):
    return T.html_text(table(spark, d, "pages"))


# --- corpus statistics ----------------------------------------------------------------------------------------


@query("a03_histogram", """WITH h AS (SELECT score, count(*) AS n FROM usage WHERE score BETWEEN 1 AND 10 GROUP BY 1) SELECT score, repeat('#', round_even(n / (SELECT max(n) FROM h) * 10, 0)::INTEGER) AS bar FROM h""")
def a03(spark, d):
    from quarry.operators.usage import score_histogram

    return Q.histogram_bars(score_histogram(kb(spark, d, "usage")))


@query("a11_source_stats", """WITH x AS (SELECT source_name AS source, count(*) AS docs, sum(length(content))::BIGINT AS chars, count(*) FILTER (has_vector) AS vectors FROM docs GROUP BY 1),
c AS (SELECT source_name AS source, count(*) AS chunks FROM sections JOIN docs ON docs.id = 'd' || substr(document_id, 2) GROUP BY 1) SELECT x.*, coalesce(chunks, 0) AS chunks FROM x LEFT JOIN c USING (source)""")
def a11(spark, d):
    s = kb(spark, d, "sections").select(F.concat(F.lit("d"), F.substring("document_id", 2, 12)).alias("document_id"))
    return Q.stats_by_source(kb(spark, d, "docs"), s)


@query("a11_rollup", "SELECT source_name, content_type, count(*) AS docs, sum(length(content))::BIGINT AS chars FROM docs GROUP BY ROLLUP (source_name, content_type)")
def a11r(spark, d):
    return Q.stats_rollup(kb(spark, d, "docs"))


@query("a12_signature", "SELECT source_name, count(*) || '|' || strftime(max(updated_at), '%Y-%m-%d %H:%M:%S') AS signature FROM docs GROUP BY 1")
def a12(spark, d):
    return Q.source_signature(kb(spark, d, "docs"))


@query("a13_counts", "SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM sections) AS chunks")
def a13(spark, d):
    a = kb(spark, d, "docs").agg(F.count(F.lit(1)).alias("documents"))
    return a.crossJoin(F.broadcast(kb(spark, d, "sections").agg(F.count(F.lit(1)).alias("chunks"))))


@query("a14_health", """WITH a AS (SELECT count(*) AS n, count(*) FILTER (has_vector) AS vec, count(*) FILTER (length(content) < 100) AS short, count(*) FILTER (status = 'deprecated') AS dep FROM docs), p AS (SELECT floor(100 * vec / n)::BIGINT AS v FROM a),
dup AS (SELECT count(*) AS v FROM (SELECT title FROM docs GROUP BY title HAVING count(*) > 1)), o AS (SELECT count(*) AS v FROM sections WHERE 'd' || substr(document_id, 2) NOT IN (SELECT id FROM docs))
SELECT 'documents' AS check, n AS value, 'ok' AS state FROM a UNION ALL SELECT 'embedded_pct', v, CASE WHEN v >= 90 THEN 'ok' WHEN v >= 50 THEN 'warning' ELSE 'error' END FROM p UNION ALL SELECT 'short', short, CASE short WHEN 0 THEN 'ok' ELSE 'warning' END FROM a
UNION ALL SELECT 'no_files', 0, 'ok' UNION ALL SELECT 'duplicate_titles', v, CASE v WHEN 0 THEN 'ok' ELSE 'warning' END FROM dup UNION ALL SELECT 'orphan_sections', v, CASE v WHEN 0 THEN 'ok' ELSE 'warning' END FROM o UNION ALL SELECT 'deprecated', dep, CASE dep WHEN 0 THEN 'ok' ELSE 'warning' END FROM a""".replace("AS check,", 'AS "check",'))
def a14(spark, d):
    s = kb(spark, d, "sections").select(F.concat(F.lit("d"), F.substring("document_id", 2, 12)).alias("document_id"))
    return Q.health(kb(spark, d, "docs"), s)


@query("a15_debt", """WITH x AS (SELECT count(*) AS n, count(*) FILTER (has_vector) AS vec, count(DISTINCT title) AS t FROM docs), g AS (SELECT count(DISTINCT source_id) AS l FROM doc_graph), u AS (SELECT count(*) FILTER (outcome = 'hit') AS h, count(*) FILTER (outcome = 'miss') AS m FROM usage),
s AS (SELECT round(15 * (1 - vec / n) + 15 * (1 - t / n) + 15 * (1 - least(l / n, 1)) + 15 * (1 - h / (h + m)), 4) AS score FROM x, g, u) SELECT score, CASE WHEN score < 10 THEN 'A' WHEN score < 25 THEN 'B' WHEN score < 45 THEN 'C' WHEN score < 65 THEN 'D' ELSE 'F' END AS grade FROM s""")
def a15(spark, d):
    return Q.debt_score(kb(spark, d, "docs"), kb(spark, d, "doc_graph"), kb(spark, d, "usage"))


@query("a16_duplicate_titles", "SELECT title, count(*) AS n, min(id) AS first_id FROM docs GROUP BY title HAVING count(*) > 1")
def a16(spark, d):
    return Q.duplicate_titles(kb(spark, d, "docs"))


@query("a17_coverage", """WITH f AS (SELECT DISTINCT source_name, 'src/' || source_name || '/m' || k || '.py' AS file FROM docs, range(50) t(k)), n AS (SELECT DISTINCT files[1] AS file FROM docs)
SELECT source_name, count(*) AS files, count(n.file) AS covered, round(count(n.file) / count(*), 6) AS ratio FROM f LEFT JOIN n USING (file) GROUP BY 1""")
def a17(spark, d):
    docs = kb(spark, d, "docs")
    f = docs.select("source_name").distinct().select("source_name", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("k")).select("source_name", F.concat(F.lit("src/"), "source_name", F.lit("/m"), "k", F.lit(".py")).alias("file"))
    return Q.coverage(f, docs)


@query("a18_ancestor_rollup", """WITH f AS (SELECT files[1] AS file, length(content) AS size FROM docs), e AS (SELECT unnest(list_value(split_part(file, '/', 1), split_part(file, '/', 1) || '/' || split_part(file, '/', 2), file)) AS node, size FROM f)
SELECT node, count(*) AS files, sum(size)::BIGINT AS size FROM e GROUP BY node""")
def a18(spark, d):
    return Q.rollup_by_directory(kb(spark, d, "docs").select(F.element_at("files", 1).alias("file"), F.length("content").cast("long").alias("size")), "size")


@query("a25_conflicts", """WITH l AS (SELECT * FROM docs WHERE id NOT IN (SELECT supersedes FROM docs WHERE supersedes IS NOT NULL)), r AS (SELECT id, row_number() OVER w AS r, first_value(id) OVER w AS winner FROM l
WINDOW w AS (PARTITION BY lower(title) ORDER BY (status = 'experimental') DESC, source_name, (provenance = 'human')::INT, updated_at DESC, n)) SELECT id, winner FROM r WHERE r > 1""")
def a25(spark, d):
    return Q.conflicts(kb(spark, d, "docs"), F.col("source_name").asc())


@query("a26_cost", "SELECT content_type AS kind, round(sum(length(content) * CASE content_type WHEN 'en' THEN 0.5 ELSE 2.0 END::DOUBLE / 1e6), 6) AS cost FROM docs GROUP BY 1")
def a26(spark, d):
    docs = kb(spark, d, "docs")
    rates = docs.select(F.col("content_type").alias("kind")).distinct().select("kind", F.when(F.col("kind") == "en", 0.5).otherwise(2.0).alias("rate"))
    return Q.cost(docs.select(F.col("content_type").alias("kind"), F.length("content").alias("tokens")), rates)


# --- windows over the event stream, as batch ------------------------------------------------------------------


@query("st_daily_window", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def st_day(spark, d):
    from quarry.streaming.events import windowed

    out = windowed(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


@query("st_session_window", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def st_sess(spark, d):
    from quarry.streaming.events import sessions

    out = sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
