"""Queries over vectors and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.catalog import query
from quarry.operators import cluster as K
from quarry.operators import usage as U
from quarry.operators import vector as V
from quarry.plans.tables import kb

_Q = "(SELECT v FROM vecs WHERE id = 0)"
_DOT = f"list_dot_product(CAST(v AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))"
_S = f"({_DOT} / sqrt(list_dot_product(CAST({_Q} AS DOUBLE[]), CAST({_Q} AS DOUBLE[]))))"
_COS = f"({_S} / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))))"


def _vq(spark, d):
    vecs = kb(spark, d, "vecs")
    return vecs, V.query_vector(vecs, 0)


def _meta(spark, d):
    return kb(spark, d, "docs").select(F.col("n").alias("id"), "provenance", "stale", "source_name")


@query("v01_cosine", f"SELECT id, round({_COS}, 6) AS score FROM vecs")
def v01(spark, d):
    vecs, q = _vq(spark, d)
    return V.with_scores(vecs, q).select("id", F.round("score", 6).alias("score"))


@query("v05_vector_topk", f"SELECT id, label, round({_S}, 6) AS score FROM vecs WHERE label < 7 ORDER BY {_S} DESC, id LIMIT 10")
def v05(spark, d):
    vecs, q = _vq(spark, d)
    return V.top_k(V.with_scores(vecs.where("label < 7"), q, unit=True), 10).select("id", "label", F.round("score", 6).alias("score"))


_STATS = """st AS (SELECT CAST(substr(doc_id, 2) AS BIGINT) AS id, count(*) AS served, count(*) FILTER (outcome = 'hit' AND score >= 5) AS hits
FROM (SELECT unnest(served) AS doc_id, outcome, score FROM usage) GROUP BY doc_id)"""
_PROV = "(CASE WHEN provenance = 'human' THEN 0.8 WHEN provenance = 'official' AND source_name NOT IN ('src1', 'src2') THEN 0.9 ELSE 1.0 END * CASE WHEN stale THEN 0.6 ELSE 1.0 END)::DOUBLE"


@query("v05_weighted_search", f"""WITH {_STATS} SELECT vecs.id, round({_S} * (CASE WHEN served IS NULL THEN 1.0 WHEN hits = 0 AND served >= 5 THEN 0.3 WHEN hits = 0 AND served >= 3 THEN 0.5
 ELSE 0.7 + 0.3::DOUBLE * hits / served END)::DOUBLE * {_PROV}, 6) AS score FROM vecs JOIN docs ON docs.n = vecs.id LEFT JOIN st ON st.id = vecs.id ORDER BY score DESC, vecs.id LIMIT 20""")
def v05w(spark, d):
    vecs, q = _vq(spark, d)
    st = U.hit_stats(kb(spark, d, "usage")).select(F.substring("doc_id", 2, 12).cast("long").alias("id"), "served", "hits")
    return V.weighted_search(vecs.select("id", "v"), _meta(spark, d), st, q, 20, ["src1", "src2"])


@query("v06_provenance", f"SELECT n AS id, round({_PROV}, 6) AS weight FROM docs")
def v06(spark, d):
    m = _meta(spark, d)
    return m.select("id", F.round(V.provenance_weight(F.col("provenance"), F.col("stale"), F.col("source_name"), ["src1", "src2"]), 6).alias("weight"))


@query("v07_search_chunks", f"""SELECT id, 'd' || (id % 100) AS document_id, round({_S}, 6) AS score FROM vecs JOIN docs ON docs.id = 'd' || (vecs.id % 100)
WHERE source_name IN ('src1', 'src3', 'src5') ORDER BY {_S} DESC, id LIMIT 12""".replace("SELECT id,", "SELECT vecs.id,").replace("(id % 100) AS", "(vecs.id % 100) AS").replace("DESC, id", "DESC, vecs.id"))
def v07(spark, d):
    vecs, q = _vq(spark, d)
    chunks = vecs.select("id", "v", F.concat(F.lit("d"), F.col("id") % 100).alias("document_id"))
    return V.search_chunks(chunks, kb(spark, d, "docs").select(F.col("id").alias("document_id"), "source_name"), q, 12, ["src1", "src3", "src5"])


@query("v09_rank_candidates", f"SELECT id, round({_S} * CASE WHEN label = 3 THEN 0.5 ELSE 1.0 END::DOUBLE, 6) AS score FROM vecs WHERE id % 3 = 0 ORDER BY score DESC, id LIMIT 15")
def v09(spark, d):
    vecs, q = _vq(spark, d)
    w = vecs.where("label = 3").select("id", F.lit(0.5).alias("weight"))
    return V.rank_candidates(vecs.select("id", "v"), vecs.where("id % 3 = 0").select("id"), w, q, 15)


@query("v11_relevant_sections", """WITH s AS (SELECT document_id, idx, content, ((idx * 37 + length(content)) % 100)::DOUBLE / 200 AS score FROM sections),
r AS (SELECT *, coalesce(score >= 0.3, false) AS good, max((score >= 0.3)::INT) OVER (PARTITION BY document_id) AS any_good,
 row_number() OVER (PARTITION BY document_id ORDER BY (length(trim(content)) < 40)::INT, idx) AS r FROM s)
SELECT document_id, idx, good AS relevant FROM r WHERE good OR (any_good = 0 AND r = 1)""")
def v11(spark, d):
    s = kb(spark, d, "sections").select("document_id", "idx", "content")
    return V.relevant_sections(s, s.select("document_id", "idx", (F.pmod(F.col("idx") * 37 + F.length("content"), F.lit(100)) / 200.0).alias("score")))


@query("v12_context_boost", f"SELECT vecs.id, round({_S} + CASE WHEN label = 2 THEN 0.15 ELSE 0 END::DOUBLE, 6) AS score FROM vecs")
def v12(spark, d):
    vecs, q = _vq(spark, d)
    return V.context_boost(V.with_scores(vecs, q, True), vecs.where("label = 2").select("id"))


@query("v13_scarcity_gate", f"""WITH s AS (SELECT {_S} AS score FROM vecs WHERE id > 0), t AS (SELECT max(score) AS top FROM s)
SELECT round(top, 6) AS top, (SELECT count(*) FROM s, t WHERE score >= 0.85::DOUBLE * top) AS near, (SELECT count(*) FROM s, t WHERE score >= 0.85::DOUBLE * top) < 3 OR top = 0 AS open FROM t""")
def v13(spark, d):
    vecs, q = _vq(spark, d)
    return V.scarcity_gate(V.with_scores(vecs.where("id > 0"), q, True))


@query("v13_rank_with_gate", f"""WITH s AS (SELECT id, {_S} AS score FROM vecs WHERE id > 0), p AS (SELECT * FROM s WHERE id % 2 = 0), t AS (SELECT max(score) AS top FROM p),
g AS (SELECT count(*) < 3 AS open FROM p, t WHERE score >= 0.85::DOUBLE * top)
SELECT id, round(score, 6) AS score FROM (SELECT * FROM p UNION ALL SELECT s.* FROM s, g WHERE id % 2 = 1 AND open) ORDER BY score DESC, id LIMIT 10""")
def v13r(spark, d):
    vecs, q = _vq(spark, d)
    s = V.with_scores(vecs.where("id > 0"), q, True)
    return V.rank_with_gate(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 10).select("id", F.round("score", 6).alias("score"))


@query("v14_select_ground")
def v14(spark, d):
    vecs, q = _vq(spark, d)
    return V.select_ground(spark, vecs.where("id > 3").select("id", "v"), vecs.where("id between 1 and 3"), q, k=8)


@query("v14_gate", f"""WITH a AS (SELECT v AS av FROM vecs WHERE id BETWEEN 1 AND 3),
n AS (SELECT id, max(list_dot_product(CAST(v AS DOUBLE[]), CAST(av AS DOUBLE[]))) AS near FROM vecs, a WHERE id > 3 GROUP BY id)
SELECT id, round(score, 6) AS score FROM (SELECT vecs.id, 0.6::DOUBLE * {_S} + 0.4::DOUBLE * near AS score FROM vecs JOIN n ON n.id = vecs.id) WHERE score >= 0.05""")
def v14g(spark, d):
    vecs, q = _vq(spark, d)
    return V.gate_candidates(vecs.where("id > 3").select("id", "v"), vecs.where("id between 1 and 3"), q, 0.6, 0.4, 0.05).select("id", F.round("score", 6).alias("score"))


@query("v15_anchored_rank", f"""WITH s AS (SELECT id, {_S} AS score FROM vecs WHERE id > 0), p AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 2 = 0),
g AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 2 = 1),
u AS (SELECT id, CASE WHEN r <= 4 THEN 0 ELSE 2 END AS part, r FROM p WHERE r <= 12 UNION ALL SELECT id, 1, r FROM g WHERE r <= 12)
SELECT id, row_number() OVER (ORDER BY part, r, id)::INTEGER AS position FROM u ORDER BY position LIMIT 12""")
def v15(spark, d):
    vecs, q = _vq(spark, d)
    s = V.with_scores(vecs.where("id > 0"), q, True).select("id", "score")
    return V.anchored_rank(s.where("id % 2 = 0"), s.where("id % 2 = 1"), 4, 12)


@query("v16_centroid", "SELECT i - 1 AS i, round(avg(CAST(v[i] AS DOUBLE)), 6) AS x FROM (SELECT v, unnest(generate_series(1, 64)) AS i FROM vecs WHERE label = 1) GROUP BY i")
def v16(spark, d):
    c = V.centroid(kb(spark, d, "vecs").where("label = 1"))
    return c.select(F.posexplode("v").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("v17_breadth", f"""WITH s AS (SELECT {_S} AS score FROM vecs WHERE id > 0 ORDER BY score DESC LIMIT 50)
SELECT count(*) AS n, count(*) FILTER (score > 0.2) AS above, max(score) >= 0.3 AND count(*) FILTER (score > 0.2) >= greatest(1, floor(count(*) / 4)) AS speaks FROM s""")
def v17(spark, d):
    vecs, q = _vq(spark, d)
    return V.breadth_speaks(V.with_scores(vecs.where("id > 0"), q, True), 0.2, floor=0.3)


@query("v19_doc_grade", "SELECT id FROM docs WHERE content_type <> 'en' UNION SELECT 'd' || id FROM vecs WHERE label = 4")
def v19(spark, d):
    docs = kb(spark, d, "docs").select("id", F.when(F.col("content_type") == "en", "catalog").otherwise(F.col("content_type")).alias("content_type"), F.lit(None).cast("string").alias("kind"))
    return V.doc_grade_candidates(docs, kb(spark, d, "vecs").where("label = 4").select(F.concat(F.lit("d"), "id").alias("id")))


_TERMS = "(VALUES ('billing', 0), ('Invoice', 1), ('export', 2)) AS t(term, pos)"
_VOCAB = "(SELECT feature AS name, 'feature' AS layer, id FROM docs UNION ALL SELECT aliases[1], 'alias', id FROM docs) AS voc"


def _terms(spark):
    return spark.createDataFrame([("billing", 0), ("Invoice", 1), ("export", 2)], "term string, pos int")


def _vocab(spark, d):
    docs = kb(spark, d, "docs")
    return docs.select(F.col("feature").alias("name"), F.lit("feature").alias("layer"), "id").unionByName(docs.select(F.element_at("aliases", 1).alias("name"), F.lit("alias").alias("layer"), "id"))


@query("v20_entity_docs", f"""WITH j AS (SELECT term, pos, layer, id, row_number() OVER (PARTITION BY term, layer ORDER BY id) AS r FROM {_TERMS} JOIN {_VOCAB} ON lower(term) = lower(name))
SELECT id, arg_min(term, pos) AS term FROM j WHERE r <= 3 GROUP BY id""")
def v20(spark, d):
    return V.entity_documents(_terms(spark), _vocab(spark, d))


@query("v21_select_docs", f"""WITH s AS (SELECT id, {_S} AS score FROM vecs WHERE id > 0), e AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 5 = 0 QUALIFY r <= 8),
m AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.1 AND id NOT IN (SELECT id FROM e WHERE r <= 4) QUALIFY r <= 8),
u AS (SELECT id, CASE WHEN r <= 4 THEN 0 ELSE 2 END AS part, r FROM e UNION ALL SELECT id, 1, r FROM m), o AS (SELECT id, min(part * 1000 + r) AS k FROM u GROUP BY id)
SELECT id, row_number() OVER (ORDER BY k, id)::INTEGER AS position FROM o ORDER BY position LIMIT 8""")
def v21(spark, d):
    vecs, q = _vq(spark, d)
    s = V.with_scores(vecs.where("id > 0"), q, True).select("id", "score")
    return V.select_documents(s.where("id % 5 = 0"), s, 8, floor=0.1)


@query("v22_candidate_terms", """WITH t AS (SELECT id AS qid, regexp_extract_all(title, '[A-Za-z0-9_.]+') AS w FROM docs), g AS (SELECT qid, n, p, w[p + 1 : p + n] AS g FROM (SELECT qid, w, n, unnest(generate_series(0, len(w) - n)) AS p FROM t, range(1, 4) r(n) WHERE len(w) >= n))
SELECT qid, p::INTEGER AS pos, n::INTEGER AS n, array_to_string(g, ' ') AS term FROM g WHERE lower(g[1]) NOT IN ('the', 'of', 'is', 'a', 'in') AND lower(g[-1]) NOT IN ('the', 'of', 'is', 'a', 'in')""")
def v22(spark, d):
    q = kb(spark, d, "docs").select(F.col("id").alias("qid"), F.col("title").alias("question"))
    return V.candidate_terms(q, ["the", "of", "is", "a", "in"])


@query("v22_maximal_munch", """WITH t AS (SELECT id AS qid, n % 4 AS pos, 1 + n % 3 AS n, title AS term FROM docs)
SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.qid = a.qid AND b.n > a.n AND b.pos <= a.pos AND b.pos + b.n >= a.pos + a.n)""")
def v22m(spark, d):
    t = kb(spark, d, "docs").select(F.col("id").alias("qid"), (F.col("n") % 4).alias("pos"), (1 + F.col("n") % 3).alias("n"), F.col("title").alias("term"))
    return V.maximal_munch(t)


@query("v23_entity_index", f"SELECT term, layer, min(id) AS id FROM {_TERMS} JOIN {_VOCAB} ON lower(term) = lower(name) GROUP BY term, layer")
def v23(spark, d):
    return V.resolve_entities(_terms(spark), _vocab(spark, d))


@query("v24_merge_lists", f"""WITH s AS (SELECT id, {_S} AS score FROM vecs WHERE id > 0), p AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 2 = 0 QUALIFY r <= 7),
l AS (SELECT id, 10 + row_number() OVER (ORDER BY score DESC, id) AS r FROM s WHERE id % 3 = 0 AND id NOT IN (SELECT id FROM p) QUALIFY r <= 13), u AS (SELECT * FROM p UNION ALL SELECT * FROM l)
SELECT id, round((count(*) OVER () - (row_number() OVER (ORDER BY r) - 1)) / count(*) OVER (), 6) AS score FROM u""")
def v24(spark, d):
    vecs, q = _vq(spark, d)
    s = V.with_scores(vecs.where("id > 0"), q, True).select("id", "score")
    return V.merge_lists(s.where("id % 2 = 0"), s.where("id % 3 = 0"), 10)


@query("v25_route_max", f"SELECT label, round(max({_COS}), 6) AS score FROM vecs WHERE id > 0 GROUP BY label HAVING round(max({_COS}), 6) >= 0.2 ORDER BY score DESC, label LIMIT 3")
def v25(spark, d):
    vecs, q = _vq(spark, d)
    return V.route_aisles(vecs.where("id > 0"), "label", q, floor=0.2)


@query("v26_nearest", f"SELECT id, round({_COS}, 6) AS score FROM vecs WHERE label = 5 ORDER BY score DESC, id LIMIT 10")
def v26(spark, d):
    vecs, q = _vq(spark, d)
    return V.nearest(vecs.where("label = 5"), q, 10).select("id", "score")


@query("v27_topk_per_group", f"""SELECT label, id, score FROM (SELECT label, id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY label ORDER BY round({_COS}, 6) DESC, id) AS r
FROM vecs WHERE id > 0) WHERE r = 1 AND score >= 0.1 ORDER BY score DESC, id LIMIT 6""")
def v27(spark, d):
    vecs, q = _vq(spark, d)
    return V.nearest_per_key(vecs.where("id > 0"), "label", q, 6, floor=0.1)


_CAMEL = "list_distinct(list_transform(regexp_extract_all(regexp_replace({t}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda w: regexp_replace(lower(w), '^(.{{3,}})s$', '\\1')))"


@query("v28_idf_overlap", f"""WITH q AS (SELECT unnest({_CAMEL.format(t="'The thing inOrder of theStation'")}) AS tok), d AS (SELECT id, unnest({_CAMEL.format(t="title")}) AS tok FROM docs), h AS (SELECT * FROM d WHERE tok IN (SELECT tok FROM q)),
f AS (SELECT tok, count(*) AS df FROM h GROUP BY tok), w AS (SELECT tok, 1 + ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (coalesce(df, 0) + 1)) AS w FROM q LEFT JOIN f USING (tok))
SELECT id, round(sum(w) / (SELECT sum(w) FROM w), 6) AS score FROM h JOIN w USING (tok) GROUP BY id""")
def v28(spark, d):
    return V.idf_overlap(kb(spark, d, "docs").select("id", F.col("title").alias("text")), "The thing inOrder of theStation")


@query("v29_pseudo_semantic", f"""WITH s AS (SELECT id, v, {_COS} AS score FROM vecs WHERE label = 1 ORDER BY score DESC, id LIMIT 6), c AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, sum(v[i]::DOUBLE * score) / sum(score) AS x FROM s, range(1, 65) r(i) GROUP BY i)),
n AS (SELECT id, round(list_dot_product(m, CAST(v AS DOUBLE[])) / sqrt(list_dot_product(m, m)) / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 6) AS score FROM vecs, c ORDER BY score DESC, id LIMIT 12),
u AS (SELECT id, 0 AS part, score FROM s UNION ALL SELECT id, 1, score FROM n WHERE id NOT IN (SELECT id FROM s))
SELECT id, row_number() OVER (ORDER BY part, score DESC, id)::INTEGER AS position FROM u QUALIFY position <= 6""")
def v29(spark, d):
    vecs, q = _vq(spark, d)
    return V.pseudo_semantic(spark, vecs.select("id", "v"), V.with_scores(vecs.where("label = 1"), q).select("id", "score"), 6)


@query("v30_scoped_candidates", """WITH s AS (SELECT id FROM docs WHERE content_type = 'de' ORDER BY length(title) DESC, id LIMIT 10)
SELECT id FROM (SELECT id FROM s UNION SELECT target_id FROM doc_graph WHERE source_id IN (SELECT id FROM s) UNION SELECT source_id FROM doc_graph WHERE target_id IN (SELECT id FROM s)) ORDER BY id LIMIT 20""")
def v30(spark, d):
    lex = kb(spark, d, "docs").where("content_type = 'de'").select("id", F.length("title").alias("score"))
    return V.scoped_candidates(lex, kb(spark, d, "doc_graph"), 10)


@query("v31_positioning", """WITH dg AS (SELECT source_id AS id, count(*) AS degree FROM doc_graph GROUP BY source_id),
j AS (SELECT docs.id, files[2] AS file, round(length(title)::DOUBLE / 100 + least(coalesce(degree, 0), 50)::DOUBLE / 1000, 6) AS score FROM docs LEFT JOIN dg USING (id))
SELECT file, id, score FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id DESC) AS r FROM j) WHERE r = 1 ORDER BY score DESC, id LIMIT 10""")
def v31(spark, d):
    docs = kb(spark, d, "docs")
    degree = kb(spark, d, "doc_graph").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return V.positioning(docs.select("id", F.element_at("files", 2).alias("file")), docs.select("id", (F.length("title") / 100.0).alias("score")), degree)


@query("v32_text_fallback", """SELECT id, score FROM (SELECT id, (CASE WHEN lower(title) = 'of the' THEN 10 ELSE 0 END + CASE WHEN contains(lower(title), 'of the') THEN 5 ELSE 0 END
 + CASE WHEN contains(lower(title), 'of') THEN 2 ELSE 0 END + CASE WHEN contains(lower(title), 'the') THEN 2 ELSE 0 END) AS score FROM docs) WHERE score > 0""")
def v32(spark, d):
    return V.text_fallback(kb(spark, d, "docs"), "of the")


@query("v33_text_search", """SELECT id, score FROM (SELECT id, (CASE WHEN contains(lower(title), 'ing') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(substr(content, 1, 3000)), 'ing') THEN 0.5 ELSE 0 END
 + CASE WHEN contains(lower(title), 'station') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(substr(content, 1, 3000)), 'station') THEN 0.5 ELSE 0 END)::DOUBLE AS score FROM docs)
WHERE score > 0 ORDER BY score DESC, id LIMIT 25""")
def v33(spark, d):
    return V.text_search(kb(spark, d, "docs"), "ing station", 25)


@query("v34_rank_symbols", """SELECT * FROM (SELECT DISTINCT name, (CASE WHEN name = 'Order12' THEN 1.0 WHEN lower(name) = 'order12' THEN 0.95 WHEN lower(string_split(name, '.')[-1]) = 'order12' THEN 0.9
WHEN starts_with(lower(name), 'order12') THEN 0.8 WHEN contains(lower(name), 'order12') THEN 0.7 END)::DOUBLE AS score FROM symbols) WHERE score IS NOT NULL""")
def v34(spark, d):
    return V.rank_symbols(kb(spark, d, "symbols").select("name"), "Order12")


@query("v34_fuzzy_symbols")
def v34f(spark, d):
    return V.fuzzy_symbols(kb(spark, d, "symbols").select("name"), "Ordr12", 25)


@query("v35_resolve_symbol", """WITH t AS (SELECT id, qname, CASE WHEN qname = 'Order7.line1' THEN 0 WHEN ends_with(qname, '.Order7.line1') THEN 1 WHEN contains(qname, 'Order7.line1') THEN 2 END AS tier FROM symbols),
b AS (SELECT * FROM t WHERE tier = (SELECT min(tier) FROM t)) SELECT *, count(*) OVER () = 1 AS is_unique FROM b""")
def v35(spark, d):
    return V.resolve_symbol(kb(spark, d, "symbols"), "Order7.line1")


@query("v36_confidence", f"SELECT CASE WHEN max(s) IS NULL THEN 'medium' WHEN max(s) > 0.6 THEN 'high' WHEN max(s) > 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT {_S} AS s FROM vecs WHERE id > 0)")
def v36(spark, d):
    vecs, q = _vq(spark, d)
    return V.confidence_bucket(V.with_scores(vecs.where("id > 0"), q, True))


@query("v37_richness", """SELECT id, round(n % 10 + CASE WHEN contains(content, '```mermaid') THEN 1.0 ELSE 0 END + 0.3 * least(len(list_distinct(regexp_extract_all(content, '[A-Za-z_]+[.](?:py|js|go|scala)'))), 4)
 + CASE WHEN length(content) > 2000 THEN 1.0 WHEN length(content) > 500 THEN 0.5 ELSE 0 END, 6)::DOUBLE AS richness FROM docs""")
def v37(spark, d):
    return V.richness(kb(spark, d, "docs").select("id", F.col("content").alias("text"), (F.col("n") % 10).cast("double").alias("score")))


@query("v38_hints", f"""SELECT n, array_to_string(list_filter(list_value(CASE WHEN n < 3 THEN 'few results' END, CASE WHEN top < 0.35 THEN 'no close match' END, CASE WHEN top BETWEEN 0.35 AND 0.5 THEN 'weak match' END),
 lambda x: x IS NOT NULL), ', ') AS hints FROM (SELECT count(*) AS n, coalesce(max({_S}), 0) AS top FROM vecs WHERE id > 0)""")
def v38(spark, d):
    vecs, q = _vq(spark, d)
    return V.poor_result_hints(V.with_scores(vecs.where("id > 0"), q, True))


@query("v39_route_sections", f"SELECT id % 12 AS route, round(max({_COS}), 6) AS score FROM vecs GROUP BY route")
def v39(spark, d):
    vecs, q = _vq(spark, d)
    return V.route_section_scores(vecs.select("id", (F.col("id") % 12).alias("route")), vecs.select("id", "v"), q)


_PAIR = "list_dot_product(CAST(x.v AS DOUBLE[]), CAST(y.v AS DOUBLE[]))"
_KNN = f"""k AS (SELECT a, b, sim FROM (SELECT x.id AS a, y.id AS b, round({_PAIR}, 6) AS sim, row_number() OVER (PARTITION BY x.id ORDER BY round({_PAIR}, 6) DESC, y.id) AS r
FROM vecs x JOIN vecs y ON x.id <> y.id WHERE {_PAIR} >= 0.2) WHERE r <= 5), e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM k GROUP BY 1, 2)"""


def _knn(spark, d):
    vecs = kb(spark, d, "vecs").select("id", "v")
    return K.knn_edges(vecs, vecs, 5, 0.2)


@query("k01_knn_edges", f"WITH {_KNN} SELECT * FROM e")
def k01(spark, d):
    return _knn(spark, d)


@query("k02_update_edges", f"WITH {_KNN.replace('x.id <> y.id', 'x.id <> y.id AND x.id % 10 = 0')} SELECT * FROM e")
def k02(spark, d):
    vecs = kb(spark, d, "vecs").select("id", "v")
    changed = vecs.where("id % 10 = 0")
    new = K.knn_edges(changed, vecs, 5, 0.2)
    return K.replace_edges(new.limit(0), new, changed)


@query("k03_delete_any", "SELECT * FROM doc_graph WHERE source_id NOT IN (SELECT id FROM docs WHERE content_type = 'de') AND target_id NOT IN (SELECT id FROM docs WHERE content_type = 'de')")
def k03(spark, d):
    return K.edges_touching(kb(spark, d, "doc_graph"), kb(spark, d, "docs").where("content_type = 'de'"), both=False)


@query("k03_delete_both", "SELECT * FROM doc_graph WHERE NOT (source_id IN (SELECT id FROM docs WHERE content_type = 'en') AND target_id IN (SELECT id FROM docs WHERE content_type = 'en'))")
def k03b(spark, d):
    return K.edges_touching(kb(spark, d, "doc_graph"), kb(spark, d, "docs").where("content_type = 'en'"), both=True)


@query("k04_index_stamp", "SELECT count(*) AS n, sum(('0x' || substr(sha256(id || '|' || CAST(updated_at AS VARCHAR)), 1, 12))::BIGINT)::DECIMAL(38,0) AS stamp FROM docs")
def k04(spark, d):
    return K.index_stamp(kb(spark, d, "docs").select("id", F.col("updated_at").cast("string").alias("updated_at")))


@query("k04_ann_search")
def k04s(spark, d):
    """Rows whose id is divisible by 20 as queries against all rows; tests hold its recall against brute force."""
    vecs = kb(spark, d, "vecs").select("id", "v")
    return K.ann_search(vecs.where("id % 20 = 0"), vecs, 10)


@query("k05_similar_pairs", f"SELECT x.id AS a, y.id AS b, round({_PAIR}, 4) AS sim FROM vecs x JOIN vecs y ON x.id < y.id WHERE {_PAIR} >= 0.35 ORDER BY sim DESC, a, b LIMIT 50")
def k05(spark, d):
    return K.similar_pairs(kb(spark, d, "vecs").select("id", "v"), 0.35)


_HYB = """h AS (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, sum(CASE edge_type WHEN 'semantic' THEN weight * 0.5::DOUBLE ELSE weight END) AS weight FROM doc_graph
WHERE source_id <> target_id AND source_id IN (SELECT id FROM docs) AND target_id IN (SELECT id FROM docs) GROUP BY 1, 2)"""


def _hybrid(spark, d):
    return K.hybrid_graph(kb(spark, d, "doc_graph"), kb(spark, d, "docs"))


@query("k06_hybrid_graph", f"WITH {_HYB} SELECT a, b, round(weight, 6) AS weight FROM h")
def k06(spark, d):
    return _hybrid(spark, d).withColumn("weight", F.round("weight", 6))


@query("k07_communities")
def k07(spark, d):
    e = _knn(spark, d)
    return K.communities(e.select("a", "b", F.col("sim").alias("weight")))


_MEM = "m AS (SELECT id, 'k' || (n % 40 * (n % 3)) AS cluster FROM docs)"


def _members(spark, d):
    return kb(spark, d, "docs").select("id", F.concat(F.lit("k"), F.col("n") % 40 * (F.col("n") % 3)).alias("cluster"))


@query("k08_tiny_reassign", f"""WITH {_HYB}, {_MEM}, s AS (SELECT cluster, count(*) AS size FROM m GROUP BY cluster), g AS (SELECT a, b, weight FROM h UNION ALL SELECT b, a, weight FROM h),
p AS (SELECT g.a, big.cluster AS dest, round(sum(weight), 9) AS w FROM g JOIN m t ON t.id = g.a JOIN s ts ON ts.cluster = t.cluster AND ts.size < 20 JOIN m big ON big.id = g.b JOIN s bs ON bs.cluster = big.cluster AND bs.size >= 20 GROUP BY 1, 2),
b AS (SELECT a, dest FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, dest) AS r FROM p) WHERE r = 1) SELECT id, coalesce(dest, cluster) AS cluster FROM m LEFT JOIN b ON b.a = m.id""")
def k08(spark, d):
    return K.reassign_tiny(_members(spark, d), _hybrid(spark, d), 20)


@query("k09_overlaps", f"""WITH {_MEM}, o AS (SELECT id, 'p' || (n % 35 * (n % 3)) AS cluster FROM docs), b AS (SELECT m.cluster AS new, o.cluster AS old, count(*) AS c FROM m JOIN o USING (id) GROUP BY 1, 2)
SELECT new, old, nn AS n_new, round(c / (nn + no - c), 6) AS overlap FROM b JOIN (SELECT cluster AS new, count(*) AS nn FROM m GROUP BY 1) USING (new) JOIN (SELECT cluster AS old, count(*) AS no FROM o GROUP BY 1) USING (old)""")
def k09(spark, d):
    old = kb(spark, d, "docs").select("id", F.concat(F.lit("p"), F.col("n") % 35 * (F.col("n") % 3)).alias("cluster"))
    return K.overlaps(_members(spark, d), old)


@query("k09_stable_ids", f"""WITH {_MEM}, o AS (SELECT * FROM m WHERE id LIKE '%1%' OR id LIKE '%2%'), nn AS (SELECT cluster AS new, count(*) AS n_new, substr(sha256(min(id)), 1, 12) AS fresh FROM m GROUP BY 1), no AS (SELECT cluster AS old, count(*) AS n_old FROM o GROUP BY 1),
v AS (SELECT new, old, n_new, round(c / (n_new + n_old - c), 6) AS overlap FROM (SELECT m.cluster AS new, o.cluster AS old, count(*) AS c FROM m JOIN o USING (id) GROUP BY 1, 2) JOIN nn USING (new) JOIN no USING (old)),
a AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY overlap DESC, old) AS r FROM v WHERE overlap >= 0.5), b AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY n_new DESC, overlap DESC, new) AS q FROM a WHERE r = 1)
SELECT nn.new AS cluster, coalesce(b.old, fresh) AS stable_id FROM nn LEFT JOIN b ON b.new = nn.new AND q = 1""")
def k09s(spark, d):
    return K.stable_ids(_members(spark, d), _members(spark, d).where("id like '%1%' or id like '%2%'"))


@query("k10_membership_diff", f"""WITH {_MEM}, nw AS (SELECT * FROM m WHERE id NOT LIKE '%7'), od AS (SELECT id, CASE WHEN id LIKE '%3' THEN 'x' ELSE cluster END AS cluster FROM m WHERE id NOT LIKE '%9')
SELECT id, CASE WHEN od.cluster IS NULL THEN 'new' WHEN nw.cluster IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM nw FULL JOIN od USING (id) WHERE od.cluster IS DISTINCT FROM nw.cluster""")
def k10(spark, d):
    m = _members(spark, d)
    return K.membership_diff(m.where("id not like '%7'"), m.where("id not like '%9'").withColumn("cluster", F.when(F.col("id").like("%3"), "x").otherwise(F.col("cluster"))))


@query("k11_two_sided", "SELECT 'k' || (n % 40) AS cluster FROM docs GROUP BY 1 HAVING max((source_name = 'src1')::INT) = 1 AND min((source_name = 'src1')::INT) = 0")
def k11(spark, d):
    m = kb(spark, d, "docs").select(F.concat(F.lit("k"), F.col("n") % 40).alias("cluster"), "source_name")
    return K.two_sided(m, F.col("source_name") == "src1")


@query("k12_local_reassign", f"""WITH {_HYB}, {_MEM}, g AS (SELECT a, b, weight FROM h UNION ALL SELECT b, a, weight FROM h), p AS (SELECT g.a, m.cluster, round(sum(weight), 9) AS w FROM g JOIN m ON m.id = g.b WHERE g.a LIKE '%5' GROUP BY 1, 2)
SELECT a AS id, cluster, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, cluster) AS r FROM p) WHERE r = 1""")
def k12(spark, d):
    m = _members(spark, d)
    return K.local_reassign(m.where("id like '%5'"), _hybrid(spark, d), m)


@query("k13_changed", "SELECT d.id FROM (SELECT id, md5(title) AS hash FROM docs) d LEFT JOIN (SELECT id, CASE WHEN n % 4 = 0 THEN 'old' ELSE md5(title) END AS h FROM docs WHERE n % 5 <> 0) s USING (id) WHERE h IS NULL OR h <> d.hash")
def k13(spark, d):
    docs = kb(spark, d, "docs")
    synced = docs.where("n % 5 <> 0").select("id", F.when(F.col("n") % 4 == 0, "old").otherwise(F.md5("title")).alias("hash"))
    return K.changed_elements(docs.select("id", F.md5("title").alias("hash")), synced)


@query("k14_summary_hash", f"""WITH {_MEM} SELECT cluster, sha256(sum(('0x' || substr(sha256(id), 1, 12))::BIGINT)::VARCHAR || '|' || count(*) || '|s') AS summary_hash FROM m GROUP BY cluster""")
def k14(spark, d):
    return K.summary_hash(_members(spark, d), _members(spark, d).groupBy("cluster").agg(F.lit("s").alias("summary")))


@query("k15_kmeans")
def k15(spark, d):
    return K.spherical_kmeans(kb(spark, d, "vecs"), 10)


@query("k15_label_words", """WITH w AS (SELECT source_name AS cluster, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS word FROM docs), n AS (SELECT cluster, word, count(*) AS n FROM w WHERE length(word) > 2 AND word NOT IN ('the', 'and', 'for') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS r FROM n) SELECT cluster, string_agg(word, ' ' ORDER BY r) AS label FROM r WHERE r <= 3 GROUP BY cluster""")
def k15l(spark, d):
    docs = kb(spark, d, "docs")
    return K.cluster_labels(docs.select("id", F.col("source_name").alias("cluster")), docs.select("id", "title"), ["the", "and", "for"])


@query("k16_list_themes", """WITH m AS (SELECT cluster_id, source_name FROM theme_members JOIN docs ON docs.id = element_id), n AS (SELECT cluster_id, count(*) AS members, count(DISTINCT source_name) AS sources FROM m GROUP BY 1)
SELECT t.cluster_id, dirty, association, members, sources FROM themes t JOIN n USING (cluster_id) WHERE cluster_id IN (SELECT cluster_id FROM m WHERE source_name = 'src2')""")
def k16(spark, d):
    return K.theme_listing(kb(spark, d, "themes"), kb(spark, d, "theme_members"), kb(spark, d, "docs"), "src2")


@query("k17_coherence", """SELECT count(*) FILTER (coherent) AS coherent, count(*) FILTER (NOT coherent) AS incoherent, count(*) FILTER (coherent IS NULL) AS unjudged,
round(count(*) FILTER (coherent) / count(*) FILTER (coherent IS NOT NULL), 6) AS rate FROM themes""")
def k17(spark, d):
    return K.coherence_counts(kb(spark, d, "themes"))


@query("k18_cross_references", """WITH i AS (SELECT source_id AS a, target_id AS b FROM doc_graph WHERE edge_type = 'import'), m AS (SELECT source_id AS a, target_id AS b FROM doc_graph WHERE edge_type = 'documents'),
s AS (SELECT source_id AS a, target_id AS b FROM doc_graph), u AS (SELECT *, 0 AS p, 'import' AS kind FROM i UNION ALL SELECT *, 1, 'mention' FROM m UNION ALL SELECT *, 2, 'semantic' FROM s)
SELECT a, b, arg_min(kind, p) AS kind FROM u WHERE a <> b GROUP BY a, b""")
def k18(spark, d):
    g = kb(spark, d, "doc_graph").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_type")
    return K.cross_references(g.where("edge_type = 'import'"), g.where("edge_type = 'documents'"), g)


@query("k19_related_section", """WITH r AS (SELECT source_id AS a, string_agg(DISTINCT '- ' || title, chr(10) ORDER BY '- ' || title) AS related FROM doc_graph JOIN docs ON docs.id = target_id WHERE edge_type = 'semantic' GROUP BY 1)
SELECT id, sha256(CASE WHEN related IS NOT NULL THEN content || chr(10) || chr(10) || '## Related' || chr(10) || related ELSE content END) AS h FROM docs LEFT JOIN r ON r.a = docs.id""")
def k19(spark, d):
    docs = kb(spark, d, "docs")
    refs = kb(spark, d, "doc_graph").where("edge_type = 'semantic'").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    return K.inject_references(docs, refs, docs.select("id", "title")).select("id", F.sha2("content", 256).alias("h"))


@query("j11_theta_pairs", f"SELECT x.id AS a, y.id AS b, round({_PAIR}, 6) AS sim FROM vecs x JOIN vecs y ON x.id < y.id WHERE round({_PAIR}, 6) >= 0.1")
def j11(spark, d):
    return K.theta_pairs(kb(spark, d, "vecs").select("id", "v"), 0.1)
