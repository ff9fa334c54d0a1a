"""Vector scoring, ranking and search."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import camel_tokens, confidence_rank

BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 16 << 20
GATE_ANCHORS = 256


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts and arrays by their length."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind.startswith("array"):
            size = size + 8 * F.greatest(F.size(f"`{f.name}`"), F.lit(0))
    return size


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only where the table has a proven small size, in rows and bytes; otherwise left to the optimizer."""
    found = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found["n"] <= limit and found["size"] <= most else df


def dot(a: Column, b: Column) -> Column:
    prod = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector on either side gives 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def lit_vector(v: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in v))


def query_vector(vecs: DataFrame, id_: int) -> list[float]:
    row = vecs.where(F.col("id") == id_).select("v").first()
    return [float(x) for x in row["v"]] if row else []


def with_scores(vecs: DataFrame, q: list[float], unit: bool = False) -> DataFrame:
    """``score`` against one query; with ``unit`` the rows are taken as normalised."""
    length = float(np.sqrt(sum(x * x for x in q)))
    if length == 0:
        return vecs.withColumn("score", F.lit(0.0))
    qn = lit_vector([x / length for x in q])
    return vecs.withColumn("score", dot(F.col("v"), qn) if unit else cosine(F.col("v"), qn))


def top_k(df: DataFrame, k: int, score: str = "score", id_: str = "id") -> DataFrame:
    """Ties by id; becomes TakeOrderedAndProject, so no full sort."""
    return df.orderBy(F.desc(score), id_).limit(k)


def usage_weight(served: Column, hits: Column) -> Column:
    """1 unserved; 0.3 or 0.5 for never helpful; else 0.7 + 0.3 hits / served."""
    return (
        F.when(served == 0, 1.0).when((hits == 0) & (served >= 5), 0.3).when((hits == 0) & (served >= 3), 0.5).otherwise(0.7 + 0.3 * hits / served)
    )


def provenance_weight(provenance: Column, stale: Column, source: Column, environment: list[str]) -> Column:
    """Human 0.8; official 0.9 outside environment sources; stale auto documents 0.6."""
    p = F.when(provenance == "human", 0.8).when((provenance == "official") & ~F.coalesce(source.isin(environment), F.lit(False)), 0.9).otherwise(1.0)
    return p * F.when(stale, 0.6).otherwise(1.0)


def weighted_search(vecs: DataFrame, meta: DataFrame, stats: DataFrame, q: list[float], k: int, environment: list[str] = ()) -> DataFrame:
    """Similarity x usage weight x provenance weight, then top k."""
    j = with_scores(vecs, q, unit=True).join(meta, "id").join(stats, "id", "left")
    served, hits = F.coalesce("served", F.lit(0)), F.coalesce("hits", F.lit(0))
    w = usage_weight(served, hits) * provenance_weight(F.col("provenance"), F.col("stale"), F.col("source_name"), list(environment))
    return top_k(j.select("id", F.round(F.col("score") * w, 6).alias("score")), k)


def search_chunks(chunks: DataFrame, parents: DataFrame, q: list[float], k: int, sources: list[str] | None = None) -> DataFrame:
    """Chunk top-k with parents; parents repeat. An empty source list gives no rows."""
    if sources is not None:
        chunks = chunks.join(parents.where(F.col("source_name").isin(list(sources)) if sources else F.lit(False)).select("document_id"), "document_id", "left_semi")
    return top_k(with_scores(chunks, q, unit=True), k).join(parents, "document_id").select("id", "document_id", F.round("score", 6).alias("score"))


def rank_candidates(vecs: DataFrame, candidates: DataFrame, weights: DataFrame, q: list[float], k: int) -> DataFrame:
    """Candidates that have a vector, weight times similarity, top k."""
    j = with_scores(vecs.join(candidates, "id", "left_semi"), q, unit=True).join(weights, "id", "left")
    return top_k(j.select("id", F.round(F.col("score") * F.coalesce("weight", F.lit(1.0)), 6).alias("score")), k)


def relevant_sections(sections: DataFrame, scores: DataFrame, floor: float = 0.3, min_body: int = 40) -> DataFrame:
    """Sections over the floor in document order; a document with none shows its first section with body text, else its first."""
    j = sections.join(scores, ["document_id", "idx"], "left")
    w = Window.partitionBy("document_id")
    good = F.coalesce(F.col("score") >= floor, F.lit(False))
    rank = F.row_number().over(w.orderBy((F.length(F.trim("content")) < min_body).cast("int"), "idx"))
    j = j.withColumns({"any_good": F.max(good.cast("int")).over(w), "good": good, "r": rank})
    return j.where("good or (any_good = 0 and r = 1)").select("document_id", "idx", F.col("good").alias("relevant"))


def context_boost(scored: DataFrame, near: DataFrame, boost: float = 0.15) -> DataFrame:
    """Add a boost to documents of the context file and its neighbours."""
    flag = near.select("id").distinct().withColumn("near", F.lit(True))
    return scored.join(flag, "id", "left").select("id", F.round(F.col("score") + F.when(F.col("near"), boost).otherwise(0.0), 6).alias("score"))


def scarcity_gate(scored: DataFrame, share: float = 0.85, least: int = 3) -> DataFrame:
    """One row; open iff empty, top score 0, or fewer than ``least`` rows reach ``share`` of the top."""
    top = scored.agg(F.max("score").alias("top"))
    n = scored.crossJoin(F.broadcast(top)).agg(F.sum((F.col("score") >= share * F.col("top")).cast("long")).alias("near"), F.max("top").alias("top"))
    return n.select(F.round("top", 6).alias("top"), F.coalesce("near", F.lit(0)).alias("near"), (F.col("top").isNull() | (F.col("top") == 0) | (F.col("near") < least)).alias("open"))


def rank_with_gate(primary: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Only when the gate is open are second-tier rows ranked along."""
    gate = scarcity_gate(primary).select("open")
    extra = second.join(F.broadcast(gate.where("open")), how="left_semi", on=F.lit(True))
    return top_k(primary.select("id", "score").unionByName(extra.select("id", "score")), k)


def gate_candidates(ground: DataFrame, anchors: DataFrame, q: list[float] | None, w_query: float, w_anchor: float, gate: float) -> DataFrame:
    """V14, first half: combined = (w_q q.v + w_a max anchor.v) weight, kept over the gate.

    The anchors are a handful of selected rows, which are broadcast; beyond ``GATE_ANCHORS`` of them both sides are
    compared by pairs of blocks.
    """
    if anchors.limit(GATE_ANCHORS + 1).count() <= GATE_ANCHORS:
        best = ground.crossJoin(F.broadcast(anchors.select(F.col("v").alias("av")))).groupBy("id").agg(F.max(dot(F.col("v"), F.col("av"))).alias("near"))
    else:
        from quarry.operators.cluster import blocked_pairs

        apart = anchors.select((-1 - F.col("id")).alias("id"), "v")
        best = blocked_pairs(ground.select("id", "v"), apart, -np.inf, 1).groupBy(F.col("a").alias("id")).agg(F.max("sim").alias("near"))
    j = with_scores(ground, q, True).withColumnRenamed("score", "sim") if q else ground.withColumn("sim", F.lit(0.0))
    j = j.join(best, "id").withColumn("score", w_query * F.col("sim") + w_anchor * F.col("near"))
    return j.where(F.col("score") >= gate).select("id", "v", "score")


def mmr(rows: list[tuple], k: int, diversity: float) -> list[tuple]:
    """V14, second half, on a ranked window of (id, vector, score): greedy argmax of score - diversity * closest chosen."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    m = np.array([r[1] for r in rows], float)
    close, out, left = np.zeros(len(rows)), [], list(range(len(rows)))
    while left and len(out) < k:
        best = max(left, key=lambda i: (rows[i][2] - diversity * close[i], -i))
        out.append((rows[best][0], round(float(rows[best][2] - diversity * close[best]), 6)))
        left.remove(best)
        close = np.maximum(close, m @ m[best]) if len(out) > 1 else m @ m[best]
    return out


def select_ground(spark, ground, anchors, q, k=5, window=50, w_query=0.6, w_anchor=0.4, gate=0.0, diversity=0.5) -> DataFrame:
    """Gate in Spark, then MMR over the best ``window`` rows."""
    head = top_k(gate_candidates(ground, anchors, q, w_query, w_anchor, gate), window).collect()
    return spark.createDataFrame(mmr([(r["id"], r["v"], r["score"]) for r in head], k, diversity), "id long, score double")


def anchored_rank(primary: DataFrame, ground: DataFrame, floor: int, limit: int) -> DataFrame:
    """The first ``floor`` anchors, then ground rows, then the other anchors, up to ``limit``."""
    w = Window.orderBy(F.desc("score"), "id")
    p = top_k(primary, limit).withColumn("r", F.row_number().over(w))
    g = top_k(ground, limit).withColumn("r", F.row_number().over(w))
    ranked = (
        p.select("id", F.when(F.col("r") <= floor, 0).otherwise(2).alias("part"), "r")
        .unionByName(g.join(p.select("id"), "id", "left_anti").select("id", F.lit(1).alias("part"), "r"))
        .withColumn("position", F.row_number().over(Window.orderBy("part", "r", "id")))
    )
    return ranked.where(F.col("position") <= limit).select("id", "position")


def centroid(vecs: DataFrame) -> DataFrame:
    """Mean vector, one average per dimension."""
    each = vecs.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))


def breadth_speaks(scored: DataFrame, repo_top: float, floor: float = 0.35, window: int = 50) -> DataFrame:
    """Top >= floor and enough of the best ``window`` beat the repository's top."""
    top = scored.select("score").orderBy(F.desc("score")).limit(window)
    agg = top.agg(F.max("score").alias("top"), F.sum((F.col("score") > repo_top).cast("long")).alias("above"), F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    return agg.select("n", F.coalesce("above", F.lit(0)).alias("above"), F.coalesce((F.col("top") >= floor) & (F.col("above") >= need), F.lit(False)).alias("speaks"))


def lens_share(limit: int) -> int:
    """V18."""
    return max(1, (limit + 1) // 3)


def doc_grade_candidates(docs: DataFrame, theme_docs: DataFrame) -> DataFrame:
    """Non-catalogue documents and Markdown sections, and theme documents."""
    return docs.where("content_type <> 'catalog' or kind = 'md_section'").select("id").union(theme_docs.select("id")).distinct()


def entity_documents(terms: DataFrame, vocabulary: DataFrame, per_hit: int = 3) -> DataFrame:
    """Per (term, layer) at most ``per_hit`` documents, and the first term that finds a document keeps it."""
    j = terms.join(vocabulary, F.lower("term") == F.lower("name"))
    w = Window.partitionBy("term", "layer").orderBy("id")
    j = j.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_hit)
    return j.groupBy("id").agg(F.min_by("term", "pos").alias("term"))


def select_documents(entity: DataFrame, semantic: DataFrame, limit: int, floor: float = 0.35) -> DataFrame:
    """Up to limit // 2 entity documents by score, semantic fill over the floor, entity backfill."""
    w = Window.orderBy(F.desc("score"), "id")
    e = top_k(entity, limit).withColumn("r", F.row_number().over(w))
    s = top_k(semantic.where(F.col("score") >= floor).join(e.where(F.col("r") <= limit // 2).select("id"), "id", "left_anti"), limit)
    s = s.withColumn("r", F.row_number().over(w))
    parts = e.select("id", F.when(F.col("r") <= limit // 2, 0).otherwise(2).alias("part"), "r").unionByName(s.select("id", F.lit(1).alias("part"), "r"))
    once = parts.groupBy("id").agg(F.min(F.struct("part", "r")).alias("k"))
    return once.withColumn("position", F.row_number().over(Window.orderBy("k", "id"))).where(F.col("position") <= limit).select("id", "position")


def candidate_terms(questions: DataFrame, stop_words: list[str], longest: int = 3) -> DataFrame:
    """N-grams up to ``longest`` words that neither begin nor end with a stop word."""
    toks = F.regexp_extract_all("question", F.lit("[A-Za-z0-9_.]+"), F.lit(0))
    q = questions.withColumn("toks", toks)
    parts = []
    for n in range(1, longest + 1):
        g = q.where(F.size("toks") >= n).select("qid", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("toks") - n + 1), _gram(n))).alias("pos", "gram"))
        parts.append(g.select("qid", "pos", F.lit(n).alias("n"), "gram"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    stop = [w.lower() for w in stop_words]
    return out.where(~F.lower(F.element_at("gram", 1)).isin(stop) & ~F.lower(F.element_at("gram", -1)).isin(stop)).select("qid", "pos", "n", F.array_join("gram", " ").alias("term"))


def _gram(n: int):
    return lambda i: F.slice("toks", i, n)


def maximal_munch(hits: DataFrame) -> DataFrame:
    """Drop a hit whose words lie inside a longer hit of the question."""
    a, b = hits.alias("a"), hits.alias("b")
    inside = (F.col("a.qid") == F.col("b.qid")) & (F.col("b.n") > F.col("a.n")) & (F.col("b.pos") <= F.col("a.pos")) & (F.col("b.pos") + F.col("b.n") >= F.col("a.pos") + F.col("a.n"))
    return a.join(b, inside, "left_anti")


def resolve_entities(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """At most one hit a layer (smallest id) for each term."""
    j = terms.join(vocabulary, F.lower("term") == F.lower("name"))
    return j.groupBy("term", "layer").agg(F.min("id").alias("id"))


def merge_lists(primary: DataFrame, lens: DataFrame, limit: int) -> DataFrame:
    """Primary list, then the capped lens list; score (n - i) / n."""
    w = Window.orderBy(F.desc("score"), "id")
    p = top_k(primary, limit - lens_share(limit)).withColumn("r", F.row_number().over(w))
    s = top_k(lens.join(p.select("id"), "id", "left_anti"), lens_share(limit)).withColumn("r", F.row_number().over(w) + limit)
    both = p.select("id", "r").unionByName(s.select("id", "r"))
    i = F.row_number().over(Window.orderBy("r")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return both.select("id", F.round((n - i) / n, 6).alias("score"))


def route_aisles(vecs: DataFrame, aisle: str, q: list[float], floor: float = 0.25, k: int = 3) -> DataFrame:
    """Best similarity of each aisle, over the floor, top k."""
    best = with_scores(vecs, q).groupBy(aisle).agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(best.where(F.col("score") >= floor), k, id_=aisle)


def nearest(vecs: DataFrame, q: list[float], k: int, floor: float = -1.0) -> DataFrame:
    """Null, zero and wrong-dimension vectors are skipped; ties by id."""
    ok = vecs.where(F.col("v").isNotNull() & (F.size("v") == len(q)) & (norm(F.col("v")) > 0))
    scored = with_scores(ok, q).withColumn("score", F.round("score", 6))
    return top_k(scored.where(F.col("score") >= floor), k)


def nearest_per_key(vecs: DataFrame, key: str, q: list[float], k: int, floor: float = 0.25) -> DataFrame:
    """At most one row a key, by (-score, id)."""
    scored = with_scores(vecs, q).withColumn("score", F.round("score", 6)).where(F.col("score") >= floor)
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("m"))
    return top_k(best.select(key, (-F.col("m.neg")).alias("id"), F.col("m.score").alias("score")), k)


def idf_overlap(items: DataFrame, question: str, text: str = "text") -> DataFrame:
    """Sum of 1 + ln((N + 1) / (df + 1)) over shared tokens, as a share of the question's sum."""
    spark = items.sparkSession
    q = spark.createDataFrame([(question,)], "q string").select(F.explode(F.array_distinct(camel_tokens(F.col("q")))).alias("tok"))
    toks = items.select("id", F.explode(F.array_distinct(camel_tokens(F.col(text)))).alias("tok")).join(F.broadcast(q), "tok", "left_semi")
    df = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    total = items.agg(F.count(F.lit(1)).alias("n_items"))
    w = q.join(df, "tok", "left").crossJoin(F.broadcast(total)).select("tok", (1 + F.log((F.col("n_items") + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("w"))
    whole = w.agg(F.sum("w").alias("whole"))
    return toks.join(F.broadcast(w), "tok").groupBy("id").agg(F.sum("w").alias("s")).crossJoin(F.broadcast(whole)).select("id", F.round(F.col("s") / F.col("whole"), 6).alias("score"))


def pseudo_semantic(spark, vecs: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Nearest to the score-weighted centroid of the lexical seeds; lexical rows first, then the others."""
    seeds = top_k(lexical, k)
    parts = vecs.join(bounded_broadcast(seeds), "id").select("score", F.posexplode("v").alias("i", "x"))
    mean = parts.groupBy("i").agg((F.sum(F.col("x").cast("double") * F.col("score")) / F.sum("score")).alias("x")).orderBy("i").collect()
    near = nearest(vecs, [r["x"] for r in mean], 2 * k) if mean else vecs.limit(0).select("id", F.lit(0.0).alias("score"))
    parts = seeds.select("id", F.lit(0).alias("part"), "score").unionByName(near.join(seeds.select("id"), "id", "left_anti").select("id", F.lit(1).alias("part"), "score"))
    return parts.withColumn("position", F.row_number().over(Window.orderBy("part", F.desc("score"), "id"))).where(F.col("position") <= k).select("id", "position")


def scoped_candidates(lexical: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """Lexical ids and their graph neighbours, bounded."""
    seeds = top_k(lexical, limit).select("id")
    seeds = bounded_broadcast(seeds)
    out = edges.join(seeds, edges["source_id"] == seeds["id"], "left_semi").select(F.col("target_id").alias("id"))
    back = edges.join(seeds, edges["target_id"] == seeds["id"], "left_semi").select(F.col("source_id").alias("id"))
    return seeds.union(out).union(back).distinct().orderBy("id").limit(2 * limit)


def positioning(docs: DataFrame, overlap: DataFrame, degree: DataFrame, cap: int = 50, k: int = 10) -> DataFrame:
    """Lexical score with degree capped, one document a file, top k."""
    j = docs.join(overlap, "id").join(degree, "id", "left").withColumn("score", F.round(F.col("score") + F.least(F.coalesce("degree", F.lit(0)), F.lit(cap)) / 1000, 6))
    best = j.groupBy("file").agg(F.max(F.struct("score", "id")).alias("m"))
    return top_k(best.select("file", "m.id", "m.score"), k)


def text_fallback(docs: DataFrame, question: str) -> DataFrame:
    """Exact title 10, title contains 5, each word 2."""
    q = question.lower()
    t = F.lower("title")
    s = F.when(t == q, 10).otherwise(0) + F.when(t.contains(q), 5).otherwise(0)
    for w in dict.fromkeys(q.split()):
        s = s + F.when(t.contains(w), 2).otherwise(0)
    return docs.select("id", s.alias("score")).where("score > 0")


def text_search(docs: DataFrame, question: str, limit: int) -> DataFrame:
    """Any word in the title or the first 3000 characters; 2 a title word, 0.5 a content word."""
    t, c = F.lower("title"), F.lower(F.substring("content", 1, 3000))
    s = F.lit(0.0)
    for w in dict.fromkeys(question.lower().split()):
        s = s + F.when(t.contains(w), 2.0).otherwise(0.0) + F.when(c.contains(w), 0.5).otherwise(0.0)
    return top_k(docs.select("id", s.alias("score")).where("score > 0"), limit)


def _tier(n: Column, name: str) -> Column:
    """1 / .95 / .9 / .8 / .7: equal, equal without case, last part equal, prefix, inside; null for other names."""
    low, last = name.lower(), F.element_at(F.split(n, "[.]"), -1)
    return F.when(n == name, 1.0).when(F.lower(n) == low, 0.95).when(F.lower(last) == low, 0.9).when(F.lower(n).startswith(low), 0.8).when(F.lower(n).contains(low), 0.7)


def rank_symbols(symbols: DataFrame, name: str) -> DataFrame:
    """V34, by tiers: distinct names that hold the searched one in some way."""
    return symbols.select("name").distinct().select("name", _tier(F.col("name"), name).alias("score")).where("score is not null")


def fuzzy_symbols(symbols: DataFrame, name: str, limit: int = 10, floor: float = 0.7) -> DataFrame:
    """The best names by tier, then by 0.69 times the matching ratio of the lower-cased names, from ``floor`` on; ties
    by length, then by name.

    The ratio (twice the characters in matching blocks by all characters) is worked out only for names whose lengths allow
    it, in Arrow batches.
    """
    import pyarrow as pa

    low = name.lower()
    distinct = symbols.select("name").where("name is not null").distinct().withColumn("score", _tier(F.col("name"), name))
    possible = 2 * F.least(F.length("name"), F.lit(len(low))) >= floor * (F.length("name") + len(low))

    def run(batches):
        from difflib import SequenceMatcher

        for batch in batches:
            names = batch.column(0).to_pylist()
            ratios = [SequenceMatcher(None, low, n.lower()).ratio() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0.69 * r if r >= floor else None for r in ratios], pa.float64())], ["name", "score"])

    near = distinct.where(F.col("score").isNull() & possible).select("name").mapInArrow(run, "name string, score double")
    found = distinct.where("score is not null").unionByName(near.where("score is not null"))
    return found.orderBy(F.desc("score"), F.length("name"), "name").limit(limit).select("name", F.round("score", 6).alias("score"))


def resolve_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """Best tier (exact, dotted suffix, substring) and its candidates; unique says whether it resolves."""
    tier = F.when(F.col("qname") == name, 0).when(F.col("qname").endswith("." + name), 1).when(F.col("qname").contains(name), 2)
    t = symbols.withColumn("tier", tier).where("tier is not null")
    best = t.agg(F.min("tier").alias("best"))
    hit = t.crossJoin(F.broadcast(best)).where("tier = best")
    return hit.withColumn("is_unique", F.count(F.lit(1)).over(Window.partitionBy()) == 1).select("id", "qname", "tier", "is_unique")


def confidence_bucket(scores: DataFrame) -> DataFrame:
    """V36."""
    m = F.max("score")
    return scores.agg(F.when(m.isNull(), "medium").when(m > 0.6, "high").when(m > 0.4, "medium").otherwise("low").alias("confidence"))


def richness(answers: DataFrame) -> DataFrame:
    """Score + 1 for a diagram + 0.3 x min(distinct file references, 4) + thoroughness by length."""
    refs = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]+[.](?:py|js|go|scala)"), F.lit(0))))
    long_ = F.when(F.length("text") > 2000, 1.0).when(F.length("text") > 500, 0.5).otherwise(0.0)
    return answers.select("id", F.round(F.col("score") + F.when(F.col("text").contains("```mermaid"), 1.0).otherwise(0.0) + 0.3 * F.least(refs, F.lit(4)) + long_, 6).alias("richness"))


def poor_result_hints(scores: DataFrame) -> DataFrame:
    """Which hints a result list deserves."""
    a = scores.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top"))
    hints = F.array_compact(
        F.array(F.when(F.col("n") < 3, "few results"), F.when(F.coalesce("top", F.lit(0.0)) < 0.35, "no close match"), F.when(F.coalesce("top", F.lit(0.0)).between(0.35, 0.5), "weak match"))
    )
    return a.select("n", F.array_join(hints, ", ").alias("hints"))


def route_section_scores(route_sections: DataFrame, vecs: DataFrame, q: list[float]) -> DataFrame:
    """Best section similarity by route."""
    return route_sections.join(with_scores(vecs, q), "id").groupBy("route").agg(F.round(F.max("score"), 6).alias("score"))


def at_least(confidence: Column, floor: str) -> Column:
    """F09 on its own: rank of the confidence against the floor's."""
    return confidence_rank(confidence) >= confidence_rank(F.lit(floor))
