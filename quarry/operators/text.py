"""Text and document operators."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import ship_package


#: Where a long paragraph is best cut, in this order.
BREAKS = (". ", "! ", "? ", "\n", " ")


def cut_long(text: str, size: int, overlap: int) -> list[str]:
    """Windows of a long paragraph. A window ends after its last mark of the first kind that stands past its middle, and the
    next one begins ``overlap`` characters before that end."""
    out, at, back = [], 0, min(overlap, size - 1)
    while at < len(text):
        end = at + size
        if end < len(text):
            ends = (text.rfind(mark, at, end) + len(mark) for mark in BREAKS if text.rfind(mark, at, end) > at + size // 2)
            end = next(ends, end)
        out.append(text[at:end].strip())
        at = max(end - back, at + 1) if end < len(text) else len(text)
    return [piece for piece in out if piece]


def chunk_text(text: str | None, size: int = 500, overlap: int = 50) -> list[str]:
    """Greedy packing of paragraphs up to ``size`` characters, two for the blank line between; a longer paragraph is cut,
    and its last piece takes in what follows. A text that fits stays as it is."""
    if not text or len(text) <= size:
        return [text] if text else []
    out, held = [], ""
    for para in re.split(r"\n\n+", text):
        if len(held) + len(para) + 2 <= size:
            held = f"{held}\n\n{para}" if held else para
        else:
            pieces = cut_long(para, size, overlap) if len(para) > size else [para]
            out += [held, *pieces[:-1]]
            held = pieces[-1] if pieces else ""
    return [chunk for chunk in [*out, held] if chunk]


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(id, chunk_index, content)."""
    ship_package(docs.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk_text(t, size, overlap))

    return docs.select("id", F.posexplode(cut("content")).alias("chunk_index", "content"))


def sections(docs: DataFrame) -> DataFrame:
    """Parts before each ``## `` heading (not ``###``), stripped, empty ones dropped."""
    parts = F.filter(F.transform(F.split("content", r"(?dm)^(?=## (?!#))"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    heading = F.trim(F.regexp_extract("part", r"^## ([^\n]*)", 1))
    return docs.select("id", F.posexplode(parts).alias("idx", "part")).select("id", "idx", heading.alias("heading"), F.length("part").alias("chars"))


def embedding_text(docs: DataFrame) -> DataFrame:
    """T03."""
    return docs.select("id", F.concat("title", F.lit("\n"), F.substring("content", 1, 2000)).alias("text"))


def lint(docs: DataFrame) -> DataFrame:
    """One row a problem."""
    found = F.array_compact(
        F.array(
            F.when(F.length("content") < 100, "too_short"),
            F.when(~F.lower("content").rlike("overview|summary"), "no_overview"),
            F.when(F.coalesce(F.size("files"), F.lit(0)) <= 0, "no_files"),
        )
    )
    return docs.select("id", F.explode(found).alias("problem"))


def broken_references(docs: DataFrame) -> DataFrame:
    """``(id.md)`` references to no document."""
    refs = docs.select("id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\(([A-Za-z0-9-]+)\.md\)"), F.lit(1)))).alias("target"))
    return refs.join(docs.select(F.col("id").alias("target")), "target", "left_anti")


def oversized(docs: DataFrame, most: int = 15000) -> DataFrame:
    """T05."""
    return docs.where(F.length("content") > most).select("id", F.length("content").alias("chars"))


def shrink_suggestions(docs: DataFrame, most: int = 12000, headers: int = 3, shown: int = 6) -> DataFrame:
    """Long documents with enough ``## `` headers, the first few of them."""
    h = F.regexp_extract_all("content", F.lit(r"(?dm)^## ([^\n]+)"), F.lit(1))
    return docs.where(F.length("content") > most).select("id", h.alias("h")).where(F.size("h") >= headers).select("id", F.size("h").alias("n"), F.array_join(F.slice("h", 1, shown), " | ").alias("headers"))


def rechunk(pieces: DataFrame, worst: int = 20) -> DataFrame:
    """Chunks that end mid-sentence or are tiny; documents of two or more chunks with quality under one half."""
    bad = (~F.rtrim("content").rlike(r"[.!?:;)\]]$")) | (F.length("content") < 30)
    q = F.round(1 - F.sum(bad.cast("long")) / F.count(F.lit(1)), 6)
    return pieces.groupBy("id").agg(F.count(F.lit(1)).alias("chunks"), q.alias("quality")).where("chunks >= 2 and quality < 0.5").orderBy("quality", "id").limit(worst)


def decisions(docs: DataFrame, chars: int = 300) -> DataFrame:
    """``###`` parts of sections whose heading speaks of design decisions."""
    s = docs.select("id", F.explode(F.split("content", r"(?dm)^(?=## (?!#))")).alias("s")).where(F.lower(F.regexp_extract("s", r"^## ([^\n]*)", 1)).rlike("(?=.*design)(?=.*decision)"))
    sub = s.select("id", F.posexplode(F.split("s", r"(?dm)^(?=### )")).alias("pos", "p")).where("p like '### %'")
    return sub.select("id", "pos", F.trim(F.regexp_extract("p", r"^### ([^\n]*)", 1)).alias("title"), F.substring(F.trim(F.regexp_replace("p", r"^### [^\n]*\n?", "")), 1, chars).alias("text"))


WARNINGS = "(?i)(?<![A-Za-z0-9_])(warning|caution|beware|gotcha|careful|never|must not)(?![A-Za-z0-9_])"


def warning_lines(docs: DataFrame, pattern: str = WARNINGS, least: int = 20, limit: int = 20) -> DataFrame:
    """Distinct lines with a warning word, first document first."""
    lines = docs.select("id", F.posexplode(F.split("content", "\n")).alias("pos", "line")).select("id", "pos", F.trim("line").alias("line"))
    hit = lines.where((F.length("line") > least) & F.col("line").rlike(pattern))
    return hit.groupBy("line").agg(F.min(F.struct("id", "pos")).alias("k")).select("line", "k.id", "k.pos").orderBy("id", "pos").limit(limit)


def explain(docs: DataFrame, file: str, limit: int, offset: int) -> DataFrame:
    """One page of the documents of a file with the outline of their headings."""
    d = docs.where(F.array_contains("files", file))
    total = d.agg(F.count(F.lit(1)).alias("total"))
    return d.orderBy("content_type", "id").offset(offset).limit(limit).crossJoin(F.broadcast(total)).select(
        "id", "content_type", F.size(F.regexp_extract_all("content", F.lit("(?dm)^#+ [^\n]+"), F.lit(0))).alias("headings"), "total", F.when(F.lit(offset + limit) < F.col("total"), offset + limit).alias("next_offset")
    )


def summaries(docs: DataFrame, least: int = 50) -> DataFrame:
    """The first paragraph that is long enough, no header and no code."""
    good = F.filter(F.transform(F.split("content", "\n\n"), lambda p: F.trim(p)), lambda p: (F.length(p) > least) & ~p.startswith("#") & ~p.startswith("```"))
    return docs.select("id", F.try_element_at(good, F.lit(1)).alias("summary"))


def stack_frames(texts: DataFrame) -> DataFrame:
    """(file, line, function) of Python frames, in order."""
    rx = r'File "([^"]+)", line (\d+), in (\w+)'
    m = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    return texts.select("id", F.posexplode(m).alias("pos", "m")).select("id", "pos", F.regexp_extract("m", rx, 1).alias("file"), F.regexp_extract("m", rx, 2).cast("int").alias("line"), F.regexp_extract("m", rx, 3).alias("function"))


def side_effects(code: DataFrame) -> DataFrame:
    """Categories of effects a body mentions."""
    kinds = {"database": r"\b(execute|commit|cursor|session)\b", "file": r"\b(open|write|unlink|rename)\b", "network": r"\b(requests|urlopen|socket|http)\b", "process": r"\b(subprocess|system|popen)\b"}
    return code.select("id", F.explode(F.array_compact(F.array(*(F.when(F.lower("text").rlike(rx), k) for k, rx in kinds.items())))).alias("effect"))


def tests_for(files: DataFrame, graph: DataFrame) -> DataFrame:
    """Tests of a file by name, then by import; the first reason wins."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"[.][a-z]+$", "")
    t = files.where(F.col("file").rlike("(^|/)test_[^/]+$")).select(F.col("file").alias("test"), F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"^test_|[.][a-z]+$", "").alias("stem"))
    f = files.where(~F.col("file").rlike("(^|/)test_[^/]+$")).select("file", stem.alias("stem"))
    named = f.join(t, "stem").select("file", "test", F.lit(0).alias("p"), F.lit("name").alias("reason"))
    imp = graph.where("edge_type = 'import'").select(F.col("target_id").alias("file"), F.col("source_id").alias("test")).where(F.col("test").rlike("(^|/)test_[^/]+$"))
    both = named.unionByName(imp.select("file", "test", F.lit(1).alias("p"), F.lit("import").alias("reason")))
    return both.groupBy("file", "test").agg(F.min_by("reason", "p").alias("reason"))


def stale_documents(docs: DataFrame, mtimes: DataFrame) -> DataFrame:
    """Documents older than one of their files."""
    return docs.select("id", "updated_at", F.explode("files").alias("file")).join(mtimes, "file").where("updated_at < mtime").select("id").distinct()


def complexity(code: DataFrame) -> DataFrame:
    """0.01 lines + 5 classes + 2 functions + 0.5 imports."""
    n = lambda rx: F.size(F.regexp_extract_all("text", F.lit(rx), F.lit(0)))
    lines, classes, functions, imports = F.size(F.split("text", "\n")), n(r"(?m)^\s*class \w+"), n(r"(?m)^\s*(?:async )?def \w+"), n(r"(?m)^\s*(?:import|from) \w+")
    return code.select("id", F.round(0.01 * lines + 5 * classes + 2 * functions + 0.5 * imports, 6).alias("complexity"))


def author_shares(blame: DataFrame) -> DataFrame:
    """Share of lines by author, from blame rows (file, author)."""
    n = blame.groupBy("file", "author").agg(F.count(F.lit(1)).alias("lines"))
    return n.withColumn("share", F.round(F.col("lines") / F.sum("lines").over(Window.partitionBy("file")), 6))


def token_budget(docs: DataFrame, budget: int) -> DataFrame:
    """Whether the listed documents fit, by characters // 4."""
    t = F.sum(F.floor(F.length("content") / 4))
    return docs.agg(t.alias("tokens"), (t > budget).alias("downgrade"))


def source_spans(seeds: DataFrame, texts: DataFrame, before: int, after: int) -> DataFrame:
    """Line windows around seeds, overlapping ones of a file merged, with their text."""
    s = seeds.select("file", F.greatest(F.lit(1), F.col("line") - before).alias("a"), (F.col("line") + after).alias("b"))
    w = Window.partitionBy("file").orderBy("a", "b")
    new = F.col("a") > F.coalesce(F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) + 1
    g = s.withColumn("g", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = g.groupBy("file", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.join(texts, "file").select("file", "a", "b", F.array_join(F.slice(F.split("text", "\n"), F.col("a"), F.col("b") - F.col("a") + 1), "\n").alias("span"))


def validate(docs: DataFrame, least: int = 200) -> DataFrame:
    """Content rules: length, a heading, closed fences, artefacts."""
    fences = F.size(F.regexp_extract_all("content", F.lit("(?dm)^```"), F.lit(0)))
    found = F.array_compact(
        F.array(
            F.when(F.length("content") < least, "short"), F.when(~F.col("content").rlike("(?dm)^#+ "), "no_heading"),
            F.when(fences % 2 == 1, "open_fence"), F.when(F.col("content").rlike("(?i)as an ai|lorem ipsum"), "artefact"),
        )
    )
    return docs.select("id", F.array_join(found, ",").alias("problems"), (F.size(found) == 0).alias("ok"))


def doc_tags(comments: DataFrame) -> DataFrame:
    """``@tag name text`` lines of documentation comments."""
    rx = r"(?m)^\s*\*?\s*@(\w+)[ \t]+(\S+)[ \t]*([^\n]*)$"
    m = F.regexp_extract_all("text", F.lit(rx), F.lit(0))
    return comments.select("id", F.posexplode(m).alias("pos", "m")).select("id", "pos", *(F.trim(F.regexp_extract("m", rx, i)).alias(k) for i, k in ((1, "tag"), (2, "name"), (3, "description"))))


def facets(questions: DataFrame) -> DataFrame:
    """Exact spans of a question: quoted text, code-shaped names and capitalised runs."""
    rx = r'"[^"]+"|`[^`]+`|\b\w+_\w+\b|\b[a-z]+[A-Z]\w*\b|\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b'
    return questions.select("id", F.posexplode(F.regexp_extract_all("question", F.lit(rx), F.lit(0))).alias("pos", "span"))


def claim_coverage(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim, symbol) against evidence symbols: covered and missing by claim."""
    e = evidence.select("symbol").distinct().withColumn("_e", F.lit(1))
    return claims.join(e, "symbol", "left").groupBy("claim").agg(F.count(F.lit(1)).alias("needed"), F.count("_e").alias("covered"))


def select_bodies(rows: DataFrame, soft_cap: int, reserve: int) -> DataFrame:
    """Distinct symbols in order; a reserve for each group first, then the others up to the cap."""
    once = rows.groupBy("grp", "symbol").agg(F.min("pos").alias("pos"))
    order = [(F.col("r") > reserve).cast("int"), "pos", "grp", "symbol"]
    r = once.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy("pos", "symbol")))
    first = r.orderBy(*order).limit(soft_cap)  # only these few rows are numbered in one place
    return first.withColumn("k", F.row_number().over(Window.orderBy(*order))).select("grp", "symbol", "k")


def html_text(pages: DataFrame) -> DataFrame:
    """Visible text of raw pages: without comments, scripts, styles and tags; entities decoded."""
    t: Column = F.regexp_replace("html", r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return pages.select("page_id", F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " ")).alias("text"))


