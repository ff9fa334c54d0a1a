"""Benchmark decontamination with a broadcast hash set of normalised test n-grams. DataFrame functions only.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters. A benchmark item gives its
windows of ``WINDOW`` consecutive words (or itself, when shorter). Two hash sets are broadcast, and a document's row
probes them in one pass over its words:

1. An anchor of ``a`` words is looked up at every ``L - a + 1``-th word of the document, for each window
   length L. Any occurrence of a window covers one such anchor whole, so no occurrence is missed.
2. Around an anchor that is known, the at most ``L - a + 1`` windows over it are looked up as strings.

What leaves the pass is one small row a document and one for each occurrence. The sets are broadcast up to
``BROADCAST_BYTES``, which is measured first. Beyond that the hashes of the anchors (not the windows) meet the set in a
shuffle join, and only documents with a known anchor have their windows joined.

Edge cases: null and empty texts have no words, no hits and aren't contaminated; benchmark items that are
null or have no words have no windows; an empty benchmark contaminates nothing; items that agree in id and
windows count once; repeated documents each get their verdict; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut

WINDOW = 13
ANCHOR = 5
#: What both hash sets may take, by the bytes of their strings and a row's share.
BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64
#: Contaminated when hits are at least one word in so many.
SHARE = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
NOT_WORD_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD_ANY_CASE = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def words(text: str = "text") -> Column:
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, NOT_WORD), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, win, len): the windows of every item."""
    w = benchmark.select("item_id", words().alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    w = w.select("item_id", "w", length.alias("len"))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    return w.select(
        "item_id", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.col("len")), " "))).alias("win")
    ).distinct()


def _anchor_length(length: int) -> int:
    return min(ANCHOR, (length + 1) // 2)


def _settle(df: DataFrame) -> DataFrame:
    """Keep Catalyst from inlining the computed columns into later filters and lambdas, where they would be
    worked out again for each element: a generator of one row stands between."""
    return df.select(F.inline(F.array(F.struct(*(F.col(c) for c in df.columns)))))


def anchors(wins: DataFrame) -> DataFrame:
    """Distinct (len, h): the hashes of all anchors of all windows."""
    a = F.least(F.lit(ANCHOR), F.floor((F.col("len") + 1) / 2).cast("int"))
    grams = F.transform(F.sequence(F.lit(1), F.col("len") - a + 1), lambda i: _hash(F.slice("v", i, a)))
    return wins.select("len", F.split("win", " ").alias("v")).select("len", F.explode(grams).alias("h")).distinct()


def _hash(some_words: Column) -> Column:
    return F.xxhash64(F.array_join(some_words, " "))


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


_SPOT = "struct<len:int,pos:int,h:bigint>"


def spots(lengths: list[int], first: bool) -> Column:
    """Anchors of ``w`` to look up; ``first`` puts one without a length before them, which stands for the document."""
    found = [F.array(F.struct(F.lit(0).alias("len"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("h"))) if first else _none(_SPOT)]
    for n in lengths:
        places = F.sequence(F.lit(1), F.greatest(F.size("w") - (_anchor_length(n) - 1), F.lit(1)), F.lit(n - _anchor_length(n) + 1))
        found.append(F.when(F.size("w") >= n, _looked_up(places, n)).otherwise(_none(_SPOT)))
    return F.concat(*found)


def _looked_up(places: Column, n: int) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(n).alias("len"), i.alias("pos"), _hash(F.slice("w", i, _anchor_length(n))).alias("h")))


def _windows_of(n: int) -> Column:
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("w", i, n), " ").alias("win")))


def scan(rows: DataFrame, ids: list[str], wins: DataFrame, lengths: list[int], every: bool) -> DataFrame:
    """(ids, n, hits, items) of ``rows`` (ids, w): occurrences (pos, len) and the items they belong to, by probing
    broadcast sets; ``every`` keeps rows without any."""
    rows = rows.select(*ids, F.size("w").alias("n"), "w", spots(lengths, every).alias("s"))
    each = rows.select(*ids, "n", "w", F.explode("s").alias("s")).select(*ids, "n", "w", "s.len", "s.pos", "s.h")
    known = F.broadcast(anchors(wins).withColumn("known", F.lit(True)))
    near = each.join(known, ["len", "h"], "left").where("pos = 0 or known")
    slack = F.col("len") - F.least(F.lit(ANCHOR), F.floor((F.col("len") + 1) / 2).cast("int"))
    low = F.greatest(F.col("pos") - slack, F.lit(1))
    # in the same generated code as the look-up, so that only what lies around a known anchor is ever copied
    near = near.select(*ids, "n", "len", low.alias("low"), "pos", F.when(F.col("pos") > 0, F.slice("w", low, F.col("pos") + F.col("len") - low)).alias("around"))
    starts = F.sequence(F.lit(0), F.size("around") - F.col("len"))
    some = F.when(
        F.size("around") >= F.greatest(F.col("len"), F.lit(1)),
        F.transform(starts, lambda k: F.struct((F.col("low") + k).alias("at"), F.array_join(F.slice("around", k + 1, F.col("len")), " ").alias("win"))),
    ).otherwise(F.when(F.col("pos") == 0, F.expr("array(struct(0 as at, cast(null as string) as win))")))
    each = near.select(*ids, "n", "len", F.explode(some).alias("c")).select(*ids, "n", "len", "c.at", "c.win")
    items = F.broadcast(wins.select("win", F.col("item_id").cast("string").alias("item"), F.lit(True).alias("hit")))
    return _gathered(each.join(items, "win", "left").where("at = 0 or hit"), [*ids, "n"])


def _gathered(hits: DataFrame, ids: list[str]) -> DataFrame:
    spot = F.when(F.col("at") > 0, F.struct(F.col("at").alias("pos"), "len"))
    return hits.groupBy(*ids).agg(F.collect_set(spot).alias("hits"), F.collect_set("item").alias("items"))


def scan_by_join(rows: DataFrame, ids: list[str], wins: DataFrame, lengths: list[int]) -> DataFrame:
    """The same for hash sets too large to broadcast; rows without an occurrence are left out."""
    looked_up = rows.select(*ids, F.explode(spots(lengths, False)).alias("s")).select(*ids, "s.len", "s.h")
    touched = cut(looked_up.join(cut(anchors(wins)), ["len", "h"], "left_semi").select(*ids).distinct())
    some = rows.join(touched, ids, "left_semi")
    parts = []
    for n in lengths:
        parts.append(some.where(F.size("w") >= n).select(*ids, F.size("w").alias("n"), F.lit(n).alias("len"), F.explode(_windows_of(n)).alias("c")))
    each = parts[0]
    for p in parts[1:]:
        each = each.unionByName(p)
    each = each.select(*ids, "n", "len", "c.at", "c.win")
    items = cut(wins.select("win", F.col("item_id").cast("string").alias("item")))
    return _gathered(each.join(items, "win"), [*ids, "n"])


def measured(wins: DataFrame) -> tuple[list[int], int]:
    """Lengths of windows, and what the hash sets take."""
    row = wins.agg(F.collect_set("len").alias("lens"), F.sum(F.length("win") + 2 * ROW_BYTES).alias("size")).first()
    return sorted(row["lens"]), int(row["size"] or 0)


def hit_words() -> Column:
    """Distinct word positions inside any occurrence."""
    each = F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))
    return F.when(F.size("hits") > 0, F.array_distinct(F.flatten(each))).otherwise(_none("int"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def text_keys() -> list[Column]:
    """Two numbers, together the same only for equal texts."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("text"), "text").alias("k2")]


def occurrences(docs: DataFrame, wins: DataFrame, lengths: list[int], size: int, most: int) -> DataFrame:
    """(k1, k2, n, hits, items) of the texts with an occurrence."""
    rows = _settle(docs.select(*text_keys(), words().alias("w")))
    return scan(rows, ["k1", "k2"], wins, lengths, False) if size <= most else scan_by_join(rows, ["k1", "k2"], wins, lengths)


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = cut(windows(benchmark))
    lengths, size = measured(wins)
    if size <= broadcast_bytes:
        rows = _settle(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", words().alias("w")))
        found = scan(rows, ["_row", "doc_id"], wins, lengths, True)
    else:
        rows = docs.select("doc_id", *text_keys(), F.size(words()).alias("n"))
        hits = cut(occurrences(docs, wins, lengths, size, broadcast_bytes).drop("n"))
        none = _none("struct<pos:int,len:int>")
        found = rows.join(hits, ["k1", "k2"], "left").select("doc_id", "n", F.coalesce("hits", none).alias("hits"), F.coalesce("items", _none("string")).alias("items"))
    n_hit = F.size(hit_words())
    return found.select("doc_id", "n", n_hit.alias("n_hit"), "items").select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        is_contaminated(F.col("n_hit"), F.col("n")).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop contaminated documents; cut the hit words out of the others. Keeps the columns of ``docs``.

    The texts with a hit become a small table first, which is broadcast to the documents while its size allows it, so
    that clean texts are not shuffled. Input columns of any name are carried through under other names.
    """
    names = docs.columns
    wins = cut(windows(benchmark))
    lengths, size = measured(wins)
    hits = cut(occurrences(docs.select("text"), wins, lengths, size, broadcast_bytes).select("k1", "k2", "n", hit_words().alias("hit")))
    held = hits.agg(F.sum(F.size("hit") * 4 + ROW_BYTES)).first()[0] or 0
    safe = docs.select(*text_keys(), *(F.col(c).alias("text" if c == "text" else f"_c{i}") for i, c in enumerate(names)))
    rows = safe.join(F.broadcast(hits) if held <= broadcast_bytes else hits, ["k1", "k2"], "left")
    touched = F.col("hit").isNotNull()
    rows = rows.where(~touched | ~is_contaminated(F.size("hit"), F.col("n")))
    rows = rows.withColumns({"inner": F.when(touched, F.split("text", NOT_WORD_ANY_CASE)), "gaps": F.when(touched, F.split("text", WORD_ANY_CASE))})
    rows = _settle(rows.drop("k1", "k2", "n"))  # else both arrays would be made again for every word
    inner, gaps = F.col("inner"), F.col("gaps")
    lead = F.when(F.element_at(inner, 1) == "", 1).otherwise(0)  # the text starts with a separator
    n_words = F.size(gaps) - 1
    # gaps[i] stands before word i; hit words are numbered from 1
    rebuilt = F.array_join(
        F.transform(
            F.sequence(F.lit(1), n_words),
            lambda i: F.concat(F.element_at(gaps, i), F.when(F.array_contains("hit", i), "").otherwise(F.element_at(inner, i + lead))),
        ),
        "",
    )
    text = F.when(touched, F.concat(rebuilt, F.element_at(gaps, -1))).otherwise(F.col("text"))
    return rows.select(*((text if c == "text" else F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)))
