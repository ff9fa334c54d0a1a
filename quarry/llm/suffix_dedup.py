"""Suffix-array dedup: remove every byte that a repeated string of ``LEAST`` bytes covers, over all documents.

No machine can hold the transform of a whole corpus, so the corpus is first cut where equal strings cannot be
told apart: every window of LEAST bytes belongs to its minimizer, the ``GRAM``-byte string inside it with the
smallest hash (leftmost on ties). Equal windows have equal minimizers at equal places. Runs of windows with
one minimizer form a segment, and all occurrences of a repeated window lie in segments of one minimizer.

1. One pass gives (minimizer, segment digest, place) of every run. Minimizers that occur once are dropped.
2. Equal segments are counted and kept once, with their count as a weight, so a group of copies costs as much
   as one. A minimizer with one distinct segment is settled by its weight.
3. The texts of the other distinct segments are fetched, dealt by minimizer, and put through the threshold-bounded
   interval expansion of ``bwt.py`` in blocks of about ``BLOCK_BYTES``.
4. A minimizer with more than ``GROUP_LIMIT`` distinct segments (a hot passage in ever new surroundings) would
   put an unbounded group into one task. Its segments are cut into bands of starts, keyed by the core that all
   windows of a band share, and go through the expansion by core. A core that is still hot has its windows hashed and
   counted one by one, which is exact as well and partially aggregated before the shuffle.
5. Repeated windows go back to every occurrence of their segment, and the bytes they cover are removed.

Edge cases: texts are UTF-8 bytes; null is empty; texts shorter than LEAST bytes have no window and stay whole;
matches never cross documents; overlapping occurrences count; rows equal in id and text are two documents and
repeat each other; null ids are documents like others; an empty table gives an empty result; other columns
are not read. Outside the expansion, segments and windows are equal if their 64-bit hash and that of their minimizer are.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbytes as tb
from quarry.llm.bwt import repeated_starts
from quarry.session import arrow_map, cut

LEAST = 200
GRAM = 101
SPAN = LEAST - GRAM + 1  # grams in a window
BLOCK_BYTES = 1 << 19
BAND = 25  # starts that share a core, where a minimizer is hot
GROUP_LIMIT = 256


def doc_keys() -> tuple[Column, Column]:
    """Two numbers, together the same only for rows equal in id and text."""
    text = F.coalesce("text", F.lit(""))
    return F.xxhash64("doc_id", text), F.xxhash64(F.lit("row"), "doc_id", text)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the key ``dk``, the same only for rows equal in id and text.

    One number goes through all shuffles. Where different rows share it, which both numbers tell beforehand, theirs is
    made from both; there are next to none of them.
    """
    k1, k2 = doc_keys()
    both = docs.select(k1.alias("dk"), k2.alias("k2"))
    clash = cut(both.groupBy("dk").agg(F.min("k2").alias("lo"), F.max("k2").alias("hi")).where("lo <> hi").select("dk"))
    if clash.isEmpty():
        return docs.select("doc_id", "text", k1.alias("dk"))
    marked = docs.select("doc_id", "text", k1.alias("dk"), k2.alias("k2")).join(clash.withColumn("_shared", F.lit(True)), "dk", "left")
    return marked.select("doc_id", "text", F.when(F.col("_shared"), F.xxhash64("dk", "k2")).otherwise(F.col("dk")).alias("dk"))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x) - w + 1
    pad = -len(x) % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def window_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: row, first start, number of starts, distance from the first start to the
    minimizer, minimizer hash, segment hash."""
    none = np.zeros(0, np.int64)
    if len(data) < LEAST:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    pref = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(tb.BYTE_CODE[data] * tb.powers("up", len(data)), out=pref[1:])
    down = tb.powers("down", len(data) + 1)
    grams = tb.mix((pref[GRAM:] - pref[:-GRAM]) * down[: len(data) + 1 - GRAM])
    packed = (grams >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
    where = (_sliding_min(packed, SPAN) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offs)
    n_win = np.maximum(0, sizes - LEAST + 1)
    rows = np.repeat(np.arange(len(sizes)), n_win)
    starts = np.arange(int(n_win.sum())) - np.repeat(np.cumsum(n_win) - n_win, n_win) + offs[rows]
    if not len(starts):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = where[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    s = starts[first]
    seg = tb.mix((pref[s + count + LEAST - 1] - pref[s]) * down[s] + count.astype(np.uint64))
    return rows[first], s, count, place[first] - s, grams[place[first]], seg


def runs(docs: DataFrame) -> DataFrame:
    """(dk, mh, sh, at, reps): document, minimizer, segment digest, place (start, distance to the minimizer and number of
    windows in one number), and how often the segment comes in a row: periodic text is one row, not one a period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            r, s, count, far, mh, sh = window_runs(data, offs)
            head = np.ones(len(r), bool)
            head[1:] = (sh[1:] != sh[:-1]) | (mh[1:] != mh[:-1]) | (r[1:] != r[:-1])
            head = np.flatnonzero(head)
            reps = np.diff(np.append(head, len(r)))
            r, s, count, far, mh, sh = (x[head] for x in (r, s, count, far, mh, sh))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(r)), pa.array(mh.view(np.int64)), pa.array(sh.view(np.int64)), pa.array(((s - offs[r]) * 128 + far) * 128 + count), pa.array(reps)],
                ["dk", "mh", "sh", "at", "reps"],
            )

    return arrow_map(docs.select("dk", "text"), run, "dk long, mh long, sh long, at long, reps long")


def _spans_of(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_FOUND = "mh long, sh long, spans array<struct<a:int,b:int>>"
_FOUND_ARROW = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the wanted segments (rep = first document and place of each)."""
    lists = wanted.groupBy("dk").agg(F.collect_list(F.struct("mh", "sh", "at", "weight", "hot")).alias("segs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            out: list[tuple] = []
            raw = data.tobytes()
            for base, segs in zip(offs.tolist(), rows.column(1).to_pylist(), strict=False):
                for g in segs:
                    a, far, n = base + (g["at"] >> 14), g["at"] >> 7 & 127, g["at"] & 127
                    out.append((g["mh"], g["sh"], g["weight"], far, g["hot"], raw[a : a + n + LEAST - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))],
                ["mh", "sh", "weight", "far", "hot", "seg"],
            )

    joined = docs.select("dk", "text").join(lists, "dk").select("text", "segs")
    return arrow_map(joined, run, "mh long, sh long, weight long, far int, hot boolean, seg binary")


def expand(segments: DataFrame) -> DataFrame:
    """Interval expansion over segments dealt by minimizer: repeated starts of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        seen: set[tuple] = set()
        held_bytes, last = 0, None

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
            ends = np.cumsum([len(h[3]) for h in held])
            starts = ends - [len(h[3]) for h in held]
            flags = repeated_starts(data, starts, ends, np.array([h[2] for h in held]), LEAST)
            spans = [_spans_of(flags[a:b]) for a, b in zip(starts, ends, strict=True)]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array(spans, _FOUND_ARROW)], ["mh", "sh", "spans"]
            )
            held.clear(), seen.clear()
            return batch

        for batch in batches:
            for mh, sh, weight, seg in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if mh != last and held_bytes >= BLOCK_BYTES:
                    yield flush()
                    held_bytes = 0
                last = mh
                if (mh, sh) not in seen:
                    seen.add((mh, sh))
                    held.append((mh, sh, weight, seg))
                    held_bytes += len(seg)
        if held:
            yield flush()

    dealt = segments.select("mh", "sh", "weight", "seg").repartition("mh").sortWithinPartitions("mh")
    return arrow_map(dealt, run, _FOUND)


def count_windows(segments: DataFrame) -> DataFrame:
    """Repeated starts of the segments of hot minimizers, by counting their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                segs = part.column(3).to_pylist()
                data = np.frombuffer(b"".join(segs), np.uint8)
                sizes = np.array([len(x) for x in segs])
                n = sizes - LEAST + 1
                at = np.repeat(np.arange(len(segs)), n)
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                s = k + np.repeat(np.cumsum(sizes) - sizes, n)
                wh = tb.span_hashes(data, s, s + LEAST)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(k.astype(np.int32)), pa.array(wh.view(np.int64))],
                    ["mh", "sh", "weight", "k", "wh"],
                )

    each = arrow_map(segments.select("mh", "sh", "weight", "seg"), run, "mh long, sh long, weight long, k int, wh long")
    # equal windows have equal minimizers, so both hashes have to agree
    twice = cut(each.groupBy("mh", "wh").agg(F.sum("weight").alias("n")).where("n > 1").select("mh", "wh"))
    return each.join(twice, ["mh", "wh"]).groupBy("mh", "sh").agg(F.collect_list(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("spans"))


def bands(segments: DataFrame) -> DataFrame:
    """Sub-segments of the segments of hot minimizers: (mh, sh, weight, k0, ch, wh, seg).

    Starts are banded by their distance to the minimizer. All windows of a band share a core around it, so equal
    windows lie in equal bands with equal cores: the hash of the core (``ch``) tells surroundings apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                segs = part.column(4).to_pylist()
                data = np.frombuffer(b"".join(segs), np.uint8)
                sizes = np.array([len(x) for x in segs], np.int64)
                n, base, far = sizes - LEAST + 1, np.cumsum(sizes) - sizes, np.array(part.column(3).to_pylist(), np.int64)
                low = (far - n + 1) // BAND
                count = far // BAND - low + 1
                at = np.repeat(np.arange(len(segs)), count)
                b = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + low[at]
                k0 = far[at] - np.minimum(far[at], b * BAND + BAND - 1)
                k1 = far[at] - np.maximum(far[at] - n[at] + 1, b * BAND) + 1
                s, e = base[at] + k0, base[at] + k1 + LEAST - 1
                core = tb.span_hashes(data, base[at] + far[at] - b * BAND, base[at] + far[at] - b * BAND - BAND + 1 + LEAST)
                core = tb.mix(core + b.astype(np.uint64))
                whole = tb.mix(tb.span_hashes(data, s, e) + (k1 - k0).astype(np.uint64))
                raw, take = data.tobytes(), pa.array(at)
                cells = pa.array([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(take) for c in range(3)), pa.array(k0.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), cells],
                    ["mh", "sh", "weight", "k0", "ch", "wh", "seg"],
                )

    # a document that stands twice in the table fetches its segments twice
    once = segments.select("mh", "sh", "weight", "far", "seg").dropDuplicates(["mh", "sh"])
    return arrow_map(once, run, "mh long, sh long, weight long, k0 int, ch long, wh long, seg binary")


def split_hot(segments: DataFrame) -> DataFrame:
    """Repeated starts of the segments of hot minimizers: bands of equal cores go through the expansion; only where
    even one core has too many distinct sub-segments are its windows counted one by one."""
    parts = cut(bands(segments))
    # aggregates that are joined back are made tables first: AQE can then split the joins where a core is hot
    distinct = cut(parts.groupBy("ch", "wh").agg(F.sum("weight").alias("weight"), F.first("seg").alias("seg")))
    kinds = parts.groupBy("ch", "wh").agg(F.sum("weight").alias("w")).groupBy("ch").agg(F.count(F.lit(1)).alias("kinds"), F.sum("w").alias("all"))
    cores = distinct.join(cut(kinds.where(F.col("all") > 1)), "ch").select(F.col("ch").alias("mh"), F.col("wh").alias("sh"), "weight", "seg", "kinds")
    cores = cut(cores)
    hits = expand(cores.where(F.col("kinds") <= GROUP_LIMIT)).unionByName(count_windows(cores.where(F.col("kinds") > GROUP_LIMIT)))
    hits = hits.where(F.size("spans") > 0).select(F.col("mh").alias("ch"), F.col("sh").alias("wh"), F.explode("spans").alias("x"))
    placed = parts.select("mh", "sh", "k0", "ch", "wh").join(hits, ["ch", "wh"])
    span = F.struct((F.col("k0") + F.col("x.a")).alias("a"), (F.col("k0") + F.col("x.b")).alias("b"))
    return placed.groupBy("mh", "sh").agg(F.collect_list(span).alias("spans"))


def release(spark) -> None:
    """Let Spark drop shuffle files of jobs that a checkpoint has cut off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(dk, start, end): byte ranges of documents that repeated strings cover; they may overlap."""
    spark = docs.sparkSession
    found = runs(docs)
    # as a table of its own it leaves the join two plain shuffles, which AQE can split where a minimizer is hot
    often = cut(found.groupBy("mh").agg(F.sum("reps").alias("n")).where("n > 1").select("mh"))
    again = cut(found.join(often, "mh"))
    release(spark)
    distinct = cut(again.groupBy("mh", "sh").agg(F.sum("reps").alias("weight"), F.min(F.struct("dk", "at")).alias("rep")))
    groups = cut(distinct.groupBy("mh").agg(F.count(F.lit(1)).alias("kinds")))
    segs = cut(distinct.join(groups, "mh").select("mh", "sh", "weight", "rep.dk", "rep.at", "kinds", (F.col("kinds") > GROUP_LIMIT).alias("hot")))
    settled = segs.where("kinds = 1").select(
        "mh", "sh", F.array(F.struct(F.lit(0).alias("a"), F.col("at").bitwiseAND(127).cast("int").alias("b"))).alias("spans")
    )
    texts = cut(fetch(docs, segs.where("kinds > 1")))
    release(spark)
    hits = settled.unionByName(expand(texts.where("not hot"))).unionByName(split_hot(texts.where("hot"))).where(F.size("spans") > 0)
    placed = again.join(hits, ["mh", "sh"]).select("dk", F.shiftright("at", 14).alias("start"), F.col("at").bitwiseAND(127).alias("n"), "reps", F.explode("spans").alias("x"))
    # a segment that comes several times in a row is repeated as a whole, so its span is (0, n)
    return placed.select("dk", (F.col("start") + F.col("x.a")).alias("start"), (F.col("start") + (F.col("reps") - 1) * F.col("n") + F.col("x.b") + (LEAST - 1)).alias("end"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_bytes, removed (byte ranges, merged), kept (the remaining bytes)."""
    docs = keyed(docs)
    ranges = cut(repeated_windows(docs).groupBy("dk").agg(F.collect_list(F.struct("start", "end")).alias("ranges")))
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            raw, merged, kept = data.tobytes(), [], []
            for a, b, found in zip(offs[:-1].tolist(), offs[1:].tolist(), rows.column(2).to_pylist(), strict=True):
                spans = merge(found or [])
                at, parts = 0, []
                for s in spans:
                    parts.append(raw[a + at : a + s["start"]])
                    at = s["end"]
                parts.append(raw[a + at : b])
                merged.append(spans)
                kept.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(offs)), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                ["doc_id", "text", "n_bytes", "removed", "kept"],
            )

    joined = docs.select("doc_id", "text", "dk").join(ranges, "dk", "left").select("doc_id", "text", "ranges")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined, run, f"doc_id {kind}, text string, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def merge(ranges: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in sorted(ranges, key=lambda r: (r["start"], r["end"])):
        if out and r["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], r["end"])
        else:
            out.append({"start": r["start"], "end": r["end"]})
    return out


def suffix_dedup_digest(docs: DataFrame) -> DataFrame:
    """Query form: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(docs).select(
        "doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
