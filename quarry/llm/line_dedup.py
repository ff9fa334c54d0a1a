"""Substring dedup by line or paragraph hashing.

Texts are cut into units: lines, paragraphs split by blank lines, or (the default) the sentences of lines, so that a
passage pasted into the middle of a longer line still consists of units of its own. What is compared are the units of
``MIN_WORDS`` words or more, and two things that stand in for paragraphs where a passage has no such units of its own:

* blocks: a unit with as many of the next ones as give ``BLOCK_WORDS`` words (short lines in a row);
* pieces of units of more than ``PIECE_OVER`` words: a piece ends after a word whose code points' sum is divisible by
  ``PIECE_MOD`` and, counted from there, after every ``PIECE_WORDS`` words, so that equal passages are cut alike wherever
  they stand in a longer unit. Pieces of ``MIN_WORDS`` words or more are compared with each other and with units.

The digest is that of the lower-cased (A-Z) words in order, so case and white space do not matter. Digests are grouped
globally; the unit or piece with the smallest (doc_id, place) stays and the others are removed; a block is removed
where a document of smaller (doc_id) holds the same one. What is removed is reported as code-point spans of the original text.

``MIN_WORDS`` is what tells a passage from the short phrases (greetings, license lines, one-word lines) that many
documents have in common without being copies: what is below it stays unless it belongs to a block. A block of units that
are all long enough says nothing that its units don't, and isn't made.

Edge cases: null and empty texts have no units; rows that agree in id and text are one document and get the same spans;
a null id ranks last; an empty table gives an empty result; other columns are not read. Digests have 128 bits, the numbers
of words and bytes among what they are made from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textbytes as tb
from quarry.llm.suffix_dedup import release
from quarry.session import arrow_map, cut

MIN_WORDS = 14
BLOCK_WORDS = 40
PIECE_OVER, PIECE_WORDS, PIECE_MOD = 25, 24, 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def _units(data: np.ndarray, offs: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = data != 10
    if kind == "sentence":  # the blank after a full stop, question or exclamation mark ends a unit as a line feed does
        inside[1:] &= ~(_STOP[data[:-1]] & (data[1:] == 32))
        inside[offs[:-1][np.diff(offs) > 0]] = data[offs[:-1][np.diff(offs) > 0]] != 10
    s, e, rows = tb.runs(inside, offs)
    if kind == "paragraph" and len(s):
        # lines that follow each other without a blank line between belong together
        joins = np.zeros(len(s), bool)
        joins[1:] = (rows[1:] == rows[:-1]) & (s[1:] == e[:-1] + 1)
        heads = np.flatnonzero(~joins)
        tails = np.append(heads[1:], len(s)) - 1
        s, e, rows = s[heads], e[tails], rows[heads]
    return s, e, rows


def _word_marks(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """Words after which a piece ends: the sum of their code points is divisible by ``PIECE_MOD``.

    Of a character's bytes only the last counts modulo 32: the others stand for multiples of 64.
    """
    last = np.ones(len(data), bool)
    last[:-1] = (data[1:] & 0xC0) != 0x80
    run = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.where(last, data & (PIECE_MOD - 1), 0), out=run[1:])
    return (run[we] - run[ws]) % PIECE_MOD == 0


@dataclass
class Layout:
    """Units with a word (s, e, row; words a to b) and the tiles that they consist of.

    A unit is one tile, or the pieces of a longer one; tiles (ts, te; words ta to tb; unit tu) leave no byte of it out.
    ``first`` is the number of each unit's first tile, with one more at the end.
    """

    s: np.ndarray
    e: np.ndarray
    row: np.ndarray
    a: np.ndarray
    b: np.ndarray
    ts: np.ndarray
    te: np.ndarray
    ta: np.ndarray
    tb: np.ndarray
    tu: np.ndarray
    first: np.ndarray
    ws: np.ndarray
    we: np.ndarray


def layout(data: np.ndarray, offs: np.ndarray, kind: str) -> Layout:
    s, e, r = _units(data, offs, kind)
    ws, we, _ = tb.words(data, offs)
    a, b = np.searchsorted(ws, s), np.searchsorted(ws, e)
    keep = b > a
    s, e, r, a, b = (x[keep] for x in (s, e, r, a, b))
    n = len(ws)
    unit_of = np.repeat(np.arange(len(s)), b - a)
    long = (b - a > PIECE_OVER)[unit_of]
    head = np.zeros(n, bool)
    head[a] = True
    marked = _word_marks(tb.lowered(data), ws, we)
    begins = head.copy()
    begins[1:] |= long[1:] & marked[:-1]
    at = np.flatnonzero(begins)
    place = np.arange(n) - at[np.cumsum(begins) - 1] if n else np.zeros(0, np.int64)
    ta = np.flatnonzero(begins | (long & (place % PIECE_WORDS == 0)))
    tu = unit_of[ta]
    ts = np.where(head[ta], s[tu], ws[ta])
    follows = np.append(tu[1:] == tu[:-1], False) if len(ta) else np.zeros(0, bool)
    te = np.where(follows, np.append(ts[1:], 0)[: len(ts)], e[tu])
    first = np.searchsorted(tu, np.arange(len(s) + 1))
    return Layout(s, e, r, a, b, ts, te, ta, np.append(ta[1:], n)[: len(ta)], tu, first, ws, we)


def _items(x: Layout, min_words: int, block_words: int) -> tuple[np.ndarray, ...]:
    """What is compared: first tile and the one after the last, whether it is a block."""
    words = x.b - x.a
    whole = np.flatnonzero(words >= min_words)
    parts = np.flatnonzero((x.tb - x.ta >= min_words) & (np.diff(x.first)[x.tu] > 1)) if len(x.tu) else np.zeros(0, np.int64)
    upto = np.concatenate([[0], np.cumsum(words)])
    short = np.concatenate([[0], np.cumsum(words < min_words)])
    u = np.arange(len(words))
    end = np.searchsorted(upto, upto[:-1] + block_words)  # the unit after the block's last
    fits = end <= len(words)
    u, end = u[fits], end[fits]
    some = (end - u > 1) & (x.row[end - 1] == x.row[u]) & (short[end] > short[u])
    u, end = u[some], end[some]
    t0 = np.concatenate([x.first[whole], parts, x.first[u]])
    t1 = np.concatenate([x.first[whole + 1], parts + 1, x.first[end]])
    return t0, t1, np.repeat([False, True], [len(whole) + len(parts), len(u)])


def items(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Units, pieces and blocks: (doc_id, text_key, at, h1, h2); ``at`` holds the first tile of the text, the one after the
    last and whether it is a block, in one number: many more rows are shuffled than stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            x = layout(data, offs, kind)
            t0, t1, block = _items(x, min_words, block_words)
            r = x.row[x.tu[t0]]
            base = np.searchsorted(x.row[x.tu], r)  # of the text's first tile
            a, b = x.ta[t0], x.tb[t1 - 1]
            codes = tb.span_hashes(tb.lowered(data), x.ws, x.we)
            digests = []
            for of_word in (codes, tb.mix(codes ^ tb.STEP)):
                pref = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(of_word * tb.powers("up", len(codes)), out=pref[1:])
                digests.append(tb.mix((pref[b] - pref[a]) * tb.powers("down", len(codes) + 1)[a]))
            size = np.zeros(len(x.ws) + 1, np.int64)
            np.cumsum(x.we - x.ws, out=size[1:])
            # blocks have digests of their own, and so have other numbers of words or bytes
            digests[1] = tb.mix(digests[1] ^ tb.mix(((size[b] - size[a]) << 32 | (b - a) << 1 | block).astype(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(r)),
                    rows.column(1).take(pa.array(r)),
                    pa.array((t0 - base) << 32 | (t1 - base) << 1 | block),
                    *(pa.array(h.view(np.int64)) for h in digests),
                ],
                ["doc_id", "text_key", "at", "h1", "h2"],
            )

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(keyed, run, f"doc_id {kind_of_id}, text_key long, at long, h1 long, h2 long")


def removals(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document that loses something: (doc_id, text_key, gone array<struct<t0,t1>>: ranges of its tiles)."""
    every = items(docs, kind, max(1, min_words), block_words)
    digest = ["h1", "h2"]
    # of a block only the document counts
    place = F.when(F.col("at") % 2 == 1, F.lit(0)).otherwise(F.shiftright("at", 32))
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", place.alias("place"))
    repeated = every.groupBy(*digest).agg(F.min(rank).alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated = cut(repeated)  # a table of its own: AQE can then split the join where a line is very common
    gone = every.join(repeated, digest).where(F.col("keeper") != rank)
    tiles = F.struct(F.shiftright("at", 32).cast("int").alias("t0"), F.shiftright(F.col("at").bitwiseAND((1 << 32) - 1), 1).cast("int").alias("t1"))
    return gone.groupBy("doc_id", "text_key").agg(F.collect_set(tiles).alias("gone"))


def line_dedup(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with ``kept_text`` and the removed spans of the original text.

    Columns: doc_id, text, n_units, removed (array of start, end in code points), kept_text. The separator right after a
    unit that goes as a whole goes with it.
    """
    found = cut(removals(docs, kind, min_words, block_words).select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k"), "gone"))
    release(docs.sparkSession)
    left = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    joined = left.join(found, (F.col("text_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left").select("doc_id", "text", "gone")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text"):
            x = layout(data, offs, kind)
            counts = np.bincount(x.row, minlength=rows.num_rows).astype(np.int64)
            span, whole, of = _spans(x, rows.column(2), rows.num_rows)
            stays = np.zeros(len(data) + 2, np.int64)
            s, e = x.ts[span[0]], x.te[span[1]]
            # the byte after a whole unit is its separator, if the text goes on
            after = e + (whole & (e < offs[1:][of]))
            np.add.at(stays, s, 1)
            np.add.at(stays, after, -1)
            kept = np.cumsum(stays)[: len(data)] == 0
            sizes = np.zeros(len(data) + 1, np.int64)
            np.cumsum(kept, out=sizes[1:])
            texts = pa.Array.from_buffers(pa.string(), rows.num_rows, [None, pa.py_buffer(sizes[offs].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[kept]))])
            chars = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
            base = chars[offs[:-1]][of]
            cells = pa.StructArray.from_arrays([pa.array((chars[s] - base).astype(np.int32)), pa.array((chars[e] - base).astype(np.int32))], ["start", "end"])
            removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(rows.num_rows + 1)).astype(np.int32)), cells)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts), removed, texts], ["doc_id", "text", "n_units", "removed", "kept_text"])

    kind_of_id = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(joined, cut_out, f"doc_id {kind_of_id}, text string, n_units long, removed array<struct<start:int,end:int>>, kept_text string")


def _spans(x: Layout, gone: pa.Array, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Maximal runs of removed tiles inside a unit: (first, last) tile, whether it is the whole unit, and the row."""
    lists = gone.fill_null([]) if gone.null_count else gone
    per = np.asarray(lists.value_lengths(), np.int64) if n else np.zeros(0, np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(n), per)
    base = np.searchsorted(x.row[x.tu], row)
    marks = np.zeros(len(x.tu) + 1, np.int64)
    np.add.at(marks, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
    np.add.at(marks, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
    out = np.cumsum(marks)[:-1] > 0
    edge = np.append(x.tu[1:] != x.tu[:-1], True) if len(x.tu) else np.zeros(0, bool)
    opens, shuts = out.copy(), out.copy()
    opens[1:] &= ~out[:-1] | edge[:-1]
    shuts[:-1] &= ~out[1:] | edge[:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(shuts)
    unit = x.tu[first]
    return (first, last), (first == x.first[unit]) & (last + 1 == x.first[unit + 1]), x.row[unit]


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    """Query form: spans and digest in place of the texts."""
    return line_dedup(docs).select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("removed", lambda r: F.concat_ws(":", r["start"], r["end"])), ",").alias("spans"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )
