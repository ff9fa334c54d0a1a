"""MinHash near-dedup with odd sketches.

1. One pass over the texts gives each document the hash of its shingle set, ``SAMPLES`` MinHash samples
   banded into ``n_bands`` keys, and an odd sketch: the samples folded into a parity bitmap.
2. Documents with equal sets form a class; from here on only classes count, however many copies they have.
3. Two classes are candidates when they share a band bucket and the XOR population count of their odd sketches allows
   the threshold. Sketches travel to the buckets; texts are fetched only for candidates, and confirm or refuse them on
   the full shingle sets.
4. First come ``STAR_ROUNDS`` rounds of stars: each class is tried against the ``HUBS`` classes, out of one hub a bucket,
   with which it shares most buckets. The components of these links settle groups of near copies of any size with a few
   texts a class.
5. Then the remaining candidates, pairs of one bucket in different components, are tried: a bucket is dealt into blocks,
   those of a large component being its own, sketches are compared by pairs of blocks (of one component: not at all), and
   only classes with a candidate in a pair of finer blocks bring their texts there. Every piece of work returns a spanning
   forest of confirmed links, never all pairs.
6. The components of all confirmed links are the groups.

The threshold is a parameter: op1 passes ``THRESHOLD``, the pipeline's stage takes ``OPEN_THRESHOLD``. The number of
bands follows it: a pair at the threshold shares no band with probability 5e-7 at most, and its odd sketch lies
beyond the limit (``sketch_limit``) with probability below 1e-6; both fall fast above the threshold. There is no
cap on buckets, partners or candidates.

Edge cases: words are lower-cased (A-Z) runs of non-blanks; a text with 1 to 4 words is one shingle; a null,
empty or blank text has none, links with nothing and is kept; repeated rows are copies; a null id never
becomes a component's id while the component has another, and its row is kept only if all its ids are null;
an empty table gives an empty result; other columns are not read. Classes are told apart by 128 bits of hash
over their sets and by their size; a link counts only if the sets of words themselves confirm it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import textbytes as tb
from quarry.llm.sampling import row_keys, under_cover, uncovered
from quarry.llm.suffix_dedup import release
from quarry.operators.components import connected_components
from quarry.session import arrow_map, cut

SHINGLE = 5
ROWS, BANDS = 5, 25  # as many bands as THRESHOLD needs
SAMPLES = 192
SKETCH_BITS = 1024
THRESHOLD = 85  # per cent, of op1
OPEN_THRESHOLD = 80  # per cent, where no contract names one
BLOCK_DOCS = 64
FINE = 8  # at least so many of them in a block of sketches
STAR_ROUNDS, HUBS = 2, 3
#: Up to so many bytes of keys go to the documents; beyond, documents and keys meet in a shuffle.
BROADCAST_BYTES = 16 << 20
BLOCK_SHINGLES = 400_000

_rng = np.random.Generator(np.random.PCG64(0x0DD))
_FLIP = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPREAD = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WIDTH = SKETCH_BITS // 8


def sketch_limit(threshold: float = THRESHOLD / 100, deviations: float = 5.0) -> int:
    """Largest XOR population count that a pair at the threshold is expected to show, with a margin.

    The number of differing samples is binomial; each puts two items into the symmetric difference, and
    m items flip n/2 (1 - exp(-2m/n)) bits, with a variance of at most m / 4 more.
    """
    differing = SAMPLES * (1 - threshold)
    items = 2 * (differing + deviations * math.sqrt(differing * threshold))
    bits = SKETCH_BITS / 2 * (1 - math.exp(-2 * items / SKETCH_BITS))
    return math.ceil(bits + 2)


def n_bands(threshold: int = THRESHOLD) -> int:
    """Bands of which a pair at the threshold shares none with probability 5e-7 at most."""
    bands = math.ceil(math.log(5e-7) / math.log(1 - (threshold / 100) ** ROWS))
    if ROWS * bands > SAMPLES:
        raise ValueError(f"a threshold of {threshold} % takes more than {SAMPLES} samples")
    return bands


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes sorted by (row, hash), and the offset of each row's first."""
    n = len(offs) - 1
    low = tb.lowered(data)
    s, e, rows = tb.words(low, offs)
    codes = tb.span_hashes(low, s, e)
    h, at = tb.gram_hashes(codes, rows, SHINGLE)
    r = rows[at]
    n_words = np.bincount(rows, minlength=n)
    first = np.concatenate([[0], np.cumsum(n_words)])[:-1]
    extra_h, extra_r = [h], [r]
    for k in range(1, SHINGLE):
        short = np.flatnonzero(n_words == k)
        if len(short):
            extra_h.append(tb.whole_hash(codes, first[short], k))
            extra_r.append(short)
    h, r = np.concatenate(extra_h), np.concatenate(extra_r)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[new], r[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).astype(np.int64)


def set_hashes(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of non-empty sets."""
    size = np.diff(at).astype(np.uint64)
    return tuple(tb.mix(np.add.reduceat(tb.mix(h ^ np.uint64(salt)), at[:-1]) + size) for salt in (0xA5A5A5A5, 0x3C3C3C3C3C))


def signatures_of(h: np.ndarray, at: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x bands) and odd sketch (rows x bytes) of non-empty sets."""
    starts = at[:-1]
    n = len(starts)
    keys = np.zeros((n, bands), np.uint64)
    bits = np.zeros((n, SKETCH_BITS), np.uint8)
    every = np.arange(n)
    for j in range(SAMPLES):
        low = np.minimum.reduceat((h ^ _FLIP[j]) * _SPREAD[j], starts)
        if j < ROWS * bands:
            keys[:, j // ROWS] += tb.mix(low + np.uint64(j)) * tb.ORDER[j % ROWS]
        bits[every, (tb.mix(low ^ _SPREAD[j]) % np.uint64(SKETCH_BITS)).astype(np.int64)] ^= 1
    return tb.mix(keys + np.arange(bands, dtype=np.uint64)), np.packbits(bits, axis=1)


def signatures(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """doc_id, k1, k2, n_shingles, u1, u2 (set hashes), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, "text", tb.SLICE_BYTES // 2):
            h, at = shingle_sets(data, offs)
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            n = len(sizes)
            u1, u2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            band_at = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
            sketch_at = np.concatenate([[0], np.cumsum((sizes > 0) * WIDTH)]).astype(np.int32)
            keys, sketch = np.zeros((0, bands), np.uint64), np.zeros((0, WIDTH), np.uint8)
            if len(full):
                some = np.append(at[full], at[-1])
                u1[full], u2[full] = set_hashes(h, some)
                keys, sketch = signatures_of(h, some, bands)
            yield pa.RecordBatch.from_arrays(
                [
                    *rows.columns[:3],
                    pa.array(sizes.astype(np.int64)),
                    pa.array(u1.view(np.int64)),
                    pa.array(u2.view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(band_at), pa.array(keys.reshape(-1).view(np.int64))),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(sketch_at.tobytes()), pa.py_buffer(sketch.tobytes())]),
                ],
                ["doc_id", "k1", "k2", "n_shingles", "u1", "u2", "bands", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", *row_keys(), "text")
    return arrow_map(keyed, run, f"doc_id {kind}, k1 long, k2 long, n_shingles long, u1 long, u2 long, bands array<long>, sketch binary")


def may_link(differ: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether differing sketch bits and set sizes allow the threshold."""
    return (differ <= sketch_limit(threshold / 100)) & (100 * np.minimum(a, b) >= threshold * np.maximum(a, b))


def shared_buckets(classes: DataFrame) -> DataFrame:
    """(g, cid): the buckets that hold two classes or more."""
    banded = classes.select(F.explode("bands").alias("g"), "cid")
    # here and below: an aggregate that is joined back on its key is made a table first, so that the join has two
    # plain shuffles, which AQE can split where a key is hot
    often = cut(banded.groupBy("g").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo <> hi").select("g"))
    return banded.join(often, "g")


def star_candidates(known: DataFrame, shared: DataFrame, turn: int, threshold: int) -> DataFrame:
    """(cid, hub, label, hub_label, n): each class with hubs of other labels, where the sketches allow a link.

    A bucket's hub is its first class in the order of the turn (of cid in the first, where each class is its own label).
    """
    rows = shared.join(known.select("cid", "label"), "cid") if turn else shared.withColumn("label", F.col("cid"))
    order = F.struct((F.col("cid") if turn == 0 else F.xxhash64("cid", F.lit(turn))).alias("o"), "cid", "label")
    hubs = cut(rows.groupBy("g").agg(F.min(order).alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g", F.col("h.cid").alias("hub"), F.col("h.label").alias("hub_label")))
    met = rows.join(hubs, "g").where("label <> hub_label").groupBy("cid", "label", "hub", "hub_label").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("cid").orderBy(F.desc("n"), "hub")  # as many rows as the class has bands, at most
    star = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= HUBS).select("cid", "label", "hub", "hub_label")
    side = lambda k, n: known.select(F.col("cid").alias(k), F.col("n_shingles").alias(f"n{n}"), F.col("sketch").alias(f"s{n}"))
    both = star.join(side("cid", 1), "cid").join(side("hub", 2), "hub").select("cid", "hub", "label", "hub_label", "n1", "n2", "s1", "s2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, WIDTH // 8) for c in (6, 7))
            n1, n2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (4, 5))
            yield batch.select([0, 1, 2, 3, 4]).rename_columns(["cid", "hub", "label", "hub_label", "n"]).filter(pa.array(may_link(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64), n1, n2, threshold)))

    return arrow_map(both, run, "cid long, hub long, label long, hub_label long, n long")


def star_groups(stars: DataFrame) -> DataFrame:
    """(g, p, q, side, cid, label): the work of ``confirmed``: a hub (side -1) meets its members, dealt into blocks."""
    n_blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = cut(stars.groupBy("hub").agg(n_blocks.alias("n_blocks"), F.first("hub_label").alias("hub_label")))
    q = F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int")
    members = stars.select("hub", "cid", "label").join(blocks.select("hub", "n_blocks"), "hub").select(F.col("hub").alias("g"), F.lit(-1).alias("p"), q.alias("q"), q.alias("side"), "cid", "label")
    hubs = blocks.select(F.col("hub").alias("g"), F.lit(-1).alias("p"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("q"), F.lit(-1).alias("side"), F.col("hub").alias("cid"), F.col("hub_label").alias("label"))
    return members.unionByName(hubs)


def blocks_of_buckets(rows: DataFrame) -> DataFrame:
    """(g, cid, label, b, fine, others) of (g, cid, label, n_shingles), for buckets with several labels.

    Labels with more classes in a bucket than a block holds have blocks of their own, the others share some; ``others``
    are the blocks that b is to be compared with: all but those of the same large label.
    """
    most = BLOCK_DOCS * FINE
    cells = cut(rows.groupBy("g", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n_shingles").alias("w")))
    whole = cells.groupBy("g").agg(
        F.count(F.lit(1)).alias("labels"),
        F.ceil(F.coalesce(F.sum(F.when(F.col("c") <= most, F.col("c"))), F.lit(0)) / most).cast("int").alias("pool"),
        F.coalesce(F.sum(F.when(F.col("c") > most, F.ceil(F.col("c") / most))), F.lit(0)).cast("int").alias("own_all"),
        F.greatest(F.lit(FINE), F.ceil(most * F.sum("w") / F.sum("c") / BLOCK_SHINGLES)).cast("int").alias("parts"),
    )
    whole = cut(whole.where("labels > 1").select("g", "pool", (F.col("pool") + F.col("own_all")).alias("blocks"), "parts"))
    large = cells.where(F.col("c") > most).withColumn("own", F.ceil(F.col("c") / most).cast("int"))
    before = F.sum("own").over(Window.partitionBy("g").orderBy("label").rowsBetween(Window.unboundedPreceding, -1))
    large = cut(large.select("g", "label", "own", F.coalesce(before, F.lit(0)).cast("int").alias("before")))
    dealt = rows.join(whole, "g").join(large, ["g", "label"], "left")
    first = F.col("pool") + F.col("before")
    h = F.xxhash64("cid", F.lit("block"))
    block = F.when(F.col("own").isNull(), F.pmod(h, F.col("pool"))).otherwise(first + F.pmod(h, F.col("own"))).cast("int")
    apart = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.col("own").isNull() | (o < first) | (o >= first + F.col("own")))
    fine = F.pmod(F.xxhash64("cid", F.lit("fine")), F.col("parts")).cast("int")
    return dealt.select("g", "cid", "label", block.alias("b"), fine.alias("fine"), F.col("parts"), apart.alias("others"))


def rest_groups(known: DataFrame, shared: DataFrame, threshold: int) -> DataFrame:
    """The same as ``star_groups`` for all candidates whose labels differ: of each bucket, the classes with one in a
    pair of fine blocks. A pair is taken up only in the first bucket that it shares."""
    dealt = blocks_of_buckets(shared.join(known.select("cid", "label", "n_shingles"), "cid"))
    rows = (
        dealt.join(known.drop("label"), "cid")
        .withColumn("o", F.explode("others"))
        .select("g", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", (F.col("b") * F.col("parts") + F.col("fine")).alias("side"), "cid", "label", "n_shingles", "sketch", "bands")
        .repartition("g", "p", "q")
        .sortWithinPartitions("g", "p", "q", "b", "cid")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple] = []
        out: set[tuple] = set()

        def flush() -> None:
            if len(held) > 1:
                out.update(candidates_of_bucket(now, held, threshold))
            held.clear()

        def emit() -> pa.RecordBatch:
            rows = sorted(out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_DEALT_ARROW)], ["g", "p", "q", "side", "cid", "label"])

        for batch in batches:
            for g, p, q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, p, q) != now:
                    flush()
                    now = (g, p, q)
                held.append(tuple(row))
            if len(out) > 10_000:
                yield emit()
        flush()
        yield emit()

    return arrow_map(rows, run, "g long, p int, q int, side int, cid long, label long")


_DEALT_ARROW = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def candidates_of_bucket(pair: tuple, rows: list[tuple], threshold: int) -> set[tuple]:
    """(bucket, p, q, side, cid, label) of both ends of each candidate, from the rows (block, fine block, cid, label, size,
    sketch, bands) of a pair (bucket, block, block)."""
    bucket, one, other = pair
    block = np.array([r[0] for r in rows])
    fine, cid, label, size = (np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
    sketch = np.frombuffer(b"".join(r[5] for r in rows), np.uint64).reshape(len(rows), -1)
    bands = np.array([r[6] for r in rows])
    two = one != other
    right = np.flatnonzero(block == other)
    out: set[tuple] = set()
    for x in np.flatnonzero(block == one).tolist():
        y = right if two else right[right > x]
        y = y[label[y] != label[x]]
        y = y[may_link(np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1, dtype=np.int64), size[y], size[x], threshold)]
        if len(y):
            y = y[bands[x][np.argmax(bands[y] == bands[x], axis=1)] == bucket]
        for z in y.tolist():
            p, q = sorted((int(fine[x]), int(fine[z])))
            for end in (x, z):
                out.add((bucket, p, q, int(fine[end]), int(cid[end]), int(label[end])))
    return out


def word_set(text: bytes) -> frozenset:
    """The shingles of a text as strings of words."""
    w = text.translate(_LOWER_BYTES).split()
    return frozenset(b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else frozenset()


_LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def agree(x: frozenset, y: frozenset, threshold: int) -> bool:
    both = len(x & y)
    return 100 * both >= threshold * (len(x) + len(y) - both)


def link_blocks(cids: list[int], sides: np.ndarray, labels: list[int], sketches: np.ndarray, sets: list[np.ndarray], texts: list[bytes], threshold: int) -> list[tuple[int, int]]:
    """Spanning forest, over labels, of the confirmed links inside one block (one side) or between two blocks."""
    n = len(cids)
    two = bool((sides != sides[0]).any()) if n else False
    left = np.flatnonzero(sides == sides[0]) if two else np.arange(n)
    right = np.flatnonzero(sides != sides[0]) if two else np.arange(n)
    sizes = np.array([len(x) for x in sets], np.int64)
    differ = np.bitwise_count(sketches[left][:, None, :] ^ sketches[right][None, :, :]).sum(axis=2, dtype=np.int64)
    ok = may_link(differ, sizes[left][:, None], sizes[right][None, :], threshold)
    if not two:
        ok &= np.arange(n)[:, None] < np.arange(n)[None, :]
    i, j = np.nonzero(ok)
    order = np.argsort(differ[i, j], kind="stable")
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    exact = lru_cache(16)(lambda k: word_set(texts[k]))
    found = []
    for x, y in zip(left[i[order]].tolist(), right[j[order]].tolist(), strict=True):
        rx, ry = root(labels[x]), root(labels[y])
        if rx == ry:
            continue
        # the hashed sets refuse most pairs at once; what they let pass, the words have to confirm
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * both < threshold * (int(sizes[x]) + int(sizes[y]) - both):
            continue
        if agree(exact(x), exact(y), threshold):
            parent[rx] = ry
            found.append((labels[x], labels[y]))
    return found


def _to_rows(keys: DataFrame, row_bytes: int) -> DataFrame:
    """A table of its own, with a hint to broadcast it if its rows are few enough for that."""
    return F.broadcast(keys) if keys.count() * row_bytes <= BROADCAST_BYTES else keys


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, u1, u2, sketch, text): one text of every wanted class."""
    texts = docs.select(*row_keys(), "text")
    # rows equal in id and text all come
    keys = _to_rows(wanted.select("k1", "k2", "cid", "u1", "u2", "sketch"), 72 + WIDTH)
    return texts.join(keys, ["k1", "k2"]).select("cid", "u1", "u2", "sketch", "text").dropDuplicates(["cid"])


def confirmed(work: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) over labels that span every group of confirmed links of the work (g, p, q, side, cid, label)."""
    dealt = (
        work.join(texts, "cid")
        .select("g", "p", "q", "side", "cid", "label", "u1", "u2", "sketch", "text")
        .repartition("g", "p", "q")
        .sortWithinPartitions("g", "p", "q", "side", "cid")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: list[tuple] = []
        out: list[tuple[int, int]] = []

        def flush() -> None:
            seen: set[int] = set()
            once = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]
            if len(once) > 1:
                sketches = np.frombuffer(b"".join(r[3] for r in once), np.uint64).reshape(len(once), -1)
                out.extend(link_blocks([r[0] for r in once], np.array([r[1] for r in once]), [r[2] for r in once], sketches, [r[4] for r in once], [r[5] for r in once], threshold))
            rows.clear()

        def emit() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
            out.clear()
            return batch

        for part, data, offs in tb.slices(batches, "text"):
            h, at = shingle_sets(data, offs)
            u1, u2 = set_hashes(h, at) if len(h) else (np.zeros(0), np.zeros(0))
            raw = data.tobytes()
            keys = zip(*(part.column(c).to_pylist() for c in (0, 1, 2)), strict=True)
            sides, cids, labels, w1, w2, sketches = (part.column(c).to_pylist() for c in range(3, 9))
            for k, key in enumerate(keys):
                if key != now:
                    flush()
                    now = key
                # a text whose set is not the class's own would be no witness of its links
                if at[k + 1] > at[k] and int(u1[k].view(np.int64)) == w1[k] and int(u2[k].view(np.int64)) == w2[k]:
                    rows.append((cids[k], sides[k], labels[k], sketches[k], h[at[k] : at[k + 1]].copy(), raw[offs[k] : offs[k + 1]]))
            if len(out) > 10_000:
                yield emit()
        flush()
        yield emit()

    return arrow_map(dealt, run, "a long, b long")


def relabelled(known: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` with the labels that the links join made one."""
    found = connected_components(links).withColumnsRenamed({"node": "label", "component": "top"})
    return cut(known.join(found, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top"))


def grouped(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of the documents, and classes (u1, u2, n_shingles, keeper, component) of all but empty sets.

    ``keeper`` is the first row of a class, as (id is null, doc_id, k1, k2).
    """
    spark = docs.sparkSession
    sig = cut(signatures(docs, n_bands(threshold)))
    keeper = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")
    classes = sig.where("n_shingles > 0").groupBy("u1", "u2", "n_shingles").agg(F.min(keeper).alias("keeper"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumns({"cid": F.monotonically_increasing_id(), "k1": F.col("keeper.k1"), "k2": F.col("keeper.k2")}))
    shared = cut(shared_buckets(classes))
    wanted = cut(classes.join(shared, "cid", "left_semi"))  # the classes with a partner in some bucket
    texts = cut(texts_of(docs, wanted))
    release(spark)
    known = wanted.select("cid", F.col("cid").alias("label"), "n_shingles", "sketch", "bands")
    for turn in range(STAR_ROUNDS):
        stars = cut(star_candidates(known, shared, turn, threshold))
        known = relabelled(known, confirmed(star_groups(stars), texts, threshold))
    release(spark)
    known = relabelled(known, confirmed(cut(rest_groups(known, shared, threshold)), texts, threshold))
    linked = classes.select("cid", "u1", "u2", "n_shingles", "keeper").join(known.select("cid", "label"), "cid", "left")
    linked = cut(linked.select("u1", "u2", "n_shingles", "keeper", F.coalesce("label", "cid").alias("component")))
    release(spark)
    return sig, linked


def near_dedup(docs: DataFrame, threshold: int = OPEN_THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; pairs of at least ``threshold`` per cent are linked."""
    sig, linked = grouped(docs, threshold)
    firsts = cut(linked.groupBy("component").agg(F.min("keeper.doc_id").alias("component_id")))
    named = linked.join(firsts, "component").select("u1", "u2", "n_shingles", "component_id")
    placed = sig.where("n_shingles > 0").select("doc_id", "n_shingles", "u1", "u2").join(named, ["u1", "u2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    alone = sig.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, threshold: int = OPEN_THRESHOLD) -> DataFrame:
    """The documents that stay, one of each group, with the columns of ``docs``: the first by id (nulls last)."""
    sig, linked = grouped(docs.select("doc_id", "text"), threshold)
    first = linked.groupBy("component").agg(F.min("keeper").alias("keeper")).select("keeper.k1", "keeper.k2")
    kept = cut(first.unionByName(sig.where("n_shingles = 0").select("k1", "k2").distinct()))
    copies = cut(sig.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2"))
    release(docs.sparkSession)
    covered, names = under_cover(docs)
    keyed = covered.withColumn("doc_id", F.col(names[docs.columns.index("doc_id")])).select(*names, *row_keys())
    held = keyed.join(_to_rows(kept, 64), ["k1", "k2"], "left_semi")
    if copies.isEmpty():  # else rows equal in id and text have to be told apart from the others
        return uncovered(held, docs, names)
    copies = _to_rows(copies, 64)
    once = uncovered(held.join(copies, ["k1", "k2"], "left_anti"), docs, names)
    return once.unionByName(uncovered(held.join(copies, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]), docs, names))
