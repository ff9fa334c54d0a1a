"""Vectorised work on UTF-8 text columns: Arrow buffers in, numpy arrays out.

A slice holds whole documents (about ``SLICE_BYTES`` of text, or one longer document), so memory per
task is bounded by the slice and the longest document, not by the Arrow batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(0x5EED))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """STEP**i (up) or STEP**-i (down) mod 2**64 for i < n."""
    have = _powers[kind]
    if len(have) < n:
        base = STEP if kind == "up" else STEP_INVERSE
        more = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        more[0] = 1
        have = _powers[kind] = np.multiply.accumulate(more)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string array; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, pa.scalar("", texts.type))
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, at, data = texts.buffers()
    offs = np.frombuffer(at, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut Arrow batches into slices of whole rows: (rows, bytes, offsets)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = buffers(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
            hi = min(hi, batch.num_rows, lo + 20_000)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that stay inside one row: starts, ends, rows."""
    n = len(inside)
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = offs[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, rows."""
    return runs(~_WS[data], offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """64-bit hash of data[start:end] for every span; equal bytes give equal hashes."""
    pref = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(code[data] * powers("up", len(data)), out=pref[1:])
    return mix((pref[ends] - pref[starts]) * powers("down", len(data) + 1)[starts])


def gram_hashes(codes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive codes of one row: hashes and index of the first code."""
    m = len(codes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += codes[at + j] * ORDER[j]
    return mix(h), at


def whole_hash(codes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Hash of ``count`` codes from each start, unlike any gram hash of other length."""
    h = np.full(len(starts), ORDER[63 - count], np.uint64)
    for j in range(count):
        h += codes[starts + j] * ORDER[j]
    return mix(h)
