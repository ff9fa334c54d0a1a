"""Language ID by compression.

For every language a raw-content zstandard dictionary is made from a bounded sample of labelled text. A
text is normalised (lower case, letters and single spaces only), cut into blocks, and every block is
compressed with each dictionary; the language whose total is smallest wins. Whole texts are encoded, and
cutting into blocks keeps a long text from becoming its own dictionary, so its evidence adds up evenly.
When the best and the second total are closer than ``MARGIN``, the answer is rejected.

The sample is ``DOCS_PER_LANG`` documents a language with the smallest hash of (doc_id, seed), chosen by
a ranked window that Spark limits on the map side. The ``DICT_BYTES`` of a dictionary are shared among all of
them: what short texts leave goes to the longer ones, and a text longer than its share gives ``PIECES`` slices
spread over its whole length.

Edge cases: a null text or one without a letter is ``und`` with score 0 (and rejected); with no labelled
text at all every document is ``und``; one learned language always wins, with score 1; equal totals go to
the language first by code point; null ids count as held out and are predicted like any other; repeated
rows are predicted each; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.sampling import under_cover, uncovered
from quarry.session import arrow_map

DOCS_PER_LANG = 128
DICT_BYTES = 128 << 10
PIECES = 8
BLOCK_BYTES = 512
LEVEL = 3
#: Rejected when the second best total is less than this share larger than the best.
MARGIN = 0.002
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_TO_SPACE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(True))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split())


def spread(data: bytes, room: int) -> bytes:
    """All of ``data``, or ``room`` bytes of it in slices from its start to its end."""
    if len(data) <= room:
        return data
    n = max(1, min(PIECES, room // 16))
    width = (room - n + 1) // n
    return b" ".join(data[at : at + width] for at in ((len(data) - width) * k // max(1, n - 1) for k in range(n)))


def shares(sizes: list[int], total: int) -> list[int]:
    """What each text may give: ``total`` in equal parts, with what short ones leave dealt to the longer ones."""
    out = [0] * len(sizes)
    for left, k in zip(range(len(sizes), 0, -1), sorted(range(len(sizes)), key=lambda k: (sizes[k], k)), strict=True):
        out[k] = min(sizes[k], total // left)
        total -= out[k]
    return out


def learn(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionary content by language, learned from rows that aren't held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("lang-id")), "doc_id")
    ids = [r[0] for r in labelled.select("doc_id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= docs_per_lang).select("doc_id").distinct().collect()]
    if not ids:
        return {}
    # a long text comes to the driver as slices spread over its length, each of twice a fair share of the dictionary
    width = 2 * dict_bytes // docs_per_lang + 256
    n = F.length("text")
    slices = [F.substring("text", F.floor((n - width) * k / (PIECES - 1)).cast("int") + 1, F.lit(width)) for k in range(PIECES)]
    text = F.when(n <= PIECES * width, F.col("text")).otherwise(F.concat_ws(" ", *slices))
    rows = labelled.where(F.col("doc_id").isin(ids)).select("lang", F.xxhash64("doc_id", F.lit("lang-id")), "doc_id", text).collect()
    found: dict[str, list[bytes]] = {}
    for lang, _, _, some in sorted(rows):
        found.setdefault(lang, []).append(normalised(some))
    out: dict[str, bytes] = {}
    for lang, parts in sorted(found.items()):
        room = shares([len(p) + 1 for p in parts], dict_bytes)
        out[lang] = b" ".join(spread(p, r - 1) for p, r in zip(parts, room, strict=True) if r > 1)
    return {k: v for k, v in out.items() if v.strip()}


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL, block: int = BLOCK_BYTES):
        self.block = block
        self.langs = sorted(content)
        self.coders = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score in [0, 1], and the margin of the best over the second."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        data = normalised(text)
        if not data:
            data = text.encode("utf-8", "replace")
        parts = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        totals = [sum(len(c.compress(p)) for p in parts) for c in self.coders]
        ranked = sorted(range(len(totals)), key=lambda i: (totals[i], i))
        if len(ranked) == 1:
            return self.langs[0], 1.0, 1.0
        best, second = totals[ranked[0]], totals[ranked[1]]
        margin = (second - best) / second
        return self.langs[ranked[0]], min(1.0, 0.5 + 2.5 * margin), margin


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Adds lang_pred, score and rejected to every column of ``docs``; input columns of those names are replaced."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(content)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([f[0] == UNKNOWN or f[2] < margin for f in found], pa.bool_()),
                ],
                [*keep, "lang_pred", "score", "rejected"],
            )

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return arrow_map(docs.select(*keep), run, schema)


def keep_determined(docs: DataFrame) -> DataFrame:
    """The documents whose language is determined, with the columns of ``docs`` as they are."""
    safe, names = under_cover(docs)
    found = identify(safe, learn(docs.select("doc_id", "text", "lang")))
    return uncovered(found.where(~F.col("rejected")), docs, names)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
