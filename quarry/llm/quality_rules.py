"""Quality rules by a rule bitmask ledger.

Each document is read once. The measurements and one bit per failed rule go into a ledger; a policy is
a versioned mask over those bits, so changing policy, or asking what each rule costs (ablation), is
integer arithmetic on the ledger and never a second pass over the texts.

Edge cases: a null or empty text, or one of white space only, has zero words and fails ``too_few_words``;
null ids and repeated rows each keep their own ledger row; an empty table gives an empty ledger; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm import textbytes as tb
from quarry.session import arrow_map

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Bit, name and condition of failure over the measurements; bits are never reused for another rule.
RULES = (
    (0, "too_few_words", "n_words < 50"),
    (1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbol_heavy", "5 * n_symbols > n_words"),
    (3, "repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    (4, "short_words", "word_chars < 2 * n_words"),
    (5, "long_words", "word_chars > 20 * n_words"),
)
BASE_MASK = 0b000011
#: Policies by version: which rules reject.
POLICIES = {"base": BASE_MASK, "v1": 0b000111, "v2": 0b111111}
PRODUCTION_POLICY = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _row_sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=run[1:])
    return run[offs[1:]] - run[offs[:-1]]


def _in_row_key(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return tb.mix(h ^ tb.mix(rows.astype(np.uint64) + np.uint64(1)))


def measure_slice(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    inside = ~_SPACE[data]
    s, e, rows = tb.runs(inside, offs)
    n_words = np.bincount(rows, minlength=n)
    word_chars = _row_sums(inside & ((data & 0xC0) != 0x80), offs)
    n_symbols = _row_sums(_SYMBOL[data], offs)

    ls, le, lrows = tb.runs(data != 10, offs)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    real = filled[le] > filled[ls]
    ls, le, lrows = ls[real], le[real], lrows[real]
    n_lines = np.bincount(lrows, minlength=n)
    keys = _in_row_key(tb.span_hashes(data, ls, le), lrows)
    _, first = np.unique(keys, return_index=True)
    n_dup = n_lines - np.bincount(lrows[first], minlength=n)

    grams, at = tb.gram_hashes(tb.span_hashes(data, s, e), rows, 3)
    n_repeat = np.zeros(n, np.int64)
    if len(at):
        keys = _in_row_key(grams, rows[at])
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(rows), bool)
        for j in range(3):
            hit[at[twice] + j] = True
        n_repeat = np.bincount(rows[hit], minlength=n)
    return [n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat]


def measurements(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One pass over the texts: ``key`` and the measurements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in tb.slices(batches, text):
            cols = [pa.array(c.astype(np.int64)) for c in measure_slice(data, offs)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *cols], [key, *MEASURES])

    schema = StructType([docs.schema[key], *(StructField(m, LongType()) for m in MEASURES)])
    return arrow_map(docs.select(key, text), run, schema)


def ledger(measured: DataFrame) -> DataFrame:
    """Evaluate every rule once: adds ``fail_bits``."""
    bits = sum((F.when(F.expr(cond), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, _, cond in RULES), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def apply_policy(led: DataFrame, version: str, name: str = "kept") -> DataFrame:
    return led.withColumn(name, F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(led: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents it fails, and documents only it keeps out.

    The ledger is first summed by ``fail_bits`` (at most 2**rules groups), so the rest is a tiny table.
    """
    mask = POLICIES[version]
    groups = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(n).alias("rule")) for b, n, _ in RULES if mask >> b & 1))
    each = groups.select("n", "fail_bits", F.inline(rules))
    bit = F.expr("shiftleft(1L, bit)")
    masked = F.col("fail_bits").bitwiseAND(F.lit(mask))
    return each.groupBy("bit", "rule").agg(
        F.sum(F.when(masked.bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(masked == bit, F.col("n")).otherwise(0)).alias("failed_by_this_alone"),
    )


def quality_rules(docs: DataFrame, policy: str = PRODUCTION_POLICY) -> DataFrame:
    """Ledger of ``docs`` with the base verdict and the verdict of ``policy``."""
    led = ledger(measurements(docs))
    led = led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0)
    return apply_policy(led, policy).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
