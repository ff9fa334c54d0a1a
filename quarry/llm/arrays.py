"""Linear passes over arrays inside a row, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_CHUNK = 32


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def running(items: str, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """``emit(state, item)`` for each element of the column ``items``, the state before it being folded by ``step``.

    Appending to an array copies it, so elements are gathered in chunks of about the square root of their number.
    ``items`` must be the name of a computed column: as an expression it would be worked out again for each chunk.
    """
    n = F.size(items)
    width = F.greatest(F.lit(LEAST_CHUNK), F.ceil(F.sqrt(n)).cast("int"))

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["st"], x).alias("st"), F.concat(acc["out"], F.array(emit(acc["st"], x))).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        part = F.slice(items, c * width + 1, width)
        start = F.struct(acc["st"].alias("st"), empty(kind).alias("out"))
        return F.aggregate(part, start, one, lambda a: F.struct(a["st"].alias("st"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    start = F.struct(zero.alias("st"), empty(f"array<{kind}>").alias("out"))
    chunks = F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1)
    return F.when(n > 0, F.aggregate(chunks, start, chunk, lambda a: F.flatten(a["out"]))).otherwise(empty(kind))
