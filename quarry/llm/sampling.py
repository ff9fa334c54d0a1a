"""Bounded samples for fitting models on the driver; names for rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def smallest_hashes(df: DataFrame, key: str, seed: str, most: int) -> list[Row]:
    """The ``most`` rows with the smallest hash of ``key`` (ties by all columns).

    A count sets a hash threshold that about twice as many rows pass, so what the tasks send to the driver is
    bounded by the sample's size and not by the number of partitions.
    """
    n = df.count()
    h = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40))
    some = df.withColumn("_h", h)
    if n > 2 * most:
        some = some.where(F.col("_h") < int((1 << 40) * (2 * most + 200) / n))
    return some.orderBy("_h", *df.columns).limit(most).drop("_h").collect()


def row_keys() -> list[Column]:
    """k1, k2: two numbers, together the same only for rows equal in id and text."""
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(F.lit("row"), "doc_id", text).alias("k2")]


def under_cover(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with every column but ``text`` under a name that no operator uses, and those names in order."""
    names = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True))), names


def uncovered(df: DataFrame, docs: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The columns of ``docs`` under their own names again, and ``more``."""
    return df.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)), *more)
