"""Compiler index files (S15): protobuf messages of the public SCIP schema, read from bytes without a compiled schema.

Fields used: Index.documents = 2; Document.relative_path = 1, occurrences = 2, symbols = 3, language = 4;
Occurrence.range = 1 (packed), symbol = 2, symbol_roles = 3; SymbolInformation.symbol = 1, display_name = 6.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from quarry.session import arrow_map


class CorruptIndex(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptIndex("truncated number")
        b = data[at]
        out |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return out, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one message: numbers for varints, bytes for the rest."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise CorruptIndex(f"wire type {kind}")
        if at > len(data):
            raise CorruptIndex("truncated field")
        yield tag >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(n)
    return out


def occurrences(data: bytes) -> Iterator[tuple]:
    """(file, language, symbol, line, column, end_line, end_column, is_definition) of an index."""
    for number, doc in fields(data):
        if number != 2:
            continue
        parts = list(fields(doc))
        path = next((v.decode() for n, v in parts if n == 1), "")
        language = next((v.decode() for n, v in parts if n == 4), "")
        for n, occ in parts:
            if n != 2:
                continue
            span: list[int] = []
            symbol, roles = "", 0
            for k, v in fields(occ):
                if k == 1:
                    span += packed(v) if isinstance(v, bytes) else [v]
                elif k == 2:
                    symbol = v.decode()
                elif k == 3:
                    roles = v
            if len(span) not in (3, 4):
                raise CorruptIndex("range")
            end = span[2:] if len(span) == 4 else [span[0], span[2]]
            yield path, language, symbol, span[0], span[1], end[0], end[1], bool(roles & 1)


SCHEMA = "index string, file string, language string, symbol string, line int, col int, end_line int, end_col int, is_definition boolean"


def decoded(files: DataFrame) -> DataFrame:
    """Occurrences of index files given as (path, content); a corrupt one is an error."""
    kinds = {"string": "string", "int": "int32", "boolean": "bool"}

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([(c.split()[0], pa.type_for_alias(kinds[c.split()[1]])) for c in SCHEMA.split(", ")])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(name, *row) for row in occurrences(content)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return arrow_map(files.select("path", "content"), run, SCHEMA)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Occurrences of every index file below a path; a missing path or a corrupt file is an error."""
    return decoded(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.scip").load(path))
