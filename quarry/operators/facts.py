"""SQL lineage, code facts and the extractors behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.functions import codefacts
from quarry.functions import elements as found
from quarry.functions import sqltext
from quarry.functions.text import confidence_rank, version_at_most
from quarry.session import arrow_map

# --- SQL text -------------------------------------------------------------------------------------------------


def sql_flags(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``is_sql``: whether the text is a SQL statement. Equal texts of a batch are read once."""
    at = texts.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            codes = batch.column(at).dictionary_encode()
            known = pa.array([sqltext.is_sql(t) for t in codes.dictionary.to_pylist()] + [False], pa.bool_())
            flags = known.take(codes.indices.fill_null(len(known) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, flags], [*batch.schema.names, "is_sql"])

    return arrow_map(texts, run, StructType([*texts.schema.fields, StructField("is_sql", BooleanType())]))


def access_from_sql(literals: DataFrame, columns: DataFrame) -> DataFrame:
    """(consumer, table_name, column_name, role, bound) of the statements among (consumer, text).

    ``*`` becomes the known columns (table_name, column_name) of its table. A statement that binds nothing, has no consumer
    or reads all columns of an unknown table is a gap: one row that is not bound.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = {t: sqltext.triples(t) for t in set(batch.column(1).to_pylist())}
            rows = []
            for consumer, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found[text] is not None:
                    rows += [(consumer, *t) for t in found[text]] if consumer is not None and found[text] else [(consumer, None, None, None)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["consumer", "table_name", "column_name", "role"])

    t = arrow_map(literals.select(F.col("consumer").cast("string").alias("consumer"), "text"), run, "consumer string, table_name string, column_name string, role string")
    known = columns.select("table_name", F.col("column_name").alias("_c")).distinct()
    star = t.where("column_name = '*'").join(known, "table_name", "left").select("consumer", "table_name", F.col("_c").alias("column_name"), F.when(F.col("_c").isNotNull(), F.col("role")).alias("role"))
    named = t.where("column_name <> '*' or column_name is null").select("consumer", "table_name", "column_name", "role")
    return star.unionByName(named).withColumn("bound", F.col("column_name").isNotNull()).distinct()


# --- lineage views --------------------------------------------------------------------------------------------


def access_for(access: DataFrame, schema_id: str, floor: str) -> DataFrame:
    """L04."""
    ok = confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(floor))
    return access.where((F.col("schema_id") == schema_id) & ok).select("consumer", F.when(F.col("role") == "writes", "writes").otherwise("reads").alias("side"), "confidence")


def touched_by(access: DataFrame, consumer: str) -> DataFrame:
    """L05."""
    a = access.where(F.col("consumer") == consumer)
    return a.where("role in ('reads', 'writes')").select("schema_id", "role").union(a.where("role = 'maps_to'").select("schema_id", "role")).distinct()


def accesses_to_table(access: DataFrame, schema: DataFrame, table: str) -> DataFrame:
    """L06/J10."""
    return access.join(schema.where(F.col("table_name") == table).select(F.col("id").alias("schema_id"), "column_name"), "schema_id").select("consumer", "column_name", "role", "line")


def schema_of_table(schema: DataFrame, table: str) -> DataFrame:
    """Nullable stays three-valued."""
    return schema.where((F.col("table_name") == table) & (F.col("node_type") == "column")).select("column_name", "column_type", "is_nullable", "is_primary_key")


def dead_columns(schema: DataFrame, access: DataFrame, floor: str) -> DataFrame:
    """Declared over the floor, no access of any confidence."""
    s = schema.where((F.col("node_type") == "column") & (confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(floor))))
    return s.join(access.select(F.col("schema_id").alias("id")), "id", "left_anti").select("id", "table_name", "column_name")


def model_gaps(access: DataFrame, schema: DataFrame) -> DataFrame:
    """Accesses to columns that no schema has."""
    return access.join(schema.select(F.col("id").alias("schema_id")), "schema_id", "left_anti").groupBy("schema_id").agg(F.count(F.lit(1)).alias("sites"))


# --- extractors -----------------------------------------------------------------------------------------------


def _found(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Line-wise matches of a pattern with groups: (file, line, names...)."""
    lines = df.select("file", F.posexplode(F.split("text", "\n")).alias("line", "l")).where(F.col("l").rlike(pattern))
    return lines.select("file", (F.col("line") + 1).alias("line"), *(F.regexp_extract("l", pattern, i + 1).alias(n) for i, n in enumerate(names)))


def _each_file(files: DataFrame, read, columns: str) -> DataFrame:
    """Rows of ``read(file, text)`` behind the file's name, for (file, text)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(f, *r) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if f is not None for r in read(f, t)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    kinds = {"string": "string", "int": "int32", "boolean": "bool"}
    import pyarrow as pa

    names = ["file", *(c.split()[0] for c in columns.split(", "))]
    schema = pa.schema([("file", pa.string()), *((c.split()[0], pa.type_for_alias(kinds[c.split()[1]])) for c in columns.split(", "))])
    return arrow_map(files.select("file", "text"), run, f"file string, {columns}")


def orm_columns(code: DataFrame) -> DataFrame:
    """Columns of SQLAlchemy and Django models and Slick tables."""
    return _each_file(code, codefacts.mapped_columns, "line int, table_name string, column_name string, column_type string")


def migration_columns(code: DataFrame) -> DataFrame:
    """Columns that Django and Alembic migrations create; what a migration does not say is null."""
    return _each_file(code, codefacts.migrated_columns, "line int, table_name string, column_name string, column_type string, is_nullable boolean, is_primary_key boolean")


def http_routes(code: DataFrame) -> DataFrame:
    """Routes of Flask, FastAPI, Express, Go and Akka files, with {names} for what a path matches."""
    return _each_file(code, codefacts.routes, "line int, method string, path string")


def http_clients(code: DataFrame) -> DataFrame:
    """HTTP requests of Python and JavaScript files with a literal URL, {} for its holes."""
    return _each_file(code, codefacts.clients, "line int, sink string, method string, url string")


def processes(code: DataFrame) -> DataFrame:
    """Processes that a file starts by a literal name."""
    return _each_file(code, codefacts.processes, "line int, target string")


def string_literals(code: DataFrame, least: int = 3) -> DataFrame:
    """String literals with line and column; interpolated ones (f-strings, templates) with {} for their holes."""
    return _each_file(code, lambda f, t: codefacts.literals(f, t, least), "line int, col int, value string")


def literal_lookup(literals: DataFrame, value: str) -> DataFrame:
    """L15."""
    return literals.where(F.col("value") == value)


def config_usage(reads: DataFrame, literals: DataFrame, key: str) -> DataFrame:
    """Explicit reads first, else equal literals; one row a site."""
    a = reads.where(F.col("key") == key).select("file", "line", F.lit(0).alias("p"), F.lit("read").alias("how"))
    b = literals.where(F.col("value") == key).select("file", "line", F.lit(1).alias("p"), F.lit("literal").alias("how"))
    return a.unionByName(b).groupBy("file", "line").agg(F.min_by("how", "p").alias("how"))


def version_facts(docs: DataFrame) -> DataFrame:
    """``since`` / ``deprecated in`` / ``removed in`` marks with their version, one row a (fact, version)."""
    rx = r"(?i)\b(since|deprecated in|removed in)[: ]+v?([0-9]+(?:\.[0-9]+)*)"
    m = docs.select("id", F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("m"))
    return m.select("id", F.lower(F.regexp_extract("m", rx, 1)).alias("fact"), F.regexp_extract("m", rx, 2).alias("version")).distinct()


def availability(facts: DataFrame, runtime: Column) -> DataFrame:
    """By the last ``since`` fact in id order; unknown where the version has no number."""
    last = facts.where("fact = 'since'").groupBy("name").agg(F.max_by("version", "id").alias("version"))
    return last.select("name", "version", version_at_most(F.col("version"), runtime).alias("available"))


def dependencies(files: DataFrame, sources: DataFrame, evidence: int = 3) -> DataFrame:
    """Imports whose first part names another source, with the first files as evidence."""
    imp = files.select("source_name", "file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:from|import)\s+([A-Za-z0-9_]+)"), F.lit(1)))).alias("depends_on"))
    j = imp.join(sources.select(F.col("source_name").alias("depends_on")), "depends_on", "left_semi").where("depends_on <> source_name")
    r = j.withColumn("r", F.row_number().over(Window.partitionBy("source_name", "depends_on").orderBy("file")))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= evidence, F.col("file")))), ",")
    return r.groupBy("source_name", "depends_on").agg(F.count(F.lit(1)).alias("files"), first.alias("evidence"))


def guardrail(symbols: DataFrame, rule: dict) -> bool:
    """symbol_exists / name_contains / all_of / any_of; the leaves are existence tests in Spark."""
    if "all_of" in rule:
        return all(guardrail(symbols, r) for r in rule["all_of"])
    if "any_of" in rule:
        return any(guardrail(symbols, r) for r in rule["any_of"])
    if "symbol_exists" in rule:
        return symbols.where(F.col("qname") == rule["symbol_exists"]).limit(1).count() > 0
    return symbols.where(F.contains("qname", F.lit(rule["name_contains"]))).limit(1).count() > 0


def element_body(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """The lines of an element."""
    return elements.join(texts, "file").select("id", F.array_join(F.slice(F.split("text", "\n"), F.col("line_start"), F.col("line_end") - F.col("line_start") + 1), "\n").alias("body"))


ELEMENT = "file string, language string, subtype string, qualified_name string, signature string, line_start int, line_end int, parent string, body_sha string"


def elements(files: DataFrame) -> DataFrame:
    """The structural elements of (file, text) in the language of the file's name; unknown languages have none."""

    def run(batches):
        import pyarrow as pa

        names = ["file", *found.Element._fields]
        kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()] * 2
        for batch in batches:
            rows = [(f, *e) for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if f is not None for e in found.elements_of(f, t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return arrow_map(files.select("file", "text"), run, ELEMENT)


def ini_entries(files: DataFrame) -> DataFrame:
    """Section, key and value of INI and dotenv lines."""
    lines = files.select("file", F.posexplode(F.split("text", "\n")).alias("line", "l"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sec = F.regexp_extract("l", r"^\s*\[([^\]]+)\]", 1)
    j = lines.withColumn("section", F.last(F.when(sec != "", sec), ignorenulls=True).over(w))
    rx = r"^\s*(?:export\s+)?([A-Za-z_][\w.]*)\s*[=:]\s*(.*?)\s*$"
    return j.where(F.col("l").rlike(rx) & ~F.col("l").rlike(r"^\s*[#;]")).select("file", (F.col("line") + 1).alias("line"), "section", F.regexp_extract("l", rx, 1).alias("key"), F.regexp_replace(F.regexp_extract("l", rx, 2), "^[\"']|[\"']$", "").alias("value"))


def dockerfile_entries(files: DataFrame) -> DataFrame:
    """Instructions with their arguments."""
    return _found(files, r"^\s*(FROM|RUN|ENV|ARG|EXPOSE|COPY|CMD|ENTRYPOINT|WORKDIR)\s+(.*?)\s*$", ["key", "value"])


def openapi_endpoints(specs: DataFrame) -> DataFrame:
    """(path, method, operation, summary) of Swagger and OpenAPI files in JSON and YAML."""
    return _each_file(specs, codefacts.endpoints, "path string, method string, operation string, summary string")


def create_tables(files: DataFrame) -> DataFrame:
    """Columns of CREATE TABLE statements."""
    rx = r"(?is)create table (?:if not exists )?([\w.]+)\s*\((.*?)\)\s*;"
    t = files.select("file", F.explode(F.regexp_extract_all("text", F.lit(rx), F.lit(0))).alias("ddl"))
    c = t.select("file", F.lower(F.regexp_extract("ddl", rx, 1)).alias("table_name"), F.posexplode(F.split(F.regexp_extract("ddl", rx, 2), r",(?![^(]*\))")).alias("pos", "c"))
    c = c.withColumn("c", F.trim(F.regexp_replace("c", r"\s+", " "))).where(~F.lower("c").rlike("^(primary key|foreign key|unique|constraint|check)"))
    return c.select("file", "table_name", "pos", F.lower(F.regexp_extract("c", r"^(\w+)", 1)).alias("column_name"), F.upper(F.regexp_extract("c", r"^\w+ (\w+)", 1)).alias("column_type"), F.lower("c").contains("primary key").alias("is_primary_key"), (~F.lower("c").contains("not null")).alias("is_nullable"))
