"""CSV read by record (RFC 4180) and in parallel, also inside one large file.

A quoted field may hold line breaks, so a line is not a record, and a task that
starts in the middle of a file cannot tell whether it starts inside quotes. It can
from the number of quotes before it: a line starts a record if the lines before it
in its file hold an even number of quotes. So the reader counts quotes per line,
adds up parities per block of the file (a row per block), and each block then
numbers its own records; only records that cross lines are put together again.
Files in which every line is a record, as most are, skip all that: they go
straight to Spark's CSV scan with its pruning.

Null and empty text stay apart: null is written as nothing, empty text as `""`,
and the reader takes a field without quotes and characters as null. Blanks around
a field belong to it. Rows that do not fit the schema keep what could be read, and
their record can be had in a column of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# stands for "no characters and no quotes" inside the parser; a text that is exactly this would read as null
_NOTHING = "\u0000\u0001null\u0001\u0000"
_RFC = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
WRITE_OPTIONS = {**_RFC, "header": "true", "nullValue": "", "emptyValue": '""'}
READ_OPTIONS = {**_RFC, "nullValue": _NOTHING, "emptyValue": "", "mode": "PERMISSIVE"}
_MALFORMED = "_malformed_record"

#: tried in this order where no schema is given
TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, block, at (order inside the block), line (without its newline)."""
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _quotes(line: str = "line") -> Column:
    return F.length(line) - F.length(F.translate(line, '"', ""))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, record (its number in the file, from 0) and text of every record,
    whatever block of the file its lines lie in."""
    lines = _lines(spark, paths).withColumn("odd", F.pmod(_quotes(), F.lit(2)))
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    parity = blocks.select("file", "block", F.pmod(F.coalesce(F.sum("quotes").over(before), F.lit(0)), F.lit(2)).alias("open"))
    inside = Window.partitionBy("file", "block").orderBy("at")
    so_far = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = lines.join(parity, ["file", "block"]).withColumn("starts", (F.pmod(F.col("open") + so_far, F.lit(2)) == 0).cast("int"))
    numbered = begun.withColumn("own", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    firsts = begun.groupBy("file", "block").agg(F.sum("starts").alias("started")).select(
        "file", "block", F.coalesce(F.sum("started").over(before), F.lit(0)).alias("earlier"))
    placed = numbered.join(firsts, ["file", "block"]).withColumn("record", F.col("earlier") + F.col("own") - 1)
    whole = placed.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    # lines that end in CR LF: the CR that closes the record is no data
    return whole.select("file", "record", F.regexp_replace(text, "\r$", "").alias("text"))


def _parts(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files in which every line is a record, and the others: those with a line
    that holds an odd number of quotes or a carriage return."""
    marked = _lines(spark, [path]).groupBy("file").agg(
        F.max((F.pmod(_quotes(), F.lit(2)) == 1) | F.contains("line", F.lit("\r"))).alias("assemble"))
    found = marked.collect()  # a row per file, as the driver's own file listing has
    return sorted(r.file for r in found if not r.assemble), sorted(r.file for r in found if r.assemble)


def _parsed(spark: SparkSession, plain: list[str], broken: list[str], schema: StructType) -> DataFrame:
    full = StructType([*schema.fields, StructField(_MALFORMED, StringType())])
    options = {**READ_OPTIONS, "columnNameOfCorruptRecord": _MALFORMED}
    out, single = None, len(schema.fields) == 1
    if single:  # a blank line is a record: a null
        plain, broken = [], plain + broken
    if plain or not broken:
        out = spark.read.schema(full).options(header="true", **options).csv(plain) if plain else spark.createDataFrame([], full)
    if broken:
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in full.fields)
        rows = records(spark, broken).where((F.col("record") > 0) & (F.lit(single) | (F.col("text") != "")))
        rows = rows.select(F.from_csv("text", ddl, {**options, "multiLine": "true"}).alias("row")).select("row.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def _header(spark: SparkSession, plain: list[str], broken: list[str]) -> list[str]:
    if plain:
        return spark.read.options(header="true", **READ_OPTIONS).csv(plain[:1]).columns
    first = records(spark, broken[:1]).where("record = 0").first()
    n = first.text.count(",") + 1
    ddl = ", ".join(f"c{i} string" for i in range(n))
    row = list(spark.range(1).select(F.from_csv(F.lit(first.text), ddl, {**READ_OPTIONS, "multiLine": "true"}).alias("row")).first().row)
    while len(row) > 1 and row[-1] is None:  # commas inside quotes were counted as well
        row.pop()
    return [name or f"_c{i}" for i, name in enumerate(row)]


def inferred(df: DataFrame) -> StructType:
    """The narrowest type of TYPES that every value of each text column has; one
    aggregate over all rows."""
    fits = df.agg(*[F.min(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast(t).isNotNull()).alias(f"{i}_{t}")
                    for i, c in enumerate(df.columns) for t in TYPES]).first()
    some = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(df.columns)]).first()
    kinds = [next((t for t in TYPES if some[str(i)] and fits[f"{i}_{t}"]), "string") for i in range(len(df.columns))]
    return StructType.fromDDL(", ".join(f"`{c.replace('`', '``')}` {t}" for c, t in zip(df.columns, kinds)))


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, malformed: str | None = None) -> DataFrame:
    """CSV files with a header, by record. Without `schema` the types are
    inferred from all rows. `malformed` names a column for the records that do
    not fit the schema (too few or many fields, a value of another type)."""
    plain, broken = _parts(spark, path)
    if not plain and not broken:
        raise ValueError(f"no CSV records, not even a header, in {path}")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if schema is None:
        text = StructType([StructField(c, StringType()) for c in _header(spark, plain, broken)])
        schema = inferred(_parsed(spark, plain, broken, text).drop(_MALFORMED))
    out = _parsed(spark, plain, broken, schema)
    names = [F.col(f"`{f.name}`") for f in schema.fields]
    return out.select(*names, F.col(_MALFORMED).alias(malformed)) if malformed else out.select(*names)
