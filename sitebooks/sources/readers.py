"""Readers for the landed files and database tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean_name

UPLOAD_SCHEMA = "level string, service string, material_surface string, total_sf double"


def read_takeoff_csv(spark: SparkSession, path: str, schema: str = UPLOAD_SCHEMA) -> DataFrame:
    """Uploaded take-off form: comma separated with a header row."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_sheet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A landed sheet: parquet, or comma separated text when a schema is given."""
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).option("header", True).csv(path)


def read_named_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """One sheet of a workbook landed as ``path/sheet=<name>``; only its folder is read."""
    return spark.read.parquet(path).where(F.col("sheet") == sheet).drop("sheet")


SOURCE_LINE = "source_line"


def _source_line() -> Column:
    """Place of a row in its source: file, block of the file, row in the order of reading the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def with_source_line(rows: DataFrame) -> DataFrame:
    """Rows just read from files, with ``source_line``: sorting by it gives the order of the source.

    Files come in the order of their names, rows of a file in the order they stand in it, however the
    file was split.  Operators that look at the row before follow it.
    """
    return rows.select("*", _source_line().alias(SOURCE_LINE))


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Records of separated text, (record, source_line): line breaks inside quotes do not end one.

    The files are read in splits.  A line opens a record if the quotes before it, in its block and in the
    blocks of the file before, are even in number; blocks are summed up first, so only one small row per
    block is looked at file by file.  Lines of one record are put together by its number.  A file whose
    quotes do not pair up is an error, since it would be one record from some line on.
    """
    text = with_source_line(spark.read.option("lineSep", "\n").text(path))
    lines = text.select("value", "source_line.*").withColumn(
        "quotes", F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    )
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    whole = Window.partitionBy("file")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.sum("quotes").over(whole) % 2 != 0
    checked = F.when(odd, F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file"))).cast("bigint"))
    blocks = blocks.select(
        F.col("file").alias("__file"),
        F.col("block").alias("__block"),
        F.coalesce(checked, F.sum("quotes").over(before), F.lit(0)).alias("__before"),
    )
    same = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    within = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("quotes").over(within), F.lit(0)) + F.col("__before")
    marked = lines.join(blocks, same).withColumn("opens", (earlier % 2 == 0).cast("int"))

    opened = marked.groupBy("file", "block").agg(F.sum("opens").alias("opens"))
    opened = opened.select(
        F.col("file").alias("__file"),
        F.col("block").alias("__block"),
        F.coalesce(F.sum("opens").over(before), F.lit(0)).alias("__opened"),
    )
    until = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = marked.select("file", "block", "row", "value", "opens").join(opened, same)
    numbered = numbered.withColumn("number", F.col("__opened") + F.sum("opens").over(until))
    # lines of one record: as many as the breaks inside its quotes
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    together = numbered.groupBy("file", "number").agg(parts.alias("parts"))
    record = F.array_join(F.transform("parts", lambda p: p["value"]), "\n")
    first = F.element_at("parts", 1)
    place = F.struct("file", first["block"].alias("block"), first["row"].alias("row"))
    return together.select(F.regexp_replace(record, "\r$", "").alias("record"), place.alias(SOURCE_LINE))


def read_report_export(
    spark: SparkSession, path: str, header: Sequence[str], leading_columns: int = 1, source_line: bool = False
) -> DataFrame:
    """A report export: title lines and leading columns before the real header.

    Every file repeats title lines and header, and lines carry no reliable
    position once a file is split, so they are told apart by content: the header
    line has the header texts, title lines have nothing beyond the first column.
    Texts may hold quotes (doubled) and line breaks inside quotes.
    All columns stay text; names are normalised.  ``source_line`` keeps the place of each row in its file.
    """
    width = leading_columns + len(header)
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in names)
    read = read_records(spark, path).where("record <> ''")
    raw = read.select(F.from_csv("record", schema, {"quote": '"', "escape": '"'}).alias("c"), SOURCE_LINE)
    raw = raw.select("c.*", SOURCE_LINE)
    kept = names[leading_columns:]
    is_header = F.lit(True)
    blank = F.lit(True)
    for column, text in zip(kept, header):
        is_header = is_header & F.col(column).eqNullSafe(F.lit(text))
        blank = blank & F.col(column).isNull()
    named = [F.col(c).alias(clean_name(text)) for c, text in zip(kept, header)]
    return raw.where(~is_header & ~blank).select(*named, *([SOURCE_LINE] if source_line else []))


def read_folder(spark: SparkSession, path: str, suffix: str = "*.parquet") -> DataFrame:
    """All files below a folder as one table with the file each row came from."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", suffix).parquet(path)
    return rows.withColumn("file", F.input_file_name())


def read_database(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A database table, read lazily; filters and columns are pushed to the database.

    Give ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    in ``options`` to read a large table in parallel.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()


def first_rows(df: DataFrame, n: int = 6) -> DataFrame:
    """The first rows for a look at a table."""
    return df.limit(n)


def sql_over(tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """Run an SQL text over named tables."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
