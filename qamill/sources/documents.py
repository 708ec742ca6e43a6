"""Document scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qamill.operators.corpus import document_id, route
from qamill.operators.markup import page_text


def scan_documents(
    spark: SparkSession, path: str, extensions: list[str] | None = None,
    include: str | None = None, exclude: str | None = None, limit: int | None = None,
) -> DataFrame:
    """One row per file under ``path`` with id, metadata and raw content.

    ``include`` and ``exclude`` are regexes on the path. The content column is only
    read when a later step uses it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    files = reader.load(path)
    if include:
        files = files.where(F.col("path").rlike(include))
    if exclude:
        files = files.where(~F.col("path").rlike(exclude))
    if limit is not None:
        files = files.limit(limit)
    return files.select(
        document_id(F.col("path"), F.col("modificationTime")).alias("doc_id"),
        F.col("path").alias("original_path"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("original_filename"),
        F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("original_extension"),
        F.col("length").alias("size_bytes"),
        F.current_timestamp().alias("ingest_timestamp"),
        F.col("content"),
    )


def decode_documents(files: DataFrame) -> DataFrame:
    """Text of every supported format that needs no outside codec.

    Plain text is decoded, pages go through the HTML rule, JSON and CSV stay text.
    Unsupported formats are dropped.
    """
    raw = F.decode("content", "UTF-8")
    kind = route(F.col("original_path"))
    ext = F.col("original_extension")
    text = (
        F.when(kind == "text", raw).when(kind == "html", page_text(raw))
        .when(ext.isin(".csv", ".json"), raw)
    )
    return (
        files.withColumn("format", kind).withColumn("text", text)
        .where(F.col("text").isNotNull()).drop("content")
    )


def structured_records(spark: SparkSession, path: str, schema: str, kind: str = "csv") -> DataFrame:
    """T5: records of CSV or JSON files and their text form, one JSON per record."""
    reader = spark.read.schema(schema)
    if kind == "csv":
        rows = reader.option("header", True).csv(path)
    else:
        rows = reader.option("multiLine", True).json(path)
    return with_text(rows).withColumn("source_file", F.input_file_name())


def with_text(records: DataFrame) -> DataFrame:
    """Add ``text``: the record as JSON."""
    return records.withColumn("text", F.to_json(F.struct(*records.columns)))


def scan_database(
    spark: SparkSession, url: str, query: str, limit: int | None = None,
    partition: tuple[str, int, int, int] | None = None, **options: str,
) -> DataFrame:
    """Rows of a database query.

    ``partition`` is (column, low, high, parts): the scan is cut into that many range
    queries instead of passing through one connection. JDBC takes no ``query`` with a
    partition column, so the query is then given as a derived table.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = (
            reader.option("dbtable", f"({query}) source_rows").option("partitionColumn", column)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
        )
    else:
        reader = reader.option("query", query)
    rows = reader.load()
    return rows.limit(limit) if limit is not None else rows
