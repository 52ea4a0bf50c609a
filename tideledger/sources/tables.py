"""Scans and sinks: chunked quote files, runs, provider series, Parquet and CSV tables, run metadata."""

from __future__ import annotations

import csv
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quotes import NUMERIC, keep_last, trimmed_headers
from ..functions.columns import number

#: A raw quote as text: bad values become null in preparation, not at the scan.
QUOTE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("ts_iso", "slug", "market_url", "window_text", *NUMERIC)])


def loaded(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix: .csv with a header, else Parquet."""
    return trimmed_headers(spark.read.csv(path, header=True)) if path.endswith(".csv") else spark.read.parquet(path)


#: What a scan adds to a file's columns: its name, and the row's place in it (block, row: rising along the file).
ADDED = ("source_file", "source_order")


def header_names(line: str) -> list[str]:
    """Column names of a CSV file's first line, trimmed; one without a name, or with the name of one before (whatever the case), is named by its place."""
    names: list[str] = []
    for i, cell in enumerate(next(csv.reader([line.lstrip("\ufeff")]), [])):
        name = cell.strip()
        names.append(f"_c{i}" if not name or name.lower() in {n.lower() for n in names} else name)
    return names


def header_groups(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """The files under ``path`` by their first line: column names, and the files that have them.

    The first line of a file is the first of its first block. Files without a
    line have no columns and are left out. The driver holds the files' names,
    as it does for any scan, and a line of each kind of header.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
    first = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    first = first.where((F.col("block") == 0) & (F.trim("value") != "")).groupBy("file").agg(F.min_by("value", "at").alias("line"))
    groups = first.groupBy("line").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy(F.col("files")[0]).collect()
    return [(header_names(r["line"]), [_literal(f) for f in r["files"]]) for r in groups]


def _literal(file: str) -> str:
    """A file's path as it is named, with the signs that would be a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _scanned(spark: SparkSession, path: str) -> DataFrame:
    """The chunks' columns as text, ADDED, and the file's path as ``_file``."""
    parts = []
    for names, files in header_groups(spark, path):
        text = T.StructType([T.StructField(n, T.StringType()) for n in names])
        scan = spark.read.csv(files, header=True, schema=text, enforceSchema=True)
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        parts.append(scan.select(*(F.col(f"`{n}`") for n in names), F.col("_metadata.file_path").alias("_file"), place.alias("source_order")))
    if not parts:
        parts = [spark.createDataFrame([], "_file string, source_order struct<block:bigint,row:bigint>")]
    path = F.url_decode(F.replace("_file", F.lit("+"), F.lit("%2B")))
    return united(*parts).withColumn("_file", path).withColumn("source_file", F.element_at(F.split("_file", "/"), -1))


def quote_files(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All CSV chunks under ``path`` as text by column name, with ADDED: one scan for each kind of header, whatever the order and number of its columns.

    A column that a file doesn't have is null in its rows. With a schema only
    its columns are read, cast, bad values null.
    """
    raw = _scanned(spark, path).drop("_file")
    if schema:
        by_name = {c.lower(): c for c in raw.columns}
        raw = raw.select(*((F.col(f"`{by_name[f.name.lower()]}`").try_cast(f.dataType) if f.name.lower() in by_name else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema), *ADDED)
    return raw


def run_files(spark: SparkSession, root: str) -> DataFrame:
    """Every run's chunks; a run is a folder below ``root``."""
    raw = _scanned(spark, root)
    return raw.withColumn("run_name", F.regexp_replace(F.element_at(F.split("_file", "/"), -2), "^run_name=", "")).drop("_file")


def united(*parts: DataFrame, layer: list[str] | None = None) -> DataFrame:
    """Rows of all parts by column name, missing columns null; with ``layer`` each row is tagged."""
    tagged = [p.withColumn("source_layer", F.lit(n)) for p, n in zip(parts, layer, strict=True)] if layer else list(parts)
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def merged_run(raw: DataFrame) -> DataFrame:
    """Runs cleaned: blank rows dropped, numbers coerced, rows without a time dropped, of each market and time the last row of the last file kept, times written with an offset of +00:00."""
    present = [c for c in NUMERIC if c in raw.columns]
    blank = raw.dropna("all", subset=[c for c in raw.columns if c not in (*ADDED, "run_name")])
    typed = blank.withColumns({c: number(c) for c in present})
    timed = typed.withColumn("ts_utc", F.try_to_timestamp("ts_iso")).where("ts_utc is not null")
    run = [c for c in ("run_name",) if c in raw.columns]
    last = keep_last(timed, [*run, "slug", "ts_utc"], [c for c in ADDED if c in timed.columns] or ["ts_iso"]).drop("source_order")
    utc = F.to_utc_timestamp("ts_utc", F.current_timezone())
    return last.withColumn("ts_iso", F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))


def provider_series(spark: SparkSession, path: str) -> DataFrame:
    """An external series with its time in ts_utc, whichever of ts_utc and timestamp the file has."""
    raw = loaded(spark, path)
    names = [c for c in ("ts_utc", "timestamp") if c in raw.columns]
    values = {c: number(c) for c in raw.columns if c not in names}
    time = F.coalesce(*(F.try_to_timestamp(F.col(c).cast("string")) for c in names))
    return raw.withColumns(values | {"ts_utc": time}).drop("timestamp").where("ts_utc is not null")


def written(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*by) if by else writer).save(path)


def metadata_written(counts: DataFrame, path: str) -> None:
    """A one-row table of counts as JSON."""
    counts.write.mode("overwrite").json(path)
