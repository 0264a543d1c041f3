"""CSV folders whose files differ in header order, and CSV files whose records run over many lines, read in parallel.

Headers: the first line of every file is read by a distributed pass; files are grouped by header, each group is one scan with its
own column order, and the groups are joined by name. What the driver holds is one header row a file, as much as Spark's own listing.

Multi-line records: a line end inside quotes does not end a record, so a split of a file cannot tell where its first record
begins. A first pass counts the quotes of each split. The parity of all quotes before a split tells whether it begins inside a
record: a running sum over one row a split. A second pass cuts each split into records from there; only the pieces of records that
run across a split's edge are shuffled and put together. Quotes inside quoted fields are doubled, and fields that hold a quote or
line end are quoted, as RFC 4180 asks. Where a record ends with carriage return and line feed, such ends inside it become line feeds.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WHOLE, HEAD, TAIL = 0, 1, 2
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders and files are listed by a few tasks a core while this lasts; Spark's own choice is a task a folder, up to 10000."""
    was = spark.conf.get(LISTING)
    spark.conf.set(LISTING, str(min(int(was), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTING, was)


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """value, file, start: every line with its file and the place in it where the line's split begins."""
    with listed_in_few_tasks(spark):
        raw = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths)
    return raw.select("value", plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("start"))


def header_layouts(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(column names, files) of every header among the files below ``path``, in the order of the first file."""
    lines = text_lines(spark, path).where(F.col("start") == 0).withColumn("nth", F.monotonically_increasing_id())
    first = lines.groupBy("file").agg(F.min_by("value", "nth").alias("header")).orderBy("file").collect()
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in first:
        names = next(csv.reader([r["header"].lstrip("﻿").rstrip("\r")]), [])
        groups.setdefault(tuple(names), []).append(r["file"])
    return [(list(names), files) for names, files in groups.items()]


def plain_path(file: Column) -> Column:
    """A file's path as it is written, from the encoded form of ``_metadata.file_path``."""
    return F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B")))


def literal_path(file: str) -> str:
    """A path that names this file only, whatever signs are in its name."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", file)


def placed(names: list[str], files: list[str], wanted: dict[str, str], optional: tuple[str, ...]) -> list:
    """The columns ``c<i>`` of ``wanted`` (file name -> name here) by header, whatever order, case or outer blanks."""
    at: dict[str, int] = {}
    for i, n in enumerate(names):
        at.setdefault(n.strip().lower(), i)
    missing = [c for c in wanted if c.lower() not in at and c not in optional]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(names)} in {files[0]}")
    return [(F.col(f"c{at[c.lower()]}") if c.lower() in at else F.lit(None).cast("string")).alias(n) for c, n in wanted.items()]


def string_schema(names: list[str]) -> str:
    return ", ".join(f"c{i} string" for i in range(len(names)))


def read_by_header(spark: SparkSession, path: str, wanted: dict[str, str], optional: tuple[str, ...] = (), multi_line: bool = False) -> DataFrame:
    """The ``wanted`` columns, as text, of all CSV files below ``path``, and ``_file``: each found by its own file's header. A file
    without a required column is named in the error."""
    out = None
    for names, files in header_layouts(spark, path):
        columns = placed(names, files, wanted, optional)
        paths = [literal_path(f) for f in files]
        if multi_line:
            fields = F.from_csv("record", string_schema(names), {"escape": '"', "multiLine": "true"})
            rows = records(spark, paths).where(~F.col("first")).select("file", fields.alias("r")).select("file", "r.*")
        else:
            reader = spark.read.schema(string_schema(names)).option("header", True).option("enforceSchema", True).option("escape", '"')
            with listed_in_few_tasks(spark):
                scan = reader.csv(paths)
            rows = scan.select("*", plain_path(F.col("_metadata.file_path")).alias("file"))
        rows = rows.select(*columns, F.col("file").alias("_file"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no files below {path}")
    return out


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, first, record: the records of CSV files, ``first`` marking each file's first one; blank ones are left out."""
    lines = text_lines(spark, paths)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = splits.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    # One short row a split of the input. Both passes must cut files alike; were the cluster resized in between, this would tell.
    known = lines.join(F.broadcast(inside), ["file", "start"], "left")
    sure = F.coalesce("inside", F.raise_error(F.lit("the files' splits changed between two passes; set spark.sql.files.minPartitionNum")).cast("int"))
    pieces = known.select("file", "start", "value", sure.alias("inside")).mapInArrow(cut_records, "file string, start bigint, kind int, first boolean, record string")
    group = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    open_ends = pieces.where(F.col("kind") != WHOLE).withColumn("nth", F.sum((F.col("kind") == TAIL).cast("int")).over(group))
    joined = open_ends.groupBy("file", "nth").agg(
        F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"))
    joined = joined.select("file", "first", F.array_join(F.col("parts.record"), "\n").alias("record"))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "first", "record").unionByName(joined)
    record = F.col("record")
    plain = F.replace(F.substring(record, F.lit(1), F.length(record) - 1), F.lit("\r\n"), F.lit("\n"))
    return whole.withColumn("record", F.when(record.endswith("\r"), plain).otherwise(record)).where(F.trim("record") != "")


def cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, in order, to records; what is open at a split's edge is marked as head or tail."""
    at: tuple[str, int] | None = None
    held: list[str] = []
    inside = head = first = False
    out: list[tuple] = []

    def emit(complete: bool) -> None:
        if held:
            out.append((*at, HEAD if head else WHOLE if complete else TAIL, first, "\n".join(held)))
            held.clear()

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "kind", "first", "record"])

    for batch in batches:
        for value, file, start, odd in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "start", "inside"))):
            if (file, start) != at:
                emit(not inside)
                at, inside, head, first = (file, start), bool(odd), bool(odd), start == 0
            elif not inside:
                emit(True)
                head = first = False
            held.append(value)
            inside ^= value.count('"') % 2 == 1
        yield batch_of()
    emit(not inside)
    yield batch_of()
