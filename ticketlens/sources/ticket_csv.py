"""Ticket files: CSV with a header, quoted fields and line breaks inside fields."""

from __future__ import annotations

import csv
import io
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.schemas import CSV_COLUMNS, NULL_WORDS
from ticketlens.session import open_uri, shuffles_dropped

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A quoted field may span lines, so a file is read by one task; keep files small.
MAX_ROWS_PER_FILE = 200_000

DIALECT = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    # Stated, so that line ends inside quoted fields are kept as they are.
    "lineSep": "\n",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "encoding": "UTF-8",
}

#: What a row has beyond its header's columns, and the file it came from.
SURPLUS, SOURCE_FILE = "surplus_field", "source_file"


def _clean(place: int, fields: int) -> Column:
    # The last field that a line has loses the carriage return of files with CRLF ends.
    later = [F.col(f"c{i}") for i in range(place + 1, fields)]
    is_last = F.coalesce(*later, F.col(SURPLUS)).isNull()
    field = F.col(f"c{place}")
    text = F.when(is_last, F.regexp_replace(field, r"\r\z", "")).otherwise(field)
    return F.when(~text.isin(NULL_WORDS), text)


#: Bytes at the start of a file that hold its header.
HEAD_BYTES = 1 << 16


def _names(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("\ufeff").rstrip("\r")]), [])


def _first_line(path: str) -> str | None:
    """The first line of a file that is not blank; none in an empty file."""
    system, name = open_uri(path)
    with system.open_input_stream(name, compression="detect") as stream:
        head = stream.read(HEAD_BYTES)
        while head and not head.strip(b"\xef\xbb\xbf\r\n") and (more := stream.read(HEAD_BYTES)):
            head = more
        while b"\n" not in head.lstrip(b"\xef\xbb\xbf\r\n") and (more := stream.read(HEAD_BYTES)):
            head += more
    lines = head.decode("utf-8-sig", errors="replace").lstrip("\r\n").split("\n", 1)
    return lines[0] if lines[0] else None


def _has_field(name: str) -> Column:
    return F.col("value").rlike(f'(^|[,"\ufeff]){name}([,"\r]|$)')


def _heads_by_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Header lines through Spark's own reader, for file systems that Python can't open.

    It reads all lines; files without a line that names both ids have an empty header.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    at = F.when(_has_field("ticket_id") & _has_field("user_id"), F.col("_metadata.file_block_start"))
    places = lines.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), "value")
    first = places.groupBy("path").agg(F.coalesce(F.min_by("value", "at"), F.lit("")).alias("head"))
    return first.select(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).alias("path"), "head")


def file_headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The layouts of ticket files: column names in order, and the files that have them.

    A header is the first line of a file and names ticket_id and user_id; a file with rows but
    without one is an error, an empty file is left out. Tasks read the first bytes of each
    file; the driver, which lists the files for any read, holds each layout once with their names.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    kinds = pa.schema([("path", pa.string()), ("head", pa.string())])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array([_first_line(p) for p in paths], pa.string())], schema=kinds)

    first = files.head()
    try:
        _first_line(first["path"]) if first else None
        found = files.where("length > 0").mapInArrow(heads, "path string, head string").where("head IS NOT NULL")
    except (pa.ArrowException, OSError, ValueError):
        found = _heads_by_scan(spark, path)
    layouts: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for head, paths in found.groupBy("head").agg(F.collect_list("path")).collect():
        names = _names(head)
        if not {"ticket_id", "user_id"} <= set(names):
            raise ValueError(f"no header with ticket_id and user_id in {paths[0]}")
        layouts[tuple(names)] += paths
    return layouts


def read_ticket_rows(spark: SparkSession, path: str | list[str], multi_line: bool) -> DataFrame:
    """Every row of ticket files by column name, with ``surplus_field`` and ``source_file``.

    Files may order their columns in any way. Columns that a file lacks are null, columns
    beyond the known ones are left out, and so are missing trailing fields of a short row.
    A row with more fields than its header is malformed: ``surplus_field`` holds the first.
    """
    parts = []
    for names, files in sorted(file_headers(spark, path).items()):
        places = {name: i for i, name in reversed(list(enumerate(names)))}
        fields = [T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
        schema = T.StructType([*fields, T.StructField(SURPLUS, T.StringType())])
        reader = spark.read.options(**DIALECT).option("multiLine", multi_line).option("mode", "PERMISSIVE")
        rows = reader.schema(schema).csv(sorted(files))
        by_name = [
            (_clean(places[c], len(names)) if c in places else F.lit(None).cast("string")).alias(c)
            for c in CSV_COLUMNS
        ]
        surplus = F.when(~F.regexp_replace(SURPLUS, r"\r\z", "").isin(""), F.col(SURPLUS)).alias(SURPLUS)
        parts.append(rows.select(*by_name, surplus, F.col("_metadata.file_path").alias(SOURCE_FILE)))
    if not parts:
        names = [*CSV_COLUMNS, SURPLUS, SOURCE_FILE]
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    return reduce(DataFrame.unionByName, parts)


def well_formed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(SURPLUS).isNull()).select(*CSV_COLUMNS)


def malformed(rows: DataFrame) -> DataFrame:
    """The rows that ``well_formed`` leaves out, as they were read."""
    return rows.where(F.col(SURPLUS).isNotNull())


def read_ticket_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """The well-formed tickets of ticket files, every field as text: guessed types turn ids into dates.

    With ``multi_line`` a file is one task, since fields may span lines. Where none does,
    ``multi_line=False`` lets many tasks share a large file.
    """
    return well_formed(read_ticket_rows(spark, path, multi_line))


def parse_file(content: bytes) -> Iterator[dict]:
    """The rows of one whole file by column name, as ``read_ticket_rows`` gives them."""
    lines = csv.reader(io.StringIO(content.decode("utf-8-sig", errors="replace"), newline=""))
    names = next(lines, [])
    for row in lines:
        if row:
            found = {n: v for n, v in zip(names, row) if v not in NULL_WORDS}
            surplus = row[len(names)] if len(row) > len(names) else ""
            yield {**{c: found.get(c) for c in CSV_COLUMNS}, SURPLUS: surplus or None}


def parse_files(files: DataFrame) -> DataFrame:
    """Ticket rows of whole files (``path``, ``content``), for streams: each file has its own header."""
    names = [*CSV_COLUMNS, SURPLUS, SOURCE_FILE]
    kinds = pa.schema([(n, pa.string()) for n in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = [{**row, SOURCE_FILE: path} for row in parse_file(content)]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pylist(found[at : at + 10_000], schema=kinds)

    return files.select("path", "content").mapInArrow(rows, ", ".join(f"{n} string" for n in names))


def write_ticket_csv(
    df: DataFrame, path: str, max_rows_per_file: int = MAX_ROWS_PER_FILE, compression: str = "none"
) -> None:
    """Ticket files; with ``compression`` ``gzip`` a fraction of the size, which readers tell by their names.

    A compressed file is read by one task even where no field spans lines.
    """
    with shuffles_dropped(df.sparkSession):
        (
            df.write.mode("overwrite")
            .options(**DIALECT)
            .options(maxRecordsPerFile=max_rows_per_file, compression=compression)
            .csv(path)
        )
