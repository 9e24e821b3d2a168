"""Records of sample CSVs, each file with a header of its own, read by CSV rules and not by lines.

Spark lists and fetches the files, as it alone reaches every store; a task parses one file after another, since only a
file's beginning tells which of its quotes open. What is wrong with a file is a row of its own, so a broken sample costs
itself alone.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "file_name string, row_ordinal long, header array<string>, cells array<string>, problem string"
#: Rows that leave a task at once.
ROWS = 10_000
#: Characters of a field, at most.
MAX_FIELD = 1 << 27


def records(content: bytes) -> Iterator[tuple[list[str] | None, list[str] | None, str | None]]:
    """(header, cells, problem): the header alone, then every record with it; a problem ends the file.

    Quoted fields may hold commas, line ends and doubled quotes. Bytes are UTF-8, with or without a byte order mark, or
    else Windows-1252. Cells are trimmed; records of white space alone are skipped; a record may be shorter or longer than
    the header. Broken quotes are a problem, and so is a file without any record.
    """
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = content.decode("cp1252", errors="replace")
    csv.field_size_limit(MAX_FIELD)
    header = None
    try:
        for cells in csv.reader(io.StringIO(text, newline=""), strict=True, skipinitialspace=True):
            cells = [c.strip() for c in cells]
            if not any(cells):
                continue
            if header is None:
                header, cells = cells, None
            yield header, cells, None
    except csv.Error as error:
        yield header, None, f"not CSV: {error}"
        return
    if header is None:
        yield None, None, "empty file"


def _tables(name: str, content: bytes) -> Iterator[pd.DataFrame]:
    columns, held, place = [c.split()[0] for c in RECORD.split(", ")], [], 0
    for header, cells, problem in records(content):
        place += cells is not None
        held.append((name, place if cells is not None else None, header, cells, problem))
        if len(held) == ROWS:
            yield pd.DataFrame(held, columns=columns).astype({"row_ordinal": "Int64"})
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns).astype({"row_ordinal": "Int64"})


def read_records(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """RECORD rows of the files of ``folder`` that ``names`` (file_name) lists. Records are numbered from 1 in their file; a
    row without number has the header, or what is wrong."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    files = files.withColumn("file_name", F.regexp_extract("path", r"([^/]*)$", 1)).join(names.select("file_name"), "file_name", "left_semi")

    def parse(batches):
        for pdf in batches:
            for name, content in zip(pdf["file_name"], pdf["content"]):
                yield from _tables(name, bytes(content))

    return files.select("file_name", "content").mapInPandas(parse, RECORD)
