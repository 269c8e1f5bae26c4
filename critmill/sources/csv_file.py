"""One CSV file from many partitions, by a data source whose commit joins what the tasks wrote."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .tables import csv_header, csv_rows

#: Bytes in memory while parts are joined.
CHUNK = 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it: a URI's, or this machine's (as all mount it) for a plain path."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote: its partition's number and the file."""

    number: int
    path: str


class CsvFileWriter(DataSourceArrowWriter):
    """Each task writes its lines under a name of its own, so that repeated and speculative tasks can't mix; the commit copies
    the parts of the tasks that count, in order of partitions, behind the header, and then renames the whole."""

    def __init__(self, path: str, header: str) -> None:
        self.path, self.header = path.rstrip("/"), header
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator):
        number = TaskContext.get().partitionId()
        path = f"{self.parts}/{number:08d}-{uuid.uuid4().hex}"
        fs, at = opened(path)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at) as out:
            for batch in iterator:
                out.write("".join(f"{line}\r\n" for line in batch.column(0).to_pylist()).encode())
        return Part(number, path)

    def commit(self, messages) -> None:
        fs, at = opened(self.path)
        part = f"{at}.part-{uuid.uuid4().hex}"
        if "/" in at:
            fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(part) as out:
            out.write(f"{self.header}\r\n".encode())
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                with fs.open_input_stream(opened(m.path)[1]) as rows:
                    while chunk := rows.read(CHUNK):
                        out.write(chunk)
        if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(at).type == pafs.FileType.File:
            fs.delete_file(at)  # not every store's move replaces a file
        fs.move(part, at)
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, at = opened(self.parts)
        if fs.get_file_info(at).type == pafs.FileType.Directory:
            fs.delete_dir(at)


class CsvFile(DataSource):
    """Takes rows of one column, rendered lines. Options: path, csv_header (the rendered first line)."""

    @classmethod
    def name(cls) -> str:
        return "csv_file"

    def writer(self, schema, overwrite) -> CsvFileWriter:
        return CsvFileWriter(self.options["path"], self.options["csv_header"])


def export_csv_file(df: DataFrame, path: str, headers: list[str] | None = None) -> None:
    """One file of CRLF lines in the order of df, the header first; replaces an older one, which stays whole until then.

    Tasks render and write; the join streams their bytes once, CHUNK at a time, since one file is one stream. A plain path must be mounted by
    all machines.
    """
    df.sparkSession.dataSource.register(CsvFile)
    header = csv_header(df, headers).first()[0]
    csv_rows(df).write.format("csv_file").option("csv_header", header).mode("overwrite").save(path)
