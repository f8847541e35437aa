"""Text files as a sink (K4-K8): a file for each name, its lines streamed in order, made visible by one commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from auditlake.sinks.commits import commit, pointer


#: Bytes of lines that are written, and of texts that are handed on, at once.
BUFFER_BYTES = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class ReportFiles(DataSource):
    """Written: rows (name, line), those of one name together and in order. Read: rows (name, text). Options path and job."""

    @classmethod
    def name(cls) -> str:
        return "report_files"

    def schema(self) -> str:
        return "name string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(f"{self.options['path']}/{self.options['job']}")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(f"{self.options['path']}/{self.options['job']}")


@dataclass
class Folder(InputPartition):
    name: str


class _Reader(DataSourceReader):
    """A task lists and reads the folder that one task wrote: names of files are never gathered, however many there are."""

    def __init__(self, place: str) -> None:
        self.place = place

    def partitions(self) -> list[Folder]:
        files, root = FileSystem.from_uri(self.place)
        with files.open_input_stream(f"{root}/folders.json") as listed:
            return [Folder(name) for name in json.loads(listed.read())]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        files, root = FileSystem.from_uri(self.place)
        names, texts, size = [], [], 0
        for info in files.get_file_info(FileSelector(f"{root}/{partition.name}")):
            with files.open_input_stream(info.path) as file:
                names.append(info.base_name)
                texts.append(file.read())
            size += len(texts[-1])
            if size >= BUFFER_BYTES:
                yield _batch(names, texts)
                names, texts, size = [], [], 0
        if names:
            yield _batch(names, texts)


def _batch(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["name", "text"])


class _Writer(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own; the folders of the attempts that counted are listed when the
    job ends, so what a lost or doubled attempt left is never read. A name's file is open while its lines pass: no
    report is held in memory."""

    def __init__(self, place: str) -> None:
        self.place = place

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        folder = uuid.uuid4().hex
        files, root = FileSystem.from_uri(self.place)
        files.create_dir(f"{root}/{folder}", recursive=True)
        open_name, out, n, held, size = None, None, 0, [], 0
        for batch in iterator:
            batch = batch.filter(pc.is_valid(batch.column(1)))
            if not batch.num_rows:
                continue
            names, lines = batch.column(0), batch.column(1).to_pylist()
            # Rows of one name are a run: names are looked at where they change only.
            starts = [0, *(np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()]
            for name, a, b in zip(names.take(pa.array(starts)).to_pylist(), starts, [*starts[1:], len(lines)], strict=True):
                if name != open_name:
                    if out is not None:
                        out.write("".join(held).encode("utf-8"))
                        out.close()
                    held, size = [], 0
                    if "/" in name or name.startswith((".", "_")):
                        raise ValueError(f"no name of a report: {name!r}")
                    open_name, out, n = name, files.open_output_stream(f"{root}/{folder}/{name}"), n + 1
                held += ["\n".join(lines[a:b]), "\n"]
                size += len(held[-2]) + 1
                if size >= BUFFER_BYTES:
                    out.write("".join(held).encode("utf-8"))
                    held, size = [], 0
        if out is not None:
            out.write("".join(held).encode("utf-8"))
            out.close()
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = FileSystem.from_uri(self.place)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/folders.json") as out:
            out.write(json.dumps([m.folder for m in messages if m is not None and m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = FileSystem.from_uri(self.place)
        for m in messages:
            if m is not None:
                files.delete_dir(f"{root}/{m.folder}")


def write_reports(lines: DataFrame, path: str) -> int:
    """Write lines (name, section, place, line) as a file for each name under path and commit them together; the commit's
    number. Lines stand by section, then place. path must be one that every task reaches, with a scheme that pyarrow
    knows. A line may hold breaks; a null line is left out."""
    spark, job = lines.sparkSession, f"reports-{uuid.uuid4().hex}"
    spark.dataSource.register(ReportFiles)
    where = path if "://" in path else f"file://{path}"
    # Null lines go where they are written: a filter here would be pushed down and tell each line twice.
    ordered = lines.where("name IS NOT NULL").repartition("name").sortWithinPartitions("name", "section", "place").select(F.col("name").cast("string"), F.col("line").cast("string"))
    ordered.write.format("report_files").mode("append").option("path", where.rstrip("/")).option("job", job).save()
    return commit(spark, where.rstrip("/"), job)


def read_reports(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(name, text) of the reports of a commit, the last one where no number is given; a task for each that wrote some."""
    where = (path if "://" in path else f"file://{path}").rstrip("/")
    job = pointer(spark, where, number)
    folders = [] if job is None else json.loads(spark.read.text(f"{where}/{job}/folders.json", wholetext=True).first()[0])
    if not folders:
        return spark.createDataFrame([], "name string, text string")
    spark.dataSource.register(ReportFiles)
    return spark.read.format("report_files").option("path", where).option("job", job).load()
