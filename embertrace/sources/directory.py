"""A folder of event files as a data source: oldest files first, a bounded number in each fetch.

The source lists files; their contents are read by the tasks that get the listed rows. A position in the
folder is the (modified, path) of the last file taken, so files that arrive later are found by a later fetch
and none is taken twice.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from embertrace.sources.xml_events import FILES_PER_FETCH

FORMAT = "event_files"
START = {"modified": -1, "path": ""}
PIECE, BLOCK = 32 << 20, 1 << 20  # bytes of a file that a task takes, and that it holds at a time
COMPRESSED = (".bz2", ".gz", ".lz4", ".zst")  # endings by which a file is decompressed


def listed(folder: str, suffix: str) -> list[tuple[int, str]]:
    """(modified in microseconds, path) of the folder's files with the suffix, oldest first."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(base, recursive=False, allow_not_found=True))
    files = [i for i in found if i.type == fs.FileType.File and i.base_name.lower().endswith(suffix) and not i.base_name.startswith((".", "_"))]
    return sorted(((i.mtime_ns or 0) // 1000, i.path) for i in files)


def after(files: list[tuple[int, str]], position: dict) -> list[tuple[int, str]]:
    return [f for f in files if f > (position["modified"], position["path"])]


class EventFiles(DataSource):
    """``path``: the folder; ``suffix`` (.xml); ``limit``: most files of a fetch (100, as a batch: all);
    ``modified`` and ``after``: the position that a batch begins behind."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "modified bigint, path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Files(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Fetches(self.options)


class _Files(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".xml").lower()
        self.limit = int(options["limit"]) if "limit" in options else None
        self.position = {"modified": int(options.get("modified", -1)), "path": options.get("after", "")}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(after(listed(self.folder, self.suffix), self.position)[: self.limit])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from partition.value


class _Fetches(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.suffix = options["path"], options.get("suffix", ".xml").lower()
        self.limit = int(options.get("limit", FILES_PER_FETCH))

    def initialOffset(self) -> dict:
        return dict(START)

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files = after(listed(self.folder, self.suffix), start)[: self.limit]
        end = {"modified": files[-1][0], "path": files[-1][1]} if files else start
        return iter(files), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([f for f in after(listed(self.folder, self.suffix), start) if f <= (end["modified"], end["path"])])


def pieces(files: DataFrame, folder: str, size: int = PIECE) -> DataFrame:
    """(path, start, end) of listed files: byte ranges of ``size``, the last one without an end. A compressed
    file is one piece, as it can only be read from its beginning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                whole = path.endswith(COMPRESSED)
                starts = [0] if whole else list(range(0, max(store.get_file_info(path).size or 0, 1), size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array([*starts[1:], None], pa.int64())],
                    ["path", "start", "end"])

    return files.select("path").mapInArrow(run, "path string, start bigint, end bigint")


def lines_of(store, path: str, start: int, end: int | None, block: int = BLOCK) -> Iterator[list[bytes]]:
    """Lists of the lines that begin in a range of a file's bytes, without line ends; about ``block`` bytes each."""
    with store.open_input_file(path) if start or end is not None else store.open_input_stream(path) as stream:
        skip, held = start > 0, []  # a line that began before belongs to another piece; what is read of an unfinished line
        at = max(start - 1, 0)  # where the next line begins or, before that is known, where to go on looking
        if skip:
            stream.seek(at)
        while end is None or at < end:
            chunk = stream.read(block)
            if not chunk:
                if held:
                    yield [b"".join(held)]
                return
            if b"\n" not in chunk:
                if skip:
                    at += len(chunk)
                else:
                    held.append(chunk)
                continue
            *lines, left = b"".join([*held, chunk]).split(b"\n")
            if skip:
                at, lines, skip = at + len(lines[0]) + 1, lines[1:], False
            for n, line in enumerate(lines):
                if end is not None and at >= end:
                    lines = lines[:n]
                    break
                at += len(line) + 1
            held = [left] if left else []
            yield lines


def contents(files: DataFrame, folder: str, tasks: int | None = None, size: int = PIECE) -> DataFrame:
    """(path, xml) of listed files (modified, path), one row per line that is not blank. Files are cut into
    pieces of ``size`` bytes, dealt to ``tasks`` (the session's shuffle partitions), and a piece is read block by
    block, so that a task holds a block and a line, however large files are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                first = start == 0
                for found in lines_of(store, path, start, end):
                    if first and found:
                        found[0], first = found[0].removeprefix(codecs.BOM_UTF8), False
                    lines = [t for line in found if (t := line.decode("utf-8", "replace")).strip()]
                    if lines:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())], ["path", "xml"])

    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces(files, folder, size).repartition(tasks, "path", "start").mapInArrow(run, "path string, xml string")


def fetch(spark: SparkSession, folder: str, position: dict | None = None, limit: int | None = FILES_PER_FETCH, suffix: str = ".xml") -> tuple[DataFrame, dict]:
    """((path, xml) of the oldest ``limit`` files behind ``position``, the position behind them). Only the
    last file's name and time reach the driver."""
    position = position or START
    spark.dataSource.register(EventFiles)
    reader = spark.read.format(FORMAT).option("suffix", suffix).option("modified", position["modified"]).option("after", position["path"])
    files = (reader if limit is None else reader.option("limit", limit)).load(folder)
    last = files.agg(F.max(F.struct("modified", "path")).alias("last")).first()["last"]
    if last is None:
        return spark.createDataFrame([], "path string, xml string"), dict(position)
    end = {"modified": last.modified, "path": last.path}
    # Files that arrive between the two listings lie behind the end and are left to the next fetch.
    upto = files.filter(F.struct("modified", "path") <= F.struct(F.lit(end["modified"]).cast("bigint").alias("modified"), F.lit(end["path"]).alias("path")))
    return contents(upto, folder), end


def stream(spark: SparkSession, folder: str, limit: int = FILES_PER_FETCH, suffix: str = ".xml") -> DataFrame:
    """(path, xml) of the folder's files as a stream, oldest first, at most ``limit`` files a fetch."""
    spark.dataSource.register(EventFiles)
    files = spark.readStream.format(FORMAT).option("suffix", suffix).option("limit", limit).load(folder)
    return contents(files, folder)
