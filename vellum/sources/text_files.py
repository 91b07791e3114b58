"""Many small text files as a Spark data source: ``spark.read.format("text_files")`` and ``df.write.format("text_files")``.

Writing (name, text): tasks write their rows' files, each under a temporary name first, into
SHARDS folders by a checksum of the name, so no folder and no task is one document's.  The
folder has to be new.  A commit puts a mark into it, without which it can't be
read; a write that fails takes the folder away.  A task that runs again writes the same files.

Reading: a partition for each folder within the listed ones lists its files, on the executors, those of no bytes
too; texts are read where they are asked for.

Options: ``path``, or ``paths``, a JSON list of folders, whose places are their ranks;
``texts`` (false: names and sizes only); ``marked`` (false: folders that other programs wrote, which have no mark).
Paths are of any file system that Arrow knows.
"""

from __future__ import annotations

import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT, SHARDS, MARK, AT_ONCE = "text_files", 256, "_COMPLETE", 256
SCHEMA = "rank int, folder string, path string, name string, size long, is_file boolean, text string"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def shard_of(name: str) -> str:
    return f"{zlib.crc32(name.encode()) % SHARDS:02x}"


@dataclass
class Written(WriterCommitMessage):
    files: int


@dataclass
class Listing(InputPartition):
    rank: int
    folder: str
    inner: str


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folders = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.texts, self.marked = (options.get(k, "true").lower() == "true" for k in ("texts", "marked"))

    def partitions(self) -> list[Listing]:
        """The folders themselves, and those right within them; their files aren't listed here."""
        out = []
        for rank, folder in enumerate(self.folders):
            system, at = _place(folder)
            entries = system.get_file_info(fs.FileSelector(at, allow_not_found=not self.marked))
            if self.marked and not any(e.base_name == MARK for e in entries):
                raise FileNotFoundError(f"{folder} isn't complete")
            out += [Listing(rank, folder, ""), *[Listing(rank, folder, e.base_name) for e in entries if e.type == fs.FileType.Directory]]
        return out

    def read(self, partition: Listing) -> Iterator[pa.RecordBatch]:
        system, at = _place(partition.folder)
        entries = system.get_file_info(fs.FileSelector(posixpath.join(at, partition.inner), allow_not_found=True))
        entries = sorted((e for e in entries if e.base_name != MARK), key=lambda e: e.base_name)
        schema = pa.schema([("rank", pa.int32()), *[(c, pa.string()) for c in ("folder", "path", "name")], ("size", pa.int64()), ("is_file", pa.bool_()), ("text", pa.string())])
        for low in range(0, len(entries), AT_ONCE):
            rows = []
            for e in entries[low : low + AT_ONCE]:
                text, is_file = None, e.type == fs.FileType.File
                if self.texts and is_file:
                    with system.open_input_stream(e.path) as stream:
                        text = stream.read().decode("utf-8", "replace")
                rows.append((partition.rank, partition.folder, posixpath.join(partition.inner, e.base_name), e.base_name, e.size if is_file else None, is_file, text))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        system, at = _place(self.folder)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.folder} exists")
        system.create_dir(at)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = _place(self.folder)
        files, made = 0, set()
        for batch in iterator:
            for name, text in zip(batch["name"].to_pylist(), batch["text"].to_pylist()):
                if not name or "/" in name or name in (".", "..", MARK):
                    raise ValueError(f"no name for a file: {name!r}")
                inner = posixpath.join(at, shard_of(name))
                if inner not in made:
                    system.create_dir(inner)
                    made.add(inner)
                draft = posixpath.join(inner, f".{uuid.uuid4().hex}")
                with system.open_output_stream(draft) as stream:
                    stream.write((text or "").encode("utf-8", "replace"))
                system.move(draft, posixpath.join(inner, name))
                files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = _place(self.folder)
        with system.open_output_stream(posixpath.join(at, MARK)) as stream:
            stream.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = _place(self.folder)
        system.delete_dir(at)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def write_texts(texts: DataFrame, folder: str) -> None:
    """Each row's text (name, text) as a file of its name in a new folder; a null text is an empty file."""
    texts.sparkSession.dataSource.register(TextFiles)
    texts.select("name", "text").write.format(FORMAT).mode("append").option("path", folder).save()


def read_files(spark: SparkSession, folders: list[str], texts: bool = False, marked: bool = True) -> DataFrame:
    """(rank, folder, path, name, size, is_file, text): what is in the folders, and in those right within them."""
    spark.dataSource.register(TextFiles)
    return spark.read.format(FORMAT).option("paths", json.dumps(folders)).option("texts", str(texts)).option("marked", str(marked)).load()
