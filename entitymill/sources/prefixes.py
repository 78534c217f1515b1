"""The first bytes of files as a table: a data source that opens each file and reads no more than its prefix.

Files are listed once and dealt out in groups, one task each. Paths are opened through
pyarrow's file systems; a store that only Spark can open is read by its
text reader instead, from the start of each file to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import profile

#: Files of one task.
GROUP = 64
_SCHEMA = "path string, size long, bytes_read long, prefix binary"
_KIND = pa.schema([("path", pa.string()), ("size", pa.int64()), ("bytes_read", pa.int64()), ("prefix", pa.binary())])


def needed(files: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """Of each dataset, a folder of ``part-`` files, the first parts that hold ``most`` bytes together; every other file."""
    out, held = [], {}
    for path, size in files:
        folder, _, name = path.rpartition("/")
        of = folder if name.startswith("part-") else path
        if held.get(of, 0) < most:
            out.append((path, size))
        held[of] = held.get(of, 0) + size
    return out


class Group(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def head(stream, most: int) -> bytes:
    """Up to ``most`` bytes from the start of a stream, in as many reads as it takes."""
    out = b""
    while len(out) < most and (more := stream.read(most - len(out))):
        out += more
    return out


class PrefixReader(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Group]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(root)
        infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and not any(p[:1] in "._" for p in i.path.removeprefix(root).split("/") if p))
        files = needed(files, self.most)
        return [Group(files[k : k + GROUP]) for k in range(0, len(files), GROUP)] or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for path, size in partition.files:
            with store.open_input_stream(path, buffer_size=0) as stream:
                prefix = head(stream, self.most)
            yield pa.RecordBatch.from_pylist([{"path": path, "size": size, "bytes_read": len(prefix), "prefix": prefix}], _KIND)


class PrefixSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_prefixes"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> PrefixReader:
        return PrefixReader(self.options["path"], int(self.options.get("most", profile.PREFIX)))


def known_store(folder: str) -> bool:
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError, NotImplementedError):
        return False
    return True


def read_prefixes(spark: SparkSession, folder: str, most: int = profile.PREFIX) -> DataFrame:
    """``(path, size, bytes_read, prefix)`` of the files in a folder and its subfolders; hidden ones and parts beyond ``needed`` are left out."""
    spark.dataSource.register(PrefixSource)
    return spark.read.format("file_prefixes").option("most", most).load(folder)
