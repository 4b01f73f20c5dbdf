"""Output files that running checks still write to, as a stream of pieces: name, seq, chunk; for streaming.live.whole_lines.

A file `<name>.out` grows at its end; `<name>.out.done` beside it says that nothing more comes. A batch takes the bytes
that were not read before, in pieces of up to PIECE bytes, none of which ends inside a character, so that a piece can
be read again after a loss and is the same. seq is a piece's first byte. After the last piece of a file that is done
comes one that is null. Bytes that are no UTF-8 come out as replacement characters.

    growing.output(spark, folder)

The folder is one that driver and executors share. What was read of each file is the stream's offset, kept in its
checkpoint: a restart goes on there. It holds a pair for each file, so a folder is for one run of checks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from siftspark.session import importable

PIECE = 64 * 1024
#: Bytes of one file that one task reads.
RANGE = 16 * 1024 * 1024
ENDING = ".out"


@dataclass
class Range(InputPartition):
    name: str
    path: str
    start: int
    stop: int
    last: bool


def whole_until(file, stop: int) -> int:
    """The last place up to stop that doesn't lie inside a character of the file."""
    start = max(0, stop - 3)
    file.seek(start)
    tail = file.read(stop - start)
    for back in range(1, len(tail) + 1):
        byte = tail[-back]
        if byte >= 0xC0:  # begins a character of 2 to 4 bytes
            return stop if back >= (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4) else stop - back
        if byte < 0x80:
            break
    return stop


class GrowingReader(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """name -> how far a file can be read, and 1 if it is done."""
        out = {}
        for name in sorted(os.listdir(self.folder)):
            if name.endswith(ENDING):
                path = os.path.join(self.folder, name)
                done = os.path.exists(path + ".done")  # asked first: after it the size stays
                size = os.path.getsize(path)
                if not done:
                    with open(path, "rb") as file:
                        size = whole_until(file, size)
                out[name] = [size, int(done)]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for name, (stop, done) in end.items():
            at, was_done = start.get(name, [0, 0])
            path = os.path.join(self.folder, name)
            with open(path, "rb") as file:
                while stop - at > self.most:
                    cut = whole_until(file, at + self.most)
                    ranges.append(Range(name[: -len(ENDING)], path, at, cut, False))
                    at = cut
            if at < stop or done > was_done:
                ranges.append(Range(name[: -len(ENDING)], path, at, stop, done > was_done))
        return ranges or [Range("", "", 0, 0, False)]

    def read(self, partition: Range) -> Iterator[tuple]:
        at = partition.start
        if at < partition.stop:
            with open(partition.path, "rb") as file:
                while at < partition.stop:
                    cut = partition.stop if partition.stop - at <= PIECE else whole_until(file, at + PIECE)
                    file.seek(at)
                    yield partition.name, at, file.read(cut - at).decode(errors="replace")
                    at = cut
        if partition.last:
            yield partition.name, partition.stop, None

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class GrowingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "name string, seq long, chunk string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"], int(self.options.get("range", RANGE)))


def output(spark: SparkSession, folder: str, most: int = RANGE) -> DataFrame:
    """The stream of pieces of a folder's files; a task reads at most so many bytes of one."""
    importable(spark).dataSource.register(GrowingFiles)
    return spark.readStream.format("growing_files").option("range", most).load(folder)
