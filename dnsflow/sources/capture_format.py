"""Capture files as a data source: `spark.read.format("capture")` and `spark.readStream.format("capture")`.

    spark.dataSource.register(CaptureSource)
    captures.index_captures(spark, folder, index)
    spark.read.format("capture").option("index", index).load(folder)

With an index every split is a partition, also of block-format files; without one every file is. A stream offers
the files of a landing folder once each, in the order in which they were finished. Options: `kind` (pcap or
dnstap), `rawIp`, `index`, and `since` and `until` (microseconds), which leave out packets of other times while reading. Filters are not
pushed down: Spark keeps a reader with its filters for all later queries on the same DataFrame. Files whose names end in `.tmp` or `.part` are still being written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from dnsflow.schema import PACKETS
from dnsflow.sources import captures

#: Without an index, files are numbered and their packets after them.
FILE_PACKETS = 1 << 40


@dataclass
class Split(InputPartition):
    path: str
    size: int
    first: int | None
    limit: int
    number: int
    state: str | None


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match("[a-z0-9]+:", path) else f"file://{path}")


def _files(path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change in nanoseconds) of the finished files at a path."""
    system, place = _located(path)
    info = system.get_file_info(place)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(place, recursive=True))
    scheme = path.split(":")[0] + "://" if re.match("[a-z0-9]+:", path) else "file://"
    return sorted(
        (scheme + x.path, x.size, x.mtime_ns or 0) for x in found if x.is_file and x.size and not x.path.endswith((".tmp", ".part", ".crc"))
    )


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, options: dict):
        self.kind, self.raw_ip = options.get("kind", "pcap"), options.get("rawip", options.get("rawIp", "false")).lower() == "true"
        self.path, self.index = options["path"], options.get("index")
        self.low, self.high = (int(options[n]) if n in options else None for n in ("since", "until"))

    def batches(self, split: Split) -> Iterator[pa.RecordBatch]:
        first, limit = split.first, split.limit
        if first is None:
            form = captures._format(self.kind, captures.Source(split.path, split.size))
            if form is None:
                return
            first, limit = form.first, split.size
        for held in captures.split_rows(self.kind, self.raw_ip, split.path, split.size, first, limit, split.number, split.state):
            kept = [r for r in held if r[2] is None or (self.low is None or r[2] >= self.low) and (self.high is None or r[2] <= self.high)]
            yield captures.packet_batch(kept)


class CaptureReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Split]:
        if self.index is not None:
            system, place = _located(self.index)
            rows = ds.dataset(place, filesystem=system, format="parquet").to_table().to_pylist()
            return [Split(r["path"], r["size"], r["first"], r["limit"], r["number"], r["state"]) for r in rows if r["kind"] == self.kind]
        return [Split(p, size, None, size, k * FILE_PACKETS, None) for k, (p, size, _) in enumerate(_files(self.path))]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)


class LandingReader(_Reading, DataSourceStreamReader):
    """Offsets are the time and name of the last file offered; a file must not get an older time when it lands."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": "", "files": 0}

    def _after(self, offset: dict) -> list[tuple[str, int, int]]:
        later = [f for f in _files(self.path) if (f[2], f[0]) > (offset["time"], offset["path"])]
        return sorted(later, key=lambda f: (f[2], f[0]))

    def latestOffset(self) -> dict:
        files = self._after({"time": -1, "path": ""})
        return {"time": files[-1][2], "path": files[-1][0], "files": len(files)} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Split]:
        fresh = [f for f in self._after(start) if (f[2], f[0]) <= (end["time"], end["path"])]
        return [Split(p, size, None, size, (start["files"] + k) * FILE_PACKETS, None) for k, (p, size, _) in enumerate(fresh)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.batches(partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> LandingReader:
        return LandingReader(self.options)
