"""Capture files and dnstap recordings as packet tables.

These formats are chains of length-prefixed records without an index, so a file cannot be
cut at any byte. Files are cut into splits anyway: every split looks for a chain of
plausible record headers after its start and walks to its end. A split must begin where the
records before it end; splits that do not are walked again from there, all at once, until
every file is one chain. So big files are read in parallel and every record exactly once.

Records before a broken one are kept; what follows it in the file is reported by
`capture_rejects`, and so are files that are no captures.
"""

from __future__ import annotations

import itertools
import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsflow.plans.skew import cut_lineage
from dnsflow.schema import PACKETS

SPLIT_BYTES = 64 << 20
CHAIN = 16
BLOCK = 4 << 20
BATCH = 4096
BATCH_BYTES = 8 << 20
COLUMNS = pa.schema([
    ("source", pa.string()), ("packet_no", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("kind", pa.string()),
    ("raw_ip", pa.bool_()), ("payload", pa.binary()),
])
# First bytes of a capture file: byte order and ticks per second.
MAGIC = {
    b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\xd4\xc3\xb2\xa1": ("<", 1_000_000),
    b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000),
}
# Block types of the block-structured capture format, its byte-order mark, and the
# option that holds an interface's clock resolution.
SECTION, INTERFACE, OLD_PACKET, SIMPLE_PACKET, PACKET = 0x0A0D0D0A, 1, 2, 3, 6
BYTE_ORDER, RESOLUTION = 0x1A2B3C4D, 9


class Broken(ValueError):
    """The file cannot be read on from here."""


class Source:
    """A file read at any position through a block cache."""

    def __init__(self, uri: str, size: int):
        system, path = fs.FileSystem.from_uri(uri)
        self.file, self.size = system.open_input_file(path), size
        self.start, self.block = 0, b""

    def read(self, at: int, count: int) -> bytes:
        if not self.start <= at or at + count > self.start + len(self.block):
            self.file.seek(at)
            self.start, self.block = at, self.file.read(max(count, BLOCK))
        return self.block[at - self.start : at - self.start + count]


@dataclass(frozen=True)
class Pcap:
    """Record headers of 16 bytes: seconds, fraction, kept and original length."""

    order: str
    ticks: int
    longest: int
    first: int = 24
    head: int = 16

    @classmethod
    def of(cls, source: Source) -> "Pcap":
        order, ticks = MAGIC[source.read(0, 4)]
        longest = struct.unpack(order + "I", source.read(16, 4))[0] if source.size >= 20 else 0
        return cls(order, ticks, longest or 1 << 31)

    def length(self, head: bytes) -> int | None:
        """Bytes after the header, None when this cannot be a header."""
        _, fraction, kept, original = struct.unpack(self.order + "4I", head)
        return kept if fraction < self.ticks and kept <= original else None

    def time_us(self, head: bytes) -> int | None:
        seconds, fraction = struct.unpack_from(self.order + "2I", head)
        return seconds * 1_000_000 + fraction * 1_000_000 // self.ticks

    def candidates(self, data: bytes) -> np.ndarray:
        """Offsets where a header with a sensible length may begin."""
        n = len(data) - self.head + 1
        word = lambda at: np.stack(
            [np.frombuffer(data, np.uint8, n, at + k).astype(np.uint32) for k in range(4)]
        )
        value = lambda at: sum(
            b << np.uint32(8 * (k if self.order == "<" else 3 - k)) for k, b in enumerate(word(at))
        )
        kept = value(8)
        return np.flatnonzero((value(4) < self.ticks) & (kept <= value(12)) & (kept <= self.longest) & (kept > 0))

    def records(self, source: Source, at: int, limit: int | None) -> Iterator[tuple]:
        """(position, time, data start, size, end) of the records that begin in [at, limit)."""
        unpack, stop = struct.Struct(self.order + "4I").unpack_from, source.size if limit is None else limit
        while at < stop:
            if at + self.head > source.size:
                raise Broken("the file ends within a record header")
            source.read(at, self.head)
            # All headers of the block are read from it without further calls.
            start, block = source.start, source.block
            last = min(stop - 1, start + len(block) - self.head)
            while at <= last:
                seconds, fraction, size, original = unpack(block, at - start)
                if fraction >= self.ticks or size > original:
                    raise Broken("broken record header")
                end = at + self.head + size
                if end > source.size:
                    raise Broken("the file ends within a record")
                yield at, seconds * 1_000_000 + fraction * 1_000_000 // self.ticks, at + self.head, size, end
                at = end


@dataclass(frozen=True)
class FrameStream:
    """Frames of a 4-byte length and data; length zero introduces a control frame."""

    first: int = 0
    head: int = 4
    likely: int = 1 << 24

    @classmethod
    def of(cls, source: Source) -> "FrameStream":
        return cls()

    def length(self, head: bytes) -> int | None:
        return int.from_bytes(head, "big")

    def time_us(self, head: bytes) -> int | None:
        return None

    def candidates(self, data: bytes) -> np.ndarray:
        n = len(data) - self.head + 1
        return np.flatnonzero(np.frombuffer(data, np.uint8, n) == 0)  # shorter than `likely`

    def records(self, source: Source, at: int, limit: int | None) -> Iterator[tuple]:
        while at < (source.size if limit is None else limit):
            if at + self.head > source.size:
                raise Broken("the file ends within a frame length")
            size = int.from_bytes(source.read(at, self.head), "big")
            if size == 0:
                # A control frame: its own length follows.
                if at + 8 > source.size:
                    raise Broken("the file ends within a control frame")
                end = at + 8 + int.from_bytes(source.read(at + 4, 4), "big")
                if end > source.size:
                    raise Broken("the file ends within a control frame")
                at = end
                continue
            end = at + self.head + size
            if end > source.size:
                raise Broken("the file ends within a frame")
            yield at, None, at + self.head, size, end
            at = end


@dataclass
class Blocks:
    """The block-structured capture format.

    Byte order and interfaces must be known, so one walk over the block headers notes them for every split.
    """

    first: int = 0
    order: str = "<"
    ticks: list = field(default_factory=list)

    @property
    def state(self) -> str:
        return json.dumps([self.order, self.ticks])

    def resumed(self, state: str) -> Blocks:
        self.order, self.ticks = json.loads(state)
        return self

    def splits(self, source: Source, width: int) -> list[tuple]:
        """(start, end, first, after, records, state, reason) of every split of `width` bytes in which a record begins."""
        out, reason = [], None
        try:
            for at, _, _, _, end in self.records(source, 0, None):
                start = at // width * width
                if not out or out[-1][0] != start:
                    out.append([start, min(start + width, source.size), at, at, 0, self.state, None])
                out[-1][3:5] = [end, out[-1][4] + 1]
        except Broken as problem:
            reason = str(problem)
        out = out or [[0, min(width, source.size), 0, 0, 0, self.state, None]]
        out[-1][6] = reason
        for one, following in zip(out, out[1:]):
            one[3] = following[2]  # blocks without packets between them belong to none
        return [tuple(x) for x in out]

    def _interface(self, body: bytes) -> None:
        ticks, at = 1_000_000, 8
        while at + 4 <= len(body):
            code, size = struct.unpack_from(self.order + "2H", body, at)
            if code == 0:
                break
            if code == RESOLUTION and size:
                value = body[at + 4]
                ticks = 2 ** (value & 127) if value & 128 else 10**value
            at += 4 + -(-size // 4) * 4
        self.ticks.append(ticks)

    def records(self, source: Source, at: int, limit: int | None) -> Iterator[tuple]:
        while at < (source.size if limit is None else limit):
            if at + 12 > source.size:
                raise Broken("the file ends within a block")
            head = source.read(at, 12)
            kind = struct.unpack(self.order + "I", head[:4])[0]
            if kind == SECTION:
                self.order = "<" if struct.unpack("<I", head[8:])[0] == BYTE_ORDER else ">"
                self.ticks = []
            size = struct.unpack(self.order + "I", head[4:8])[0]
            if size < 12 or size % 4 or at + size > source.size:
                raise Broken("broken block length")
            if kind == INTERFACE:
                self._interface(source.read(at + 8, size - 12))
            elif kind == PACKET and size >= 32:
                number, high, low, kept = struct.unpack(self.order + "4I", source.read(at + 8, 16))
                if number >= len(self.ticks) or kept > size - 32:
                    raise Broken("broken packet block")
                yield at, ((high << 32) | low) * 1_000_000 // self.ticks[number], at + 28, kept, at + size
            elif kind == OLD_PACKET and size >= 32:
                number, _, high, low, kept = struct.unpack(self.order + "2H3I", source.read(at + 8, 16))
                if number >= len(self.ticks) or kept > size - 32:
                    raise Broken("broken packet block")
                yield at, ((high << 32) | low) * 1_000_000 // self.ticks[number], at + 28, kept, at + size
            elif kind == SIMPLE_PACKET and size >= 16:
                original = struct.unpack(self.order + "I", source.read(at + 8, 4))[0]
                yield at, None, at + 12, min(original, size - 16), at + size
            at += size


def _format(kind: str, source: Source):
    """How to read the file; None if it is no capture."""
    if kind == "dnstap":
        return FrameStream.of(source)
    magic = source.read(0, 4)
    if magic == SECTION.to_bytes(4, "big"):
        return Blocks()
    return Pcap.of(source) if magic in MAGIC else None


def _plausible(source: Source, form, at: int) -> bool:
    last = None
    for _ in range(CHAIN):
        if at + form.head > source.size:
            return at == source.size
        head = source.read(at, form.head)
        size = form.length(head)
        if not size:
            return False
        seconds = form.time_us(head)
        if last is not None and seconds is not None and abs(seconds - last) > 86_400_000_000:
            return False
        last, at = seconds, at + form.head + size
    return at <= source.size


def _begin(source: Source, form, start: int, end: int) -> int | None:
    """The first place in [start, end) where a chain of records seems to begin."""
    step = 1 << 16
    for low in range(start, end, step):
        data = source.read(low, min(step + form.head - 1, source.size - low))
        if len(data) >= form.head:
            for offset in form.candidates(data):
                if low + offset < end and _plausible(source, form, low + int(offset)):
                    return low + int(offset)
    return None


INDEX = (
    "path string, size bigint, start bigint, end bigint, first bigint, after bigint, records bigint, reason string, state string"
)
_FIELDS = [x.split()[0] for x in INDEX.split(", ")]


def _index(kind: str):
    """Walks splits: from the place in `first` if there is one, else from where records seem to begin."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, size, start, end, known in pdf[["path", "size", "start", "end", "first"]].itertuples(index=False):
                source = Source(path, size)
                form = _format(kind, source)
                if form is None:
                    rows.append((path, size, start, end, 0, 0, 0, "not a capture" if start == 0 else None, None))
                    continue
                if isinstance(form, Blocks):  # the first split walks the headers for all
                    if start == 0:
                        for low, high, first, after, count, state, reason in form.splits(source, int(end)):
                            rows.append((path, size, low, high, first, after, count, reason, state))
                    continue
                if not pd.isna(known):
                    at = int(known)
                else:
                    at = form.first if start == 0 else _begin(source, form, start, end)
                count, after, reason = 0, at, None
                try:
                    for *_, stop in form.records(source, at, end) if at is not None else ():
                        count, after = count + 1, stop
                    if isinstance(form, FrameStream) and at is not None:
                        after = max(after, _past_control(source, after, end))
                except Broken as problem:
                    reason = str(problem)
                rows.append((path, size, start, end, at, after, count, reason, None))
            out = pd.DataFrame(rows, columns=_FIELDS)
            yield out.astype({"first": "Int64", "after": "Int64"})

    return run


def _past_control(source: Source, at: int, end: int) -> int:
    """The end of the control frames that begin at `at`, below `end`."""
    while at < end and at + 8 <= source.size and source.read(at, 4) == bytes(4):
        at += 8 + int.from_bytes(source.read(at + 4, 4), "big")
    return at


def _expected(index: DataFrame) -> DataFrame:
    """Adds where each split has to begin, and whether an earlier one of its file has stopped."""
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return index.withColumns({
        "due": F.coalesce(F.max("after").over(before), F.col("first")),
        "dead": F.coalesce(F.max(F.col("reason").isNotNull()).over(before), F.lit(False)),
    })


def _chained(spark: SparkSession, path: str, kind: str, split_bytes: int) -> DataFrame:
    """The index of all splits, each beginning where the one before ended."""
    files = spark.read.format("binaryFile").load(path).filter("path not like '%.tmp' and path not like '%.part'").select("path", F.col("length").alias("size"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))
    cut = files.filter("size > 0").select("path", "size", F.explode(starts).alias("start"))
    ranges = cut.withColumn("end", F.least(F.col("start") + split_bytes, F.col("size")))
    number = max(1, ranges.count())
    unknown = ranges.withColumn("first", F.lit(None).cast("bigint"))
    index = cut_lineage(unknown.repartition(number).mapInPandas(_index(kind), INDEX))
    while True:
        linked = cut_lineage(_expected(index))
        wrong = ~F.col("dead") & ~F.col("first").eqNullSafe(F.col("due"))
        outside = F.col("due") >= F.col("end")
        # A split that lies within a record of an earlier one has no records.
        settled = linked.withColumns({
            "first": F.when(wrong & outside, F.col("due")).otherwise(F.col("first")),
            "after": F.when(wrong & outside, F.col("due")).otherwise(F.col("after")),
            "records": F.when(wrong & outside, F.lit(0)).otherwise(F.col("records")).cast("bigint"),
            "reason": F.when(~(wrong & outside), F.col("reason")),
            "again": wrong & ~outside,
        })
        n = linked.filter(wrong).count()
        if n == 0:
            return linked.filter("not dead").drop("dead")
        walk = settled.filter("again").drop("first").withColumnRenamed("due", "first").select("path", "size", "start", "end", "first")
        index = cut_lineage(
            settled.filter("not again").select(*_FIELDS).unionByName(walk.repartition(n).mapInPandas(_index(kind), INDEX))
        )


def _splits(spark: SparkSession, path: str, kind: str, split_bytes: int) -> DataFrame:
    """(path, size, first, limit, number, state): byte ranges whose records start in them; numbers run over all files."""
    index = _chained(spark, path, kind, split_bytes).filter("records > 0")
    sums = index.groupBy("path").agg(F.sum("records").alias("n"))
    # One row per file.
    bases = sums.select("path", (F.sum("n").over(Window.orderBy("path")) - F.col("n")).alias("base"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("records").over(before), F.lit(0))
    return cut_lineage(
        index.withColumn("within", within).join(bases, "path")
        .select("path", "size", "first", F.col("after").alias("limit"), (F.col("base") + F.col("within")).alias("number"), "state")
    )


def split_rows(kind: str, raw_ip: bool, path: str, size: int, first: int, limit: int, number: int, state: str | None) -> Iterator[list[tuple]]:
    """The packets of a split, in lists of bounded size; those before a broken record."""
    label = "WIRE" if kind == "pcap" else "DNSTAP"
    source = Source(path, size)
    form = _format(kind, source)
    if state is not None:
        form = form.resumed(state)
    rows, held, records = [], 0, form.records(source, first, limit)
    for k in itertools.count():
        try:
            _, us, at, length, end = next(records, (None,) * 5)
        except Broken:
            break
        if end is None:
            break
        rows.append((path, number + k, us, label, raw_ip, source.read(at, length)))
        held += length
        if len(rows) == BATCH or held >= BATCH_BYTES:
            yield rows
            rows, held = [], 0
        if end >= limit:
            break
    yield rows


def _packets(kind: str, raw_ip: bool):
    def run(batches):
        for batch in batches:
            for split in batch.select(["path", "size", "first", "limit", "number", "state"]).to_pylist():
                for rows in split_rows(kind, raw_ip, *split.values()):
                    yield packet_batch(rows)

    return run


def packet_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.types)], schema=COLUMNS)


def _read(spark, path, kind, raw_ip, split_bytes) -> DataFrame:
    splits = _splits(spark, path, kind, split_bytes)
    # One task per split; a number given to repartition is kept as it is.
    return splits.repartition(max(1, splits.count())).mapInArrow(_packets(kind, raw_ip), PACKETS)


def read_captures(spark: SparkSession, path: str, raw_ip: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Packets of the capture files under `path` with their capture time.

    `packet_no` runs over all files, in order of path and place, so it names one packet.
    """
    return _read(spark, path, "pcap", raw_ip, split_bytes)


def read_dnstap(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """dnstap frames of recorded frame streams; `ts` is null, the frames carry their own times."""
    return _read(spark, path, "dnstap", False, split_bytes)


def index_captures(spark: SparkSession, path: str, index: str, kind: str = "pcap", split_bytes: int = SPLIT_BYTES) -> None:
    """Writes the splits of all files as a table that the `capture` data source takes as its index."""
    splits = _splits(spark, path, kind, split_bytes).withColumn("kind", F.lit(kind))
    splits.coalesce(1).write.mode("overwrite").parquet(index)  # one row per split


def capture_rejects(
    spark: SparkSession, path: str, kind: str = "pcap", split_bytes: int = SPLIT_BYTES
) -> DataFrame:
    """(source, position, reason): where a file cannot be read on, and files that are no captures."""
    stopped = _chained(spark, path, kind, split_bytes).filter("reason is not null")
    return stopped.select(F.col("path").alias("source"), F.col("after").alias("position"), "reason")


def write_captures(packets: DataFrame, folder: str, longest: int = 1 << 18) -> DataFrame:
    """Writes packets as capture files, one per partition; returns (path, packets).

    A file appears under its name when it is whole, so a repeated task does no harm.
    """
    def run(batches):
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}.pcap"
        system, path = fs.FileSystem.from_uri(name if ":" in name.split("/")[0] else f"file://{name}")
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        hidden, number = f"{path}.{uuid.uuid4().hex}.tmp", 0
        head = struct.Struct("<4I").pack
        with system.open_output_stream(hidden, compression=None) as out:
            out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, longest, 1))
            for batch in batches:
                for low in range(0, batch.num_rows, BATCH):
                    parts = []
                    for us, data in zip(*(c.to_pylist() for c in batch.slice(low, BATCH).columns)):
                        parts += head(us // 1_000_000, us % 1_000_000, len(data), len(data)), data
                    out.write(b"".join(parts))
                number += batch.num_rows
        system.move(hidden, path)
        yield pa.RecordBatch.from_pydict({"path": [name], "packets": [number]})

    rows = packets.select(F.unix_micros("ts").alias("us"), "payload")
    return cut_lineage(rows.mapInArrow(run, "path string, packets bigint"))
