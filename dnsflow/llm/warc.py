"""WARC archives: writing with revisit records, a normaliser for monolithic gzip files, reading by offset.

Archives are first written as one gzip stream each, which nobody can seek in. The normaliser inflates
such a file once from start to end, writes every record as a gzip member of its own and puts a
sidecar index of offsets beside it; memory holds one chunk, however long a record is. Reading then
takes index rows in any order and inflates single members.

Files lie in the shared folder and are opened through the file system their address names. A task
writes under a name of its own attempt and renames at the end, so a lost or repeated task leaves
either a whole file or none under the final name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.llm import common

#: Payloads from this size on may be replaced by a reference to an equal one.
LEAST_REVISIT = 1000
#: Bytes before compression after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
GZIP = 31
_PAGE = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_INDEX = "archive string, position long, size long, record_type string, record_id string"


def _opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Output:
    """A file that appears under its name when it is finished."""

    def __init__(self, uri: str):
        self.files, self.path = _opened(uri)
        self.files.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.hidden = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream, self.size = self.files.open_output_stream(self.hidden, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def finish(self) -> None:
        self.stream.close()
        if self.files.get_file_info(self.path).type != pa.fs.FileType.NotFound:
            self.files.delete_file(self.path)  # left by an attempt whose task was repeated
        self.files.move(self.hidden, self.path)


def _page_urn(page_id: int | None, digest: bytes) -> str:
    return f"<{_PAGE}{page_id}>" if page_id is not None else f"<{_PAGE}none:{digest.hex()}>"


def _page_of(urn: str | None) -> int | None:
    found = urn.strip("<>").removeprefix(_PAGE) if urn else "none"
    return None if found.startswith("none") else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit of the page it refers to, which keeps the payload's digest and size."""
    digest = hashlib.sha1(payload).digest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _page_urn(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": urllib.parse.quote(url or "", safe=":/?#[]@!$&'()*+,;=%~"),
        "WARC-Payload-Digest": f"sha1:{base64.b32encode(digest).decode()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": _page_urn(refers_to, digest)}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def normalise(source: str, target: str) -> Iterator[tuple[int, int, str, str]]:
    """Rewrites a gzip file of any members as one member per record; yields position, size, type and id.

    The index is also written beside the target as lines of JSON (target + ".idx").
    """
    files, path = _opened(source)
    out, index = _Output(target), _Output(target + ".idx")
    held, left, member, began, fields = b"", 0, None, 0, {}
    inflate = zlib.decompressobj(GZIP)
    with files.open_input_stream(path, compression=None) as stream:
        while True:
            raw = stream.read(CHUNK)
            if not raw:
                break
            while True:
                part = inflate.decompress(raw, CHUNK)
                held, raw = held + part, inflate.unconsumed_tail
                if inflate.eof:
                    raw, inflate = inflate.unused_data, zlib.decompressobj(GZIP)
                # records, as far as what is held goes
                while True:
                    if member is None:
                        held = held.lstrip(b"\r\n")
                        end = held.find(b"\r\n\r\n")
                        if end < 0:
                            break
                        fields = _fields(held[:end])
                        left, began = end + 4 + int(fields["content-length"]) + 4, out.size
                        member = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    piece = held[:left]
                    out.write(member.compress(piece))
                    held, left = held[len(piece):], left - len(piece)
                    if left:
                        break
                    out.write(member.flush())
                    member = None
                    row = (began, out.size - began, fields.get("warc-type", ""), fields.get("warc-record-id", ""))
                    index.write(json.dumps(dict(zip(("position", "size", "record_type", "record_id"), row))).encode() + b"\n")
                    yield row
                if not raw and not part:
                    break
    if member is not None or held.strip(b"\r\n"):
        raise ValueError(f"{source} ends within a record")
    out.finish()
    index.finish()


def with_references(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the largest id of an equal large payload, null on that row."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload"),
    )
    narrow = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", F.sha1("payload").alias("digest"))
    shared = common.written(
        narrow.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 AND last IS NOT NULL"), "payloads"
    )
    # the join on the digest moves ids only; pages move once, by their ids
    again = narrow.join(shared, "digest").filter("page_id IS NULL OR page_id < last").select("page_id", "digest", "last").distinct()
    keyed = rows.withColumn("digest", F.sha1("payload"))
    spread = lambda df: df.withColumn("place", F.coalesce("page_id", F.xxhash64("digest")))
    on = ["place", "digest"]
    found = spread(keyed).join(spread(again).select(*on, F.col("page_id").isNull().alias("no_id"), "last").distinct(), on, "left")
    return found.select("page_id", "url", "payload", F.when(F.col("no_id") == F.col("page_id").isNull(), F.col("last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes (page_id, url, payload, refers_to) as monolithic gzip archives; returns their addresses (archive)."""

    def run(batches):
        from pyspark import TaskContext

        name, n = f"{folder}/raw/part-{TaskContext.get().partitionId():06d}", 0
        out = packer = None
        size = 0
        for batch in batches:
            for page, url, payload, refers_to in zip(*(batch[i] for i in range(4))):
                if out is None:
                    out, packer, size = _Output(f"{name}-{n:04d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, GZIP), 0
                data = record(page.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                out.write(packer.compress(data))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.write(packer.flush())
                    out.finish()
                    yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{n:04d}.warc.gz"])], ["archive"])
                    out, n = None, n + 1
        if out is not None:
            out.write(packer.flush())
            out.finish()
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}-{n:04d}.warc.gz"])], ["archive"])

    return common.written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "archive string"), "archives")


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalises every archive into the folder; returns the index: archive, position, size, record_type, record_id."""

    def run(batches):
        for batch in batches:
            for source in batch[0]:
                target = f"{folder}/members/{source.as_py().rsplit('/', 1)[1]}"
                rows = list(normalise(source.as_py(), target))
                columns = [pa.array([target] * len(rows), pa.string())]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                columns += [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["archive", "position", "size", "record_type", "record_id"])

    tasks = max(1, archives.count())  # an archive is one gzip stream: one task each
    return common.written(archives.repartition(tasks).mapInArrow(run, _INDEX), "index")


def read_records(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hexadecimal SHA-1), record_type and refers_to of every record.

    Digests of responses are computed from what was read and must equal the header's.
    """

    def run(batches):
        address = files = stream = None
        for batch in batches:
            out = []
            for archive, position, size in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist()):
                if archive != address:
                    address, (files, path) = archive, _opened(archive)
                    stream = files.open_input_file(path)
                stream.seek(position)
                data = zlib.decompress(stream.read(size), GZIP)
                end = data.index(b"\r\n\r\n") + 4
                fields = _fields(data[:end])
                block = data[end:end + int(fields["content-length"])]
                body = block.index(b"\r\n\r\n") + 4
                said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                kind = fields["warc-type"]
                if kind == "response" and hashlib.sha1(block[body:]).hexdigest() != said:
                    raise ValueError(f"{archive} at {position}: the payload differs from its digest")
                length = len(block) - body if kind == "response" else int(_fields(block[:body])["content-length"])
                out.append((_page_of(fields["warc-record-id"]), length, said, kind, _page_of(fields.get("warc-refers-to"))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return index.select("archive", "position", "size").mapInArrow(run, _FOUND)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives, normalises them and reads every record back.

    Null html is an empty payload. Of equal payloads of at least 1000 bytes the one with the largest
    id is a response and the others revisit it; rows that share that id are all responses. Rows
    without an id are revisits if an equal payload has one, responses otherwise, and come back with
    a null id. An empty table gives no archive and no rows; other columns are ignored.
    """
    folder = common.shared_path(pages.sparkSession, "warc")
    archives = write_archives(with_references(pages), folder)
    return read_records(normalise_archives(archives, folder))


def op2_warc(spark, sf_dir) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page."""
    return round_trip(common.table(spark, sf_dir, "pages"))
