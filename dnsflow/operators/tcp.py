"""DNS over TCP: connections, byte order, message framing.

All steps are table operations ordered by arrival or by stream position. Connections of
ordinary size are handled by windows per connection; crowded ones (see `plans.skew`) run
the same steps in chunks of time or position, so no task ever holds a whole connection.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsflow.functions.binding import stage
from dnsflow.operators.decode import decode_dns
from dnsflow.plans.prefix import with_prefix
from dnsflow.plans.skew import SkewPolicy, cut_lineage, split_hot

WRAP = 1 << 32
CHUNK_BYTES = 1 << 20
BUFFER_LIMIT = 100
#: Segments that one task of the windows by connection takes: each of a chain of sorts holds them.
ROWS_PER_TASK = 100_000
ARRIVAL = ["us", "seg_no"]
STREAM = ["conn", "session", "side"]
# Header fields a message takes over from its segments, where the input has them.
HEADER = ["src_ip", "dst_ip", "src_port", "dst_port", "ttl", "ipv", "prot"]


def _header(df: DataFrame) -> list[str]:
    return [c for c in HEADER if c in df.columns]


def _timed(segments: DataFrame) -> DataFrame:
    return segments.withColumn("us", F.unix_micros("ts"))


def _ahead(seq: Column, start: Column) -> Column:
    """Signed distance of two wrapping sequence numbers."""
    return F.pmod(seq - start + (WRAP >> 1), F.lit(WRAP)) - (WRAP >> 1)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over as many tasks as their number asks for, so that a task's share does not grow with the input."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks, *keys)


def with_sessions(segments: DataFrame, timeout_ms: int = 60_000, chunk: str | None = None) -> DataFrame:
    """Numbers the connections of an address pair.

    A new one starts after `timeout_ms` of silence or with a SYN that is not the repetition
    of the last one from that side.
    """
    if chunk is None:
        segments = _dealt(segments, "conn")
    opening = F.col("syn") & ~F.col("ack_flag") & ~F.col("rst")
    seen = with_prefix(_timed(segments), ["conn"], ARRIVAL, {
        "before_us": ("last", F.col("us")),
        "open0": ("last", F.when(opening & (F.col("side") == 0), F.col("seq"))),
        "open1": ("last", F.when(opening & (F.col("side") == 1), F.col("seq"))),
    }, chunk)
    last_open = F.when(F.col("side") == 0, F.col("open0")).otherwise(F.col("open1"))
    fresh = opening & ~last_open.eqNullSafe(F.col("seq"))
    silent = F.col("us") - F.col("before_us") >= timeout_ms * 1000
    starts = seen.withColumn("starts", (fresh | silent | F.col("before_us").isNull()).cast("bigint"))
    numbered = with_prefix(starts, ["conn"], ARRIVAL, {"session": ("sum", F.col("starts"))}, chunk)
    return numbered.withColumn("session", F.col("session") + F.col("starts")).drop(
        "before_us", "open0", "open1", "starts"
    )


def with_state(sessions: DataFrame, chunk: str | None = None) -> DataFrame:
    """Segments of connections whose SYN was seen and that are neither reset nor closed yet.

    Adds the first sequence numbers of both sides known so far, the opening time, whether this
    segment completes the handshake (`completes`), the handshake time once it is known, the `room` that
    is left in front of the side's own FIN (null before it) and whether the FIN of either side was sent
    and acknowledged up to here. A connection is closed when both are acknowledged.
    """
    def syn_of(side: int) -> Column:
        return F.when(F.col("syn") & (F.col("side") == side), F.col("seq"))

    opening = F.col("syn") & ~F.col("ack_flag") & ~F.col("rst")
    known = with_prefix(sessions, ["conn", "session"], ARRIVAL, {
        "isn0": ("last", syn_of(0)), "isn1": ("last", syn_of(1)),
        "late": ("max", F.when(~opening, -F.col("us"))),
        "opened": ("max", F.when(opening, -F.col("us"))),
    }, chunk)
    # The first segment of a connection must be its SYN: nothing came before the first opening.
    valid = (opening & F.col("late").isNull()) | (
        F.col("opened").isNotNull() & (F.col("late").isNull() | (F.col("opened") >= F.col("late")))
    )
    other = F.when(F.col("side") == 0, F.col("isn1")).otherwise(F.col("isn0"))
    answers = ~F.col("syn") & F.col("ack_flag") & ~F.col("rst") & F.coalesce(
        F.col("ack") == F.pmod(other + 1, F.lit(WRAP)), F.lit(False)
    ) & F.col("isn0").isNotNull() & F.col("isn1").isNotNull()
    opened = stage(known.filter(valid), {
        "opened_us": F.coalesce(-F.col("opened"), F.col("us")), "answers": answers,
    }).drop("late", "opened")
    # Where the last segment of either side ended: a reset older than that is ignored.
    length = F.octet_length("data") + (F.col("syn") | F.col("fin")).cast("int")
    after = F.pmod(F.col("seq") + length, F.lit(WRAP))
    # The first FIN of a side ends its data.
    finished = F.struct((-F.col("us")).alias("us"), (-F.col("seg_no")).alias("seg_no"), after.alias("after"))
    ends = with_prefix(opened, ["conn", "session"], ARRIVAL, {
        f"end{side}": ("last", F.when((F.col("side") == side) & ~F.col("rst"), after)) for side in (0, 1)
    } | {
        f"fin{side}": ("max", F.when((F.col("side") == side) & F.col("fin") & ~F.col("rst"), finished)) for side in (0, 1)
    }, chunk)
    of = lambda side, what: F.when(F.col("side") == side, F.col(f"{what}0")).otherwise(F.col(f"{what}1"))
    expected = of(0, "end")
    resets = F.col("rst") & (expected.isNull() | (_ahead(F.col("seq"), expected) >= 0))
    answered = F.col("ack_flag") & ~F.col("rst") & (F.col("ack") == of(1, "fin")["after"])
    known_ends = stage(ends, {
        "resets_now": resets, "answered": F.coalesce(answered, F.lit(False)),
        "room": -_ahead(F.col("seq"), F.pmod(of(0, "fin")["after"] - 1, F.lit(WRAP))),
    })
    reached = with_prefix(known_ends.drop("end0", "end1", "fin0", "fin1"), ["conn", "session"], ARRIVAL, {
        "done": ("max", F.when(F.col("answers"), -F.col("us"))),
        "resets": ("max", F.col("resets_now").cast("int")),
        "acked0": ("max", (F.col("answered") & (F.col("side") == 1)).cast("int")),
        "acked1": ("max", (F.col("answered") & (F.col("side") == 0)).cast("int")),
    }, chunk).drop("resets_now")
    completes = F.col("answers") & F.col("done").isNull()
    done_us = F.when(completes, F.col("us")).otherwise(-F.col("done"))
    closed = (F.coalesce("acked0", F.lit(0)) == 1) & (F.coalesce("acked1", F.lit(0)) == 1)
    return stage(reached.filter((F.coalesce("resets", F.lit(0)) == 0) & ~closed), {
        "completes": completes, "rtt_us": done_us - F.col("opened_us"),
    }).drop("answers", "done", "resets", "acked0", "acked1")


def _last_state() -> Column:
    """The state that all segments of a connection lead to."""
    fins = F.count_distinct(F.when(F.col("fin") & ~F.col("rst"), F.col("side")))
    acked = F.count_distinct(F.when(F.col("answered"), F.col("side")))
    return (
        F.when(F.bool_or("rst") | (acked == 2), "CLOSED").when((fins == 2) & (acked == 1), "FIN2").when(fins == 2, "FIN1_FIN2")
        .when((fins == 1) & (acked == 1), "FIN1_ACK").when(fins == 1, "FIN1").when(F.max("rtt_us").isNotNull(), "ESTABLISHED")
        .when(F.bool_or(F.col("syn") & (F.col("side") == 1)), "SYN_ACK").otherwise("SYN")
    )


def tcp_connections(segments: DataFrame, timeout_ms: int = 60_000,
                    skew: SkewPolicy = SkewPolicy()) -> DataFrame:
    """One row per connection: times, segments and bytes per side, handshake time, how it ended."""
    out = None
    for part, chunk in _parts(segments, skew):
        rows = with_state(with_sessions(part, timeout_ms, chunk), chunk)
        size = F.octet_length("data")
        table = rows.groupBy("conn", "session").agg(
            F.min("us").alias("first_us"), F.max("us").alias("last_us"),
            F.count_if(F.col("side") == 0).alias("from_client"),
            F.count_if(F.col("side") == 1).alias("from_server"),
            F.sum(size).alias("bytes"),
            F.max("rtt_us").alias("handshake_us"),
            F.bool_or("rst").alias("reset"),
            _last_state().alias("state"),
        )
        out = table if out is None else out.unionByName(table)
    return out


def handshakes(rows: DataFrame) -> DataFrame:
    """Round trip from SYN to the completing ACK, one row per established connection."""
    return rows.filter("completes").select("conn", "session", "us", "rtt_us")


def ordered_bytes(rows: DataFrame, chunk: str | None = None) -> DataFrame:
    """Data segments at their stream position, repetitions dropped, with the unbroken prefix marked.

    `pos` is the position in the stream (sequence numbers may wrap many times), `whole` is
    false from the first hole on, `released_us` is when everything up to here had arrived.
    """
    isn = F.when(F.col("side") == 0, F.col("isn0")).otherwise(F.col("isn1"))
    # Nothing comes after the side's own FIN.
    data = stage(rows.filter((F.octet_length("data") > 0) & (F.col("room").isNull() | (F.col("room") > 0))), {
        "isn": isn, "data": F.when(F.col("room") < F.octet_length("data"), F.substring("data", F.lit(1), F.col("room").cast("int"))).otherwise(F.col("data")),
    }).filter("isn is not null")
    seen = with_prefix(data, STREAM, ARRIVAL, {"before_seq": ("last", F.col("seq"))}, chunk)
    step = _ahead(F.col("seq"), F.coalesce("before_seq", F.pmod(F.col("isn") + 1, F.lit(WRAP))))
    moved = with_prefix(seen.withColumn("step", step), STREAM, ARRIVAL, {"pos": ("sum", F.col("step"))}, chunk)
    kept = ["us", "seg_no", "packet_len", "rtt_us", "data", *_header(rows)]
    # One row per position: the segment that came first. Positions are spread over all tasks.
    unique = (
        moved.withColumn("pos", F.col("pos") + F.col("step"))
        .groupBy(*STREAM, "pos")
        .agg(F.min(F.struct(*kept)).alias("seg"))
        .select(*STREAM, "pos", "seg.*")
        .filter("pos >= 0")
        .withColumn("__part", F.floor(F.col("pos") / CHUNK_BYTES).cast("bigint"))
    )
    by_pos = "__part" if chunk else None
    end = F.col("pos") + F.octet_length("data")
    reach = with_prefix(unique, STREAM, ["pos"], {
        "reach": ("max", end), "before": ("max", F.col("us")), "known": ("max", F.col("rtt_us")),
    }, by_pos)
    fresh = stage(reach, {
        "hole": (F.col("pos") > F.coalesce("reach", F.lit(0))).cast("int"),
        "skip": F.greatest(F.coalesce("reach", F.lit(0)) - F.col("pos"), F.lit(0)).cast("int"),
        "released_us": F.greatest("us", "before"),
        "rtt_us": F.greatest("rtt_us", "known"),
    })
    marked = with_prefix(fresh, STREAM, ["pos"], {"holes": ("max", F.col("hole"))}, by_pos)
    trimmed = stage(marked, {
        "whole": (F.col("hole") == 0) & (F.coalesce("holes", F.lit(0)) == 0),
        "data": F.substring("data", F.col("skip") + 1, F.octet_length("data")),
        "pos": F.col("pos") + F.col("skip"),
    })
    return trimmed.filter(F.octet_length("data") > 0).drop("reach", "before", "known", "hole", "holes", "skip")


def overflow_times(pieces: DataFrame, limit: int = BUFFER_LIMIT, chunk: str | None = None) -> DataFrame:
    """When a side first holds more than `limit` segments that still wait for earlier ones."""
    waiting = pieces.filter(~F.col("whole") | (F.col("released_us") > F.col("us")))
    steps = waiting.select(
        *STREAM, "seg_no",
        F.inline(F.array_compact(F.array(
            F.struct(F.col("us").alias("us"), F.lit(1).alias("change")),
            F.when(F.col("whole"), F.struct(F.col("released_us").alias("us"), F.lit(-1).alias("change"))),
        ))),
    ).withColumn("__part", F.floor(F.col("us") / 60_000_000).cast("bigint"))
    held = with_prefix(
        steps, STREAM, ["us", "change", "seg_no"], {"held": ("sum", F.col("change"))},
        "__part" if chunk else None,
    )
    over = held.filter(F.col("held") + F.col("change") > limit)
    return over.groupBy("conn", "session").agg(F.min("us").alias("overflow_us"))


#: A message with its length prefix is no longer than this.
LONGEST = (1 << 16) + 1
FOUND = "array<struct<start:bigint,body:binary,first:int,last:int>>"
_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("body", pa.binary()), ("first", pa.int32()), ("last", pa.int32())]))


def _frames(stream: bytes, ends: list[int], at: int = 0, stop: int | None = None) -> list[dict]:
    """Whole messages of a stream that start from `at` on and before `stop`: start, size, and the pieces (given by their ends) they span."""
    out = []
    while at + 2 <= len(stream) and (stop is None or at < stop):
        size = int.from_bytes(stream[at : at + 2], "big")
        close = at + 2 + size
        if close > len(stream):
            break
        out.append({
            "start": at, "size": size,
            "first": bisect.bisect_right(ends, at), "last": bisect.bisect_left(ends, close),
        })
        at = close
    return out


def _joined(parts: pa.ListScalar) -> tuple[bytes, list[int]]:
    """The bytes of all pieces and where each of them ends."""
    held = parts.as_py()
    return b"".join(held), np.cumsum([len(x) for x in held]).tolist()


def _found_udf(width: int | None = None):
    """Messages in the pieces of a group: all from `entry` on, or those that start in the group's chunk of this width."""
    @F.arrow_udf(FOUND)
    def found(parts: pa.Array, base: pa.Array, chunk: pa.Array, entry: pa.Array) -> pa.Array:
        out = []
        for held, low, number, first in zip(parts, base.to_pylist(), chunk.to_pylist(), entry.to_pylist()):
            stream, ends = _joined(held)
            start = 0 if width is None else number * width - low
            frames = [] if first < 0 else _frames(stream, ends, start + first, None if width is None else start + width)
            out.append([
                {"start": low + f["start"], "body": stream[f["start"] + 2 : f["start"] + 2 + f["size"]], "first": f["first"], "last": f["last"]}
                for f in frames
            ])
        return pa.array(out, type=_FOUND)

    return found


def exits(stream: bytes, width: int) -> np.ndarray:
    """For every offset at which a message may start, counted from the start of a chunk, where the first one after the chunk starts.

    Both are counted from the start of their chunk; -1 where the stream ends first. Pointers to the next start
    are squared until all have left the chunk.
    """
    n = len(stream)
    head = np.frombuffer(stream[: width + 1], dtype=np.uint8).astype(np.int64)
    size = max(width, LONGEST) + LONGEST + 1
    jump = np.arange(size + 1)  # the last stands for the end of the stream
    inside = min(width, n)
    jump[inside:width] = size
    known = max(0, min(inside, len(head) - 1))
    jump[known:inside] = size
    after = np.arange(known) + 2 + head[:known] * 256 + head[1 : known + 1]
    jump[:known] = np.where(after <= n, after, size)
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    first = jump[:LONGEST]
    return np.where(first == size, -1, first - width).astype(np.int32)


def _packed(offsets: np.ndarray) -> bytes:
    return zlib.compress(offsets.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=np.int32)


_REACHED = pa.struct([("offsets", pa.binary()), ("exit", pa.int32())])


def _exits_udf(width: int):
    @F.arrow_udf("struct<offsets:binary,exit:int>")
    def reached(parts: pa.Array, base: pa.Array, chunk: pa.Array) -> pa.Array:
        out = []
        for held, low, number in zip(parts, base.to_pylist(), chunk.to_pylist()):
            offsets = exits(_joined(held)[0][number * width - low :], width)
            out.append({"offsets": None, "exit": int(offsets[0])} if number == 0 else {"offsets": _packed(offsets), "exit": None})
        return pa.array(out, type=_REACHED)

    return reached


def _composed_udf():
    @F.arrow_udf("struct<offsets:binary,exit:int>")
    def composed(offsets: pa.Array, before: pa.Array, exit_before: pa.Array) -> pa.Array:
        out = []
        for own, other, start in zip(offsets.to_pylist(), before.to_pylist(), exit_before.to_pylist()):
            after = _unpacked(own)
            if start is not None:
                out.append({"offsets": None, "exit": -1 if start < 0 else int(after[start])})
            else:
                first = _unpacked(other)
                out.append({"offsets": _packed(np.where(first < 0, -1, after[first]).astype(np.int32)), "exit": None})
        return pa.array(out, type=_REACHED)

    return composed


def _composed(reached: DataFrame, distance: int) -> DataFrame:
    """Every chunk's offsets behind those of the chunk `distance` before it; known exits stay."""
    on = [*STREAM, "chunk"]
    before = reached.select(
        *STREAM, (F.col("chunk") + distance).alias("chunk"), F.col("offsets").alias("before"), F.col("exit").alias("exit_before")
    )
    met = reached.filter("exit IS NULL").join(before, on)
    made = met.select(*on, _composed_udf()("offsets", "before", "exit_before").alias("r")).select(*on, "r.*")
    return cut_lineage(reached.filter("exit IS NOT NULL").unionByName(made))


def _entries(reached: DataFrame) -> DataFrame:
    """(stream, chunk, entry): where the first message of every chunk starts.

    The distance doubles with every round, so n chunks are settled in log2(n) rounds.
    """
    last = reached.agg(F.max("chunk")).first()[0] or 0
    for turn in range(last.bit_length()):
        reached = _composed(reached, 1 << turn)
    return reached.select(*STREAM, (F.col("chunk") + 1).alias("chunk"), F.col("exit").alias("entry"))


PIECE = ["us", "seg_no", "packet_len", "released_us", "rtt_us"]


def _piece(df: DataFrame) -> Column:
    return F.struct("pos", "data", *PIECE, *_header(df))


def _grouped(pieces: DataFrame, keys: list[str]) -> DataFrame:
    rows = pieces.filter("whole").select(*keys, _piece(pieces).alias("piece")).repartition(*keys)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("pieces"))


def _messages(groups: DataFrame, chunk: Column, entry: Column, width: int | None = None) -> DataFrame:
    """The messages of groups of pieces; a message takes its fields from the piece that completes it."""
    fields = groups.schema["pieces"].dataType.elementType.names
    found = _found_udf(width)(F.transform("pieces", lambda p: p["data"]), F.get("pieces", F.lit(0))["pos"], chunk, entry)
    light = F.transform("pieces", lambda p: F.struct(*[p[c].alias(c) for c in fields if c != "data"]))
    rows = groups.select(*STREAM, light.alias("pieces"), found.alias("found"))

    def message(f: Column) -> Column:
        last = F.get("pieces", f["last"])
        used = F.slice("pieces", f["first"] + 1, f["last"] - f["first"] + 1)
        return F.struct(
            f["start"].alias("pos"), f["body"].alias("body"), last["released_us"].alias("us"), last["seg_no"].alias("seg_no"),
            last["rtt_us"].alias("rtt_us"), *[last[c].alias(c) for c in HEADER if c in fields],
            F.aggregate(used, F.lit(0), lambda a, p: a + p["packet_len"]).alias("len"),
        )

    return rows.select(*STREAM, F.inline(F.transform("found", message)))


def frame_messages(pieces: DataFrame, chunked: bool = False) -> DataFrame:
    """Length-prefixed messages of every stream: (stream key, pos, body, us, seg_no, len).

    `len` adds up the packets that contributed, `us` is when the last missing byte came. In chunks, a group holds the
    bytes of a chunk and as many behind it as a message may take. Where a chunk's first message starts depends on
    all chunks before, so each chunk gives the offset at which it is left for every offset at which it may
    be entered, and these are composed.
    """
    if not chunked:
        return _messages(_grouped(pieces, STREAM), F.lit(0), F.lit(0))
    width = CHUNK_BYTES
    end = F.col("pos") + F.octet_length("data")
    low = F.greatest(F.floor((F.col("pos") - LONGEST) / width), F.lit(0))
    high = F.floor((end - 1) / width)
    parts = pieces.filter("whole").withColumn("chunk", F.explode(F.sequence(low.cast("bigint"), high.cast("bigint"))))
    groups = cut_lineage(_grouped(parts, [*STREAM, "chunk"]))
    base = F.get("pieces", F.lit(0))["pos"]
    reached = groups.select(*STREAM, "chunk", _exits_udf(width)(F.transform("pieces", lambda p: p["data"]), base, "chunk").alias("r"))
    entries = _entries(cut_lineage(reached.select(*STREAM, "chunk", "r.*")))
    entered = groups.join(entries, [*STREAM, "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
    return _messages(entered, F.col("chunk"), F.col("entry"), width)


def _parts(segments: DataFrame, skew: SkewPolicy):
    """(segments, chunk column or None) of ordinary and of crowded connections."""
    cold, hot = split_hot(segments, ["conn"], F.unix_micros("ts"), 1_000_000, skew)
    yield cold, None
    if hot is not None:
        yield cut_lineage(hot.drop("chunk_us")), "chunk"


def reassemble(
    segments: DataFrame,
    timeout_ms: int = 60_000,
    buffer_limit: int = BUFFER_LIMIT,
    skew: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """DNS messages of all connections.

    The handshake time goes to the first message of a connection only. A connection that
    holds more than `buffer_limit` waiting segments is given up: later messages are lost.
    """
    out = None
    for part, chunk in _parts(segments, skew):
        rows = with_state(with_sessions(part, timeout_ms, chunk), chunk)
        if chunk:
            rows = cut_lineage(rows)
        # Framing and the buffer limit both read the pieces.
        pieces = cut_lineage(ordered_bytes(rows, chunk))
        found = frame_messages(pieces, chunked=chunk is not None)
        over = overflow_times(pieces, buffer_limit, chunk)
        kept = found.join(over, ["conn", "session"], "left").filter(
            F.col("overflow_us").isNull() | (F.col("us") < F.col("overflow_us"))
        ).drop("overflow_us")
        # The first message after the handshake, found by aggregation, one row per connection.
        at = F.struct("us", "seg_no", "side", "pos", "rtt_us")
        first = (
            kept.filter("rtt_us is not null").groupBy("conn", "session").agg(F.min(at).alias("at"))
            .select("conn", "session", "at.side", "at.pos", F.col("at.rtt_us").alias("tcp_rtt_us"))
        )
        timed = kept.drop("rtt_us").join(first, [*STREAM, "pos"], "left").withColumn(
            "tcp_rtt_us", F.coalesce("tcp_rtt_us", F.lit(-1).cast("bigint"))
        )
        out = timed if out is None else out.unionByName(timed)
    return out


def repeated_segments(rows: DataFrame) -> DataFrame:
    """Data segments that repeat a sequence number of their side, by number of copies."""
    data = rows.filter(F.octet_length("data") > 0)
    return data.groupBy("conn", "session", "side", "seq").agg(
        F.count("*").alias("copies"), F.min(F.struct(*ARRIVAL)).alias("kept")
    ).filter("copies > 1")


def decode_tcp(segments: DataFrame, with_rrs: bool = False, **options) -> DataFrame:
    """Reassembled messages decoded; needs segments with the header fields.

    The number of a message is its segment's number and the end of the message in the stream:
    messages that end in one segment end less than 2^16 bytes apart.
    """
    found = reassemble(segments, **options)
    return decode_dns(
        found.withColumns({
            "error": F.lit(None).cast("string"), "ts": F.timestamp_micros("us"),
            "packet_no": F.col("seg_no") * 65536 + F.pmod(F.col("pos") + F.octet_length("body"), F.lit(65536)),
            "udp_sum": F.lit(0),
        }),
        with_rrs,
    )
