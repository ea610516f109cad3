"""Reassembly of DNS over TCP on an unbounded stream of segments."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dnsflow.operators.tcp import BUFFER_LIMIT, WRAP, _frames
from dnsflow.streaming.state import use_rocksdb

CONNECTION = "opened bigint, isn0 bigint, isn1 bigint, at0 bigint, at1 bigint, rtt bigint, told boolean, " \
    "fin0 bigint, fin1 bigint, acked0 boolean, acked1 boolean"
PIECES = "side int, pos bigint, us bigint, packet_len int, data binary"
OUT = "conn string, side int, pos bigint, us bigint, len int, body binary, tcp_rtt_us bigint"
#: Connections share the state of a bucket.
STATE_BUCKETS = 1024
FIELDS = ["side", "us", "seq", "ack", "syn", "ack_flag", "fin", "rst", "data", "packet_len"]


def _signed(distance: int) -> int:
    return (distance + WRAP // 2) % WRAP - WRAP // 2


class _Connection:
    """State of one connection: handshake, next position per side, where the sides end, pieces not framed yet."""

    def __init__(self, saved, pieces):
        self.opened, self.isn, self.at, self.rtt, self.told = None, [None, None], [0, 0], None, False
        self.fin, self.acked = [None, None], [False, False]
        if saved is not None:
            self.opened, a, b, c, d, self.rtt, self.told, *rest = saved
            self.isn, self.at, self.fin, self.acked = [a, b], [c, d], rest[:2], rest[2:]
        self.pieces = ([], [])
        for side, *piece in pieces:
            self.pieces[side].append(tuple(piece))

    def saved(self):
        return (self.opened, *self.isn, *self.at, self.rtt, self.told, *self.fin, *self.acked)

    @property
    def closed(self):
        """Both sides have sent their FIN and the other has acknowledged it."""
        return all(self.acked)

    def rows(self):
        return [(side, *piece) for side in (0, 1) for piece in self.pieces[side]]

    def take(self, side, us, seq, ack, syn, ack_flag, fin, rst, data, packet_len, limit):
        """Messages completed by this segment; None when the connection ends here."""
        if syn and not ack_flag and not rst and self.isn[side] != seq:
            self.__init__(None, ())
            self.opened = us
        if self.opened is None:
            return []
        if rst:
            # Any reset that is not older than what is expected ends the connection.
            start = self.isn[side]
            old = start is not None and _signed(seq - (start + 1 + self.at[side])) < 0 and not syn
            return [] if old else None
        if syn:
            self.isn[side] = seq
        other = self.isn[1 - side]
        known = None not in self.isn
        if self.rtt is None and known and ack_flag and not syn and ack == (other + 1) % WRAP:
            self.rtt = us - self.opened
        if ack_flag and self.fin[1 - side] is not None and other is not None and ack == (other + 2 + self.fin[1 - side]) % WRAP:
            self.acked[1 - side] = True
        if self.isn[side] is None or not (len(data) or fin):
            return []
        pos, data = self.at[side] + _signed(seq - (self.isn[side] + 1 + self.at[side])), bytes(data)
        if self.fin[side] is not None:
            data = data[: max(0, self.fin[side] - pos)]
        elif fin:
            self.fin[side] = pos + len(data)
        if not data:
            return []
        self.insert(side, pos, us, packet_len, data)
        out = self.frame(side, us)
        return None if self.behind_hole(side) > limit else out

    def insert(self, side, pos, us, packet_len, data):
        """Keeps what no earlier piece covers; the first new part stands for the segment."""
        waiting = self.pieces[side]
        if pos < self.at[side]:
            data, pos = data[self.at[side] - pos :], self.at[side]
        new = []
        for start, _, _, held in waiting:
            if not data or start >= pos + len(data):
                break
            if start > pos:
                new.append((pos, data[: start - pos]))
            skip = max(0, start + len(held) - pos)
            data, pos = data[skip:], pos + skip
        if data:
            new.append((pos, data))
        for k, (start, part) in enumerate(new):
            bisect.insort(waiting, (start, us, 0 if k else packet_len, part))

    def behind_hole(self, side):
        """Pieces that wait for bytes which have not come yet."""
        waiting, end = self.pieces[side], self.at[side]
        for k, (pos, _, _, data) in enumerate(waiting):
            if pos != end:
                return len(waiting) - k
            end = pos + len(data)
        return 0

    def frame(self, side, us):
        waiting, stream, ends, first = self.pieces[side], b"", [], self.at[side]
        for pos, _, _, data in waiting:
            if pos != first + len(stream):
                break
            stream += data
            ends.append(len(stream))
        out = []
        for f in _frames(stream, ends):
            used = waiting[f["first"] : f["last"] + 1]
            told = self.told or self.rtt is None
            body = stream[f["start"] + 2 : f["start"] + 2 + f["size"]]
            out.append((side, first + f["start"], us, sum(p[2] for p in used), body, -1 if told else self.rtt))
            self.told = self.told or self.rtt is not None
            self.at[side] = first + f["start"] + 2 + f["size"]
        edge = self.at[side]
        self.pieces[side][:] = [
            (max(p, edge), t, size, data[max(edge - p, 0):])
            for p, t, size, data in waiting if p + len(data) > edge
        ]
        return out


class _Reassembly(StatefulProcessor):
    """All connections of a bucket, each with the time of its last segment."""

    def __init__(self, timeout_ms: int, limit: int):
        self.timeout_ms, self.limit = timeout_ms, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.connections = handle.getListState("connections", f"conn string, last bigint, {CONNECTION}")
        self.waiting = handle.getListState("pieces", f"conn string, {PIECES}")

    def handleInputRows(self, key, rows, timerValues):
        pieces: dict[str, list] = {}
        for conn, *piece in self.waiting.get():
            pieces.setdefault(conn, []).append(piece)
        held, last = {}, {}
        for conn, us, *saved in self.connections.get():
            held[conn], last[conn] = _Connection(saved, pieces.get(conn, ())), us
        arrived, out = pd.concat(rows).sort_values(["us", "seg_no"]), []
        for conn, *row in arrived[["conn", *FIELDS]].itertuples(index=False, name=None):
            state = held.get(conn)
            if state is None or row[1] - last[conn] >= self.timeout_ms * 1000:
                state = held[conn] = _Connection(None, ())
            last[conn] = row[1]
            done = state.take(*row, self.limit)
            out += [(conn, *m) for m in done or ()]
            if done is None or state.closed:
                del held[conn]
        self._keep(held, last, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["conn", "side", "pos", "us", "len", "body", "tcp_rtt_us"])

    def _keep(self, held, last, watermark_ms) -> None:
        """Stores the open connections that are not idle; the bucket goes when the last of them would."""
        ends = {c: int(last[c]) // 1000 + self.timeout_ms for c, state in held.items() if state.opened is not None}
        kept = {c: held[c] for c, end in ends.items() if end > watermark_ms}
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        connections = [
            (c, int(last[c]), *(v if v is None or isinstance(v, bool) else int(v) for v in state.saved())) for c, state in kept.items()
        ]
        pieces = [(c, s, int(p), int(t), int(n), d) for c, state in kept.items() for s, p, t, n, d in state.rows()]
        self.connections.put(connections) if connections else self.connections.clear()
        self.waiting.put(pieces) if pieces else self.waiting.clear()
        if kept:
            self.handle.registerTimer(max(ends[c] for c in kept))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.connections.clear()
        self.waiting.clear()
        yield pd.DataFrame([], columns=["conn", "side", "pos", "us", "len", "body", "tcp_rtt_us"])

    def close(self) -> None:
        pass


def stream_tcp_reassembly(
    segments: DataFrame, timeout_ms: int = 60_000, buffer_limit: int = BUFFER_LIMIT,
    delay: str = "10 seconds",
) -> DataFrame:
    """Messages like `reassemble`, for streaming segments; a connection idle for the timeout is dropped.

    State per connection is bounded: at most `buffer_limit` waiting pieces per side. It is kept per bucket of connections,
    so a micro-batch reads and writes one state per bucket.
    """
    use_rocksdb(segments.sparkSession)
    rows = segments.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("conn"), F.lit(STATE_BUCKETS)).cast("int").alias("bucket"),
        "conn", "ts", "seg_no", F.unix_micros("ts").alias("us"), *[c for c in FIELDS if c != "us"]
    )
    return rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Reassembly(timeout_ms, buffer_limit), outputStructType=OUT,
        outputMode="Append", timeMode="EventTime",
    )
