"""Query-response matching on an unbounded stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from dnsflow.operators.match import (
    FLOW_KEY, FROM_QUERY, FROM_RESPONSE, merge_projection, with_flow_key,
)
from dnsflow.schema import QTYPE_AXFR
from dnsflow.streaming.state import use_rocksdb

WAITING = "k string, t bigint, m bigint, is_response boolean, payload string"
OUT = "query string, response string"
SUMS = ("sum_len", "sum_dns_len", "sum_ancount")
ENTRIES = "k string, t bigint, query string, response string, " + ", ".join(f"{s} bigint" for s in SUMS)
# Keeps the microseconds of timestamps inside JSON.
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
# Keys share the state of a bucket, so a micro-batch reads and writes one state per bucket
# instead of one per key.
STATE_BUCKETS = 256


# Rows that are taken or given back at once.
PIECE = 4096


def _in_turn(arrived: pd.DataFrame) -> Iterator[tuple]:
    """(k, t, m, is_response, payload) of the rows; a payload is let go with its piece, so that only what waits is kept."""
    columns = [arrived.pop(c).to_numpy() for c in ("k", "t", "m", "is_response", "payload")]
    for low in range(0, len(columns[0]), PIECE):
        piece = [c[low : low + PIECE].tolist() for c in columns]
        for c in (columns[0], columns[-1]):
            c[low : low + PIECE] = None
        yield from zip(*piece)


class _Pending(StatefulProcessor):
    """Messages that wait for a partner, for all keys of a bucket."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues):
        held: dict[str, deque] = {}
        for k, *message in self.waiting.get():
            held.setdefault(k, deque()).append(tuple(message))
        arrived = pd.concat(rows).sort_values(["t", "m"], ignore_index=True)
        pairs = []
        for k, *row in _in_turn(arrived):
            waiting = held.setdefault(k, deque())
            while waiting and waiting[0][0] + self.timeout_us <= row[0]:
                waiting.popleft()
            if waiting and waiting[0][2] != row[2]:
                other = waiting.popleft()
                pairs.append((row[3], other[3]) if other[2] else (other[3], row[3]))
                if not waiting:
                    del held[k]
            else:
                waiting.append(tuple(row))
            if len(pairs) == PIECE:
                yield pd.DataFrame(pairs, columns=["query", "response"])
                pairs = []
        self._keep(held, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(pairs, columns=["query", "response"])

    def _keep(self, held, watermark_ms) -> None:
        """Stores what may still find a partner: no message older than the watermark will come."""
        left = [
            (k, int(t), int(m), bool(r), p) for k, waiting in held.items() for t, m, r, p in waiting
            if (t + self.timeout_us) // 1000 + 1 > watermark_ms
        ]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if left:
            self.waiting.put(left)
            self.handle.registerTimer((max(x[1] for x in left) + self.timeout_us) // 1000 + 1)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.waiting.clear()
        yield pd.DataFrame([], columns=["query", "response"])

    def close(self) -> None:
        pass


class _Outcomes(StatefulProcessor):
    """Pairs, and the messages that will not be in any: late ones, and those that waited too long.

    Late is what comes `delay_us` or more behind the youngest message that the bucket had seen before; the operator
    keeps this mark itself, as Spark would drop late rows without a trace.
    """

    def __init__(self, timeout_us: int, delay_us: int):
        self.timeout_us, self.delay_us = timeout_us, delay_us

    def init(self, handle) -> None:
        self.waiting = handle.getListState("waiting", WAITING)
        self.mark = handle.getValueState("mark", "t bigint")

    def handleInputRows(self, key, rows, timerValues):
        held: dict[str, deque] = {}
        for k, *message in self.waiting.get():
            held.setdefault(k, deque()).append(tuple(message))
        mark = self.mark.get()[0] if self.mark.exists() else None
        limit = None if mark is None else mark - self.delay_us
        arrived, out = pd.concat(rows).sort_values(["t", "m"]), []

        def alone(kind, message):
            out.append((kind, None, message[3]) if message[2] else (kind, message[3], None))

        for k, *row in arrived[["k", "t", "m", "is_response", "payload"]].itertuples(index=False, name=None):
            if limit is not None and row[0] <= limit:
                alone("late", row)
                continue
            waiting = held.setdefault(k, deque())
            while waiting and waiting[0][0] + self.timeout_us <= row[0]:
                alone("expired", waiting.popleft())
            if waiting and waiting[0][2] != row[2]:
                other = waiting.popleft()
                out.append(("pair", row[3], other[3]) if other[2] else ("pair", other[3], row[3]))
            else:
                waiting.append(tuple(row))
        mark = int(arrived["t"].max()) if mark is None else max(mark, int(arrived["t"].max()))
        left = []
        for k, waiting in held.items():
            for message in waiting:
                if message[0] + self.timeout_us <= mark - self.delay_us:
                    alone("expired", message)
                else:
                    left.append((k, int(message[0]), int(message[1]), bool(message[2]), message[3]))
        self.mark.update((mark,))
        self.waiting.put(left) if left else self.waiting.clear()
        yield pd.DataFrame(out, columns=["kind", "query", "response"])

    def close(self) -> None:
        pass


class _Transfers(StatefulProcessor):
    """Zone transfers of a bucket: entries that add up responses, each of which renews the entry's age."""

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ENTRIES)

    def handleInputRows(self, key, rows, timerValues):
        held: dict[str, list] = {}
        for k, *entry in self.open.get():
            held.setdefault(k, []).append(list(entry))
        arrived, done = pd.concat(rows).sort_values(["t", "m"]), []
        for k, t, is_response, last, payload, *sums in arrived[["k", "t", "is_response", "last", "payload", *SUMS]].itertuples(index=False, name=None):
            alive = [e for e in held.get(k, []) if e[0] + self.timeout_us > t]
            own = [t, None, payload, *sums] if is_response else [t, payload, None, 0, 0, 0]
            gate = alive[0] if alive else None
            if gate is None or is_response == (gate[1] is None):
                alive.append(own)
            elif not is_response:
                gate[:2] = [t, payload]
            else:
                gate[0], gate[2] = t, payload if gate[2] is None else gate[2]
                gate[3:] = [a + b for a, b in zip(gate[3:], sums)]
                if last:
                    done.append(alive.pop(0)[1:])
            held[k] = alive
        watermark = timerValues.getCurrentWatermarkInMs()
        left = [
            (k, int(e[0]), e[1], e[2], *map(int, e[3:])) for k, entries in held.items() for e in entries
            if (e[0] + self.timeout_us) // 1000 + 1 > watermark
        ]
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if left:
            self.open.put(left)
            self.handle.registerTimer((max(e[1] for e in left) + self.timeout_us) // 1000 + 1)
        else:
            self.open.clear()
        yield pd.DataFrame(done, columns=["query", "response", *SUMS])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.open.clear()
        yield pd.DataFrame([], columns=["query", "response", *SUMS])

    def close(self) -> None:
        pass


def _bucketed(messages: DataFrame, keys: list[str], *more: Column) -> tuple[DataFrame, list[str]]:
    """Messages with their bucket, key and payload as text, and the columns that payloads hold: those that a pair takes from that side."""
    sides = [dict.fromkeys(["id", "prot", "ipv", "qtype", *[c for c in side.values() if c in messages.columns]]) for side in (FROM_QUERY, FROM_RESPONSE)]
    query, response = (F.to_json(F.struct(*side), JSON_TIME) for side in sides)
    return with_flow_key(messages).select(
        F.pmod(F.xxhash64(*keys), F.lit(STATE_BUCKETS)).cast("int").alias("bucket"),
        F.to_json(F.struct(*keys)).alias("k"), "ts", F.unix_micros("ts").alias("t"), F.col("msg_id").alias("m"), "is_response",
        F.when(F.col("is_response"), response).otherwise(query).alias("payload"), *more,
    ), list(sides[0] | sides[1])


def _picked(found: DataFrame, messages: DataFrame, kept: list[str], *more: str) -> DataFrame:
    """The columns of a pair from the payloads of its query and response."""
    schema = messages.select(*kept).schema
    both = found.select(
        F.from_json("query", schema, JSON_TIME).alias("q"), F.from_json("response", schema, JSON_TIME).alias("r"), *more,
    )
    picked = [F.coalesce(F.col(f"q.{c}"), F.col(f"r.{c}")).alias(c) for c in ("id", "prot", "ipv", "qtype")]
    for side, mapping in (("q", FROM_QUERY), ("r", FROM_RESPONSE)):
        picked += [F.col(f"{side}.{src}").alias(dst) for dst, src in mapping.items() if src in kept]
    return both.select(*picked, *more)


def stream_match_transfers(messages: DataFrame, timeout_ms: int = 1000, delay: str = "10 seconds") -> DataFrame:
    """Completed zone transfers like `match_transfers`, for a streaming `messages`.

    Sizes and answer counts of all responses are added up in the state; an entry lives until the watermark passes
    the timeout of the last message it accepted.
    """
    use_rocksdb(messages.sparkSession)
    fresh = messages.withWatermark("ts", delay).filter(F.col("qtype") == QTYPE_AXFR)
    sizes = [F.col(c).cast("bigint").alias(s) for c, s in zip(("len", "dns_len", "ancount"), SUMS)]
    keyed, kept = _bucketed(fresh, FLOW_KEY, F.coalesce("last_soa", F.lit(False)).alias("last"), *sizes)
    found = keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Transfers(timeout_ms * 1000), outputStructType=f"{OUT}, " + ", ".join(f"{s} bigint" for s in SUMS),
        outputMode="Append", timeMode="EventTime",
    )
    rows = _picked(found, messages, kept, *SUMS)
    totals = {c: F.col(s).cast(rows.schema[c].dataType) for c, s in zip(("res_len", "res_dns_len", "ancount"), SUMS) if c in rows.columns}
    return merge_projection(rows.withColumns(totals).drop(*SUMS))


def stream_outcomes(messages: DataFrame, timeout_ms: int = 1000, delay_ms: int = 10_000, match_qname: bool = False) -> DataFrame:
    """Every ordinary message of a stream by what became of it: `kind` is pair, late or expired.

    Pairs have the columns of both sides, late and expired messages those of their own side. Messages still waiting
    are in none. `flows.split_sinks` writes the kinds to targets of their own.
    """
    use_rocksdb(messages.sparkSession)
    keys = FLOW_KEY + (["qname_wire"] if match_qname else [])
    keyed, kept = _bucketed(messages.filter(F.col("qtype") != QTYPE_AXFR), keys)
    found = keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Outcomes(timeout_ms * 1000, delay_ms * 1000), outputStructType=f"kind string, {OUT}",
        outputMode="Append", timeMode="None",
    )
    return merge_projection(_picked(found, messages, kept, "kind"))


def stream_match_transactions(
    messages: DataFrame, timeout_ms: int = 1000, delay: str = "10 seconds", match_qname: bool = False
) -> DataFrame:
    """Pairs like `match_transactions`, for a streaming `messages`.

    Rows of a micro-batch are taken in event-time order; `delay` is how late rows may come and
    should not be below the timeout. State of a key lives until the watermark passes the
    timeout of its youngest message. Payloads travel as JSON, so the state schema stays fixed.
    State is kept per bucket of keys; keys are compared as a whole, not by their hash.
    """
    use_rocksdb(messages.sparkSession)
    keys = FLOW_KEY + (["qname_wire"] if match_qname else [])
    keyed, kept = _bucketed(messages.withWatermark("ts", delay).filter(F.col("qtype") != QTYPE_AXFR), keys)
    found = keyed.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Pending(timeout_ms * 1000), outputStructType=OUT,
        outputMode="Append", timeMode="EventTime",
    )
    return merge_projection(_picked(found, messages, kept))
