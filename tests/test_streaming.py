import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dnsflow.operators import match, stats
from dnsflow.plans import catalog, views
from dnsflow.streaming import flows, matching
from dnsflow.streaming import tcp as tcp_stream
from dnsflow.streaming.tcp import _Connection

from compare import check
from conftest import SF


def run(stream, folder, mode="append"):
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}/cp").format("parquet").option("path", f"{folder}/out")
    writer.start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def test_state_survives_batches(spark, tmp_path):
    """Queries and responses arrive in different micro-batches."""
    events = views.table(spark, SF, "events")
    parts = events.orderBy("ts").repartitionByRange(4, "ts")
    parts.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    messages = views.messages_of(stream)
    # One key per user and a long timeout, so that pairs span the batches.
    static = views.messages_of(events)
    got = run(matching.stream_match_transactions(messages, delay="60 days"), tmp_path)
    expected = match.match_transactions(static)
    ids = lambda df: {tuple(r) for r in df.select("query_id", "response_id").collect()}
    assert ids(got) == ids(expected)


def test_rotation(spark, tmp_path):
    events = views.table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    rows = views.messages_of(stream).select("msg_id", "ts")
    flows.rotated(rows, f"{tmp_path}/out", f"{tmp_path}/cp", 86_400, trigger={"availableNow": True}).awaitTermination()
    folders = sorted(p.name for p in (tmp_path / "out").glob("rotation=*"))
    days = views.messages_of(events).select(F.date_format("ts", "yyyyMMdd").alias("d")).distinct().count()
    assert len(folders) == days and spark.read.parquet(f"{tmp_path}/out").count() == 2048


def test_delivery_falls_back():
    calls = []

    def broken(batch, number):
        calls.append("primary")
        raise OSError("down")

    flows.deliver(broken, lambda batch, number: calls.append("backup"))(None, 3)
    assert calls == ["primary"] * 3 + ["backup"]
    with pytest.raises(OSError):
        flows.deliver(broken)(None, 3)


def test_unsent_batches_are_kept_and_sent_later(spark, tmp_path):
    """The primary is down for two batches, over a restart; then every batch is delivered once, in order."""
    sent, down = [], [True]

    def primary(batch, number):
        if down[0]:
            raise OSError("down")
        sent.append((number, sorted(r.id for r in batch.collect())))

    batch = lambda n: spark.range(10 * n, 10 * n + 3)
    flows.deliver(primary, unsent=f"{tmp_path}/unsent")(batch(0), 0)
    again = flows.deliver(primary, unsent=f"{tmp_path}/unsent")
    again(batch(1), 1)
    again(batch(1), 1)  # the same batch once more
    assert not sent and flows.Unsent(f"{tmp_path}/unsent").numbers(spark) == [0, 1]
    down[0] = False
    flows.deliver(primary, unsent=f"{tmp_path}/unsent")(batch(2), 2)
    again(batch(3), 3)
    assert sent == [(n, [10 * n, 10 * n + 1, 10 * n + 2]) for n in range(4)]
    assert flows.Unsent(f"{tmp_path}/unsent").numbers(spark) == []


def test_a_kept_batch_that_comes_again_is_not_sent_twice(spark, tmp_path):
    sent, down = [], [True]

    def primary(batch, number):
        if down[0]:
            raise OSError("down")
        sent.append(number)

    run = flows.deliver(primary, unsent=f"{tmp_path}/unsent")
    run(spark.range(2), 0)
    down[0] = False
    run(spark.range(2), 0)
    assert sent == [0] and flows.Unsent(f"{tmp_path}/unsent").numbers(spark) == []


def test_every_message_of_a_stream_has_an_outcome(spark, messages, tmp_path):
    """Pairs, late and expired messages go to sinks of their own; with what still waits they are the input."""
    ordinary = messages.filter("qtype <> 252").withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / 100_000).cast("bigint") + F.col("msg_id") % 7))
    held = F.col("msg_id") % 20 == 0  # these come after all others
    bounds = ordinary.agg(F.percentile_approx(F.unix_micros("ts"), [0.3, 0.6])).first()[0]
    cuts = [F.unix_micros("ts") < bounds[0], F.unix_micros("ts").between(bounds[0], bounds[1] - 1), F.unix_micros("ts") >= bounds[1]]
    for number, part in enumerate([*[c & ~held for c in cuts], held]):
        ordinary.filter(part).coalesce(1).write.parquet(f"{tmp_path}/in/part={number}")
    stream = spark.readStream.schema(ordinary.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = matching.stream_outcomes(stream, timeout_ms=1, delay_ms=2)
    targets = {k: flows.folder_target(f"{tmp_path}/{k}") for k in ("pair", "late", "expired")}
    writer = found.writeStream.foreachBatch(flows.split_sinks(targets)).option("checkpointLocation", f"{tmp_path}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    ids = {}
    for kind in targets:
        rows = spark.read.parquet(f"{tmp_path}/{kind}").select("query_id", "response_id").collect()
        ids[kind] = [x for r in rows for x in r if x is not None]
    every = [r[0] for r in ordinary.select("msg_id").collect()]
    out = [x for found in ids.values() for x in found]
    assert len(out) == len(set(out)) and set(out) <= set(every)
    assert ids["late"] and all(x % 20 == 0 for x in ids["late"]) and ids["pair"] and ids["expired"]
    waiting = ordinary.filter(~F.col("msg_id").isin(out)).agg(F.min(F.unix_micros("ts")), F.count("*")).first()
    last = ordinary.agg(F.max(F.unix_micros("ts"))).first()[0]
    assert waiting[1] == len(every) - len(out) and waiting[1] < 200 and (waiting[1] == 0 or waiting[0] < last)


def test_late_messages(messages):
    mark = messages.agg(F.min("ts")).first()[0]
    assert flows.late_messages(messages, F.lit(mark)).count() == 1


def test_moving_average_against_loop(messages):
    rates = {r.tick: r.ipv4 for r in stats.qps(messages, 3600, 3600).collect()}
    rows = stats.qps_moving_average(messages, 5, 3600, 3600).collect()
    ticks = sorted(rates)
    for row in rows:
        i = ticks.index(row.tick)
        last = [rates[t] for t in ticks[max(0, i - 4) : i + 1]]
        assert (row.ipv4, row.samples) == (sum(last) // len(last), len(last))
    with pytest.raises(ValueError):
        stats.qps_moving_average(messages, 4000)


def connection(steps, limit=100):
    """Feeds segments (side, seq, data, flags) to the stream's connection after its handshake."""
    state = _Connection(None, ())
    state.take(0, 0, 99, 0, True, False, False, False, b"", 54, limit)
    state.take(1, 1, 499, 100, True, True, False, False, b"", 54, limit)
    state.take(0, 2, 100, 500, False, True, False, False, b"", 54, limit)
    out = []
    for k, (side, seq, data, rst) in enumerate(steps):
        done = state.take(side, 10 + k, seq, 0, False, not rst, False, rst, data, 54 + len(data), limit)
        if done is None:
            return out, "ended"
        out += [bytes(m[4]) for m in done]
    return out, "open"


def framed(*bodies):
    return b"".join(len(b).to_bytes(2, "big") + b for b in bodies)


def test_overlapping_pieces_of_a_stream():
    data = framed(b"a" * 12, b"b" * 30)
    assert connection([(0, 100, data[:20], False), (0, 110, data[10:], False)])[0] == [b"a" * 12, b"b" * 30]
    # pieces behind a hole that overlap, the hole filled last by one that covers more than it
    late = [(0, 120, data[20:40], False), (0, 130, data[30:], False), (0, 125, data[25:35], False), (0, 100, data[:28], False)]
    assert connection(late)[0] == [b"a" * 12, b"b" * 30]
    # a piece that begins before what was released and brings a new message
    assert connection([(0, 100, data[:14], False), (0, 105, data[5:], False)])[0] == [b"a" * 12, b"b" * 30]


def test_many_small_pieces_in_order_are_no_overflow():
    data = framed(b"x" * 150)
    steps = [(0, 100 + k, data[k:k + 1], False) for k in range(len(data))]
    assert connection(steps, limit=5) == ([b"x" * 150], "open")
    holes = [(0, 102 + 2 * k, b"y", False) for k in range(6)]
    assert connection(holes, limit=5)[1] == "ended"


def test_a_side_sends_nothing_after_its_own_fin():
    first, late = framed(b"a" * 12), framed(b"b" * 12)
    state = _Connection(None, ())
    steps = [
        (0, 99, 0, True, False, False, b""), (1, 499, 100, True, True, False, b""), (0, 100, 500, False, True, False, b""),
        (0, 110, 500, False, True, True, first[10:] + late[:0]),  # the FIN overtakes the first bytes
        (0, 114, 500, False, True, False, late), (0, 100, 500, False, True, False, first[:10]),
        (1, 500, 115, False, True, False, late), (1, 514, 115, False, True, True, b""),
        (0, 115, 515, False, True, False, b""),
    ]
    out, closed = [], []
    for k, (side, seq, ack, syn, ack_flag, fin, data) in enumerate(steps):
        out += [(m[0], bytes(m[4])) for m in state.take(side, k, seq, ack, syn, ack_flag, fin, False, data, 54, 100)]
        closed.append(state.closed)
    assert out == [(0, b"a" * 12), (1, b"b" * 12)] and closed == [False] * 8 + [True]


def test_resets_of_a_stream():
    data = framed(b"a" * 12)
    assert connection([(0, 100, data, False), (0, 114, b"", True)]) == ([b"a" * 12], "ended")
    assert connection([(0, 100, data, False), (0, 60, b"", True)]) == ([b"a" * 12], "open")


def test_connections_of_a_bucket_open_across_batches_and_end_by_silence(spark, tmp_path):
    """The data of `a` comes 10 s after its handshake, that of `b` 100 s after, both in a later micro-batch."""
    def segment(conn, second, no, side, seq, ack, syn, data=b""):
        return conn, side, second, no, seq, ack, syn, not (syn and side == 0), False, False, bytearray(data), 54 + len(data)

    shakes = [segment(c, 0, 10 + k, *x) for c in "ab" for k, x in enumerate(((0, 100, 0, True), (1, 500, 101, True), (0, 101, 501, False)))]
    later = [segment(c, second, 20, 0, 101, 501, False, b"\x00\x03abc") for c, second in (("a", 10), ("b", 100))]
    kind = "conn string, side int, s long, seg_no long, seq long, ack long, syn boolean, ack_flag boolean, fin boolean, rst boolean, data binary, packet_len int"
    for number, rows in enumerate((shakes, later)):
        df = spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds(F.col("s") + 2_000_000))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={number}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = run(tcp_stream.stream_tcp_reassembly(stream, delay="10 days"), tmp_path).collect()
    assert [(r.conn, bytes(r.body)) for r in found] == [("a", b"abc")]


def test_zone_transfers_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    """Each micro-batch takes the files of one part, however many there are."""
    monkeypatch.setattr(catalog, "TRANSFERS_PER_FILE", 20)
    monkeypatch.setattr(catalog, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    ok, text = check(spark, SF, "stream_axfr")
    assert ok, text
    files = [len(list((tmp_path / "transfers" / f"part={k}").glob("*.parquet"))) for k in range(4)]
    assert files[0] > 1 and len(set(files)) == 1


def test_a_payload_holds_what_a_pair_takes_from_its_side(messages):
    keyed, kept = matching._bucketed(messages, matching.FLOW_KEY)
    rows = keyed.select("is_response", "payload").limit(200).collect()
    assert {r.is_response for r in rows} == {True, False} and {"qname", "answer_rrs"} <= set(kept)
    assert all(("answer_rrs" in r.payload, "qname" in json.loads(r.payload)) == (r.is_response, not r.is_response) for r in rows)


def test_pairs_of_a_bucket_leave_in_pieces():
    """A bucket's pairs are never one table, and the state keeps the messages that wait."""
    class Handle:
        def __init__(self):
            self.kept = [("w", 1, -1, False, "old")]

        def getListState(self, *_):
            return self

        def get(self):
            return iter(self.kept)

        def put(self, rows):
            self.kept = rows

        def listTimers(self):
            return []

        def registerTimer(self, at):
            pass

        def getCurrentWatermarkInMs(self):
            return 0

    handle, pending, n = Handle(), matching._Pending(1_000_000), 10_000
    pending.init(handle)
    rows = [(f"k{i}", 10 * i + r, 2 * i + r, bool(r), f"{'qr'[r]}{i}") for i in range(n) for r in (0, 1)] + [("w", 5, -2, True, "new"), ("x", 7, -3, False, "alone")]
    random.Random(1).shuffle(rows)
    frame = pd.DataFrame(rows, columns=["k", "t", "m", "is_response", "payload"])
    out = list(pending.handleInputRows((0,), iter([frame.iloc[:9000], frame.iloc[9000:]]), handle))
    assert max(map(len, out)) < n
    assert sorted(map(tuple, pd.concat(out).to_numpy())) == sorted([("old", "new"), *[(f"q{i}", f"r{i}") for i in range(n)]])
    assert handle.kept == [("x", 7, -3, False, "alone")]
