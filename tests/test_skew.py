"""Crowded keys take the chunked paths and must give what the plain paths give."""

from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from dnsflow.operators import enrich, match, normalize, tcp, transfer
from dnsflow.plans import skew, views, wireviews
from dnsflow.plans.prefix import with_prefix
from dnsflow.plans.skew import SkewPolicy, split_hot

PLAIN = SkewPolicy(enabled=False)
CROWDED = SkewPolicy(rows_per_group=150)


def one_key():
    return {
        "client_ip": F.unhex(F.lit("0A000001")), "server_ip": F.unhex(F.lit("0A000002")),
        "client_port": F.lit(4000), "server_port": F.lit(53), "id": F.lit(7), "prot": F.lit(17),
        "ipv": F.lit(4),
    }


def squeezed(df, factor):
    """The same messages, closer together in time."""
    return df.withColumn("ts", F.timestamp_micros((F.unix_micros("ts") / factor).cast("bigint")))


def one_busy_key(messages):
    """A third of all messages share one key; the rest keep their own."""
    busy = squeezed(messages.filter("qtype <> 252 and msg_id % 3 = 0"), 4000)
    return busy.withColumns({**one_key(), "qtype": F.lit(1)}).unionByName(
        messages.filter("qtype <> 252 and msg_id % 3 <> 0")
    )


def brute_force(rows, timeout=1_000_000):
    """Pending queue per key, one message at a time."""
    pairs, waiting = set(), {}
    for key, t, m, response in sorted(rows, key=lambda r: (r[1], r[2])):
        queue = waiting.setdefault(key, deque())
        while queue and queue[0][0] + timeout <= t:
            queue.popleft()
        if queue and queue[0][2] != response:
            other = queue.popleft()
            pairs.add((other[1], m) if response else (m, other[1]))
        else:
            queue.append((t, m, response))
    return pairs


@pytest.fixture(scope="module")
def busy(spark, messages):
    return one_busy_key(messages).cache()


@pytest.fixture(scope="module")
def expected(busy):
    keyed = match.with_flow_key(busy)
    rows = keyed.select(
        F.concat_ws("/", *[F.hex(c) for c in match.FLOW_KEY]).alias("k"), F.unix_micros("ts"),
        "msg_id", "is_response",
    ).collect()
    return brute_force([tuple(r) for r in rows])


def ids(df):
    return {tuple(r) for r in df.select("query_id", "response_id").collect()}


def test_plain_matches_brute_force(busy, expected):
    assert ids(match.match_transactions(busy, skew=PLAIN)) == expected


def test_crowded_key_matches_brute_force(busy, expected):
    found = match.match_transactions(busy, skew=CROWDED).select("query_id", "response_id").collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == expected


def test_crowded_key_unmatched(busy, expected):
    used = {m for pair in expected for m in pair}
    every = {r[0] for r in busy.select("msg_id").collect()}
    for policy in (PLAIN, CROWDED):
        alone = [r[0] for r in match.unmatched(busy, skew=policy).select("msg_id").collect()]
        assert len(alone) == len(set(alone)) and set(alone) == every - used


def test_repeated_ids_lose_no_row(busy):
    """Two captures may number their packets alike; leftovers are found by position, not by id."""
    again = busy.withColumn("msg_id", F.pmod("msg_id", F.lit(7)))
    rows = [
        Counter(tuple(r) for r in match.unmatched(again, skew=p).select("ts", "is_response", "msg_id").collect())
        for p in (PLAIN, CROWDED)
    ]
    assert rows[0] == rows[1] and sum(rows[0].values()) == match.unmatched(busy, skew=PLAIN).count()


def test_a_burst_is_cut_into_small_chunks(spark):
    start = 1_700_000_000_000_000
    times = [start - 365 * 86_400_000_000] + [start + 10_000 * k for k in range(1000)]
    df = spark.createDataFrame([(1, t) for t in times], "k int, us bigint")
    cold, hot = split_hot(df, ["k"], F.col("us"), 1_000_000, SkewPolicy(rows_per_group=100))
    sizes = [r["count"] for r in hot.groupBy("chunk").count().collect()]
    assert cold.count() == 0 and sum(sizes) == 1001 and max(sizes) <= 100


def test_buckets_that_ordinary_keys_fill_mark_no_key(busy, expected, monkeypatch):
    """Every bucket of the histogram is over the limit; only the one key that is over it too is cut."""
    monkeypatch.setattr(skew, "HISTOGRAM_BUCKETS", 4)
    keyed = match.with_flow_key(busy)
    per_key = keyed.groupBy(*match.FLOW_KEY).count()
    limit = sorted((r["count"] for r in per_key.collect()), reverse=True)[1]
    least = min(r["count"] for r in keyed.groupBy(skew.key_bucket(match.FLOW_KEY)).count().collect())
    assert limit < least
    cold, hot = split_hot(keyed, match.FLOW_KEY, F.unix_micros("ts"), 1_000_000, SkewPolicy(rows_per_group=limit))
    assert hot.select(*match.FLOW_KEY).distinct().count() == 1 and cold.count() + hot.count() == busy.count()
    assert ids(match.match_transactions(busy, skew=SkewPolicy(rows_per_group=limit))) == expected
    quiet = keyed.join(hot.select(*match.FLOW_KEY).distinct(), match.FLOW_KEY, "left_anti")
    assert split_hot(quiet, match.FLOW_KEY, F.unix_micros("ts"), 1_000_000, SkewPolicy(rows_per_group=limit))[1] is None
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 0)
    assert ids(match.match_transactions(busy, skew=SkewPolicy(rows_per_group=limit))) == expected


def test_a_sketch_taken_on_the_way_spares_the_count(busy, expected, monkeypatch, tmp_path):
    taken = skew.Sketching(match.with_flow_key(busy), match.FLOW_KEY)
    taken.rows.write.parquet(str(tmp_path / "messages"))
    sketch = taken.sketch()
    counts = sorted((r["count"] for r in match.with_flow_key(busy).groupBy(*match.FLOW_KEY).count().collect()), reverse=True)
    assert counts[0] <= sketch.most < busy.count() and all(sum(row) == busy.count() for row in sketch.counters)
    monkeypatch.setattr(skew, "crowded_keys", None)  # must not be called
    assert ids(match.match_transactions(busy, skew=SkewPolicy(rows_per_group=sketch.most, sketch=sketch))) == expected
    monkeypatch.undo()
    assert ids(match.match_transactions(busy, skew=SkewPolicy(rows_per_group=150, sketch=sketch))) == expected


def test_crowded_key_waiting_times(busy):
    rows = [
        Counter(tuple(r) for r in match.waiting_times(busy, skew=p).collect()) for p in (PLAIN, CROWDED)
    ]
    assert rows[0] == rows[1] and sum(rows[0].values()) > 0


def test_crowded_transfers(messages):
    rows = squeezed(messages.filter("msg_id % 4 <> 1"), 3000).withColumns(
        {**one_key(), "qtype": F.lit(252), "last_soa": F.expr("is_response and msg_id % 3 = 0")}
    )
    columns = ["query_id", "response_id", "res_len", "res_dns_len", "ancount"]
    plain, crowded = (
        Counter(tuple(r) for r in transfer.match_transfers(rows, skew=p).select(*columns).collect())
        for p in (PLAIN, SkewPolicy(rows_per_group=100))
    )
    assert plain == crowded and sum(plain.values()) > 5


def test_unfinished_transfers(messages):
    rows = squeezed(messages.filter("msg_id % 4 <> 1"), 3000).withColumns(
        {**one_key(), "qtype": F.lit(252), "last_soa": F.expr("is_response and msg_id % 3 = 0")}
    )
    plain, crowded = (
        Counter(r[0] for r in transfer.unfinished(rows, skew=p).select("msg_id").collect())
        for p in (PLAIN, SkewPolicy(rows_per_group=100))
    )
    assert plain == crowded and 0 < sum(plain.values()) < rows.count() and max(plain.values()) == 1


def test_waiting_times_of_transfers(messages):
    """Windows of a key and chunks of time give the same entries; every message is in one."""
    rows = squeezed(messages.filter("msg_id % 4 <> 1"), 3000).withColumns(
        {**one_key(), "qtype": F.lit(252), "last_soa": F.expr("is_response and msg_id % 3 = 0")}
    )
    plain, crowded = (
        Counter(tuple(r) for r in transfer.waiting_times(rows, skew=p).select("arrived", "renewed", "left").collect())
        for p in (PLAIN, SkewPolicy(rows_per_group=100))
    )
    assert plain == crowded
    assert sum(n for (_, _, left), n in plain.items() if left is not None) == transfer.match_transfers(rows, skew=PLAIN).count()


def busy_connection(spark):
    """Many messages back to back on one connection, cut into uneven segments, some twice, some late."""
    import random

    rng = random.Random(5)
    stream, bodies = b"", []
    for k in range(400):
        body = bytes([k % 256]) * (12 + rng.randrange(300))
        bodies.append(body)
        stream += len(body).to_bytes(2, "big") + body
    isn, server, start = (1 << 32) - 5000, 77, 1_700_000_000_000_000
    rows = [
        ("x", 0, start, 0, isn, 0, True, False, False, False, b"", 54),
        ("x", 1, start + 10, 1, server, isn + 1, True, True, False, False, b"", 54),
        ("x", 0, start + 250, 2, (isn + 1) % (1 << 32), server + 1, False, True, False, False, b"", 54),
    ]
    at, t, number = 0, start + 1000, 3
    while at < len(stream):
        piece = stream[at : at + rng.randrange(1, 500)]
        late = rng.choice([0, 0, 0, 40])
        for again in range(rng.choice([1, 1, 2])):
            rows.append((
                "x", 0, t + late + 7 * again, number, (isn + 1 + at) % (1 << 32), server + 1, False,
                True, False, False, piece, 54 + len(piece),
            ))
            number += 1
        at, t = at + len(piece), t + 25
    columns = "conn string, side int, us bigint, seg_no bigint, seq bigint, ack bigint, syn boolean, " \
        "ack_flag boolean, fin boolean, rst boolean, data binary, packet_len int"
    df = spark.createDataFrame(rows, columns)
    return df.withColumn("ts", F.timestamp_micros("us")).drop("us"), bodies


def test_crowded_connection(spark, messages, monkeypatch):
    monkeypatch.setattr(tcp, "CHUNK_BYTES", 2000)
    busy, bodies = busy_connection(spark)
    segments = wireviews.segments(messages).select(busy.columns).unionByName(busy)
    plain, crowded = (
        [tuple(r) for r in tcp.reassemble(segments, skew=p).orderBy("conn", "side", "pos").collect()]
        for p in (PLAIN, SkewPolicy(rows_per_group=200))
    )
    assert plain == crowded
    mine = [r for r in plain if r[0] == "x"]
    assert [bytes(r[4]) for r in mine] == bodies
    assert [r[-1] for r in mine if r[-1] >= 0] == [250]
    ends = [
        sorted(map(tuple, tcp.tcp_connections(segments, skew=p).collect())) for p in (PLAIN, SkewPolicy(rows_per_group=4))
    ]
    assert ends[0] == ends[1] and {"CLOSED", "FIN1", "ESTABLISHED"} <= {r[-1] for r in ends[0]}


def test_states_of_a_connection(spark):
    """The close in all its orders, in windows of the connection and in chunks of a second."""
    shake = [(0, 10, 0, "S", b""), (1, 50, 11, "SA", b""), (0, 11, 51, "A", b"")]
    ends = {
        "SYN": [(0, 10, 0, "S", b"")],
        "SYN_ACK": shake[:2],
        "ESTABLISHED": shake,
        "FIN1": [*shake, (0, 11, 51, "FA", b"ab"), (0, 13, 51, "A", b"refused"), (1, 51, 11, "A", b"kept")],
        "FIN1_ACK": [*shake, (0, 11, 51, "FA", b"ab"), (1, 51, 14, "A", b"")],
        "FIN1_FIN2": [*shake, (0, 11, 51, "FA", b""), (1, 51, 11, "FA", b"")],
        "FIN2": [*shake, (0, 11, 51, "FA", b""), (1, 51, 11, "FA", b""), (0, 12, 52, "A", b"")],
        "CLOSED": [*shake, (0, 11, 51, "FA", b""), (1, 51, 12, "FA", b""), (0, 12, 52, "A", b""), (0, 12, 52, "A", b"refused")],
    }
    rows = [
        (conn, side, 1_700_000_000_000_000 + 700_000 * k, k, seq, ack, "S" in f, "A" in f, "F" in f, "R" in f, data, 54)
        for conn, steps in ends.items() for k, (side, seq, ack, f, data) in enumerate(steps)
    ]
    df = spark.createDataFrame(rows, "conn string, side int, us long, seg_no long, seq long, ack long, syn boolean, ack_flag boolean, "
                               "fin boolean, rst boolean, data binary, packet_len int").withColumn("ts", F.timestamp_micros("us")).drop("us")
    for policy in (PLAIN, SkewPolicy(rows_per_group=1)):
        found = {r.conn: (r.state, r.bytes) for r in tcp.tcp_connections(df, skew=policy).collect()}
        assert {c: s for c, (s, _) in found.items()} == {c: c for c in ends} and found["CLOSED"][1] == 0
        kept = tcp.ordered_bytes(tcp.with_state(tcp.with_sessions(df))).filter("conn = 'FIN1'").collect()
        assert sorted(bytes(r.data) for r in kept) == [b"ab", b"kept"]


def frames_of(stream):
    at, out = 0, []
    while at + 2 <= len(stream) and at + 2 + int.from_bytes(stream[at : at + 2], "big") <= len(stream):
        size = int.from_bytes(stream[at : at + 2], "big")
        out.append((at, stream[at + 2 : at + 2 + size]))
        at += 2 + size
    return out


def test_a_chunk_gives_an_exit_for_every_entry():
    import random

    rng = random.Random(3)
    for width in (5, 64, 1000):
        data = bytes(rng.choice([0, 0, 0, 1, 9]) for _ in range(width + tcp.LONGEST + 70))
        for stream in (data, data[: width + 3], data[: width // 2], data[:1], b""):
            got = tcp.exits(stream, width)
            for entry in [*range(min(width + 3, 200)), 65_000]:
                at = entry
                while 0 <= at < width:
                    size = int.from_bytes(stream[at : at + 2], "big") if at + 2 <= len(stream) else 1 << 20
                    at = at + 2 + size if at + 2 + size <= len(stream) else -1
                assert got[entry] == (at - width if at >= 0 else -1)


@pytest.mark.parametrize("cut", [0, 40])
def test_framing_in_chunks_takes_log2_rounds(spark, monkeypatch, cut):
    """64 chunks, with messages longer than a chunk and length prefixes across borders, in six rounds."""
    import random

    monkeypatch.setattr(tcp, "CHUNK_BYTES", 3000)
    rng, streams = random.Random(9), {}
    for side in (0, 1):
        stream = b""
        while len(stream) < 63 * 3000 + 100:
            size = rng.choice([0, 1, 12, 200, 2997, 2998, 9000])
            stream += size.to_bytes(2, "big") + bytes([size % 251]) * size
        streams[side] = stream[: 64 * 3000 - cut] if side else stream[:5000]
    rows = []
    for side, stream in streams.items():
        at = 0
        while at < len(stream):
            data = stream[at : at + rng.randrange(1, 1500)]
            rows.append(("x", 1, side, at, data, at, at, len(data), at, None, True))
            at += len(data)
    pieces = spark.createDataFrame(
        rows, "conn string, session long, side int, pos long, data binary, us long, seg_no long, packet_len int, released_us long, rtt_us long, whole boolean"
    )
    turns = []
    composed = tcp._composed
    monkeypatch.setattr(tcp, "_composed", lambda df, distance: turns.append(distance) or composed(df, distance))
    plain, chunked = (sorted(map(tuple, tcp.frame_messages(pieces, c).collect())) for c in (False, True))
    assert plain == chunked and turns == [1, 2, 4, 8, 16, 32]
    for side, stream in streams.items():
        assert [(r[3], bytes(r[4])) for r in chunked if r[2] == side] == frames_of(stream)


def test_prefix_in_chunks(spark):
    rows = spark.range(500).select(
        (F.col("id") % 3).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 4 == 0, F.col("id") * 7 % 50).alias("v"),
    ).withColumn("chunk", F.floor(F.col("o") / 40))
    ops = {"l": ("last", F.col("v")), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}
    both = [
        sorted(tuple(r) for r in with_prefix(rows, ["k"], ["o"], ops, c).select("o", "s", "m", "l").collect())
        for c in (None, "chunk")
    ]
    assert [tuple(0 if x is None else x for x in r) for r in both[0]] == [
        tuple(0 if x is None else x for x in r) for r in both[1]
    ]


def test_range_lookup_without_broadcast(spark, messages):
    geo = views.geo(spark, "/root/testdata/sf0.001")
    rows = messages.select("msg_id", "client_ip")
    small, large = (
        {tuple(r) for r in enrich.range_lookup(rows, "client_ip", geo, ["asn"], n).select("msg_id", "asn").collect()}
        for n in (1_000_000, 1)
    )
    assert small == large


def test_blocks_of_one_slot_are_numbered_by_several_tasks(spark):
    """The rows of a time slot are not dealt by slot when they are numbered."""
    rows = spark.range(2000).selectExpr("id AS query_id", "id AS time_offset")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = normalize.assign_blocks(rows, rows_per_block=50, rows_per_part=100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(Counter(r.block_id for r in found).values()) == 50 and len({r.task for r in found}) > 2


def test_a_task_of_the_connection_windows_takes_few_segments(spark, messages, monkeypatch):
    segments = wireviews.segments(messages)
    monkeypatch.setattr(tcp, "ROWS_PER_TASK", 100, raising=False)
    rows = tcp.with_sessions(segments).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == segments.count() > 1000 and max(r["count"] for r in rows) < 250
