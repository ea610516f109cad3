import random
import struct

import pytest
from pyspark.sql import functions as F

from dnsflow import schema
from dnsflow.operators import filters, ingest, match, normalize
from dnsflow.plans import catalog, wireviews
from dnsflow.sources import capture_format, captures, tables


def pcap(rows, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for us, data in rows:
        part = us % 1_000_000 * (1000 if magic == 0xA1B23C4D else 1)
        out += struct.pack(order + "4I", us // 1_000_000, part, len(data), len(data)) + data
    return out


def sample(seed, n=3000):
    rng = random.Random(seed)
    return [(1_700_000_000_000_000 + 1000 * k, rng.randbytes(20 + rng.randrange(200))) for k in range(n)]


@pytest.mark.parametrize("order, magic", [("<", 0xA1B2C3D4), (">", 0xA1B2C3D4), ("<", 0xA1B23C4D)])
def test_captures_in_splits(spark, tmp_path, order, magic):
    files = {f"{tmp_path}/{k}.pcap": sample(k, n) for k, n in ((1, 3000), (2, 5), (3, 0))}
    for path, rows in files.items():
        with open(path, "wb") as out:
            out.write(pcap(rows, order, magic))
    got = captures.read_captures(spark, str(tmp_path), split_bytes=20_000)
    found = sorted(
        (r.source.split("/")[-1], r.packet_no, r.us, bytes(r.payload))
        for r in got.withColumn("us", F.unix_micros("ts")).collect()
    )
    expected = sorted(
        (path.split("/")[-1], n + k, us, data)
        for (path, rows), n in zip(files.items(), (0, 3000, 3005)) for k, (us, data) in enumerate(rows)
    )
    assert found == expected


def ids_and_sizes(df):
    return sorted((r.packet_no, len(r.payload)) for r in df.collect())


def test_records_before_a_broken_one_are_kept(spark, tmp_path):
    for n, split in ((50, 1 << 20), (2000, 20_000)):
        rows = sample(n, n)
        (tmp_path / "a.pcap").write_bytes(pcap(rows) + b"\xff" * 64)
        got = captures.read_captures(spark, str(tmp_path), split_bytes=split)
        assert ids_and_sizes(got) == [(k, len(d)) for k, (_, d) in enumerate(rows)]
        reject = captures.capture_rejects(spark, str(tmp_path), split_bytes=split).collect()
        assert [(r.position, r.reason) for r in reject] == [(len(pcap(rows)), "broken record header")]


def test_broken_record_in_the_middle_ends_the_file(spark, tmp_path):
    head, tail = sample(1, 1000), sample(2, 1000)
    (tmp_path / "a.pcap").write_bytes(pcap(head) + b"\xff" * 40 + pcap(tail)[24:])
    got = captures.read_captures(spark, str(tmp_path), split_bytes=10_000)
    assert ids_and_sizes(got) == [(k, len(d)) for k, (_, d) in enumerate(head)]


@pytest.mark.parametrize("split", [100_000, 1 << 20, 8 << 20])
def test_a_long_record_spans_splits(spark, tmp_path, split):
    rows = sample(3, 200)
    rows[100] = (rows[100][0], random.Random(1).randbytes(2 << 20))
    (tmp_path / "a.pcap").write_bytes(pcap(rows))
    got = captures.read_captures(spark, str(tmp_path), split_bytes=split)
    assert ids_and_sizes(got) == [(k, len(d)) for k, (_, d) in enumerate(rows)]


def test_one_task_per_split(spark, tmp_path):
    rows = sample(4, 3000)
    (tmp_path / "a.pcap").write_bytes(pcap(rows))
    got = captures.read_captures(spark, str(tmp_path), split_bytes=10_000)
    size = len(pcap(rows))
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == got.rdd.getNumPartitions() == -(-size // 10_000)


def blocks(rows, order="<"):
    """The block-structured format with two interfaces of different clocks."""
    def block(kind, body):
        body += bytes(-len(body) % 4)
        n = len(body) + 12
        return struct.pack(order + "II", kind, n) + body + struct.pack(order + "I", n)

    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535))
    out += block(1, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HHB3x", 9, 1, 9) + bytes(4))
    for k, (us, data) in enumerate(rows):
        t = us * (1000 if k % 2 else 1)
        out += block(6, struct.pack(order + "5I", k % 2, t >> 32, t & 0xFFFFFFFF, len(data), len(data)) + data)
        if k % 10 == 0:
            out += block(5, bytes(12))
    return out


@pytest.mark.parametrize("order", "<>")
def test_block_format_beside_other_files(spark, tmp_path, order):
    rows = sample(5, 300)
    (tmp_path / "a.pcapng").write_bytes(blocks(rows, order))
    (tmp_path / "b.pcap").write_bytes(pcap(rows[:7]))
    (tmp_path / "c.txt").write_bytes(b"no capture")
    got = captures.read_captures(spark, str(tmp_path), split_bytes=5000).withColumn("us", F.unix_micros("ts"))
    found = sorted((r.packet_no, r.us, bytes(r.payload)) for r in got.collect())
    assert found == [(k, us, d) for k, (us, d) in enumerate(rows + rows[:7])]
    rejects = captures.capture_rejects(spark, str(tmp_path), split_bytes=5000).collect()
    assert [(r.source.split("/")[-1], r.reason) for r in rejects] == [("c.txt", "not a capture")]


@pytest.mark.parametrize("order", "<>")
def test_a_block_format_file_is_read_by_several_tasks(spark, tmp_path, order):
    rows = sample(9, 400)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pcapng").write_bytes(blocks(rows, order) + blocks(rows[:50], "<" if order == ">" else ">"))
    got = captures.read_captures(spark, str(tmp_path / "in"), split_bytes=4000)
    assert got.rdd.getNumPartitions() > 5
    found = sorted((r.packet_no, r.us, bytes(r.payload)) for r in got.withColumn("us", F.unix_micros("ts")).collect())
    assert found == [(k, us, d) for k, (us, d) in enumerate(rows + rows[:50])]


def test_captures_as_a_data_source(spark, tmp_path):
    spark.dataSource.register(capture_format.CaptureSource)
    rows, folder = sample(3, 300), tmp_path / "in"
    folder.mkdir()
    (folder / "a.pcapng").write_bytes(blocks(rows))
    (folder / "b.pcap").write_bytes(pcap(rows[:90]))
    (folder / "c.txt").write_bytes(b"no capture")
    (folder / "d.pcap.part").write_bytes(pcap(rows[:3]))
    (folder / "e.pcap").write_bytes(pcap(rows[:5])[:-1])
    expected = sorted((us, d) for us, d in rows + rows[:90] + rows[:4])
    content = lambda df: sorted((r.us, bytes(r.payload)) for r in df.select(F.unix_micros("ts").alias("us"), "payload").collect())
    plain = spark.read.format("capture").load(str(folder))
    assert content(plain) == expected and plain.select("packet_no").distinct().count() == len(expected)
    captures.index_captures(spark, str(folder), str(tmp_path / "index"), split_bytes=4000)
    indexed = spark.read.format("capture").option("index", str(tmp_path / "index")).load(str(folder))
    assert content(indexed) == [x for x in expected] and indexed.rdd.getNumPartitions() > 5
    middle = rows[150][0]
    late = spark.read.format("capture").options(index=str(tmp_path / "index"), since=str(middle)).load(str(folder))
    assert content(late) == [x for x in expected if x[0] >= middle] and content(indexed) == expected


def test_a_landing_folder_of_captures_as_a_stream(spark, tmp_path):
    spark.dataSource.register(capture_format.CaptureSource)
    rows, folder = sample(2, 60), tmp_path / "in"
    folder.mkdir()
    (folder / "b.pcap").write_bytes(pcap(rows[:20]))

    def run():
        stream = spark.readStream.format("capture").load(str(folder))
        writer = stream.writeStream.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{tmp_path}/out").start().awaitTermination()
        return sorted(bytes(r.payload) for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect())

    assert run() == sorted(d for _, d in rows[:20])
    (folder / "a.pcap").write_bytes(pcap(rows[20:50]))
    (folder / "c.pcap.tmp").write_bytes(pcap(rows[50:]))
    assert run() == sorted(d for _, d in rows[:50])
    (folder / "c.pcap.tmp").rename(folder / "c.pcap")
    assert run() == sorted(d for _, d in rows)


def test_dnstap_with_a_broken_tail_and_a_long_frame(spark, tmp_path):
    rng = random.Random(6)
    frames = [rng.randbytes(50 + rng.randrange(300)) for _ in range(1500)]
    frames[700] = rng.randbytes(2 << 20)
    body = struct.pack(">IIII", 0, 8, 2, 0) + b"".join(struct.pack(">I", len(f)) + f for f in frames)
    (tmp_path / "a.fstrm").write_bytes(body + struct.pack(">I", 500) + b"cut off")
    got = captures.read_dnstap(spark, str(tmp_path), split_bytes=40_000)
    assert [bytes(r.payload) for r in sorted(got.collect(), key=lambda r: r.packet_no)] == frames
    rejects = captures.capture_rejects(spark, str(tmp_path), "dnstap", split_bytes=40_000).collect()
    assert [(r.position, r.reason) for r in rejects] == [(len(body), "the file ends within a frame")]


def test_misleading_capture_is_read_from_its_start(spark, tmp_path):
    """Packet data that looks like a chain of records must not win over the real records."""
    bait = b"".join(struct.pack("<4I", 1_700_000_000, k, 40, 40) + bytes(40) for k in range(40))
    rows = [(1_700_000_000_000_000 + k, bait) for k in range(12)]
    (tmp_path / "a.pcap").write_bytes(pcap(rows))
    got = captures.read_captures(spark, str(tmp_path), split_bytes=3000).collect()
    assert sorted((r.packet_no, len(r.payload)) for r in got) == [(k, len(bait)) for k in range(12)]


def test_dnstap_recording(spark, tmp_path):
    frames = [bytes([k]) * (50 + k) for k in range(200)]
    control = struct.pack(">IIII", 0, 8, 2, 0)
    stop = struct.pack(">III", 0, 4, 3)
    body = b"".join(struct.pack(">I", len(f)) + f for f in frames)
    (tmp_path / "a.fstrm").write_bytes(control + body + stop)
    got = captures.read_dnstap(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in sorted(got, key=lambda r: r.packet_no)] == frames


def test_kafka_rows(spark):
    df = spark.createDataFrame([(1, "a")], "time bigint, v string")
    row = tables.kafka_rows(df, "t", "k", "time").collect()[0]
    assert (row.topic, row.value, row.key) == ("t", '{"time":1,"v":"a"}', "k")
    assert tables.kafka_options("b:1", "t", {"security.protocol": "ssl"}) == {
        "kafka.bootstrap.servers": "b:1", "topic": "t", "kafka.security.protocol": "ssl",
    }


def test_file_rotation_by_rows(spark, messages, tmp_path):
    df = messages.select("id").coalesce(1)
    df.write.option("maxRecordsPerFile", 500).parquet(f"{tmp_path}/x")
    assert len(list((tmp_path / "x").glob("*.parquet"))) == -(-df.count() // 500)


def test_kept_packets(spark):
    rows = [(0, False, bytearray(20), None), (1, False, bytearray(10), "error: x"), (2, True, bytearray(10), "error: y")]
    df = spark.createDataFrame(rows, "n int, raw_ip boolean, payload binary, error string")
    sizes = lambda d: sorted((r.n, len(r.payload)) for r in d.collect())
    assert sizes(tables.kept_packets(df)) == [(0, 6), (2, 10)]
    assert sizes(tables.kept_packets(df, only_invalid=True)) == [(2, 10)]


def test_options_overlay():
    config = {"default": {"timeout_ms": 500, "dns_ports": {53, 5353}}, "eu": {"timeout_ms": 700, "note": 1}}
    options = schema.Options.overlay(config, "eu")
    assert options.timeout_ms == 700 and options.dns_ports == {53, 5353} and options.extra == {"note": 1}
    assert schema.Options().moving_avg_window == 300 and schema.Options.overlay(config).timeout_ms == 500


def test_packet_export_and_capture_files(spark, tmp_path, messages):
    """Kept packets as a table and as capture files hold the same packets."""
    packets = wireviews.udp_packets(messages)
    tables.write_packets(packets, f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == packets.count()
    written = captures.write_captures(packets, f"file://{tmp_path}/files").collect()
    assert sum(r.packets for r in written) == packets.count()
    bodies = lambda df: sorted((r.us, bytes(r.payload)) for r in df.withColumn("us", F.unix_micros("ts")).collect())
    assert bodies(captures.read_captures(spark, f"{tmp_path}/files")) == bodies(packets)


def test_packets_are_read_twice_for_messages(spark, messages):
    """Once for datagrams and once for segments, which are counted and dealt without reading packets again."""
    packets = wireviews.udp_packets(messages).unionByName(wireviews.tcp_packets(messages))
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    found = ingest.packets_to_messages(packets.mapInArrow(passed, packets.schema), ports={53, 443, 853})
    assert found.count() > 0 and seen.value == 2 * packets.count()


def test_events_are_derived_once_for_segments(messages):
    plan = wireviews.segments(messages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_capture_times_in_any_session_zone(spark, tmp_path, zone):
    rows = sample(7, 40)
    (tmp_path / "a.pcap").write_bytes(pcap(rows))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = captures.read_captures(spark, str(tmp_path)).withColumn("us", F.unix_micros("ts")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(r.us for r in got) == [us for us, _ in rows]


def test_address_lists_on_the_paired_feed(messages):
    feed = catalog.paired_feed(match.match_transactions(messages))
    rows = tables.ingest_paired(feed)
    for lists in ({"deny": ["192.0.2.2/32"]}, {"allow": ["192.0.2.0/31", "2001:db8:ffff::1/128"]}):
        expected = filters.cidr_filter(rows, **lists).count()
        assert tables.ingest_paired(feed, **lists).count() == expected and 0 < expected < rows.count()


def test_no_file_holds_more_blocks_than_it_may(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('b', id % 101) AS block_id", "id AS query_id")
    names = spark.range(500).selectExpr("concat('b', id % 101) AS block_id", "CAST(id AS INT) AS index", "CAST('x' AS BINARY) AS value")
    tables.write_blocks(rows, {"names": names}, f"{tmp_path}/out", blocks_per_file=4)
    for table, n in (("facts", 2000), ("names", 500)):
        back = spark.read.parquet(f"{tmp_path}/out/{table}").withColumn("file", F.col("_metadata.file_name"))
        per_file = back.groupBy("file").agg(F.count_distinct("block_id").alias("n")).collect()
        assert back.count() == n and max(r.n for r in per_file) <= 4 and len(per_file) >= 26
        assert back.groupBy("block_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").isEmpty()


def test_blocks_are_encoded_many_to_a_call(spark, messages):
    """A call gets whole blocks, many at once, however the batches are cut; the rows come back as they were."""
    rows = catalog.blocks(messages)
    layout = normalize._Layout.of(rows)
    encode, calls = normalize._encoded(layout), []

    def counted(table):
        calls.append(len(table["block_id"].unique()))
        return encode(table)

    held = rows.sort("block_id").toArrow().combine_chunks()
    out = [list(normalize._by_whole_blocks(counted)(held.to_batches(max_chunksize=n))) for n in (7, 100_000)]
    n = len(held["block_id"].unique())
    assert n > 10 and calls[-2:] == [n - 1, 1] and sum(calls[:-2]) == n and len(calls) > 10
    key = ("table", "block_id", "index")
    first, second = (sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (*map(str, (r[k] for k in key)), repr(r))) for batches in out)
    assert first == second
    back = normalize.decode_refs(*normalize.encode_blocks(rows))
    shown = lambda df: sorted(map(repr, df.select("block_id", "query_id", "query_name", "query_classtype", "response_answer_sections").collect()))
    assert shown(back) == shown(rows)


def test_a_task_writes_several_files_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "WRITERS", 3)
    rows = spark.range(2000).selectExpr("concat('b', id % 101) AS block_id", "id AS query_id")
    tables.write_blocks(rows, {}, f"{tmp_path}/out", blocks_per_file=4)
    back = spark.read.parquet(f"{tmp_path}/out/facts").withColumn("file", F.col("_metadata.file_path"))
    per_file = back.groupBy("file").agg(F.count_distinct("block_id").alias("n")).collect()
    assert back.count() == 2000 and max(r.n for r in per_file) <= 4 and len(per_file) >= 26
    assert len({r.file.rsplit("/", 1)[1] for r in per_file}) <= 3
