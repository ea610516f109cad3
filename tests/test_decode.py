"""Hand-made bytes with known answers."""

import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dnsflow.operators import columnar, decode, wire
from dnsflow.plans import views, wireviews


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".") if p) + b"\0"


def header(flags=0x8180, counts=(1, 0, 0, 0)):
    return struct.pack(">2H4H", 9, flags, *counts)


QUESTION = name("example.com") + struct.pack(">2H", 1, 1)


def record(owner, kind, data, ttl=60):
    return owner + struct.pack(">2HIH", kind, 1, ttl, len(data)) + data


def test_compressed_records():
    answers = [
        record(b"\xc0\x0c", 1, bytes([192, 0, 2, 1])),
        record(b"\xc0\x0c", 15, b"\x00\x0a" + b"\x04mail\xc0\x0c"),
        record(b"\xc0\x0c", 33, b"\x00\x01\x00\x02\x00\x35" + b"\x03srv\xc0\x0c"),
        record(b"\xc0\x0c", 16, b"\x02hi\x03a\"b"),
        record(b"\xc0\x0c", 99, b"\xab\xcd"),
        record(b"\xc0\x0c", 6, b"\x02ns\xc0\x0c" + b"\x05admin\xc0\x0c" + struct.pack(">5I", 1, 2, 3, 4, 5)),
    ]
    opt = b"\0" + struct.pack(">2HIH", 41, 1232, 0x01008000, 6) + b"\x00\x03\x00\x02ab"
    msg = header(counts=(1, len(answers), 0, 1)) + QUESTION + b"".join(answers) + opt
    out = wire.decode_message(msg, True)
    assert out["qname"] == "example.com" and (out["qtype"], out["qclass"]) == (1, 1)
    assert [r["rdata"] for r in out["answer_rrs"]] == [
        "192.0.2.1", "10 mail.example.com.", "1 2 53 srv.example.com.", '"hi" "a\\034b"',
        "\\# 2 ABCD", "ns.example.com. admin.example.com. 1 2 3 4 5",
    ]
    assert all(r["name"] == "example.com" and r["ttl"] == 60 for r in out["answer_rrs"])
    assert out["last_soa"] and out["edns_udp"] == 1232 and out["edns_do"] and out["ext_rcode"] == 1
    assert out["opt_rdata"] == b"\x00\x03\x00\x02ab" and out["additional_rrs"] is None
    assert wire.decode_message(msg, False)["answer_rrs"] is None


@pytest.mark.parametrize("msg", [
    header() + b"\x07exam",
    header() + b"\xc0\x0c\x00\x01\x00\x01",
    header() + b"\x40" + b"a" * 64 + b"\0" + struct.pack(">2H", 1, 1),
    header(counts=(1, 2, 0, 0)) + QUESTION + record(b"\xc0\x0c", 1, b"\1\2\3\4"),
    header(counts=(1, 1, 0, 0)) + QUESTION + record(b"\xc0\x40", 1, b"\1\2\3\4"),
    header(counts=(1, 1, 0, 0)) + QUESTION + record(b"\xc0\x0c", 1, b"\1\2\3\4")[:-2],
    header(counts=(1, 1, 0, 0)) + QUESTION + record(b"\x80aaaaaa", 1, b"\1\2\3\4"),
])
def test_malformed(msg):
    with pytest.raises(wire.Malformed):
        wire.decode_message(msg, True)


def packets(spark, *payloads, raw=False):
    rows = [("t", i, None, "WIRE", raw, bytearray(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "source string, packet_no bigint, ts timestamp, kind string, raw_ip boolean, payload binary")


def udp4(body, options=b"", sport=4000, dport=53, protocol=17):
    udp = struct.pack(">4H", sport, dport, 8 + len(body), 0xBEEF) + body
    words = 5 + len(options) // 4
    ip = struct.pack(">BBHIBBH", 0x40 | words, 0, words * 4 + len(udp), 0, 61, protocol, 0)
    return ip + bytes([10, 0, 0, 1, 192, 0, 2, 9]) + options + udp


def udp6(body):
    udp = struct.pack(">4H", 53, 4000, 8 + len(body), 1) + body
    return struct.pack(">IHBB", 6 << 28, len(udp), 17, 55) + bytes(15) + b"\1" + bytes(15) + b"\2" + udp


def ether(ip, kind=0x0800):
    return bytes(12) + struct.pack(">H", kind) + ip


def test_packets(spark):
    query = header(0x0100) + QUESTION
    answer = header(0x8583, (1, 0, 0, 0)) + QUESTION
    rows = decode.decode_packets(packets(
        spark, ether(udp4(query)), ether(udp6(answer), 0x86DD), ether(udp4(query, options=b"\1\1\1\1")),
        ether(udp4(query))[:13], ether(udp4(query), 0x0806), ether(udp4(query, protocol=1)),
        ether(udp4(query))[:60], ether(udp4(query, dport=54)), ether(udp4(b"")), ether(udp4(query[:11])),
        ether(udp4(query) + b"trailer"),
    ))
    got = {r.packet_no: r for r in rows.collect()}
    assert (got[0].client_port, got[0].server_port, got[0].ttl, got[0].udp_sum) == (4000, 53, 61, 0xBEEF)
    assert bytes(got[0].client_ip) == bytes([10, 0, 0, 1]) and not got[0].is_response and got[0].rd
    assert got[1].is_response and got[1].aa and got[1].rcode == 3 and got[1].client_port == 4000
    assert bytes(got[1].client_ip) == bytes(15) + b"\2"
    assert got[2].qname == "example.com" and got[10].dns_len == got[0].dns_len
    assert {n: got[n].error for n in got if got[n].error} == {
        3: "error: link header cut off", 6: "error: packet shorter than its IP header claims",
        8: "error: no DNS data", 9: "error: DNS header cut off",
    }
    assert set(got) == {0, 1, 2, 3, 6, 8, 9, 10}


def test_raw_packets_and_lists(spark):
    query = header(0x0100) + QUESTION
    rows = packets(spark, udp4(query), udp6(query), raw=True)
    assert decode.decode_packets(rows).filter("error is null").count() == 2
    kept = decode.decode_packets(rows, allow=["10.0.0.0/8"], deny=["::/64"]).collect()
    assert [r.packet_no for r in kept] == [0]
    assert [r.packet_no for r in decode.decode_packets(rows, deny=["10.0.0.1"]).collect()] == [1]


def tcp_packet(data, flags, sport=4000, dport=53, seq=1, ack=1):
    tcp = struct.pack(">2H2IBB3H", sport, dport, seq, ack, 0x50, flags, 0, 0, 0) + data
    ip = struct.pack(">BBHIBBH", 0x45, 0, 20 + len(tcp), 0, 61, 6, 0)
    return ether(ip + bytes([10, 0, 0, 1, 192, 0, 2, 9]) + tcp)


def test_segments_of_packets(spark):
    rows = decode.tcp_segments(packets(spark, tcp_packet(b"", 2, seq=77), tcp_packet(b"abc", 0x18), tcp_packet(b"", 0x14)))
    got = sorted((r.seg_no, r.side, r.seq, r.syn, r.ack_flag, r.rst, bytes(r.data)) for r in rows.collect())
    assert got == [
        (0, 0, 77, True, False, False, b""), (1, 0, 1, False, True, False, b"abc"),
        (2, 0, 1, False, True, True, b""),
    ]


@pytest.mark.parametrize("kind, data, text", [
    (43, bytes.fromhex("ec450802") + b"\xab" * 4, "60485 8 2 ABABABAB"),
    (48, bytes.fromhex("01010308") + b"key!", "257 3 8 a2V5IQ=="),
    (52, bytes.fromhex("030101") + b"\x01\x02", "3 1 1 0102"),
    (257, b"\x00\x05issueca.example", '0 issue "ca.example"'),
    (35, bytes.fromhex("0064000a") + b"\x01u\x07E2U+sip\x00" + b"\x03sip\x00", '100 10 "u" "E2U+sip" "" sip.'),
    (46, struct.pack(">HBBIIIH", 1, 8, 2, 300, 1700000000, 1690000000, 77) + b"\x02cz\x00sig",
     "A 8 2 300 20231114221320 20230722042640 77 cz. c2ln"),
    (65, b"\x00\x01\x00" + struct.pack(">HH", 1, 6) + b"\x02h2\x02h3" + struct.pack(">HHH", 3, 2, 8443)
     + struct.pack(">HH", 4, 4) + bytes([192, 0, 2, 1]), "1 . alpn=h2,h3 port=8443 ipv4hint=192.0.2.1"),
    (43, b"\x01", "\\# 1 01"),
    (257, b"\x00\x09issue", "\\# 7 00096973737565"),
])
def test_text_of_service_and_signature_records(kind, data, text):
    message = bytes(12) + data
    assert wire.rdata_text(message, kind, 12, len(data), len(message)) == text


def mutated(rng, values):
    """The values, cut, with bytes changed, doubled or taken from each other."""
    out = list(values)
    while len(out) < 6000:
        v = bytearray(rng.choice(values))
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            if v:
                at = rng.randrange(len(v))
                v[at] = rng.choice([0, 1, 12, 41, 63, 64, 0xC0, 0xFF, rng.randrange(256)])
        cut = rng.choice([None, None, rng.randrange(len(v) + 1)])
        out.append(bytes(v[:cut]) + (bytes(rng.randrange(9)) if rng.random() < 0.1 else b""))
    return out


@pytest.mark.parametrize("with_rrs", [True, False])
def test_columns_equal_messages_decoded_one_by_one(with_rrs):
    rng = random.Random(4)
    rr = [record(b"\xc0\x0c", k, d) for k, d in (
        (1, bytes([192, 0, 2, 1])), (28, bytes(range(16))), (15, b"\0\x0a\x04mail\xc0\x0c"), (16, b"\x02hi\x03a\"b"), (99, b"\xab"), (5, b"\xc0\x0c"), (1, b""),
        (6, b"\x02ns\xc0\x0c\x05admin\xc0\x0c" + bytes(20)))]
    rr += [record(name("other.example.org"), 1, b"\1\2\3\4"), record(b"\x03www\xc0\x0c", 2, b"\x02ns\xc0\x10"), record(b"\0", 1, b"\0\0\0\0")]
    opt = b"\0" + struct.pack(">2HIH", 41, 1232, 0x01008000, 6) + b"\x00\x03\x00\x02ab"
    bodies = [header(0x0100) + QUESTION, header(0x0100, (0, 0, 0, 0)), header(counts=(0, 1, 0, 0)) + record(name("a.b"), 1, b"\1\2\3\4"),
              header(counts=(2, 1, 0, 0)) + QUESTION * 2 + rr[0], header() + name("") + b"\0\1\0\1", header() + b"\x04\xff\xfe\xc3\xa9\0\0\1\0\1", header() + QUESTION + b"tail"]
    for _ in range(60):
        parts = [[rng.choice(rr) for _ in range(rng.choice([0, 1, 2, 5]))] for _ in range(3)]
        counts = (1, len(parts[0]), len(parts[1]), len(parts[2]) + 1)
        bodies.append(header(rng.choice([0x8180, 0x8180, 0x0100]), counts) + QUESTION + b"".join(sum(parts, [])) + opt)
    values = [*mutated(rng, bodies), None, b""]
    values = [v for v in values if v is None or len(v) >= 12]

    def one(v):
        try:
            return None if v is None else {"body_error": None, **wire.decode_message(v, with_rrs)}
        except wire.Malformed as problem:
            return {f.name: None for f in decode._BODY} | {"body_error": f"error: {problem}"}

    column = pa.array([b"x", *values], pa.binary()).slice(1)
    got = columnar.bodies(column, with_rrs, decode._BODY).to_pylist()
    assert got == [one(v) for v in values]
    assert sum(g is not None and g["body_error"] is None for g in got) > 500 and sum(g is not None and g["body_error"] is not None for g in got) > 500
    assert columnar.bodies(pa.array([], pa.binary()), with_rrs, decode._BODY).to_pylist() == []


def test_columns_equal_frames_decoded_one_by_one():
    rng = random.Random(8)

    def varint(n):
        return bytes([n & 0x7F | 0x80]) + varint(n >> 7) if n > 127 else bytes([n])

    number = lambda f, n: varint(f << 3) + varint(n)
    data = lambda f, b: varint(f << 3 | 2) + varint(len(b)) + b
    fixed = lambda f, n: varint(f << 3 | 5) + struct.pack("<I", n)
    frames = [b"", number(15, 1), data(14, b"")]
    for _ in range(60):
        policy = data(15, data(2, rng.choice([b"rule", b"\xff\xfe", "réglé".encode()])) + rng.choice([b"", number(3, rng.randrange(9))]))
        inner = [number(1, rng.randrange(9)), number(2, 1), number(3, 300), data(4, b"\1\2\3\4"), data(5, bytes(16)), number(6, 53), number(8, 1 << 33), fixed(9, 7),
                 data(10, header()), number(12, 5), fixed(13, 1 << 31), data(14, b""), policy, varint(20 << 3 | 1) + bytes(8), number(1, 4)]
        rng.shuffle(inner)
        frames.append(number(15, 1) + data(3, rng.choice([b"rtt=5", b"", b"\xff"])) + data(14, b"".join(inner[: rng.randrange(1, 16)])) + rng.choice([b"", data(3, b"last")]))
    values = [*mutated(rng, frames), None]

    def one(v):
        return None if v is None else {f.name: None for f in decode._TAP} | decode._tap_fields(v)

    got = columnar.taps(pa.array(values, pa.binary()), decode._TAP, decode.MESSAGE_FIELDS, decode._BINARY, decode._tap_fields, decode.TAP_EXTRA,
                        decode.TAP_MESSAGE, decode.POLICY_FIELD, decode.POLICY_RULE, decode.POLICY_ACTION).to_pylist()
    assert got == [one(v) for v in values]
    assert sum(g is not None and g["frame_error"] is None for g in got) > 500


def test_splits_are_dealt_to_several_tasks_of_each_core(spark):
    """Few splits hold unlike shares of the rows of a compact file, so no task may have to take one whole."""
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 1000, 1, cores).selectExpr("IF(id < 900, 0, id) AS id")
    assert views.spread(rows).rdd.getNumPartitions() == 4 * cores and views.spread(rows).count() == 1000
    assert views.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
    many = spark.range(0, 10, 1, 4 * cores)
    assert views.spread(many) is many


@pytest.mark.parametrize("value", [0, 1, 127, 128, 300, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**32 - 1, 1_700_000_000])
def test_varints(spark, value):
    data, v = bytearray(), value
    while v > 127:
        data.append(v & 127 | 128)
        v >>= 7
    data.append(v)
    got = spark.range(1).select(F.unhex(wireviews._varint(F.col("id") + value))).first()[0]
    assert bytes(got) == bytes(data)
