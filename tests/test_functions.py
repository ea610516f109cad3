import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from dnsflow.functions import addresses, codes, edns, names
from dnsflow.operators import anonymize


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", build(F.col("v"))).collect())]


def addresses_sample():
    rng = random.Random(3)
    out = [ipaddress.ip_address(a) for a in (
        "::", "::1", "1::", "2001:db8::1:0:0:1", "1:0:0:2:0:0:0:3", "0:0:1::", "1:2:3:4:5:6:7:8",
        "1:0:2:0:3:0:4:0", "fe80::", "0.0.0.0", "255.255.255.255", "10.0.0.1",
    )]
    for _ in range(60):
        groups = [rng.choice([0, 0, 0, rng.randrange(65536)]) for _ in range(8)]
        groups[0] = groups[0] or 1
        out.append(ipaddress.ip_address(":".join(f"{g:x}" for g in groups)))
    return out


def test_ip_text(spark):
    sample = addresses_sample()
    got = column(spark, [bytearray(a.packed) for a in sample], "binary", addresses.ip_text)
    # A single zero group is never shortened, the same as in Python's form.
    assert got == [str(a) for a in sample]
    mapped = ["::ffff:1.2.3.4", "::1.2.3.4"]
    raw = [bytes(10) + b"\xff\xff\x01\x02\x03\x04", bytes(12) + b"\x01\x02\x03\x04"]
    assert column(spark, [bytearray(r) for r in raw], "binary", addresses.ip_text) == mapped


def test_ip_binary(spark):
    sample = addresses_sample()
    got = column(spark, [str(a) for a in sample], "string", addresses.ip_binary)
    assert [bytes(g) for g in got] == [a.packed for a in sample]
    bad = ["", "1.2.3", "1.2.3.256", "1.2.3.4.5", "g::", "1:2:3", "1::2::3", ":1::", "12345::", "1:2:3:4:5:6:7:8:9"]
    assert column(spark, bad, "string", addresses.ip_binary) == [None] * len(bad)


def test_parse_cidr(spark):
    rng = random.Random(4)
    texts = [f"{a}/{rng.randrange(a.max_prefixlen + 1)}" for a in addresses_sample()]
    got = column(spark, texts, "string", addresses.parse_cidr)
    for text, p in zip(texts, got):
        net = ipaddress.ip_network(text, strict=False)
        assert (p.family, p.bits, bytes(p.base), bytes(p.last)) == (
            net.version, net.prefixlen, net.network_address.packed, net.broadcast_address.packed)
    assert [p.bits for p in column(spark, ["10.0.0.1", "::1"], "string", addresses.parse_cidr)] == [32, 128]
    bad = ["10.0.0.0/33", "::/129", "x/8", "10.0.0.0/", "10.0.0.0/x"]
    assert all(p.base is None and p.family is None for p in column(spark, bad, "string", addresses.parse_cidr))


def test_names(spark):
    texts = ["", "a", "a.b", "WWW.Example.com", "x" * 63 + ".org"]
    wire = column(spark, texts, "string", names.name_to_wire)
    assert bytes(wire[3]) == b"\x03WWW\x07Example\x03com\x00" and bytes(wire[0]) == b"\x00"
    assert column(spark, wire, "binary", names.wire_to_name) == texts
    assert column(spark, texts, "string", names.domainname) == ["", "a", "a.b", "example.com", "x" * 63 + ".org"]
    assert column(spark, texts, "string", names.label_count) == [0, 1, 2, 3, 2]


def test_edns_options(spark):
    def parsed(hexes):
        rows = column(spark, [bytearray.fromhex(h) for h in hexes], "binary", edns.edns_options)
        return [None if r is None else [(o.code, bytes(o.data)) for o in r] for r in rows]

    assert parsed(["", "00030000", "0003000261620005000108"]) == [[], [], [(3, b"ab"), (5, b"\x08")]]
    # Cut off, too long, trailing bytes.
    assert parsed(["0003", "0003000561", "000300016100"]) == [None, None, None]
    two = bytearray.fromhex("0003000161000300016200080001010010000102")
    assert column(spark, [two], "binary", lambda c: edns.nsid(edns.edns_options(c))) == ["b"]
    assert column(spark, [two], "binary", lambda c: edns.other_codes(edns.edns_options(c))) == ["8,16"]


def test_extra(spark):
    texts = ["rtt=5\n", "rtt=5", "rtt=5\nrtt=x\n", "user_key=a\nuser_key=" + "b" * 37 + "\n", "user_key=\n", ""]
    assert column(spark, texts, "string", codes.extra_rtt) == [5, -1, 5, -1, -1, -1]
    assert column(spark, texts, "string", codes.extra_user) == ["", "", "", "a", "", ""]


# Sample key and addresses of the published prefix-preserving scheme.
SAMPLE_KEY = bytes([
    21, 34, 23, 141, 51, 164, 207, 128, 19, 10, 91, 22, 73, 144, 125, 16,
    216, 152, 143, 131, 121, 121, 101, 39, 98, 87, 76, 45, 42, 132, 34, 2,
])
SAMPLES = {"128.11.68.132": "135.242.180.132", "129.118.74.4": "134.136.186.123"}


def test_scramble_samples(spark):
    plain = [bytearray(ipaddress.ip_address(a).packed) for a in SAMPLES]
    got = column(spark, plain, "binary", lambda c: addresses.ip_text(anonymize.scramble(c, SAMPLE_KEY)))
    assert got == list(SAMPLES.values())


@pytest.mark.parametrize("version, bits", [(4, 32), (6, 128)])
def test_scramble_keeps_prefixes(spark, version, bits):
    rng = random.Random(version)
    base = rng.getrandbits(bits)
    values = [base] + [base ^ (1 << k) for k in range(0, bits, 7)]
    raw = [bytearray(v.to_bytes(bits // 8, "big")) for v in values]
    got = [int.from_bytes(g, "big") for g in column(
        spark, raw, "binary", lambda c: anonymize.scramble(c, SAMPLE_KEY))]
    shared = lambda a, b: bits - (a ^ b).bit_length()
    for i in range(len(values)):
        for j in range(i):
            assert shared(values[i], values[j]) == shared(got[i], got[j])


def test_anonymize_without_broadcast(spark, messages):
    """The join back gives what each row would compute by itself, broadcast or not."""
    rows = messages.select("msg_id", "client_ip").unionByName(
        spark.sql("select cast(-1 as bigint) as msg_id, cast(null as binary) as client_ip")
    )
    plain = lambda df: {(r[0], None if r[1] is None else bytes(r[1])) for r in df.collect()}
    expected = plain(rows.withColumn("client_ip", anonymize.scramble(F.col("client_ip"), SAMPLE_KEY)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in (limit, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert plain(anonymize.anonymize_ip(rows, SAMPLE_KEY)) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_dots_inside_labels(spark):
    wires = [b"\x03a.b\x03com\x00", b"\x03www\x07example\x03org\x00", b"\x00", b"\x2e" + b"q" * 46 + b"\x02cz\x00"]
    df = spark.createDataFrame([(bytearray(w),) for w in wires], "w binary")
    got = df.select(names.labels_and_domain(F.col("w")).alias("p"), names.has_inner_dot(F.col("w")).alias("d")).select("p.*", "d").collect()
    assert [tuple(r) for r in got] == [(2, "a.b.com", True), (3, "example.org", False), (0, "", False), (2, "q" * 46 + ".cz", True)]


def test_file_names(spark):
    rows = [
        ("dns_20240102.030405.678901.p0.parquet", "p0", "parquet", False),
        ("x.y-20240102.030405.678901.p123.json.gz", "p123", "json", True),
        ("20240102.030405.678901.stats.json", "stats", "json", False),
        ("dns_20240102.030405.678901.p0.parquet.part", None, None, None),
        ("dns_20240102.030405.678.p0.parquet", None, None, None), ("a.b", None, None, None), ("", None, None, None),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, name string")
    got = df.select("k", *[c.alias(n) for n, c in codes.file_name_parts(F.col("name")).items()]).orderBy("k").collect()
    assert [(r.process, r.format, r.gzip) for r in got] == [r[1:] for r in rows]
    assert got[0].time_ms == got[1].time_ms == 1704164645678
