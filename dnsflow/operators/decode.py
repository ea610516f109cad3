"""Packets to messages.

Two stages. Link, IP, transport and DNS headers are Spark expressions, so filters on
ports and addresses run before anything leaves the JVM. Names, records and options have
variable length; an Arrow UDF reads just the DNS bytes of the surviving rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions import codes
from dnsflow.functions.addresses import byte_at, uint
from dnsflow.functions.binding import stage
from dnsflow.operators import columnar, filters, wire
from dnsflow.schema import DNS_PORT, MESSAGES, RR_LIST, TCP, UDP, column_names

ETHERTYPES = ("0800", "86DD")

BODY_TYPE = (
    "struct<qname:string,qname_wire:binary,qtype:int,qclass:int,edns_udp:int,edns_version:int,"
    "edns_do:boolean,ext_rcode:int,opt_rdata:binary,last_soa:boolean,"
    f"answer_rrs:{RR_LIST},authority_rrs:{RR_LIST},additional_rrs:{RR_LIST},body_error:string>"
)
_RR = pa.list_(pa.struct([
    ("name", pa.string()), ("type", pa.int32()), ("class", pa.int32()), ("ttl", pa.int64()),
    ("rdata", pa.string()),
]))
_BODY = pa.struct([
    ("qname", pa.string()), ("qname_wire", pa.binary()), ("qtype", pa.int32()),
    ("qclass", pa.int32()), ("edns_udp", pa.int32()), ("edns_version", pa.int32()),
    ("edns_do", pa.bool_()), ("ext_rcode", pa.int32()), ("opt_rdata", pa.binary()),
    ("last_soa", pa.bool_()), ("answer_rrs", _RR), ("authority_rrs", _RR),
    ("additional_rrs", _RR), ("body_error", pa.string()),
])


def _body_udf(with_rrs: bool):
    @F.arrow_udf(BODY_TYPE)
    def decode_body(values: pa.Array) -> pa.Array:
        return columnar.bodies(values, with_rrs, _BODY)

    return decode_body


def _tail(binary: Column, start: Column) -> Column:
    return F.substring(binary, start, F.octet_length(binary))


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for condition, reason in reversed(checks):
        out = F.when(condition, reason).otherwise(out)
    return out


def decode_headers(packets: DataFrame) -> DataFrame:
    """Link, IP and transport headers; `error` tells why a packet goes no further.

    Reasons starting with `drop:` mark traffic that is simply not DNS, `error:` marks
    malformed packets.
    """
    raw = F.col("raw_ip")
    size = F.octet_length("payload")
    link = stage(packets, {
        "len": size.cast("int"),
        "l3": F.when(raw, F.col("payload")).otherwise(F.substring("payload", F.lit(15), size)),
        "error": _first(
            (~raw & (size < 14), "error: link header cut off"),
            (~raw & ~F.hex(F.substring("payload", 13, 2)).isin(*ETHERTYPES), "drop: not IP"),
        ),
    })
    l3 = F.col("l3")
    first = F.col("first")
    version = F.call_function("shiftright", first, F.lit(4))
    ip = stage(link.withColumn("first", F.when(F.octet_length("l3") > 0, byte_at(F.col("l3"), 1))), {
        "ipv": F.when(version.isin(4, 6), version).cast("int"),
        "head": F.when(version == 4, first.bitwiseAND(15) * 4).when(version == 6, 40),
        "claimed": F.when(version == 4, uint(F.substring(l3, 3, 2)))
        .when(version == 6, uint(F.substring(l3, 5, 2)) + 40),
        "prot": F.when(version == 4, byte_at(l3, 10)).when(version == 6, byte_at(l3, 7)),
        "ttl": F.when(version == 4, byte_at(l3, 9)).when(version == 6, byte_at(l3, 8)),
        "src_ip": F.when(version == 4, F.substring(l3, 13, 4)).when(version == 6, F.substring(l3, 9, 16)),
        "dst_ip": F.when(version == 4, F.substring(l3, 17, 4)).when(version == 6, F.substring(l3, 25, 16)),
    })
    ip = ip.drop("first")
    have = F.octet_length("l3")
    least = F.greatest(F.col("head"), F.when(F.col("ipv") == 4, 20).otherwise(40))
    ip = stage(ip, {
        "error": F.coalesce("error", _first(
            (have == 0, "error: IP header missing"),
            (F.col("ipv").isNull(), "drop: unknown IP version"),
            (have < least, "error: IP header cut off"),
            (~F.col("prot").isin(TCP, UDP), "drop: not TCP or UDP"),
            (F.col("claimed") > have, "error: packet shorter than its IP header claims"),
        )),
        "l4": F.substring(
            "l3", F.col("head") + 1, F.greatest(F.col("claimed") - F.col("head"), F.lit(0)).cast("int")
        ),
    }).drop("l3")
    l4, udp = F.col("l4"), F.col("prot") == UDP
    have = F.octet_length(l4)
    offset = F.when(udp, 8).otherwise(F.call_function("shiftright", byte_at(l4, 13), F.lit(4)) * 4)
    flags = byte_at(l4, 14)
    ok = F.col("error").isNull()
    transport = stage(ip, {
        "error": F.coalesce("error", _first(
            (udp & (have < 8), "error: UDP header cut off"),
            (~udp & ((have < 20) | (have < offset)), "error: TCP header cut off"),
        )),
        "src_port": F.when(ok, uint(F.substring(l4, 1, 2))).cast("int"),
        "dst_port": F.when(ok, uint(F.substring(l4, 3, 2))).cast("int"),
        "udp_sum": F.when(ok & udp, uint(F.substring(l4, 7, 2))).when(ok, 0).cast("int"),
        "seq": F.when(~udp, uint(F.substring(l4, 5, 4))),
        "ack": F.when(~udp, uint(F.substring(l4, 9, 4))),
        **{
            name: F.when(~udp, codes.flag(flags, mask))
            for name, mask in (("fin", 1), ("syn", 2), ("rst", 4), ("ack_flag", 16))
        },
        "body": F.when(ok, _tail(l4, offset + 1)),
    })
    return transport.drop("l4", "head", "claimed")


def decode_dns(df: DataFrame, with_rrs: bool = False) -> DataFrame:
    """DNS header by expressions, question and records by one Arrow pass over `body`.

    Needs body, src/dst addresses and ports, len; adds the message columns, the
    direction and `error`.
    """
    df = df.withColumn("body", F.when(F.col("error").isNull(), F.col("body")))
    body = F.col("body")
    size = F.octet_length(body)
    third, fourth = byte_at(body, 3), byte_at(body, 4)
    head = stage(df, {
        "error": F.coalesce("error", _first(
            (size == 0, "error: no DNS data"), (size < 12, "error: DNS header cut off"),
        )),
        "id": uint(F.substring(body, 1, 2)).cast("int"),
        "is_response": codes.flag(third, 0x80),
        "opcode": F.call_function("shiftright", third.bitwiseAND(0x78), F.lit(3)),
        "aa": codes.flag(third, 0x04), "tc": codes.flag(third, 0x02), "rd": codes.flag(third, 0x01),
        "ra": codes.flag(fourth, 0x80), "z": codes.flag(fourth, 0x40),
        "ad": codes.flag(fourth, 0x20), "cd": codes.flag(fourth, 0x10),
        "low_rcode": fourth.bitwiseAND(0x0F),
        **{
            name: uint(F.substring(body, 5 + 2 * i, 2)).cast("int")
            for i, name in enumerate(("qdcount", "ancount", "nscount", "arcount"))
        },
        "dns_len": size.cast("int"),
    })
    readable = F.when(F.col("error").isNull(), body)
    parsed = head.withColumn("parsed", _body_udf(with_rrs)(readable)).select("*", "parsed.*")
    response = F.col("is_response")
    named = stage(parsed, {
        "error": F.coalesce("error", "body_error"),
        "rcode": F.col("low_rcode").bitwiseOR(
            F.call_function("shiftleft", F.coalesce("ext_rcode", F.lit(0)), F.lit(4))
        ),
        **{
            f"{side}_{what}": F.when(response == on, F.col(f"dst_{what}"))
            .when(response.isNotNull(), F.col(f"src_{what}"))
            for side, on in (("client", True), ("server", False))
            for what in ("ip", "port")
        },
    })
    return named.drop("parsed", "body_error", "low_rcode", "ext_rcode")


# Columns a source may lack, with the value they then have.
DEFAULTS = {
    "tcp_rtt_us": ("bigint", -1),
    "user_id": ("string", ""),
    "policy_action": ("int", 0),
    "policy_rule": ("string", None),
    "ttl": ("int", 0),
    "udp_sum": ("int", 0),
    "len": ("int", 0),
}


def as_messages(decoded: DataFrame) -> DataFrame:
    """Valid decoded rows in the message schema; the packet number is the message id."""
    valid = decoded.filter(F.col("error").isNull())
    if "msg_id" not in decoded.columns:
        valid = valid.withColumnRenamed("packet_no", "msg_id")
    missing = {c: F.lit(v).cast(t) for c, (t, v) in DEFAULTS.items() if c not in decoded.columns}
    return valid.withColumns(missing).select(*column_names(MESSAGES))


def split_invalid(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid messages, malformed packets); dropped traffic is in neither."""
    return as_messages(decoded), decoded.filter(F.col("error").startswith("error:"))


def decode_packets(
    packets: DataFrame, ports=(DNS_PORT,), allow=(), deny=(), with_rrs: bool = False
) -> DataFrame:
    """UDP packets decoded, with `error` set on malformed ones.

    Filters on transport, ports and address lists run on the native header columns first.
    """
    headers = decode_headers(packets)
    known = headers.filter(F.col("error").isNull() | F.col("error").startswith("error:"))
    allowed = filters.cidr_filter(known, allow, deny, columns=("src_ip", "dst_ip"))
    on_port = F.col("src_port").isin(sorted(ports)) | F.col("dst_port").isin(sorted(ports))
    wanted = allowed.filter(F.col("error").isNotNull() | ((F.col("prot") == UDP) & on_port))
    return decode_dns(wanted, with_rrs)


def tcp_segments(packets: DataFrame, ports=(DNS_PORT,), allow=(), deny=()) -> DataFrame:
    """TCP segments of the packets, keyed by connection; side 1 is the one with a DNS port."""
    headers = decode_headers(packets).filter(F.col("error").isNull() & (F.col("prot") == TCP))
    wanted = filters.cidr_filter(headers, allow, deny, columns=("src_ip", "dst_ip"))
    wanted = filters.dns_port_filter(wanted, ports, columns=("src_port", "dst_port"))
    server = F.col("src_port").isin(sorted(ports))
    conn = F.concat_ws(
        "/", F.hex(F.least("src_ip", "dst_ip")), F.hex(F.greatest("src_ip", "dst_ip")),
        F.least("src_port", "dst_port"), F.greatest("src_port", "dst_port"),
    )
    return wanted.select(
        conn.alias("conn"), server.cast("int").alias("side"), "ts",
        F.col("packet_no").alias("seg_no"), "seq", "ack", "syn", "ack_flag", "fin", "rst",
        F.col("body").alias("data"), F.col("len").alias("packet_len"),
        "src_ip", "dst_ip", "src_port", "dst_port", "ttl", "ipv", "prot",
    )


# Field numbers of the dnstap messages.
TAP_EXTRA, TAP_MESSAGE = 3, 14
MESSAGE_FIELDS = {
    "kind": 1, "family": 2, "protocol": 3, "query_address": 4, "response_address": 5,
    "query_port": 6, "response_port": 7, "query_sec": 8, "query_nsec": 9, "query_message": 10,
    "response_sec": 12, "response_nsec": 13, "response_message": 14,
}
POLICY_FIELD, POLICY_RULE, POLICY_ACTION = 15, 2, 3
_BINARY = ("query_address", "response_address", "query_message", "response_message")
TAP_TYPE = "struct<" + ",".join(
    f"{n}:{'binary' if n in _BINARY else 'bigint'}" for n in MESSAGE_FIELDS
) + ",extra:string,policy:boolean,action:int,rule:string,frame_error:string>"
_TAP = pa.struct(
    [(n, pa.binary() if n in _BINARY else pa.int64()) for n in MESSAGE_FIELDS]
    + [("extra", pa.string()), ("policy", pa.bool_()), ("action", pa.int32()),
       ("rule", pa.string()), ("frame_error", pa.string())]
)


def _tap_fields(frame: bytes) -> dict:
    try:
        top = wire.protobuf_fields(frame)
        wire.need(TAP_MESSAGE in top, "dnstap message content missing")
        wire.need(isinstance(top[TAP_MESSAGE], bytes), "unexpected field encoding")
        inner = wire.protobuf_fields(top[TAP_MESSAGE])
        policy = inner.get(POLICY_FIELD)
        wire.need(policy is None or isinstance(policy, bytes), "unexpected field encoding")
        rules = wire.protobuf_fields(policy) if policy is not None else {}
        out = {n: inner.get(number) for n, number in MESSAGE_FIELDS.items()}
        rule = rules.get(POLICY_RULE)
        for n, value in out.items():
            wire.need(value is None or isinstance(value, bytes) == (n in _BINARY), "unexpected field encoding")
            wire.need(not isinstance(value, int) or value < 1 << 63, "number too large")
        wire.need(isinstance(top.get(TAP_EXTRA, b""), bytes) and isinstance(rule or b"", bytes), "unexpected field encoding")
        wire.need(not isinstance(rules.get(POLICY_ACTION), bytes) and (rules.get(POLICY_ACTION) or 0) < 1 << 31, "unexpected policy action")
    except wire.Malformed as problem:
        return {"frame_error": f"error: {problem}"}
    out.update(
        extra=top.get(TAP_EXTRA, b"").decode("utf-8", "replace"), policy=policy is not None,
        action=rules.get(POLICY_ACTION), rule=None if rule is None else rule.decode("utf-8", "replace"),
    )
    return out


def _tap_udf():
    @F.arrow_udf(TAP_TYPE)
    def decode_tap(frames: pa.Array) -> pa.Array:
        return columnar.taps(
            frames, _TAP, MESSAGE_FIELDS, _BINARY, _tap_fields, TAP_EXTRA, TAP_MESSAGE, POLICY_FIELD, POLICY_RULE, POLICY_ACTION
        )

    return decode_tap


def decode_dnstap(
    frames: DataFrame, ports=(DNS_PORT,), allow=(), deny=(), with_rrs: bool = False
) -> DataFrame:
    """dnstap frames (`payload`, `packet_no`, `ts`) decoded into message columns and `error`.

    The time of the frame's query or response is used, else the time it was recorded.
    """
    taps = frames.withColumn("tap", _tap_udf()(F.col("payload"))).select(
        F.col("ts").alias("recorded"), "packet_no", "tap.*"
    )
    response = F.col("kind").isin(*filters.RESPONSE_TYPES)
    pick = lambda name: F.when(response, F.col(f"response_{name}")).otherwise(F.col(f"query_{name}"))
    micros = pick("sec") * codes.MICROS + F.floor(pick("nsec") / 1000)
    taps = stage(taps, {
        "body": pick("message"),
        "ts": F.coalesce(F.timestamp_micros(micros.cast("bigint")), F.col("recorded")),
    })
    reason = filters.dnstap_reject_reason(*[F.col(c) for c in (
        "kind", "family", "query_address", "response_address", "protocol", "query_port",
        "response_port", "body",
    )])
    # The frame names the client side as "query", whichever way the message went; the DNS
    # header decides the direction later, so responses enter with the sides swapped.
    sent_back = F.coalesce(byte_at(F.col("body"), 3) >= 128, F.lit(False))
    side = lambda a, b: F.when(sent_back, F.col(a)).otherwise(F.col(b))
    taps = stage(taps, {"error": F.coalesce("frame_error", reason)})
    named = taps.select(
        "packet_no", "ts", "body", "error",
        F.when(F.col("family") == 1, 4).when(F.col("family") == 2, 6).alias("ipv"),
        filters.dnstap_transport(F.col("protocol")).alias("prot"),
        side("response_address", "query_address").alias("src_ip"),
        side("query_address", "response_address").alias("dst_ip"),
        side("response_port", "query_port").cast("int").alias("src_port"),
        side("query_port", "response_port").cast("int").alias("dst_port"),
        codes.extra_rtt(F.col("extra")).alias("tcp_rtt_us"),
        codes.extra_user(F.col("extra")).alias("user_id"),
        codes.policy_action_code(F.col("policy"), F.col("action")).alias("policy_action"),
        F.col("rule").alias("policy_rule"),
    )
    known = named.filter(F.col("error").isNull() | F.col("error").startswith("error:"))
    allowed = filters.cidr_filter(known, allow, deny, columns=("src_ip", "dst_ip"))
    on_port = F.col("src_port").isin(sorted(ports)) | F.col("dst_port").isin(sorted(ports))
    return decode_dns(allowed.filter(F.col("error").isNotNull() | on_port), with_rrs)
