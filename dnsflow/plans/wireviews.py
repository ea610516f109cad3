"""Captured bytes derived from the message view: packets, dnstap frames, TCP segments.

Every byte comes from Spark expressions over `events`, so decoding jobs can be checked
against the formulas the bytes were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.addresses import hex_fixed
from dnsflow.functions.binding import stage
from dnsflow.schema import RR_LIST, TCP, UDP


def u8(value) -> Column:
    return hex_fixed(value if isinstance(value, Column) else F.lit(value), 2)


def u16(value) -> Column:
    return hex_fixed(value if isinstance(value, Column) else F.lit(value), 4)


def u32(value) -> Column:
    return hex_fixed(value if isinstance(value, Column) else F.lit(value), 8)


def _bit(column: str, weight: int) -> Column:
    return F.when(F.col(column), weight).otherwise(0)


def _option() -> Column:
    data = F.coalesce(F.hex("opt_rdata"), F.lit(""))
    present = F.col("opt_rdata").isNotNull() | (F.col("edns_udp") > 0)
    record = F.concat(
        F.lit("000029"), u16(F.col("edns_udp")), F.lit("0000"), u16(_bit("edns_do", 0x8000)),
        u16(F.length(data) / 2), data,
    )
    return F.when(present, record).otherwise("")


def dns_hex() -> Column:
    """DNS message of a row: header, question, compressed answers, a final SOA, EDNS."""
    k = F.col("msg_id")
    answers = F.coalesce(F.col("answer_rrs"), F.array().cast(RR_LIST))
    claimed = F.size(answers) + _bit("last_soa", 1) + F.when(k % 41 == 0, 60_000).otherwise(0)
    third = _bit("is_response", 128) + _bit("aa", 4) + _bit("tc", 2) + _bit("rd", 1)
    fourth = _bit("ra", 128) + _bit("ad", 32) + _bit("cd", 16) + F.col("rcode")
    records = F.array_join(F.transform(answers, lambda r: F.concat(
        F.lit("C00C00010001"), u32(r["ttl"]), F.lit("0004C00002"), u8(r["ttl"] - 300)
    )), "")
    soa = F.when(
        F.col("last_soa"),
        F.concat(F.lit("C00C0006000100000E100018C00CC00C"), F.lit("0000000A" * 5)),
    ).otherwise("")
    return F.concat(
        u16(F.col("id")), u8(third), u8(fourth), F.lit("0001"), u16(claimed), F.lit("0000"),
        u16(F.when(F.col("opt_hex") != "", 1).otherwise(0)),
        F.hex("qname_wire"), u16(F.col("qtype")), u16(F.col("qclass")), records, soa, F.col("opt_hex"),
    )


def _sides() -> dict[str, Column]:
    back = F.col("is_response")
    return {
        f"{end}_{what}": F.when(back == flip, F.col(f"server_{what}")).otherwise(F.col(f"client_{what}"))
        for end, flip in (("src", True), ("dst", False))
        for what in ("ip", "port")
    }


def _frame(prot: Column, body: Column) -> Column:
    """Ethernet and IP headers around transport bytes given as hex."""
    size = F.length(body) / 2
    v4 = F.concat(
        F.lit("4500"), u16(size + 20), F.lit("00000000"), u8(F.col("ttl")), u8(prot), F.lit("0000"),
        F.hex("src_ip"), F.hex("dst_ip"),
    )
    v6 = F.concat(
        F.lit("60000000"), u16(size), u8(prot), u8(F.col("ttl")), F.hex("src_ip"), F.hex("dst_ip")
    )
    k = F.col("msg_id")
    kind = F.when(k % 31 == 0, "0806").when(F.col("ipv") == 6, "86DD").otherwise("0800")
    head = F.when(F.col("ipv") == 6, v6).otherwise(v4)
    return F.concat(F.lit("00" * 12), kind, head, body)


def udp_packets(messages: DataFrame) -> DataFrame:
    """One packet per UDP message; some are cut off, of another protocol, or claim too much."""
    k = F.col("msg_id")
    rows = stage(messages.filter(F.col("prot") == UDP), {**_sides(), "opt_hex": _option()})
    rows = stage(rows, {"dns": dns_hex()})
    prot = F.when(k % 37 == 0, 1).otherwise(UDP)
    datagram = F.concat(
        u16(F.col("src_port")), u16(F.col("dst_port")), u16(F.length("dns") / 2 + 8),
        u16(F.col("udp_sum")), F.col("dns"),
    )
    rows = stage(rows, {"datagram": datagram})
    whole = stage(rows, {"payload": F.unhex(_frame(prot, F.col("datagram")))})
    return whole.select(
        F.lit("events").alias("source"), k.alias("packet_no"), "ts", F.lit("WIRE").alias("kind"),
        F.lit(False).alias("raw_ip"),
        F.when(k % 29 == 0, F.substring("payload", 1, 50)).otherwise(F.col("payload")).alias("payload"),
    )


def _varint(value: Column, most: int = 5) -> Column:
    """Seven bits to a byte, the lowest first, in at most so many bytes; only the branch that fits is made."""
    v = value.cast("bigint")

    def coded(size: int) -> Column:
        parts = [F.shiftright(v, 7 * i).bitwiseAND(127).bitwiseOR(128 if i < size - 1 else 0) for i in range(size)]
        number = parts[0]
        for part in parts[1:]:
            number = number * 256 + part
        return F.hex(number)  # all bytes but the last have their highest bit set: no digit is missing

    out = F.when(v < 1 << 7, hex_fixed(v, 2))
    for size in range(2, most):
        out = out.when(v < 1 << 7 * size, coded(size))
    return out.otherwise(coded(most))


def _number(field: int, value: Column) -> Column:
    return F.concat(_varint(F.lit(field << 3)), _varint(value))


def _bytes(field: int, digits: Column) -> Column:
    """`digits` is used twice: give it a column, not a long expression."""
    return F.concat(_varint(F.lit(field << 3 | 2)), _varint(F.octet_length(digits) / 2, 4), digits)


def _little32(value: Column) -> Column:
    """A number of up to 32 bits, lowest byte first."""
    big = u32(value)
    return F.concat(*[F.substring(big, p, 2) for p in (7, 5, 3, 1)])


def _text(value: Column) -> Column:
    return F.hex(F.encode(value, "UTF-8"))


def tap_frames(messages: DataFrame) -> DataFrame:
    """One dnstap frame per message of every protocol; some lack their type or ports."""
    k, response = F.col("msg_id"), F.col("is_response")
    us = F.unix_micros("ts")
    second, nano = F.floor(us / 1_000_000), us % 1_000_000 * 1000
    action = F.col("policy_action")
    chosen = F.when(action == 128, 3).when(action == 129, 1).when(action == 255, 6)
    extra = F.concat(
        F.lit("user_key="), F.col("user_id"), F.lit("\n"),
        F.when(F.col("tcp_rtt_us") >= 0, F.concat(F.lit("rtt="), F.col("tcp_rtt_us"), F.lit("\n"))).otherwise(""),
    )
    # Every field is named before it is measured, so that nothing is made twice.
    rows = stage(stage(messages, {"opt_hex": _option()}), {"dns": dns_hex()})
    rows = stage(rows, {
        "rule": _text(F.coalesce("policy_rule", F.lit(""))), "extra": _text(extra),
        "client": F.hex("client_ip"), "server": F.hex("server_ip"),
    })
    rows = stage(rows, {"policy": F.concat(
        _bytes(2, F.col("rule")), F.when(chosen.isNull(), "").otherwise(_number(3, F.coalesce(chosen, F.lit(0)))),
    )})
    # Short expressions in several steps: a generated method that is too long is never compiled.
    rows = stage(rows, {"head": F.concat(
        F.when(k % 43 == 0, "").otherwise(_number(1, F.when(response, 6).otherwise(5))),
        _number(2, F.when(F.col("ipv") == 4, 1).otherwise(2)),
        _number(3, F.when(F.col("prot") == UDP, 1).otherwise(2)),
        _bytes(4, F.col("client")), _bytes(5, F.col("server")),
    )})
    rows = stage(rows, {"head": F.concat(
        F.col("head"), F.when(k % 47 == 0, "").otherwise(_number(6, F.col("client_port"))), _number(7, F.col("server_port")),
    )})
    rows = stage(rows, {"time": F.concat(
        F.when(response, _varint(F.lit(12 << 3))).otherwise(_varint(F.lit(8 << 3))), _varint(second),
        F.when(response, _varint(F.lit(13 << 3 | 5))).otherwise(_varint(F.lit(9 << 3 | 5))), _little32(nano),
    )})
    rows = stage(rows, {"sent": F.concat(
        F.when(response, _varint(F.lit(14 << 3 | 2))).otherwise(_varint(F.lit(10 << 3 | 2))), _varint(F.octet_length("dns") / 2, 4), F.col("dns"),
    )})
    rows = stage(rows, {"body": F.concat("head", "time", "sent", F.when(action == 0, "").otherwise(_bytes(15, F.col("policy"))))})
    frame = F.concat(_number(15, F.lit(1)), _bytes(3, F.col("extra")), _bytes(14, F.col("body")))
    return rows.select(k.alias("packet_no"), "ts", F.unhex(frame).alias("payload"))


def segments(messages: DataFrame) -> DataFrame:
    """TCP segments: one connection per event with TCP messages and its handshake.

    Queries travel on side 0, responses on side 1, the messages of a side back to back. By event
    number some messages are cut in two (also inside their length prefix), some pieces come in
    reversed order, some are sent twice, some connections miss their SYN and sequence numbers start
    just below 2^32 for some. Three seconds later some connections are closed by both sides, some
    by one, some are reset; what comes after a side's FIN, the close or the reset would be a message.
    """
    rows = stage(stage(messages.filter(F.col("prot") == TCP), {"opt_hex": _option()}), {
        "e": F.floor(F.col("msg_id") / 10).cast("bigint"),
        "n": F.col("msg_id") % 5,
        "dns": dns_hex(),
        "t": F.unix_micros("ts"),
    })
    e = F.col("e")
    rows = stage(rows, {
        "framed": F.unhex(F.concat(u16(F.length("dns") / 2), F.col("dns"))),
        "side": F.col("is_response").cast("int"),
    })
    size = F.octet_length("framed")
    isn = F.when(e % 5 == 0, (1 << 32) - 20).otherwise(e * 1000 % 100_000)
    # All earlier messages of a side are as long as this one; only the last of a transfer has a SOA more.
    before = F.col("n") * (size - _bit("last_soa", 36))
    first = F.pmod(isn + F.col("side") * 500 + 1 + before, F.lit(1 << 32))
    cut = F.when(e % 9 == 0, 1).when(e % 3 == 0, 10).otherwise(size)
    later = F.when(e % 6 == 0, -2).otherwise(2)

    def piece(order: int, start: Column, length: Column, wait: Column) -> Column:
        return F.struct(
            F.col("side"), (F.col("t") + wait).alias("t"), (F.col("msg_id") * 10 + order).alias("seg_no"),
            F.pmod(first + start, F.lit(1 << 32)).alias("seq"),
            F.substring("framed", (start + 1).cast("int"), length.cast("int")).alias("data"),
            F.lit(False).alias("syn"), F.lit(True).alias("ack_flag"), F.lit(0).cast("bigint").alias("ack"),
            F.lit(False).alias("fin"), F.lit(False).alias("rst"),
        )

    pieces = F.array_compact(F.array(
        piece(0, F.lit(0), cut, F.lit(0)),
        F.when(cut < size, piece(1, cut, size - cut, later)),
        F.when(e % 7 == 0, piece(2, F.lit(0), cut, F.lit(5))),
    ))
    # The handshake comes before both the query and an early response.
    opens = ~F.col("is_response") & (F.col("n") == 0) & (e % 11 != 0)
    base = F.pmod(isn, F.lit(1 << 32))
    server = F.pmod(isn + 500, F.lit(1 << 32))
    plus = lambda c: F.pmod(c + 1, F.lit(1 << 32))

    def control(order: int, side: int, wait: Column, seq: Column, ack: Column, syn: bool, acked: bool) -> Column:
        return F.struct(
            F.lit(side).alias("side"), (F.col("t") - 400_000 + wait).alias("t"),
            (F.col("msg_id") * 10 + 5 + order).alias("seg_no"), seq.alias("seq"),
            F.lit(b"").alias("data"), F.lit(syn).alias("syn"), F.lit(acked).alias("ack_flag"),
            ack.alias("ack"), F.lit(False).alias("fin"), F.lit(False).alias("rst"),
        )

    shake = F.array(
        control(0, 0, F.lit(0), base, F.lit(0).cast("bigint"), True, False),
        control(1, 1, F.lit(1000), server, plus(base), True, True),
        control(2, 0, F.lit(2000) + e % 5000, plus(base), plus(server), False, True),
    )
    transfer = e % 97 == 0
    sent = size * F.when((e % 13 == 0) & ~transfer, 2).otherwise(1)
    answer = 18 + F.octet_length("qname_wire") + 16 * (e % 4 + 1) + F.when(e % 9 == 0, 18).otherwise(0)
    answered = F.when(transfer, 4 * answer + 36).when(e % 10 == 3, 0).otherwise(answer * F.when(e % 26 == 0, 2).otherwise(1))
    ends = (F.pmod(base + 1 + sent, F.lit(1 << 32)), F.pmod(server + 1 + answered, F.lit(1 << 32)))
    late_message = F.unhex(F.lit("0012" + "00" * 18))

    def closing(order: int, side: int, flag: str, seq: Column, ack: Column, data: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"), (F.col("t") + 3_000_000 + order).alias("t"),
            (F.col("msg_id") * 10 + 20 + order).alias("seg_no"), seq.alias("seq"), data.alias("data"),
            F.lit(False).alias("syn"), F.lit(flag != "rst").alias("ack_flag"), ack.alias("ack"),
            F.lit(flag == "fin").alias("fin"), F.lit(flag == "rst").alias("rst"),
        )

    nothing = F.lit(b"")
    half = [closing(0, 0, "fin", ends[0], ends[1], nothing), closing(1, 0, "ack", ends[0], ends[1], late_message)]
    whole = [
        *half, closing(2, 1, "ack", ends[1], plus(ends[0]), nothing), closing(3, 1, "fin", ends[1], plus(ends[0]), nothing),
        closing(4, 0, "ack", plus(ends[0]), plus(ends[1]), nothing), closing(5, 1, "ack", ends[1], plus(ends[0]), late_message),
    ]
    reset = [closing(0, 0, "rst", ends[0], ends[1], nothing), closing(1, 1, "ack", ends[1], ends[0], late_message)]
    close = F.when(e % 4 == 1, F.array(*whole)).when(e % 4 == 2, F.array(*half)).when(e % 4 == 3, F.array(*reset))
    # The events are derived once: a message's own segments and those that open and close its connection come from one row.
    made = stage(rows, {"pieces": pieces, "shake": F.when(opens, shake), "close": F.when(opens, close)})
    flow = ["client_ip", "server_ip", "client_port", "server_port", "ttl", "ipv", "prot"]
    none = F.filter("pieces", lambda p: F.lit(False))
    every = made.select("e", *flow, F.inline(F.concat("pieces", F.coalesce("shake", none), F.coalesce("close", none))))
    back = F.col("side") == 1
    endpoints = [
        F.when(back == flip, F.col(f"server_{what}")).otherwise(F.col(f"client_{what}")).alias(f"{end}_{what}")
        for end, flip in (("src", True), ("dst", False)) for what in ("ip", "port")
    ]
    return every.select(
        *endpoints, "ttl", "ipv", "prot",
        F.concat(F.lit("c"), e).alias("conn"), "side", F.timestamp_micros("t").alias("ts"),
        "seg_no", "seq", "ack", "syn", "ack_flag", "fin", "rst", "data", (F.octet_length("data") + 54).alias("packet_len"),
    )


def tcp_packets(messages: DataFrame) -> DataFrame:
    """The segments as captured packets, headers included."""
    flags = (
        F.col("fin").cast("int") + F.col("syn").cast("int") * 2 + F.col("rst").cast("int") * 4
        + F.col("ack_flag").cast("int") * 16
    )
    rows = segments(messages).withColumn("msg_id", F.lit(1))
    header = F.concat(
        u16(F.col("src_port")), u16(F.col("dst_port")), u32(F.col("seq")), u32(F.col("ack")),
        F.lit("50"), u8(flags), F.lit("FFFF00000000"), F.hex("data"),
    )
    rows = stage(rows, {"datagram": header})
    return rows.select(
        F.lit("events").alias("source"), F.col("seg_no").alias("packet_no"), "ts",
        F.lit("WIRE").alias("kind"), F.lit(False).alias("raw_ip"),
        F.unhex(_frame(F.lit(TCP), F.col("datagram"))).alias("payload"),
    )
