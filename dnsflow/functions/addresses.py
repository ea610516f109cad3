"""IP address expressions over BINARY columns of 4 or 16 bytes."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsflow.functions.binding import let


def byte_at(binary: Column, pos: int) -> Column:
    """Unsigned value of the byte at 1-based `pos`."""
    return F.conv(F.hex(F.substring(binary, pos, 1)), 16, 10).cast("int")


def uint(binary: Column) -> Column:
    """Big-endian unsigned value of up to seven bytes."""
    return F.conv(F.hex(binary), 16, 10).cast("bigint")


def hex_fixed(value: Column, digits: int) -> Column:
    """Lower-case hexadecimal text of a number, zero-padded."""
    return F.lpad(F.lower(F.hex(value.cast("bigint"))), digits, "0")


def family(ip: Column) -> Column:
    return F.when(F.octet_length(ip) == 4, 4).when(F.octet_length(ip) == 16, 6)


def first_octet(ip: Column) -> Column:
    return byte_at(ip, 1)


def _dotted(ip: Column, start: int = 1) -> Column:
    return F.concat_ws(".", *[byte_at(ip, start + i).cast("string") for i in range(4)])


def _shortened(text: Column) -> Column:
    """The first longest run of two or more zero groups becomes `::`."""
    out = text
    for n in range(2, 9):  # the longest run is tested last, so it wins
        run = f"^(.*?)(^|:)0(:0){{{n - 1}}}(:|$)(.*)$"
        out = F.when(text.rlike(run), F.regexp_replace(text, run, "$1::$5")).otherwise(out)
    return out


def _colon(ip: Column) -> Column:
    h = F.lower(F.hex(ip))
    groups = [
        F.regexp_replace(F.substring(h, 1 + 4 * i, 4), "^0{1,3}", "") for i in range(8)
    ]
    return let(F.concat_ws(":", *groups), _shortened)


def ip_text(ip: Column) -> Column:
    """Usual text form: dotted IPv4, compressed IPv6 (mapped IPv4 keeps its dotted tail)."""
    head = F.hex(F.substring(ip, 1, 12))
    low = F.hex(F.substring(ip, 13, 2))
    v6 = (
        F.when(head == "00000000000000000000FFFF", F.concat(F.lit("::ffff:"), _dotted(ip, 13)))
        .when((head == "0" * 24) & (low != "0000"), F.concat(F.lit("::"), _dotted(ip, 13)))
        .otherwise(_colon(ip))
    )
    return F.when(F.octet_length(ip) == 4, _dotted(ip)).when(F.octet_length(ip) == 16, v6)


V4_PATTERN = r"^\d{1,3}(\.\d{1,3}){3}$"


def _v4_hex(text: Column) -> Column:
    def coded(octets: Column) -> Column:
        digits = F.array_join(F.transform(octets, lambda o: hex_fixed(o, 2)), "")
        return F.when(F.forall(octets, lambda o: o <= 255), digits)

    octets = F.transform(F.split(text, "[.]"), lambda o: o.cast("int"))
    return F.when(text.rlike(V4_PATTERN), let(octets, coded))


def _v6_hex(text: Column) -> Column:
    def filled(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    def coded(sides: Column) -> Column:
        missing = F.lit(8) - F.size(sides["left"]) - F.size(sides["right"])
        groups = F.concat(
            sides["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), sides["right"]
        )
        fits = F.when(sides["short"], missing >= 1).otherwise(missing == 0)
        short_groups = F.forall(groups, lambda g: F.length(g) <= 4)
        digits = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        return F.when(fits & short_groups, digits)

    lower = F.lower(text)
    sides = F.struct(
        filled(F.substring_index(lower, "::", 1)).alias("left"),
        F.when(lower.contains("::"), filled(F.substring_index(lower, "::", -1)))
        .otherwise(F.array().cast("array<string>"))
        .alias("right"),
        lower.contains("::").alias("short"),
    )
    shape = text.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$") & ~text.rlike("(^:[^:])|([^:]:$)|(::.*::)|(:::)")
    return F.when(shape, let(sides, coded))


def _address_hex(text: Column) -> Column:
    return F.when(text.contains(":"), _v6_hex(text)).otherwise(_v4_hex(text))


def ip_binary(text: Column) -> Column:
    """BINARY of an address text; null when malformed."""
    return F.unhex(let(text, _address_hex))


def parse_cidr(text: Column) -> Column:
    """`address[/n]` as struct(family, bits, base, last); null fields when malformed.

    Without a length the prefix is the single host; host bits of the base are cleared.
    """
    def edges(p: Column) -> Column:
        whole, rest = (p["bits"] / 4).cast("int"), p["bits"] % 4
        kept = F.substring(p["digits"], F.lit(1), whole)
        keep = F.lit(15) - F.call_function("shiftright", F.lit(15), rest)
        digit = F.conv(F.substring(p["digits"], whole + 1, F.lit(1)), 16, 10).cast("int")
        ok = p["bits"] <= p["total"]

        def bound(fill: str, edge: Column) -> Column:
            middle = F.when(rest == 0, F.lit("")).otherwise(F.lower(F.hex(edge.cast("bigint"))))
            size = (p["total"] / 4).cast("int")
            return F.when(ok, F.unhex(F.rpad(F.concat(kept, middle), size, fill)))

        low = digit.bitwiseAND(keep)
        return F.struct(
            F.when(ok, F.when(p["total"] == 32, 4).otherwise(6)).alias("family"),
            F.when(ok, p["bits"]).alias("bits"),
            bound("0", low).alias("base"),
            bound("f", low.bitwiseOR(F.lit(15) - keep)).alias("last"),
        )

    def sized(p: Column) -> Column:
        total = F.length(p["digits"]) * 4
        length = F.when(p["length"].rlike(r"^\d{1,3}$"), p["length"].cast("int"))
        bits = F.when(p["length"].isNull(), total).otherwise(length)
        fields = F.struct(p["digits"].alias("digits"), total.alias("total"), bits.alias("bits"))
        return let(fields, edges)

    parts = F.split(text, "/", 2)
    given = F.struct(
        let(F.get(parts, F.lit(0)), _address_hex).alias("digits"),
        F.get(parts, F.lit(1)).alias("length"),
    )
    return let(given, sized)


def cidr_literals(prefixes) -> list[tuple[bytes, bytes]]:
    """Disjoint sorted (first, last) byte ranges of a list of prefix texts."""
    nets = [ipaddress.ip_network(p, strict=False) for p in prefixes]
    merged = []
    for version in (4, 6):
        merged += ipaddress.collapse_addresses(n for n in nets if n.version == version)
    return [(n.network_address.packed, n.broadcast_address.packed) for n in merged]
