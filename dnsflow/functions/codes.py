"""Time, flag, label and small text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsflow.schema import DOH_PORT, DOT_PORT, TCP, UDP

MICROS = 1_000_000

# Bits of the transport and DNS flag masks (RFC 8618, 7.3.2.3.2).
TRANSPORT_BITS = {"ipv6": 1, "udp": 0, "tcp": 2}
DNS_FLAG_BITS = {
    "cd": 1, "ad": 2, "z": 4, "ra": 8, "rd": 16, "tc": 32, "aa": 64, "do": 128,
    "response_tc": 1 << 13, "response_aa": 1 << 14,
}

# Policy actions and their labels.
POLICY_LABELS = {128: "PASS", 129: "BLOCK", 130: "AUDIT"}
POLICY_NONE, POLICY_OTHER = 0, 255

# Formats that export files may have.
FILE_FORMATS = ("cdns", "parquet", "json")


def split_time(ts: Column) -> dict[str, Column]:
    """Whole seconds, microseconds and the microsecond remainder of a timestamp."""
    us = F.unix_micros(ts)
    return {
        "unixtime": F.floor(us / MICROS).cast("bigint"),
        "time": us,
        "time_micro": F.pmod(us, F.lit(MICROS)),
    }


def transport_class(prot: Column, server_port: Column) -> Column:
    return (
        F.when((prot == TCP) & (server_port == DOT_PORT), "dot")
        .when((prot == TCP) & (server_port == DOH_PORT), "doh")
        .when(prot == TCP, "tcp")
        .when(prot == UDP, "udp")
    )


def rtt_ms(us: Column) -> Column:
    return F.when(us >= 0, us / F.lit(1000.0))


def policy_action_label(action: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, label in POLICY_LABELS.items():
        out = F.when(action == code, label).otherwise(out)
    return out


def policy_action_code(policy_present: Column, action: Column) -> Column:
    """Stored action of a dnstap policy: pass, blocked, anything else, or no action given."""
    return (
        F.when(~F.coalesce(policy_present, F.lit(False)), POLICY_NONE)
        .when(action.isNull(), 130)
        .when(action == 3, 128)
        .when(action == 1, 129)
        .otherwise(POLICY_OTHER)
    )


def code_list(binary: Column) -> Column:
    """Bytes as decimal numbers separated by commas."""
    size = F.octet_length(binary)
    spots = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    digits = F.hex(binary)
    return F.array_join(
        F.transform(
            spots, lambda i: F.conv(F.substring(digits, i * 2 - 1, F.lit(2)), 16, 10)
        ),
        ",",
    )


def extra_value(extra: Column, key: str) -> Column:
    """Value of the last `key=` line; only lines closed by a newline count."""
    lines = F.split(extra, "\n")
    closed = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    hits = F.filter(closed, lambda x: x.startswith(key) & (F.length(x) > len(key)))
    return hits, len(key)


def extra_rtt(extra: Column) -> Column:
    """Microseconds of the last readable `rtt=` line, -1 when there is none."""
    hits, skip = extra_value(extra, "rtt=")
    numbers = F.filter(
        F.transform(hits, lambda x: F.regexp_extract(F.substr(x, F.lit(skip + 1)), r"^\s*\+?(\d+)", 1)),
        lambda x: x != "",
    )
    return F.coalesce(F.get(numbers, F.size(numbers) - 1).cast("bigint"), F.lit(-1).cast("bigint"))


def extra_user(extra: Column) -> Column:
    """Last `user_key=` value of at most 36 bytes; longer ones are ignored."""
    hits, skip = extra_value(extra, "user_key=")
    users = F.filter(
        F.transform(hits, lambda x: F.substr(x, F.lit(skip + 1))),
        lambda x: F.octet_length(x) <= 36,
    )
    return F.coalesce(F.get(users, F.size(users) - 1), F.lit(""))


def _mask(bits: dict[int, Column]) -> Column:
    out = F.lit(0)
    for bit, cond in bits.items():
        out = out.bitwiseOR(F.when(cond, bit).otherwise(0))
    return out


def transport_flags(ipv: Column, prot: Column) -> Column:
    return _mask({
        TRANSPORT_BITS["ipv6"]: ipv == 6,
        TRANSPORT_BITS["tcp"]: prot == TCP,
    })


def dns_flags(aa, tc, rd, ra, ad, cd, z, do) -> Column:
    """Query flags in the low byte, response flags shifted above it."""
    b = DNS_FLAG_BITS
    return _mask({
        b["response_aa"]: aa, b["response_tc"]: tc,
        b["rd"]: rd, b["ra"]: ra, b["ad"]: ad, b["cd"]: cd, b["z"]: z, b["do"]: do,
    })


def flag(value: Column, mask: int) -> Column:
    """True when any masked bit of a header byte is set."""
    return value.bitwiseAND(mask) != 0


def file_name_parts(name: Column) -> dict[str, Column]:
    """Time (ms), process, format and compression of an export file name; nulls for any other name.

    A name ends in day.time.microseconds.process.format, perhaps with .gz; a process is "p" and
    its number, or "stats". Whatever stands before the day is free.
    """
    zipped = name.endswith(".gz")
    parts = F.split(F.when(zipped, F.substr(name, F.lit(1), F.length(name) - 3)).otherwise(name), "[.]")
    at = lambda k: F.try_element_at(parts, F.lit(-k))
    day, clock, micros, process, kind = F.right(at(5), F.lit(8)), at(4), at(3), at(2), at(1)
    digits = lambda c, n: c.rlike(f"^[0-9]{{{n}}}$")
    fits = (
        digits(day, 8) & digits(clock, 6) & digits(micros, 6)
        & process.rlike("^(p[0-9]+|stats)$") & kind.isin(*FILE_FORMATS)
    )
    hit = F.coalesce(fits, F.lit(False))
    seconds = F.unix_seconds(F.try_to_timestamp(F.concat(day, clock), F.lit("yyyyMMddHHmmss")))
    millis = (seconds * 1000 + F.floor(micros.try_cast("bigint") / 1000)).cast("bigint")
    return {
        "time_ms": F.when(hit, millis),
        "process": F.when(hit, process),
        "format": F.when(hit, kind),
        "gzip": F.when(hit, zipped),
    }
