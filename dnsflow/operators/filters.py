"""Row filters: ports, address prefixes, transports, message kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.addresses import cidr_literals
from dnsflow.operators.enrich import in_ranges
from dnsflow.schema import DNS_PORT, TCP, UDP

# Ranges up to this number become one predicate that reaches the scan.
MAX_PREDICATE_RANGES = 64


def dns_port_filter(
    df: DataFrame, ports=(DNS_PORT,), columns=("client_port", "server_port")
) -> DataFrame:
    """Rows with either port in `ports`."""
    ports = sorted(ports)
    return df.filter(reduce(Column.__or__, [F.col(c).isin(ports) for c in columns]))


def transport_filter(df: DataFrame, column: str = "prot") -> DataFrame:
    return df.filter(F.col(column).isin(TCP, UDP))


def queries_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_response"))


def _any_match(ranges, columns) -> Column:
    tests = [
        (F.octet_length(c) == len(first)) & F.col(c).between(F.lit(first), F.lit(last))
        for c in columns
        for first, last in ranges
    ]
    return reduce(Column.__or__, tests)


def cidr_filter(
    df: DataFrame, allow=(), deny=(), columns=("client_ip", "server_ip")
) -> DataFrame:
    """Address lists, decided for each family on its own.

    With an allow list a row stays only if either address is in it and the deny list is
    not consulted; otherwise a row goes if either address is in the deny list. Short lists
    become a predicate over disjoint ranges, long ones a range lookup that never
    shuffles the rows.
    """
    allow, deny = cidr_literals(allow), cidr_literals(deny)
    rules = {}
    for size in (4, 16):
        inside = [r for r in allow if len(r[0]) == size]
        outside = [r for r in deny if len(r[0]) == size]
        if inside or outside:
            rules[size] = (inside or outside, bool(inside))
    if not rules:
        return df
    if sum(len(ranges) for ranges, _ in rules.values()) <= MAX_PREDICATE_RANGES:
        hits = {size: _any_match(ranges, columns) for size, (ranges, _) in rules.items()}
        marked = df
        helper = []
    else:
        spark = df.sparkSession
        listed = spark.createDataFrame(
            [(bytearray(a), bytearray(b)) for ranges, _ in rules.values() for a, b in ranges],
            "start_ip binary, end_ip binary",
        )
        marked, helper = df, []
        for i, column in enumerate(columns):
            helper.append(f"__listed{i}")
            marked = in_ranges(marked, column, listed, helper[-1])
        hit = reduce(Column.__or__, [F.col(h) for h in helper])
        hits = {size: hit for size in rules}
    keep = F.lit(True)
    for size, (_, keep_listed) in rules.items():
        hit = hits[size] if keep_listed else ~hits[size]
        keep = F.when(F.octet_length(columns[0]) == size, hit).otherwise(keep)
    return marked.filter(keep).drop(*helper)


# Dnstap message types that carry a query or a response.
QUERY_TYPES = (1, 3, 5, 7, 9, 11, 13)
RESPONSE_TYPES = (2, 4, 6, 8, 10, 12, 14)


def dnstap_reject_reason(
    kind: Column, family: Column, query_address: Column, response_address: Column,
    protocol: Column, query_port: Column, response_port: Column, body: Column,
) -> Column:
    """Why a dnstap frame yields no message; null when it does. Drops are quiet, errors are not."""
    return (
        F.when(kind.isNull(), "error: message type missing")
        .when(
            family.isNull() | query_address.isNull() | response_address.isNull(),
            "error: family or address missing",
        )
        .when(
            protocol.isNull() | query_port.isNull() | response_port.isNull(),
            "error: protocol or port missing",
        )
        .when(~family.isin(1, 2), "drop: unknown family")
        .when(~protocol.isin(1, 2, 3, 4, 7), "drop: unknown protocol")
        .when(~kind.isin(*QUERY_TYPES, *RESPONSE_TYPES), "error: unknown message type")
        .when(body.isNull(), "error: DNS data missing")
    )


def dnstap_transport(protocol: Column) -> Column:
    """IP protocol of a dnstap socket protocol: UDP, DOQ; TCP, DOT, DOH."""
    return F.when(protocol.isin(1, 7), UDP).when(protocol.isin(2, 3, 4), TCP)
