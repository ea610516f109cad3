"""Country and AS number of client addresses by range lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.addresses import uint

# A range table is broadcast only up to this many rows after bucketing (tens of bytes each).
MAX_BROADCAST_ROWS = 2_000_000
SALTS = 32
# An IPv6 range over more /32 blocks than this is kept under its /16 instead.
NARROW_BLOCKS = 256


def _key16(ip: Column) -> Column:
    """First two bytes, IPv6 apart from IPv4."""
    return uint(F.substring(ip, 1, 2)) + F.when(F.octet_length(ip) == 16, 1 << 16).otherwise(0)


def _key32(ip: Column) -> Column:
    """First four bytes of an IPv6 address."""
    return F.when(F.octet_length(ip) == 16, uint(F.substring(ip, 1, 4)))


def _bucketed(ranges: DataFrame) -> list[tuple]:
    """Ranges repeated for every key they touch: a coarse table and a fine one for short IPv6 ranges.

    The coarse table has at most one extra row per /16 block, the fine one at most
    NARROW_BLOCKS rows per range, so neither explodes.
    """
    first, last = F.col("start_ip"), F.col("end_ip")
    narrow = F.coalesce(_key32(last) - _key32(first) < NARROW_BLOCKS, F.lit(False))
    out = []
    for key, part in ((_key16, ranges.filter(~narrow)), (_key32, ranges.filter(narrow))):
        out.append((key, part.withColumn("__key", F.explode(F.sequence(key(first), key(last))))))
    return out


def range_lookup(
    df: DataFrame,
    ip_column: str,
    ranges: DataFrame,
    values: list[str],
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Adds `values` of the range holding the address; null outside all ranges.

    `ranges` (start_ip, end_ip, values) must not overlap. Both sides meet on address
    blocks, so no row is compared with every range. The bucketed ranges are broadcast
    when a count proves them small; a bigger table is joined by shuffle with the rows of
    a block spread over SALTS partitions, so a busy client cannot fill one task.
    """
    out = df.withColumns({v: F.lit(None).cast(ranges.schema[v].dataType) for v in values})
    for key, table in _bucketed(ranges.select("start_ip", "end_ip", *values)):
        table = table.withColumnsRenamed({v: f"__{v}" for v in values})
        # Addresses that the table cannot hold get keys of their own below zero: they match
        # nothing and, unlike nulls, do not meet in one task.
        apart = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
        facts = out.withColumn("__key", F.coalesce(key(F.col(ip_column)), apart))
        on = ["__key"]
        rows = table.limit(max_broadcast_rows + 1).count()
        if rows == 0:
            continue
        if rows <= max_broadcast_rows:
            table = F.broadcast(table)
        else:
            salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
            facts = facts.withColumn("__salt", salt)
            table = table.withColumn(
                "__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
            )
            on.append("__salt")
        left, right = facts.alias("f"), table.alias("r")
        condition = F.col(f"f.{ip_column}").between(F.col("r.start_ip"), F.col("r.end_ip"))
        for column in on:
            condition = condition & (F.col(f"f.{column}") == F.col(f"r.{column}"))
        picked = [F.col(f"f.{c}") for c in df.columns]
        found = [F.coalesce(F.col(f"f.{v}"), F.col(f"r.__{v}")).alias(v) for v in values]
        out = left.join(right, condition, "left").select(*picked, *found)
    return out


def in_ranges(df: DataFrame, ip_column: str, ranges: DataFrame, flag: str) -> DataFrame:
    """Adds a boolean: does any of the disjoint ranges hold the address?"""
    found = range_lookup(df, ip_column, ranges.withColumn(flag, F.lit(True)), [flag])
    return found.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def enrich_geo(df: DataFrame, geo: DataFrame, ip_column: str = "client_ip") -> DataFrame:
    """Country code and AS number (plain digits) of the client, '' when unknown."""
    found = range_lookup(df, ip_column, geo, ["country", "asn"])
    return found.fillna("", ["country", "asn"])


def enrich_country(df: DataFrame, geo: DataFrame, ip_column: str = "client_ip") -> DataFrame:
    return range_lookup(df, ip_column, geo, ["country"]).fillna("", ["country"])


def enrich_asn(df: DataFrame, geo: DataFrame, ip_column: str = "client_ip") -> DataFrame:
    return range_lookup(df, ip_column, geo, ["asn"]).fillna("", ["asn"])
