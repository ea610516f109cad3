"""EDNS option expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsflow.functions.codes import code_list

OPTIONS = "array<struct<code:int,data:binary>>"

# Option codes (IANA).
NSID, DAU, DHU, N3U = 3, 5, 6, 7


def edns_options(rdata: Column) -> Column:
    """Options of an OPT record in order, empty ones left out; null when the list is broken."""
    digits = F.hex(rdata)
    size = F.length(digits)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), (size / 8).cast("int")))

    def number(pos: Column) -> Column:
        return F.conv(F.substring(digits, pos, F.lit(4)), 16, 10).cast("int")

    def take(s: Column, _: Column) -> Column:
        length = number(s["pos"] + 4) * 2
        fits = (size - s["pos"] + 1 >= 8) & (length <= size - s["pos"] - 7)
        option = F.struct(
            number(s["pos"]).alias("code"),
            F.unhex(F.substring(digits, s["pos"] + 8, length)).alias("data"),
        )
        return (
            F.when(s["pos"] > size, s)
            .when(
                fits,
                F.struct(
                    (s["pos"] + 8 + length).alias("pos"),
                    F.when(length > 0, F.array_append(s["out"], option)).otherwise(s["out"]).alias("out"),
                ),
            )
            .otherwise(s)
        )

    start = F.struct(F.lit(1).alias("pos"), F.array().cast(OPTIONS).alias("out"))
    return F.when(
        size > 0,
        F.aggregate(steps, start, take, lambda s: F.when(s["pos"] == size + 1, s["out"])),
    ).when(size == 0, F.array().cast(OPTIONS))


def edns_valid(rdata: Column) -> Column:
    return rdata.isNull() | edns_options(rdata).isNotNull()


def last_option(options: Column, code: int) -> Column:
    hits = F.filter(options, lambda o: o["code"] == code)
    return F.get(hits, F.size(hits) - 1)["data"]


def nsid(options: Column) -> Column:
    return F.coalesce(F.make_valid_utf8(last_option(options, NSID).cast("string")), F.lit(""))


def algorithm_list(options: Column, code: int) -> Column:
    return F.coalesce(code_list(last_option(options, code)), F.lit(""))


def other_codes(options: Column) -> Column:
    rest = F.filter(options, lambda o: ~o["code"].isin(NSID, DAU, DHU, N3U))
    return F.coalesce(F.array_join(F.transform(rest, lambda o: o["code"].cast("string")), ","), F.lit(""))
