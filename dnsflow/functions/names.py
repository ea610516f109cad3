"""Domain name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsflow.functions.addresses import hex_fixed
from dnsflow.functions.binding import let


def domainname(qname: Column) -> Column:
    """Last two labels (or the only one), lower-cased."""
    return F.lower(F.substring_index(qname, ".", -2))


def label_count(qname: Column) -> Column:
    """Number of labels; the root has none."""
    return F.when(qname == "", 0).otherwise(F.size(F.split(qname, "[.]")))


def name_to_wire(name: Column) -> Column:
    """Length-prefixed labels with the closing zero byte."""
    labels = F.filter(F.split(name, "[.]"), lambda x: x != "")
    coded = F.transform(
        labels, lambda x: F.concat(hex_fixed(F.octet_length(x), 2), F.hex(F.encode(x, "UTF-8")))
    )
    return F.unhex(F.concat(F.array_join(coded, ""), F.lit("00")))


def wire_to_name(wire: Column) -> Column:
    """Text of an uncompressed wire name: dots between labels, none at the end, case kept."""
    digits = F.hex(wire)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(wire) / 2).cast("int")))

    def take(state: Column, _: Column) -> Column:
        size = F.conv(F.substring(digits, state["pos"], F.lit(2)), 16, 10).cast("int")
        size = F.coalesce(size, F.lit(0))
        label = F.substring(digits, state["pos"] + 2, size * 2)
        return F.when(
            size > 0,
            F.struct(
                (state["pos"] + 2 + size * 2).alias("pos"),
                F.concat(
                    state["out"], F.when(state["out"] == "", F.lit("")).otherwise(F.lit("2E")), label
                ).alias("out"),
            ),
        ).otherwise(state)

    start = F.struct(F.lit(1).alias("pos"), F.lit("").alias("out"))
    return F.decode(F.unhex(F.aggregate(steps, start, take, lambda s: s["out"])), "UTF-8")


def wire_labels(wire: Column) -> Column:
    """The labels of an uncompressed wire name, in hexadecimal; a label may hold dots."""
    digits = F.hex(wire)
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), (F.octet_length(wire) / 2).cast("int")))

    def take(state: Column, _: Column) -> Column:
        size = F.coalesce(F.conv(F.substring(digits, state["pos"], F.lit(2)), 16, 10).cast("int"), F.lit(0))
        label = F.substring(digits, state["pos"] + 2, size * 2)
        return F.when(
            size > 0,
            F.struct((state["pos"] + 2 + size * 2).alias("pos"), F.array_append(state["out"], label).alias("out")),
        ).otherwise(state)

    start = F.struct(F.lit(1).alias("pos"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(steps, start, take, lambda s: s["out"])


def labels_and_domain(wire: Column) -> Column:
    """struct(labels, domainname) counted on the wire, where a dot inside a label separates nothing."""
    def of(labels: Column) -> Column:
        n = F.size(labels)
        last = F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2))
        text = F.make_valid_utf8(F.decode(F.unhex(F.array_join(last, "2E")), "UTF-8"))
        return F.struct(n.alias("labels"), F.lower(text).alias("domainname"))

    return let(wire_labels(wire), of)


def has_inner_dot(wire: Column) -> Column:
    """Whether a label of the wire name holds a dot.

    On the wire dots stand inside labels only. The digits 2E may also be a label's length or
    straddle two bytes; such names are then counted on the wire as well, with the same result.
    """
    return F.coalesce(F.instr(F.hex(wire), "2E") > 0, F.lit(False))
