"""Prefix-preserving address scrambling after the published Crypto-PAn scheme (AES)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsflow.functions.binding import let
from dnsflow.plans.shared import shared_folder


def _aes(block: Column, key: bytes) -> Column:
    """AES-128 of one 16-byte block; the padding block that ECB adds is cut off."""
    coded = F.aes_encrypt(block, F.lit(bytearray(key)), F.lit("ECB"), F.lit("PKCS"))
    return F.substring(coded, 1, 16)


def _hex16(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def _upper_bits(pos: Column) -> Column:
    """64-bit mask with the `pos` highest bits set."""
    return F.when(pos <= 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.greatest(F.lit(64) - pos, F.lit(0)))
    )


def _mixed(address: Column, pad: Column, pos: Column) -> Column:
    """The first `pos` bits of the address, the remaining ones of the pad."""
    mask = _upper_bits(pos)
    return address.bitwiseAND(mask).bitwiseOR(pad.bitwiseAND(F.bitwise_not(mask)))


def _scrambled(address: Column, top: int, first: int, last: int, block: Callable[[Column], Column], key: bytes) -> Column:
    """64-bit `address` with the bits first..last flipped where the cipher says so.

    Bit `top` sits at the top of the 64-bit value. Whether a bit flips depends on all
    bits before it, which is what keeps common prefixes common.
    """
    def add(flips: Column, pos: Column) -> Column:
        byte = F.conv(F.hex(F.substring(_aes(block(pos), key), 1, 1)), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, F.lit(7)).cast("bigint")
        return flips.bitwiseOR(F.call_function("shiftleft", bit, F.lit(63 + top) - pos))

    flips = F.aggregate(F.sequence(F.lit(first), F.lit(last)), F.lit(0).cast("bigint"), add)
    return address.bitwiseXOR(flips)


def _pad(key: bytes) -> tuple[bytes, bytes]:
    """The cipher key and the block that fills up what follows a prefix."""
    if len(key) != 32:
        raise ValueError("the key must have 32 bytes")
    # The pad is one constant block; computing it here keeps the cipher out of every row.
    pad = SparkSession.active().range(1).select(_aes(F.lit(bytearray(key[16:])), key[:16])).first()[0]
    return key[:16], bytes(pad)


def _part(ip: Column, first: int, last: int, secret: bytes, pad: bytes) -> Column:
    """The bytes first..last (not included) of the scrambled address; of the address only those before `last` are read."""
    if first < 8 < last:
        return F.concat(_part(ip, first, 8, secret, pad), _part(ip, 8, last, secret, pad))
    pad_hi, pad_lo = (F.lit(int.from_bytes(pad[i : i + 8], "big", signed=True)).cast("bigint") for i in (0, 8))
    digits = F.rpad(F.hex(F.substring(ip, 1, last)), 32, "0")
    half = lambda at: F.conv(F.substring(digits, at, 16), 16, -10).cast("bigint")
    at = 0 if first < 8 else 8

    def coded(x: Column) -> Column:
        hi, lo = x["hi"], x["lo"]
        if at:
            block = lambda pos: F.unhex(F.concat(_hex16(hi), _hex16(_mixed(lo, pad_lo, pos - 64))))
        else:
            block = lambda pos: F.unhex(F.concat(_hex16(_mixed(hi, pad_hi, pos)), F.lit(pad[8:].hex())))
        turned = _scrambled(lo if at else hi, 8 * at, 8 * first, 8 * last - 1, block, secret)
        return F.substring(F.unhex(_hex16(turned)), first - at + 1, last - first)

    return let(F.struct(half(1).alias("hi"), half(17).alias("lo")), coded)


def scramble(ip: Column, key: bytes) -> Column:
    """Scrambled address of the same length; `key` is 16 bytes cipher key and 16 bytes pad seed."""
    secret, pad = _pad(key)
    return F.when(F.octet_length(ip) == 4, _part(ip, 0, 4, secret, pad)).when(F.octet_length(ip) == 16, _part(ip, 0, 16, secret, pad))


#: Lengths of the prefixes, in bytes, that are scrambled one after the other, for addresses of 4 and 16 bytes.
CUTS = {4: (1, 1, 1, 2, 3, 4), 16: (4, 8, 12, 14, 15, 16)}


def scrambled_prefixes(addresses: DataFrame, key: bytes) -> DataFrame:
    """(plain, scrambled) of the distinct addresses in the column `plain`.

    Whether a bit flips depends on the bits before it only, so each distinct prefix is scrambled once: a level table
    holds the prefixes of one length, and the next one adds the bytes behind them. Shared networks cost a
    cipher call for each of their bits, not for each of their addresses. Values of other lengths become null.
    """
    secret, pad = _pad(key)

    def cut(of: str, level: int) -> Column:
        by_size = [F.when(F.col("size") == size, F.substring(of, 1, cuts[level])) for size, cuts in CUTS.items()]
        return F.coalesce(*by_size)

    known = addresses.withColumn("size", F.octet_length("plain")).filter(F.col("size").isin(list(CUTS)))
    levels = [known.select("size", F.col("plain").alias("prefix"))]
    for level in reversed(range(len(CUTS[4]) - 1)):
        levels.insert(0, levels[0].select("size", cut("prefix", level).alias("prefix")).distinct())
    done = None
    for level, rows in enumerate(levels):
        part = F.lit(None).cast("binary")
        for size, cuts in CUTS.items():
            first, last = cuts[level - 1] if level else 0, cuts[level]
            own = _part(F.col("prefix"), first, last, secret, pad) if last > first else F.lit(b"")
            part = F.when(F.col("size") == size, own).otherwise(part)
        # Few distinct prefixes are few rows; a fixed number of parts keeps all cores on the cipher.
        spread = rows.repartition(_parts(rows), "prefix").withColumn("part", part)
        if done is None:
            done = spread.select("size", "prefix", F.col("part").alias("scrambled"))
        else:
            before = done.select("size", F.col("prefix").alias("above"), F.col("scrambled").alias("head"))
            joined = spread.withColumn("above", cut("prefix", level - 1)).join(before, ["size", "above"])
            done = joined.select("size", "prefix", F.concat("head", "part").alias("scrambled"))
    return done.select(F.col("prefix").alias("plain"), "scrambled")


def _parts(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def anonymize_ip(df: DataFrame, key: bytes, column: str = "client_ip") -> DataFrame:
    """Scrambles the client address; server addresses stay. Enrich before, not after.

    The distinct addresses are written to the shared folder, scrambled prefix by prefix and written again. The
    join back reads that table, so Spark knows its size: a small one is broadcast, a large one is
    joined by shuffle, where the rows of a busy address can be split among tasks.
    """
    plain = _written(df.select(F.col(column).alias("plain")).distinct().filter("plain is not null"), "addresses")
    back = _written(scrambled_prefixes(plain, key), "scrambled").select(F.col("plain").alias("__plain"), F.col("scrambled").alias("__scrambled"))
    joined = df.join(back, F.col(column) == F.col("__plain"), "left")
    return joined.withColumn(column, F.col("__scrambled")).select(*df.columns)


def _written(table: DataFrame, purpose: str) -> DataFrame:
    folder = shared_folder(table.sparkSession, purpose)
    table.write.mode("overwrite").parquet(folder)
    return table.sparkSession.read.schema(table.schema).parquet(folder)
