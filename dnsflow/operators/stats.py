"""Traffic counters, rates, moving averages, entropy and reports.

Everything starts from a small pre-aggregated table (per tick, per server, per first
octet), so busy servers or seconds are reduced before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.functions.addresses import first_octet
from dnsflow.functions.codes import MICROS, transport_class
from dnsflow.operators.filters import queries_only
from dnsflow.plans.timeline import fill_gaps, running_totals, trailing_frame

COUNTERS = ["ipv4", "ipv6", "tcp", "udp", "dot", "doh"]


def tick_of(unit_s: int, ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(ts) / (unit_s * MICROS)).cast("bigint")


def _counters() -> list[Column]:
    kind = transport_class(F.col("prot"), F.col("server_port"))
    tests = {"ipv4": F.col("ipv") == 4, "ipv6": F.col("ipv") == 6}
    tests.update({name: kind == name for name in ("tcp", "udp", "dot", "doh")})
    return [F.count_if(tests[c]).alias(c) for c in COUNTERS]


def with_total(counters: DataFrame) -> DataFrame:
    return counters.withColumn("queries", F.col("ipv4") + F.col("ipv6"))


def query_counters(messages: DataFrame) -> DataFrame:
    """Requests by IP version and transport, and their total."""
    return with_total(queries_only(messages).agg(*_counters()))


def query_counters_per_server(
    messages: DataFrame, ipv4_allow=(), ipv6_allow=(), every_family: bool = False
) -> DataFrame:
    """The same per server address, for families that have an allow list."""
    families = [v for v, allow in ((4, ipv4_allow), (6, ipv6_allow)) if allow or every_family]
    rows = queries_only(messages).filter(F.col("ipv").isin(families) if families else F.lit(False))
    return with_total(rows.groupBy("server_ip").agg(*_counters()))


def octet_histogram(messages: DataFrame) -> DataFrame:
    """Requests per first octet of the IPv4 client address; at most 256 rows."""
    rows = queries_only(messages).filter(F.col("ipv") == 4)
    return rows.groupBy(first_octet(F.col("client_ip")).alias("octet")).agg(F.count("*").alias("n"))


def _entropy(octets: DataFrame, by: list[str]) -> DataFrame:
    """Shannon entropy in bits from counts: log2(N) - sum(n log2 n) / N."""
    n = F.col("n").cast("double")
    sums = octets.groupBy(*by).agg(F.sum("n").alias("all"), F.sum(n * F.log2(n)).alias("weighted"))
    bits = F.log2(F.col("all").cast("double")) - F.col("weighted") / F.col("all")
    value = F.when(F.col("all") > 0, F.greatest(bits, F.lit(0.0))).otherwise(0.0)
    return sums.select(*by, F.coalesce(value, F.lit(0.0)).alias("entropy"))


def source_entropy(messages: DataFrame) -> DataFrame:
    return _entropy(octet_histogram(messages), [])


def entropy_series(messages: DataFrame, every_s: int = 300) -> DataFrame:
    """Entropy of the clients seen within each interval."""
    rows = queries_only(messages).filter(F.col("ipv") == 4)
    octets = rows.groupBy(
        tick_of(every_s).alias("tick"), first_octet(F.col("client_ip")).alias("octet")
    ).agg(F.count("*").alias("n"))
    return _entropy(octets, ["tick"])


def merge_stats(parts: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Adds up partial counters of several workers or runs."""
    return parts.groupBy(*by).agg(*[F.sum(v).cast("bigint").alias(v) for v in values])


def counts_per_tick(messages: DataFrame, unit_s: int) -> DataFrame:
    return queries_only(messages).groupBy(tick_of(unit_s).alias("tick")).agg(*_counters())


def _rates(counts: DataFrame, unit_s: int, per_s: int, *keep: str) -> DataFrame:
    return counts.select(
        *keep, *[F.expr(f"{c} * {per_s} div {unit_s}").alias(c) for c in COUNTERS]
    )


def qps(messages: DataFrame, unit_s: int = 1, per_s: int = 1) -> DataFrame:
    """Whole requests per `per_s` seconds for every tick of `unit_s` seconds, quiet ticks included."""
    filled = fill_gaps(counts_per_tick(messages, unit_s), "tick", COUNTERS)
    return _rates(filled, unit_s, per_s, "tick")


def _mean(column: Column, window) -> Column:
    return F.floor(F.sum(column).over(window) / F.count("*").over(window)).cast("bigint")


def qps_moving_average(
    messages: DataFrame, window: int = 300, unit_s: int = 1, per_s: int = 1
) -> DataFrame:
    """Integer mean of the last `window` rates (1 to 3600), fewer at the start."""
    if not 1 <= window <= 3600:
        raise ValueError("window must be 1 to 3600")
    return trailing_frame(qps(messages, unit_s, per_s), "tick", COUNTERS, window, _mean)


def qps_moving_average_per_server(
    messages: DataFrame,
    window: int = 300,
    unit_s: int = 1,
    per_s: int = 1,
    every: int = 300,
    strict_window: bool = False,
) -> DataFrame:
    """Mean rate per server at every `every`-th tick, for servers seen up to then.

    The frame holds one sample more than `window` unless `strict_window`. Each non-empty (server, tick) count is
    added at the first report whose frame covers it and taken away at the first one behind: two rows, however many
    reports there are in a window. Running totals give the sums, in chunks, so no server's rows meet in one task.
    """
    size = window if strict_window else window + 1
    counted = queries_only(messages).groupBy("server_ip", tick_of(unit_s).alias("tick")).agg(*_counters())
    rates = _rates(counted, unit_s, per_s, "server_ip", "tick")
    bounds = counted.agg(F.min("tick").alias("first"), F.ceil(F.max("tick") / every).cast("bigint").alias("final"))
    report = F.ceil(F.col("tick") / every).cast("bigint")
    behind = F.floor((F.col("tick") + (size - 1)) / every).cast("bigint") + 1
    change = lambda at, sign: F.struct(at.alias("report"), *[(sign * F.col(c)).alias(c) for c in COUNTERS])
    changes = rates.filter(report < behind).select("server_ip", F.inline(F.array(change(report, 1), change(behind, -1))))
    bounded = rates.groupBy("server_ip").agg(F.min("tick").alias("tick")).crossJoin(F.broadcast(bounds))  # bounds is one row
    every_report = bounded.select(
        "server_ip", F.explode(F.sequence(report, F.col("final"))).alias("report"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS],
    )
    steps = changes.unionByName(every_report).groupBy("server_ip", "report").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    sums = running_totals(steps, "report", list(COUNTERS), ["server_ip"]).crossJoin(F.broadcast(bounds)).filter(F.col("report") <= F.col("final"))
    samples = F.least(F.lit(size), F.col("report") * every - F.col("first") + 1)
    return sums.select(
        "server_ip", (F.col("report") * every).alias("tick"),
        *[F.floor(F.col(c) / samples).cast("bigint").alias(c) for c in COUNTERS],
    )


def server_report(
    messages: DataFrame, window: int = 300, unit_s: int = 1, per_s: int = 1, every: int = 300, strict_window: bool = False
) -> DataFrame:
    """What the statistics format says about each server: its requests since the start and its moving-average rates.

    One row per server and report, under the names of the format.
    """
    averages = qps_moving_average_per_server(messages, window, unit_s, per_s, every, strict_window)
    counted = queries_only(messages).groupBy("server_ip", tick_of(unit_s).alias("at")).agg(*_counters())
    counts = counted.withColumn("tick", (F.ceil(F.col("at") / every) * every).cast("bigint"))
    quiet = averages.select("server_ip", "tick", *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS])
    steps = counts.select(*quiet.columns).unionByName(quiet).groupBy("server_ip", "tick").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    totals = running_totals(steps, "tick", COUNTERS, ["server_ip"])
    renamed = totals.select("server_ip", "tick", *[F.col(c).alias(f"queries-{c}") for c in COUNTERS])
    return averages.select("server_ip", "tick", *[F.col(c).alias(f"queries-per-second-{c}") for c in COUNTERS]).join(renamed, ["server_ip", "tick"])


def pipeline_counters(messages: DataFrame, packets: DataFrame, transactions: DataFrame,
                      exported: DataFrame, kept_packets: DataFrame | None = None) -> DataFrame:
    """Rows per stage, one row in all."""
    stages = {
        "processed-packets": packets, "processed-transactions": transactions,
        "exported-records": exported,
        "exported-pcap-packets": kept_packets if kept_packets is not None else packets.limit(0),
    }
    parts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in stages.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pending_gauge(
    waits: DataFrame, timeout_ms: int = 1000, tick_ms: int = 1000
) -> DataFrame:
    """Messages waiting at each tick.

    `waits` has `arrived` and `left` (µs, null when never paired); a message waits from its
    arrival until it is paired or times out, so it touches at most timeout/tick + 1 ticks. Entries of zone
    transfers also have `renewed`, the time from which their timeout runs.
    """
    tick = tick_ms * 1000
    until = (F.coalesce("renewed", "arrived") if "renewed" in waits.columns else F.col("arrived")) + timeout_ms * 1000
    end = F.least(F.coalesce(F.col("left"), until), until)
    first = F.ceil(F.col("arrived") / tick).cast("bigint")
    last = (F.ceil(end / tick) - 1).cast("bigint")
    ticks = waits.filter(first <= last).select(F.explode(F.sequence(first, last)).alias("tick"))
    return ticks.groupBy("tick").agg(F.count("*").alias("pending"))


def stats_report(
    messages: DataFrame, every_s: int = 300, window: int = 300, unit_s: int = 1, per_s: int = 1
) -> DataFrame:
    """One row per interval under the names of the statistics format.

    Totals since the start, moving-average rates at the last tick of the interval, entropy
    of the interval, and the time of the report (end of the interval, µs).
    """
    counts = fill_gaps(counts_per_tick(messages, every_s), "tick", COUNTERS)
    totals = running_totals(counts, "tick", COUNTERS)
    averages = qps_moving_average(messages, window, unit_s, per_s).drop("samples")
    interval = F.floor(F.col("tick") * unit_s / every_s).cast("bigint")
    values = F.struct("tick", *COUNTERS)
    rates = averages.groupBy(interval.alias("interval")).agg(F.max(values).alias("rate"))
    entropy = entropy_series(messages, every_s).withColumnRenamed("tick", "interval")
    joined = (
        totals.withColumnRenamed("tick", "interval")
        .join(rates, "interval")
        .join(entropy, "interval", "left")
    )
    rate_names = {c: f"queries-per-second-{c}" for c in COUNTERS}
    return joined.select(
        F.col("interval").alias("tick"),
        F.coalesce("entropy", F.lit(0.0)).alias("ipv4-source-entropy"),
        *[F.col(c).alias(f"queries-{c}") for c in COUNTERS],
        (F.col("ipv4") + F.col("ipv6")).alias("queries"),
        *[F.col(f"rate.{c}").alias(name) for c, name in rate_names.items()],
        (F.col("rate.ipv4") + F.col("rate.ipv6")).alias("queries-per-second"),
        ((F.col("interval") + 1) * every_s * MICROS).alias("unix-timestamp"),
    )


def full_report(
    report: DataFrame, packets: DataFrame, transactions: DataFrame, exported: DataFrame,
    kept_packets: DataFrame, waits: DataFrame, every_s: int = 300, timeout_ms: int = 1000,
) -> DataFrame:
    """`stats_report` with the five stage counters, so with every field of the statistics format.

    The stages have a time `us`; their counters run since the start. `waits` as in
    `pending_gauge`: the messages waiting at the end of each interval.
    """
    stages = {
        "processed-packets": packets, "processed-transactions": transactions,
        "exported-records": exported, "exported-pcap-packets": kept_packets,
    }
    tick = F.floor(F.col("us") / (every_s * MICROS)).cast("bigint")
    zero = F.lit(0).cast("bigint")
    rows = report.select("tick", *[zero.alias(s) for s in stages])
    for name, df in stages.items():
        counted = df.groupBy(tick.alias("tick")).agg(F.count("*").alias("n"))
        rows = rows.unionByName(
            counted.select("tick", *[(F.col("n") if s == name else zero).alias(s) for s in stages])
        )
    sums = rows.groupBy("tick").agg(*[F.sum(f"`{s}`").alias(s) for s in stages])
    short = {s: f"n{i}" for i, s in enumerate(stages)}
    totals = running_totals(sums.withColumnsRenamed(short), "tick", list(short.values()))
    pending = pending_gauge(waits, timeout_ms, every_s * 1000).select(
        (F.col("tick") - 1).alias("tick"), F.col("pending").alias("pending-transactions")
    )
    out = report.join(totals.withColumnsRenamed({v: k for k, v in short.items()}), "tick", "left")
    return out.join(pending, "tick", "left").fillna(0, ["pending-transactions"])
