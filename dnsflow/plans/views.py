"""DNS tables derived from the generic test tables.

The test tables hold no DNS data, so messages are computed from `events` by integer
formulas: narrow, row-local expressions without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsflow.functions.names import name_to_wire
from dnsflow.schema import RR_LIST, column_names, MESSAGES

TIMEOUT_US = 1_000_000
PARTS_PER_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_events(events: DataFrame) -> DataFrame:
    """`events` with short names and the time in microseconds, whatever the session zone is."""
    return events.selectExpr(
        "event_id AS e", "user_id AS u", "event_type AS et",
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) AS t0",
    )


# Condition, response flag, number and time of the messages an event may cause.
EVENT_ROWS = [
    ("true", "false", 0, "t0"),
    ("e % 13 = 0 AND e % 97 <> 0", "false", 1, "t0 + 200000"),
    ("e % 10 <> 3 AND e % 97 <> 0", "true", 0, "IF(e % 17 = 0, t0 - 300, t0 + e * 7919 % 1200000 + 1)"),
    ("e % 26 = 0 AND e % 97 <> 0", "true", 1, "t0 + e * 7919 % 1200000 + 150001"),
    *[("e % 97 = 0", "true", n, f"t0 + {100_000 * (n + 1)}") for n in range(3)],
    ("e % 97 = 0", "true", 3, "t0 + 400000 + IF(e % 5 = 0, 1500000, 0)"),
]


def event_rows(events: DataFrame) -> DataFrame:
    """One row (e, u, et, t0, r, n, t) per message of an event."""
    rows = ", ".join(
        f"IF({cond}, named_struct('r', {r}, 'n', {n}, 't', CAST({t} AS BIGINT)), NULL)"
        for cond, r, n, t in EVENT_ROWS
    )
    return short_events(events).selectExpr(
        "e", "u", "et", "t0", f"inline(filter(array({rows}), x -> x IS NOT NULL))"
    )


def _v4(*octets: str) -> str:
    return "unhex(concat(" + ", ".join(f"lpad(hex({o}), 2, '0')" for o in octets) + "))"


def _v6(head: str, tail: str) -> str:
    """Eight groups: the hex text `head`, zeros, then the decimal digits of `tail` as last group."""
    return f"unhex(concat('{head + '0' * (28 - len(head))}', lpad({tail}, 4, '0')))"


MESSAGE_COLUMNS = {
    "msg_id": "e * 10 + IF(r, 5, 0) + n",
    "ts": "timestamp_micros(t)",
    "is_response": "r",
    "client_ip": f"IF(u % 5 = 0, {_v6('20010db8', '1000 + u % 9000')}, "
    f"{_v4('u % 7 * 31 + 1', 'u % 256', 'u * 7 % 256', 'e % 250 + 1')})",
    "client_port": "CAST(e % 60000 + 1024 AS INT)",
    "server_ip": f"IF(u % 5 = 0, {_v6('20010db8ffff', 'e % 3 + 1')}, {_v4('192', '0', '2', 'e % 3 + 1')})",
    "server_port": "CASE WHEN e % 41 = 0 THEN 5353 WHEN u % 4 = 1 AND e % 4 = 0 THEN 853 "
    "WHEN u % 4 = 1 AND e % 4 = 1 THEN 443 ELSE 53 END",
    "id": "CAST(e * 31 % 65536 AS INT)",
    "prot": "IF(u % 4 = 1, 6, 17)",
    "ipv": "IF(u % 5 = 0, 6, 4)",
    "len": "CAST(IF(r, 100 + e % 400 + n, 60 + e % 40) AS INT)",
    "dns_len": "CAST(IF(r, 100 + e % 400 + n, 60 + e % 40) - 42 AS INT)",
    "ttl": "CAST(64 - e % 3 AS INT)",
    "udp_sum": "CAST(IF(u % 4 = 1, 0, e * 17 % 65536) AS INT)",
    "opcode": "0",
    "aa": "r AND e % 7 = 0",
    "tc": "r AND e % 19 = 0",
    "rd": "e % 3 <> 0",
    "ra": "r",
    "z": "false",
    "ad": "e % 23 = 0",
    "cd": "e % 29 = 0",
    "rcode": "IF(r AND et = 'error', 3, 0)",
    "qdcount": "1",
    "ancount": "CAST(IF(r, e % 4 + 1, 0) AS INT)",
    "nscount": "CAST(IF(r, e % 2, 0) AS INT)",
    "arcount": "CAST(IF(r, e % 3, e % 2) AS INT)",
    "qname": "qname",
    "qtype": "CASE WHEN e % 97 = 0 THEN 252 WHEN e % 5 = 0 THEN 1 WHEN e % 5 = 1 THEN 28 "
    "WHEN e % 5 = 2 THEN 15 WHEN e % 5 = 3 THEN 2 ELSE 6 END",
    "qclass": "1",
    "edns_udp": "IF(NOT r AND e % 2 = 0, 1232, 0)",
    "edns_version": "0",
    "edns_do": "NOT r AND e % 4 = 0",
    "opt_rdata": "CASE WHEN NOT r AND e % 6 = 0 THEN X'00050003080D0F' "
    "WHEN r AND e % 9 = 0 THEN unhex(concat('000300036E73', hex(CAST(e % 3 AS STRING)))) END",
    "tcp_rtt_us": "IF(r AND u % 4 = 1, 100 + e % 5000, -1)",
    "last_soa": "r AND e % 97 = 0 AND n = 3",
    "user_id": "concat('u-', u)",
    "policy_action": "CAST(CASE WHEN r AND e % 31 < 3 THEN 128 + e % 31 WHEN r AND e % 31 = 3 THEN 255 ELSE 0 END AS INT)",
    "policy_rule": "IF(r AND e % 31 < 4, concat('rule', e % 5), NULL)",
    "answer_rrs": "IF(r, transform(sequence(1, CAST(e % 4 + 1 AS INT)), i -> named_struct('name', qname, "
    "'type', 1, 'class', 1, 'ttl', CAST(300 + i AS BIGINT), 'rdata', concat('192.0.2.', i))), NULL)",
}
QNAME = """CASE WHEN e % 59 = 0 THEN '' WHEN e % 53 = 0 THEN 'LocalHost'
  ELSE concat(et, '.Zone', e % 11, '.Example.', element_at(array('com', 'CZ', 'org'), CAST(u % 3 AS INT) + 1)) END"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(spread(table(spark, sf_dir, "events")))


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with few splits on all cores: in as many parts as cores if it is one small file, else in several for
    each core, as splits of a compact file hold unlike shares of its rows."""
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    if splits >= PARTS_PER_CORE * cores:
        return df
    return df.repartition(cores if splits == 1 else PARTS_PER_CORE * cores)


def messages_of(events: DataFrame) -> DataFrame:
    """Messages of a static or streaming `events` table."""
    named = event_rows(events).selectExpr("*", f"{QNAME} AS qname")
    out = named.selectExpr(*[f"{sql} AS {name}" for name, sql in MESSAGE_COLUMNS.items()])
    none = F.lit(None).cast(RR_LIST)
    return out.withColumns({
        "qname_wire": name_to_wire(F.col("qname")), "authority_rrs": none, "additional_rrs": none,
    }).select(*column_names(MESSAGES))


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 ranges of ten /8 networks per nation, some missing, and one IPv6 range per region."""
    number = lambda sql: f"unhex(lpad(hex({sql}), 8, '0'))"
    v4 = (
        table(spark, sf_dir, "nation")
        .selectExpr("CAST(n_nationkey AS BIGINT) AS n")
        .filter("n % 7 <> 3 AND n <= 24")
        .selectExpr(
            f"{number('n * 10 * 16777216')} AS start_ip",
            f"{number('(n * 10 + 10) * 16777216 - 1')} AS end_ip",
            "concat(char(n + 65), 'X') AS country", "CAST(n + 64500 AS STRING) AS asn",
        )
    )
    v6 = (
        table(spark, sf_dir, "region")
        .selectExpr("r_regionkey AS k")
        .filter("k % 2 = 0")
        .selectExpr(
            f"{_v6('20010db8', 'k * 300 + 1000')} AS start_ip",
            f"{_v6('20010db8', 'k * 300 + 1299')} AS end_ip",
            "concat('R', k) AS country", "CAST(k + 65000 AS STRING) AS asn",
        )
    )
    return v4.union(v6)
