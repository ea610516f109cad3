"""Reading and writing transactions, statistics and blocks as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsflow import schema
from dnsflow.functions.codes import file_name_parts
from dnsflow.operators import filters
from dnsflow.operators.normalize import DICTIONARIES
from dnsflow.plans.skew import cut_lineage


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRANSACTIONS).parquet(path)


def write_transactions(
    df: DataFrame, path: str, max_rows: int = 5_000_000, compress: bool = True, mode: str = "errorifexists"
) -> None:
    """Parquet files of at most `max_rows` rows, written where the rows are: no extra shuffle."""
    codec = "gzip" if compress else "none"
    df.write.mode(mode).option("maxRecordsPerFile", max_rows).option("compression", codec).parquet(path)


def read_transactions_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.TRANSACTIONS_JSON).json(path)


def write_transactions_json(
    df: DataFrame, path: str, compress: bool = True, mode: str = "errorifexists"
) -> None:
    """One JSON object per line with explicit nulls."""
    writer = df.write.mode(mode).option("ignoreNullFields", "false")
    writer.option("compression", "gzip" if compress else "none").json(path)


def stats_objects(stats: DataFrame, per_ip: DataFrame | None = None) -> DataFrame:
    """(tick, value): one flat JSON object per report.

    `per_ip` has (tick, ip text, one column per metric); its keys are written as
    `[address]metric`. Every report lists its addresses, so an object is as long as the
    address list of that report; only reports are grouped, never raw traffic.
    """
    def entries(df: DataFrame, prefix: Column, skip: set[str]) -> DataFrame:
        metrics = [c for c in df.columns if c not in skip]
        pairs = F.array(*[
            F.struct(
                F.concat(prefix, F.lit(m)).alias("key"),
                F.to_json(F.struct(F.col(f"`{m}`").alias("v"))).alias("value"),
            )
            for m in metrics
        ])
        return df.select("tick", F.explode(pairs).alias("entry"))

    out = entries(stats, F.lit(""), {"tick"})
    if per_ip is not None:
        prefix = F.concat(F.lit("["), F.col("ip"), F.lit("]"))
        out = out.unionByName(entries(per_ip, prefix, {"tick", "ip"}))
    part = F.concat(
        F.lit('"'), F.col("entry.key"), F.lit('":'),
        F.regexp_extract(F.col("entry.value"), r'^\{"v":(.*)\}$', 1),
    )
    joined = out.select("tick", part.alias("part")).groupBy("tick").agg(
        F.array_join(F.array_sort(F.collect_list("part")), ",").alias("body")
    )
    return joined.select("tick", F.concat(F.lit("{"), F.col("body"), F.lit("}")).alias("value"))


def write_stats_json(stats: DataFrame, path: str, per_ip: DataFrame | None = None) -> None:
    stats_objects(stats, per_ip).select("value").write.text(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Long rows (file_ts, ip, metric, value); `ip` is null for totals."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    pairs = lines.select(
        F.coalesce(file_name_parts(F.col("file"))["time_ms"], F.lit(None)).alias("file_ts"),
        F.get_json_object("value", "$.unix-timestamp").cast("bigint").alias("report_ts"),
        F.explode(F.from_json("value", "map<string,double>")).alias("key", "value"),
    )
    pattern = r"^\[([^\]]*)\](.*)$"
    ip = F.when(F.col("key").rlike(pattern), F.regexp_extract("key", pattern, 1))
    metric = F.when(F.col("key").rlike(pattern), F.regexp_extract("key", pattern, 2))
    return pairs.select(
        "file_ts", "report_ts", ip.alias("ip"), F.coalesce(metric, "key").alias("metric"), "value"
    )


#: Tasks that write files of blocks, and the column of the folders that hold a file of each task.
WRITERS, FOLDER = 256, "folder"


def block_files(blocks: DataFrame, per_file: int, buckets: int = 1024) -> tuple[DataFrame, int]:
    """(block_id, file) of every block, at most `per_file` blocks in a file, and the number of files.

    Blocks are dealt into buckets and numbered there; running sums over the buckets, of which there is a fixed number,
    give the files of all buckets consecutive numbers.
    """
    dealt = blocks.select("block_id").distinct().withColumn("bucket", F.pmod(F.xxhash64("block_id"), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("block_id")) - 1
    numbered = dealt.withColumn("part", F.floor(place / per_file).cast("int"))
    sizes = numbered.groupBy("bucket").agg((F.max("part") + 1).alias("files"))
    offsets = sizes.withColumn("offset", F.sum("files").over(Window.orderBy("bucket")) - F.col("files"))
    files = sizes.agg(F.sum("files")).first()[0] or 0
    return numbered.join(F.broadcast(offsets), "bucket").select("block_id", (F.col("offset") + F.col("part")).cast("int").alias("file")), files


def write_blocks(
    facts: DataFrame, dicts: dict[str, DataFrame], path: str,
    max_rows: int = 5_000_000, mode: str = "errorifexists", blocks_per_file: int | None = None,
) -> None:
    """The fact table and the dictionaries, one Parquet folder each.

    With `blocks_per_file` a block lies in one file of each table (unless `max_rows` cuts it) and no file holds more blocks.
    """
    if blocks_per_file is not None:
        placed, files = block_files(facts, blocks_per_file, min(1024, max(1, facts.sparkSession.sparkContext.defaultParallelism)))
        # Beyond so many files a task writes several, one in each folder.
        placed = cut_lineage(placed.withColumn(FOLDER, F.floor(F.col("file") / WRITERS).cast("int")))
        of_file = F.pmod("file", F.lit(WRITERS))
        place = lambda df: df.join(placed, "block_id").repartitionById(min(WRITERS, max(1, files)), of_file).drop("file")
        facts, dicts = place(facts), {name: place(df) for name, df in dicts.items()}
    for name, df in {"facts": facts, **dicts}.items():
        writer = df.write.mode(mode).option("maxRecordsPerFile", max_rows)
        (writer if blocks_per_file is None else writer.partitionBy(FOLDER)).parquet(f"{path}/{name}")


def read_blocks(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    facts = spark.read.parquet(f"{path}/facts").drop(FOLDER)
    return facts, {name: spark.read.parquet(f"{path}/{name}").drop(FOLDER) for name in DICTIONARIES}


def union_inputs(**inputs: DataFrame) -> DataFrame:
    """All inputs as one table; `source` says where a row came from."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in inputs.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# Names a pre-paired resolver feed uses for the columns of a pair.
PAIRED_FEED = {
    "query_id": "query_id", "time": "ts", "remote_addr": "client_ip", "remote_port": "client_port",
    "local_addr": "server_ip", "local_port": "server_port", "ip": "ipv", "proto": "prot",
    "query_size": "dns_len", "reply_size": "res_dns_len", "tcp_rtt": "tcp_rtt_us",
    "id": "id", "opcode": "opcode", "aa": "aa", "tc": "tc", "rd": "rd", "ra": "ra", "z": "z",
    "ad": "ad", "cd": "cd", "rcode": "rcode", "qdcount": "qdcount", "ancount": "ancount",
    "nscount": "nscount", "arcount": "arcount", "qname": "qname", "qtype": "qtype",
    "qclass": "qclass", "edns_payload": "edns_udp", "edns_version": "edns_version",
    "edns_do": "edns_do", "option_bits": "option_bits",
}
# Protocol codes of the feed.
FEED_UDP, FEED_TCP, FEED_TLS, FEED_HTTPS = 0, 1, 2, 3


def ingest_paired(feed: DataFrame, ports=(schema.DNS_PORT,), allow=(), deny=()) -> DataFrame:
    """A feed that already carries query and reply, in the columns of matched pairs.

    Rows without a reply, of another IP version, transport or port, or ruled out by the address
    lists (see `filters.cidr_filter`) are left out. The feed
    has no packet sizes, hop limit or checksum (0), and names options only by a bit set,
    which becomes empty options.
    """
    valid = (
        (F.col("reply_size") > 0)
        & F.col("ip").isin(4, 6)
        & F.col("proto").isin(FEED_UDP, FEED_TCP, FEED_TLS, FEED_HTTPS)
        & (F.col("remote_port").isin(sorted(ports)) | F.col("local_port").isin(sorted(ports)))
    )
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(31)),
        lambda i: F.call_function("getbit", F.col("option_bits").cast("bigint"), i) == 1,
    )
    options = F.unhex(F.array_join(
        F.transform(bits, lambda i: F.concat(F.lpad(F.hex(i.cast("bigint")), 4, "0"), F.lit("0000"))), ""
    ))
    made = {
        "proto": F.when(F.col("proto") == FEED_UDP, schema.UDP).otherwise(schema.TCP),
        "tcp_rtt": F.when(F.col("tcp_rtt") > 0, F.col("tcp_rtt")).otherwise(-1).cast("bigint"),
    }
    renamed = feed.filter(valid).select(
        *[made.get(src, F.col(src)).alias(dst) for src, dst in PAIRED_FEED.items()]
    )
    if allow or deny:
        renamed = filters.cidr_filter(renamed, allow, deny, columns=("client_ip", "server_ip"))
    none = F.lit(None).cast(schema.RR_LIST)
    return renamed.withColumns({
        "len": F.lit(0), "res_len": F.lit(0), "ttl": F.lit(0), "udp_sum": F.lit(0),
        "query_opt": F.when(F.col("option_bits") > 0, options),
        "response_opt": F.lit(None).cast("binary"),
        "user_id": F.lit(""), "policy_action": F.lit(0),
        "policy_rule": F.lit(None).cast("string"),
        "answer_rrs": none, "authority_rrs": none, "additional_rrs": none,
    }).drop("option_bits")


def kafka_rows(
    df: DataFrame, topic: str, partition_key: str | None = None, time_us: str | None = None
) -> DataFrame:
    """Rows in the shape the Kafka sink takes: one JSON message per row."""
    columns = [F.lit(topic).alias("topic"), F.to_json(F.struct(*df.columns)).alias("value")]
    if partition_key is not None:
        columns.append(F.lit(partition_key).alias("key"))
    if time_us is not None:
        columns.append(F.timestamp_micros(time_us).alias("timestamp"))
    return df.select(*columns)


def kafka_options(brokers: str, topic: str, security: dict | None = None) -> dict[str, str]:
    """Options of the Kafka sink; client settings get the `kafka.` prefix."""
    options = {"kafka.bootstrap.servers": brokers, "topic": topic}
    options.update({f"kafka.{k}": str(v) for k, v in (security or {}).items()})
    return options


def write_kafka(df: DataFrame, brokers: str, topic: str, partition_key: str | None = None,
                time_us: str | None = None, security: dict | None = None) -> None:
    """Needs the Kafka connector on the class path."""
    rows = kafka_rows(df, topic, partition_key, time_us)
    rows.write.format("kafka").options(**kafka_options(brokers, topic, security)).save()


def kept_packets(packets: DataFrame, only_invalid: bool = False) -> DataFrame:
    """Packets to keep: all or the malformed ones, without the link header, empty ones left out."""
    rows = packets.filter(F.col("error").isNotNull()) if only_invalid else packets
    link_free = F.substring("payload", F.when(F.col("raw_ip"), 1).otherwise(15), F.octet_length("payload"))
    return rows.withColumn("payload", link_free).filter(F.octet_length("payload") > 0)


def write_packets(packets: DataFrame, path: str, only_invalid: bool = False) -> None:
    kept_packets(packets, only_invalid).write.parquet(path)
