"""The registered queries: every operator applied to the derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsflow import schema
from dnsflow.functions import addresses, codes, names
from dnsflow.functions.binding import stage
from dnsflow.operators import (
    anonymize, decode, enrich, filters, ingest, match, normalize, project, stats, tcp, transfer,
)
from dnsflow.plans import views, wireviews
from dnsflow.plans.shared import shared_folder
from dnsflow.plans.skew import cut_lineage
from dnsflow.sources import captures, tables
from dnsflow.streaming import flows, matching
from dnsflow.streaming import tcp as tcp_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = 86_400
HOUR = 3600
ALLOW_V4 = ["32.0.0.0/8", "94.0.0.0/7"]
DENY_V4 = ["192.0.2.2/32", "125.0.0.0/8"]
ALLOW_V6 = ["2001:db8::1000/116"]
DENY_V6 = ["2001:db8:ffff::1/128"]
ANONYMIZE_KEY = bytes(range(32))
PAIR_IDS = ["query_id", "response_id"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def on_messages(fn: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(views.messages(spark, sf_dir))
    return fn


def us(column: str = "ts") -> Column:
    return F.unix_micros(column)


# --- matching -------------------------------------------------------------------------


def dns_pairs(messages: DataFrame) -> DataFrame:
    return match.match_transactions(filters.dns_port_filter(messages))


@on_messages
def txn_flagship(messages):
    return project.to_transactions(dns_pairs(messages))


@on_messages
def txn_by_domain(messages):
    rows = project.to_transactions(dns_pairs(messages))
    return rows.groupBy("domainname", "rcode").agg(
        F.count("*").alias("n"),
        F.sum("res_len").alias("bytes"),
        F.count_if(F.col("tcp_hs_rtt").isNotNull()).alias("n_rtt"),
    )


def _pair_view(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        *PAIR_IDS, us().alias("query_us"), us("response_ts").alias("response_us"),
        "res_len", "rcode", "ancount", "rd", "ra", "tcp_rtt_us",
    )


@on_messages
def match_fifo(messages):
    return _pair_view(match.match_transactions(messages))


@on_messages
def match_qname(messages):
    """Two names per key: repeated messages ask for another one."""
    number = F.unhex(F.lpad(F.hex(F.col("msg_id") % 5), 2, "0"))
    named = messages.withColumn("qname_wire", F.concat(F.col("qname_wire"), number))
    return _pair_view(match.match_transactions(named, match_qname=True))


@on_messages
def match_unmatched(messages):
    """Leftovers of ordinary messages and of zone transfers; some transfers lose their end."""
    cut = messages.filter("msg_id % 2910 <> 8")
    rest = match.unmatched(cut).unionByName(transfer.unfinished(cut))
    return rest.select("msg_id", us().alias("time_us"), "is_response")


@on_messages
def match_axfr(messages):
    return transfer.match_transfers(messages).select(
        *PAIR_IDS, "res_len", "res_dns_len", "ancount", "rcode"
    )


@on_messages
def flow_key(messages):
    keyed = match.with_flow_key(messages)
    return keyed.groupBy("port_lo", "prot", "ipv", "qtype").agg(
        F.count("*").alias("n"),
        F.count_distinct("addr_lo", "addr_hi", "port_hi", "id").alias("flows"),
    )


# --- inputs ---------------------------------------------------------------------------


def paired_feed(pairs: DataFrame) -> DataFrame:
    """Answered pairs under the names of the resolver feed."""
    columns = {dst: src for src, dst in tables.PAIRED_FEED.items() if dst in pairs.columns}
    feed = pairs.select(*[F.col(dst).alias(src) for dst, src in columns.items()])
    return feed.withColumns({
        "proto": F.when(F.col("proto") == schema.UDP, 0).when(F.col("local_port") == 853, 2).otherwise(1),
        "option_bits": F.when(F.col("query_id") % 60 == 0, 0b101000).otherwise(0),
    })


@on_messages
def ingest_paired_union(messages):
    pairs = cut_lineage(match.match_transactions(messages))
    feed = tables.ingest_paired(paired_feed(pairs))
    both = tables.union_inputs(
        wire=project.to_transactions(filters.dns_port_filter(pairs)), feed=project.to_transactions(feed)
    )
    return both.groupBy("source", "prot", "qtype").agg(
        F.count("*").alias("n"), F.sum("dns_res_len").alias("bytes"), F.sum("res_len").alias("wire")
    )


@on_messages
def input_union(messages):
    both = tables.union_inputs(
        capture=filters.queries_only(messages),
        tap=messages.filter("is_response").drop("answer_rrs", "udp_sum"),
    )
    return both.groupBy("source").agg(
        F.count("*").alias("n"), F.sum("len").alias("bytes"), F.count("udp_sum").alias("sums")
    )


# --- filters --------------------------------------------------------------------------


@on_messages
def port_filter(messages):
    return filters.dns_port_filter(messages, {53, 853}).select("msg_id", "client_port", "server_port")


@on_messages
def transport_filter(messages):
    """Some messages come by another transport."""
    mixed = messages.withColumn("prot", F.when(F.col("msg_id") % 37 == 0, 1).otherwise(F.col("prot")))
    return filters.transport_filter(mixed).groupBy("prot").agg(F.count("*").alias("n"))


def _ids(df: DataFrame) -> DataFrame:
    return df.select("msg_id", "ipv", "is_response")


@on_messages
def cidr_allow_v4(messages):
    return _ids(filters.cidr_filter(messages, allow=ALLOW_V4))


@on_messages
def cidr_deny_v4(messages):
    return _ids(filters.cidr_filter(messages, deny=DENY_V4))


@on_messages
def cidr_allow_over_deny(messages):
    return _ids(filters.cidr_filter(messages, allow=ALLOW_V4, deny=DENY_V4 + DENY_V6))


@on_messages
def cidr_v6(messages):
    return _ids(filters.cidr_filter(messages, allow=ALLOW_V6, deny=DENY_V4))


@on_messages
def cidr_long_list(messages):
    hosts = [f"{1 + 31 * k}.{64 + 2 * m}.0.0/16" for k in range(7) for m in range(40)]
    return _ids(filters.cidr_filter(messages, allow=hosts))


@on_messages
def parse_cidr(messages):
    """IPv4 networks as text, IPv6 networks in hexadecimal; lengths beyond the address give nothing."""
    k = F.col("msg_id")
    bits = F.when(F.col("ipv") == 4, k % 40).otherwise(112 + k % 20)
    text = F.concat(addresses.ip_text(F.col("client_ip")), F.lit("/"), bits)
    parsed = stage(messages.select("msg_id", text.alias("text")), {"p": addresses.parse_cidr(F.col("text"))})
    shown = lambda c: F.when(F.col("p.family") == 4, addresses.ip_text(F.col(c))).otherwise(F.lower(F.hex(c)))
    return parsed.select("msg_id", "p.bits", shown("p.base").alias("base"), shown("p.last").alias("last"))


def _tap_fields(messages: DataFrame) -> DataFrame:
    """Decoded dnstap fields with gaps, from message ids."""
    k = F.col("msg_id")
    return messages.select(
        "msg_id",
        F.when(k % 11 != 0, (k % 16).cast("int")).alias("kind"),
        F.when(k % 13 != 0, (k % 3).cast("int") + 1).alias("family"),
        F.col("client_ip").alias("query_address"),
        F.col("server_ip").alias("response_address"),
        (k % 8).cast("int").alias("protocol"),
        F.when(k % 17 != 0, F.col("client_port")).alias("query_port"),
        F.col("server_port").alias("response_port"),
        F.when(k % 19 != 0, F.col("qname_wire")).alias("body"),
    )


@on_messages
def dnstap_reject(messages):
    taps = _tap_fields(messages)
    reason = filters.dnstap_reject_reason(
        *[F.col(c) for c in (
            "kind", "family", "query_address", "response_address", "protocol",
            "query_port", "response_port", "body",
        )]
    )
    return taps.select(
        F.coalesce(reason, F.lit("ok")).alias("reason"),
        filters.dnstap_transport(F.col("protocol")).alias("prot"),
    ).groupBy("reason", "prot").agg(F.count("*").alias("n"))


# --- scalars --------------------------------------------------------------------------


@on_messages
def domainname(messages):
    return messages.select("msg_id", names.domainname(F.col("qname")).alias("domainname"))


@on_messages
def label_count(messages):
    return messages.select("msg_id", names.label_count(F.col("qname")).alias("labels"))


@query
def page_hosts(spark, sf_dir):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)
    rows = views.table(spark, sf_dir, "pages").select(host.alias("host"))
    return rows.groupBy(
        names.domainname(F.col("host")).alias("domainname"),
        names.label_count(F.col("host")).alias("labels"),
    ).agg(F.count("*").alias("n"))


@on_messages
def wire_names(messages):
    name = names.wire_to_name(F.col("qname_wire"))
    return messages.select("msg_id", name.alias("qname"), F.octet_length("qname_wire").alias("size"))


@on_messages
def split_time(messages):
    return messages.select("msg_id", *[c.alias(n) for n, c in codes.split_time(F.col("ts")).items()])


@on_messages
def ip_text(messages):
    return messages.select(
        "msg_id", addresses.ip_text(F.col("client_ip")).alias("src"),
        addresses.ip_text(F.col("server_ip")).alias("dst"),
    )


@on_messages
def ip_binary(messages):
    text = addresses.ip_text(F.col("client_ip"))
    return messages.select("msg_id", F.lower(F.hex(addresses.ip_binary(text))).alias("digits"))


@on_messages
def transport_class(messages):
    return messages.select(
        "msg_id", codes.transport_class(F.col("prot"), F.col("server_port")).alias("transport")
    )


@on_messages
def rtt_ms(messages):
    return messages.select("msg_id", codes.rtt_ms(F.col("tcp_rtt_us")).alias("rtt"))


@on_messages
def policy_label(messages):
    k = F.col("msg_id")
    return messages.select(
        "msg_id", codes.policy_action_label(F.col("policy_action")).alias("label"),
        codes.policy_action_code(k % 3 != 0, F.when(k % 2 == 0, k % 7)).alias("code"),
    )


@on_messages
def code_list(messages):
    return messages.select("msg_id", codes.code_list(F.col("server_ip")).alias("codes"))


@on_messages
def extra_kv(messages):
    user = F.col("user_id")
    extra = F.concat(
        F.lit("rtt="), F.col("client_port"), F.lit("\nuser_key="), user,
        F.when(F.col("msg_id") % 3 == 0, F.lit("\nother=1\n")).otherwise("\n"),
        F.when(F.col("msg_id") % 4 == 0, F.lit("rtt=bad\n")).otherwise(""),
        F.when(F.col("msg_id") % 5 == 0, F.concat(F.lit("user_key="), F.repeat(F.lit("x"), F.lit(37)), F.lit("\n"))).otherwise(""),
        F.when(F.col("msg_id") % 7 == 0, F.lit("rtt=1")).otherwise(""),
    )
    return messages.select(
        "msg_id", codes.extra_rtt(extra).alias("rtt"), codes.extra_user(extra).alias("user_key")
    )


@on_messages
def flag_bitmasks(messages):
    flags = [F.col(c) for c in ("aa", "tc", "rd", "ra", "ad", "cd", "z", "edns_do")]
    return messages.select(
        "msg_id", codes.transport_flags(F.col("ipv"), F.col("prot")).alias("transport_flags"),
        codes.dns_flags(*flags).alias("dns_flags"),
        codes.flag(F.col("id"), 0x40).alias("bit"),
    )


@on_messages
def first_octet(messages):
    return messages.select("msg_id", addresses.first_octet(F.col("client_ip")).alias("octet"))


@on_messages
def filename_parts(messages):
    stamp = F.date_format("ts", "yyyyMMdd.HHmmss.SSSSSS")
    kind = F.when(F.col("is_response"), "parquet").otherwise("json.gz")
    mark = F.when(F.col("msg_id") % 50 == 0, ".part").otherwise("")
    name = F.concat(F.lit("dns_"), stamp, F.lit(".p"), F.col("msg_id") % 4, F.lit("."), kind, mark)
    return messages.select("msg_id", *[c.alias(n) for n, c in codes.file_name_parts(name).items()])


@on_messages
def direction_normalise(messages):
    keyed = match.with_flow_key(messages)
    return keyed.select(
        "msg_id", addresses.ip_text(F.col("addr_lo")).alias("addr_lo"),
        addresses.ip_text(F.col("addr_hi")).alias("addr_hi"), "port_lo", "port_hi",
        (F.col("client_ip") == F.col("addr_lo")).alias("client_low"),
    )


@on_messages
def length_routing(messages):
    lengths = match.routed(messages, ("len", "dns_len"))
    return lengths.groupBy("is_response").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in lengths.columns[2:]])


@on_messages
def anonymise_counts(messages):
    scrambled = anonymize.anonymize_ip(messages.select("msg_id", "ipv", "client_ip", "server_ip"), ANONYMIZE_KEY)
    kept = messages.select("msg_id", F.col("client_ip").alias("plain"))
    joined = scrambled.join(kept, "msg_id")
    return joined.groupBy("ipv").agg(
        F.count("*").alias("n"),
        F.count_distinct("client_ip").alias("addresses"),
        F.count_distinct("client_ip", "plain").alias("pairs"),
        F.count_distinct(F.substring("client_ip", 1, 2)).alias("prefixes16"),
        F.count_distinct(F.substring("client_ip", 1, 3)).alias("prefixes24"),
        F.sum(F.octet_length("client_ip")).alias("bytes"),
    )


# --- projections ----------------------------------------------------------------------


@on_messages
def txn_json_rrs(messages):
    rows = project.to_transactions_json(dns_pairs(messages), export_rrs=True)
    rr = lambda column: F.to_json(F.get(F.col(column), F.lit(0)))
    return rows.select(
        "id", "time", "user_id", "policy_action", "policy_rule",
        F.size("answer_rrs").alias("answers"), F.col("answer_rrs")[0]["rdata"].alias("first_rdata"),
        F.col("authority_rrs").isNull().alias("no_authority"),
        F.col("additional_rrs")[0]["class"].alias("opt_class"),
        F.col("additional_rrs")[0]["rdata"].alias("opt_rdata"),
    )


@on_messages
def rr_explode(messages):
    return project.explode_records(messages, "answer_rrs", ["msg_id"])


@query
def order_lists(spark, sf_dir):
    """Nested lists of real size: line items per order, exploded back with their position."""
    items = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey").alias("item")
    )
    lists = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return project.explode_records(lists, "items", ["l_orderkey"])


@on_messages
def field_subset(messages):
    wanted = ["Transaction_ID", "query_opt_rdata", "response_size", "POLICY_ACTION", "unknown", "qr_dns_flags"]
    rows = project.select_fields(project.block_rows(dns_pairs(messages)), wanted)
    return rows.withColumn("query_opt_data", F.hex("query_opt_data"))


# --- blocks ---------------------------------------------------------------------------


BLOCKS_PER_FILE = 8


def blocks(messages: DataFrame) -> DataFrame:
    rows = project.block_rows(match.match_transactions(messages), export_rrs=True)
    return cut_lineage(normalize.assign_blocks(rows, rows_per_block=50, slot_s=10 * DAY, rows_per_part=1000))


@on_messages
def block_sizes(messages):
    return blocks(messages).groupBy("block_id").agg(
        F.count("*").alias("n"), F.min("query_id").alias("first"), F.max("query_id").alias("last")
    )


@on_messages
def block_dictionaries(messages):
    _, dicts = normalize.encode_blocks(blocks(messages))
    parts = [
        df.groupBy("block_id").agg(
            F.count_distinct("index").alias("n"), F.max("index").cast("bigint").alias("last")
        ).select(F.lit(name).alias("dictionary"), "block_id", "n", "last")
        for name, df in dicts.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@on_messages
def block_round_trip(messages):
    rows = blocks(messages)
    folder = shared_folder(rows.sparkSession, "blocks")
    tables.write_blocks(*normalize.encode_blocks(rows), folder, mode="overwrite", blocks_per_file=BLOCKS_PER_FILE)
    back = normalize.decode_refs(*tables.read_blocks(rows.sparkSession, folder))
    return back.select(
        "query_id", "query_name", addresses.ip_text(F.col("client_address")).alias("src"),
        addresses.ip_text(F.col("server_address")).alias("dst"), "server_port",
        "qr_dns_flags", F.col("query_classtype.type").alias("qtype"), "query_ancount",
        F.hex("query_opt_data").alias("query_opt"),
        F.col("response_answer_sections")[0]["rdata"].alias("first_rdata"),
        F.size("response_answer_sections").alias("answers"),
        F.col("response_additional_sections")[0]["rdata"].alias("opt_rdata"),
    )


# --- statistics -----------------------------------------------------------------------


@on_messages
def query_counters(messages):
    return stats.query_counters(messages)


@on_messages
def query_counters_per_server(messages):
    rows = stats.query_counters_per_server(messages, ipv4_allow=ALLOW_V4)
    return rows.withColumn("server_ip", addresses.ip_text(F.col("server_ip")))


@on_messages
def octet_histogram(messages):
    return stats.octet_histogram(messages)


@on_messages
def source_entropy(messages):
    return stats.source_entropy(messages).select(F.round("entropy", 9).alias("entropy"))


@on_messages
def merge_stats(messages):
    workers = [stats.octet_histogram(messages.filter(F.col("msg_id") % 2 == k)) for k in (0, 1)]
    return stats.merge_stats(workers[0].unionByName(workers[1]), ["octet"], ["n"])


@on_messages
def pipeline_counters(messages):
    pairs = cut_lineage(dns_pairs(messages))
    return stats.pipeline_counters(messages, messages, pairs, project.to_transactions(pairs), messages)


def waits(messages: DataFrame) -> DataFrame:
    """The times of everything that waits: ordinary messages, and entries of zone transfers."""
    return match.waiting_times(messages).unionByName(transfer.waiting_times(messages), allowMissingColumns=True)


@on_messages
def pending_gauge(messages):
    return stats.pending_gauge(waits(messages))


@on_messages
def qps(messages):
    return stats.qps(messages, unit_s=HOUR, per_s=HOUR)


@on_messages
def qps_moving_average(messages):
    return stats.qps_moving_average(messages, window=24, unit_s=HOUR, per_s=HOUR)


@on_messages
def qps_moving_average_minutes(messages):
    return stats.qps_moving_average(messages, window=300, unit_s=60, per_s=HOUR)


@on_messages
def qps_moving_average_per_server(messages):
    rows = stats.qps_moving_average_per_server(messages, window=24, unit_s=HOUR, per_s=DAY, every=10)
    return rows.withColumn("server_ip", addresses.ip_text(F.col("server_ip")))


@on_messages
def entropy_series(messages):
    return stats.entropy_series(messages, DAY).withColumn("entropy", F.round("entropy", 9))


def daily_report(messages: DataFrame) -> DataFrame:
    return stats.stats_report(messages, every_s=DAY, window=24, unit_s=HOUR, per_s=HOUR)


@on_messages
def stats_report(messages):
    rounded = F.round("`ipv4-source-entropy`", 9)
    out = daily_report(messages).withColumn("ipv4-source-entropy", rounded)
    return out.toDF(*[c.replace("-", "_") for c in out.columns])


@on_messages
def stats_report_full(messages):
    # One walk over the keys gives the pairs as well as what waits.
    ordinary = cut_lineage(match.waiting_times(messages))
    met = ordinary.filter("left is not null").select(F.col("left").alias("us"))
    waiting = ordinary.unionByName(transfer.waiting_times(messages), allowMissingColumns=True)
    seen = messages.select("is_response", us().alias("us"))
    full = stats.full_report(
        daily_report(messages), packets=seen, transactions=met, exported=met,
        kept_packets=seen.filter("is_response"), waits=waiting, every_s=DAY,
    )
    out = project.select_stats(full, schema.STATS_FIELDS)
    out = out.withColumn("ipv4-source-entropy", F.round("`ipv4-source-entropy`", 9))
    return out.toDF(*[c.replace("-", "_") for c in out.columns])


@on_messages
def stats_subset(messages):
    out = project.select_stats(daily_report(messages), ["Queries", "queries-dot", "nonsense", "unix-timestamp"])
    return out.toDF(*[c.replace("-", "_") for c in out.columns])


# --- enrichment -----------------------------------------------------------------------


@query
def geo_country(spark, sf_dir):
    rows = views.messages(spark, sf_dir).select("msg_id", "client_ip")
    return enrich.enrich_country(rows, views.geo(spark, sf_dir)).select("msg_id", "country")


@query
def geo_asn(spark, sf_dir):
    rows = views.messages(spark, sf_dir).select("msg_id", "client_ip")
    return enrich.enrich_asn(rows, views.geo(spark, sf_dir)).select("msg_id", "asn")


@query
def txn_enriched(spark, sf_dir):
    pairs = enrich.enrich_geo(dns_pairs(views.messages(spark, sf_dir)), views.geo(spark, sf_dir))
    rows = project.to_transactions(anonymize.anonymize_ip(pairs, ANONYMIZE_KEY))
    return rows.groupBy("country", "asn").agg(
        F.count("*").alias("n"), F.count_distinct("src").alias("clients")
    )


# --- files ----------------------------------------------------------------------------


@on_messages
def parquet_round_trip(messages):
    spark = messages.sparkSession
    folder = shared_folder(spark, "transactions")
    tables.write_transactions(project.to_transactions(dns_pairs(messages)), folder, max_rows=1000, mode="overwrite")
    return tables.read_transactions(spark, folder)


@on_messages
def json_round_trip(messages):
    spark = messages.sparkSession
    folder = shared_folder(spark, "json")
    rows = project.to_transactions_json(dns_pairs(messages), export_rrs=True)
    tables.write_transactions_json(rows, folder, mode="overwrite")
    back = tables.read_transactions_json(spark, folder)
    return back.select(
        "id", "time", "qname", "src", "tcp_hs_rtt", "user_id", "policy_action",
        F.size("answer_rrs").alias("answers"), F.col("answer_rrs")[0]["ttl"].alias("ttl"),
    )


@on_messages
def stats_json_round_trip(messages):
    spark = messages.sparkSession
    folder = f"{shared_folder(spark, 'stats')}/reports"
    report = daily_report(messages)
    servers = stats.server_report(messages, window=24, unit_s=HOUR, per_s=HOUR, every=24)
    per_ip = servers.select(
        (F.col("tick") / 24).cast("bigint").alias("tick"), addresses.ip_text(F.col("server_ip")).alias("ip"),
        *[F.col(f"`{c}`") for c in servers.columns[2:]],
    ).join(report.select("tick"), "tick", "left_semi")
    tables.write_stats_json(report, folder, per_ip)
    back = tables.read_stats(spark, folder)
    return back.groupBy("ip", "metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")
    )


# --- decoding -------------------------------------------------------------------------


def _decoded_view(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "packet_no", "error", *more, addresses.ip_text(F.col("client_ip")).alias("client"),
        "client_port", addresses.ip_text(F.col("server_ip")).alias("server"), "is_response",
        "id", "rcode", "ancount", "arcount", "dns_len", "edns_udp", "edns_do", "last_soa",
        "qname", "qtype", F.hex("opt_rdata").alias("opt"),
        F.size("answer_rrs").alias("answers"),
        F.array_join(F.col("answer_rrs.name"), "|").alias("rr_name"), F.array_join(F.col("answer_rrs.rdata"), "|").alias("rr_data"),
    )


@on_messages
def decode_packets(messages):
    decoded = decode.decode_packets(wireviews.udp_packets(messages), with_rrs=True)
    return _decoded_view(decoded, "len", "ttl", "udp_sum")


@on_messages
def capture_messages(messages):
    """Packets written as capture files, read back and turned into messages of both transports."""
    folder = shared_folder(messages.sparkSession, "captures")
    packets = wireviews.udp_packets(messages).unionByName(wireviews.tcp_packets(messages))
    captures.write_captures(packets, folder)
    found = ingest.packets_to_messages(captures.read_captures(messages.sparkSession, folder), ports={53, 443, 853})
    return found.select(
        "client_port", "server_port", "is_response", "id", "qname", "qtype", "rcode", "prot",
        us().alias("time_us"), "dns_len", "tcp_rtt_us",
    )


@on_messages
def dnstap_decode(messages):
    decoded = decode.decode_dnstap(wireviews.tap_frames(messages), with_rrs=True)
    rows = _decoded_view(decoded, "prot", "tcp_rtt_us", "user_id", "policy_action", "policy_rule", "ts")
    return rows.withColumn("time_us", us()).drop("ts")


@on_messages
def invalid_split(messages):
    valid, invalid = decode.split_invalid(decode.decode_packets(wireviews.udp_packets(messages)))
    kept = tables.kept_packets(invalid, only_invalid=True)
    return (
        valid.groupBy(F.lit("valid").alias("reason")).agg(F.count("*").alias("n"), F.sum("len").cast("bigint").alias("bytes"))
        .unionByName(kept.groupBy(F.col("error").alias("reason")).agg(
            F.count("*").alias("n"), F.sum(F.octet_length("payload")).alias("bytes")))
    )


# --- TCP ------------------------------------------------------------------------------


@on_messages
def tcp_sessions(messages):
    return tcp.tcp_connections(wireviews.segments(messages))


def _stateful(messages: DataFrame) -> DataFrame:
    return tcp.with_state(tcp.with_sessions(wireviews.segments(messages)))


@on_messages
def tcp_reorder(messages):
    pieces = tcp.ordered_bytes(_stateful(messages))
    return pieces.select(
        "conn", "side", "pos", F.octet_length("data").alias("size"), "us", "released_us", "whole"
    )


@on_messages
def tcp_handshake_rtt(messages):
    return tcp.handshakes(_stateful(messages))


@on_messages
def tcp_duplicates(messages):
    return tcp.repeated_segments(_stateful(messages)).select("conn", "side", "copies")


@on_messages
def tcp_overflow(messages):
    found = tcp.reassemble(wireviews.segments(messages), buffer_limit=0)
    return found.groupBy("side").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@on_messages
def tcp_framing(messages):
    decoded = tcp.decode_tcp(wireviews.segments(messages), with_rrs=True)
    rows = _decoded_view(decoded, "conn", "len", "ttl", "tcp_rtt_us", "us")
    return rows.drop("packet_no")


# --- streams --------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a file stream."""
    table = views.table(spark, sf_dir, "events")
    return spark.readStream.schema(table.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over everything there is and reads back what it wrote."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


#: Messages of zone transfers for every file of a micro-batch.
TRANSFERS_PER_FILE = 100_000


@query
def stream_match(spark, sf_dir):
    messages = views.messages_of(event_stream(spark, sf_dir))
    return _pair_view(drained(matching.stream_match_transactions(messages)))


@query
def stream_axfr(spark, sf_dir):
    """Zone transfers whose query, first, second and later responses come in micro-batches of their own."""
    folder = shared_folder(spark, "transfers")
    rows = cut_lineage(views.messages(spark, sf_dir).filter(F.col("qtype") == schema.QTYPE_AXFR))
    files = 1 + rows.count() // TRANSFERS_PER_FILE
    for number, part in enumerate(("NOT is_response", "msg_id % 5 = 0 AND is_response", "msg_id % 5 = 1", "msg_id % 5 > 1")):
        rows.filter(part).repartition(files).write.parquet(f"{folder}/part={number}")
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    found = drained(matching.stream_match_transfers(reader.parquet(folder), delay="60 days"))
    return found.select(*PAIR_IDS, "res_len", "res_dns_len", "ancount", "rcode")


@query
def stream_stats(spark, sf_dir):
    messages = views.messages_of(event_stream(spark, sf_dir))
    folder = shared_folder(spark, "ticks")
    # Update mode with one folder per batch; a later batch replaces a tick it touched again.
    target = flows.deliver(flows.folder_target(folder))
    stream = flows.stream_stats(messages, unit_s=HOUR)
    writer = stream.writeStream.outputMode("update").trigger(availableNow=True)
    writer = writer.option("checkpointLocation", f"{folder}-checkpoint")
    writer.foreachBatch(target).start().awaitTermination()
    rows = spark.read.schema("batch bigint, " + stream.schema.simpleString()[7:-1].replace(":", " ")).parquet(folder)
    values = [c for c in stream.columns if c != "tick"]
    latest = rows.groupBy("tick").agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return latest.select("tick", "v.*")


@query
def stream_tcp(spark, sf_dir):
    segments = wireviews.segments(views.messages_of(event_stream(spark, sf_dir)))
    rows = drained(tcp_stream.stream_tcp_reassembly(segments))
    return rows.select("conn", "side", "pos", "us", "len", "tcp_rtt_us", F.octet_length("body").alias("size"))


@query
def landing_dir(spark, sf_dir):
    folder = shared_folder(spark, "landing")
    rows = project.to_transactions(dns_pairs(views.messages(spark, sf_dir)))
    tables.write_transactions(rows, f"{folder}/files", mode="overwrite")
    landed = drained(flows.stream_landing_dir(spark, f"{folder}/files", "parquet", schema.TRANSACTIONS))
    return landed.filter(F.col("file_name").endswith(".parquet")).groupBy("domainname", "rcode").agg(
        F.count("*").alias("n"), F.sum("res_len").alias("bytes"),
        F.count_if(F.col("tcp_hs_rtt").isNotNull()).alias("n_rtt"),
    )
