"""Schemas, field lists and default options."""

from __future__ import annotations

from dataclasses import dataclass, field

RR_LIST = "array<struct<name:string,type:int,class:int,ttl:bigint,rdata:string>>"

PACKETS = "source string, packet_no bigint, ts timestamp, kind string, raw_ip boolean, payload binary"

MESSAGES = f"""
    msg_id bigint, ts timestamp, is_response boolean,
    client_ip binary, client_port int, server_ip binary, server_port int,
    id int, prot int, ipv int, len int, dns_len int, ttl int, udp_sum int,
    opcode int, aa boolean, tc boolean, rd boolean, ra boolean, z boolean,
    ad boolean, cd boolean, rcode int,
    qdcount int, ancount int, nscount int, arcount int,
    qname string, qname_wire binary, qtype int, qclass int,
    edns_udp int, edns_version int, edns_do boolean, opt_rdata binary,
    tcp_rtt_us bigint, last_soa boolean,
    user_id string, policy_action int, policy_rule string,
    answer_rrs {RR_LIST}, authority_rrs {RR_LIST}, additional_rrs {RR_LIST}
"""

SEGMENTS = """
    conn string, side int, ts timestamp, seg_no bigint, seq bigint, ack bigint,
    syn boolean, ack_flag boolean, fin boolean, rst boolean, data binary, packet_len int
"""

# The 55 columns of the transaction table, in file order.
TRANSACTIONS = """
    id int, unixtime bigint, time bigint, qname string, domainname string,
    len int, frag int, ttl int, ipv int, prot int,
    src string, srcp int, dst string, dstp int, udp_sum int, dns_len int,
    aa boolean, tc boolean, rd boolean, ra boolean, z boolean, ad boolean, cd boolean,
    ancount int, arcount int, nscount int, qdcount int,
    opcode int, rcode int, qtype int, qclass int, country string, asn string,
    edns_udp int, edns_version int, edns_do boolean, edns_ping boolean, edns_nsid string,
    edns_dnssec_dau string, edns_dnssec_dhu string, edns_dnssec_n3u string,
    edns_client_subnet string, edns_other string,
    edns_client_subnet_asn string, edns_client_subnet_country string,
    labels int, res_len int, time_micro bigint, resp_frag int, proc_time int,
    is_google boolean, is_opendns boolean, dns_res_len int, server_location string,
    tcp_hs_rtt double
"""

# The six columns only the JSON form has.
JSON_EXTRA = f"""
    answer_rrs {RR_LIST}, authority_rrs {RR_LIST}, additional_rrs {RR_LIST},
    user_id string, policy_action string, policy_rule string
"""
TRANSACTIONS_JSON = TRANSACTIONS.rstrip() + "," + JSON_EXTRA


def column_names(ddl: str) -> list[str]:
    """Top-level column names of a DDL string."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names


# Field names of the dictionary-normalised block rows.
BLOCK_FIELDS = (
    "transaction_id", "time_offset", "query_name", "client_hoplimit",
    "qr_transport_flags", "client_address", "client_port", "server_address",
    "server_port", "query_size", "qr_dns_flags", "query_ancount",
    "query_arcount", "query_nscount", "query_qdcount", "query_opcode",
    "response_rcode", "query_classtype", "query_edns_version",
    "query_edns_udp_size", "query_opt_data", "response_answer_sections",
    "response_authority_sections", "response_additional_sections",
    "response_size", "asn", "country_code", "round_trip_time", "user_id",
    "policy_action", "policy_rule",
)

# The statistics fields.
STATS_FIELDS = (
    "processed-packets", "processed-transactions", "exported-records",
    "pending-transactions", "exported-pcap-packets", "ipv4-source-entropy",
    "queries-ipv4", "queries-ipv6", "queries-tcp", "queries-udp",
    "queries-dot", "queries-doh", "queries",
    "queries-per-second-ipv4", "queries-per-second-ipv6",
    "queries-per-second-tcp", "queries-per-second-udp",
    "queries-per-second-dot", "queries-per-second-doh",
    "queries-per-second", "unix-timestamp",
)

# Protocol numbers, ports and record types.
TCP, UDP = 6, 17
DNS_PORT, DOT_PORT, DOH_PORT = 53, 853, 443
QTYPE_AXFR = 252
TYPE_OPT = 41


@dataclass(frozen=True)
class Options:
    """Run options with their defaults."""

    dns_ports: frozenset[int] = frozenset({DNS_PORT})
    raw_ip: bool = False
    ipv4_allow: tuple[str, ...] = ()
    ipv4_deny: tuple[str, ...] = ()
    ipv6_allow: tuple[str, ...] = ()
    ipv6_deny: tuple[str, ...] = ()
    timeout_ms: int = 1000
    match_qname: bool = False
    tcp_timeout_ms: int = 60_000
    parquet_records: int = 5_000_000
    records_per_block: int = 10_000
    blocks_per_file: int = 0
    export_rrs: bool = False
    compress: bool = True
    anonymize_ip: bool = False
    stats_every_s: int = 300
    moving_avg_window: int = 300
    stats_per_ip: bool = False
    block_fields: tuple[str, ...] = BLOCK_FIELDS
    stats_fields: tuple[str, ...] = STATS_FIELDS
    extra: dict = field(default_factory=dict)

    @classmethod
    def overlay(cls, config: dict, instance: str = "default") -> "Options":
        """The `default` section, overridden by the section of the named instance."""
        merged = {**config.get("default", {}), **config.get(instance, {})}
        known = {k: v for k, v in merged.items() if k in cls.__dataclass_fields__}
        return cls(**known, extra={k: v for k, v in merged.items() if k not in known})
