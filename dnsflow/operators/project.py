"""Pairs to the published row formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dnsflow import schema
from dnsflow.functions import codes, edns, names
from dnsflow.functions.addresses import ip_text
from dnsflow.functions.binding import stage


def _constants() -> dict[str, Column]:
    """Columns of the format that are never filled (fixed values: the format's names)."""
    numbers = ("frag", "resp_frag", "proc_time")
    flags = ("edns_ping", "is_google", "is_opendns")
    texts = (
        "edns_client_subnet", "edns_client_subnet_asn", "edns_client_subnet_country",
        "server_location",
    )
    return {
        **{c: F.lit(0) for c in numbers},
        **{c: F.lit(False) for c in flags},
        **{c: F.lit("") for c in texts},
    }


def _given(pairs: DataFrame, column: str) -> Column:
    return F.col(column) if column in pairs.columns else F.lit("")


def with_edns(pairs: DataFrame) -> DataFrame:
    """Parsed option lists of both sides, each evaluated once."""
    return stage(pairs, {
        "query_options": edns.edns_options(F.col("query_opt")),
        "response_options": edns.edns_options(F.col("response_opt")),
    })


def _broken() -> Column:
    return (F.col("query_opt").isNotNull() & F.col("query_options").isNull()) | (
        F.col("response_opt").isNotNull() & F.col("response_options").isNull()
    )


def rejected_transactions(pairs: DataFrame) -> DataFrame:
    """Pairs that are counted but not published because an option list is broken."""
    return with_edns(pairs).filter(_broken()).drop("query_options", "response_options")


def _name_parts(pairs: DataFrame, qname: Column) -> dict[str, Column]:
    """Labels and domain of the text, or of the wire where a label may hold a dot."""
    count, domain = names.label_count(qname), names.domainname(qname)
    if "qname_wire" not in pairs.columns:
        return {"domainname": domain, "labels": count}
    odd = names.has_inner_dot(F.col("qname_wire"))
    parts = names.labels_and_domain(F.col("qname_wire"))
    return {
        "domainname": F.when(odd, parts["domainname"]).otherwise(domain),
        "labels": F.when(odd, parts["labels"]).otherwise(count),
    }


def _row(pairs: DataFrame) -> dict[str, Column]:
    qname = F.make_valid_utf8("qname")
    query, response = F.col("query_options"), F.col("response_options")
    renamed = {
        "src": ip_text(F.col("client_ip")), "srcp": F.col("client_port"),
        "dst": ip_text(F.col("server_ip")), "dstp": F.col("server_port"),
        "dns_res_len": F.col("res_dns_len"),
        "country": _given(pairs, "country"), "asn": _given(pairs, "asn"),
    }
    derived = {
        **codes.split_time(F.col("ts")),
        "qname": qname,
        **_name_parts(pairs, qname),
        "edns_nsid": edns.nsid(response),
        "edns_dnssec_dau": edns.algorithm_list(query, edns.DAU),
        "edns_dnssec_dhu": edns.algorithm_list(query, edns.DHU),
        "edns_dnssec_n3u": edns.algorithm_list(query, edns.N3U),
        "edns_other": edns.other_codes(query),
        "tcp_hs_rtt": codes.rtt_ms(F.col("tcp_rtt_us")),
    }
    return {**_constants(), **renamed, **derived}


def _select(pairs: DataFrame, ddl: str, made: dict[str, Column]) -> DataFrame:
    valid = with_edns(pairs).filter(~_broken())
    return valid.select(*[
        made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in StructType.fromDDL(ddl).fields
    ])


def to_transactions(pairs: DataFrame) -> DataFrame:
    """The 55-column transaction table; country and asn are empty unless enriched before."""
    return _select(pairs, schema.TRANSACTIONS, _row(pairs))


def option_record(opt: Column, udp_size: Column) -> Column:
    """OPT pseudo record of a response: generic text of its data, class is the query's UDP size."""
    text = F.concat(
        F.lit("\\# "), F.octet_length(opt).cast("string"), F.lit(" "), F.hex(opt)
    )
    return F.struct(
        F.lit("").alias("name"),
        F.lit(schema.TYPE_OPT).alias("type"),
        udp_size.cast("int").alias("class"),
        F.lit(None).cast("bigint").alias("ttl"),
        text.alias("rdata"),
    )


def _or_null(records: Column) -> Column:
    return F.when(F.size(records) > 0, records)


def to_transactions_json(pairs: DataFrame, export_rrs: bool = False) -> DataFrame:
    """Transactions plus records, user and policy; record arrays are null unless exported."""
    none = F.lit(None).cast(schema.RR_LIST)
    empty = F.array().cast(schema.RR_LIST)
    extra = {
        "user_id": F.col("user_id"),
        "policy_action": codes.policy_action_label(F.col("policy_action")),
        "policy_rule": F.col("policy_rule"),
    }
    for section in ("answer_rrs", "authority_rrs", "additional_rrs"):
        extra[section] = none
    if export_rrs:
        opt = F.when(
            F.col("response_opt").isNotNull(),
            F.array(option_record(F.col("response_opt"), F.col("edns_udp"))),
        ).otherwise(empty)
        additional = F.concat(opt.cast(schema.RR_LIST), F.coalesce("additional_rrs", empty))
        extra["answer_rrs"] = _or_null(F.col("answer_rrs"))
        extra["authority_rrs"] = _or_null(F.col("authority_rrs"))
        extra["additional_rrs"] = _or_null(additional)
    return _select(pairs, schema.TRANSACTIONS_JSON, {**_row(pairs), **extra})


def block_rows(pairs: DataFrame, export_rrs: bool = False) -> DataFrame:
    """One row per pair with the 31 block fields, flags packed into masks."""
    additional = F.when(
        F.col("response_opt").isNotNull(),
        F.array(option_record(F.col("response_opt"), F.col("edns_udp"))),
    )
    sections = {s: F.lit(None).cast(schema.RR_LIST) for s in ("answer_rrs", "authority_rrs")}
    if export_rrs:
        sections = {s: _or_null(F.col(s)) for s in sections}
        additional = _or_null(F.concat(
            F.coalesce(additional.cast(schema.RR_LIST), F.array().cast(schema.RR_LIST)),
            F.coalesce("additional_rrs", F.array().cast(schema.RR_LIST)),
        ))
    fields = {
        "transaction_id": F.col("id"),
        "time_offset": F.unix_micros("ts"),
        "query_name": F.col("qname"),
        "client_hoplimit": F.col("ttl"),
        "qr_transport_flags": codes.transport_flags(F.col("ipv"), F.col("prot")),
        "client_address": F.col("client_ip"),
        "client_port": F.col("client_port"),
        "server_address": F.col("server_ip"),
        "server_port": F.col("server_port"),
        "query_size": F.col("dns_len"),
        "qr_dns_flags": codes.dns_flags(
            *[F.col(c) for c in ("aa", "tc", "rd", "ra", "ad", "cd", "z", "edns_do")]
        ),
        "query_ancount": F.col("ancount"),
        "query_arcount": F.col("arcount"),
        "query_nscount": F.col("nscount"),
        "query_qdcount": F.col("qdcount"),
        "query_opcode": F.col("opcode"),
        "response_rcode": F.col("rcode"),
        "query_classtype": F.struct(F.col("qtype").alias("type"), F.col("qclass").alias("class")),
        "query_edns_version": F.col("edns_version"),
        "query_edns_udp_size": F.col("edns_udp"),
        "query_opt_data": F.col("query_opt"),
        "response_answer_sections": sections["answer_rrs"],
        "response_authority_sections": sections["authority_rrs"],
        "response_additional_sections": additional.cast(schema.RR_LIST),
        "response_size": F.col("res_dns_len"),
        "asn": F.nullif(_given(pairs, "asn"), F.lit("")),
        "country_code": F.nullif(_given(pairs, "country"), F.lit("")),
        "round_trip_time": F.col("tcp_rtt_us"),
        "user_id": F.col("user_id"),
        "policy_action": F.nullif(F.col("policy_action"), F.lit(codes.POLICY_NONE)),
        "policy_rule": F.col("policy_rule"),
    }
    return pairs.select("query_id", *[fields[f].alias(f) for f in schema.BLOCK_FIELDS])


# Second names some field lists use.
FIELD_ALIASES = {"query_opt_rdata": "query_opt_data"}


def _chosen(names, known) -> list[str]:
    wanted = {FIELD_ALIASES.get(n.lower(), n.lower()) for n in names}
    return [k for k in known if k in wanted]


def select_fields(block: DataFrame, names, keep=("query_id",)) -> DataFrame:
    """Subset of the block fields by name; case does not matter, unknown names are ignored."""
    present = [k for k in keep if k in block.columns]
    return block.select(*present, *_chosen(names, schema.BLOCK_FIELDS))


def select_stats(stats: DataFrame, names, keep=("tick",)) -> DataFrame:
    """Subset of the statistics fields by name."""
    present = [k for k in keep if k in stats.columns]
    return stats.select(*present, *[F.col(f"`{n}`") for n in _chosen(names, schema.STATS_FIELDS)])


def explode_records(df: DataFrame, section: str, keep: list[str]) -> DataFrame:
    """Long form of a record list: one row per record with its position."""
    spread = df.select(*keep, F.posexplode(section).alias("pos", "rr"))
    return spread.select(*keep, "pos", "rr.*")
