"""Pairing queries with responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.plans.skew import SkewPolicy, cut_lineage, settle_carry, split_hot
from dnsflow.schema import QTYPE_AXFR

FLOW_KEY = ["addr_lo", "addr_hi", "port_lo", "port_hi", "id", "prot", "ipv", "qtype"]

# What a pair takes from its query and from its response, under the names used afterwards.
FROM_QUERY = {
    "query_id": "msg_id", "ts": "ts",
    **{c: c for c in (
        "client_ip", "client_port", "server_ip", "server_port", "len", "dns_len", "ttl",
        "udp_sum", "opcode", "rd", "ra", "z", "ad", "cd", "qdcount", "qname", "qname_wire",
        "qclass", "edns_udp", "edns_version", "edns_do", "user_id",
    )},
    "query_opt": "opt_rdata", "query_rtt_us": "tcp_rtt_us",
}
FROM_RESPONSE = {
    "response_id": "msg_id", "response_ts": "ts", "res_len": "len", "res_dns_len": "dns_len",
    **{c: c for c in (
        "aa", "tc", "rcode", "ancount", "nscount", "arcount",
        "policy_action", "policy_rule", "answer_rrs", "authority_rrs", "additional_rrs",
    )},
    "response_opt": "opt_rdata", "response_rtt_us": "tcp_rtt_us",
}


def with_flow_key(df: DataFrame) -> DataFrame:
    """Direction-free key columns: addresses and ports are sorted independently."""
    return df.withColumns({
        "addr_lo": F.least("client_ip", "server_ip"),
        "addr_hi": F.greatest("client_ip", "server_ip"),
        "port_lo": F.least("client_port", "server_port"),
        "port_hi": F.greatest("client_port", "server_port"),
    })


def routed(messages: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Every message with what a pair takes from it of these fields, under the pair's names; null for the other side's."""
    taken = [
        F.when(F.col("is_response") == response, F.col(source)).alias(name)
        for mapping, response in ((FROM_QUERY, False), (FROM_RESPONSE, True)) for name, source in mapping.items() if source in fields
    ]
    return messages.select("msg_id", "is_response", *taken)


def _side(df: DataFrame, mapping: dict[str, str]) -> Column:
    """Time, id and the wanted payload of a message as one sortable struct."""
    present = [F.col(src).alias(dst) for dst, src in mapping.items() if src in df.columns]
    return F.struct(
        F.unix_micros("ts").alias("t"), F.col("msg_id").alias("m"), F.struct(*present).alias("row")
    )


# A fold copies its state at every step, so positions are gathered in short runs and only
# whole runs are added to the result.
RUN = 512
HITS = "array<struct<i:int,j:int>>"


def _hit(i: Column, j: Column) -> Column:
    return F.struct(i.alias("i"), j.alias("j"))


def walk(queries: str, responses: str, timeout_us: int) -> Column:
    """struct(i, j, hits) of the greedy walk over the time-ordered messages of one key.

    The older head is dropped when the other head comes `timeout` or more later, else both
    heads are a pair. This gives the same pairs as a queue of pending messages in which an
    arrival consumes the oldest pending message of the other kind. `hits` are the paired
    positions; everything from `i` and `j` on was still pending at the end. When no message
    of the common length expires, the k-th query simply meets the k-th response.
    """
    times = [F.transform(side, lambda x: x["t"]) for side in (queries, responses)]
    nq, nr = F.size(queries), F.size(responses)
    common = F.least(nq, nr)
    in_time = F.forall(
        F.zip_with(*times, lambda a, b: F.coalesce(F.abs(a - b) < timeout_us, F.lit(True))),
        lambda ok: ok,
    )
    no_hits = F.array().cast(HITS)
    straight = F.when(
        common > 0, F.transform(F.sequence(F.lit(0), common - 1), lambda k: _hit(k, k))
    ).otherwise(no_hits)

    def state(i, j, hits) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), hits.alias("hits"))

    def step(s: Column, _: Column) -> Column:
        q, r = F.get(queries, s["i"])["t"], F.get(responses, s["j"])["t"]
        both = q.isNotNull() & r.isNotNull()
        hit = both & (F.abs(q - r) < timeout_us)
        return state(
            s["i"] + (both & (hit | (q < r))).cast("int"),
            s["j"] + (both & (hit | (r < q))).cast("int"),
            F.when(hit, F.array_append(s["hits"], _hit(s["i"], s["j"]))).otherwise(s["hits"]),
        )

    def run(s: Column, _: Column) -> Column:
        part = F.aggregate(
            F.sequence(F.lit(1), F.least(nq + nr, F.lit(RUN))), state(s["i"], s["j"], no_hits), step
        )
        joined = F.transform(
            F.array(part), lambda p: state(p["i"], p["j"], F.concat(s["hits"], p["hits"]))
        )
        return F.get(joined, F.lit(0))

    runs = F.sequence(F.lit(0), ((nq + nr) / RUN).cast("int"))
    folded = F.aggregate(runs, state(F.lit(0), F.lit(0), no_hits), run)
    return F.when(in_time, state(common, common, straight)).otherwise(folded)


def _grouped(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its queries and responses in time order; one shuffle."""
    query, response = _side(keyed, FROM_QUERY), _side(keyed, FROM_RESPONSE)
    sides = keyed.select(
        *keys,
        F.when(~F.col("is_response"), query).alias("q"),
        F.when(F.col("is_response"), response).alias("r"),
    )
    # Repartitioning first keeps collect_list from also building lists before the shuffle.
    return sides.repartition(*keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list("q")).alias("q"),
        F.array_sort(F.collect_list("r")).alias("r"),
    )


def _walked(groups: DataFrame, timeout_us: int) -> DataFrame:
    return groups.withColumn("walk", walk("q", "r", timeout_us))


def _pairs() -> Column:
    return F.transform(
        "walk.hits",
        lambda hit: F.struct(
            F.get("q", hit["i"])["row"].alias("query"), F.get("r", hit["j"])["row"].alias("response")
        ),
    )


def _lonely(handed_on=None) -> Column:
    """Messages without a partner; `handed_on(t)` tells which of those still pending at the end
    a later chunk has received."""
    def free(side: str, position: str, response: bool) -> Column:
        used = F.transform("walk.hits", lambda hit: hit[position])
        every = F.when(
            F.size(side) > 0, F.sequence(F.lit(0), F.size(side) - 1)
        ).otherwise(F.array().cast("array<int>"))

        def mark(i: Column) -> Column:
            message = F.get(side, i)
            return F.struct(
                message["m"].alias("msg_id"),
                F.timestamp_micros(message["t"]).alias("ts"),
                F.lit(response).alias("is_response"),
            )

        alone = F.array_except(every, used)
        if handed_on is not None:
            alone = F.filter(
                alone,
                lambda i: ~((i >= F.col(f"walk.{position}")) & handed_on(F.get(side, i)["t"])),
            )
        return F.transform(alone, mark)

    return F.concat(free("q", "i", False), free("r", "j", True))


def _settled(hot: DataFrame, keys: list[str], timeout_us: int) -> DataFrame:
    """Walked chunks of crowded keys, each started with what the chunk before left pending."""
    wide = _grouped(hot, [*keys, "chunk", "chunk_us"])
    chunks = cut_lineage(
        wide.withColumns({"own_q": F.col("q"), "own_r": F.col("r")}).withColumns({
            "q": F.slice("q", 1, 0), "r": F.slice("r", 1, 0),
        })
    )

    def started(df: DataFrame) -> DataFrame:
        return _walked(
            df.withColumns({"q": F.concat("q", "own_q"), "r": F.concat("r", "own_r")}), timeout_us
        )

    def step(df: DataFrame) -> DataFrame:
        still_open = (F.col("chunk") + 1) * F.col("chunk_us") - timeout_us

        def rest(side: str, done: Column) -> Column:
            return F.filter(side, lambda x, i: (i >= done) & (x["t"] > still_open))

        out = started(df)
        return out.select(
            *keys, "chunk",
            rest("q", F.col("walk.i")).alias("q"), rest("r", F.col("walk.j")).alias("r"),
        )

    return started(settle_carry(chunks, keys, step, ["q", "r"]))


def _ordinary(messages: DataFrame) -> DataFrame:
    return with_flow_key(messages.filter(F.col("qtype") != QTYPE_AXFR))


def _keys(match_qname: bool) -> list[str]:
    return FLOW_KEY + (["qname_wire"] if match_qname else [])


def match_transactions(
    messages: DataFrame,
    timeout_ms: int = 1000,
    match_qname: bool = False,
    skew: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Pairs of a query and its response per flow key, first in first out.

    An arriving message pairs with the oldest message of the other kind that came less
    than `timeout_ms` earlier; responses may come first. Zone transfers are left to
    `match_transfers`. The wide rows are shuffled once, by key.
    """
    timeout_us = timeout_ms * 1000
    keys = _keys(match_qname)
    keyed = _ordinary(messages)
    cold, hot = split_hot(keyed, keys, F.unix_micros("ts"), timeout_us, skew)
    walked = _walked(_grouped(cold, keys).filter((F.size("q") > 0) & (F.size("r") > 0)), timeout_us)
    pairs = _as_pairs(walked)
    if hot is not None:
        pairs = pairs.unionByName(_as_pairs(_settled(hot, keys, timeout_us)))
    return pairs


def _as_pairs(walked: DataFrame) -> DataFrame:
    kept = ["id", "prot", "ipv", "qtype"]
    flat = walked.select(*kept, F.inline(_pairs()))
    return merge_projection(flat.select(*kept, "query.*", "response.*"))


def merge_projection(pairs: DataFrame) -> DataFrame:
    """A measured response round trip replaces the one of the query."""
    if "response_rtt_us" not in pairs.columns:
        return pairs
    rtt = F.when(F.col("response_rtt_us") > 0, F.col("response_rtt_us")).otherwise(
        F.col("query_rtt_us")
    )
    return pairs.withColumn("tcp_rtt_us", rtt).drop("query_rtt_us", "response_rtt_us")


def unmatched(
    messages: DataFrame,
    timeout_ms: int = 1000,
    match_qname: bool = False,
    skew: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Messages that end without a partner: expired, or still waiting when the input ends."""
    timeout_us = timeout_ms * 1000
    keys = _keys(match_qname)
    columns = ["msg_id", "ts", "is_response"]
    narrow = _ordinary(messages).select(*keys, *columns)
    cold, hot = split_hot(narrow, keys, F.unix_micros("ts"), timeout_us, skew)
    walked = _walked(_grouped(cold, keys), timeout_us)
    out = walked.select(*FLOW_KEY, F.inline(_lonely()))
    if hot is not None:
        # By position, as on ordinary keys: ids need not be unique.
        settled = cut_lineage(_settled(hot, keys, timeout_us))
        later = settled.select(
            *keys, (F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("more")
        )
        edge = (F.col("chunk") + 1) * F.col("chunk_us") - timeout_us
        followed = F.coalesce("more", F.lit(False))
        rest = settled.join(later, [*keys, "chunk"], "left")
        out = out.unionByName(
            rest.select(*FLOW_KEY, F.inline(_lonely(lambda t: followed & (t > edge))))
        )
    return out


def waiting_times(
    messages: DataFrame, timeout_ms: int = 1000, skew: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """(arrived, left) in µs of every message that had to wait; `left` is null without a partner."""
    timeout_us = timeout_ms * 1000
    narrow = _ordinary(messages).select(*FLOW_KEY, "msg_id", "ts", "is_response")
    cold, hot = split_hot(narrow, FLOW_KEY, F.unix_micros("ts"), timeout_us, skew)
    never = F.lit(None).cast("bigint")

    def paired(hit: Column) -> Column:
        q, r = F.get("q", hit["i"])["t"], F.get("r", hit["j"])["t"]
        return F.struct(F.least(q, r).alias("arrived"), F.greatest(q, r).alias("left"))

    alone = F.transform(
        _lonely(), lambda m: F.struct(F.unix_micros(m["ts"]).alias("arrived"), never.alias("left"))
    )
    out = _walked(_grouped(cold, FLOW_KEY), timeout_us).select(
        F.inline(F.concat(F.transform("walk.hits", paired), alone))
    )
    if hot is not None:
        met = _settled(hot, FLOW_KEY, timeout_us).select(F.inline(F.transform("walk.hits", paired)))
        lonely = unmatched(hot.drop("chunk", "chunk_us").withColumns({
            "client_ip": F.col("addr_lo"), "server_ip": F.col("addr_hi"),
            "client_port": F.col("port_lo"), "server_port": F.col("port_hi"),
        }), timeout_ms, skew=skew)
        out = out.unionByName(met).unionByName(
            lonely.select(F.unix_micros("ts").alias("arrived"), never.alias("left"))
        )
    return out
