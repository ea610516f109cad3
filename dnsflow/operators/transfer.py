"""Zone transfers: one query answered by a run of responses that ends with a SOA record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsflow.operators.match import (
    FLOW_KEY, FROM_QUERY, FROM_RESPONSE, RUN, merge_projection, with_flow_key,
)
from dnsflow.plans.skew import SkewPolicy, cut_lineage, settle_carry, split_hot
from dnsflow.schema import QTYPE_AXFR

SUMMED = ("res_len", "res_dns_len", "ancount")
# Of an entry: its age, both sides, the messages it is made of, and its sums.
ENTRY = ("t", "query", "response", "members", *SUMMED)
MEMBER = ("t", "msg_id", "is_response")


def _events(keyed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with its messages in time order."""
    def payload(mapping):
        return F.struct(*[F.col(s).alias(d) for d, s in mapping.items() if s in keyed.columns])

    response = F.col("is_response")
    size = {"res_len": "len", "res_dns_len": "dns_len", "ancount": "ancount"}
    event = F.struct(
        F.unix_micros("ts").alias("t"),
        F.col("msg_id").alias("m"),
        F.coalesce("last_soa", F.lit(False)).alias("last"),
        F.when(~response, payload(FROM_QUERY)).alias("query"),
        F.when(response, payload(FROM_RESPONSE)).alias("response"),
        F.array(F.struct(F.unix_micros("ts").alias("t"), "msg_id", "is_response")).alias("members"),
        *[
            F.when(response, F.col(size[c])).otherwise(0).cast("bigint").alias(c)
            for c in SUMMED
        ],
    )
    rows = keyed.select(*keys, event.alias("ev")).repartition(*keys)
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list("ev")).alias("ev"))


def _entry_type(groups: DataFrame) -> str:
    event = groups.schema["ev"].dataType.elementType
    return "struct<" + ",".join(
        f"{f}:{event[f].dataType.simpleString()}" for f in ENTRY
    ) + ">"


def _entry(x: Column, **changed: Column) -> Column:
    return F.struct(*[
        changed.get(f, x[f]).alias(f) for f in ENTRY
    ])


def _follow(entries: str, pending: Column, timeout_us: int) -> Column:
    """struct(pending, done, gone) after all messages of `ev`; gone are the entries that got too old.

    A message belongs to the oldest entry that is younger than the timeout. Responses add
    up in an entry that has its query, and each of them renews its age; a query or
    response the oldest entry cannot take waits as an entry of its own.
    """
    none = F.array().cast(f"array<{entries}>")

    def state(pending: Column, done: Column, gone: Column) -> Column:
        parts = {"pending": pending, "done": done, "gone": gone}
        return F.struct(*[c.cast(f"array<{entries}>").alias(n) for n, c in parts.items()])

    def place(s: Column, x: Column, alive: Column) -> Column:
        old = F.filter(s["pending"], lambda p: p["t"] + timeout_us <= x["t"])
        gone = F.when(F.size(old) > 0, F.concat(s["gone"], old)).otherwise(s["gone"])
        gate = F.get(alive, F.lit(0))
        others = F.slice(alive, F.lit(2), F.greatest(F.size(alive), F.lit(1)))
        alone = F.array_append(alive, _entry(x))
        joined = F.concat(gate["members"], x["members"])
        asked = F.concat(F.array(_entry(gate, t=x["t"], query=x["query"], members=joined)), others)
        grown = _entry(
            gate, t=x["t"], response=F.coalesce(gate["response"], x["response"]), members=joined,
            **{c: gate[c] + x[c] for c in SUMMED},
        )
        is_query, has_query = x["query"].isNotNull(), gate["query"].isNotNull()
        return (
            F.when(gate.isNull() | (is_query == has_query), state(alone, s["done"], gone))
            .when(is_query, state(asked, s["done"], gone))
            .when(x["last"], state(others, F.array_append(s["done"], grown), gone))
            .otherwise(state(F.concat(F.array(grown), others), s["done"], gone))
        )

    def step(s: Column, index: Column) -> Column:
        x = F.get("ev", index)
        alive = F.filter(s["pending"], lambda p: p["t"] + timeout_us > x["t"])
        placed = F.get(F.transform(F.array(alive), lambda a: place(s, x, a)), F.lit(0))
        return F.when(x.isNull(), s).otherwise(placed)

    def run(s: Column, k: Column) -> Column:
        part = F.aggregate(
            F.sequence(k * RUN, F.least(k * RUN + (RUN - 1), F.size("ev") - 1)),
            state(s["pending"], none, none), step,
        )
        joined = F.transform(
            F.array(part), lambda p: state(p["pending"], F.concat(s["done"], p["done"]), F.concat(s["gone"], p["gone"]))
        )
        return F.get(joined, F.lit(0))

    runs = F.sequence(F.lit(0), ((F.size("ev") - 1) / RUN).cast("int"))
    return F.aggregate(runs, state(pending, none, none), run)


def _finished(walked: DataFrame) -> DataFrame:
    kept = ["id", "prot", "ipv", "qtype"]
    sums = [F.col(f"done.{c}").alias(f"sum_{c}") for c in SUMMED]
    flat = walked.select(*kept, F.explode("walk.done").alias("done")).select(
        *kept, "done.query.*", "done.response.*", *sums
    )
    totals = {c: F.col(f"sum_{c}").cast(flat.schema[c].dataType) for c in SUMMED if c in flat.columns}
    return merge_projection(flat.withColumns(totals).drop(*[f"sum_{c}" for c in SUMMED]))


def match_transfers(
    messages: DataFrame, timeout_ms: int = 1000, skew: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Completed zone transfers with the sizes and answer counts of all responses added up."""
    walked = _walked_parts(messages, timeout_ms, skew)
    out = _finished(walked[0])
    for more in walked[1:]:
        out = out.unionByName(_finished(more))
    return out


def _walked_parts(messages: DataFrame, timeout_ms: int, skew: SkewPolicy) -> list[DataFrame]:
    """Groups with their `walk`: those of ordinary keys, then the chunks of crowded ones."""
    timeout_us = timeout_ms * 1000
    keyed = with_flow_key(messages.filter(F.col("qtype") == QTYPE_AXFR))
    cold, hot = split_hot(keyed, FLOW_KEY, F.unix_micros("ts"), timeout_us, skew)
    groups = _events(cold, FLOW_KEY)
    entries = _entry_type(groups)
    none = F.array().cast(f"array<{entries}>")
    parts = [groups.withColumn("walk", _follow(entries, none, timeout_us))]
    if hot is None:
        return parts
    chunks = cut_lineage(_events(hot, [*FLOW_KEY, "chunk", "chunk_us"]).withColumn("open", none))

    def step(df: DataFrame) -> DataFrame:
        edge = (F.col("chunk") + 1) * F.col("chunk_us") - timeout_us
        left = F.filter(
            _follow(entries, F.col("open"), timeout_us)["pending"], lambda p: p["t"] > edge
        )
        return df.select(*FLOW_KEY, "chunk", left.alias("open"))

    settled = settle_carry(chunks, FLOW_KEY, step, ["open"])
    return [*parts, settled.withColumn("walk", _follow(entries, F.col("open"), timeout_us))]


def unfinished(
    messages: DataFrame, timeout_ms: int = 1000, skew: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """Messages of zone transfers that belong to no completed one, with their flow key."""
    parts = _walked_parts(messages, timeout_ms, skew)
    key = [*FLOW_KEY, "member"]
    used = None
    for part in parts:
        found = part.select(*FLOW_KEY, F.explode("walk.done").alias("done")).select(
            *FLOW_KEY, F.explode("done.members").alias("member")
        )
        used = found if used is None else used.unionByName(found)
    every = with_flow_key(messages.filter(F.col("qtype") == QTYPE_AXFR)).select(
        *FLOW_KEY, "ts", F.struct(F.unix_micros("ts").alias("t"), "msg_id", "is_response").alias("member")
    )
    return every.join(used.distinct(), key, "left_anti").select(
        *FLOW_KEY, "member.msg_id", "ts", "member.is_response"
    )


def waiting_times(
    messages: DataFrame, timeout_ms: int = 1000, skew: SkewPolicy = SkewPolicy()
) -> DataFrame:
    """(arrived, renewed, left) in µs of every entry of a zone transfer.

    An entry waits from its first message on until its transfer ends (`left`), or for the timeout after the last
    message it accepted (`renewed`).
    """
    timeout_us = timeout_ms * 1000
    out = None
    for part in _walked_parts(messages, timeout_ms, skew):
        pending = F.col("walk.pending")
        if "chunk" in part.columns:
            # What the next chunk has received is its own.
            following = part.select(*FLOW_KEY, (F.col("chunk") - 1).alias("chunk"), F.lit(True).alias("more"))
            part = cut_lineage(part.join(following, [*FLOW_KEY, "chunk"], "left"))
            edge = (F.col("chunk") + 1) * F.col("chunk_us") - timeout_us
            pending = F.filter("walk.pending", lambda p: F.col("more").isNull() | (p["t"] <= edge))
        never = F.lit(None).cast("bigint")

        def times(entry: Column, left: Column) -> Column:
            return F.struct(
                F.array_min(F.transform(entry["members"], lambda m: m["t"])).alias("arrived"), entry["t"].alias("renewed"), left.alias("left")
            )

        ended = F.transform("walk.done", lambda p: times(p, p["t"]))
        rest = F.transform(F.concat("walk.gone", pending), lambda p: times(p, never))
        found = part.select(F.inline(F.concat(ended, rest)))
        out = found if out is None else out.unionByName(found)
    return out
