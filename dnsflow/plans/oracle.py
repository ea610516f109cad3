"""DuckDB twins of the registered queries, written from the formulas of the derived tables."""

from __future__ import annotations

EVENTS = """
ev AS (SELECT event_id AS e, user_id AS u, event_type AS et, epoch_us(ts) AS t0 FROM events),
raw AS (
  SELECT e, u, et, false AS r, 0 AS n, t0 AS t FROM ev
  UNION ALL SELECT e, u, et, false, 1, t0 + 200000 FROM ev WHERE e % 13 = 0 AND e % 97 <> 0
  UNION ALL SELECT e, u, et, true, 0,
      CASE WHEN e % 17 = 0 THEN t0 - 300 ELSE t0 + (e * 7919) % 1200000 + 1 END
    FROM ev WHERE e % 10 <> 3 AND e % 97 <> 0
  UNION ALL SELECT e, u, et, true, 1, t0 + (e * 7919) % 1200000 + 150001
    FROM ev WHERE e % 26 = 0 AND e % 97 <> 0
  UNION ALL SELECT e, u, et, true, k::INTEGER,
      t0 + 100000 * (k + 1) + CASE WHEN e % 5 = 0 AND k = 3 THEN 1500000 ELSE 0 END
    FROM ev, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE e % 97 = 0
)"""

MESSAGES = EVENTS + """,
msg AS (
  SELECT e, u, et, r, n, t, e * 10 + CASE WHEN r THEN 5 ELSE 0 END + n AS msg_id,
    CASE WHEN u % 5 = 0 THEN 6 ELSE 4 END AS ipv,
    CASE WHEN u % 4 = 1 THEN 6 ELSE 17 END AS prot,
    (u % 7) * 31 + 1 AS o1, u % 256 AS o2, (u * 7) % 256 AS o3, e % 250 + 1 AS o4,
    CASE WHEN u % 5 = 0 THEN '2001:db8::' || (1000 + u % 9000)
      ELSE ((u % 7) * 31 + 1) || '.' || (u % 256) || '.' || ((u * 7) % 256) || '.' || (e % 250 + 1)
      END AS client_ip,
    CASE WHEN u % 5 = 0 THEN '2001:db8:ffff::' || (1 + e % 3)
      ELSE '192.0.2.' || (1 + e % 3) END AS server_ip,
    CASE WHEN u % 5 = 0 THEN '20010db800000000000000000000' || lpad((1000 + u % 9000)::VARCHAR, 4, '0')
      ELSE printf('%02x%02x%02x%02x', (u % 7) * 31 + 1, u % 256, (u * 7) % 256, e % 250 + 1)
      END AS client_hex,
    CASE WHEN u % 5 = 0 THEN '20010db8ffff0000000000000000' || lpad((1 + e % 3)::VARCHAR, 4, '0')
      ELSE printf('c00002%02x', 1 + e % 3) END AS server_hex,
    (1024 + e % 60000)::INTEGER AS client_port,
    CASE WHEN e % 41 = 0 THEN 5353 WHEN u % 4 = 1 AND e % 4 = 0 THEN 853
      WHEN u % 4 = 1 AND e % 4 = 1 THEN 443 ELSE 53 END AS server_port,
    ((e * 31) % 65536)::INTEGER AS id,
    CASE WHEN e % 59 = 0 THEN '' WHEN e % 53 = 0 THEN 'LocalHost'
      ELSE et || '.Zone' || (e % 11) || '.Example.' ||
        CASE u % 3 WHEN 0 THEN 'com' WHEN 1 THEN 'CZ' ELSE 'org' END END AS qname,
    CASE WHEN e % 97 = 0 THEN 252 WHEN e % 5 = 0 THEN 1 WHEN e % 5 = 1 THEN 28
      WHEN e % 5 = 2 THEN 15 WHEN e % 5 = 3 THEN 2 ELSE 6 END AS qtype,
    CASE WHEN r AND et = 'error' THEN 3 ELSE 0 END AS rcode,
    (CASE WHEN r THEN 100 + e % 400 + n ELSE 60 + e % 40 END)::INTEGER AS len,
    CASE WHEN r AND u % 4 = 1 THEN 100 + e % 5000 ELSE -1 END AS rtt_us,
    CASE WHEN r AND e % 31 < 3 THEN 128 + e % 31 WHEN r AND e % 31 = 3 THEN 255 ELSE 0 END AS policy,
    r AND e % 7 = 0 AS aa, r AND e % 19 = 0 AS tc, e % 3 <> 0 AS rd, r AS ra,
    e % 23 = 0 AS ad, e % 29 = 0 AS cd, NOT r AND e % 4 = 0 AS edns_do
  FROM raw
)"""

# The walk over the two time-ordered lists of a key, which is the event here.
PAIRS = MESSAGES + """,
lists AS (
  SELECT e, list(t ORDER BY t, msg_id) FILTER (NOT r) AS qs, list(msg_id ORDER BY t, msg_id) FILTER (NOT r) AS qm,
    list(t ORDER BY t, msg_id) FILTER (r) AS rs, list(msg_id ORDER BY t, msg_id) FILTER (r) AS rm
  FROM msg WHERE qtype <> 252 GROUP BY e
),
steps AS (
  SELECT e, 1 AS i, 1 AS j, NULL::BIGINT AS query_id, NULL::BIGINT AS response_id
  FROM lists WHERE len(qs) > 0 AND len(rs) > 0
  UNION ALL
  SELECT s.e,
    CASE WHEN abs(qs[i] - rs[j]) < 1000000 OR qs[i] < rs[j] THEN i + 1 ELSE i END,
    CASE WHEN abs(qs[i] - rs[j]) < 1000000 OR rs[j] < qs[i] THEN j + 1 ELSE j END,
    CASE WHEN abs(qs[i] - rs[j]) < 1000000 THEN qm[i] END,
    CASE WHEN abs(qs[i] - rs[j]) < 1000000 THEN rm[j] END
  FROM steps s JOIN lists l ON s.e = l.e WHERE i <= len(qs) AND j <= len(rs)
),
pairs AS (SELECT query_id, response_id FROM steps WHERE query_id IS NOT NULL),
joined AS (
  SELECT p.query_id, p.response_id, q.t AS query_us, s.t AS response_us, q.e, q.u, q.et,
    q.client_ip, q.server_ip, q.client_port, q.server_port, q.id, q.qname, q.qtype, q.ipv, q.prot,
    q.len, s.len AS res_len, q.rd, q.ra, q.ad, q.cd, s.aa, s.tc, s.rcode, q.edns_do, s.policy,
    CASE WHEN s.rtt_us > 0 THEN s.rtt_us ELSE q.rtt_us END AS rtt_us,
    (q.e % 4 + 1)::INTEGER AS ancount
  FROM pairs p JOIN msg q ON q.msg_id = p.query_id JOIN msg s ON s.msg_id = p.response_id
),
dns AS (SELECT * FROM joined WHERE client_port = 53 OR server_port = 53)"""

TXN = PAIRS + """,
txn AS (
  SELECT id, query_us // 1000000 AS unixtime, query_us AS time, qname,
    lower(array_to_string(string_split(qname, '.')[-2:], '.')) AS domainname,
    len, 0 AS frag, (64 - e % 3)::INTEGER AS ttl, ipv, prot, client_ip AS src, client_port AS srcp,
    server_ip AS dst, server_port AS dstp,
    (CASE WHEN u % 4 = 1 THEN 0 ELSE (e * 17) % 65536 END)::INTEGER AS udp_sum, len - 42 AS dns_len,
    aa, tc, rd, ra, false AS z, ad, cd, ancount, (e % 3)::INTEGER AS arcount,
    (e % 2)::INTEGER AS nscount, 1 AS qdcount, 0 AS opcode, rcode, qtype, 1 AS qclass,
    '' AS country, '' AS asn,
    CASE WHEN e % 2 = 0 THEN 1232 ELSE 0 END AS edns_udp, 0 AS edns_version, edns_do,
    false AS edns_ping, CASE WHEN e % 9 = 0 THEN 'ns' || (e % 3) ELSE '' END AS edns_nsid,
    CASE WHEN e % 6 = 0 THEN '8,13,15' ELSE '' END AS edns_dnssec_dau,
    '' AS edns_dnssec_dhu, '' AS edns_dnssec_n3u, '' AS edns_client_subnet, '' AS edns_other,
    '' AS edns_client_subnet_asn, '' AS edns_client_subnet_country,
    (CASE WHEN qname = '' THEN 0 ELSE len(string_split(qname, '.')) END)::INTEGER AS labels,
    res_len, query_us % 1000000 AS time_micro, 0 AS resp_frag, 0 AS proc_time,
    false AS is_google, false AS is_opendns, res_len - 42 AS dns_res_len, '' AS server_location,
    CASE WHEN rtt_us >= 0 THEN rtt_us / 1000.0::DOUBLE END AS tcp_hs_rtt, e
  FROM dns
)"""

# Repeated messages (n = 1) ask for a name of their own.
PAIRS_BY_NAME = PAIRS.replace(
    "FROM msg WHERE qtype <> 252 GROUP BY e",
    "FROM (SELECT * REPLACE (e * 10 + n AS e) FROM msg) WHERE qtype <> 252 GROUP BY e",
)

PAIR_VIEW = """SELECT query_id, response_id, query_us, response_us, res_len, rcode, ancount,
  rd, ra, rtt_us AS tcp_rtt_us FROM joined"""

COUNTERS = """count(*) FILTER (ipv = 4) AS ipv4, count(*) FILTER (ipv = 6) AS ipv6,
  count(*) FILTER (prot = 6 AND server_port NOT IN (853, 443)) AS tcp,
  count(*) FILTER (prot = 17) AS udp,
  count(*) FILTER (prot = 6 AND server_port = 853) AS dot,
  count(*) FILTER (prot = 6 AND server_port = 443) AS doh"""
NAMES = ("ipv4", "ipv6", "tcp", "udp", "dot", "doh")


def _each(template: str, joiner: str = ", ") -> str:
    return joiner.join(template.format(c=c) for c in NAMES)


def _ticks(unit_s: int, per_s: int, prefix: str = "") -> str:
    """CTE with the rate of every tick, quiet ones included."""
    p = prefix
    return f"""{p}counts AS (SELECT t // {unit_s * 1_000_000} AS tick, {COUNTERS} FROM msg WHERE NOT r GROUP BY 1),
{p}spine AS (SELECT unnest(range((SELECT min(tick) FROM {p}counts), (SELECT max(tick) FROM {p}counts) + 1)) AS tick),
{p}rates AS (SELECT tick, {_each(f"(coalesce({{c}}, 0) * {per_s}) // {unit_s} AS {{c}}")}
  FROM {p}spine LEFT JOIN {p}counts USING (tick))"""


def _moving(unit_s: int, per_s: int, window: int, prefix: str = "") -> str:
    p = prefix
    frame = f"OVER (ORDER BY tick ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"""{_ticks(unit_s, per_s, p)},
{p}moving AS (SELECT tick, {_each(f"(sum({{c}}) {frame} // count(*) {frame})::BIGINT AS {{c}}")},
  count(*) {frame} AS samples FROM {p}rates)"""


HISTOGRAM = "SELECT o1::INTEGER AS octet, count(*) AS n FROM msg WHERE NOT r AND ipv = 4 GROUP BY 1"

DAILY = f"""{_moving(3600, 3600, 24, "h_")},
day_counts AS (SELECT t // 86400000000 AS tick, {COUNTERS} FROM msg WHERE NOT r GROUP BY 1),
day_spine AS (SELECT unnest(range((SELECT min(tick) FROM day_counts), (SELECT max(tick) FROM day_counts) + 1)) AS tick),
totals AS (SELECT tick, {_each("sum(coalesce({c}, 0)) OVER (ORDER BY tick)::BIGINT AS {c}")}
  FROM day_spine LEFT JOIN day_counts USING (tick)),
octets AS (SELECT t // 86400000000 AS tick, o1, count(*) AS n FROM msg WHERE NOT r AND ipv = 4 GROUP BY 1, 2),
entropies AS (SELECT tick, -sum(n / total * log2(n / total)) AS entropy
  FROM (SELECT tick, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY tick))::DOUBLE AS total FROM octets) GROUP BY 1),
last_rates AS (SELECT tick // 24 AS day, {_each("arg_max({c}, tick) AS {c}")} FROM h_moving GROUP BY 1),
report AS (SELECT d.tick, round(coalesce(entropy, 0), 9) AS ipv4_source_entropy,
  {_each("d.{c} AS queries_{c}")}, d.ipv4 + d.ipv6 AS queries,
  {_each("l.{c} AS queries_per_second_{c}")}, l.ipv4 + l.ipv6 AS queries_per_second,
  (d.tick + 1) * 86400000000 AS unix_timestamp
  FROM totals d JOIN last_rates l ON l.day = d.tick LEFT JOIN entropies x ON x.tick = d.tick)"""


def _per_server(every: int, per_s: int, size: int = 25, unit_s: int = 3600) -> str:
    return f"""sv_counts AS (SELECT server_ip, t // {unit_s * 1_000_000} AS tick, {COUNTERS} FROM msg WHERE NOT r GROUP BY 1, 2),
sv_rates AS (SELECT server_ip, tick, {_each(f"({{c}} * {per_s}) // {unit_s} AS {{c}}")} FROM sv_counts),
sv_seen AS (SELECT server_ip, min(tick) AS seen FROM sv_rates GROUP BY 1),
sv_ends AS (SELECT min(tick) AS a, max(tick) AS b FROM sv_rates),
sv_reports AS (SELECT unnest(range(a // {every}, b // {every} + 2)) * {every} AS tick, a, b FROM sv_ends),
servers AS (SELECT s.server_ip, p.tick, {_each(f"(coalesce(sum(x.{{c}}), 0) // least({size}, p.tick - p.a + 1))::BIGINT AS {{c}}")}
  FROM sv_reports p JOIN sv_seen s ON s.seen <= p.tick
  LEFT JOIN sv_rates x ON x.server_ip = s.server_ip AND x.tick <= p.tick AND x.tick > p.tick - {size}
  WHERE p.tick < p.b + {every}
  GROUP BY s.server_ip, p.tick, p.a),
sv_totals AS (SELECT x.server_ip, p.tick, {_each("sum(x.{c})::BIGINT AS total_{c}")}
  FROM sv_reports p JOIN sv_counts x ON x.tick <= p.tick WHERE p.tick < p.b + {every} GROUP BY 1, 2)"""


def _ids(condition: str) -> str:
    return f"WITH {MESSAGES} SELECT msg_id, ipv, r AS is_response FROM msg WHERE {condition}"


NAME_TIME = "strftime(make_timestamp(t), '%Y%m%d.%H%M%S.')"
POLICY = "CASE policy WHEN 128 THEN 'PASS' WHEN 129 THEN 'BLOCK' WHEN 130 THEN 'AUDIT' END"
ALLOWED_V4 = "(o1 = 32 OR o1 IN (94, 95))"
DENIED_V4 = "(e % 3 = 1 OR o1 = 125)"
NSID_HEX = "'000300036E73' || CASE e % 3 WHEN 0 THEN '30' WHEN 1 THEN '31' ELSE '32' END"
OPT_TEXT = f"CASE WHEN e % 9 = 0 THEN '\\# 7 ' || {NSID_HEX} END"
DNS_FLAGS = """(CASE WHEN aa THEN 16384 ELSE 0 END + CASE WHEN tc THEN 8192 ELSE 0 END
  + CASE WHEN rd THEN 16 ELSE 0 END + CASE WHEN ra THEN 8 ELSE 0 END
  + CASE WHEN ad THEN 2 ELSE 0 END + CASE WHEN cd THEN 1 ELSE 0 END
  + CASE WHEN edns_do THEN 128 ELSE 0 END)::INTEGER"""

BLOCKS = PAIRS + """,
slots AS (SELECT *, query_us // 864000000000 AS slot FROM joined),
parts AS (SELECT slot, ceil(count(*) / 1000.0)::BIGINT AS parts FROM slots GROUP BY 1),
blocks AS (SELECT *, slot || '-' || (((query_id % 2147483648) * 2654435761 // 65536) % parts) || '-' ||
    ((row_number() OVER (PARTITION BY slot, ((query_id % 2147483648) * 2654435761 // 65536) % parts ORDER BY query_id) - 1) // 50) AS block_id
  FROM slots JOIN parts USING (slot))"""

# The message as it goes over the wire, by the same formulas as the derived bytes.
WIRE = MESSAGES + """,
bytes AS (SELECT *, msg_id AS k,
    CASE WHEN r THEN e % 4 + 1 ELSE 0 END AS answers, r AND e % 97 = 0 AND n = 3 AS soa,
    CASE WHEN NOT r AND e % 6 = 0 THEN '00050003080D0F' WHEN r AND e % 9 = 0 THEN
      '000300036E73' || CASE e % 3 WHEN 0 THEN '30' WHEN 1 THEN '31' ELSE '32' END END AS opt,
    CASE WHEN NOT r AND e % 2 = 0 THEN 1232 ELSE 0 END AS udp FROM msg),
wired AS (SELECT *, opt IS NOT NULL OR udp > 0 AS has_opt,
    12 + CASE WHEN qname = '' THEN 1 ELSE length(qname) + 2 END + 4 + 16 * answers
      + CASE WHEN soa THEN 36 ELSE 0 END
      + CASE WHEN opt IS NOT NULL OR udp > 0 THEN 11 + coalesce(length(opt) // 2, 0) ELSE 0 END AS size
  FROM bytes)"""
DECODED = """client_ip AS client, client_port, server_ip AS server, r AS is_response, id,
  rcode, (answers + CASE WHEN soa THEN 1 ELSE 0 END + CASE WHEN k % 41 = 0 THEN 60000 ELSE 0 END)::INTEGER AS ancount,
  CASE WHEN has_opt THEN 1 ELSE 0 END AS arcount, size::INTEGER AS dns_len"""
BODY = """udp AS edns_udp, edns_do, soa AS last_soa, qname, qtype, opt,
  CASE WHEN r THEN (answers + CASE WHEN soa THEN 1 ELSE 0 END)::INTEGER END AS answers,
  CASE WHEN r THEN array_to_string(list_transform(range(answers + CASE WHEN soa THEN 1 ELSE 0 END), lambda i: qname), '|') END AS rr_name,
  CASE WHEN r THEN array_to_string(list_transform(range(1, answers + 1), lambda i: '192.0.2.' || i)
    || CASE WHEN soa THEN [CASE WHEN qname = '' THEN '. .' ELSE qname || '. ' || qname || '.' END || ' 10 10 10 10 10'] ELSE [] END, '|') END AS rr_data"""
NO_BODY = """NULL AS edns_udp, NULL AS edns_do, NULL AS last_soa, NULL AS qname, NULL AS qtype, NULL AS opt,
  NULL AS answers, NULL AS rr_name, NULL AS rr_data"""
# Frame errors of derived packets; only UDP traffic is framed.
PACKETS = WIRE + """,
framed AS (SELECT *, CASE
    WHEN k % 31 = 0 THEN 'drop: not IP'
    WHEN k % 29 = 0 AND ipv = 6 THEN 'error: IP header cut off'
    WHEN k % 37 = 0 THEN 'drop: not TCP or UDP'
    WHEN k % 29 = 0 THEN 'error: packet shorter than its IP header claims'
    WHEN server_port <> 53 THEN 'drop: port'
    WHEN k % 41 = 0 AND (answers > 0 OR has_opt) THEN 'error: records cut off' END AS error,
    14 + CASE WHEN ipv = 6 THEN 40 ELSE 20 END + 8 + size AS full_len
  FROM wired WHERE prot = 17)"""

# Segments of the derived connections: three of the handshake, the pieces of all messages, and how they end.
TCP = WIRE + """,
streams AS (SELECT *, n * (size + 2 - CASE WHEN soa THEN 36 ELSE 0 END) AS before, size + 2 AS total, CASE WHEN e % 9 = 0 THEN 1 WHEN e % 3 = 0 THEN 10 ELSE size + 2 END AS cut,
    r::INTEGER AS side, CASE WHEN e % 6 = 0 THEN -2 ELSE 2 END AS wait
  FROM wired WHERE prot = 6 AND e % 11 <> 0),
pieces AS (
  SELECT e, side, n, 0 AS o, before AS pos, t AS us, cut AS bytes FROM streams
  UNION ALL SELECT e, side, n, 1, before + cut, t + wait, total - cut FROM streams WHERE e % 3 = 0
  UNION ALL SELECT e, side, n, 2, before, t + 5, cut FROM streams WHERE e % 7 = 0),
found AS (SELECT *, t + CASE WHEN e % 3 = 0 THEN greatest(wait, 0) ELSE 0 END AS us,
    (total + CASE WHEN e % 3 = 0 THEN 108 ELSE 54 END)::INTEGER AS packet_bytes FROM streams),
ranked AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY e ORDER BY us) = 1
    THEN 2000 + e % 5000 ELSE -1 END AS tcp_rtt FROM found)"""

TRANSFERS = f"""WITH {MESSAGES}, gaps AS (
        SELECT *, t - lag(t) OVER (PARTITION BY e ORDER BY t) AS gap FROM msg WHERE qtype = 252)
      SELECT min(msg_id) FILTER (NOT r) AS query_id, min(msg_id) FILTER (r) AS response_id,
        (sum(len) FILTER (r))::INTEGER AS res_len, (sum(len - 42) FILTER (r))::INTEGER AS res_dns_len,
        (sum(e % 4 + 1) FILTER (r))::INTEGER AS ancount, max(rcode) AS rcode
      FROM gaps GROUP BY e HAVING coalesce(max(gap), 0) < 1000000"""

# Entries of zone transfers: answered to the end, given up before the last response, or that response alone.
TRANSFER_WAITS = """SELECT t0, t0 + 400000 FROM ev WHERE e % 97 = 0 AND e % 5 <> 0
        UNION ALL SELECT t0, t0 + 1300000 FROM ev WHERE e % 97 = 0 AND e % 5 = 0
        UNION ALL SELECT t0 + 1900000, t0 + 2900000 FROM ev WHERE e % 97 = 0 AND e % 5 = 0"""

ORACLE: dict[str, str] = {
    "txn_flagship": f"WITH RECURSIVE {TXN} SELECT * EXCLUDE (e) FROM txn",
    "txn_by_domain": f"""WITH RECURSIVE {TXN} SELECT domainname, rcode, count(*) AS n,
      sum(res_len)::BIGINT AS bytes, count(tcp_hs_rtt) AS n_rtt FROM txn GROUP BY 1, 2""",
    "match_fifo": f"WITH RECURSIVE {PAIRS} {PAIR_VIEW}",
    "match_qname": f"WITH RECURSIVE {PAIRS_BY_NAME} {PAIR_VIEW}",
    "match_unmatched": f"""WITH RECURSIVE {PAIRS} SELECT msg_id, t AS time_us, r AS is_response FROM msg
      WHERE qtype <> 252 AND msg_id % 2910 <> 8 AND msg_id NOT IN (SELECT query_id FROM pairs)
        AND msg_id NOT IN (SELECT response_id FROM pairs)
      UNION ALL SELECT msg_id, t, r FROM (
        SELECT *, lag(t) OVER (PARTITION BY e ORDER BY t) AS before FROM msg WHERE qtype = 252 AND msg_id % 2910 <> 8)
      QUALIFY count_if(r AND n = 3) OVER (PARTITION BY e) = 0
        OR count_if(NOT r) OVER (PARTITION BY e) = 0 OR max(coalesce(t - before, 0)) OVER (PARTITION BY e) >= 1000000""",
    "match_axfr": TRANSFERS,
    "stream_axfr": TRANSFERS,
    "flow_key": f"""WITH {MESSAGES} SELECT least(client_port, server_port) AS port_lo, prot, ipv, qtype,
        count(*) AS n, count(DISTINCT e) AS flows FROM msg GROUP BY 1, 2, 3, 4""",
    "ingest_paired_union": f"""WITH RECURSIVE {PAIRS}
      SELECT 'wire' AS source, prot, qtype, count(*) AS n, sum(res_len - 42)::BIGINT AS bytes,
        sum(res_len)::BIGINT AS wire FROM dns GROUP BY 2, 3
      UNION ALL SELECT 'feed', prot, qtype, count(*), sum(res_len - 42)::BIGINT, 0::BIGINT
        FROM dns GROUP BY 2, 3""",
    "input_union": f"""WITH {MESSAGES} SELECT CASE WHEN r THEN 'tap' ELSE 'capture' END AS source,
        count(*) AS n, sum(len)::BIGINT AS bytes, count(*) FILTER (NOT r) AS sums FROM msg GROUP BY 1""",
    "port_filter": f"""WITH {MESSAGES} SELECT msg_id, client_port, server_port FROM msg
      WHERE client_port IN (53, 853) OR server_port IN (53, 853)""",
    "transport_filter": f"WITH {MESSAGES} SELECT prot, count(*) AS n FROM msg WHERE prot IN (6, 17) AND msg_id % 37 <> 0 GROUP BY 1",
    "cidr_allow_v4": _ids(f"ipv = 6 OR {ALLOWED_V4}"),
    "cidr_deny_v4": _ids(f"ipv = 6 OR NOT {DENIED_V4}"),
    "cidr_allow_over_deny": _ids(f"CASE WHEN ipv = 4 THEN {ALLOWED_V4} ELSE e % 3 <> 0 END"),
    "cidr_v6": _ids(
        f"CASE WHEN ipv = 4 THEN NOT {DENIED_V4} "
        "ELSE ('0x' || (1000 + u % 9000))::BIGINT // 4096 = 1 END"
    ),
    "cidr_long_list": _ids("ipv = 6 OR (o2 >= 64 AND o2 <= 142 AND o2 % 2 = 0)"),
    "parse_cidr": f"""WITH {MESSAGES}, p AS (
        SELECT msg_id, (msg_id % 40)::INTEGER AS bits, o1 * 16777216 + o2 * 65536 + o3 * 256 + o4 AS ip
        FROM msg WHERE ipv = 4 AND msg_id % 40 <= 32),
      b AS (SELECT msg_id, bits, (ip // (1::BIGINT << (32 - bits))) * (1::BIGINT << (32 - bits)) AS lo,
        (1::BIGINT << (32 - bits)) - 1 AS span FROM p)
      SELECT msg_id, bits,
        (lo // 16777216) || '.' || (lo // 65536 % 256) || '.' || (lo // 256 % 256) || '.' || (lo % 256) AS base,
        ((lo + span) // 16777216) || '.' || ((lo + span) // 65536 % 256) || '.' ||
          ((lo + span) // 256 % 256) || '.' || ((lo + span) % 256) AS last FROM b
      UNION ALL SELECT msg_id, bits, '20010db800000000000000000000' || printf('%04x', x // span * span),
        '20010db800000000000000000000' || printf('%04x', x // span * span + span - 1)
      FROM (SELECT msg_id, (112 + msg_id % 20)::INTEGER AS bits, ('0x' || (1000 + u % 9000))::BIGINT AS x,
          1::BIGINT << (16 - msg_id % 20)::INTEGER AS span FROM msg WHERE ipv = 6 AND msg_id % 20 <= 16)
      UNION ALL SELECT msg_id, NULL, NULL, NULL FROM msg
        WHERE CASE WHEN ipv = 4 THEN msg_id % 40 > 32 ELSE msg_id % 20 > 16 END""",
    "dnstap_reject": f"""WITH {MESSAGES}, k AS (SELECT msg_id AS k FROM msg)
      SELECT CASE WHEN k % 11 = 0 THEN 'error: message type missing'
          WHEN k % 13 = 0 THEN 'error: family or address missing'
          WHEN k % 17 = 0 THEN 'error: protocol or port missing'
          WHEN k % 3 = 2 THEN 'drop: unknown family'
          WHEN k % 8 IN (0, 5, 6) THEN 'drop: unknown protocol'
          WHEN k % 16 IN (0, 15) THEN 'error: unknown message type'
          WHEN k % 19 = 0 THEN 'error: DNS data missing' ELSE 'ok' END AS reason,
        CASE WHEN k % 8 IN (1, 7) THEN 17 WHEN k % 8 IN (2, 3, 4) THEN 6 END AS prot,
        count(*) AS n FROM k GROUP BY 1, 2""",
    "domainname": f"""WITH {MESSAGES} SELECT msg_id,
        lower(array_to_string(string_split(qname, '.')[-2:], '.')) AS domainname FROM msg""",
    "label_count": f"""WITH {MESSAGES} SELECT msg_id,
        (CASE WHEN qname = '' THEN 0 ELSE len(string_split(qname, '.')) END)::INTEGER AS labels FROM msg""",
    "page_hosts": """WITH h AS (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages)
      SELECT lower(array_to_string(string_split(host, '.')[-2:], '.')) AS domainname,
        (CASE WHEN host = '' THEN 0 ELSE len(string_split(host, '.')) END)::INTEGER AS labels,
        count(*) AS n FROM h GROUP BY 1, 2""",
    "wire_names": f"""WITH {MESSAGES} SELECT msg_id, qname,
        (CASE WHEN qname = '' THEN 1 ELSE length(qname) + 2 END)::INTEGER AS size FROM msg""",
    "split_time": f"""WITH {MESSAGES} SELECT msg_id, t // 1000000 AS unixtime, t AS time,
        t % 1000000 AS time_micro FROM msg""",
    "ip_text": f"WITH {MESSAGES} SELECT msg_id, client_ip AS src, server_ip AS dst FROM msg",
    "ip_binary": f"WITH {MESSAGES} SELECT msg_id, client_hex AS digits FROM msg",
    "transport_class": f"""WITH {MESSAGES} SELECT msg_id, CASE WHEN prot = 17 THEN 'udp'
        WHEN server_port = 853 THEN 'dot' WHEN server_port = 443 THEN 'doh' ELSE 'tcp' END AS transport FROM msg""",
    "rtt_ms": f"""WITH {MESSAGES} SELECT msg_id,
        CASE WHEN rtt_us >= 0 THEN rtt_us / 1000.0::DOUBLE END AS rtt FROM msg""",
    "policy_label": f"""WITH {MESSAGES} SELECT msg_id, {POLICY} AS label,
        CASE WHEN msg_id % 3 = 0 THEN 0 WHEN msg_id % 2 = 1 THEN 130 WHEN msg_id % 7 = 3 THEN 128
          WHEN msg_id % 7 = 1 THEN 129 ELSE 255 END AS code FROM msg""",
    "code_list": f"""WITH {MESSAGES} SELECT msg_id, CASE WHEN ipv = 4 THEN '192,0,2,' || (1 + e % 3)
        ELSE '32,1,13,184,255,255,0,0,0,0,0,0,0,0,0,' || (1 + e % 3) END AS codes FROM msg""",
    "extra_kv": f"""WITH {MESSAGES} SELECT msg_id, client_port::BIGINT AS rtt, 'u-' || u AS user_key FROM msg""",
    "flag_bitmasks": f"""WITH {MESSAGES} SELECT msg_id,
        CASE WHEN ipv = 6 THEN 1 ELSE 0 END + CASE WHEN prot = 6 THEN 2 ELSE 0 END AS transport_flags,
        {DNS_FLAGS} AS dns_flags, id // 64 % 2 = 1 AS bit FROM msg""",
    "first_octet": f"""WITH {MESSAGES} SELECT msg_id,
        (CASE WHEN ipv = 4 THEN o1 ELSE 32 END)::INTEGER AS octet FROM msg""",
    "filename_parts": f"""WITH {MESSAGES} SELECT msg_id,
        CASE WHEN msg_id % 50 <> 0 THEN t // 1000 END AS time_ms,
        CASE WHEN msg_id % 50 <> 0 THEN 'p' || (msg_id % 4) END AS process,
        CASE WHEN msg_id % 50 <> 0 THEN CASE WHEN r THEN 'parquet' ELSE 'json' END END AS format,
        CASE WHEN msg_id % 50 <> 0 THEN NOT r END AS gzip FROM msg""",
    "direction_normalise": f"""WITH {MESSAGES} SELECT msg_id,
        CASE WHEN client_hex <= server_hex THEN client_ip ELSE server_ip END AS addr_lo,
        CASE WHEN client_hex <= server_hex THEN server_ip ELSE client_ip END AS addr_hi,
        least(client_port, server_port) AS port_lo, greatest(client_port, server_port) AS port_hi,
        client_hex <= server_hex AS client_low FROM msg""",
    "length_routing": f"""WITH {MESSAGES} SELECT r AS is_response,
        coalesce(sum(len) FILTER (NOT r), 0)::BIGINT AS len, coalesce(sum(len - 42) FILTER (NOT r), 0)::BIGINT AS dns_len,
        coalesce(sum(len) FILTER (r), 0)::BIGINT AS res_len,
        coalesce(sum(len - 42) FILTER (r), 0)::BIGINT AS res_dns_len FROM msg GROUP BY 1""",
    "anonymise_counts": f"""WITH {MESSAGES} SELECT ipv, count(*) AS n, count(DISTINCT client_ip) AS addresses,
        count(DISTINCT client_ip) AS pairs, count(DISTINCT substr(client_hex, 1, 4)) AS prefixes16,
        count(DISTINCT substr(client_hex, 1, 6)) AS prefixes24,
        sum(length(client_hex) // 2)::BIGINT AS bytes FROM msg GROUP BY 1""",
    "txn_json_rrs": f"""WITH RECURSIVE {PAIRS} SELECT id, query_us AS time, 'u-' || u AS user_id,
        {POLICY} AS policy_action, CASE WHEN e % 31 < 4 THEN 'rule' || (e % 5) END AS policy_rule,
        ancount AS answers, '192.0.2.1' AS first_rdata, true AS no_authority,
        CASE WHEN e % 9 = 0 THEN CASE WHEN e % 2 = 0 THEN 1232 ELSE 0 END END AS opt_class,
        {OPT_TEXT} AS opt_rdata FROM dns""",
    "rr_explode": f"""WITH {MESSAGES} SELECT msg_id, k::INTEGER AS pos, qname AS name, 1 AS type, 1 AS class,
        (301 + k)::BIGINT AS ttl, '192.0.2.' || (1 + k) AS rdata
      FROM msg, (SELECT unnest([0, 1, 2, 3]) AS k) WHERE r AND k <= e % 4""",
    "order_lists": """SELECT l_orderkey,
        (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::INTEGER AS pos,
        l_linenumber, l_partkey FROM lineitem""",
    "field_subset": f"""WITH RECURSIVE {PAIRS} SELECT query_id, id AS transaction_id, {DNS_FLAGS} AS qr_dns_flags,
        CASE WHEN e % 6 = 0 THEN '00050003080D0F' END AS query_opt_data, res_len - 42 AS response_size,
        CASE WHEN policy <> 0 THEN policy::INTEGER END AS policy_action FROM dns""",
    "block_sizes": f"""WITH RECURSIVE {BLOCKS} SELECT block_id, count(*) AS n, min(query_id) AS first,
        max(query_id) AS last FROM blocks GROUP BY 1""",
    "block_dictionaries": f"""WITH RECURSIVE {BLOCKS},
      rr AS (SELECT block_id, e, qname, 1 AS type, 1 AS class, (300 + k) AS ttl, '192.0.2.' || k AS rdata
        FROM blocks, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= ancount
        UNION ALL SELECT block_id, e, '', 41, CASE WHEN e % 2 = 0 THEN 1232 ELSE 0 END, NULL, {OPT_TEXT}
        FROM blocks WHERE e % 9 = 0),
      ref AS (
        SELECT block_id, 'names' AS dictionary, qname AS v FROM blocks
        UNION ALL SELECT block_id, 'names', '00050003080D0F' FROM blocks WHERE e % 6 = 0
        UNION ALL SELECT block_id, 'names', qname FROM rr
        UNION ALL SELECT block_id, 'names', rdata FROM rr
        UNION ALL SELECT block_id, 'addresses', client_ip FROM blocks
        UNION ALL SELECT block_id, 'addresses', server_ip FROM blocks
        UNION ALL SELECT block_id, 'classtypes', qtype || '/1' FROM blocks
        UNION ALL SELECT block_id, 'classtypes', type || '/' || class FROM rr
        UNION ALL SELECT block_id, 'signatures', concat_ws('/', server_ip, server_port, ipv, prot, {DNS_FLAGS},
          ancount, e % 3, e % 2, rcode, qtype, e % 2, e % 6 = 0) FROM blocks
        UNION ALL SELECT block_id, 'records', concat_ws('/', qname, type, class, coalesce(ttl, -1), rdata) FROM rr
        UNION ALL SELECT block_id, 'record_lists', qname || '*' || ancount FROM blocks
        UNION ALL SELECT block_id, 'record_lists', 'opt' || (e % 2) || {OPT_TEXT} FROM blocks WHERE e % 9 = 0)
      SELECT dictionary, block_id, count(DISTINCT v) AS n, count(DISTINCT v) - 1 AS last FROM ref GROUP BY 1, 2""",
    "block_round_trip": f"""WITH RECURSIVE {PAIRS} SELECT query_id, qname AS query_name, client_ip AS src,
        server_ip AS dst, server_port, {DNS_FLAGS} AS qr_dns_flags, qtype, ancount AS query_ancount,
        CASE WHEN e % 6 = 0 THEN '00050003080D0F' END AS query_opt, '192.0.2.1' AS first_rdata,
        ancount AS answers, {OPT_TEXT} AS opt_rdata FROM joined""",
    "query_counters": f"WITH {MESSAGES} SELECT *, ipv4 + ipv6 AS queries FROM (SELECT {COUNTERS} FROM msg WHERE NOT r)",
    "query_counters_per_server": f"""WITH {MESSAGES} SELECT *, ipv4 + ipv6 AS queries FROM (
        SELECT server_ip, {COUNTERS} FROM msg WHERE NOT r AND ipv = 4 GROUP BY 1)""",
    "octet_histogram": f"WITH {MESSAGES} {HISTOGRAM}",
    "merge_stats": f"WITH {MESSAGES} {HISTOGRAM}",
    "source_entropy": f"""WITH {MESSAGES}, h AS ({HISTOGRAM})
      SELECT round(-sum(n / total * log2(n / total)), 9) AS entropy
      FROM (SELECT n::DOUBLE AS n, (sum(n) OVER ())::DOUBLE AS total FROM h)""",
    "entropy_series": f"""WITH {MESSAGES}, h AS (SELECT t // 86400000000 AS tick, o1, count(*) AS n FROM msg
        WHERE NOT r AND ipv = 4 GROUP BY 1, 2)
      SELECT tick, round(-sum(n / total * log2(n / total)), 9) AS entropy
      FROM (SELECT tick, n::DOUBLE AS n, (sum(n) OVER (PARTITION BY tick))::DOUBLE AS total FROM h) GROUP BY 1""",
    "pipeline_counters": f"""WITH RECURSIVE {PAIRS}, c AS (SELECT (SELECT count(*) FROM msg) AS m, (SELECT count(*) FROM dns) AS d)
      SELECT 'processed-packets' AS stage, m AS n FROM c UNION ALL SELECT 'processed-transactions', d FROM c
      UNION ALL SELECT 'exported-records', d FROM c UNION ALL SELECT 'exported-pcap-packets', m FROM c""",
    "pending_gauge": f"""WITH RECURSIVE {PAIRS}, waits AS (
        SELECT least(query_us, response_us) AS a, greatest(query_us, response_us) AS b FROM joined
        UNION ALL SELECT t, t + 1000000 FROM msg WHERE qtype <> 252
          AND msg_id NOT IN (SELECT query_id FROM pairs) AND msg_id NOT IN (SELECT response_id FROM pairs)
        UNION ALL {TRANSFER_WAITS}),
      ticks AS (SELECT a, b, unnest([(a + 999999) // 1000000, (a + 999999) // 1000000 + 1]) AS tick FROM waits)
      SELECT tick, count(*) AS pending FROM ticks WHERE tick * 1000000 >= a AND tick * 1000000 < b GROUP BY 1""",
    "qps": f"WITH {MESSAGES}, {_ticks(3600, 3600)} SELECT * FROM rates",
    "qps_moving_average": f"WITH {MESSAGES}, {_moving(3600, 3600, 24)} SELECT * FROM moving",
    "qps_moving_average_minutes": f"WITH {MESSAGES}, {_moving(60, 3600, 300)} SELECT * FROM moving",
    "qps_moving_average_per_server": f"WITH {MESSAGES}, {_per_server(10, 86400)} SELECT * FROM servers",
    "stats_report": f"WITH {MESSAGES}, {DAILY} SELECT * FROM report",
    "stats_report_full": f"""WITH RECURSIVE {PAIRS}, {DAILY}, met AS (
        SELECT least(query_us, response_us) AS a, greatest(query_us, response_us) AS b FROM joined),
      waits AS (SELECT a, b FROM met UNION ALL SELECT t, t + 1000000 FROM msg WHERE qtype <> 252
          AND msg_id NOT IN (SELECT query_id FROM pairs) AND msg_id NOT IN (SELECT response_id FROM pairs)
        UNION ALL {TRANSFER_WAITS})
      SELECT r.*, (SELECT count(*) FROM msg WHERE t // 86400000000 <= r.tick) AS processed_packets,
        (SELECT count(*) FROM met WHERE b // 86400000000 <= r.tick) AS processed_transactions,
        (SELECT count(*) FROM met WHERE b // 86400000000 <= r.tick) AS exported_records,
        (SELECT count(*) FROM msg m WHERE m.r AND t // 86400000000 <= r.tick) AS exported_pcap_packets,
        (SELECT count(*) FROM waits WHERE a <= r.unix_timestamp AND b > r.unix_timestamp) AS pending_transactions
      FROM report r""",
    "stats_subset": f"WITH {MESSAGES}, {DAILY} SELECT tick, queries_dot, queries, unix_timestamp FROM report",
    "geo_country": f"""WITH {MESSAGES} SELECT msg_id,
        CASE WHEN ipv = 4 THEN coalesce(chr((65 + n_nationkey)::INTEGER) || 'X', '')
          ELSE coalesce('R' || r_regionkey, '') END AS country
      FROM msg LEFT JOIN nation ON ipv = 4 AND n_nationkey = o1 // 10 AND n_nationkey % 7 <> 3
        LEFT JOIN region ON ipv = 6 AND r_regionkey = (u % 9000) // 300 AND r_regionkey % 2 = 0""",
    "geo_asn": f"""WITH {MESSAGES} SELECT msg_id,
        CASE WHEN ipv = 4 THEN coalesce((64500 + n_nationkey)::VARCHAR, '')
          ELSE coalesce((65000 + r_regionkey)::VARCHAR, '') END AS asn
      FROM msg LEFT JOIN nation ON ipv = 4 AND n_nationkey = o1 // 10 AND n_nationkey % 7 <> 3
        LEFT JOIN region ON ipv = 6 AND r_regionkey = (u % 9000) // 300 AND r_regionkey % 2 = 0""",
    "txn_enriched": f"""WITH RECURSIVE {PAIRS} SELECT
        CASE WHEN ipv = 4 THEN coalesce(chr((65 + n_nationkey)::INTEGER) || 'X', '') ELSE coalesce('R' || r_regionkey, '') END AS country,
        CASE WHEN ipv = 4 THEN coalesce((64500 + n_nationkey)::VARCHAR, '') ELSE coalesce((65000 + r_regionkey)::VARCHAR, '') END AS asn,
        count(*) AS n, count(DISTINCT client_ip) AS clients
      FROM dns LEFT JOIN nation ON ipv = 4 AND n_nationkey = ((u % 7) * 31 + 1) // 10 AND n_nationkey % 7 <> 3
        LEFT JOIN region ON ipv = 6 AND r_regionkey = (u % 9000) // 300 AND r_regionkey % 2 = 0
      GROUP BY 1, 2""",
    "parquet_round_trip": f"WITH RECURSIVE {TXN} SELECT * EXCLUDE (e) FROM txn",
    "json_round_trip": f"""WITH RECURSIVE {TXN} SELECT t.id, t.time, t.qname, t.src, t.tcp_hs_rtt, 'u-' || d.u AS user_id,
        {POLICY} AS policy_action, d.ancount AS answers, 301::BIGINT AS ttl
      FROM txn t JOIN dns d ON t.e = d.e AND t.time = d.query_us""",
    "stats_json_round_trip": f"""WITH {MESSAGES}, {DAILY}, {_per_server(24, 3600)},
      long AS (
        SELECT NULL AS ip, unnest(['ipv4-source-entropy', 'queries', 'queries-per-second', 'unix-timestamp',
            {_each("'queries-{c}', 'queries-per-second-{c}'")}]) AS metric,
          unnest([ipv4_source_entropy, queries, queries_per_second, unix_timestamp,
            {_each("queries_{c}, queries_per_second_{c}")}]::DOUBLE[]) AS value FROM report
        UNION ALL SELECT server_ip, unnest([{_each("'queries-{c}', 'queries-per-second-{c}'")}]), unnest([{_each("total_{c}, {c}")}]::DOUBLE[])
          FROM servers JOIN sv_totals USING (server_ip, tick) WHERE tick // 24 IN (SELECT tick FROM report))
      SELECT ip, metric, count(*) AS n, round(sum(value), 6) AS total FROM long GROUP BY 1, 2""",
    "decode_packets": f"""WITH {PACKETS}
      SELECT k AS packet_no, error, full_len::INTEGER AS len, (64 - e % 3)::INTEGER AS ttl,
        ((e * 17) % 65536)::INTEGER AS udp_sum, {DECODED}, {BODY} FROM framed WHERE error IS NULL
      UNION ALL SELECT k, error, full_len::INTEGER, (64 - e % 3)::INTEGER, ((e * 17) % 65536)::INTEGER,
        {DECODED}, {NO_BODY} FROM framed WHERE error = 'error: records cut off'
      UNION ALL SELECT k, error, 50, (64 - e % 3)::INTEGER, NULL,
        NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {NO_BODY} FROM framed
        WHERE error LIKE 'error: %IP header%'""",
    "dnstap_decode": f"""WITH {WIRE},
      taps AS (SELECT *, CASE WHEN k % 43 = 0 THEN 'error: message type missing'
        WHEN k % 47 = 0 THEN 'error: protocol or port missing'
        WHEN server_port <> 53 THEN 'drop: port'
        WHEN k % 41 = 0 AND (answers > 0 OR has_opt) THEN 'error: records cut off' END AS error FROM wired),
      shared AS (SELECT *, 'u-' || u AS user_id, policy::INTEGER AS policy_action,
        CASE WHEN policy <> 0 THEN 'rule' || (e % 5) END AS policy_rule, t AS time_us FROM taps)
      SELECT k AS packet_no, error, {DECODED}, {BODY}, prot, rtt_us AS tcp_rtt_us, user_id, policy_action,
        policy_rule, time_us FROM shared WHERE error IS NULL
      UNION ALL SELECT k, error, {DECODED}, {NO_BODY}, prot, rtt_us, user_id, policy_action, policy_rule, time_us
        FROM shared WHERE error = 'error: records cut off'
      UNION ALL SELECT k, error, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {NO_BODY}, prot, rtt_us, user_id,
        policy_action, policy_rule, time_us
        FROM shared WHERE error LIKE '%missing'""",
    "invalid_split": f"""WITH {PACKETS}
      SELECT coalesce(error, 'valid') AS reason, count(*) AS n, sum(CASE WHEN error IS NULL THEN full_len
        WHEN k % 29 = 0 THEN 36 ELSE full_len - 14 END)::BIGINT AS bytes
      FROM framed WHERE error IS NULL OR error LIKE 'error%' GROUP BY 1""",
    "tcp_sessions": f"""WITH {TCP} SELECT 'c' || e AS conn, 1::BIGINT AS session, min(t0) - 400000 AS first_us,
        CASE e % 4 WHEN 0 THEN greatest(max(us), min(t0) - 398000 + e % 5000) WHEN 1 THEN min(t0) + 3000004
          WHEN 2 THEN min(t0) + 3000001 ELSE min(t0) + 3000000 END AS last_us,
        2 + count(*) FILTER (side = 0) + [0, 3, 2, 1][e % 4 + 1] AS from_client,
        1 + count(*) FILTER (side = 1) + [0, 2, 0, 0][e % 4 + 1] AS from_server,
        (sum(bytes) + [0, 20, 20, 0][e % 4 + 1])::BIGINT AS bytes, 2000 + e % 5000 AS handshake_us, e % 4 = 3 AS reset,
        ['ESTABLISHED', 'CLOSED', 'FIN1', 'CLOSED'][e % 4 + 1] AS state
      FROM pieces JOIN ev USING (e) GROUP BY e""",
    "tcp_reorder": f"""WITH {TCP} SELECT 'c' || p.e AS conn, p.side, pos::BIGINT AS pos, bytes::INTEGER AS size, p.us,
        CASE WHEN o = 1 THEN greatest(s.t, p.us) ELSE p.us END AS released_us, true AS whole
      FROM pieces p JOIN streams s ON s.e = p.e AND s.side = p.side AND s.n = p.n WHERE o < 2""",
    "tcp_handshake_rtt": f"""WITH {TCP} SELECT DISTINCT 'c' || e AS conn, 1::BIGINT AS session,
        t0 - 398000 + e % 5000 AS us, 2000 + e % 5000 AS rtt_us FROM streams JOIN ev USING (e)""",
    "tcp_duplicates": f"""WITH {TCP} SELECT 'c' || e AS conn, side, 2::BIGINT AS copies FROM streams WHERE e % 7 = 0""",
    "tcp_overflow": f"""WITH {TCP} SELECT side, count(*) AS n, sum(packet_bytes)::BIGINT AS bytes
      FROM found WHERE e % 6 <> 0 GROUP BY 1""",
    "tcp_framing": f"""WITH {TCP},
      checked AS (SELECT *, CASE WHEN k % 41 = 0 AND (answers > 0 OR has_opt) THEN 'error: records cut off' END AS error
        FROM ranked)
      SELECT 'c' || e AS conn, error, packet_bytes AS len, (64 - e % 3)::INTEGER AS ttl, tcp_rtt AS tcp_rtt_us, us,
        {DECODED}, {BODY} FROM checked WHERE error IS NULL
      UNION ALL SELECT 'c' || e, error, packet_bytes, (64 - e % 3)::INTEGER, tcp_rtt, us, {DECODED}, {NO_BODY}
        FROM checked WHERE error IS NOT NULL""",
    "capture_messages": f"""WITH {TCP}
      SELECT client_port, server_port, r AS is_response, id, qname, qtype, rcode, prot, t AS time_us, size::INTEGER AS dns_len,
        -1::BIGINT AS tcp_rtt_us FROM wired WHERE prot = 17 AND k % 31 <> 0 AND k % 37 <> 0 AND k % 29 <> 0
          AND server_port = 53 AND NOT (k % 41 = 0 AND (answers > 0 OR has_opt))
      UNION ALL SELECT client_port, server_port, r, id, qname, qtype, rcode, prot, us, size::INTEGER, tcp_rtt FROM ranked
        WHERE server_port <> 5353 AND NOT (k % 41 = 0 AND (answers > 0 OR has_opt))""",
    "stream_match": f"WITH RECURSIVE {PAIRS} {PAIR_VIEW}",
    "stream_stats": f"""WITH {MESSAGES} SELECT *, ipv4 + ipv6 AS queries FROM (
        SELECT t // 3600000000 AS tick, {COUNTERS} FROM msg WHERE NOT r GROUP BY 1)""",
    "stream_tcp": f"""WITH {TCP} SELECT 'c' || e AS conn, side, before::BIGINT AS pos, us, packet_bytes AS len,
        tcp_rtt AS tcp_rtt_us, size::INTEGER AS size FROM ranked""",
    "landing_dir": f"""WITH RECURSIVE {TXN} SELECT domainname, rcode, count(*) AS n,
      sum(res_len)::BIGINT AS bytes, count(tcp_hs_rtt) AS n_rtt FROM txn GROUP BY 1, 2""",
}
