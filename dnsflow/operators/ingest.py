"""From packets to messages, whatever the transport."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsflow.operators import decode, tcp
from dnsflow.plans.shared import shared_folder
from dnsflow.schema import DNS_PORT


def packets_to_messages(
    packets: DataFrame, ports=(DNS_PORT,), allow=(), deny=(), with_rrs: bool = False, **tcp_options
) -> DataFrame:
    """Messages of all UDP packets and TCP connections, with ids that are unique if packet numbers are.

    `tcp_options` go to the reassembly (timeout, buffer limit, skew). Segments are written once to the shared folder: the
    reassembly counts them twice before it deals them, and none of that should read the packets again.
    """
    datagrams = decode.as_messages(decode.decode_packets(packets, ports, allow, deny, with_rrs))
    segments = _written(decode.tcp_segments(packets, ports, allow, deny))
    streams = decode.as_messages(tcp.decode_tcp(segments, with_rrs, **tcp_options))
    return datagrams.withColumn("msg_id", F.col("msg_id") * 65536).unionByName(streams)


def _written(rows: DataFrame) -> DataFrame:
    folder = f"{shared_folder(rows.sparkSession, 'segments')}/rows"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
