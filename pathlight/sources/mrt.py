"""MRT table dumps and updates as a Spark data source, one partition for each file.

``spark.dataSource.register(MrtSource)`` and ``spark.read.format("mrt").load(path)``. Paths may be files or
folders that the executors see; ``collector`` is an option. Records that can't be decoded are skipped.
The rows are those that ``readers.normalise`` takes.
"""

from __future__ import annotations

import bz2
import gzip
import ipaddress
import os
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ts timestamp_ntz, collector string, peer_asn bigint, peer_ip string, elem_type string, prefix string, path_text string, next_hop string"
_EPOCH = datetime(1970, 1, 1)
# MRT types and BGP attribute codes.
TABLE_DUMP_V2, BGP4MP, BGP4MP_ET = 13, 16, 17
PEER_INDEX, RIB_IPV4, RIB_IPV6 = 1, 2, 4
MESSAGE, MESSAGE_AS4 = 1, 4
AS_PATH, NEXT_HOP, MP_REACH, MP_UNREACH = 2, 3, 14, 15


def _open(path: str):
    return bz2.open(path) if path.endswith(".bz2") else gzip.open(path) if path.endswith(".gz") else open(path, "rb")


def records(stream) -> Iterator[tuple[float, int, int, bytes]]:
    """(time, type, subtype, body) of each record."""
    while len(head := stream.read(12)) == 12:
        seconds, kind, subtype, size = struct.unpack(">IHHI", head)
        body = stream.read(size)
        if len(body) < size:
            return
        micros = 0
        if kind == BGP4MP_ET:
            micros, body, kind = struct.unpack(">I", body[:4])[0], body[4:], BGP4MP
        yield seconds + micros / 1e6, kind, subtype, body


def _prefixes(data: bytes, version: int) -> Iterator[str]:
    at, width = 0, 4 if version == 4 else 16
    while at < len(data):
        bits = data[at]
        size = (bits + 7) // 8
        address = data[at + 1 : at + 1 + size].ljust(width, b"\0")
        yield f"{ipaddress.ip_address(address)}/{bits}"
        at += 1 + size


def attributes(data: bytes, as_bytes: int) -> dict[int, bytes | str]:
    """Attribute code to value; the AS path as text, sets in braces."""
    out: dict[int, bytes | str] = {}
    at = 0
    while at + 3 <= len(data):
        flags, code = data[at], data[at + 1]
        wide = bool(flags & 0x10)
        size = struct.unpack(">H", data[at + 2 : at + 4])[0] if wide else data[at + 2]
        at += 4 if wide else 3
        value = data[at : at + size]
        at += size
        if code == AS_PATH:
            words, k = [], 0
            while k + 2 <= len(value):
                kind, n = value[k], value[k + 1]
                numbers = [str(int.from_bytes(value[k + 2 + i * as_bytes : k + 2 + (i + 1) * as_bytes], "big")) for i in range(n)]
                words.append("{" + ",".join(numbers) + "}" if kind == 1 else " ".join(numbers))
                k += 2 + n * as_bytes
            out[code] = " ".join(words)
        else:
            out[code] = value
    return out


def _update(ts: datetime, collector: str, subtype: int, body: bytes) -> Iterator[tuple]:
    wide = subtype == MESSAGE_AS4
    size = 4 if wide else 2
    peer = int.from_bytes(body[:size], "big")
    family = struct.unpack(">H", body[2 * size + 2 : 2 * size + 4])[0]
    width = 4 if family == 1 else 16
    at = 2 * size + 4
    address = str(ipaddress.ip_address(body[at : at + width]))
    message = body[at + 2 * width :]
    if len(message) < 23 or message[18] != 2:
        return
    gone = struct.unpack(">H", message[19:21])[0]
    withdrawn = message[21 : 21 + gone]
    at = 21 + gone
    n = struct.unpack(">H", message[at : at + 2])[0]
    found = attributes(message[at + 2 : at + 2 + n], size)
    base = (ts, collector, peer, address)
    for p in _prefixes(withdrawn, 4):
        yield (*base, "W", p, "", None)
    path, hop = found.get(AS_PATH, ""), found.get(NEXT_HOP)
    hop_text = str(ipaddress.ip_address(hop)) if hop else None
    for p in _prefixes(message[at + 2 + n :], 4):
        yield (*base, "A", p, path, hop_text)
    if (reach := found.get(MP_REACH)) and reach[:3] == b"\0\x02\x01":
        size6 = reach[3]
        hop6 = str(ipaddress.ip_address(reach[4:20])) if size6 >= 16 else None
        for p in _prefixes(reach[5 + size6 :], 6):
            yield (*base, "A", p, path, hop6)
    if (unreach := found.get(MP_UNREACH)) and unreach[:3] == b"\0\x02\x01":
        for p in _prefixes(unreach[3:], 6):
            yield (*base, "W", p, "", None)


def _peers(body: bytes) -> list[tuple[int, str]]:
    at = 6 + struct.unpack(">H", body[4:6])[0]
    n = struct.unpack(">H", body[at : at + 2])[0]
    at, out = at + 2, []
    for _ in range(n):
        kind = body[at]
        width, size = (16 if kind & 1 else 4), (4 if kind & 2 else 2)
        address = str(ipaddress.ip_address(body[at + 5 : at + 5 + width]))
        out.append((int.from_bytes(body[at + 5 + width : at + 5 + width + size], "big"), address))
        at += 5 + width + size
    return out


def _rib(ts: datetime, collector: str, version: int, body: bytes, peers: list[tuple[int, str]]) -> Iterator[tuple]:
    bits = body[4]
    size = (bits + 7) // 8
    prefix = next(_prefixes(body[4 : 5 + size], version))
    at = 5 + size
    n = struct.unpack(">H", body[at : at + 2])[0]
    at += 2
    for _ in range(n):
        index, _, length = struct.unpack(">HIH", body[at : at + 8])
        found = attributes(body[at + 8 : at + 8 + length], 4)
        at += 8 + length
        peer, address = peers[index]
        hop = found.get(NEXT_HOP)
        yield ts, collector, peer, address, "R", prefix, found.get(AS_PATH, ""), str(ipaddress.ip_address(hop)) if hop else None


def elements(stream, collector: str) -> Iterator[tuple]:
    """Rows of one file."""
    peers: list[tuple[int, str]] = []
    for seconds, kind, subtype, body in records(stream):
        ts = _EPOCH + timedelta(seconds=seconds)
        try:
            if kind == TABLE_DUMP_V2 and subtype == PEER_INDEX:
                peers = _peers(body)
            elif kind == TABLE_DUMP_V2 and subtype in (RIB_IPV4, RIB_IPV6):
                yield from _rib(ts, collector, 4 if subtype == RIB_IPV4 else 6, body, peers)
            elif kind == BGP4MP and subtype in (MESSAGE, MESSAGE_AS4):
                yield from _update(ts, collector, subtype, body)
        except (IndexError, ValueError, struct.error, StopIteration):
            continue


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.collector = options["path"].removeprefix("file://"), options.get("collector", "")

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            return [_File(os.path.join(self.path, f)) for f in sorted(os.listdir(self.path)) if not f.startswith((".", "_"))]
        return [_File(self.path)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with _open(partition.path) as stream:
            yield from elements(stream, self.collector)


class MrtSource(DataSource):
    """Format ``mrt``."""

    @classmethod
    def name(cls) -> str:
        return "mrt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
