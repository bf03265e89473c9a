"""Packet captures (pcap and pcapng) as tables of packets.

read_pcap() deals long captures to many tasks. A task has a range of bytes, in which it looks for the first record by headers that chain (a plausible
record followed by another one, and so on), then goes from record to record to the first one behind its range. A first pass counts the packets of the ranges; sums
over the ranges before give the packets their places. What a task takes for its first record is checked against where the task before it ended: the first range
begins at a known place, so ranges that agree all the way are right, and those that don't are counted again from where they must begin. Captures of pcapng are dealt
in the same way; the first pass also gathers the section and interface blocks that the ranges behind them need. Captures that fit one range are read at once.

spark.read.format("pcap").load(path) is the same table by one task a capture. A task reads record by record, so it holds one packet and a read buffer.

Options: linklayer (ethernet or sll) decodes frames of that layer alone, whatever the capture says; truncated=stop ends a capture that is cut inside a packet
before it, which is an error otherwise. Frames that hold no IPv4 packet have nulls in the decoded columns; pcapng's simple packets have no time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from flowsift.functions.scratch import discard, written

SCHEMA = "file string, pkt_idx long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, ttl int, ip_len int, l4_len int, tcp_flags int, tcp_win int, payload binary, frame_len int"
SUFFIXES = (".pcap", ".pcapng", ".cap")
ETHERNET, SLL = 1, 113
LAYERS = {"ethernet": (ETHERNET,), "sll": (SLL,)}
READ_BYTES, SPLIT_BYTES = 1 << 20, 64 << 20
#: Tasks of one stage; beyond it a task reads several ranges.
MOST_TASKS = 100_000
#: Records that must chain to a cut end for a place to be taken for a record's, and the longest record that is looked for.
CHAIN, LONGEST = 12, 1 << 18
#: The first bytes of captures, with byte order and parts of a second in a microsecond.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
SECTION = b"\x0a\x0d\x0d\x0a"


class Cut(ValueError):
    """The capture ends inside a record."""


class _Records:
    """Exact reads from a stream; place is that of the next byte."""

    def __init__(self, stream: BinaryIO, place: int = 0) -> None:
        self.stream, self.held, self.at, self.place = stream, b"", 0, place

    def take(self, size: int, may_end: bool = False) -> bytes:
        """The next size bytes; nothing at the end if that may be here."""
        if len(self.held) - self.at < size:
            parts, have = [self.held[self.at :]], len(self.held) - self.at
            while have < size:
                more = bytes(self.stream.read(max(READ_BYTES, size - have)))
                if not more:
                    if may_end and not have:
                        return b""
                    raise Cut("the capture ends inside a packet")
                parts.append(more)
                have += len(more)
            self.held, self.at = b"".join(parts), 0
        self.at += size
        self.place += size
        return self.held[self.at - size : self.at]


def _chains(records: int, whole: bool, ends: bool) -> bool:
    """Whether records that chain to the end of a window are taken for such; a capture may be cut in its last one."""
    return records > 0 and (whole or not ends or records >= CHAIN)


class _Pcap:
    """What the head of a pcap file says; records are a header of 16 bytes and a frame."""

    size = 24

    def __init__(self, head: bytes) -> None:
        self.end, self.divide = MAGIC[head[:4]]
        self.link = struct.unpack(self.end + "I", head[20:24])[0]

    def state(self) -> list[bytes]:
        return []

    def packets(self, data: _Records, stop: int | None = None) -> Iterator[tuple[int, int, bytes]]:
        """Packets that begin before stop."""
        while (stop is None or data.place < stop) and (head := data.take(16, may_end=True)):
            sec, part, size, _ = struct.unpack(self.end + "IIII", head)
            yield sec * 1_000_000 + part // self.divide, self.link, data.take(size)

    def guess(self, window: bytes, upto: int, ends: bool) -> tuple[int, str] | None:
        """Where in the window, before upto, records begin to chain; ends: whether the window ends with the file."""
        if len(window) < 16:
            return None
        whole = len(window) - 15
        words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(window, np.uint8), 16)[: min(upto, whole)]
        as_int = lambda a: words[:, a : a + 4].copy().view(self.end + "u4")[:, 0].astype(np.int64)
        part, size, full = as_int(4), as_int(8), as_int(12)
        fit = (part < 1_000_000 * self.divide) & (size > 0) & (size <= LONGEST) & (size <= full)
        for at in np.flatnonzero(fit).tolist():
            place, chained = at, 0
            while place + 16 <= len(window):
                _, part_, size_, full_ = struct.unpack_from(self.end + "IIII", window, place)
                if part_ >= 1_000_000 * self.divide or not 0 < size_ <= LONGEST or size_ > full_:
                    break
                place, chained = place + 16 + size_, chained + 1
            if place + 16 > len(window) and _chains(chained, place == len(window), ends):
                return at, self.end
        return None


class _Pcapng:
    """The section that a place of a pcapng file lies in: byte order and interfaces, gathered from the blocks before."""

    size = 0

    def __init__(self, blocks: list[bytes] = (), end: str = "<") -> None:
        self.end, self.links, self.blocks = end, [], []
        for block in blocks:
            if block[:4] == SECTION:
                self._section(block)
            else:
                self._interface(block[8:-4])
                self.blocks.append(block)

    def state(self) -> list[bytes]:
        return self.blocks

    def _section(self, block: bytes) -> None:
        self.end, self.links, self.blocks = "<" if block[8:12] == b"\x4d\x3c\x2b\x1a" else ">", [], [block]

    def _interface(self, body: bytes) -> None:
        """Link type, ticks a second, seconds to add and the longest frame of an interface."""
        link, longest, at = struct.unpack(self.end + "H", body[:2])[0], struct.unpack(self.end + "I", body[4:8])[0], 8
        ticks, offset = 1_000_000, 0
        while at + 4 <= len(body):
            code, length = struct.unpack(self.end + "HH", body[at : at + 4])
            if code == 9 and length:
                r = body[at + 4]
                ticks = 2 ** (r & 127) if r & 128 else 10**r
            if code == 14 and length == 8:
                offset = struct.unpack(self.end + "q", body[at + 4 : at + 12])[0]
            if code == 0:
                break
            at += 4 + (length + 3) // 4 * 4
        self.links.append((link, ticks, offset, longest))

    def packets(self, data: _Records, stop: int | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """Packets whose blocks begin before stop: enhanced, simple and obsolete ones."""
        while (stop is None or data.place < stop) and (head := data.take(8, may_end=True)):
            if head[:4] == SECTION:
                head += data.take(4)
                self.end = "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
            number, length = struct.unpack(self.end + "II", head[:8])
            if length < len(head) + 4:
                raise ValueError("broken pcapng block")
            block = head + data.take(length - len(head))
            body = block[8:-4]
            if head[:4] == SECTION:
                self._section(block)
            elif number == 1:
                self._interface(body)
                self.blocks.append(block)
            elif number in (2, 6):
                which, high, low, size = struct.unpack(self.end + ("IIII" if number == 6 else "HxxIII"), body[:16])
                link, ticks, offset, _ = self.links[which]
                yield ((high << 32) | low) * 1_000_000 // ticks + offset * 1_000_000, link, body[20 : 20 + size]
            elif number == 3:
                link, _, _, longest = self.links[0]
                size = struct.unpack(self.end + "I", body[:4])[0]
                yield None, link, body[4 : 4 + min(size, longest or size)]

    def guess(self, window: bytes, upto: int, ends: bool) -> tuple[int, str] | None:
        """Blocks begin at multiples of four, which the window's first byte is, and have their length at both ends."""
        for end in ("<", ">"):
            words = np.frombuffer(window[: len(window) // 4 * 4], end + "u4").astype(np.int64)
            places = np.flatnonzero((words[1:] >= 12) & (words[1:] % 4 == 0) & (words[1:] <= LONGEST)) if len(words) > 2 else []
            for at in (p for p in places if 4 * p < upto):
                place, chained = int(at), 0
                while place + 1 < len(words):
                    length = int(words[place + 1])
                    last = place + length // 4 - 1
                    if length < 12 or length % 4 or length > LONGEST or last < len(words) and words[last] != length:
                        break
                    place, chained = last + 1, chained + 1
                if place + 1 >= len(words) and _chains(chained, place == len(words), ends):
                    return 4 * int(at), end
        return None


def _form(head: bytes):
    if head[:4] == SECTION:
        return _Pcapng()
    if head[:4] not in MAGIC:
        raise ValueError("neither pcap nor pcapng")
    if len(head) < _Pcap.size:
        raise Cut("the capture ends inside its head")
    return _Pcap(head)


def frames(stream: BinaryIO) -> Iterator[tuple[int | None, int, bytes]]:
    """(microseconds, link type, frame) of a capture of either format."""
    data = _Records(stream)
    head = data.take(4)
    if head in MAGIC:
        head += data.take(_Pcap.size - 4)
    form = _form(head)
    if isinstance(form, _Pcapng):  # the head is the first block's
        data.at, data.place = 0, 0
    yield from form.packets(data)


def _behind(frame: bytes, link: int) -> bytes | None:
    at = 12 if link == ETHERNET else 14
    while link == ETHERNET and frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
        at += 4
    packet = frame[at + 2 :]
    whole = frame[at : at + 2] == b"\x08\x00" and len(packet) >= 20 and packet[0] >> 4 == 4 and 20 <= (packet[0] & 15) * 4 <= len(packet)
    return packet if whole else None


def ipv4(frame: bytes, link: int, layer: str | None = None) -> bytes | None:
    """The IPv4 packet in an Ethernet (with VLAN tags) or Linux cooked frame; layer: only if the frame is of that one. Unknown link types are tried as both."""
    tried = LAYERS[layer] if layer else (link,) if link in (ETHERNET, SLL) else (ETHERNET, SLL)
    return next((p for p in (_behind(frame, x) for x in tried) if p is not None), None)


def decode(packet: bytes) -> tuple:
    """src_ip .. payload of SCHEMA; ports are 0 where there are none."""
    head = (packet[0] & 15) * 4
    total, ttl, proto = struct.unpack(">H", packet[2:4])[0], packet[8], packet[9]
    l4 = packet[head : total or None]
    sport, dport = struct.unpack(">HH", l4[:4]) if proto in (6, 17) and len(l4) >= 4 else (0, 0)
    flags, win = (l4[13], struct.unpack(">H", l4[14:16])[0]) if proto == 6 and len(l4) >= 20 else (None, None)
    return int.from_bytes(packet[12:16], "big"), int.from_bytes(packet[16:20], "big"), sport, dport, proto, ttl, total, len(l4), flags, win, l4


def _store(path: str):
    """The file system of an address and the path in it. Names of Spark's file systems are turned into those that Arrow knows."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def _rows(name: str, packets: Iterator, first: int, layer: str | None, stop: bool) -> Iterator[tuple]:
    """Rows of SCHEMA."""
    try:
        for i, (ts, link, frame) in enumerate(packets, first):
            packet = ipv4(frame, link, layer)
            yield (name, i, ts, *(decode(packet) if packet else (None,) * 11), len(frame))
    except Cut:
        if not stop:
            raise


class PcapReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.layer, self.stop = options["path"], options.get("linklayer"), options.get("truncated") == "stop"
        if self.layer and self.layer not in LAYERS:
            raise ValueError(f"linklayer is one of {', '.join(LAYERS)}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.path)
        info = store.get_file_info(base)
        names = [base] if info.is_file else sorted(f.path for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.is_file and f.path.endswith(SUFFIXES))
        return [InputPartition(n) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _store(self.path)[0].open_input_stream(partition.value, compression=None) as f:
            yield from _rows(partition.value.rsplit("/", 1)[-1], frames(f), 0, self.layer, self.stop)


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcapReader:
        return PcapReader(self.options)


_RANGE = "path string, length long, start long, stop long"
#: first: where the range's first record begins, next: where the first one behind the range does (null if the range has none), n: packets, blocks: those that set a section's state, order: byte order.
_COUNTED = _RANGE + ", first long, next long, n long, blocks array<binary>, order string"
_PLAN = _RANGE + ", first long, base long, blocks array<binary>, order string"


def _opened(path: str):
    store, name = _store(path)
    return store.open_input_file(name)


def _count(stop_cut: bool):
    """Ranges, with the place where they begin by their predecessors (sure, if those are right), to _COUNTED."""

    def counted(path, length, start, stop, known, order, sure):
        with _opened(path) as f:
            form = _form(f.read(_Pcap.size))
            first, end = known, order
            if start == 0:
                first, end = form.size, form.end
            if first is None:
                f.seek(start)
                window = f.read(min(length - start, stop - start + CHAIN * LONGEST, READ_BYTES))
                found = form.guess(window, stop - start, start + len(window) == length)
                if found is None:
                    return path, length, start, stop, None, None, 0, [], None
                first, end = start + found[0], found[1]
            if first >= stop:
                return path, length, start, stop, None, None, 0, [], end
            if isinstance(form, _Pcapng):
                form = _Pcapng(end=end)
                # packets refer to interfaces of earlier ranges; for counting any will do
                form.links = [(0, 1, 0, 0)] * (1 << 16 if first else 0)
            f.seek(first)
            data, n = _Records(f, first), 0
            try:
                for _ in form.packets(data, stop):
                    n += 1
            except (ValueError, IndexError, struct.error) as error:
                if not isinstance(error, Cut) or not stop_cut:
                    if sure or start == 0:
                        raise
                    return path, length, start, stop, None, None, 0, [], None  # not a record after all
                data.place = length
            return path, length, start, stop, first, data.place, n, form.state(), form.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [counted(*r.values()) for r in batch.to_pylist()]
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.string())
            names = ["path", "length", "start", "stop", "first", "next", "n", "blocks", "order"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, types)], names)

    return run


def _wrong(table: pa.Table) -> pa.Table:
    """Of the ranges of one capture those that must begin elsewhere than they do by their predecessors, with that place."""
    out, place, order = [], None, None
    for r in sorted(table.to_pylist(), key=lambda r: r["start"]):
        if place is not None:
            want = place if place < r["stop"] else None
            if r["first"] != want or (want is not None and r["order"] != order and not any(b[:4] == SECTION for b in r["blocks"])):
                out.append((r["path"], r["length"], r["start"], r["stop"], place, order, not out))
                if want is not None and r["next"] is None:  # nothing is known of the range behind it
                    place = None
        if r["next"] is not None:
            place, order = r["next"], r["order"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], ["path", "length", "start", "stop", "known", "order", "sure"])


def _plan(table: pa.Table) -> pa.Table:
    """The ranges of one capture that hold packets, with the number of packets before them and the state of their section."""
    out, base, blocks, order = [], 0, [], None
    for r in sorted(table.to_pylist(), key=lambda r: r["start"]):
        if r["n"]:
            out.append((r["path"], r["length"], r["start"], r["stop"], r["first"], base, blocks, order or r["order"]))
        base += r["n"]
        for block in r["blocks"]:
            blocks = [block] if block[:4] == SECTION else [*blocks, block]
        order = r["order"] or order
    types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.string())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, types)], ["path", "length", "start", "stop", "first", "base", "blocks", "order"])


def _decoded(layer: str | None, stop_cut: bool):
    """Ranges of _PLAN to the packets in them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with _opened(r["path"]) as f:
                    form = _form(f.read(_Pcap.size))
                    first = r["first"] if r["first"] is not None else form.size
                    if isinstance(form, _Pcapng) and first:
                        form = _Pcapng(r["blocks"], r["order"])
                    f.seek(first)
                    held, size = [], 0
                    for row in _rows(r["path"].rsplit("/", 1)[-1], form.packets(_Records(f, first), r["stop"]), r["base"], layer, stop_cut):
                        held.append(row)
                        size += row[-1]
                        if len(held) == 10_000 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    return run


def capture_ranges(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """_RANGE of the captures at a path, a file or a folder: as many ranges as a capture has times split_bytes. Only names and lengths of the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    end = F.lower(F.col("path"))
    named = F.lit(False)
    for suffix in SUFFIXES:
        named |= end.endswith(suffix)
    files = files.where(named | F.col("path").endswith(path.rstrip("/")))
    size = F.lit(split_bytes).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, size)).alias("start")
    return files.select("path", "length", starts).select("path", "length", "start", F.least(F.col("start") + size, "length").alias("stop"))


def read_pcap(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, linklayer: str | None = None, truncated: str | None = None) -> DataFrame:
    """The packets (SCHEMA) of the captures at a path; split_bytes, a multiple of four, is what one task reads."""
    if linklayer and linklayer not in LAYERS:
        raise ValueError(f"linklayer is one of {', '.join(LAYERS)}")
    if split_bytes <= _Pcap.size or split_bytes % 4:
        raise ValueError("split_bytes is a multiple of four and longer than a capture's head")
    stop_cut = truncated == "stop"
    ranges = written(capture_ranges(spark, path, split_bytes), "capture_ranges")
    long, short = ranges.where(F.col("length") > split_bytes), ranges.where(F.col("length") <= split_bytes)
    tasks = lambda rows, n: rows.repartitionByRange(max(1, min(n, MOST_TASKS)), "path", "start")
    plan = short.select("path", "length", "start", "stop", F.lit(None).cast("long").alias("first"), F.lit(0).cast("long").alias("base"), F.array().cast("array<binary>").alias("blocks"), F.lit("<").alias("order"))
    n_long = long.count()
    if n_long:
        unknown = long.withColumns({"known": F.lit(None).cast("long"), "order": F.lit(None).cast("string"), "sure": F.lit(False)})
        counted = written(tasks(unknown, n_long).mapInArrow(_count(stop_cut), _COUNTED), "capture_counts")
        while True:
            # each round sets right at least the first wrong range of every capture
            wrong = written(counted.groupBy("path").applyInArrow(_wrong, _RANGE + ", known long, order string, sure boolean"), "capture_wrong")
            n_wrong = wrong.count()
            if not n_wrong:
                break
            again = tasks(wrong, n_wrong).mapInArrow(_count(stop_cut), _COUNTED)
            before = counted
            counted = written(before.join(wrong.select("path", "start"), ["path", "start"], "left_anti").select(*before.columns).unionByName(again), "capture_counts")
            discard(before, wrong)
        plan = plan.unionByName(counted.groupBy("path").applyInArrow(_plan, _PLAN))
    plan = written(plan, "capture_plan")
    return tasks(plan, plan.count()).mapInArrow(_decoded(linklayer, stop_cut), SCHEMA)


def subset(packets: DataFrame, ranges: list[tuple[int, int | str]], order: str = "pkt_idx") -> DataFrame:
    """Packets whose place lies in one of the half-open ranges; "end" is open."""
    cond = F.lit(False)
    for a, b in ranges:
        cond |= (F.col(order) >= a) if b == "end" else (F.col(order) >= a) & (F.col(order) < b)
    return packets.where(cond)


def select_files(files: list[str], patterns: list[str]) -> list[str]:
    """Files by 1-based places: "3" or "1-10" (both ends inside), in the order of the patterns."""
    out = []
    for p in patterns:
        a, _, b = p.partition("-")
        if not 1 <= int(a) <= int(b or a) <= len(files):
            raise ValueError(f"{p} is not a range of 1 to {len(files)}")
        out += files[int(a) - 1 : int(b or a)]
    return out
