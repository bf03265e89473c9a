"""WARC archives of web pages in Zstandard frames, written and read by tasks.

An archive begins with a skippable frame that holds the dictionary, followed by one frame per record. The reader loads the
dictionary from that frame, finds the end of each frame from its block headers, decodes one record at a time, and checks
version, lengths, the record's end and the payload digest; anything else raises an error. Of pages with equal payloads, the one with the
smallest page_id is a response and the others are revisit records that refer to it.

Tasks write to the shared folder under names of their own attempt; only the archives in the committed list are read, so that a repeated
task leaves no double records. The dictionary is trained on the beginnings (SAMPLE_BYTES characters) of at most SAMPLE pages; no more goes to the driver.

Defined cases: null html is an empty payload; a null page_id is larger than any other and cannot be referred to; rows that repeat page_id
and payload are all responses if that page_id is the smallest; null or odd urls are percent-encoded; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import BROADCAST_ROWS, new_path, stored

SAMPLE, DICTIONARY_BYTES, SAMPLE_BYTES = 400, 64 << 10, 16 << 10
ARCHIVE_BYTES = 16 << 20
#: The skippable frame of a dictionary, the revisit profile, the name space of record ids.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGES, NAMELESS = 0x70616765_00000000, 0x6E6F6E65_00000000
DATE = "2024-01-01T00:00:00Z"


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 8 else b""
    except zstandard.ZstdError:
        return b""


def _record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=((PAGES if page is not None else NAMELESS) << 64) | ((page or 0) & (1 << 64) - 1))}>"


def _page_of(record_id: str) -> int | None:
    value = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    low = value & (1 << 64) - 1
    return None if value >> 64 == NAMELESS else low - (1 << 64) if low >> 63 else low


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    """A response with the payload, or a revisit with its HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {urllib.parse.quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}"]
    if revisit:
        head += [f"WARC-Refers-To: {_record_id(first)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}


def parse_record(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload bytes, digest, type and what it refers to; raises ValueError on any mismatch."""
    head, split, rest = data.partition(b"\r\n\r\n")
    if not split or not head.startswith((b"WARC/1.1\r\n", b"WARC/1.0\r\n")):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} is not {size} bytes long")
    http, split, payload = rest[:size].partition(b"\r\n\r\n")
    length, digest, kind = int(_fields(http)["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or payload_digest(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its length or digest")
    if kind == "revisit" and payload:
        raise ValueError(f"revisit {fields['warc-record-id']} has a payload")
    refers = fields.get("warc-refers-to")
    return _page_of(fields["warc-record-id"]), length, digest, kind, _page_of(refers) if refers else None


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends, from its block headers."""
    import zstandard

    head = bytes(data[at : at + 18])
    at += zstandard.frame_header_size(head)
    last = False
    while not last:
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
        if at > len(data):
            raise ValueError("the archive ends inside a frame")
    return at + 4 * zstandard.get_frame_parameters(head).has_checksum


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    import zstandard

    view, at, words = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        at = 8 + struct.unpack("<I", data[4:8])[0]
        words = zstandard.ZstdCompressionDict(data[8:at])
    decoder = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
    while at < len(data):
        end = frame_end(view, at)
        yield decoder.decompress(view[at:end])
        at = end


def _samples(pages: DataFrame, id_col: str, html_col: str) -> list[bytes]:
    """The pages of the smallest hashes: first their hashes alone are compared, then the chosen pages are read."""
    draw = F.xxhash64(id_col, html_col)
    drawn = pages.select(draw.alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not drawn:
        return []
    chosen = pages.where(draw <= drawn[-1]["h"]).select(draw.alias("h"), F.substring(html_col, 1, SAMPLE_BYTES).alias("html")).dropDuplicates(["h"])
    return [r["html"].encode("utf-8", "replace") for r in chosen.collect()]


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Writes a record per page to archives below folder; returns the committed list (name, records)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    firsts = rows.groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    firsts = stored(firsts.withColumn("known", F.lit(True)), "firsts")
    if firsts.count() <= broadcast_rows:
        rows = rows.join(F.broadcast(firsts), "sha1", "left")
    else:  # the largest groups are settled where their rows lie, so that no key of the shuffle is hot
        hot = F.broadcast(stored(firsts.orderBy(F.desc("n"), "sha1").limit(max(1, broadcast_rows // 8)), "hot_firsts").drop("n"))
        near = rows.join(hot, "sha1", "left")
        far = near.where("known is null").drop("first", "known").join(firsts.drop("n"), "sha1", "left")
        rows = near.where("known").unionByName(far)
    rows = rows.select("page_id", "url", "payload", "first", (F.col("known").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    words = spark.sparkContext.broadcast(train_dictionary(_samples(pages.where(F.length(html_col) > 0), id_col, html_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        extra = {"dict_data": zstandard.ZstdCompressionDict(words.value)} if words.value else {}
        encoder = zstandard.ZstdCompressor(level=6, write_checksum=True, **extra)
        lead = struct.pack("<II", SKIPPABLE, len(words.value)) + words.value if words.value else b""
        number, out, size, count = 0, [lead], len(lead), 0

        def close():
            name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}-{number:04d}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(b"".join(out))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], ["name", "records"])

        for b in batches:
            for page, url, payload, first, revisit in zip(*(c.to_pylist() for c in b.columns)):
                frame = encoder.compress(make_record(page, url, payload, first, revisit))
                if count and size + len(frame) > archive_bytes:
                    yield close()
                    number, out, size, count = number + 1, [lead], len(lead), 0
                out.append(frame)
                size, count = size + len(frame), count + 1
        if count:
            yield close()

    return stored(rows.mapInArrow(run, "name string, records long"), "archives")


def read_archives(written: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the committed archives."""
    spark = written.sparkSession
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if written.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").join(written.select("name"), "name", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for b in batches:
            for content in b.column(0):
                found = [parse_record(r) for r in read_archive(content.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return files.select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Writes archives to the shared folder and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **columns), folder)
