"""WARC archives in Zstandard: a writer, and a reader that decodes one frame per record.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds its dictionary, itself a Zstandard frame; then each record is a
frame of its own. The reader loads the dictionary, walks the block headers to the end of each frame, decodes that frame alone and
checks the record: version line, required headers, lengths, closing line ends and, for a response, the payload's digest.

Scale: pages are matched with the first page of equal payload by digest, pre-aggregated; a task writes archives of at most ARCHIVE
compressed bytes to the shared folder, so one archive fits in memory. Names are unique to a task's attempt and only archives of the
stored manifest are read, so a repeated task leaves no record twice.

Defined results: a null html is an empty payload; a null url leaves the target header out; a null page_id is kept (as a revisit where a page
with an id has the same payload, else as a response); all rows with the smallest page_id of equal payloads are responses; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh_path

SKIPPABLE = 0x184D2A5D
MAGIC = b"\x28\xb5\x2f\xfd"
ARCHIVE = 16_000_000
SAMPLE, DICT = 400_000, 16_384
DATE = "2024-01-01T00:00:00Z"


def filesystem(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if re.match(r"file:/", folder):
        folder = re.sub(r"^file:/+", "/", folder)
    return pyarrow.fs.FileSystem.from_uri(folder)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """first: the page_id that has the payload, for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page-Id: {first}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT, records).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few or too short
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts here ends, by its block headers."""
    p = zstandard.get_frame_parameters(data[at : at + 18])
    pos = at + zstandard.frame_header_size(data[at : at + 18])
    while True:
        if pos + 3 > len(data):
            raise ValueError("the archive ends within a frame")
        header = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if header >> 1 & 3 == 1 else header >> 3)
        if header & 1:
            break
    pos += 4 * p.has_checksum
    if pos > len(data):
        raise ValueError("the archive ends within a frame")
    return pos


def read_frames(data: bytes):
    """The records of an archive, each from its own frame."""
    view, at, dictionary = memoryview(data), 0, None
    while at < len(view):
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 > len(view) or (end := at + 8 + int.from_bytes(view[at + 4 : at + 8], "little")) > len(view):
                raise ValueError("the archive ends within a skippable frame")
            if at == 0 and magic == SKIPPABLE:
                raw = bytes(view[8:end])
                dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == MAGIC else raw)
            at = end
            continue
        end = frame_end(view, at)
        out = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
        yield out.decompressobj().decompress(view[at:end])
        at = end


def parse_record(raw: bytes) -> dict:
    """Headers, payload and, in `problem`, the first rule that the record breaks."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    out = {"type": fields.get("warc-type"), "page_id": fields.get("x-page-id"), "refers_to": fields.get("x-refers-to-page-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": b"", "bytes": None, "problem": None}
    length = fields.get("content-length", "")
    if lines[0] not in ("WARC/1.0", "WARC/1.1") or not sep:
        return out | {"problem": "version"}
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]:
        return out | {"problem": f"no {missing[0]}"}
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[int(length) :] != b"\r\n\r\n":
        return out | {"problem": "length"}
    http, sep, payload = rest[: int(length)].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not sep or not size:
        return out | {"problem": "http headers"}
    out |= {"payload": payload, "bytes": int(size[1])}
    if out["type"] == "response" and (len(payload) != out["bytes"] or digest(payload) != out["digest"]):
        return out | {"problem": "payload"}
    if out["type"] == "revisit" and (payload or out["refers_to"] is None):
        return out | {"problem": "revisit"}
    return out


def write_archives(pages: DataFrame, folder: str, least: int = 0, archive: int = ARCHIVE) -> DataFrame:
    """Write pages(page_id, url, html) to archives in a folder; gives the stored manifest (name, records).

    Of pages with equal payloads of at least `least` bytes, that with the smallest page_id is a response and the others revisit it.
    """
    paged = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    firsts = paged.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    matched = paged.join(firsts, "digest", "left").select("page_id", "url", "html", F.expr("case when page_id <=> first then null else first end").alias("first"))

    def rows(batches):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        names, counts = [], []
        task = TaskContext.get()
        stem = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"

        def close(frames, lead, n):
            names.append(f"{stem}-{len(names):05d}.warc.zst")
            counts.append(n)
            with fs.open_output_stream(f"{base}/{names[-1]}", compression=None) as f:
                f.write(lead)
                for x in frames:
                    f.write(x)

        def records():
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, html, first = (batch.column(c)[k].as_py() for c in range(4))
                    yield build_record(page_id, url, html.encode(), first)

        waiting, held, compress, lead, frames, size = [], 0, None, b"", [], 0
        for raw in records():
            if compress is None:
                waiting.append(raw)
                held += len(raw)
                if held < SAMPLE:
                    continue
            else:
                waiting = [raw]
            if compress is None:
                d = train(waiting)
                lead = leading_frame(d) if d else b""
                compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=3)
            for x in waiting:
                frames.append(compress.compress(x))
                size += len(frames[-1])
                if size >= archive:
                    close(frames, lead, len(frames))
                    frames, size = [], 0
            waiting = []
        if waiting and compress is None:
            d = train(waiting)
            lead = leading_frame(d) if d else b""
            compress = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d)) if d else zstandard.ZstdCompressor(level=3)
            frames = [compress.compress(x) for x in waiting]
        if frames:
            close(frames, lead, len(frames))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=["name", "records"])

    path = f"{folder}-manifest"
    matched.mapInArrow(rows, "name string, records long").write.parquet(path)
    return pages.sparkSession.read.schema("name string, records long").parquet(path)


def read_archives(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """page_id, uri, payload_bytes, payload_digest, record_type, refers_to and problem of every record; the payload too if asked for.

    An archive of the manifest that is missing, or has another number of records, is an error.
    """
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    missing = manifest.join(files.select(name), "name", "left_anti").select("name").first()
    if missing:
        raise FileNotFoundError(f"{folder} has no archive {missing[0]}")
    named = files.select(name, "content").join(manifest.select("name", "records"), "name").select("content", "name", "records")
    kinds = {"page_id": pa.int64(), "uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "problem": pa.string()}
    schema = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string"
    if payload:
        kinds, schema = kinds | {"payload": pa.binary()}, schema + ", payload binary"

    def rows(batches):
        def made(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.values())], names=list(kinds))

        for batch in batches:
            for content, name, records in zip(*batch.columns):
                out, held, count = [], 0, 0
                for raw in read_frames(content.as_py()):
                    count += 1
                    r = parse_record(raw)
                    number = {k: int(r[k]) if r[k] is not None else None for k in ("page_id", "refers_to")}
                    out.append((number["page_id"], r["uri"], r["bytes"], r["digest"], r["type"], number["refers_to"], r["problem"], *([r["payload"]] if payload else [])))
                    held += len(raw)
                    if held > 8_000_000 and payload or len(out) >= 10_000:
                        yield made(out)
                        out, held = [], 0
                if count != records.as_py():
                    raise ValueError(f"archive {name} has {count} records, not {records}")
                if out:
                    yield made(out)

    return named.mapInArrow(rows, schema)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    folder = fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, least)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string")
    return read_archives(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
