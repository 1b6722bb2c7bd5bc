"""WARC archives in Zstandard form, written and read.

An archive is a leading skippable frame that holds the compression dictionary, then one Zstandard
frame for each record. The reader walks the frames by their headers, loads the dictionary, decodes
one frame for each record and validates version line, headers, lengths and digests.

Writing: records with equal payloads (of ``min_revisit_bytes`` at least) are stored once. The record
with the largest id is the response, the others are revisits that refer to it and carry the HTTP
head only, whose Content-Length tells the full payload's length. Archives are cut at
``ARCHIVE_BYTES`` of raw records. A task names its files at random and reports them in a manifest;
files that a lost or repeated attempt left are in no manifest and aren't read.

Defined cases: a null payload is the empty payload; a null id sorts below all others and is written
as an empty id; rows that repeat the largest id of their group are all responses; a null url is
written as an empty target; other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_dir

ARCHIVE_BYTES = 16 << 20
#: A frame that declares more is an error row: its size isn't trusted with memory.
MOST_RECORD_BYTES = 1 << 30
DICTIONARY_BYTES, DICTIONARY_SAMPLES, SAMPLE_BYTES = 32 << 10, 200, 16 << 10
#: Fixed values of the formats (RFC 8878; WARC 1.1 and its Zstandard extension).
SKIPPABLE_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "archive string, offset long, record_type string, record_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def build_record(record_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None, revisit: bool, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One WARC record; payload is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if record_id is None else record_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <{ID_PREFIX}{'' if refers_to is None else refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack_archive(records: list[bytes], level: int = 3) -> bytes:
    """A whole archive. The dictionary is trained on a bounded share of the archive's own records; of too few it is their own text."""
    step = max(1, len(records) // DICTIONARY_SAMPLES)
    samples = [x[:SAMPLE_BYTES] for x in records[::step][:DICTIONARY_SAMPLES]]
    out, dictionary = [], None
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * DICTIONARY_BYTES:
        try:
            dictionary = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstd.ZstdError:
            dictionary = None
    if dictionary is None:
        dictionary = zstd.ZstdCompressionDict(b"".join(samples)[-DICTIONARY_BYTES:], dict_type=zstd.DICT_TYPE_RAWCONTENT)
    raw = dictionary.as_bytes()
    out.append(struct.pack("<II", SKIPPABLE_MAGIC, len(raw)) + raw)
    packer = zstd.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join(out + [packer.compress(x) for x in records])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, by its header and its blocks' headers."""
    if len(data) - at < 6:
        raise ValueError("cut frame header")
    described = data[at + 4]
    single, sums, ids, sizes = described >> 5 & 1, described >> 2 & 1, described & 3, described >> 6
    pos = at + 5 + (0 if single else 1) + (0, 1, 2, 4)[ids] + ((1 if single else 0), 2, 4, 8)[sizes]
    while True:
        if pos + 3 > len(data):
            raise ValueError("cut block header")
        head = data[pos] | data[pos + 1] << 8 | data[pos + 2] << 16
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * sums
    if pos > len(data):
        raise ValueError("cut frame")
    return pos


def frames(data: bytes) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, decoded record, error) for each frame; a frame that can't be walked ends the archive with an error."""
    view, at = memoryview(data), 0
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, at = bytes(view[8 : 8 + size]), 8 + size
        if len(raw) != size:
            yield 0, None, "cut dictionary"
            return
        try:
            if raw[:4] == struct.pack("<I", FRAME_MAGIC):
                raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
            dictionary = zstd.ZstdCompressionDict(raw)
            reader = zstd.ZstdDecompressor(dict_data=dictionary)
        except zstd.ZstdError as e:
            yield 0, None, f"dictionary: {e}"
            return
    else:
        reader = zstd.ZstdDecompressor()
    while at < len(data):
        try:
            magic = struct.unpack_from("<I", data, at)[0] if len(data) - at >= 4 else 0
            if magic & 0xFFFFFFF0 == 0x184D2A50 and len(data) - at >= 8:  # a later skippable frame holds no record
                at += 8 + struct.unpack_from("<I", data, at + 4)[0]
                continue
            if magic != FRAME_MAGIC:
                raise ValueError("no frame magic")
            end = frame_end(view, at)
        except ValueError as e:
            yield at, None, str(e)
            return
        try:
            frame = view[at:end]
            if zstd.frame_content_size(frame) > MOST_RECORD_BYTES:
                raise zstd.ZstdError("declared content size is over the limit")
            yield at, reader.decompress(frame) if zstd.frame_content_size(frame) >= 0 else reader.decompressobj().decompress(frame), None
        except zstd.ZstdError as e:
            yield at, None, f"frame: {e}"
        at = end


def parse_record(raw: bytes) -> dict:
    """The fields of one record; raises ValueError where version, headers, lengths or digest don't hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of headers")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise ValueError("bad version line")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != (size := int(fields["content-length"])) + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("length doesn't match")
    block = rest[:size]
    number = lambda name: int(m[1]) if (m := re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", fields.get(name, ""))) else None
    out = {"record_type": fields["warc-type"], "record_id": number("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": None, "payload": None, "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
    if out["record_type"] in ("response", "revisit"):
        http, found, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not found or not m:
            raise ValueError("bad HTTP head")
        out["payload_bytes"] = int(m[1])
        if out["record_type"] == "revisit":
            out["refers_to"] = number("warc-refers-to")
        else:
            if len(payload) != out["payload_bytes"]:
                raise ValueError("payload length doesn't match")
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != out["payload_digest"]:
                raise ValueError("payload digest doesn't match")
            out["payload"] = payload
    else:
        out |= {"payload_bytes": len(block), "payload": block}
    return out


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else uri.removeprefix("file:"))


def write_archives(df: DataFrame, target: str, id_column: str = "page_id", payload_column: str = "html", url_column: str = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the rows as archives under ``target`` and returns the manifest, itself a table under ``target``."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(url_column).cast("string").alias("url"), F.coalesce(F.col(payload_column), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    groups = rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("id").alias("responder"), F.count("*").alias("n"))
    revisit = F.coalesce((F.col("n") > 1) & F.col("responder").isNotNull() & ~F.col("id").eqNullSafe(F.col("responder")), F.lit(False))
    rows = rows.join(groups, "digest", "inner" if min_revisit_bytes <= 0 else "left").select("id", "url", "digest", F.octet_length("payload").cast("long").alias("length"), revisit.alias("revisit"), F.when(revisit, F.col("responder")).alias("refers_to"), F.when(~revisit, F.encode("payload", "UTF-8")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = filesystem(target)
        files.create_dir(folder, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            data, name = pack_archive(records), f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(records)], "n_bytes": [len(data)]})

        records, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                x = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                digest = base64.b32encode(bytes.fromhex(x["digest"])).decode()
                records.append(r := build_record(x["id"], x["url"], x["payload"], x["length"], digest, x["refers_to"], x["revisit"]))
                held += len(r)
                if held >= ARCHIVE_BYTES:
                    yield flush(records)
                    records, held = [], 0
        if records:
            yield flush(records)

    spark = df.sparkSession
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{target}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{target}/manifest")


def read_archives(spark: SparkSession, target: str, manifest: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """One row for each record (RECORDS); a record that fails validation has its error and no fields."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(target)
    if manifest is not None:
        found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(manifest.select(F.col("path").alias("name")).distinct(), "name", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORDS.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                rows, held = [], 0
                for at, raw, error in frames(data):
                    x: dict = {}
                    if error is None:
                        try:
                            x = parse_record(raw)
                        except (ValueError, UnicodeDecodeError) as e:
                            error = str(e)
                    if not with_payload:
                        x.pop("payload", None)
                    rows.append({"archive": path, "offset": at, "error": error} | x)
                    held += len(x.get("payload") or b"")
                    if held >= 16 << 20 or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(names, types, strict=True)], names)
                        rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(names, types, strict=True)], names)

    return found.select("path", "content").mapInArrow(read, RECORDS)


def round_trip(df: DataFrame, **columns) -> DataFrame:
    """Writes the rows to archives in the shared folder, then reads the archives back."""
    target = fresh_dir(df.sparkSession, "warc")
    return read_archives(df.sparkSession, target, write_archives(df, target, **columns), with_payload=False)
