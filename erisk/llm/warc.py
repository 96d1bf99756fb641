"""Zstandard web archives: one compressed frame per record, a shared dictionary in a leading skippable frame.

Writing: a payload's digest decides which record carries it. Of records with equal payloads of at least 1000 bytes the one
with the largest page_id is the response and the others are revisits that refer to it; smaller payloads are all responses.
Only digests that occur twice reach the join, so pages move only if that list is too long to broadcast. Each task then
writes archives of bounded size, trains each one's dictionary on its first records, and returns a manifest. Names hold the
task attempt, so a repeated task never touches a file that a manifest names.

Reading: each archive is streamed by one task. The dictionary is taken from the skippable frame, each frame must hold
exactly one record, and version, required headers, content lengths, digests and the HTTP block are validated.

Defined results: null html is an empty payload; a null page_id is never the largest, and a group of only null ids are all
responses; rows that share the largest page_id are all responses; an empty table gives no archive. Extra columns are not
read. `read_archives` raises ValueError on any damage, or with on_error="report" returns the reason in column `error`.
"""
from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erisk.llm.common import written

#: Fixed values of the format: the dictionary frame, a dictionary, a frame.
DICTIONARY_FRAME, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
REVISIT_LEAST = 1000
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 32_000_000, 2_000_000, 32_768, 6
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
          "archive string, error string")


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def page_uri(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def page_of(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise ValueError(f"unknown record id {uri}")
    return None if uri[10:-1] == "none" else int(uri[10:-1])


def head(first: str, fields: Iterable[tuple[str, object]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields if v is not None), "\r\n"]).encode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as bytes: a response carries the payload, a revisit the response's HTTP head alone."""
    http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http + payload if kind == "response" else http
    return head("WARC/1.1", [
        ("WARC-Type", kind), ("WARC-Record-ID", page_uri(page)), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="%:/?#[]@!$&'()*+,;=~")),
        ("WARC-Refers-To", page_uri(refers_to) if kind == "revisit" else None), ("WARC-Profile", PROFILE if kind == "revisit" else None),
        ("WARC-Payload-Digest", base32(hashlib.sha1(payload).digest())), ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]) + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The dictionary frame and one frame per record. Too little to train on: no dictionary."""
    samples, held = [], 0
    for r in records:
        samples.append(r)
        held += len(r)
        if held > SAMPLE_BYTES:
            break
    try:
        trained = zstd.train_dictionary(min(DICTIONARY_BYTES, held // 10), samples)
    except (zstd.ZstdError, ValueError):
        trained = None
    out = io.BytesIO()
    if trained is not None:
        body = zstd.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out.write(struct.pack("<II", DICTIONARY_FRAME, len(body)) + body)
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue()


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def writer(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}"
        records, held, files = [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, files
            data, path = archive(records), f"{root}/{name}-{files:05d}.warc.zst"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(path, compression=None) as f:
                f.write(data)
            out = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}-{files:05d}.warc.zst"], "records": [len(records)], "bytes": [len(data)]})
            records.clear()
            held, files = 0, files + 1
            return out

        for b in batches:
            for r in b.to_pylist():
                raw = record(r["kind"], r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"])
                if records and held + len(raw) > archive_bytes:
                    yield close()
                records.append(raw)
                held += len(raw)
        if records:
            yield close()
    return run


def record_plan(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, url, html, kind (response or revisit) and refers_to of every page."""
    raw = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.when(F.octet_length(raw) >= least, F.sha1(raw)).alias("digest"))
    owners = rows.filter("digest IS NOT NULL").groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    repeated = written(owners.filter("n > 1 AND owner IS NOT NULL").select("digest", "owner"), "payloads")
    revisit = F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id"))
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "html", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("owner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_LEAST, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages under `folder`, which all executors share; the manifest: path, records and bytes of each archive."""
    return written(record_plan(pages, least).mapInArrow(writer(folder, archive_bytes), MANIFEST), "manifest")


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame, decoded with the dictionary of the leading skippable frame."""
    at, dictionary = 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", data, 4)[0]
        body = data[8:8 + size]
        if len(body) < max(size, 4):
            raise ValueError("the dictionary frame is cut short")
        if struct.unpack_from("<I", body)[0] == FRAME:
            body = zstd.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
        if struct.unpack_from("<I", body)[0] != DICTIONARY:
            raise ValueError("the leading frame holds no dictionary")
        dictionary, at = zstd.ZstdCompressionDict(body), 8 + size
    reader = zstd.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        one, parts, end = reader.decompressobj(), [], at
        while not one.eof:
            if end >= len(data):
                raise ValueError("a frame is cut short")
            parts.append(one.decompress(data[end:end + 65_536]))
            end = min(end + 65_536, len(data))
        at = end - len(one.unused_data)
        yield b"".join(parts)


def fields(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode().split("\r\n")
    out: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"not a header: {line[:80]}")
        out[name.strip().lower()] = value.strip()
    return first, out


def expect(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def parsed(raw: bytes) -> dict:
    """A frame's record, validated; url still percent-encoded."""
    top, blank, rest = raw.partition(b"\r\n\r\n")
    version, h = fields(top)
    expect(bool(blank) and version in ("WARC/1.0", "WARC/1.1"), f"not a record: {version[:40]}")
    expect(all(k in h for k in REQUIRED), "a required header is missing")
    length = int(h["content-length"])
    expect(len(rest) == length + 4 and rest.endswith(b"\r\n\r\n"), "the content length is wrong, or the frame holds more than a record")
    block = rest[:length]
    expect(h.get("warc-block-digest") in (None, base32(hashlib.sha1(block).digest())), "the block digest is wrong")
    kind = h["warc-type"]
    expect(kind in ("response", "revisit"), f"unexpected type {kind}")
    top, blank, payload = block.partition(b"\r\n\r\n")
    status, http = fields(top)
    expect(bool(blank) and status.startswith("HTTP/1."), "no HTTP head")
    size, digest = int(http["content-length"]), h["warc-payload-digest"]
    if kind == "response":
        expect(len(payload) == size, "the payload's length is wrong")
        expect(base32(hashlib.sha1(payload).digest()) == digest, "the payload digest is wrong")
    else:
        expect(not payload and "warc-refers-to" in h and h.get("warc-profile") == PROFILE, "a revisit carries a payload or refers to nothing")
    return {"page_id": page_of(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload_bytes": size,
            "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(), "record_type": kind,
            "refers_to": page_of(h["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


def reader(payloads: bool, report: bool):
    names = [*(c.split()[0] for c in RECORD.split(", ")), *(["payload"] if payloads else [])]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = file_system(path)
                with fs.open_input_stream(at, compression=None) as f:
                    data = f.read()                  # archives have a bounded size
                rows: list[dict] = []
                try:
                    for raw in frames(data):
                        rows.append(parsed(raw) | {"archive": path.rsplit("/", 1)[-1], "error": None})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except (ValueError, KeyError, zstd.ZstdError) as e:
                    if not report:
                        raise ValueError(f"{path}: {e}") from e
                    rows.append({"archive": path.rsplit("/", 1)[-1], "error": f"{type(e).__name__}: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def read_archives(archives: DataFrame, payloads: bool = False, on_error: str = "raise") -> DataFrame:
    """The records of the archives in column `path`; with `payloads` the response bodies too."""
    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(n).mapInArrow(reader(payloads, on_error == "report"), RECORD + ", payload binary" * payloads)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder, for `read_archives`; their content is not read here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")
