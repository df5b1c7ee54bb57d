"""WARC archives, compressed record by record with an embedded Zstandard dictionary.

write_archives(pages) writes one record per row and read_archives reads them back.

* The dictionary is trained from a bounded sample of the records to be archived
  (`sample_records`), on the driver; it travels to the tasks with the writer. Each
  archive starts with a skippable frame that holds it, so a file can be read alone.
* Every record, header and payload, is a frame of its own. Any record can be read
  from its offset and length and the leading frame.
* Of records with equal payloads of at least `least_bytes`, that with the smallest
  id is a response; the others are revisit records, which keep the HTTP header (with
  the payload's length) and name the response. Which is which is decided on thin
  rows: digest and length are computed natively, the smallest id per digest by a
  partial aggregation. Records are compressed before they meet that decision, so the
  pages' markup is never shuffled, only its compressed form is; the join by digest
  can be split by Spark where one payload fills a large part of the table.
* A task writes its records to a file under a name of its own attempt and reports
  the places it wrote; only reported files are read. The files are in the folder
  given, or in the session's shared one.

Defined results: a null payload is empty; a null or odd URL is percent-encoded or
replaced by a placeholder; rows that repeat the smallest id of a payload are all
responses; a null id loses to any other and is a response only if all ids of its
payload are null; other columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, fresh_dir, map_batches, store, text_bytes
from sparquill.llm.media_store import _filesystem as filesystem_of

LEAST_BYTES = 100
#: The dictionary's size, and the most records and bytes of each that train it.
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 400
SAMPLE_BYTES = 16 << 10
#: Frame type of a dictionary frame in zstandard-compressed archives.
DICTIONARY_MAGIC = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PLACES = "archive string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: bytes | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None) -> bytes:
    """One record; payload None makes it a revisit of refers_to."""
    target = quote(url, safe="/:?#[]@!$&'()*+,;=%-._~") if url else "urn:x-none"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(WARC fields by lower-case name, HTTP header, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("the record's length doesn't hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records; their raw tail where there are too few to train from."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def read_leading_frame(head: bytes) -> bytes:
    magic, size = struct.unpack_from("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary leads this archive")
    return head[8 : 8 + size]


def write_archives(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = LEAST_BYTES, level: int = 3) -> DataFrame:
    """Write every row's record; gives (archive, offset, length) per record. Written out before it returns."""
    spark = pages.sparkSession
    base = folder or fresh_dir(spark, "archives")
    raw = text_bytes(payload)
    digest = F.sha2(raw, 256)
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").cast("binary").alias("u"), raw.alias("p"), digest.alias("digest"))

    sample = [record(r.k, bytes(r.u) if r.u else None, bytes(r.p), r.n, r.digest) for r in rows.limit(SAMPLE_RECORDS).select("k", "u", F.substring("p", 1, SAMPLE_BYTES).alias("p"), F.octet_length("p").alias("n"), "digest").toLocalIterator()]
    dictionary = train_dictionary(sample)

    def compress(batches: Iterator[Batch]) -> Iterator[Batch]:
        z = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        for b in batches:
            frames = [z.compress(record(k, u, p, len(p), d)) for k, u, p, d in zip(b["k"], b["u"], b["p"], b["digest"], strict=True)]
            yield {"k": b["k"], "u": b["u"], "digest": b["digest"], "size": [len(p) for p in b["p"]], "frame": frames}

    def write(batches: Iterator[Batch]) -> Iterator[Batch]:
        z = zstandard.ZstdCompressor(level=level, dict_data=_dictionary(dictionary))
        out, name = None, ""
        for b in batches:
            places: Batch = {"archive": [], "offset": [], "length": []}
            for k, u, d, size, frame, first in zip(b["k"], b["u"], b["digest"], b["size"], b["frame"], b["first"], strict=True):
                if first is not None and first != k:
                    frame = z.compress(record(k, u, None, size, d, first))
                if out is None:
                    filesystem, root = filesystem_of(base)
                    filesystem.create_dir(root, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.zst"
                    out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(leading_frame(dictionary))
                places["archive"].append(name)
                places["offset"].append(out.tell())
                places["length"].append(len(frame))
                out.write(frame)
            yield places
        if out is not None:
            out.close()

    sized = pages.select(F.col(key).cast("long").alias("k"), F.octet_length(raw).alias("n"), digest.alias("digest"))
    first = sized.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("k").alias("first"))
    frames = map_batches(rows, compress, "k long, u binary, digest string, size long, frame binary")
    places = store(map_batches(frames.join(first, "digest", "left"), write, PLACES), "archive-places")
    return places.withColumn("archive", F.concat(F.lit(base + "/"), "archive"))


def read_archives(places: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type and refers_to, from the archives' bytes."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        file, opened, z = None, None, None
        for b in batches:
            found = []
            for archive, offset, length in zip(b["archive"], b["offset"], b["length"], strict=True):
                if archive != opened:
                    if file is not None:
                        file.close()
                    filesystem, path = filesystem_of(archive)
                    file, opened = filesystem.open_input_file(path), archive
                    size = struct.unpack("<I", file.read_at(4, 4))[0]
                    z = zstandard.ZstdDecompressor(dict_data=_dictionary(read_leading_frame(file.read_at(8 + size, 0))))
                fields, http, payload = parse(z.decompress(file.read_at(length, offset)))
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                found.append((_page(fields["warc-record-id"]), size, digest, kind, _page(fields["warc-refers-to"]) if kind == "revisit" else None))
            yield dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else {n: [] for n in names}
        if file is not None:
            file.close()

    dealt = places.repartition("archive", (F.col("offset") / F.lit(16 << 20)).cast("long")).sortWithinPartitions("archive", "offset")
    return map_batches(dealt, run, RECORDS, rows=256)
