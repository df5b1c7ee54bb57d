"""Media columns: content-addressed payloads in tar shards.

write_media(docs) stores each text's bytes, padded with zeros to a positive
multiple of 64, as a greyscale PNG image: one 8-bit sample per byte, deflated, so
the stored form is lossless and smaller than the bytes. The image is one row
high; a tEXt chunk ahead of the samples keeps the unpadded length. Images go into
uncompressed tar shards in the shared folder, under the SHA-256 of the image as
member name. Rows carry digest, shard, offset and length only.

catalog(rows) gives one place per digest; read_metadata and read_features fetch
byte ranges of the shards: the first 96 bytes of a member for metadata, the whole
member for payload digests and features.

A task writes a content once however often it meets it. Copies met by other tasks
land in their shards too; the catalog names one of them for all rows. Shard names
are unique per attempt, so a repeated task can't disturb what another wrote, and
only shards named by a finished task's rows are ever read.

Defined results: null and empty texts become 64 zero bytes with n_bytes 0;
repeated rows and null ids give a row each; other columns are ignored; an empty
table gives an empty table and writes no shard.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import Batch, fresh_dir, map_batches, store, text_bytes

#: A shard is closed at this size; a task holds one open file and one image.
SHARD_BYTES = 64 << 20
UNIT = 64
#: Bytes that hold everything ahead of the samples.
HEADER_BYTES = 96

_SIGNATURE = b"\x89PNG\r\n\x1a\n"

PLACES = "doc_id long, digest binary, shard string, offset long, length long"
METADATA = "digest binary, width long, height long, bit_depth int, n_bytes long, media_bytes long"
FEATURES = "digest binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    return data + b"\0" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def to_png(data: bytes, level: int = 3) -> bytes:
    payload = padded(data)
    head = struct.pack(">IIBBBBB", len(payload), 1, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode()) + _chunk(b"IDAT", zlib.compress(b"\0" + payload, level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, unpadded bytes) from the first bytes of an image."""
    if not head.startswith(_SIGNATURE):
        raise ValueError("not an image of this store")
    width, height, depth = struct.unpack_from(">IIB", head, 16)
    size, kind = struct.unpack_from(">I4s", head, 33)
    if kind != b"tEXt":
        raise ValueError("the unpadded length is missing")
    return width, height, depth, int(head[41 : 41 + size].partition(b"\0")[2])


def png_samples(image: bytes) -> bytes:
    """The samples, with every chunk's checksum verified."""
    at, data = len(_SIGNATURE), []
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError(f"damaged {kind!r} chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return zlib.decompress(b"".join(data))[1:]


def feature_of(samples: bytes) -> str:
    """Mean, root mean square, entropy in bits, and zero-crossing rate around the mean."""
    x = np.frombuffer(samples, np.uint8)
    n = len(x)
    share = np.bincount(x, minlength=256) / n
    values = np.arange(256)
    mean = float(share @ values)
    rms = float(np.sqrt(share @ (values * values)))
    seen = share[share > 0]
    above = x > mean
    crossing = float(np.count_nonzero(above[1:] != above[:-1])) / n
    return f"mean={mean:.4f};rms={rms:.4f};entropy={float(-(seen * np.log2(seen)).sum()) + 0.0:.4f};zcr={crossing:.4f}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def write_media(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store every text; per row its digest, shard, offset and length. Written out before it returns."""
    base = folder or fresh_dir(docs.sparkSession, "media")

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        filesystem, root = _filesystem(base)
        places: dict[bytes, tuple[str, int, int]] = {}
        by_text: dict[bytes, bytes] = {}
        out, name = None, ""
        for b in batches:
            rows: Batch = {"doc_id": b["k"], "digest": [], "shard": [], "offset": [], "length": []}
            for raw in b["t"]:
                of_text = hashlib.sha256(raw).digest()
                digest = by_text.get(of_text)
                if digest is None:
                    image = to_png(raw)
                    digest = hashlib.sha256(image).digest()
                    if len(by_text) >= 500_000:
                        by_text.clear(), places.clear()
                    if out is None:
                        filesystem.create_dir(root, recursive=True)
                        name = f"shard-{uuid.uuid4().hex}.tar"
                        out = filesystem.open_output_stream(f"{root}/{name}", compression=None)
                    info = tarfile.TarInfo(digest.hex() + ".png")
                    info.size = len(image)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    at = out.tell() + len(head)
                    out.write(head + image + b"\0" * (-len(image) % tarfile.BLOCKSIZE))
                    by_text[of_text], places[digest] = digest, (name, at, len(image))
                    if out.tell() >= shard_bytes:
                        out = _close(out)
                for column, value in zip(("digest", "shard", "offset", "length"), (digest, *places[digest]), strict=True):
                    rows[column].append(value)
            yield rows
        _close(out)

    rows = docs.select(F.col(key).cast("long").alias("k"), text_bytes(text).alias("t"))
    placed = store(map_batches(rows, run, PLACES), "media-rows")
    return placed.withColumn("shard", F.concat(F.lit(base + "/"), "shard"))


def _close(out) -> None:
    if out is not None:
        out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        out.close()


def catalog(rows: DataFrame) -> DataFrame:
    """One place per digest."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(places: DataFrame, fn, schema: str, most: int | None) -> DataFrame:
    """fn(digest, member's length, bytes) per place, by shard and offset so that reads run forward."""

    def run(batches: Iterator[Batch]) -> Iterator[Batch]:
        names = [c.split()[0] for c in schema.split(", ")]
        file, opened = None, None
        for b in batches:
            found = []
            for digest, shard, offset, length in zip(b["digest"], b["shard"], b["offset"], b["length"], strict=True):
                if shard != opened:
                    if file is not None:
                        file.close()
                    filesystem, path = _filesystem(shard)
                    file, opened = filesystem.open_input_file(path), shard
                found.append(fn(digest, length, file.read_at(length if most is None else min(most, length), offset)))
            yield dict(zip(names, map(list, zip(*found, strict=True)), strict=True)) if found else {n: [] for n in names}
        if file is not None:
            file.close()

    dealt = places.repartition("shard", (F.col("offset") / F.lit(16 << 20)).cast("long")).sortWithinPartitions("shard", "offset")
    return map_batches(dealt, run, schema, rows=128)


def read_metadata(places: DataFrame) -> DataFrame:
    """Metadata columns per digest, from the members' headers alone."""

    def fn(digest: bytes, length: int, head: bytes) -> tuple:
        width, height, depth, n = png_header(head)
        return digest, width, height, depth, n, length

    return _ranges(places, fn, METADATA, HEADER_BYTES)


def read_features(places: DataFrame) -> DataFrame:
    """Payload and image digests, tail checksum and features per digest, from the whole members."""

    def fn(digest: bytes, length: int, image: bytes) -> tuple:
        if hashlib.sha256(image).digest() != digest:
            raise ValueError("a stored image doesn't match its name")
        samples = png_samples(image)
        return digest, png_header(image)[3], len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), length, digest.hex(), feature_of(samples)

    return _ranges(places, fn, FEATURES, None)


def media_columns(docs: DataFrame, folder: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document the metadata and feature columns of its stored payload."""
    rows = write_media(docs, folder, text, key)
    places = catalog(rows)
    # Both reads share the catalog's order; headers give sizes, whole members the rest.
    known = read_metadata(places).select("digest", "width", "height", "bit_depth")
    full = read_features(places)
    found = rows.join(known.join(full, "digest"), "digest", "left")
    return found.select("doc_id", *[c for c in full.columns if c != "digest"], "width", "height", "bit_depth")


def members(archive: bytes) -> list[str]:
    """Names in a shard, for checks."""
    with tarfile.open(fileobj=io.BytesIO(archive)) as t:
        return t.getnames()
