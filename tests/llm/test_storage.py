"""WARC archives and media shards: round trips and ties."""

from __future__ import annotations

import hashlib
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparquill.llm import media_store, warc


def _pages(spark):
    long = "<p>" + "x y z " * 50_000 + "</p>"
    same = "<html>" + "same page " * 20 + "</html>"
    rows = [
        (1, "http://a/1", same), (2, "http://a/2", same), (0, "http://a/0", same), (3, "http://a/ü x\n", "short"), (4, None, "short"),
        (5, "http://a/5", None), (6, "http://a/6", ""), (7, "http://a/7", long), (7, "http://a/7", long), (None, "http://a/n", same), (8, "u", "é\r\n\r\nWARC/1.1\r\n"),
    ]
    return spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, frame string, size int")


def test_archives_give_back_every_record(spark, tmp_path):
    pages = _pages(spark).repartition(3)
    places = warc.write_archives(pages, f"file://{tmp_path}/w")
    rows = warc.read_archives(places).collect()
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows], key=str)
    want = []
    for p in pages.collect():
        data = (p.html or "").encode()
        first = min((q.page_id for q in pages.collect() if q.html == p.html and q.page_id is not None), default=None)
        again = len(data) >= 100 and p.page_id != first
        want.append((p.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    assert {r.record_type for r in rows} == {"response", "revisit"}


def test_an_archive_reads_alone(spark, tmp_path):
    """Any frame decompresses with the dictionary of the leading frame, and holds a whole record."""
    warc.write_archives(_pages(spark).coalesce(1), f"file://{tmp_path}/w").count()
    (path,) = (tmp_path / "w").glob("*.warc.zst")
    data = path.read_bytes()
    dictionary = warc.read_leading_frame(data)
    z = zstandard.ZstdDecompressor(dict_data=warc._dictionary(dictionary))
    at, n = 8 + len(dictionary), 0
    while at < len(data):
        d = z.decompressobj()
        fields, _, _ = warc.parse(d.decompress(data[at:]))
        at = len(data) - len(d.unused_data)
        n += 1
        assert fields["warc-record-id"].startswith("<urn:x-page:")
    assert n == 11


def test_a_trained_dictionary_is_used_with_enough_records(spark, tmp_path):
    rows = [(i, f"http://a/{i}", f"<html><head><title>Page {i}</title></head><body class='main'>{'paragraph %d ' % i * 20}</body></html>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    places = warc.write_archives(pages, f"file://{tmp_path}/w")
    assert warc.read_archives(places).where("record_type = 'response'").count() == 300
    data = next((tmp_path / "w").glob("*.warc.zst")).read_bytes()
    assert zstandard.ZstdCompressionDict(warc.read_leading_frame(data)).dict_id() != 0


def test_no_pages(spark):
    assert warc.read_archives(warc.write_archives(_pages(spark).where("false"))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=500))
def test_images_are_lossless(data):
    image = media_store.to_png(data)
    samples = media_store.png_samples(image)
    assert samples[: len(data)] == data and not any(samples[len(data) :])
    assert len(samples) % 64 == 0 and len(samples) >= 64 and len(samples) - len(data) < 64 + 64 * (not data)
    assert media_store.png_header(image[: media_store.HEADER_BYTES]) == (len(samples), 1, 8, len(data))
    with pytest.raises(ValueError):
        media_store.png_samples(image[:50] + bytes([image[50] ^ 1]) + image[51:])


def test_media_columns(spark, odd_docs, no_docs, tmp_path):
    rows = media_store.media_columns(odd_docs.repartition(3), f"file://{tmp_path}/m").collect()
    want = sorted([(r.doc_id, len(d := (r.text or "").encode()), len(p := media_store.padded(d)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(media_store.to_png(d)).hexdigest()) for r in odd_docs.collect()], key=str)
    assert sorted([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in rows], key=str) == want
    by = {}
    for r in rows:
        assert by.setdefault(r.media_sha256, (r.feature, r.media_bytes)) == (r.feature, r.media_bytes)
        assert (r.width, r.height, r.bit_depth) == (r.payload_bytes, 1, 8)
    assert media_store.media_columns(no_docs).count() == 0


def test_shards_are_tar_files_that_hold_a_content_once(odd_docs, tmp_path):
    rows = media_store.write_media(odd_docs.coalesce(1), f"file://{tmp_path}/m", shard_bytes=2048)
    places = media_store.catalog(rows).collect()
    names = [n for p in (tmp_path / "m").glob("*.tar") for n in media_store.members(p.read_bytes())]
    assert sorted(names) == sorted(bytes(p.digest).hex() + ".png" for p in places)
    assert len(list((tmp_path / "m").glob("*.tar"))) > 1
