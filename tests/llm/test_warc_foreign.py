"""Archives that others wrote: streamed frames, skippable frames, other record types, other digests."""

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.errors import PythonException

from folioworks.llm import warc

ID = "<urn:uuid:8f0b2c1a-1111-4222-8333-444455556666>"


def record(kind, block, *more, content="application/http;msgtype=response"):
    head = [("WARC-Type", kind), ("WARC-Record-ID", ID), ("WARC-Date", "2020-01-01T00:00:00Z"), ("Content-Type", content), *more, ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def streamed(raw, dictionary=None):
    """A frame as a stream writes it: without its content's size."""
    press = zstandard.ZstdCompressor(dict_data=dictionary).compressobj()
    return press.compress(raw) + press.flush()


HTTP = b"HTTP/1.1 200 OK\r\nServer: \xe9\r\nX-Long: a\r\n  b\r\nContent-Length: 4\r\n\r\nbody"
SHA1 = "sha1:" + base64.b32encode(hashlib.sha1(b"body").digest()).decode()
SKIP = struct.pack("<II", 0x184D2A53, 3) + b"abc"


def read(spark, content, **how):
    return warc.read_archives(spark.createDataFrame([("a.warc.zst", bytearray(content))], "archive string, content binary"), **how)


def test_frames_without_content_size_and_between_them_skippable_ones(spark):
    raw = record("response", HTTP, ("WARC-Payload-Digest", SHA1))
    assert zstandard.get_frame_parameters(streamed(raw)).content_size in (0, zstandard.CONTENTSIZE_UNKNOWN)
    rows = read(spark, SKIP + streamed(raw) + SKIP + streamed(raw) + SKIP).collect()
    assert [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.record_id, bytes(r.payload)) for r in rows] == [(None, 4, hashlib.sha256(b"body").hexdigest(), "response", ID, b"body")] * 2


@pytest.mark.parametrize("packed", [False, True])
def test_dictionary_that_is_a_frame_without_size(spark, packed):
    records = [record("response", HTTP.replace(b"body", b"%04d" % i)) for i in range(200)]
    dictionary = zstandard.train_dictionary(1024, records, k=64, d=8)
    own = streamed(dictionary.as_bytes()) if packed else dictionary.as_bytes()
    content = struct.pack("<II", warc.SKIPPABLE_DICTIONARY, len(own)) + own + b"".join(streamed(r, dictionary) for r in records)
    assert sorted(bytes(r.payload) for r in read(spark, content).collect()) == [b"%04d" % i for i in range(200)]


def test_other_types_are_left_out_or_listed(spark):
    content = b"".join(map(streamed, [
        record("warcinfo", b"software: x\r\n", content="application/warc-fields"), record("request", b"GET / HTTP/1.1\r\n\r\n", content="application/http;msgtype=request"),
        record("response", HTTP), record("metadata", b"", content="text/plain"), record("response", b"a.example. 1.2.3.4", content="text/dns"),
        record("revisit", b"", ("WARC-Profile", warc.REVISIT)), record("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 9", ("WARC-Profile", warc.REVISIT), ("WARC-Refers-To", ID)),
    ]))
    assert [r.record_type for r in read(spark, content).collect()] == ["response", "response", "revisit", "revisit"]
    rows = read(spark, content, types=None).collect()
    assert [r.record_type for r in rows] == ["warcinfo", "request", "response", "metadata", "response", "revisit", "revisit"]
    assert [r.payload_bytes for r in rows] == [13, 18, 4, 0, 18, None, 9] and all(r.refers_to is None for r in rows) and rows[5].payload_digest is None


@pytest.mark.parametrize("raw", [
    record("response", HTTP.replace(b"Content-Length: 4", b"Transfer-Encoding: chunked"), ("WARC-Payload-Digest", "sha1:AAAA")),
    record("response", HTTP.replace(b"Length: 4", b"Length: 4000"), ("WARC-Truncated", "length"), ("WARC-Payload-Digest", "sha256:" + "0" * 64)),
    record("response", HTTP, ("WARC-Payload-Digest", "blake3:00")),
])
def test_bodies_that_headers_cannot_vouch_for(spark, raw):
    row = read(spark, streamed(raw)).first()
    assert (row.payload_bytes, row.payload_digest) == (4, hashlib.sha256(b"body").hexdigest())


@pytest.mark.parametrize("content, what", [
    (streamed(record("response", HTTP)) + streamed(record("response", HTTP, ("WARC-Payload-Digest", "sha1:AAAA"))), "another digest"),
    (streamed(record("response", HTTP.replace(b"Length: 4", b"Length: 5"))), "another length"),
    (streamed(record("response", HTTP))[:-2], "byte 0"), (SKIP + b"no frame at all", "byte 11"), (SKIP[:-1], "skippable frame is cut off"), (b"\x28", "cut off"),
    (streamed(record("revisit", b"")), "profile"), (streamed(b"WARC/1.0\r\n\r\n"), "header|not a"),
])
def test_errors_name_archive_and_place(spark, content, what):
    with pytest.raises(PythonException, match=rf"a\.warc\.zst, record \d.*({what})"):
        read(spark, content).collect()


def test_ids_of_pages():
    for page in (0, 1, 7, -1, (1 << 63) - 1, -(1 << 63), None):
        assert warc.page_of(warc.record_id(page)) == page
    assert warc.page_of(ID) is None and warc.page_of("<urn:x:1>") is None and warc.page_of("") is None
