"""WARC archives in Zstandard: a frame for each record, a dictionary in a leading skippable frame.

Archives are rows (archive, content) with binary content of bounded size, so Spark writes
and reads them in any store. Files `*.warc.zst` read with format("binaryFile") have the
same content column, and `content` of a row written to a file is such a file.

Scale: equal payloads are found by their digests, with partial aggregates; the first ones
of repeated payloads are broadcast up to a checked number, joined by a shuffle beyond it.
Records go into archives where they are; no archive exceeds the size of its records by
more than one.

Defined results: a null payload is empty; a null id is kept as null and never referred to;
a null address has no header; control characters in addresses are percent-encoded; rows
that share the smallest id of a payload are all responses. A record that breaks a rule of
the format stops the reading with an error naming the archive and place.

Archives that others wrote are read as well: frames without a content size, skippable
frames between records, record types beside response and revisit (left out, or listed on
request), responses that are not HTTP, digests by other algorithms (checked where they are
MD5 or SHA), HTTP bodies with a transfer encoding or cut off on purpose (their length and
digest are not those of the response's own headers, so they are not held against them).
Their record ids are no page ids: page_id is null, record_id is as written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as c

#: The first numbers of frames to skip, that of a dictionary among them, and of a frame with data.
SKIPPABLE, SKIPPABLE_DICTIONARY, FRAME = range(0x184D2A50, 0x184D2A60), 0x184D2A5D, 0xFD2FB528
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
#: An archive ends once its records, not compressed, have this size.
ARCHIVE_BYTES = 4 << 20
#: Bytes of an archive's first records that its dictionary is trained on, and the dictionary's size.
TRAINING_BYTES, DICTIONARY_BYTES = 256 << 10, 16 << 10
BROADCAST_FIRSTS = 200_000
_NO_ID = (1 << 128) - 1


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_ID if page is None else page & (1 << 64) - 1)}>"


def page_of(record: str) -> int | None:
    """The page id of a record id made by `record_id`; null for the null page's and for ids that others made."""
    own = re.fullmatch(r"<urn:uuid:(00000000-0000-0000-[0-9a-f]{4}-[0-9a-f]{12})>", record)
    n = uuid.UUID(own[1]).int if own else None
    return n if n is None or n < 1 << 63 else n - (1 << 64)


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0], safe=""), url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to))]
    body = http if refers_to is not None else http + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8") + b"\r\n" + body + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """An archive of the records. A dictionary needs a few records to be trained on; without, none is written."""
    sample, size = [], 0
    for r in records:
        if size >= TRAINING_BYTES:
            break
        sample.append(r[: TRAINING_BYTES - size])
        size += len(sample[-1])
    lead, dictionary = b"", None
    if len(sample) >= 8:
        try:
            dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 10)), sample, k=512, d=8)
        except zstandard.ZstdError:
            dictionary = None
    if dictionary is not None:
        raw = dictionary.as_bytes()
        lead = struct.pack("<II", SKIPPABLE_DICTIONARY, len(raw)) + raw
        dictionary.precompute_compress(level=3)
    press = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return lead + b"".join(press.compress(r) for r in records)


def frame_end(raw: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends: its header, its blocks, its checksum."""
    head = bytes(raw[at : at + 18])
    place = at + zstandard.frame_header_size(head)
    while True:
        if place + 3 > len(raw):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(raw[place : place + 3], "little")
        place += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            return place + 4 * zstandard.get_frame_parameters(head).has_checksum


def _frame(press: zstandard.ZstdDecompressor, raw: memoryview) -> bytes:
    """What a frame holds, whether or not it says how much that is."""
    stream = press.decompressobj()
    out = stream.decompress(raw)
    if not stream.eof:
        raise ValueError("a frame is cut off")
    return out


def unpack(content: bytes):
    """The records of an archive, one for each frame; errors say at which byte the frame starts."""
    raw, at = memoryview(content), 0
    press = zstandard.ZstdDecompressor()
    while at < len(raw):
        try:
            if len(raw) - at < 8:
                raise ValueError("a frame is cut off")
            kind, size = struct.unpack("<II", raw[at : at + 8])
            if kind in SKIPPABLE:
                end = at + 8 + size
                if end > len(raw):
                    raise ValueError("a skippable frame is cut off")
                if kind == SKIPPABLE_DICTIONARY and at == 0:
                    own = bytes(raw[8:end])
                    if own[:4] == FRAME.to_bytes(4, "little"):  # the dictionary may be a frame itself
                        own = _frame(press, memoryview(own))
                    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
                at = end
                continue
            end = frame_end(raw, at)
            if end > len(raw):
                raise ValueError("a frame is cut off")
            record = _frame(press, raw[at:end])
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"byte {at}: {e}") from e
        yield record
        at = end


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or name != name.strip():
            raise ValueError(f"not a header: {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _http_headers(raw: bytes) -> dict[str, str]:
    """Headers of a response as servers write them: any bytes, lines that go on, the first of a name counts."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", raw.decode("latin-1")).splitlines():
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def digest_fits(label: str, payload: bytes) -> bool:
    """Whether algorithm:value is the payload's digest, in hexadecimal or base 32; unknown algorithms fit."""
    algorithm, _, value = label.partition(":")
    algorithm = algorithm.strip().lower().replace("-", "")
    if algorithm not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(algorithm, payload)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its response, and the payload, after checks of form, lengths and digest.

    The payload of a record that is not HTTP is its whole block.
    """
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC header")
    h = _headers(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"no {name}")
    if not h["content-length"].isdecimal():
        raise ValueError("Content-Length is no number")
    size = int(h["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length does not fit the record")
    block, kind = rest[:size], h["warc-type"]
    if kind == "revisit" and "warc-profile" not in h:
        raise ValueError("a revisit without a profile")
    if kind not in ("response", "revisit") or not h.get("content-type", "").lower().startswith("application/http") or kind == "revisit" and not block:
        return h, {}, block
    status, gap, payload = block.partition(b"\r\n\r\n")
    first, _, lines = status.partition(b"\r\n")
    if not first.startswith(b"HTTP/") or not gap and kind == "response":
        raise ValueError("no HTTP response")
    inner = _http_headers(lines)
    if kind == "response" and "warc-truncated" not in h and "transfer-encoding" not in inner:
        if inner.get("content-length", str(len(payload))) != str(len(payload)):
            raise ValueError("the payload has another length than its response says")
        if "warc-payload-digest" in h and not digest_fits(h["warc-payload-digest"], payload):
            raise ValueError("the payload has another digest than its record says")
    return h, inner, payload


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """_id, url, payload, digest, refers_to (null: a response)."""
    p = pages.select(F.col(page_id).cast("long").alias("_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    firsts = p.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    firsts = c.materialize(firsts)
    few = firsts.limit(BROADCAST_FIRSTS + 1).count() <= BROADCAST_FIRSTS
    return p.join(F.broadcast(firsts) if few else firsts, "digest", "left").select("_id", "url", "payload", "digest", F.when(F.col("first") != F.col("_id"), F.col("first")).alias("refers_to"))


def write_archives(marked: DataFrame, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """archive, content: the records of each task in archives of bounded size."""

    def run(batches):
        records, size = [], 0

        def archive():
            raw = pack(records)
            return pa.RecordBatch.from_pydict({"archive": pa.array([hashlib.sha256(raw).hexdigest()[:32] + ".warc.zst"]), "content": pa.array([raw], pa.binary())})

        for batch in batches:
            ids, urls, payloads, digests, refs = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                records.append(build_record(ids[i].as_py(), urls[i].as_py(), payloads[i].as_py(), digests[i].as_py(), refs[i].as_py(), date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield archive()
                    records, size = [], 0
        if records:
            yield archive()

    return marked.select("_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def _row(h: dict[str, str], inner: dict[str, str], payload: bytes) -> tuple:
    """A record's columns. A revisit's length and digest are those of the full payload, null where its headers don't say."""
    revisit, label = h["warc-type"] == "revisit", h.get("warc-payload-digest", "").lower()
    own = label.removeprefix("sha256:") if re.fullmatch("sha256:[0-9a-f]{64}", label) else None
    whole = inner.get("content-length", "")
    size = len(payload) if not revisit else int(whole) if whole.isdecimal() else None
    checked = own and "warc-truncated" not in h and "transfer-encoding" not in inner and inner
    digest = own if revisit or checked else hashlib.sha256(payload).hexdigest()
    return page_of(h["warc-record-id"]), h.get("warc-target-uri"), size, digest, h["warc-type"], page_of(h.get("warc-refers-to", "")) if revisit else None, h["warc-record-id"]


def read_archives(archives: DataFrame, content: str = "content", name: str = "archive", payloads: bool = True, types: tuple[str, ...] | None = ("response", "revisit")) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, record_id (and payload; null for revisits).

    Records of other types than these are checked and left out; None lists all.
    """
    fields = [("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("record_id", T.StringType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields + [("payload", T.BinaryType())] * payloads])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=schema.names)

        for batch in batches:
            for where, raw in zip(batch.column(0), batch.column(1), strict=True):
                rows, size, k = [], 0, 0
                try:
                    for k, record in enumerate(unpack(raw.as_py() or b"")):
                        h, inner, payload = parse_record(record)
                        if types is not None and h["warc-type"] not in types:
                            continue
                        rows.append(_row(h, inner, payload) + ((None if h["warc-type"] == "revisit" else payload,) if payloads else ()))
                        size += len(payload) if payloads else 100
                        if size > 4 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as e:
                    raise ValueError(f"{where.as_py()}, record {k} or the next: {e}") from e
                if rows:
                    yield out(rows)

    return archives.select(name, content).mapInArrow(run, schema)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Writes archives of all pages to the shared folder and reads them back: one row for each page."""
    archives = c.materialize(write_archives(mark_revisits(pages, page_id, url, payload)))
    return read_archives(archives, payloads=False).select(F.col("page_id").alias(page_id), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("url").alias("target_uri"))
