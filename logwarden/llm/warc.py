"""Zstandard WARC archives: a dictionary in a leading skippable frame, then one frame per record.

Archives are written by Spark's text sink, whose rows may be any bytes and whose line separator is an empty skippable frame, so they
can lie in any store Spark writes to and a lost executor's part is written again. Readers skip such frames by the format's rules.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_dir

#: Frame magics and the fixed lines of records (fixed values).
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
FRAME_MAGIC = 0xFD2FB528
SEPARATOR = "P*M\x18\0\0\0\0"  # the skippable frame 0x184D2A50 of length 0
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_MANY = 16  # ways in which the rows of one digest are dealt


def with_originals(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to: the largest page_id of equal payloads of ``least`` bytes, null for that page itself.

    Digests are grouped before anything is moved, and only those met twice are joined back, each dealt in several ways.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"))
    copies = (rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes")
              .agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    dealt = copies.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(_MANY - 1))))
    rows = rows.withColumn("way", F.when(F.col("bytes") >= least, F.pmod(F.xxhash64("page_id", "url"), F.lit(_MANY)).cast("int")))
    joined = rows.join(dealt, ["digest", "bytes", "way"], "left")
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("original")), F.col("original"))
    return joined.select("page_id", "url", "payload", "bytes", "digest", revisit.alias("refers_to"))


def _id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _page(name: str) -> int | None:
    if not (name.startswith("<urn:page:") and name.endswith(">")):
        raise ValueError("a record's id is malformed")
    return None if name == "<urn:page:none>" else int(name[10:-1])


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response record with an HTTP block, or a revisit record that holds the HTTP head alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + payload if refers_to is None else head
    clean = "".join(c if c.isprintable() and c != " " else "%20" for c in url or "about:blank")
    lines = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}", "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes], size: int):
    """A dictionary trained on ``samples``, or their beginnings where they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records: int = 4096, samples: int = 256,
                   dict_bytes: int = 32_768, level: int = 3) -> None:
    """Write archives of at most ``records`` records from the rows of :func:`with_originals`.

    Each archive has a dictionary of its own, trained on its first ``samples`` records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def frames(part: list[bytes], packer):
            return pa.RecordBatch.from_arrays([pa.array([packer.compress(x) for x in part], pa.binary())], names=["value"])

        waiting: list[bytes] = []
        packer, n = None, 0
        def start():
            nonlocal packer
            trained = _dictionary(waiting, dict_bytes)
            packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
            raw = trained.as_bytes()
            return pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICT_MAGIC, len(raw)) + raw], pa.binary())], names=["value"])

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page, url, payload, digest, refers_to = (c[i].as_py() for c in cols)
                waiting.append(record(page, url, payload, digest, refers_to, date))
                n += 1
                if packer is None and len(waiting) == samples:
                    yield start()
                if packer is not None and (len(waiting) >= 64 or n == records):
                    yield frames(waiting, packer)
                    waiting = []
                if n == records:
                    packer, n = None, 0
        if waiting:
            if packer is None:
                yield start()
            yield frames(waiting, packer)

    # the sink begins a file after as many rows: the dictionary and the records of one archive
    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("compression", "none")
     .option("lineSep", SEPARATOR).option("maxRecordsPerFile", records + 1).text(path))


def read_records(raw: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive; ValueError where frames, headers or lengths are not as they must be."""
    import zstandard

    if len(raw) < 8 or struct.unpack_from("<I", raw)[0] != DICT_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = struct.unpack_from("<I", raw, 4)[0]
    if 8 + size > len(raw):
        raise ValueError("the dictionary frame is cut off")
    known = bytes(raw[8 : 8 + size])
    if known[:4] == struct.pack("<I", FRAME_MAGIC):
        known = zstandard.ZstdDecompressor().decompress(known)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known))
    at = 8 + size
    while at < len(raw):
        if at + 8 > len(raw):
            raise ValueError("a frame is cut off")
        magic, length = struct.unpack_from("<II", raw, at)
        if magic in SKIPPABLE:
            at += 8 + length
            if at > len(raw):
                raise ValueError("a skippable frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError("no frame begins here")
        one = reader.decompressobj()
        data = b""
        pos = at
        while not one.eof and pos < len(raw):
            data += one.decompress(raw[pos : pos + 65_536])
            pos += 65_536
        if not one.eof:
            raise ValueError("a record's frame is cut off")
        at = min(pos, len(raw)) - len(one.unused_data)
        yield parsed(data)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the only record in ``data``, with version, lengths and block digest checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise ValueError("a record does not begin with its version")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise ValueError("a header has no colon")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"a record has no {name}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("a record's length is not as its header says")
    block = rest[:length]
    if "warc-block-digest" in headers and headers["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("a record's block does not match its digest")
    return headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple:
    kind = headers["warc-type"]
    http, mark, payload = block.partition(b"\r\n\r\n")
    said = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(said) != 1:
        raise ValueError("a record's HTTP head has no length")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
    if kind == "response" and (len(payload) != said[0] or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its length and digest")
    return _page(headers["warc-record-id"]), said[0], digest, kind, _page(headers["warc-refers-to"]) if kind == "revisit" else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record under ``path``; nothing is skipped silently."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for content in batch.column("content"):
                rows = [_row(*x) for x in read_records(memoryview(content.as_buffer()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def archived_pages(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives in the shared folder and read them back, a row per row of ``pages``.

    A null html is an empty payload. Of equal payloads of ``least`` bytes or more the rows of the largest page_id are responses and
    the others, null ids too, revisit it. Where all such ids are null, all are responses. A null url becomes about:blank. Repeated
    rows are archived each; an empty table gives an empty result; other columns are ignored.
    """
    path = shared_dir(pages.sparkSession, "warc")
    write_archives(with_originals(pages, least), path)
    return read_archives(pages.sparkSession, path)
