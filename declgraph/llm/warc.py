"""WARC archives: a writer with revisits and a sequential reader.

An archive is a sequence of records, each in a gzip member of its own. The
writer gives rows of whole archives (binary) of about ``roll`` bytes, which
Spark stores wherever its session can write; ``read_files`` reads .warc.gz
files through Spark's own file source, each as one value, so up to 2 GB. The
reader inflates a member bit by bit, frames the block by Content-Length and
checks the SHA-1 of the payload, and of the block, where the record states them.

Records of other writers are read as well: of any type, with HTTP heads in any
encoding, with or without lengths and digests. What isn't an HTTP message is all payload.

Of pages with equal payloads of at least ``least`` bytes, the one with the
largest page_id is a response; the others are revisits that refer to it.
Payloads are compared by SHA-1 and length. Only digests are grouped and
joined; the html crosses the network once, by page_id.

Defined cases: a null html is an empty payload; a page without page_id is
a response; rows that repeat the largest page_id are all responses; a null url
is an empty target; an empty table gives no archives and no records; other
columns are ignored. A record that is cut off, or whose digest or length
doesn't fit, raises an error, or is a row with an ``error`` if asked for; the
reader then goes on at the next member that holds a record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

ROLL = 1 << 20
PIECE = 1 << 16
#: Records carry no wall-clock time, so that equal pages give equal archives.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c not in chr(13) + chr(10))}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Members:
    """Gzip members of an archive, inflated piece by piece."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def more(self) -> bool:
        return self.at < len(self.data)

    def open(self) -> None:
        self.inflate, self.held, self.left = zlib.decompressobj(31), bytearray(), b""

    def fill(self) -> bool:
        """Inflate one more piece; False at the member's end."""
        if self.inflate.eof:
            return False
        given = self.left or self.data[self.at : self.at + PIECE]
        if not given:
            raise ValueError("a record is cut off")
        if not self.left:
            self.at += len(given)
        self.held += self.inflate.decompress(given, PIECE)
        self.left = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.at -= len(self.inflate.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (end := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark))
            if not self.fill():
                raise ValueError("a record's head is cut off")
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def exactly(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.held and not self.fill():
                raise ValueError("a record's block is cut off")
            piece = bytes(self.held[:size])
            del self.held[:size]
            size -= len(piece)
            if piece:
                yield piece

    def close(self) -> None:
        while self.fill():
            pass
        if bytes(self.held) != b"\r\n\r\n":
            raise ValueError("Content-Length and the record's end don't fit")


def fields(head: bytes) -> dict[str, str]:
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError:
        text = head.decode("latin-1")
    first, *lines = text.split("\r\n")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return out | {"": first}


def page(urn: str) -> int | None:
    found = urn.removeprefix("<urn:x-page:").removesuffix(">")
    return int(found) if found.lstrip("-").isdigit() else None


def sha1_of(stated: str | None) -> str | None:
    """The hex digits of a stated SHA-1, in base 32 or 16; None for another or no digest."""
    name, _, value = (stated or "").partition(":")
    if name.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def one_record(members: Members, keep_payload: bool) -> dict:
    members.open()
    head = fields(members.until(b"\r\n\r\n"))
    if not head[""].startswith("WARC/") or not head.get("content-length", "").isdigit():
        raise ValueError("not a WARC record")
    kind = head.get("warc-type", "")
    is_http = head.get("content-type", "").lower().replace(" ", "").startswith("application/http")
    of_block, sha, length = hashlib.sha1(), hashlib.sha1(), 0
    kept: list[bytes] | None = [] if keep_payload else None
    http, answer = bytearray(), None if is_http else {}
    for piece in members.exactly(int(head["content-length"])):
        of_block.update(piece)
        if answer is None:
            http += piece
            if (end := http.find(b"\r\n\r\n")) < 0:
                continue
            answer, piece = fields(bytes(http[:end])), bytes(http[end + 4 :])
        sha.update(piece)
        length += len(piece)
        if kept is not None:
            kept.append(piece)
    members.close()
    stated, block = sha1_of(head.get("warc-payload-digest")), sha1_of(head.get("warc-block-digest"))
    long = (answer or {}).get("content-length", "")
    said = int(long) if long.isdigit() else None
    if block and block != of_block.hexdigest():
        raise ValueError(f"block of {head.get('warc-record-id')} doesn't fit its digest")
    if kind == "revisit" and length:
        raise ValueError("a revisit with a payload")
    if kind != "revisit" and (stated != sha.hexdigest() if stated else said not in (None, length) and "transfer-encoding" not in answer):
        raise ValueError(f"payload of {head.get('warc-record-id')} doesn't fit its digest or length")
    return {
        "page_id": page(head.get("warc-record-id", "")),
        "payload_bytes": (said or 0) if kind == "revisit" else length,
        "payload_digest": stated or (None if kind == "revisit" else sha.hexdigest()),
        "record_type": kind,
        "refers_to": page(head["warc-refers-to"]) if "warc-refers-to" in head else None,
        "url": head.get("warc-target-uri", "").removeprefix("<").removesuffix(">"),
        "payload": b"".join(kept) if kept is not None else None,
        "error": None,
    }


def records(archive: bytes, keep_payload: bool = False, errors: bool = False) -> Iterator[dict]:
    """Verified records in sequence. A payload is only held if it is asked for; with errors, damaged records are rows that say why."""
    members, told = Members(archive), False
    while members.more():
        begin = members.at
        try:
            found = one_record(members, keep_payload)
        except (ValueError, zlib.error) as e:
            if not errors:
                raise ValueError(str(e)) from e
            if not told:
                yield dict.fromkeys(("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")) | {"error": str(e)}
            told, after = True, archive.find(b"\x1f\x8b\x08", begin + 1)
            members.at = after if after >= 0 else len(archive)
            continue
        told = False
        yield found


def classify(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, refers_to (null for responses)."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    digests = own.select("page_id", "digest", F.octet_length("html").alias("size")).filter(F.col("size") >= least)
    groups = digests.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = digests.join(groups, ["digest", "size"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return own.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


def archives(classified: DataFrame, roll: int = ROLL) -> DataFrame:
    """Rows of whole archives: warc binary, records long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = bytearray(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bytes(held)], pa.binary()), pa.array([n], pa.int64())], names=["warc", "records"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                held += record(page_id, url, html.encode(), digest, refers_to)
                n += 1
                if len(held) >= roll:
                    yield out()
                    held, n = bytearray(), 0
        if held:
            yield out()

    small_batches(classified.sparkSession)
    return classified.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "warc binary, records long")


def read(warcs: DataFrame, warc_col: str = "warc", payloads: bool = False, errors: bool = False) -> DataFrame:
    """A row per record of the archives in a binary column."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * payloads + ["error"] * errors
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads + [pa.string()] * errors
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads + ", error string" * errors

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            for archive in given.column(0):
                rows, held = [], 0
                for r in records(archive.as_py() or b"", payloads, errors):
                    rows.append(r)
                    held += len(r["payload"] or b"")
                    if len(rows) >= 1000 or held > 16 * ROLL:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return warcs.select(warc_col).mapInArrow(run, schema)


def read_files(spark, path: str, payloads: bool = False, errors: bool = False) -> DataFrame:
    """The records of .warc.gz files."""
    return read(spark.read.format("binaryFile").load(path), "content", payloads, errors)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read(staged(archives(classify(pages, least)))).drop("url")
