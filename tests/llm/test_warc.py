import gzip
import hashlib

import pytest

from declgraph.llm import warc

PAGE = "page_id long, url string, html string, warc string, digest int"


def test_round_trip(spark):
    big = "<p>" + "x é " * 500
    rows = [(1, "http://a", big), (5, None, big), (5, None, big), (3, "http://c", big + "y"), (4, "http://d", None), (6, "http://e", ""), (None, "u", big), (2, "http://s", "small"), (7, "x", "small")]
    pages = spark.createDataFrame([(*r, None, 1) for r in rows], PAGE)
    found = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    wanted = sorted(
        (str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), *(("revisit", 5) if i == 1 else ("response", None))) for i, _, h in rows
    )
    assert found == wanted
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_and_files(spark, tmp_path):
    body = "y" * 300_000
    pages = spark.createDataFrame([(1, "http://a/é", body, None, 1), (2, "b", "z", None, 1)], PAGE)
    made = warc.archives(warc.classify(pages).coalesce(1)).collect()
    (tmp_path / "one.warc.gz").write_bytes(b"".join(bytes(r.warc) for r in made))
    found = {r.page_id: (r.url, bytes(r.payload).decode()) for r in warc.read_files(spark, str(tmp_path), payloads=True).collect()}
    assert found == {1: ("http://a/é", body), 2: ("b", "z")}


def test_damage_is_seen():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert [r["page_id"] for r in warc.records(good + good)] == [1, 1]
    for bad in (good[:-9], gzip.compress(gzip.decompress(good).replace(b"payload\r\n", b"PAYLOAD\r\n")), gzip.compress(gzip.decompress(good)[:-2])):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_revisits_have_no_payload():
    data = warc.record(1, "u", b"p" * 2000, hashlib.sha1(b"p" * 2000).hexdigest(), 9)
    (r,) = warc.records(data, keep_payload=True)
    assert (r["record_type"], r["refers_to"], r["payload_bytes"], r["payload"]) == ("revisit", 9, 2000, b"")
    assert len(gzip.decompress(data)) < 700


def member(head, block):
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in head.items()), f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def crawled():
    """Records as crawlers write them: no lengths, other encodings, digests of blocks or in base 16, several types."""
    sha = lambda x: hashlib.sha1(x).hexdigest()
    info, body = b"software: x\r\n", b"<p>caf\xe9</p>"
    answer = "HTTP/1.0 200 D'accord\r\nX-Nom: é\r\n\r\n".encode("latin-1") + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    return [
        member({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>", "Content-Type": "application/warc-fields"}, info),
        member({"WARC-Type": "request", "WARC-Target-URI": "<http://a/>", "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.0\r\n\r\n"),
        member({"WARC-Type": "response", "WARC-Target-URI": "http://a/", "Content-Type": "application/http;msgtype=response", "WARC-Block-Digest": f"sha1:{sha(answer)}"}, answer),
        member({"WARC-Type": "response", "WARC-Target-URI": "dns:a", "Content-Type": "text/dns", "WARC-Payload-Digest": "md5:00"}, b"a 1.2.3.4"),
        member({"WARC-Type": "response", "WARC-Target-URI": "http://c/", "Content-Type": "application/http", "WARC-Payload-Digest": f"sha1:{sha(chunked.split(bytes([13, 10]) * 2, 1)[1])}"}, chunked),
        member({"WARC-Type": "metadata"}, b""),
    ], body, info


def test_records_of_crawlers():
    made, body, info = crawled()
    found = list(warc.records(b"".join(made), keep_payload=True))
    assert [r["record_type"] for r in found] == ["warcinfo", "request", "response", "response", "response", "metadata"]
    assert [r["payload"] for r in found] == [info, b"", body, b"a 1.2.3.4", b"5\r\nhello\r\n0\r\n\r\n", b""]
    assert [r["url"] for r in found] == ["", "http://a/", "http://a/", "dns:a", "http://c/", ""]
    assert all(r["payload_bytes"] == len(r["payload"]) and r["payload_digest"] == hashlib.sha1(r["payload"]).hexdigest() for r in found)


def test_damaged_records_are_rows(spark):
    """The records before and after a damaged one are read, and the damage is told once."""
    good = [warc.record(i, "u", b"payload" * i, hashlib.sha1(b"payload" * i).hexdigest(), None) for i in range(1, 5)]
    broken = bytearray(good[1])
    broken[len(broken) // 2] ^= 0x3C
    rows = [(b"".join([good[0], bytes(broken), good[2]]),), (good[3][:-5],), (None,), (b"",), (b"no archive",)]
    found = warc.read(spark.createDataFrame(rows, "warc binary"), errors=True).collect()
    assert sorted(r.page_id for r in found if r.page_id) == [1, 3] and sum(r.error is not None for r in found) == 3
