import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from plantwatch.llm import warc


def want(rows):
    holders = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 1000:
            holders.setdefault(data, []).append(key)
    found = []
    for key, _, html in rows:
        data = (html or "").encode()
        ids = [k for k in holders.get(data, []) if k is not None]
        holder = max(ids) if ids else key
        found.append((key, len(data), hashlib.sha1(data).hexdigest(), *(("response", None) if holder == key else ("revisit", holder))))
    return sorted(found, key=str)


@pytest.fixture
def pages(spark):
    schema = "page_id bigint, url string, html string, payload string, digest string"
    return lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], schema)


def cases():
    big, other = "<p>é " + "text " * 300, "x" * 999
    rows = [(k, f"http://e.example/{k}", big) for k in range(30)] + [(k, "u", other) for k in range(30, 34)]
    rows += [(40, None, None), (41, "http://a b\r\nX-Page-ID: 7", ""), (42, "u", "y" * 1000), (43, "u", "y" * 1000), (43, "u", "y" * 1000), (None, "u", "y" * 1000),
             (None, "u", "z" * 2000), (None, "u", "z" * 2000), (50, "u", "\r\n\r\nWARC/1.1\r\n" * 200), (51, "u", "語" * 400_000), (52, "u", "\x1f\x8b\x08" * 900)]
    return rows


def got(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


@pytest.mark.parametrize("file_bytes,range_bytes", [(32 << 20, 8 << 20), (3000, 100), (1 << 20, 777)])
def test_round_trip(spark, pages, file_bytes, range_bytes):
    files = warc.write_warc(pages(cases()), file_bytes=file_bytes)
    assert got(warc.archive_index(files, range_bytes=range_bytes)) == want(cases())


def test_records_are_valid_and_payloads_whole(spark, pages):
    files = warc.write_warc(pages(cases()), file_bytes=4000)
    assert files.agg(F.sum("n_records")).first()[0] == len(cases())
    rows = warc.read_warc(files).collect()
    texts = {(r.page_id, r.payload.decode()) for r in rows if r.record_type == "response"}
    assert {(k, h or "") for k, _, h in cases() if (h or "") and len((h or "").encode()) < 1000} <= texts
    assert all(r.url is None or "\n" not in r.url for r in rows)
    path = files.first().path.removeprefix("file://")
    with gzip.open(path) as f:
        assert f.readline() == b"WARC/1.1\r\n"


def test_empty_table(spark, pages):
    assert warc.round_trip(pages(cases()).limit(0)).count() == 0


def test_every_range_owns_the_records_that_start_inside():
    members = [warc.pack_record(k, "u", (f"{k} " * (50 * k)).encode(), hashlib.sha1(b"").hexdigest()) for k in range(1, 40)]
    members.insert(5, gzip.compress(b"not a record" * 50))
    data = b"".join(members)
    places = [sum(map(len, members[:k])) for k in range(len(members)) if k != 5]
    for step in (1, 13, 1000, len(data)) if len(data) < 20_000 else (50, 1000, len(data)):
        found = [p for s in range(0, len(data), step) for p, _, _ in warc.records_of(io.BytesIO(data), len(data), s, min(len(data), s + step))]
        assert found == places


def member(fields, block, level=6):
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return pack.compress(b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def places_of(data, step):
    return [(p, f is None) for s in range(0, len(data), step) for p, f, _ in warc.records_of(io.BytesIO(data), len(data), s, min(len(data), s + step))]


@pytest.mark.parametrize("payload", [3_000, 300_000])
def test_archives_inside_stored_members_are_payload(payload):
    inner = b"".join(warc.pack_record(k, "u", hashlib.sha512(f"{payload} {k}".encode()).hexdigest().encode() * 4, 40 * "0") for k in range(payload // 500))
    outer = [warc.pack_record(1, "u", b"a" * 2000, 40 * "1"), member({"WARC-Type": "response", "Content-Length": len(inner)}, inner, 0), warc.pack_record(2, "u", b"b" * 500, 40 * "2")]
    data = b"".join(outer)
    want = [(0, False), (len(outer[0]), False), (len(outer[0]) + len(outer[1]), False)]
    assert len(inner) > payload // 2 and all(places_of(data, step) == want for step in (max(97, payload // 50), payload // 3, len(data)))


@pytest.mark.parametrize("step", [50, 333, 10**6])
def test_damaged_members_are_counted_and_others_read(step):
    members = [warc.pack_record(k, "u", hashlib.sha512(str(k).encode()).digest() * 20, 40 * "0") for k in range(12)]
    places = [sum(map(len, members[:k])) for k in range(12)]
    broken = bytearray(b"".join(members))
    broken[places[4] + len(members[4]) // 2:places[4] + len(members[4]) // 2 + 40] = bytes(40)
    cut = bytes(broken[:places[11] + len(members[11]) - 30])
    assert places_of(cut, step) == [(p, k in (4, 11)) for k, p in enumerate(places)]


def test_foreign_records(spark, tmp_path):
    sha = hashlib.sha1(b"body").hexdigest()
    http = b"HTTP/1.0 200\r\n\r\nbody"
    records = [member({"WARC-Type": "response", "WARC-Payload-Digest": f"sha1:{sha}", "X-Page-ID": "7"}, http), member({"WARC-Type": "warcinfo", "Content-Length": "x"}, b"a: b"),
               member({"WARC-Type": "response", "Content-Length": len(http), "X-Page-ID": "page one", "WARC-Payload-Digest": "md5:abc"}, http), member({}, b""),
               member({"WARC-Type": "revisit", "WARC-Refers-To": "<urn:other>", "X-Page-ID": "9", "WARC-Payload-Digest": "sha1:?"}, b""), member({"WARC-Type": "response"}, http)[:-9]]
    (tmp_path / "foreign.warc.gz").write_bytes(b"".join(records))
    files = spark.createDataFrame([(f"file://{tmp_path}/foreign.warc.gz", sum(map(len, records)))], "path string, size bigint")
    rows = sorted(warc.read_warc(files, range_bytes=64).collect(), key=lambda r: r.offset)
    assert [(r.record_type, r.page_id, r.payload_digest, r.payload and bytes(r.payload)) for r in rows] == [
        ("response", 7, sha, b"body"), ("warcinfo", None, None, None), ("response", None, None, b"body"), (None, None, None, None), ("revisit", 9, None, None), ("damaged", None, None, None)]
    assert got(warc.archive_index(files)) == sorted([(7, 4, sha, "response", None), (None, 4, sha, "response", None), (9, None, None, "revisit", None)], key=str)


@pytest.mark.parametrize("value,digest", [("sha1:" + 32 * "A", 40 * "0"), ("SHA-1:" + 40 * "F", 40 * "f"), ("sha1:", None), ("sha1:xyz", None), ("sha256:" + 64 * "0", None), ("", None)])
def test_digest_labels(value, digest):
    assert warc.unpack_digest(value) == digest
