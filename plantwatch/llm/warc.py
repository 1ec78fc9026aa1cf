"""WARC archives: gzip members in files of the shared store, written and read by tasks.

Writing: a task rolls over to a new file when one is large enough; a file appears under its name only when it is whole.
Reading is splittable: the files are cut into byte ranges, and the task of a range looks for the gzip magic, takes a place
as the start of a member if what it decodes to begins with a WARC header and members follow on it without a gap for 64 KB,
and then reads every record that starts inside its range, the last one to its end beyond the range. An archive that is the
payload of a stored (uncompressed) member passes the first check but not the second, since deflate puts a header into
stored bytes every 65,535. Where the second check fails the file is walked from its beginning, so all ranges agree.
"""

import base64
import hashlib
import uuid
import zlib

import pandas as pd
from pyspark.sql import functions as F

from plantwatch.llm.store import open_file, partitions, shared_dir, write_file, written

MAGIC = b"\x1f\x8b\x08"
LEAST = 1000
FILE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
READ = 1 << 18
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


# ---- records --------------------------------------------------------------------------------------------------------

def record_id(page_id, digest):
    """The same id for the same page and payload, whichever task asks."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _one_line(text):
    return " ".join((text or "").split())


def pack_record(page_id, url, payload, digest, refers_to=None, date=DATE):
    """One gzip member. ``digest`` is the payload's SHA-1 in hex, ``refers_to`` the page that holds it if this is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    label = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
              ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", label), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def unpack_record(data):
    """Fields (names in lower case) and block of a decoded record. Without a valid length the block is all up to the blank lines."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    return fields, rest[:int(length)] if length.isascii() and length.isdigit() else rest.removesuffix(b"\r\n\r\n")


def unpack_digest(label):
    """The SHA-1 of a digest label as hex, from base32 or hex; None for other labels."""
    method, _, value = label.partition(":")
    if method.strip().lower().replace("-", "") != "sha1":
        return None
    value = value.strip()
    try:
        raw = bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())
    except ValueError:
        return None
    return raw.hex() if len(raw) == 20 else None


class _Window:
    """Bytes of a file from any place, read as they are needed."""

    def __init__(self, file, size):
        self.file, self.size, self.start, self.data = file, size, 0, b""

    def at(self, place, n):
        """Up to ``n`` bytes at ``place``."""
        if place < self.start or place + n > self.start + len(self.data):
            self.file.seek(place)
            self.start, self.data = place, self.file.read(max(n, READ))
        return self.data[place - self.start:place - self.start + n]


#: What a member is that begins as a record but can't be decoded to its end.
DAMAGED = (None, None)
#: Members that follow on each other for this many bytes aren't inside a stored member.
PROOF = 1 << 16


def _member(window, place):
    """The decoded record that starts at ``place`` and where the next would start; ``DAMAGED``, or None if no record starts there."""
    unpack, parts, at, known, chunk = zlib.decompressobj(31), [], place, b"", b""
    try:
        while not unpack.eof:
            if not chunk:
                chunk = window.at(at, READ if len(known) == 5 else 512)
                at += len(chunk)
            if not chunk:
                break
            # the first bytes alone, so that they are known if later ones are damaged
            out = unpack.decompress(chunk, 5 - len(known))
            chunk = unpack.unconsumed_tail
            parts.append(out)
            if len(known) < 5:
                known += out
                if not b"WARC/".startswith(known):
                    return None
    except zlib.error:
        return DAMAGED if known == b"WARC/" else None
    if known != b"WARC/":
        return None
    return (b"".join(parts), at - len(unpack.unused_data)) if unpack.eof else DAMAGED


def _candidates(window, start, end):
    """The places from ``start`` and before ``end`` that hold the gzip magic."""
    place = start
    while place < end:
        data = window.at(place, min(READ, end + len(MAGIC) - 1 - place))
        found = data.find(MAGIC)
        if found < 0:
            place += max(1, len(data) - len(MAGIC) + 1)
        elif place + found < end:
            place += found
            yield place
            place += 1
        else:
            return


def _walk(window, start, end):
    """(place, record) of the members from ``start``, before ``end``; the record is None where one is damaged.

    What is no record, and what follows a damaged one, is searched for the next.
    """
    place, held = start, None
    while place < end:
        held = _member(window, place) if window.at(place, 3) == MAGIC else None
        if held and held is not DAMAGED:
            yield place, held[0]
            place = held[1]
            continue
        if held is DAMAGED:
            yield place, None
        place = next(_candidates(window, place + 1, end), end)


def first_member(window, start, end):
    """The first place from ``start`` and before ``end`` where a record of the file starts, whole or damaged, or None."""
    if start == 0:
        return next((place for place, _ in _walk(window, 0, end)), None)
    for place in _candidates(window, start, end):
        if not (held := _member(window, place)):
            continue
        at = place
        while held and held is not DAMAGED:
            at = held[1]
            if at >= window.size or at - place >= PROOF:
                return place
            held = _member(window, at) if window.at(at, 3) == MAGIC else None
        return next((p for p, _ in _walk(window, 0, end) if p >= start), None)
    return None


def records_of(file, size, start, end):
    """(place, fields, block) of the records that start in a byte range; fields and block are None for damaged ones."""
    window = _Window(file, size)
    place = first_member(window, start, end)
    if place is not None:
        for place, data in _walk(window, place, end):
            yield place, *(unpack_record(data) if data is not None else (None, None))


# ---- tables ---------------------------------------------------------------------------------------------------------

def write_warc(pages, folder=None, least=LEAST, file_bytes=FILE_BYTES, id_column="page_id", url_column="url", html_column="html"):
    """Write a record for every row; gives the manifest, a row per file: ``path``, ``size`` and ``n_records``.

    Of rows with equal payloads of at least ``least`` bytes the one with the largest page id is written as response, all
    others as revisits of it; rows that repeat that page are responses too. Rows with a null id can only be revisits, or
    responses if all their equals have null ids. A null html is an empty payload, a null url has no field.
    The files of a task have a name of their own for each attempt, so a late attempt replaces nothing.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # only payloads that occur more than once meet the join
    holders = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(holders.select("digest", "holder"), "digest", "left")
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    rows = rows.select(F.spark_partition_id().alias("shard"), "page_id", "url", "payload", "digest", refers_to.alias("refers_to"))

    def write(batches):
        shard, number, held, size, attempt = 0, 0, [], 0, uuid.uuid4().hex
        for batch in batches:
            for shard, page, url, data, digest, holder in zip(*[batch[c] for c in ("shard", "page_id", "url", "payload", "digest", "refers_to")]):
                page, holder = (None if pd.isna(x) else int(x) for x in (page, holder))
                held.append(pack_record(page, url, bytes(data), digest, holder))
                size += len(held[-1])
                if size >= file_bytes:
                    yield pd.DataFrame([(write_file(folder, f"pages-{shard:06d}-{number:05d}-{attempt}.warc.gz", held), size, len(held))], columns=["path", "size", "n_records"])
                    number, held, size = number + 1, [], 0
        if held:
            yield pd.DataFrame([(write_file(folder, f"pages-{shard:06d}-{number:05d}-{attempt}.warc.gz", held), size, len(held))], columns=["path", "size", "n_records"])

    rows = rows.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "refers_to")})  # whole numbers that may be null
    return written(rows.mapInPandas(write, "path string, size bigint, n_records bigint"), "warc-manifest", spark)


def read_warc(files, range_bytes=RANGE_BYTES):
    """A row for every record of the files (``path``, ``size``), one task for some byte ranges of ``range_bytes``.

    Columns: ``path``, ``offset``, ``record_type``, ``record_id``, ``page_id``, ``url``, ``payload_digest`` (of the header, hex),
    ``refers_to_id``, ``payload`` (the HTTP body; null for all but responses). Fields that a record lacks, ids that are no
    numbers and digests of another kind are null. A damaged or truncated member is a row of type ``damaged`` at its offset.
    """
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes)))
    ranges = files.select("path", "size", starts.alias("start")).repartition(max(partitions(files), 8), "path", "start")

    def read(batches):
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["start"]):
                held, load = [], 0
                with open_file(path) as file:
                    for place, fields, block in records_of(file, size, start, min(size, start + range_bytes)):
                        if fields is None:
                            held.append((path, place, "damaged", *6 * [None]))
                            continue
                        kind, digest = fields.get("warc-type"), unpack_digest(fields.get("warc-payload-digest", ""))
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        held.append((path, place, kind, fields.get("warc-record-id"), fields.get("x-page-id"), fields.get("warc-target-uri"), digest, fields.get("warc-refers-to"), payload))
                        load += len(block)
                        if load >= 8 << 20:
                            yield pd.DataFrame(held, columns=names)
                            held, load = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    names = ["path", "offset", "record_type", "record_id", "page_id", "url", "payload_digest", "refers_to_id", "payload"]
    schema = "path string, offset bigint, record_type string, record_id string, page_id string, url string, payload_digest string, refers_to_id string, payload binary"
    return ranges.mapInPandas(read, schema).withColumn("page_id", F.col("page_id").try_cast("bigint"))


def archive_index(files, **settings):
    """Per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``, from the archives alone.

    Lengths and digests are those of the payloads read; a revisit has those of the record that it refers to, or nulls if
    the archives don't hold it. Records of other types, and damaged ones, are left out; ``read_warc`` has them.
    """
    payload = F.coalesce("payload", F.lit(b""))
    rows = read_warc(files, **settings).select("record_type", "record_id", "refers_to_id", "page_id", F.when(F.col("record_type") == "response", F.octet_length(payload)).cast("bigint").alias("payload_bytes"),
                                               F.when(F.col("record_type") == "response", F.sha1(payload)).alias("payload_digest"))
    rows = written(rows, "warc-records", files.sparkSession)
    responses, revisits = rows.filter("record_type = 'response'"), rows.filter("record_type = 'revisit'")
    held = responses.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to_id"])
    revisits = revisits.select("page_id", "record_type", "refers_to_id").join(held, "refers_to_id", "left")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).select(*out).unionByName(revisits.select(*out))


def round_trip(pages, **settings):
    """Write the archives and read them back: a row per page; other columns of the input are left out, whatever their names.

    Repeated rows are written and come back as often as they occur; an empty table gives no file and an empty result.
    Very long pages are one record each, written and read whole.
    """
    return archive_index(write_warc(pages, **settings))


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id THEN holder END AS refers_to
FROM p LEFT JOIN h USING (payload_digest)
""".strip()
