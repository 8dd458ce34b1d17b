"""Operator 8, WARC archives read index first.

Writing: pages are dealt out by page_id and each task appends one gzip member per record to an archive of its own in
the shared folder, giving for each record an index row (path, offset, length, url, digest, ...). A repeated task writes
another file, and the index, once written, names only the files of tasks that counted.

Reading: the index is consulted first; selected rows are sorted by path and offset, near ranges are coalesced into one
read, and records are cut from it. Reading verifies each response's payload against its digest.

Of records with equal payloads the one with the smallest page_id is a response, the others are revisits of it.

Nulls and odd rows: a null html is an empty payload; a null url gives no target header; rows with a null page_id come
after all others and share an empty record name; of repeated rows the first is the response, later ones revisit it;
an empty table gives an empty index and result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempora.llm.common import load, materialize, new_path, shuffle_partitions

ARCHIVE_BYTES = 128 << 20  # an archive is closed and the next begun beyond this
DEAL_BYTES = 128 << 20
GAP, RUN = 64 << 10, 8 << 20  # ranges nearer than GAP are read at once, up to RUN bytes
INDEX = "page_id long, path string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(name: str) -> int | None:
    digits = name[len("<urn:page:") : -1]
    return int(digits) if digits else None


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; refers_to is False for a response, else the page that holds the payload."""
    revisit = refers_to is not False
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record of another length than it says")
    return headers, block.partition(b"\r\n\r\n")[2]


def _write(folder: str, date: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        out = path = None
        at, last = 0, None
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 200):
                    rows = []
                    batch = whole.slice(start, 200)
                    for page_id, url, html, short, least in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "short", "least"))):
                        payload = html.encode()
                        digest = base32_sha1(payload)
                        again, last = last == (page_id, digest), (page_id, digest)
                        refers = False if short or (page_id == least and not again) else least
                        if out is None or at >= archive_bytes:
                            if out is not None:
                                out.close()
                            files, place = fs.FileSystem.from_uri(folder)
                            files.create_dir(place, recursive=True)
                            name = f"{uuid.uuid4().hex}.warc.gz"
                            out, path, at = files.open_output_stream(f"{place}/{name}", compression=None), f"{folder}/{name}", 0
                        member = gzip.compress(record(page_id, url, payload, digest, refers, date), 1, mtime=0)
                        out.write(member)
                        rows.append((page_id, path, at, len(member), url, digest, len(payload), "response" if refers is False else "revisit", None if refers is False else refers))
                        at += len(member)
                    cols = list(zip(*rows))
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, folder: str | None = None) -> DataFrame:
    """Writes a record per page to archives in `folder` (by default a new one in the shared folder); gives their index.

    The index is a written table, kept while the application runs; the archives stay.

    Only digests are grouped and joined; the pages themselves are dealt out once, by page_id. Payloads of fewer than
    min_bytes bytes are all responses.
    """
    spark = pages.sparkSession
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    full = full.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    small = materialize(full.select("page_id", "digest", F.octet_length("html").alias("size")), "digests")
    first = small.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("least"))
    chosen = small.select("page_id", "digest", (F.col("size") < min_bytes).alias("short")).distinct().join(first, "digest", "left")
    n = _deals(spark, small.agg(F.sum("size")).first()[0])
    # one row a page and one plain join key, so that the join keeps the partitioning and pages are dealt out once; pages
    # without an id are dealt by payload, and should a page's id be such a hash, options are told apart by digest anyway
    key = F.coalesce("page_id", F.xxhash64("digest"))
    chosen = chosen.groupBy(key.alias("other_key")).agg(F.collect_list(F.struct("digest", "short", "least")).alias("options"))
    dealt = full.withColumn("key", key).repartition(n, "key").join(chosen.repartition(n, "other_key").hint("shuffle_hash"), F.col("key") == F.col("other_key"))
    option = F.get(F.filter("options", lambda x: x["digest"] == F.col("digest")), F.lit(0))
    rows = dealt.select("page_id", "url", "html", option["short"].alias("short"), option["least"].alias("least"), "digest").sortWithinPartitions("page_id", "digest").drop("digest")
    return materialize(rows.mapInArrow(_write((folder or new_path(spark, "warc")).rstrip("/"), date, archive_bytes), INDEX), "warc-index")


def _deals(spark: SparkSession, size: int | None) -> int:
    """Tasks for so many bytes of payload, of some DEAL_BYTES each."""
    return max(shuffle_partitions(spark), -(-(size or 0) // DEAL_BYTES))


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, run: int = RUN) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) -> (start, length, which): ranges within `gap` of each other read at once, up to `run` bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(ranges):
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= run:
            start, size, which = out[-1]
            which.append(i)
            out[-1] = (start, max(size, offset + length - start), which)
        else:
            out.append((offset, length, [i]))
    return out


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to) of the selected index rows.

    A revisit's payload is null: it stands in the record that it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        opened = handle = None
        try:
            for batch in batches:
                rows = list(zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
                begin = 0
                while begin < len(rows):
                    end = next((i for i in range(begin, len(rows)) if rows[i][0] != rows[begin][0]), len(rows))
                    if rows[begin][0] != opened:
                        if handle is not None:
                            handle.close()
                        files, place = fs.FileSystem.from_uri(rows[begin][0])
                        opened, handle = rows[begin][0], files.open_input_file(place)
                    for start, size, which in coalesced([r[1:] for r in rows[begin:end]]):
                        handle.seek(start)
                        data, found = handle.read(size), []
                        for i in which:
                            _, offset, length = rows[begin + i]
                            headers, payload = parse(gzip.decompress(data[offset - start : offset - start + length]))
                            digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                            if kind == "response" and (base32_sha1(payload) != digest or len(payload) != int(headers["Payload-Length"])):
                                raise ValueError(f"record {headers['WARC-Record-ID']} of {opened} isn't what its digest says")
                            refers = headers.get("WARC-Refers-To")
                            found.append((_page_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), payload if kind == "response" else None, digest, int(headers["Payload-Length"]), kind, _page_id(refers) if refers else None))
                        cols, kinds = list(zip(*found)), [pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["page_id", "url", "payload", "payload_digest", "payload_bytes", "record_type", "refers_to"])
                    begin = end
        finally:
            if handle is not None:
                handle.close()

    n = _deals(index.sparkSession, index.agg(F.sum("length")).first()[0])
    sorted_ = index.select("path", "offset", "length").repartition(n, "path").sortWithinPartitions("path", "offset")
    return sorted_.mapInArrow(run, "page_id long, url string, payload binary, payload_digest string, payload_bytes long, record_type string, refers_to long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(load(spark, sf_dir, "pages"), min_bytes=0)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, lower(sha1(html)) AS hex FROM p),
g AS (SELECT hex, payload_bytes, min(page_id) AS least FROM h GROUP BY hex, payload_bytes)
SELECT h.page_id, h.payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST(('0x' || substr(h.hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5)) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN h.page_id = g.least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN h.page_id = g.least THEN NULL ELSE g.least END AS refers_to
FROM h JOIN g USING (hex, payload_bytes)
"""
