"""WARC archives, index first.

Every row becomes one record in its own gzip member, so a record can be read alone.  While
an archive is written an index row is made for each record: file, offset, length, URL, digest,
type.  Reading starts from the index: selected rows are grouped by file, sorted by offset, and
ranges with small gaps are fetched together.

Equal payloads of at least `least` bytes are stored once, in the record of the largest id; the
others become revisit records without a payload.  Files get a new name in every attempt and
count only if the index names them, so a lost executor leaves at worst an unused file.

Rows of one payload meet by its digest; the rows of a frequent payload are dealt to many tasks.

Defined results: a null payload is empty; a null url is an empty header value; a row without id
revisits the response of its payload, and is a response where no row of that payload has an id;
rows with the same id and payload are each a record (the largest id is chosen, and of rows that share
it every one is a response); an empty table gives an empty index; columns besides id, url and payload
are not read.  Ids are taken as long.  A record's id is a UUID made of page id and digest (a revisit's
also of its place), its date is `date`, the same for all records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import salted_join, scratch, table

INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
#: Ranges of one file that are this near are read together, up to so many bytes at a time.
GAP, MOST = 64 << 10, 8 << 20
#: Date of records for which none is told.
DATE = "1970-01-01T00:00:00Z"


def open_fs(path: str):
    """(file system, path in it) for a path with or without a scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Names of records are made below this one.
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:kindred:warc")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, place: str = "", date: str = DATE) -> bytes:
    """One gzip member."""
    name = lambda *of: f"<urn:uuid:{uuid.uuid5(NAMES, '/'.join(map(str, of)))}>"
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id, digest, place) if revisit else name(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.partition(": ")[::2] for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archive(pages: DataFrame, folder: str, *, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE) -> DataFrame:
    """Write all rows as WARC files below folder; returns the index, itself stored there."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("key", F.unhex(F.sha1("payload")))
    heads = keyed.where(F.octet_length("payload") >= least).groupBy("key").agg(F.max("page_id").alias("head"))
    dealt = salted_join(keyed, heads, "key", "page_id", "left")
    dealt = dealt.select("page_id", "url", "payload", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                cols: list[list] = [[] for _ in range(8)]
                for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    digest = base32_sha1(body)
                    member = record(page_id, url, body, digest, refers_to, f"{name}:{at}", date)
                    if out is None:
                        fs, path = open_fs(name)
                        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = fs.open_output_stream(path, compression=None)
                    out.write(member)
                    for c, v in zip(cols, (name, at, len(member), page_id, url, digest, "response" if refers_to is None else "revisit", refers_to), strict=True):
                        c.append(v)
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def ranges(found: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int]]:
    """Sorted (offset, length) made into fewer (offset, end) reads."""
    out: list[list[int]] = []
    for a, n in found:
        if out and a - out[-1][1] <= gap and max(a + n, out[-1][1]) - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def read_records(index: DataFrame) -> DataFrame:
    """The selected records: page_id, record_type, payload (null for a revisit), digest, payload_bytes, refers_to."""
    schema = "page_id long, url string, record_type string, payload binary, digest string, payload_bytes long, refers_to long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(name: str, wanted: list) -> pa.RecordBatch:
            fs, path = open_fs(name)
            wanted.sort()
            rows: list[list] = [[] for _ in range(7)]
            with fs.open_input_file(path) as f:
                k = 0
                for a, z in ranges([w[:2] for w in wanted]):
                    block = f.read_at(z - a, a)
                    while k < len(wanted) and wanted[k][0] < z:
                        off, n, page_id, kind, digest = wanted[k]
                        head, body = parse(block[off - a : off - a + n])
                        if head["WARC-Payload-Digest"] != f"sha1:{digest}" or kind == "response" and base32_sha1(body) != digest:
                            raise ValueError(f"{name} at {off}: the digest is not the index's")
                        to = head.get("X-Refers-To-Page")
                        for c, v in zip(rows, (page_id, head["WARC-Target-URI"], head["WARC-Type"], body if kind == "response" else None, digest, int(head["X-Payload-Length"]), int(to) if to else None), strict=True):
                            c.append(v)
                        k += 1
            kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        now, wanted = None, []
        for b in batches:
            for name, off, n, page_id, kind, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if name != now or len(wanted) >= 2000:
                    if wanted:
                        yield flush(now, wanted)
                    now, wanted = name, []
                wanted.append((off, n, page_id, kind, digest))
        if wanted:
            yield flush(now, wanted)

    # offsets of a file are dealt in runs, not all of a large file to one task
    run = (F.col("offset") / F.lit(16 << 20)).cast("long")
    chosen = index.select("file", "offset", "length", "page_id", "record_type", "digest")
    return chosen.repartition("file", run).sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    index = write_archive(table(spark, sf_dir, "pages"), folder)
    return read_records(index).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
