"""WARC archives with a two-level capture index.

Pages are written as gzip members, one a record, into archives below the shared
folder. The capture index has a line for each record, sorted by the URL with
its host reversed; lines are cut into blocks that are compressed each on their
own, and a sparse directory holds a line for each block: first key, file,
offset, length. Directory lines are kept beside each index file, and one line
a file with its first key. A lookup finds the file, the block and the line by
bisection, and reads the record's byte range.

Files are named by partition and a random part, and only those that a finished
task lists count, so a task that runs twice does no harm.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import Fence, scope, scratch, slices

#: Payloads below so many bytes are always responses.
LEAST = 100
#: Lines of a block; bytes of an archive file; adjoining records are read by one range of up to so many bytes.
BLOCK_LINES, FILE_BYTES, RANGE_BYTES = 512, 256 << 20, 4 << 20
#: A fixed date, so that equal pages give equal archives.
DATE = "1970-01-01T00:00:00Z"
SEP = "\x1f"


def store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def one_line(url: str | None) -> str:
    """The URL with control characters and spaces written as %XX."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def surt(url: str | None) -> str:
    """The URL with its host reversed by labels: ``http://a.b.com:80/x`` gives ``com,b,a:80)/x``."""
    rest = re.sub(r"^.*?://", "", one_line(url), count=1)
    host, tail = re.match(r"(?s)([^/?#]*)(.*)", rest).groups()
    name, colon, port = host.lower().rpartition("@")[2].partition(":")
    return ",".join(reversed(name.split("."))) + colon + port + ")" + (tail or "/")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member. A revisit has no payload; its digest is that of the payload it stands for."""
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
        "",
        "",
    ]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", 6, mtime=0)


@dataclass
class Record:
    kind: str
    page_id: int | None
    uri: str
    digest: str
    refers_to: int | None
    length: int
    payload: bytes


def _page(value: str | None) -> int | None:
    return int(m[1]) if value and (m := re.fullmatch(r"<urn:page:(-?\d+)>", value)) else None


def parse(member: bytes) -> Record:
    """The record of one decompressed member."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    return Record(fields["WARC-Type"], _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), _page(fields.get("WARC-Refers-To")), int(fields["WARC-Payload-Length"]), payload)


CAPTURES = "key string, page_id long, file string, start long, length long"
DIRECTORY = "first_key string, first_page long, last_key string, last_page long, file string, start long, length long, n long"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every page and returns its capture (key, page_id, file, start, length).

    ``pages``: page_id, url, payload binary, digest, refers_to (null for a response), revisit.
    """

    def run(batches):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        out = name = None
        size = 0
        for b in slices(batches, 128):
            rows = []
            for page_id, url, payload, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)):
                data = record(page_id, url, payload, digest, refers_to, revisit)
                if out is None or size + len(data) > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out, size = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                out.write(data)
                rows.append((surt(url), page_id, name, size, len(data)))
                size += len(data)
            yield _batch(rows, CAPTURES)
        if out is not None:
            out.close()

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, CAPTURES)


_KINDS = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sorts captures by (key, page_id), writes blocks of ``lines`` lines and returns the sparse directory."""

    def run(batches):
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.cdx"
        out, at, held = None, 0, []

        lines_of: list[tuple] = []

        def block(rows):
            nonlocal at
            data = zlib.compress("\n".join(SEP.join("" if x is None else str(x) for x in r) for r in rows).encode(), 6)
            out.write(data)
            at += len(data)
            lines_of.append((rows[0][0], rows[0][1], rows[-1][0], rows[-1][1], name, at - len(data), len(data), len(rows)))
            return lines_of[-1]

        for b in slices(batches):
            held += zip(*(c.to_pylist() for c in b.columns))
            if out is None and held:
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            done = []
            while len(held) > lines:
                n = lines  # lines of one page stay in one block
                while n < len(held) and held[n][:2] == held[n - 1][:2]:
                    n += 1
                if n == len(held):
                    break
                done.append(block(held[:n]))
                held = held[n:]
            if done:
                yield _batch(done, DIRECTORY)
        if held:
            yield _batch([block(held)], DIRECTORY)
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as beside:
                beside.write(zlib.compress("\n".join(SEP.join("" if x is None else str(x) for x in (*r[:2], *r[5:7])) for r in lines_of).encode(), 6))

    # Sorted by key and page: equal URLs, however many, are spread over the ranges.
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, DIRECTORY)


def read_range(folder: str, file: str, start: int, length: int) -> bytes:
    fs, root = store(folder)
    with fs.open_input_file(f"{root}/{file}") as f:
        return f.read_at(length, start)


def read_block(data: bytes) -> list[tuple]:
    """The block's lines as captures."""
    out = []
    for line in zlib.decompress(data).decode().split("\n"):
        key, page_id, file, start, length = line.rsplit(SEP, 4)
        out.append((key, int(page_id) if page_id else None, file, int(start), int(length)))
    return out


class Index:
    """Lookups of single URLs over a directory held in memory, sorted by first key."""

    def __init__(self, directory: list[tuple], index_folder: str, archive_folder: str):
        self.blocks = sorted(directory, key=lambda d: (d[0], d[1] is not None, d[1] or 0))
        self.index_folder, self.archive_folder = index_folder, archive_folder

    def captures(self, url: str) -> list[tuple]:
        """All captures of the URL: bisect the directory, then the blocks that may hold the key."""
        key = surt(url)
        firsts = [b[0] for b in self.blocks]
        at = max(0, bisect_left(firsts, key) - 1)
        found = []
        for b in self.blocks[at : bisect_right(firsts, key)]:
            if b[2] >= key:
                rows = read_block(read_range(self.index_folder, b[4], b[5], b[6]))
                keys = [r[0] for r in rows]
                found += rows[bisect_left(keys, key) : bisect_right(keys, key)]
        return found

    def fetch(self, url: str) -> list[Record]:
        return [parse(gzip.decompress(read_range(self.archive_folder, c[2], c[3], c[4]))) for c in self.captures(url)]


def place(key: str, page_id: int | None) -> tuple:
    """What captures are ordered by; a null page_id comes first."""
    return key, page_id is not None, page_id or 0


def read_directory(data: bytes) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Places at which an index file's blocks begin, and their (start, length)."""
    lines = [line.rsplit(SEP, 3) for line in zlib.decompress(data).decode().split("\n")]
    return [place(key, int(page) if page else None) for key, page, *_ in lines], [(int(a), int(n)) for *_, a, n in lines]


def look_up(queries: DataFrame, directory: DataFrame, index_folder: str) -> DataFrame:
    """Captures of every (key, page_id) of ``queries``.

    A task holds the first line of each index file, as many as the index had
    partitions, and finds the file by bisection, then the block in the file's
    directory, then the lines in the block. Queries are sorted, so each
    directory and each block is read about once.
    """
    first = F.struct("first_key", F.col("first_page").isNotNull().alias("there"), F.coalesce("first_page", F.lit(0)).alias("page"))
    files = sorted((tuple(r["first"]), r["file"]) for r in directory.groupBy("file").agg(F.min(first).alias("first")).collect())
    begins, names = [f[0] for f in files], [f[1] for f in files]

    def run(batches):
        fs, root = store(index_folder)
        now, blocks, spans, where, rows, keys = None, [], [], None, [], []
        for b in slices(batches):
            out = []
            for key, page_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                want = place(key, page_id)
                at = bisect_right(begins, want) - 1
                if at < 0:
                    continue
                if at != now:
                    with fs.open_input_stream(f"{root}/{names[at]}.dir", compression=None) as f:
                        now, (blocks, spans) = at, read_directory(f.read())
                span = spans[bisect_right(blocks, want) - 1]
                if (at, span) != where:
                    where, rows = (at, span), read_block(read_range(index_folder, names[at], *span))
                    keys = [place(*r[:2]) for r in rows]
                out += rows[bisect_left(keys, want) : bisect_right(keys, want)]
            yield _batch(out, CAPTURES)

    return queries.select("key", "page_id").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, CAPTURES)


READ = "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_captures(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of captures, read file by file in order of place; adjoining records share a range read.

    A response's digest and bytes are those of the payload that was read, a
    revisit's those of its header. Without ``payloads`` that column is null.
    """

    def run(batches):
        def read(span):
            file, start, end, parts = span
            data = read_range(folder, file, start, end - start)
            return [parse(gzip.decompress(data[a - start : a - start + n])) for a, n in parts]

        def emit(records):
            rows = [(r.page_id, r.kind, hashlib.sha256(r.payload).hexdigest() if r.kind == "response" else r.digest, len(r.payload) if r.kind == "response" else r.length, r.refers_to, r.payload if payloads and r.kind == "response" else None) for r in records]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in READ.split(", ")])

        span = None
        for b in slices(batches):
            for file, start, length in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if span and span[0] == file and span[2] == start and start + length - span[1] <= RANGE_BYTES:
                    span = (file, span[1], start + length, [*span[3], (start, length)])
                else:
                    if span:
                        yield emit(read(span))
                    span = (file, start, start + length, [(start, length)])
        if span:
            yield emit(read(span))

    return captures.repartitionByRange("file", "start").sortWithinPartitions("file", "start").mapInArrow(run, READ)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit: of equal payloads one row with the smallest page_id is the response, the others are revisits.

    Only digests that occur more than once are joined back. Of several such
    rows, that with the smallest url is the response; of rows that repeat all
    three, one is. A null page_id is the largest.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    size = rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("times"))
    groups = size.groupBy(F.col("digest").alias("same")).agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "times")).alias("first"), F.sum("times").alias("n"))
    several = Fence(groups.filter("n > 1").select("same", "first.page_id", "first.url", "first.times").toDF("same", "first", "first_url", "times"), small=True).df
    joined = rows.join(several, rows["digest"] == several["same"], "left")
    is_first = F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url"))
    again = F.col("same").isNotNull() & ~is_first
    shown = lambda df, revisit: df.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    if several.filter("times > 1").isEmpty():
        return shown(joined, again)
    repeated = is_first & (F.col("times") > 1)
    # Such rows are the same in all that is kept: one of them is written as many times as there are.
    one = joined.filter(repeated).dropDuplicates(["digest"])
    each = one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return shown(joined.filter(~F.coalesce(repeated, F.lit(False))), again).unionByName(shown(each, F.col("copy") > 1))


def archive(pages: DataFrame) -> tuple[DataFrame, DataFrame, str, str]:
    """Writes archives and index; returns captures, directory and the two folders."""
    spark = pages.sparkSession
    archives, index = scratch(spark, "warc"), scratch(spark, "cdx")
    captures = Fence(write_archives(with_revisits(pages), archives)).df
    directory = Fence(write_index(captures, index), small=True).df
    return captures, directory, archives, index


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for each page, read back by way of the index.

    A null html is an empty payload. Payloads under 100 bytes are responses,
    equal ones too; of longer equal ones, in rows that repeat as well, one is.
    A response's bytes and digest are computed from what is read, a revisit's
    are those that its record names of the payload it stands for. Null urls
    have the key ``)/``. An empty table gives no rows. Other columns are
    ignored.
    """
    with scope() as keep:
        captures, directory, archives, index = archive(pages)
        found = look_up(captures.select("key", "page_id").distinct(), directory, index)
        back = Fence(read_captures(found, archives, payloads=False).drop("payload"))
        keep(back)
    return back.df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
