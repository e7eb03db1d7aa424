"""WARC archives: written with revisits, read back, and indexed by an external merge of sorted runs."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_skewed, parts_for, sha256_hex, shared_dir, small_batches, stored

#: Smaller payloads are never replaced by a revisit.
REVISIT_BYTES = 100
#: Digests of repeated payloads that may be broadcast.
BROADCAST_ROWS = 50_000
#: Bytes after which an archive file ends, and the records it has at most.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 100_000
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 20
#: 2020-01-01: a page without a capture time was captured page_id seconds later.
EPOCH = 1_577_836_800
CRLF = "\r\n"
#: What a URL must not hold.
BLANK = re.compile(r"[\x00-\x20\x7f]")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RUN = "page_id string, url_key string, captured string, record_type string, payload_digest string, payload_bytes long, refers_to string, archive string, offset long, length long"


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) with payload, digest, n_bytes and refers_to: the smallest id with an equal payload.

    Digests combine before they are shuffled. Those of repeated payloads are few beside the pages and
    are broadcast up to a bound; beyond it only pages are shuffled whose digest isn't a frequent one.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", sha256_hex(F.col("payload").cast("binary")))
    same = p.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    same = stored(same.where("n > 1"), "payloads")
    n, rows = same.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    firsts = same.select("digest", "first_id")
    if n <= BROADCAST_ROWS:
        p = p.join(F.broadcast(firsts), "digest", "left")
    else:
        p = join_skewed(p, firsts, "digest", hot_keys(same, "digest", "n", rows))
    other = F.col("page_id").isNull() | (F.col("page_id") > F.col("first_id"))
    return p.withColumn("refers_to", F.when(F.col("first_id").isNotNull() & other, F.col("first_id"))).drop("first_id")


def record_id(page_id: object) -> str:
    return "<urn:page:" + ("" if page_id is None else quote(str(page_id), safe="")) + ">"


def record_of(page_id: object, captured: str, url: str, payload: bytes, digest: str, n_bytes: int, refers_to: object) -> bytes:
    """One WARC record of a page: a response, or a revisit without the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {n_bytes}{CRLF}{CRLF}".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {BLANK.sub('', url)}", f"WARC-Date: {captured}",
        f"WARC-Payload-Digest: sha256:{digest}", *([f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return (CRLF.join(head) + CRLF * 2).encode() + block + (CRLF * 2).encode()


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """WARC files under path, each record a gzip member of its own: (archive, records, bytes) of those that count.

    An archive's name is new for each attempt of a task, and only what a finished task returned is
    in the stored list: files that a lost executor left behind are read by nobody.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fs, folder = pa_fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out, name, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["archive", "records", "bytes"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name, n, size = f"{TaskContext.get().partitionId():06}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress(record_of(*row), 6, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= ARCHIVE_BYTES or n >= ARCHIVE_RECORDS:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    p = with_revisits(pages)
    captured = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id").try_cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.when(F.col("refers_to").isNull(), F.col("payload").cast("binary"))
    return p.select("page_id", captured.alias("captured"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), "digest", "n_bytes", "refers_to").mapInArrow(run, "archive string, records long, bytes long")


def url_key(url: str) -> str:
    """The host's labels reversed, then path and query: captures of one site sort together."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + ("?" + parts.query.lower() if parts.query else "")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record; a damaged one raises."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {record[:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("a record is cut short")
    return headers, rest[:size]


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member of a stream, one held at a time."""
    at, held, unzip, out = 0, b"", zlib.decompressobj(31), []
    length = 0
    while data := held or stream.read(READ_BYTES):
        held = b""
        out.append(unzip.decompress(data))
        length += len(data) - len(unzip.unused_data)
        if unzip.eof:
            yield at, length, b"".join(out)
            held, at, length, out, unzip = unzip.unused_data, at + length, 0, [], zlib.decompressobj(31)
    if length:
        raise ValueError("an archive is cut short")


def fetch(path: str, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """(headers, block) of the record at a place that the index tells, without reading the rest of its archive."""
    fs, folder = pa_fs.FileSystem.from_uri(path)
    with fs.open_input_file(f"{folder}/{archive}") as f:
        return parse(gzip.decompress(f.read_at(length, offset)))


def run_of(stream, name: str) -> list[tuple]:
    """One archive's index, sorted by URL key, time and page: a run for the merge. Payloads are held against their digests."""
    page = lambda x: unquote(x.removeprefix("<urn:page:").removesuffix(">"))
    out = []
    for offset, length, content in members(stream):
        headers, block = parse(content)
        http, _, payload = block.partition(b"\r\n\r\n")
        n = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = headers["warc-payload-digest"].removeprefix("sha256:")
        kind = headers["warc-type"]
        if kind == "response" and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
        refers = headers.get("warc-refers-to")
        out.append((page(headers["warc-record-id"]), url_key(headers["warc-target-uri"]), headers["warc-date"], kind, digest, n, page(refers) if refers else None, name, offset, length))
    return sorted(out, key=order_of)


def order_of(row: tuple) -> tuple:
    """URL key, time, page (shorter ids first), and where the record is."""
    return row[1], row[2], len(row[0]), row[0], *row[7:9]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def read_runs(archives: DataFrame, path: str) -> DataFrame:
    """The sorted index run of each of archives(archive) under path; a task reads one record after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        fs, folder = pa_fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    rows = run_of(f, name)
                for a in range(0, len(rows), 4096):
                    yield _batch(rows[a : a + 4096], RUN)

    spark = archives.sparkSession
    parts = parts_for(archives.count(), 4, spark)
    return archives.select("archive").repartition(parts, "archive").mapInArrow(run, RUN)


class LoserTree:
    """k-way merge: inner nodes keep the losers, so each step replays one path of comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(k, 1)
        for r in range(k):
            self.play(r, True)

    def head(self, r: int) -> tuple:
        return (1,) if self.at[r] >= len(self.runs[r]) else (0, order_of(self.runs[r][self.at[r]]), r)

    def play(self, winner: int, filling: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            loser = self.tree[node]
            if filling and loser < 0:
                self.tree[node] = winner
                return
            if self.head(loser) < self.head(winner):
                self.tree[node], winner = winner, loser
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        for _ in range(sum(map(len, self.runs))):
            r = self.tree[0]
            yield self.runs[r][self.at[r]]
            self.at[r] += 1
            self.play(r)


def merged(runs: DataFrame, n: int) -> DataFrame:
    """The runs as one order by URL key, time and page: index_part, then index_row.

    Parts are ranges of that order, so a URL or host with very many captures spreads over several. In
    each part what it has of every run is merged by a loser tree.
    """
    schema = RUN + ", index_part int, index_row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                part.setdefault(row[7], []).append(row)
        for rows in part.values():  # what a shuffle brings of a run may have lost its order
            if any(order_of(a) > order_of(b) for a, b in zip(rows, rows[1:])):
                rows.sort(key=order_of)
        me, out = TaskContext.get().partitionId(), []
        for i, row in enumerate(LoserTree([part[k] for k in sorted(part)]) if part else ()):
            out.append((*row, me, i))
            if len(out) == 4096:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    parts = parts_for(n, 100_000, runs.sparkSession)
    ranged = runs.repartitionByRange(parts, "url_key", "captured", F.length("page_id"), "page_id", "archive", "offset")
    return ranged.mapInArrow(run, schema)


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages(page_id, url, html) as WARC files under path, read them back, and return the index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, archive, offset,
    length, index_part, index_row), one row a page; archive, offset and length are where fetch() finds
    the record. Payloads are the html in UTF-8, a null as empty. Of equal payloads of at least
    REVISIT_BYTES the one with the smallest id is the response and others revisit it; rows that repeat
    that id are responses too, and a null id revisits. Null URLs are empty. Control characters and
    blanks in a URL are left out. Other columns are not read; no pages give no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = stored(write_archives(pages, path), "archives")
    runs = stored(read_runs(archives, path), "runs")
    kind = dict(pages.dtypes)["page_id"]
    out = merged(runs, archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0])
    for c in ("page_id", "refers_to"):
        out = out.withColumn(c, F.when(F.col(c) != "", F.col(c)).cast(kind))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "offset", "length", "index_part", "index_row")


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload) as payload_bytes, sha256(payload) as payload_digest from p),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then first_id end as refers_to
from f
"""
