"""WARC: archives of web pages, a two-level capture index over them, and reads through it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pcframe.llm.common import as_bytes, attempt_name, cut, fresh_dir, open_fs, release, small_batches

#: Payloads shorter than this are never replaced by a revisit.
LEAST_REVISIT = 100
#: Lines of a compressed index block.
BLOCK_LINES = 1_000
#: Payloads that are stored more than once: broadcast (a digest and an id each) up to so many.
BROADCAST_DIGESTS = 200_000
#: Bytes of archives that one task reads back.
READ_BYTES = 64_000_000
#: Bytes of payloads that a task gives back to Spark at once (a longer one goes alone).
REPLY_BYTES = 4_000_000
#: Rows that Spark's Parquet reader holds at once; its own 4,096 pages would be many MB a task.
READER_ROWS, _SPARKS_ROWS = "256", "4096"
_DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """Reversed-host sort key: 'http://m.b.org:80/x?q' -> 'org,b,m:80)/x?q', lower-cased host;
    scheme, user and fragment left out. Null or hostless: what there is, behind ')'."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"#.*$", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?]*)", 1), r"^.*@", "")
    host = F.lower(F.regexp_extract(authority, r"^([^:]*)", 1))
    port = F.regexp_extract(authority, r"(:\d+)$", 1)
    path = F.regexp_extract(rest, r"^[^/?]*([\s\S]*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(path == "", "/").otherwise(path))


def _record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.0 record; a revisit has the HTTP header block only, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {target}", f"WARC-Date: {_DATE}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{sha}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = http if refers_to is not None else http + payload
    return ("\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """Of a record: its headers (lower-case names), HTTP headers and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.0":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("truncated WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["http"] = {k.lower(): v for k, _, v in (line.partition(": ") for line in http.decode("latin-1").split("\r\n")[1:])}
    fields["payload"] = payload
    return fields


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write each partition's records, each a gzip member of its own, to an archive in folder;
    returns the captures: url_key, page_id, file, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name = attempt_name("capture") + ".warc.gz"
        out, at = None, 0
        for b in batches:
            out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
            offsets, lengths = [], []
            for page, url, html, digest, refers in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), as_bytes(b.column("html")), b.column("payload_digest").to_pylist(), b.column("refers_to").to_pylist()):
                member = gzip.compress(_record(page, url or "", html, digest, refers), 6, mtime=0)
                out.write(member)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays([b.column("url_key"), b.column("page_id"), pa.array([name] * len(b)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["url_key", "page_id", "file", "offset", "length"])
        if out:
            out.close()
        release()

    return pages.mapInArrow(run, "url_key string, page_id long, file string, offset long, length long")


def _order(key: str, page: int | None) -> tuple:
    """The index's order, Spark's as well: by key, then null page ids before all others."""
    return key, page is not None, page or 0


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Captures sorted by url_key, then page_id, in compressed blocks of lines in files of folder;
    returns the sparse directory: of each block its first and last key and page, file, offset, length."""
    by = captures.repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name = attempt_name("index") + ".cdx.gz"
        out, at, lines, rows = None, 0, [], []

        def block() -> None:
            nonlocal at, lines
            data = gzip.compress("".join(json.dumps(x) + "\n" for x in lines).encode(), 6, mtime=0)
            out.write(data)
            rows.append((*lines[0][:2], *lines[-1][:2], name, at, len(data)))
            at, lines = at + len(data), []

        for b in batches:
            out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
            for line in zip(*(c.to_pylist() for c in b.columns)):
                lines.append(line)
                if len(lines) >= BLOCK_LINES:
                    block()
        if lines:
            block()
        if out:
            out.close()
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["first", "first_page", "last", "last_page", "file", "offset", "length"])
        release()

    return by.mapInArrow(run, "first string, first_page long, last string, last_page long, file string, offset long, length long")


class Reader:
    """Range reads from the files of one folder, the last few of which stay open."""

    def __init__(self, folder: str):
        self.fs, self.top = open_fs(folder)
        self.files: dict[str, pa.NativeFile] = {}

    def member(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.files:
            if len(self.files) >= 16:
                self.files.pop(next(iter(self.files))).close()
            self.files[file] = self.fs.open_input_file(f"{self.top}/{file}")
        f = self.files[file]
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


class Directory:
    """The sparse directory (a Parquet table), opened once by a task; slices of it are read."""

    def __init__(self, path: str):
        import pyarrow.dataset as ds

        fs, top = open_fs(path)
        self.table = ds.dataset(top, filesystem=fs, format="parquet")

    def slice(self, low: tuple, high: tuple) -> list[tuple]:
        """(order of its first line, of its last line, file, offset, length) of the blocks that
        (key, page) pairs from low to high can be in, sorted."""
        import pyarrow.dataset as ds

        f = ds.field
        after, before = f("last") > low[0], f("first") < high[0]
        same_low, same_high = f("last") == low[0], f("first") == high[0]
        if low[1] is not None:
            same_low &= f("last_page").is_null() | (f("last_page") >= low[1])
        if high[1] is not None:
            same_high &= f("first_page").is_null() | (f("first_page") <= high[1])
        found = self.table.to_table(filter=(after | same_low) & (before | same_high))
        rows = zip(*(found.column(c).to_pylist() for c in ("first", "first_page", "last", "last_page", "file", "offset", "length")))
        return sorted((_order(a, p), _order(b, q), *rest) for a, p, b, q, *rest in rows)


def lookup(keys: DataFrame, directory: str, folder: str) -> DataFrame:
    """The captures of (url_key, page_id) pairs: sorted requests, a binary search in the directory
    for each, range reads of the blocks it names, and a binary search in the block. Both searches
    go by key and page, so that many captures of one URL cost no more than as many of others."""
    by = keys.select("url_key", "page_id").distinct().repartitionByRange("url_key", "page_id").sortWithinPartitions("url_key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, places, block, lines = Reader(folder), None, None, []
        for b in batches:
            wanted = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            if not wanted:
                continue
            places = places or Directory(directory)
            blocks = places.slice(wanted[0], wanted[-1])
            lasts, found = [x[1] for x in blocks], []
            for target in (_order(*x) for x in wanted):
                i = bisect_left(lasts, target)
                while i < len(blocks) and blocks[i][0] <= target:
                    if block != blocks[i]:
                        block = blocks[i]
                        lines = [tuple(json.loads(x)) for x in reader.member(*block[2:]).decode().splitlines()]
                    j = bisect_left(lines, target, key=lambda x: _order(x[0], x[1]))
                    while j < len(lines) and _order(lines[j][0], lines[j][1]) == target:
                        found.append(lines[j])
                        j += 1
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in ((1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.int64()))], ["page_id", "file", "offset", "length"])
        release()

    return by.mapInArrow(run, "page_id long, file string, offset long, length long")


def read_records(places: DataFrame, folder: str) -> DataFrame:
    """Records at (file, offset, length), read in file order: page_id, payload_bytes,
    payload_digest, record_type, refers_to, html (a revisit's is null). The places are few bytes
    each; as many tasks read as the records' own bytes ask for."""
    places = cut(places, "places")
    tasks = -(-int(places.agg(F.sum("length")).first()[0] or 1) // READ_BYTES)
    tasks = max(tasks, places.sparkSession.sparkContext.defaultParallelism)
    by = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader(folder), 0
        cols: list[list] = [[], [], [], [], [], []]

        def reply() -> pa.RecordBatch:
            nonlocal cols, held
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            rows = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])
            cols, held = [[], [], [], [], [], []], 0
            return rows

        # a batch of places is few bytes, the records that it names are as many as they are
        for b in batches:
            for page, file, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                r = parse(reader.member(file, offset, length))
                digest = base64.b32decode(r["warc-payload-digest"].removeprefix("sha256:")).hex()
                kind = r["warc-type"]
                if r["warc-record-id"] != f"<urn:page:{page}>" or kind == "response" and hashlib.sha256(r["payload"]).hexdigest() != digest:
                    raise ValueError(f"record {file}:{offset} is not that of page {page}")
                refers = int(r["warc-refers-to"][10:-1]) if kind == "revisit" else None
                for c, v in zip(cols, (page, int(r["http"]["content-length"]), digest, kind, refers, r["payload"] if kind == "response" else None)):
                    c.append(v)
                held += len(r["payload"])
                if held >= REPLY_BYTES:
                    yield reply()
            yield reply()
        release()

    return by.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary")


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Spark's Parquet reader holds READER_ROWS at once, as html is long; a session's own value holds on."""
    option = "spark.sql.parquet.columnarReaderBatchSize"
    own = spark.conf.get(option, _SPARKS_ROWS)
    spark.conf.set(option, READER_ROWS if own == _SPARKS_ROWS else own)
    try:
        yield
    finally:
        spark.conf.set(option, own)


def archive(pages: DataFrame) -> tuple[str, str, str, DataFrame]:
    """Write pages (page_id, url, html) as WARC records and index them.

    Returns the archives' folder, the index's folder, the directory table's path, and the keys
    (url_key, page_id). Of records with equal payloads of at least LEAST_REVISIT bytes, that of
    the smallest page_id is the response, which the others revisit. Null html: an empty payload;
    null url: empty; a null page_id is archived as a response, to which nothing refers. Rows that
    repeat a response's page_id and payload are responses too. Other columns are left out.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"))
    large = F.octet_length("html") >= LEAST_REVISIT
    first = p.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("__d"), "first")
    with _few_rows(spark):
        first = cut(first, "digests")
    if first.count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)
    # beyond, pages that can't be revisits are dealt by a key of their own; Spark splits large digests
    own = F.when(large, F.col("payload_digest")).otherwise(F.hex(F.xxhash64("page_id", "url")))
    p = p.withColumn("__own", own).join(first, F.col("__own") == F.col("__d"), "left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    p = p.select("page_id", "url", "html", "payload_digest", refers.alias("refers_to"), url_key(F.col("url")).alias("url_key"))
    archives, index, directory = fresh_dir(spark, "warc"), fresh_dir(spark, "cdx"), fresh_dir(spark, "directory")
    with _few_rows(spark):
        captures = cut(write_archives(p, archives), "captures")
    build_index(captures, index).write.parquet(directory)
    return archives, index, directory, captures.select("url_key", "page_id")


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive pages, then look every page up in the index and read its record back."""
    archives, index, directory, keys = archive(pages)
    return read_records(lookup(keys, directory, index), archives)
