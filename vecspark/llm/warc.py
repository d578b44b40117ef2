"""Operator 3: captured pages in WARC files, behind a two-level capture index.

*Archive.* Each task writes the pages it reads as one WARC file: one gzip member a record, so that a record can be read by
its place (file, offset, length) alone.

*Index.* A capture's key is its URL with the host's labels reversed (``com,example,blog)/path?query``): lower case, without
scheme, user, ``www``, default port, fragment, tracking or session parameters and closing slash, arguments sorted. Captures
are range-partitioned and sorted by (key, page_id); each partition becomes one index file of compressed blocks of ``LINES``
captures, followed by its sparse directory (first key, offset and length of each block). The upper level is the first
and last key of each index file: one small row a file.

*Lookup.* A key is sent to the index files whose range covers it (binary search in the upper level); there it is
binary-searched in the directory, only the blocks that can hold it are read, by range, and searched; then the records
are read by range. Lookups are sorted, so each block is read and unpacked once a task however many keys fall into it.

Files go to the shared folder through Arrow's file systems (a local path, HDFS or S3 alike). A retried task writes new
files under new names; only those of the attempts that succeeded are listed.

Defined cases: pages without a URL aren't captured; a URL without a host is keyed by its path alone; null HTML is an empty
payload; repeated rows and pages with one key are captures of their own, in order of page_id, nulls first; null and
unknown keys find nothing; an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import text as X

LINES, PART_LINES, LEVEL, TASK_READS = 512, 200_000, 1, 4000
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"
_PORT = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?[^/:?#]*:([0-9]+)"
_PATH = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*[?]([^#]*)"
_NOISE = "^(utm_[a-z]+|fbclid|gclid|sid|sessionid|phpsessid|jsessionid)="


def url_key(url: Column) -> Column:
    """The sort key of a URL."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www[0-9]*\.", "")
    port = F.regexp_extract(url, _PORT, 1)
    path = F.lower(F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", ""))
    kept = F.filter(F.split(F.lower(F.regexp_extract(url, _QUERY, 1)), "&", -1), lambda x: (x != "") & ~x.rlike(_NOISE))
    query = F.array_join(F.array_sort(kept), "&")
    parts = [
        F.array_join(F.reverse(F.split(host, r"\.", -1)), ","),
        F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        F.lit(")"),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    ]
    return F.concat(*parts)


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _pack(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str, html: bytes) -> bytes:
    """One WARC record."""
    known = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    target = url.replace("\r", "%0D").replace("\n", "%0A")
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {target}\r\nWARC-Record-ID: <urn:uuid:{known}>\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n"
    return head.encode("utf-8", "replace") + html + b"\r\n\r\n"


def payload(raw: bytes) -> bytes:
    """The payload of a record's gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    return rest[:size]


def _archive(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                ids, urls, places = b.column(1).to_pylist(), b.column(2).to_pylist(), []
                for page_id, url, html in zip(ids, urls, b.column(3).to_pylist(), strict=True):
                    packed = _pack(record(page_id, url, (html or "").encode("utf-8", "surrogatepass")))
                    if out is None:
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(packed)
                    places.append((at, len(packed)))
                    at += len(packed)
                cols = [b.column(0), b.column(1), b.column(2), pa.array([name] * len(ids), pa.string())]
                cols += [pa.array([p[k] for p in places], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "page_id", "url", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return write


def _blocks(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        name, out, at, last, lines = f"{uuid.uuid4().hex}.cdx", None, 0, "", []
        directory: list[tuple[str, int, int]] = []

        def close() -> None:
            nonlocal out, at, lines
            if out is None:
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            packed = _pack(json.dumps(lines).encode())
            directory.append((lines[0][0], at, len(packed)))
            out.write(packed)
            at += len(packed)
            lines = []

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(row)
                last = row[0]
                if len(lines) == LINES:
                    close()
        if lines:
            close()
        if out is None:
            return
        packed = _pack(json.dumps(directory).encode())
        out.write(packed)
        out.close()
        cols = [pa.array([x]) for x in (name, directory[0][0], last, at, len(packed))]
        yield pa.RecordBatch.from_arrays(cols, names=["file", "first", "last", "offset", "length"])

    return write


class Index:
    """The upper level: index files by the range of their keys."""

    def __init__(self, root: str, files: list[tuple[str, str, str, int, int]], captures: int = 0):
        self.root, self.captures = root, captures
        self.files = sorted(files, key=lambda r: (r[1].encode(), r[2].encode(), r[0]))
        self.first = [r[1].encode() for r in self.files]
        self.last = [r[2].encode() for r in self.files]

    def covering(self, key: str) -> range:
        k = key.encode()
        return range(bisect.bisect_left(self.last, k), bisect.bisect_right(self.first, k))


def build(pages: DataFrame) -> Index:
    """Writes the archive and the index of ``pages``; the driver gets one row an index file."""
    root = f"{X.shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    system, base = _open(root)
    system.create_dir(base, recursive=True)
    X.remove_at_exit(pages.sparkSession, root)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    own = own.where("url IS NOT NULL").select(url_key(F.col("url")).alias("key"), "page_id", "url", "html")
    captures = X.stored(own.mapInArrow(_archive(root), "key string, page_id long, url string, file string, offset long, length long"), "captures")
    n = captures.count()
    parts = max(1, -(-n // PART_LINES))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    files = ordered.mapInArrow(_blocks(root), "file string, first string, last string, offset long, length long").collect()
    X.discard(captures)
    return Index(root, [tuple(r) for r in files], n)


class Reader:
    """Range reads of index blocks and records; open files and the block read last are kept."""

    def __init__(self, root: str):
        self.system, self.base = _open(root)
        self.open: dict[str, pa.NativeFile] = {}
        self.directory: dict[str, tuple[list[bytes], list]] = {}
        self.block: tuple = (None, None)

    def read(self, file: str, offset: int, length: int) -> bytes:
        if file not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            self.open[file] = self.system.open_input_file(f"{self.base}/{file}")
        return self.open[file].read_at(length, offset)

    def lines(self, file: str, offset: int, length: int) -> tuple[list[bytes], list]:
        if self.block[0] != (file, offset):
            rows = json.loads(zlib.decompress(self.read(file, offset, length), 31))
            self.block = (file, offset), ([r[0].encode() for r in rows], rows)
        return self.block[1]

    def captures(self, file: str, offset: int, length: int, key: str) -> Iterator[list]:
        """Lines of a key in one index file, whose directory lies at ``offset``."""
        if file not in self.directory:
            rows = json.loads(zlib.decompress(self.read(file, offset, length), 31))
            self.directory = {file: ([r[0].encode() for r in rows], rows)}
        first, rows = self.directory[file]
        k = key.encode()
        for n in range(max(0, bisect.bisect_left(first, k) - 1), bisect.bisect_right(first, k)):
            keys, lines = self.lines(file, rows[n][1], rows[n][2])
            yield from lines[bisect.bisect_left(keys, k) : bisect.bisect_right(keys, k)]


def looked_up(keys: DataFrame, index: Index) -> DataFrame:
    """(key, page_id, url, digest, n_bytes) of every capture of the distinct ``keys.key``; digest is MD5 of the payload read."""
    spark = keys.sparkSession
    shipped = spark.sparkContext.broadcast(index)

    @F.arrow_udf("array<int>")
    def files(key: pa.Array) -> pa.Array:
        return pa.array([None if k is None else list(shipped.value.covering(k)) for k in key.to_pylist()], pa.list_(pa.int32()))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shipped.value.root)
        for b in batches:
            rows = []
            for number, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name, _, _, offset, length = shipped.value.files[number]
                for _, page_id, url, file, at, size in reader.captures(name, offset, length, key):
                    data = payload(reader.read(file, at, size))
                    rows.append((key, page_id, url, hashlib.md5(data).hexdigest(), len(data)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "page_id", "url", "digest", "n_bytes"])

    sent = keys.select("key").where("key IS NOT NULL").distinct().select(F.explode(files("key")).alias("number"), "key")
    # the work is the reads, not the keys' bytes: so many tasks as the captures need
    sent = sent.repartitionByRange(max(1, -(-index.captures // TASK_READS)), "number", "key").sortWithinPartitions("number", "key")
    return sent.mapInArrow(search, "key string, page_id long, url string, digest string, n_bytes long")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Builds the index of all pages, looks every page's URL up in it and reads each capture back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return looked_up(pages.select(url_key(F.col("url")).alias("key")), build(pages)).withColumnRenamed("key", "url_key")


ORACLE = f"""
WITH u AS (
  SELECT page_id, url, html,
    regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '^www[0-9]*\\.', '') AS host,
    regexp_extract(url, '{_PORT}', 1) AS port,
    lower(regexp_replace(regexp_extract(url, '{_PATH}', 1), '/+$', '')) AS path,
    array_to_string(list_sort(list_filter(string_split(lower(regexp_extract(url, '{_QUERY}', 1)), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{_NOISE}'))), '&') AS query
  FROM pages WHERE url IS NOT NULL)
SELECT array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')'
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key,
  page_id, url, md5(coalesce(html, '')) AS digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes
FROM u"""
