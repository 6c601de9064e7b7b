"""WARC archives with revisit records, and a two-level index of their captures.

Level one of the index is a set of files of compressed blocks of sorted capture keys, each with a
sparse directory (the first key of every block) at its end; level two names the first key of
every file. A look-up searches files, directory and block by halving, then reads the record's
bytes. All files lie in the shared folder; a task that runs again writes files of a new name,
and only what the finished task reports is ever read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.spread import join_groups
from riskloom.plans.materialise import new_path, stored

# Keys that one task looks up and reads.
KEYS_OF_A_TASK = 4096
# Payloads below this size are stored again each time.
LEAST_SHARED = 1000
BLOCK_LINES = 256
# What a response has in place of the key of another capture.
NO_KEY = "\t"
FILE_BYTES = 1 << 30
_LEVEL = 3
_TRAILER = "<QQ"
_URN = "urn:page:"


def reversed_host_key(url: Column) -> Column:
    """Sort key of a URL: its host's labels from the last to the first, then what follows the host.

    A null or odd URL is its own text. White space and control characters become %20.
    """
    text = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(text, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "%20")


def capture_key(url: Column, page: Column) -> Column:
    """Unique sort key of a capture: the URL's key and the page's id, in order of both."""
    number = F.lpad((page.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    return F.concat(reversed_host_key(url), F.lit("\t"), F.coalesce(number, F.lit("")))


@dataclass(frozen=True)
class Archive:
    """Captures (capture, path, offset, length), and (first key, path) of each index file."""

    captures: DataFrame
    files: tuple[tuple[bytes, str], ...]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared path, as the path's scheme says."""
    if path.startswith("file:"):
        path = "file://" + "/" + path[len("file:"):].lstrip("/")
    elif "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class _Output:
    """A new file in the shared folder, opened with its first bytes."""

    def __init__(self, folder: str, suffix: str):
        self.path, self.at = f"{folder}/{uuid.uuid4().hex}{suffix}", 0
        system, inner = _opened(self.path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.stream = system.open_output_stream(inner, compression=None)

    def write(self, data: bytes) -> tuple[int, int]:
        """Append; where the bytes begin and how many there are."""
        begin = self.at
        self.stream.write(data)
        self.at += len(data)
        return begin, len(data)

    def close(self) -> None:
        self.stream.close()


class _Cache(OrderedDict):
    """The last few values by key."""

    def __init__(self, most: int, make: Callable[[Any], Any]):
        super().__init__()
        self.most, self.make = most, make

    def __missing__(self, key: Any) -> Any:
        value = self[key] = self.make(key)
        if len(self) > self.most:
            self.popitem(last=False)
        return value


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_bytes(page: str, url: str, payload: bytes, digest: bytes, refers: tuple[str, str] | None) -> bytes:
    """One WARC record: a response, or a revisit without payload that names page and URL of its response."""
    clean = "".join(c if c > " " else "%20" for c in url)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if refers else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{_URN}{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers:
        target = "".join(c if c > " " else "%20" for c in refers[1])
        lines[7:7] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_URN}{refers[0]}>", f"WARC-Refers-To-Target-URI: {target}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record's bytes."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str) -> Callable:
    """Rows (capture, page, url, html, refers, refers_url, refers_key) to captures."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Output | None = None
        answered: set[tuple[str, bytes]] = set()
        for part in parts:
            found = []
            for capture, page, url, html, refers, refers_url, refers_key in zip(*(c.to_pylist() for c in part.columns)):
                payload = (html or "").encode()
                # The page that others refer to answers once; a repeated row of it refers to it as well.
                digest = hashlib.sha1(payload).digest()
                first = refers is None or (refers == page and (page, digest) not in answered)
                if refers == page:
                    answered.add((page, digest))
                data = record_bytes(
                    "" if page is None else page, url or "", payload, digest,
                    None if first else (refers, refers_url or ""),
                )
                if out is None or out.at > FILE_BYTES:
                    if out is not None:
                        out.close()
                    out = _Output(folder, ".warc.gz")
                found.append((capture, out.path, *out.write(_gzip(data)), None if first else refers_key))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                    ["capture", "path", "offset", "length", "refers"],
                )
        if out is not None:
            out.close()

    return batches


def _index_writer(folder: str) -> Callable:
    """Sorted captures to one index file of compressed blocks and their directory."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Output | None = None
        directory: list[str] = []
        lines: list[tuple[str, str]] = []
        first = None

        def flush() -> None:
            nonlocal out, first
            if out is None:
                out, first = _Output(folder, ".cdx"), lines[0][0]
            begin, size = out.write(zlib.compress("\n".join(f"{k}\t{v}" for k, v in lines).encode()))
            directory.append(f"{lines[0][0]}\t{begin}\t{size}")
            lines.clear()

        for part in parts:
            for capture, path, offset, length, refers in zip(*(c.to_pylist() for c in part.columns)):
                lines.append((capture, f"{path}\t{offset}\t{length}\t{refers or NO_KEY}"))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            begin, size = out.write(zlib.compress("\n".join(directory).encode()))
            out.write(struct.pack(_TRAILER, begin, size))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([out.path])], ["first", "path"])

    return batches


class Reader:
    """Look-ups in an archive's index and records; keeps a few blocks and open files."""

    def __init__(self, files: tuple[tuple[bytes, str], ...]):
        self.files, self.firsts = files, [f[0] for f in files]
        self.open = _Cache(16, lambda path: (lambda found: found[0].open_input_file(found[1]))(_opened(path)))
        self.directories = _Cache(8, self._directory)
        self.blocks = _Cache(32, self._block)
        self.payloads = _Cache(256, self._payload)

    def _directory(self, path: str) -> tuple[list[bytes], list[tuple[int, int]]]:
        source = self.open[path]
        begin, size = struct.unpack(_TRAILER, source.read_at(16, source.size() - 16))
        rows = [line.rsplit(b"\t", 2) for line in zlib.decompress(source.read_at(size, begin)).split(b"\n")]
        return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, at: tuple[str, int, int]) -> tuple[list[bytes], list[list[bytes]]]:
        path, begin, size = at
        rows = [line.rsplit(b"\t", 5) for line in zlib.decompress(self.open[path].read_at(size, begin)).split(b"\n")]
        return [r[0] for r in rows], rows

    def captures(self, key: bytes) -> Iterator[tuple[str, int, int, bytes]]:
        """Path, offset, length and the key referred to (or ``NO_KEY``) of every capture with a key."""
        # The file before the first one that begins at or beyond the key may end with it.
        for at in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            path = self.files[at][1]
            firsts, places = self.directories[path]
            for block in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                keys, rows = self.blocks[(path, *places[block])]
                for row in range(bisect_left(keys, key), bisect_right(keys, key)):
                    _, where, offset, length, *refers = rows[row]
                    yield where.decode(), int(offset), int(length), b"\t".join(refers)

    def record(self, path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """The record at a place."""
        return parsed_record(zlib.decompress(self.open[path].read_at(length, offset), 31))

    def _payload(self, asked: tuple[bytes, str]) -> tuple[int, str]:
        """Size and digest of the response under a key that has the digest asked for."""
        key, digest = asked
        for path, offset, length, refers in self.captures(key):
            if refers == NO_KEY.encode():
                _, payload = self.record(path, offset, length)
                if hashlib.sha1(payload).hexdigest() == digest:
                    return len(payload), digest
        raise KeyError(f"no response {digest} under {key!r}")

    def close(self) -> None:
        for source in self.open.values():
            source.close()


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> Archive:
    """Write a record per row of ``pages`` and the index of the captures.

    Of rows with equal payloads of at least ``LEAST_SHARED`` bytes the one with the largest key is the
    response and the others refer to it; smaller payloads and rows without a key are responses. A
    null payload is empty. Payloads are shuffled once, by key, to meet the plan of revisits.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    light = pages.where(F.col(key).isNotNull() & (F.octet_length(payload) >= LEAST_SHARED)).select(
        F.col(key).alias("page"), digest.alias("digest"), F.col(url).alias("url")
    )
    groups = stored(
        light.groupBy("digest").agg(F.max(F.struct("page", "url")).alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "warc-payloads",
    )
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # A payload that fills a third of the pages is joined where its rows are.
    met = join_groups(light.select("page", "digest"), groups, ["digest"], "n", total).where("to is not null")
    plan = stored(met.select("page", "digest", "to").distinct(), "warc-revisits")
    named = plan.select(
        F.col("page").alias("__p"), F.col("digest").alias("__d"), F.col("to.page").cast("string").alias("refers"),
        F.col("to.url").alias("refers_url"), capture_key(F.col("to.url"), F.col("to.page")).alias("refers_key"),
    ).distinct()
    rows = pages.select(
        capture_key(F.col(url), F.col(key)).alias("capture"), F.col(key).alias("__key"),
        F.col(key).cast("string").alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), digest.alias("__digest"),
    )
    joined = rows.join(named, (F.col("__key") == F.col("__p")) & (F.col("__digest") == F.col("__d")), "left").select(
        "capture", "page", "url", "html", "refers", "refers_url", "refers_key"
    )
    folder = new_path(spark, "warc")
    captures = stored(
        joined.mapInArrow(_writer(folder), "capture string, path string, offset long, length long, refers string"),
        "warc-captures",
    )
    found = stored(
        captures.repartitionByRange("capture").sortWithinPartitions("capture")
        .mapInArrow(_index_writer(folder), "first string, path string"), "warc-index",
    )
    # One row per index file, as many as the sort has partitions.
    files = tuple(sorted((r["first"].encode(), r["path"]) for r in found.collect()))
    return Archive(captures, files)


def read_archive(archive: Archive, keys: DataFrame) -> DataFrame:
    """Every capture of the ``keys`` (capture), read through the index.

    Returns page, payload_bytes, payload_digest (hex SHA-1 of the full payload, a revisit's from its
    response), record_type and refers_to. Keys are looked up in order, so a task reads each
    block once; keys without a capture give no row.
    """
    files = archive.files

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(files)
        for part in parts:
            found = []
            for key in part.column(0).to_pylist():
                for path, offset, length, source in reader.captures(key.encode()):
                    fields, payload = reader.record(path, offset, length)
                    page = fields["WARC-Record-ID"][1 + len(_URN):-1]
                    claimed = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    refers, size, name = None, len(payload), hashlib.sha1(payload).hexdigest()
                    if fields["WARC-Type"] == "revisit":
                        refers = fields["WARC-Refers-To"][1 + len(_URN):-1]
                        size, name = reader.payloads[(source, claimed)]
                    if claimed != name:
                        raise ValueError(f"payload of {page} does not match its digest")
                    found.append((page, size, name, fields["WARC-Type"], refers))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))],
                    ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )
        reader.close()

    wanted = stored(keys.select("capture").distinct(), "warc-keys")
    # A key costs the read of a payload: tasks are cut by keys, not by the bytes of the keys.
    parts = max(1, -(-wanted.count() // KEYS_OF_A_TASK))
    return wanted.repartitionByRange(parts, "capture").sortWithinPartitions("capture").mapInArrow(
        batches, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    )
