"""WARC archives with a two-level capture index.

Writing.  Of records with equal payloads of at least ``least`` bytes the smallest page id is a response and
the others are revisits that refer to it; smaller payloads are always responses.  Each task writes one
archive of gzip members, one a record.  The records' lines (capture key, archive, place, size) are dealt by ranges
of the key (host name reversed, path, page id, digest of the payload) and sorted; each task writes one index of them: blocks of
``block`` lines, each compressed by itself, then a sparse directory (first key, place and size of every block)
and its place.
Files are named by the attempt that writes them and renamed when whole, and lines name their file, so a lost
executor's task can run again, even beside its first attempt; files of lost attempts are never read.

Reading.  The first level is one row a file (its first key), which the driver holds; a lookup finds its file
by binary search there, its block by binary search in that file's directory, its line by binary search in
the block, and then reads just the record's bytes.  Revisits follow their reference the same way.
Lookups are dealt by the same ranges and sorted, so a task reads few directories and each block once.

Tasks open the folder by pyarrow, whose names of object stores are used for Hadoop's (``s3a://`` is ``s3://``); hdfs needs
libhdfs on the executors.

Defined results: null html counts as empty; a null url is the key of an empty host; rows that repeat a page
id are archived and read back one by one, as their payloads are part of the key; a null page id counts as larger than
any other and gives a row too; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, shared_dir

EPOCH = "2024-01-01T00:00:00Z"  # captures carry no time of their own
SALTS = 32


def store_uri(folder: str) -> str:
    """pyarrow's name of a folder that Hadoop names."""
    scheme, mark, rest = folder.partition("://")
    return {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + mark + rest


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(store_uri(folder))


def capture_key(url: str | Column, page_id: str | Column, digest: str | Column) -> Column:
    """Reversed host, then the rest of the URL, then page id and payload digest: sorts a site's captures together."""
    u, p, d = (F.col(x) if isinstance(x, str) else x for x in (url, page_id, digest))
    u = F.coalesce(u, F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    host = F.regexp_replace(host, r"[\x00-\x20\x7f]", "+")  # lines of the index end, and fields are split, at such characters
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[\x00-\x20\x7f]", "+")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest, F.lit(" "), F.coalesce(F.format_string("%020d", p), F.lit("-")), F.lit(" "), F.substring(d, 1, 32))


def keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, digest."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def plan(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to (page id) and refers_url: which record each page becomes."""
    rows = keyed(pages, id_col, url_col, html_col)
    # only groups with more than one record of some size travel to the join
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    first = (rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min(named).alias("first"), F.count("*").alias("n"))
             .where("n > 1 and first is not null").select("digest", "first"))
    later = (F.col("first.page_id") < F.col("page_id")) | (F.col("first").isNotNull() & F.col("page_id").isNull())
    # payloads that many records share are dealt over salts; the other side is a page id and a url a group
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return rows.join(first.hint("shuffle_hash"), ["digest", "salt"], "left").select("page_id", "url", "payload", "digest", F.when(later, F.col("first.page_id")).alias("refers_to"),
                                                     F.when(later, F.col("first.url")).alias("refers_url"))


def _record(page_id: int, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> bytes:
    uri = url if url and url.isascii() and not any(c <= " " for c in url) else quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    head = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri} {digest}')}>"),
            ("WARC-Date", EPOCH), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is None:
        body = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    else:
        body = http + b"\r\n"
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To-Target-URI", quote(refers_url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")), ("X-Refers-To-Page", str(refers_to))]
    head += [("X-Page", "-" if page_id is None else str(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record; the block is cut by its length, not by its content."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if not head.startswith(b"WARC/1.") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    return fields, block.partition(b"\r\n\r\n")[2]


def write(records: DataFrame, folder: str, block: int = 200) -> DataFrame:
    """Writes archives and index; one row an index file: file, first_key, records.  records: as ``plan`` gives
    them.  Payloads are written where they are; only index lines are dealt by key ranges and sorted."""
    spark = records.sparkSession
    names = ["key", "file", "at", "size", "refers_key"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        out, at, lines = None, 0, []
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.part")
                member = gzip.compress(_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["refers_url"]), 6, mtime=0)
                out.write(member)
                lines.append((r["key"], name, at, len(member), r["refers_key"]))
                at += len(member)
        if out is not None:
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), kinds)], names=names)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        task = TaskContext.get()
        name = f"index-{task.partitionId():06d}-{task.taskAttemptId()}.cdx"
        out, where, n, first, lines, directory = None, 0, 0, "", [], []

        def close_block() -> None:
            nonlocal where
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append((lines[0].partition("\t")[0], where, len(data)))
            where += len(data)
            lines.clear()

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out, first = fs.open_output_stream(f"{root}/{name}.part"), r["key"]
                lines.append(f"{r['key']}\t{json.dumps([r['file'], r['at'], r['size'], r['refers_key']])}")
                n += 1
                if len(lines) == block:
                    close_block()
        if out is not None:
            if lines:
                close_block()
            tail = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(tail + where.to_bytes(8, "big") + len(tail).to_bytes(8, "big"))
            out.close()
            fs.move(f"{root}/{name}.part", f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([first]), pa.array([n], pa.int64())], names=["file", "first_key", "records"])

    named = records.withColumn("key", capture_key("url", "page_id", "digest")).withColumn("refers_key", F.when(F.col("refers_to").isNotNull(), capture_key("refers_url", "refers_to", "digest")))
    lines = cut(named.select("key", "page_id", "url", "payload", "digest", "refers_to", "refers_url", "refers_key")
                .mapInArrow(archive, "key string, file string, at long, size long, refers_key string"))
    return lines.repartitionByRange(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(index, "file string, first_key string, records long")


class Reader:
    """Looks captures up in the files of ``folder``; holds a few directories, blocks and payload sizes."""

    def __init__(self, folder: str, files: list[tuple[str, str]]) -> None:
        self.fs, self.root = open_folder(folder)
        self.firsts, self.names = [k for k, _ in files], [f for _, f in files]
        self.kept: OrderedDict = OrderedDict()

    def _remember(self, key, make, most: int = 64):
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        value = self.kept[key] = make()
        while len(self.kept) > most:
            self.kept.popitem(last=False)
        return value

    def _read(self, file: str, at: int, size: int) -> bytes:
        return self._remember(("open", file), lambda: self.fs.open_input_file(f"{self.root}/{file}")).read_at(size, at)

    def _directory(self, name: str) -> tuple[list[str], list]:
        def make():
            f = self.fs.open_input_file(f"{self.root}/{name}")
            end = f.size()
            tail = f.read_at(16, end - 16)
            where, size = int.from_bytes(tail[:8], "big"), int.from_bytes(tail[8:], "big")
            rows = json.loads(zlib.decompress(f.read_at(size, where)))
            return [r[0] for r in rows], rows
        return self._remember(("dir", name), make)

    def find(self, key: str) -> list | None:
        """[file, offset, size, refers_key] of the first capture with that key."""
        i = bisect.bisect_right(self.firsts, key) - 1
        if i < 0:
            return None
        name = self.names[i]
        firsts, rows = self._directory(name)
        j = bisect.bisect_right(firsts, key) - 1
        if j < 0:
            return None
        _, at, size = rows[j]
        keys, values = self._remember(("block", name, j), lambda: tuple(zip(*(x.split("\t") for x in zlib.decompress(self._read(name, at, size)).decode().split("\n")))))
        k = bisect.bisect_left(keys, key)
        return json.loads(values[k]) if k < len(keys) and keys[k] == key else None

    def capture(self, key: str) -> tuple[dict[str, str], bytes] | None:
        found = self.find(key)
        if found is None:
            return None
        return parse(gzip.decompress(self._read(*found[:3])))

    def full(self, key: str) -> tuple[int, str] | None:
        """Size and digest of the payload stored for a response."""
        def make():
            got = self.capture(key)
            return None if got is None else (len(got[1]), hashlib.sha256(got[1]).hexdigest())
        return self._remember(("full", key), make, most=256)


def read(lookups: DataFrame, folder: str, files: list[tuple[str, str]]) -> DataFrame:
    """lookups: page_id, key.  One row each, from the archive: page_id, payload_bytes, payload_digest,
    record_type, refers_to."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, files)
        for b in batches:
            rows = []
            for page_id, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = reader.capture(key)
                if got is None:
                    raise LookupError(f"no capture {key}")
                fields, payload = got
                kind, refers = fields["WARC-Type"], None
                if kind == "revisit":
                    refers = int(fields["X-Refers-To-Page"])
                    size, digest = reader.full(reader.find(key)[3])
                else:
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if fields["WARC-Payload-Digest"] != f"sha256:{digest}" or fields["X-Page"] != ("-" if page_id is None else str(page_id)):
                    raise ValueError(f"capture {key} does not hold what its header says")
                rows.append((page_id, size, digest, kind, refers))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    n = partitions(lookups.sparkSession)
    return lookups.repartitionByRange(n, "key").sortWithinPartitions("key").select("page_id", "key").mapInArrow(run, schema)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def round_trip(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives the pages in the shared folder, reads every one of them back, and removes the archives; ``write`` keeps them."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    files = cut(write(plan(pages, least, id_col, url_col, html_col), folder))
    index = sorted((r.first_key, r.file) for r in files.collect())  # one row a file
    lookups = keyed(pages, id_col, url_col, html_col).select("page_id", capture_key("url", "page_id", "digest").alias("key"))
    result = cut(read(lookups, folder, index))
    remove(spark, folder)
    return result
