"""A deterministic sharded WARC writer, and its reader.

Writing.  A first pass takes, for every page, the digest and size of its payload and
the size of its record when compressed (a gzip member each, without times).  Digests
name the first page of each group of equal payloads; it becomes a response record,
the others revisit records that refer to it.  Running sums of compressed sizes in
page order give each page its file, so files roll by compressed size and every
file's bytes follow from the pages alone, not from how Spark dealt them.  A second
pass makes the records again and sends each, with what is known of its page, to the
task of its file: a range of pages, sorted there by page.  No page is joined with
anything: what is known of a page comes just before it in the sort.  Each file begins
with a warcinfo record, is written under a temporary name of its own attempt, renamed
when complete, and listed with its size and SHA-256 in a manifest; a run is committed
when the manifest is.  A task that is lost or run twice leaves a temporary file that
no manifest lists, or replaces a file by the same bytes.

Reading takes the files of a manifest, checks how many records they hold, and checks
block and payload digests; a revisit's length and digest are in its headers.

Files are written where ``root`` says, through the local file interface for
file: paths (a folder that driver and executors share) and pyarrow's file systems
for others.

Defined results: a null payload is empty; a null page_id is refused; rows that
share the smallest page_id of a payload are all responses, and a revisit names the
first url of theirs; the payload of fewer than ``least_bytes`` bytes is always a
response; a null or blank url is written as ``urn:page:<page_id>``; the rows of one
page_id lie in one file, however many they are; an empty table gives an empty
manifest; other columns are not written.
"""

from __future__ import annotations

import base64
import functools
import gzip
import hashlib
import io
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Compressed bytes after which a file ends.
ROLL = 32 << 20
#: Fixed, so that equal pages make equal archives.
DATE = "2000-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def target(page_id: int, url: str | None) -> str:
    return "".join((url or "").split()) or f"urn:page:{page_id}"


def _member(kind: str, lines: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", *lines, f"WARC-Date: {DATE}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _page_lines(page_id: int, url: str, digest: str, size: int) -> list[str]:
    return [
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{url}:{digest}')}>",
        f"WARC-Target-URI: {target(page_id, url)}",
        f"WARC-Page-ID: {page_id}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
    ]


def _http(size: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size


def response(page_id: int, url: str, payload: bytes, digest: str) -> bytes:
    """A record of the whole payload, its headers made from it."""
    return _member("response", _page_lines(page_id, url, digest, len(payload)), _http(len(payload)) + payload)


def revisit(page_id: int, url: str, digest: str, size: int, refers_to: int, refers_url: str) -> bytes:
    """A record without payload, which says where that is."""
    lines = [
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        f"WARC-Refers-To-Target-URI: {target(refers_to, refers_url)}",
        f"WARC-Refers-To-Date: {DATE}",
        f"WARC-Refers-To-Page: {refers_to}",
    ]
    return _member("revisit", _page_lines(page_id, url, digest, size) + lines, _http(size))


def warcinfo(name: str) -> bytes:
    """The record that a file begins with."""
    lines = [f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'warcinfo:{name}')}>", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _member("warcinfo", lines, b"software: vellum\r\nformat: WARC File Format 1.1\r\n")


# --- what is known of pages ---------------------------------------------------------

_PAGE = "page_id long, url string, digest string, n long"
_KNOWN = ("page_id", "url", "digest", "n")


def _payloads(batches):
    """(page_id, url, payload, digest) of each row, row by row."""
    for batch in batches:
        html = batch.column("html").cast(pa.large_binary())
        for i, u, h in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), html, strict=True):
            payload = h.as_buffer().to_pybytes() if h.is_valid else b""
            yield i, u or "", payload, base32_sha1(payload)


def _sizes(batches):
    """Digest, payload size and record size of each page."""
    rows = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["page_id", "url", "digest", "n", "size"])

    for i, u, payload, digest in _payloads(batches):
        rows.append((i, u, digest, len(payload), len(response(i, u, payload, digest))))
        if len(rows) == 4096:
            yield out()
            rows = []
    yield out()


def repeats(known: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages that repeat a payload, with the first page and url that have it; only narrow rows are shuffled, and a payload of many pages is not sent to one task."""
    payloads = known.where(F.col("n") >= least_bytes)
    first = payloads.groupBy("digest", "n").agg(F.min(F.struct("page_id", "url")).alias("f"), F.count("*").alias("copies")).where("copies > 1")
    first = shared.written(first.select("digest", "n", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url"), "copies"), "first")
    often = first.agg(F.sum("copies")).first()[0] or 0
    # A payload of a thousandth of all repeats or more: a thousand at most, so they can be broadcast; the others are joined by digest.
    least = max(2, -(-often // 1000))
    hot, cold = first.where(F.col("copies") >= least).drop("copies"), first.where(F.col("copies") < least).drop("copies")
    rest = payloads.join(hot.hint("broadcast"), ["digest", "n"], "left_anti")
    found = payloads.join(hot.hint("broadcast"), ["digest", "n"]).unionByName(rest.join(cold, ["digest", "n"]))
    return found.where("page_id > refers_to").select(*_KNOWN, "refers_to", "refers_url").distinct()


def _revisit_sizes(batches):
    for batch in batches:
        size = [len(revisit(*r)) for r in zip(*(batch.column(c).to_pylist() for c in (*_KNOWN, "refers_to", "refers_url")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KNOWN), pa.array(size, pa.int64())], names=[*_KNOWN, "revisit_size"])


def _running(batches):
    """Rows sorted by page: where each begins in its task."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = np.asarray(batch.column("size"))
        ends = at + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(ends - size), pa.array(ends), pa.array(np.full(len(size), part, np.int32))], names=["page_id", "begin", "end", "part"])
        at = int(ends[-1]) if len(ends) else at


def _firsts(batches, base: np.ndarray, roll: int):
    """Of the batch's pages, the first of each file."""
    for batch in batches:
        file = (np.asarray(batch.column("begin")) + base[np.asarray(batch.column("part"))]) // roll
        order = np.lexsort((np.asarray(batch.column("page_id")), file))  # a batch may hold ranges in any order
        files, at = np.unique(file[order], return_index=True)
        yield pa.RecordBatch.from_arrays([pa.array(files), batch.column("page_id").take(pa.array(order[at]))], names=["file", "page_id"])


def first_pages(sizes: DataFrame, roll: int) -> np.ndarray:
    """The first page of each file, in order; sizes: page_id, size."""
    n = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Ranges of pages, in order of the partitions' numbers: sums within each, then over the ranges (a number for each).
    placed = sizes.repartitionByRange(n, "page_id").sortWithinPartitions("page_id").mapInArrow(_running, "page_id long, begin long, end long, part int")
    placed = shared.written(placed, "placed")
    totals = {r["part"]: r["total"] for r in placed.groupBy("part").agg(F.max("end").alias("total")).collect()}
    base = np.zeros(max(totals, default=0) + 1, np.int64)
    base[1:] = np.cumsum([totals.get(k, 0) for k in range(len(base))])[:-1]
    found = placed.mapInArrow(functools.partial(_firsts, base=base, roll=roll), "file long, page_id long").groupBy("file").agg(F.min("page_id").alias("first")).collect()  # a row for each file
    return np.array(sorted({r["first"] for r in found}), np.int64)


# --- files ------------------------------------------------------------------------


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


class _File:
    """A file under a temporary name of this attempt; commit() renames it."""

    def __init__(self, path: str):
        self.path, self.temporary = path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.size, self.digest = 0, hashlib.sha256()
        self.first = self.last = None
        self.records = 0
        if _local(path):
            self.stream = open(_local(self.temporary), "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            self.system, self.where = fs.FileSystem.from_uri(self.temporary)
            self.stream = self.system.open_output_stream(self.where)
        self._put(warcinfo(path.rpartition("/")[2]))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.digest.update(data)
        self.size += len(data)

    def add(self, page_id: int, data: bytes) -> None:
        self._put(data)
        self.records += 1
        self.first = page_id if self.first is None else self.first
        self.last = page_id

    def commit(self) -> tuple:
        if _local(self.path):
            self.stream.flush()
            os.fsync(self.stream.fileno())
            self.stream.close()
            os.replace(_local(self.temporary), _local(self.path))
        else:
            from pyarrow import fs

            self.stream.close()
            self.system.move(self.where, fs.FileSystem.from_uri(self.path)[1])
        return self.path.rpartition("/")[2], self.size, self.digest.hexdigest(), self.records, self.first, self.last

    def abandon(self) -> None:
        self.stream.close()
        if _local(self.path):
            os.unlink(_local(self.temporary))
        else:
            self.system.delete_file(self.where)


def _open(path: str):
    local = _local(path)
    if local:
        return open(local, "rb")
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_stream(where)


def _records(batches, firsts: np.ndarray):
    """Each page's record as a response, with its file."""
    rows, held = [], 0

    def out():
        ids = np.array([r[0] for r in rows], np.int64)
        columns = [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.string()), (3, pa.int64()), (4, pa.binary()))]
        none = pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(_file_of(ids, firsts)), pa.array(ids), *columns, *none], names=_SENT_NAMES)

    for i, u, payload, digest in _payloads(batches):
        rows.append((i, u, digest, len(payload), response(i, u, payload, digest)))
        held += len(rows[-1][4])
        if len(rows) == 4096 or held > 4 << 20:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()


def _file_of(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    return (np.searchsorted(firsts, ids, side="right") - 1).astype(np.int32)


def _notes(batches, firsts: np.ndarray):
    """What is known of pages that repeat a payload, sent as rows without a record."""
    for batch in batches:
        file = pa.array(_file_of(np.asarray(batch.column("page_id")), firsts))
        columns = [batch.column(c) for c in _KNOWN]
        yield pa.RecordBatch.from_arrays([file, *columns, pa.nulls(batch.num_rows, pa.binary()), batch.column("refers_to"), batch.column("refers_url")], names=_SENT_NAMES)


_SENT = f"file int, {_PAGE}, record binary, refers_to long, refers_url string"
_SENT_NAMES = [c.split()[0] for c in _SENT.split(", ")]


def _write_files(batches, root: str):
    """One file for each run of rows with the same file number; rows come sorted, a note before the rows it is about."""
    number, file, rows, note = None, None, [], None
    try:
        for batch in batches:
            for n, i, u, digest, size, data, refers, refers_url in zip(*(batch.column(c) if c == "record" else batch.column(c).to_pylist() for c in _SENT_NAMES), strict=True):
                if n != number:
                    if file:
                        rows.append(file.commit())
                    number, file = n, _File(f"{root}/part-{n:08d}.warc.gz")
                if not data.is_valid:
                    note = (i, u, digest, size, refers, refers_url)
                elif note and note[:4] == (i, u, digest, size):
                    file.add(i, revisit(*note))
                else:
                    file.add(i, data.as_py())
        if file:
            rows.append(file.commit())
            file = None
    except BaseException:
        if file:
            file.abandon()
        raise
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names=["name", "bytes", "sha256", "records", "first_page", "last_page"])


MANIFEST = "name string, bytes long, sha256 string, records long, first_page long, last_page long"


def write(pages: DataFrame, root: str, roll: int = ROLL, least_bytes: int = 0) -> DataFrame:
    """Write the archive under root and commit it; returns its manifest."""
    spark = pages.sparkSession
    named = F.coalesce(F.col("page_id").cast("long"), F.raise_error(F.lit("a page without a page_id")).cast("long"))
    pages = pages.select(named.alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html"))
    root = root.rstrip("/")
    local = _local(root)
    if local:
        os.makedirs(local, exist_ok=True)
    else:
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(root)
        system.create_dir(where, recursive=True)
    known = shared.written(pages.mapInArrow(_sizes, f"{_PAGE}, size long"), "known")
    again = shared.written(repeats(known, least_bytes), "repeats")
    shorter = again.mapInArrow(_revisit_sizes, f"{_PAGE}, revisit_size long")
    sizes = known.join(shorter, list(_KNOWN), "left").groupBy("page_id").agg(F.sum(F.coalesce("revisit_size", "size")).alias("size"))
    firsts = first_pages(shared.written(sizes, "sizes"), roll)
    path = f"{root}/_manifest"
    if not len(firsts):
        spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(path)
        return spark.read.schema(MANIFEST).parquet(path)
    records = pages.mapInArrow(functools.partial(_records, firsts=firsts), _SENT)
    notes = again.mapInArrow(functools.partial(_notes, firsts=firsts), _SENT)
    sent = records.unionByName(notes).repartitionById(len(firsts), F.col("file"))
    ordered = sent.sortWithinPartitions("file", "page_id", "digest", "n", "url", F.col("record").isNotNull())
    ordered.mapInArrow(functools.partial(_write_files, root=root), MANIFEST).write.mode("overwrite").parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


# --- reading ----------------------------------------------------------------------


def members(stream):
    """Yield the decompressed bytes of each gzip member."""
    pending = b""
    out, d = io.BytesIO(), None
    while True:
        chunk = pending or stream.read(1 << 18)
        pending = b""
        if not chunk:
            if d is not None:
                raise EOFError("the archive ends within a record")
            return
        if d is None:
            d, out = zlib.decompressobj(31), io.BytesIO()
        out.write(d.decompress(chunk))
        if d.eof:
            pending, d = d.unused_data, None
            yield out.getvalue()


def parse(member: bytes) -> dict:
    """Headers and payload of a record; digests that do not match raise."""
    head, _, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
        raise ValueError("a damaged record")
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha1:" + base32_sha1(payload):
        raise ValueError("a payload does not match its digest")
    return {"headers": headers, "payload": payload}


def _read(batches, root: str, payloads: bool):
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(columns))], names=columns)

    for batch in batches:
        for name, n in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
            rows, seen, held = [], 0, 0
            with _open(f"{root}/{name}") as f:
                for member in members(f):
                    r = parse(member)
                    h = r["headers"]
                    kind = h["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    refers = h.get("WARC-Refers-To-Page")
                    length = len(r["payload"]) if kind == "response" else int(h["WARC-Payload-Length"])
                    rows.append((int(h["WARC-Page-ID"]), h["WARC-Target-URI"], length, h["WARC-Payload-Digest"].removeprefix("sha1:"), kind, int(refers) if refers else None, r["payload"]))
                    seen += 1
                    held += len(r["payload"])
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
            if seen != n:
                raise ValueError(f"{name} holds {seen} records; its manifest says {n}")
            if rows:
                yield batch_of(rows)


def read(spark: SparkSession, root: str, manifest: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """One row for each record of the archive that a manifest lists; a revisit's length and digest are those of the payload that it refers to."""
    root = root.rstrip("/")
    listed = manifest if manifest is not None else spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payloads else "")
    files = max(1, listed.count())
    number = F.regexp_extract("name", r"part-(\d+)", 1).cast("int") % files
    return listed.select("name", "records").repartitionById(files, number).mapInArrow(functools.partial(_read, root=root, payloads=payloads), schema)
