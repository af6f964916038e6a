"""WARC archives: a writer of one gzip member per record, and a sequential reader that checks what it reads.

The reader takes bytes as they come, inflates them member by member in bounded parts, frames records by Content-Length while it does and verifies the
digests of blocks and payloads; where payloads are not asked for it never holds a whole one. Files lie in a folder that all executors see and are reached through
pyarrow's file systems (local, hdfs, s3, gs), never through a local path of one machine. A task writes a file of its own name and reports it in its
result; what a lost or repeated task has left is in no result, so it is never read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import arrow, cut, partitions, shared_dir, small_batches, stored

DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 18
#: The most revisits (about 150 bytes each) that are broadcast; beyond that pages are shuffled to them.
REVISITS = 100_000


class WarcError(ValueError):
    """Bytes that are no sound archive."""


@dataclass
class Record:
    """A record's named fields, its HTTP header and its payload (what follows the HTTP header, or the whole block), or its size alone."""

    fields: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    size: int = 0


def _named(lines: Iterable[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"a field without a colon: {line[:60]!r}")
        out[name.decode().lower()] = value.strip().decode()
    return out


def member(fields: dict[str, str], *block: bytes) -> bytes:
    """One record as one gzip member; the block may come in parts."""
    own = hashlib.sha256()
    for part in block:
        own.update(part)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"WARC-Block-Digest: sha256:{own.hexdigest()}\r\nContent-Length: {sum(map(len, block))}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([deflate.compress(head.encode()), *map(deflate.compress, block), deflate.compress(b"\r\n\r\n"), deflate.flush()])


def members(parts: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The members of a gzip stream, from parts of any size: each as an iterator of inflated parts of READ bytes at most, to be used up before the next."""
    source = filter(None, parts)
    rest = next(source, b"")

    def inflated() -> Iterator[bytes]:
        nonlocal rest
        inflate = zlib.decompressobj(31)
        while True:
            try:
                out = inflate.decompress(rest, READ)
            except zlib.error as e:
                raise WarcError(f"not gzip: {e}") from e
            if out:
                yield out
            if inflate.eof:
                rest = inflate.unused_data or next(source, b"")
                return
            rest = inflate.unconsumed_tail
            if not rest and len(out) < READ:
                rest = next(source, b"")
                if not rest:
                    raise WarcError("the last member is cut short")

    while rest:
        yield inflated()


class _Framed:
    """Bytes of one member, in the order they are inflated: a header up to a blank line, a counted number, the rest."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def head(self, most: int | None = None) -> tuple[bytes, int]:
        """What precedes the first blank line of the next `most` bytes, and how many bytes were taken with it."""
        seen = 0
        while True:
            end = self.held.find(b"\r\n\r\n", max(0, seen - 3))
            if end >= 0 and (most is None or end + 4 <= most):
                out, self.held = self.held[:end], self.held[end + 4 :]
                return out, end + 4
            seen = len(self.held)
            more = next(self.parts, None) if most is None or seen < most else None
            if more is None:
                return b"", 0
            self.held += more

    def take(self, n: int) -> Iterator[bytes]:
        """n bytes, or as many as there are."""
        while n:
            if not self.held:
                self.held = next(self.parts, b"")
                if not self.held:
                    return
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out

    def rest(self) -> bytes:
        return self.held + b"".join(self.parts)


def parse(parts: Iterator[bytes], keep: bool = True) -> Record:
    """The record in a member, framed by its Content-Length while it is inflated, with digests verified; keep: with its payload, else with its size."""
    member = _Framed(parts)
    head, found = member.head()
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise WarcError("no WARC header")
    fields = _named(lines[1:])
    try:
        left = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    record, block, payload, kept = Record(fields), hashlib.sha256(), hashlib.sha256(), []
    if fields.get("content-type", "").startswith("application/http"):
        http, found = member.head(left)
        if found:
            record.http = _named(http.split(b"\r\n")[1:])
            block.update(http + b"\r\n\r\n")
            left -= found
    for part in member.take(left):
        block.update(part)
        payload.update(part)
        record.size += len(part)
        if keep:
            kept.append(part)
    if record.size != left or member.rest() != b"\r\n\r\n":
        raise WarcError("Content-Length does not frame the record")
    if fields.get("warc-block-digest") not in (None, "sha256:" + block.hexdigest()):
        raise WarcError("the block has another digest")
    if fields.get("warc-type") == "response" and fields.get("warc-payload-digest") != "sha256:" + payload.hexdigest():
        raise WarcError("the payload has another digest")
    record.payload = b"".join(kept)
    return record


def records(parts: Iterable[bytes], keep: bool = True) -> Iterator[Record]:
    return (parse(member, keep) for member in members(parts))


def _clean(value: str) -> str:
    return "".join(c if c.isprintable() and c not in "<> " else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def page_member(page_id: int | None, url: str | None, payload: bytes, sha256: str, first: int | None) -> bytes:
    """A page as a response record, or as a revisit of the page `first`, which has the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": DATE, "WARC-Target-URI": _clean(url or "about:blank"), "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{sha256}"}
    if first is not None:
        fields |= {"WARC-Profile": SAME_PAYLOAD, "WARC-Refers-To": f"<urn:page:{first}>"}
    return member(fields, http, payload if first is None else b"")


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, count, size, out = f"{uuid.uuid4().hex}.warc.gz", 0, 0, None
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, sha256, first = (batch.column(c)[k].as_py() for c in (0, 1, 3, 4))
                    html = batch.column(2)[k]
                    if out is None:
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                        out.write(member({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:file:{name}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                    raw = page_member(page_id, url, html.as_buffer() if html.is_valid else b"", sha256, first)
                    out.write(raw)
                    count, size = count + 1, size + len(raw)
        finally:
            if out is not None:
                out.close()
        if count:
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})

    return run


def _page(uri: str) -> int | None:
    return int(uri[len("<urn:page:") : -1]) if len(uri) > len("<urn:page:>") else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            store, at = pyarrow.fs.FileSystem.from_uri(path)
            with store.open_input_stream(at, compression=None) as stream:
                rows, total = [], 0
                for record in records(iter(lambda: stream.read(READ), b""), keep=False):
                    kind = record.fields.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    size = record.size if kind == "response" else int(record.http["content-length"])
                    refers = record.fields.get("warc-refers-to")
                    rows.append((_page(record.fields["warc-record-id"]), size, record.fields["warc-payload-digest"].removeprefix("sha256:"), kind, _page(refers) if refers else None))
                    total += 1
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if total != expected:
                    raise WarcError(f"{path} has {total} records instead of {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the archives: (path, records, bytes).

    Of rows with equal payloads of at least `least` bytes, the smallest page_id's is a response and the others revisit it; all smaller
    ones are responses. A null html is an empty payload, a null url about:blank. Repeated rows are a record each: rows that have the
    response's page_id are responses too. A row without page_id is written, never referred to, and revisits where others have its payload. No rows,
    no archive.
    """
    small_batches(pages.sparkSession)
    store, base = pyarrow.fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    payload = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).alias("size"))
    narrow = pages.where(F.col("size") >= least).select("page_id", "sha256")
    firsts = narrow.groupBy("sha256").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    revisits = narrow.join(firsts.select("sha256", "first"), "sha256").where("page_id is null or page_id != first").distinct()
    revisits = cut(revisits.select(F.col("sha256").alias("sha256_"), F.col("page_id").alias("page_id_"), "first"))
    few = F.broadcast(revisits) if revisits.count() <= REVISITS else revisits  # then pages stay where they were read
    rows = pages.join(few, [F.col("sha256") == F.col("sha256_"), F.col("page_id").eqNullSafe(F.col("page_id_"))], "left").select("page_id", "url", "html", "sha256", "first")
    return stored(rows.transform(arrow, _write(folder), "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) for each record of archives (path, records); each file is read front to back."""
    return archives.select("path", "records").repartition(partitions(archives.sparkSession), F.xxhash64("path")).transform(arrow, _read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """What read_archives finds in archives that write_archives has put into the shared folder."""
    return read_archives(write_archives(pages, f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}", least))
