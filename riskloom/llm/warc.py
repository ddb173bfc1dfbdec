"""WARC archives: written and read as a sequence of records, one gzip member each.

Files are opened through ``pyarrow.fs`` by the URI of their folder, so any shared store that it
knows will do. A task names its file itself and reports it; only files in the reported list are
read, so a repeated or lost task leaves at most an unused file behind.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.base import map_arrow
from riskloom.session import checkpoint_root, pin

SHARED_BYTES = 1000  # payloads from this size on are stored once
ARCHIVE_BYTES = 1 << 28  # compressed size at which a task begins another file
MOST_TASKS = 100_000  # that read at once; beyond it a task reads several files
CHUNK = 1 << 16
LEVEL = 3
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_name(page: int | None, row: str = "") -> str:
    return f"<urn:x-page:{page}>" if page is not None else f"<urn:x-page:none:{row}>"


def page_of(name: str) -> int | None:
    last = name.rstrip(">").removeprefix("<urn:x-page:")
    return None if last.startswith("none") else int(last)


def encode_record(kind: str, name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None) -> bytes:
    """One record as a gzip member; a revisit keeps the digest and length of its payload, not the payload."""
    block = HTTP if kind == "revisit" else HTTP + payload
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url or "", safe="!#$%&'()*+,/:;=?@[]~")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [("WARC-Refers-To", refers_to or ""), ("WARC-Profile", REVISIT)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(head.encode() + block + b"\r\n\r\n") + squeeze.flush()


class _Members:
    """The bytes of a file's gzip members, decompressed as they are asked for."""

    def __init__(self, file: BinaryIO) -> None:
        self.file, self.raw, self.text = file, b"", bytearray()
        self.inflate = None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.file.read(CHUNK)
        if not self.raw:
            if self.inflate is not None:
                raise ValueError("the archive ends inside a gzip member")
            return False
        self.inflate = self.inflate or zlib.decompressobj(31)
        self.text += self.inflate.decompress(self.raw, CHUNK)
        self.raw = self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.raw = self.inflate.unused_data
            self.inflate = None
        return True

    def line(self) -> bytes | None:
        while (end := self.text.find(b"\r\n")) < 0:
            if not self._more():
                if self.text:
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.text[:end])
        del self.text[: end + 2]
        return out

    def take(self, size: int) -> bytes:
        while len(self.text) < size:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.text[:size])
        del self.text[:size]
        return out


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by lower-case name, and payload of every record; digests and framing are verified."""
    members = _Members(file)
    while (version := members.line()) is not None:
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {version[:20]!r}")
        fields = {}
        while line := members.line():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        if lacks := [n for n in ("content-length", "warc-record-id", "warc-type", "warc-block-digest") if n not in fields]:
            raise ValueError(f"a record's header lacks {', '.join(lacks)}")
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its content length")
        if f"sha1:{hashlib.sha1(block).hexdigest()}" != fields["warc-block-digest"]:
            raise ValueError(f"block digest of {fields['warc-record-id']} differs")
        payload = block.partition(b"\r\n\r\n")[2]
        if fields["warc-type"] == "response" and f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields.get("warc-payload-digest"):
            raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
        yield fields, payload


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes every row as a record under ``folder``, a URI or path, and returns the files as ``archive``, ``records``.

    Equal payloads of ``SHARED_BYTES`` or more are stored in the row with the largest id; the other rows
    become revisits of it. Rows repeating that id are responses too; payloads whose rows have no id are
    all responses. A null html is an empty payload, a null url an empty one.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    given = pages.select(F.col(f"`{id_column}`").cast("bigint").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    given = given.withColumn("digest", F.sha1("payload"))
    large = given.where(F.octet_length("payload") >= SHARED_BYTES)
    shared = pin(large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page").alias("keeper")).where("n > 1").drop("n"))
    told = given.join(shared, "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, out, count = "", None, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("page", "url", "payload", "digest", "keeper"))
            done: dict[str, int] = {}
            for page, link, payload, digest, keeper in zip(*columns):
                if out is None:
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out, count = store.open_output_stream(f"{path}/{name}", compression=None), 0
                again = keeper is not None and page != keeper
                own = record_name(page, uuid.uuid4().hex)
                out.write(encode_record("revisit" if again else "response", own, link, payload, digest, record_name(keeper) if again else None))
                count += 1
                if out.tell() >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    done[name] = count
            if done:
                yield {"archive": [*done], "records": [*done.values()]}
        if out is not None:
            out.close()
            yield {"archive": [name], "records": [count]}

    return pin(map_arrow(told.select("page", "url", "payload", "digest", "keeper"), run, "archive string, records bigint"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the listed files: page, url, kind, full length and digest of its payload, revisited page, payload.

    Files are read record by record in bounded memory. The payload of a revisit is null.
    """
    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, expected in zip(*(batch.column(c).to_pylist() for c in ("archive", "records"))):
                rows: list = []
                size = seen = 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as file:
                    for fields, payload in read_records(file):
                        kind = fields["warc-type"]
                        origin = fields.get("warc-refers-to")
                        rows.append((
                            page_of(fields["warc-record-id"]), fields["warc-target-uri"], kind, int(fields["x-payload-length"]),
                            fields["warc-payload-digest"].removeprefix("sha1:"), page_of(origin) if origin else None,
                            payload if kind == "response" else None,
                        ))
                        seen += 1
                        size += len(payload)
                        if size > 1 << 24 or len(rows) >= 10_000:
                            yield dict(zip(names, map(list, zip(*rows))))
                            rows, size = [], 0
                if seen != expected:
                    raise ValueError(f"{name} holds {seen} records, {expected} were written")
                if rows:
                    yield dict(zip(names, map(list, zip(*rows))))

    # A task for each file: a repartition by name alone would be merged into few tasks, as names are small.
    tasks = max(1, min(archives.count(), MOST_TASKS))
    return map_arrow(archives.repartition(tasks), run, schema)


def archive_folder(df: DataFrame) -> str:
    """A fresh folder for archives under the session's shared folder."""
    root = checkpoint_root(df.sparkSession)
    return f"{root if ':' in root.split('/')[0] else 'file://' + root}/warc-{uuid.uuid4().hex}"
