"""WARC archives with a two-level capture index.

Each page becomes one WARC record, a gzip member of its own. Captures are sorted
by reversed-host URL key into index parts. A part is a file of compressed blocks
of sorted lines; its directory holds the first key and the byte range of each
block. A look-up finds the part by the first keys of all parts, the block by
binary search in the part's directory, and then reads just that block and just
the record's bytes.

Files live in the folder of `spark.checkpoint.dir` and are opened with
`pyarrow.fs`. A task writes to names of its own attempt, and only names that a
finished task has returned are used, so a lost executor leaves unused files only.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.session import broadcast_if_small, durable, scratch_path

MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1_000
LEVEL = 3
BROADCAST_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def reversed_host_key(url: str | None) -> str:
    """Sort key of a URL: host labels from the last to the first, then path and query.

    Scheme, user, fragment, `www.` and default ports are left out, and case is
    folded in the host. A null or broken URL sorts by its own text.
    """
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return f"!{url}"
    if not host:
        return f"!{url or ''}"
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{key}){parts.path or '/'}{query}"


def record_uri(page: int | None) -> str:
    return f"urn:capture:{'none' if page is None else page}"


def record_page(uri: str) -> int | None:
    name = uri.rpartition(":")[2]
    return None if name == "none" else int(name)


def warc_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record; a revisit has no payload and names the record that has it."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_uri(page)}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {0 if revisit else len(payload)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{record_uri(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return head + (b"" if revisit else payload) + b"\r\n\r\n"


def parsed_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    return fields, rest[: int(fields["Content-Length"])]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; the folder is made if it isn't there."""
    if "://" in folder or folder.startswith("file:"):
        system, path = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))
    else:
        system, path = fs.LocalFileSystem(), folder
    system.create_dir(path, recursive=True)
    return system, path


_CAPTURE_FIELDS = [
    ("surt", pa.string()),
    ("page_id", pa.int64()),
    ("file", pa.string()),
    ("offset", pa.int64()),
    ("length", pa.int64()),
]
_CAPTURES = "surt string, page_id long, file string, offset long, length long"


def _archive_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        out, name, size = None, "", 0
        rows = []

        def batch_of():
            columns = zip(*rows, strict=True)
            found = pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, (_, kind) in zip(columns, _CAPTURE_FIELDS, strict=True)],
                names=[n for n, _ in _CAPTURE_FIELDS],
            )
            rows.clear()
            return found

        for batch in batches:
            for page, url, html, first in zip(
                *(batch.column(c) for c in ("page_id", "url", "html", "first")), strict=True
            ):
                page, url, first = page.as_py(), url.as_py(), first.as_py()
                payload = (html.as_py() or "").encode()
                revisit = first is not None and first != page
                data = gzip.compress(
                    warc_record(page, url, payload, base32_sha1(payload), first, revisit), LEVEL, mtime=0
                )
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                rows.append((reversed_host_key(url), page, name, size, len(data)))
                size += len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            # Rows leave the task as they are made, but count only if it ends well.
            if rows:
                yield batch_of()
        if out is not None:
            out.close()

    return run


def _payload_digest() -> Column:
    return F.sha1(F.coalesce("html", F.lit("")).cast("binary"))


def first_captures(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """`digest` and `first`, the smallest page_id, of payloads that more than one page has.

    A payload that holds most pages is folded before its shuffle.
    """
    return (
        pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) >= min_bytes)
        .select(_payload_digest().alias("digest"), F.col("page_id").cast("long").alias("page_id"))
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("pages"))
        .where("pages > 1")
        .select("digest", "first")
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write a record per row of `pages` (`page_id`, `url`, `html`); returns the captures.

    Among records of equal payload with at least `min_bytes` bytes the one with
    the smallest page_id is the response and the others revisit it. Records that
    tie at the smallest page_id (repeated rows) are all responses. A null
    page_id is a response, unless a page with an id has the same payload.
    """
    seen = broadcast_if_small(durable(first_captures(pages, min_bytes), "digests"), BROADCAST_BYTES)
    marked = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _payload_digest().alias("digest"))
        .join(seen, "digest", "left")
        .select("page_id", "url", "html", "first")
    )
    return durable(marked.mapInArrow(_archive_rows(folder), _CAPTURES), "captures")


_PARTS = "nth int, file string, first string, blocks array<struct<key:string,offset:long,length:long>>"


def _index_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        out, name, size, blocks, lines = None, f"{uuid.uuid4().hex}.cdx.gz", 0, [], []

        def flushed():
            nonlocal out, size
            if out is None:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            data = gzip.compress("\n".join(json.dumps(line) for line in lines).encode(), LEVEL, mtime=0)
            out.write(data)
            blocks.append({"key": lines[0][0], "offset": size, "length": len(data)})
            size += len(data)
            lines.clear()

        for batch in batches:
            for line in zip(*(batch.column(c).to_pylist() for c, _ in _CAPTURE_FIELDS), strict=True):
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    flushed()
        if lines:
            flushed()
        if out is not None:
            out.close()
            kind = pa.list_(pa.struct([("key", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([TaskContext.get().partitionId()], pa.int32()),
                    pa.array([name]),
                    pa.array([blocks[0]["key"]]),
                    pa.array([blocks], kind),
                ],
                names=["nth", "file", "first", "blocks"],
            )

    return run


def _tasks(frame: DataFrame) -> int:
    """A number stated to a shuffle, so that small keys of large records are not gathered into one task."""
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into index parts; returns `nth`, `file`, `first` key and block directory of each part.

    Captures of one URL or host may fill several parts: ties go by page_id. Parts
    may then begin with one key; `nth` tells their order. There are at most as
    many parts as shuffle partitions, without captures none.
    """
    ordered = captures.repartitionByRange(_tasks(captures), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    return durable(ordered.mapInArrow(_index_rows(folder), _PARTS), "parts")


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_FOUND_FIELDS = [
    ("page_id", pa.int64()),
    ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()),
    ("record_type", pa.string()),
    ("refers_to", pa.int64()),
]


def _read_record(handle, offset: int, length: int) -> tuple:
    """Capture as read back; the payload is digested anew where the record has it."""
    handle.seek(offset)
    fields, payload = parsed_record(gzip.decompress(handle.read(length)))
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and base32_sha1(payload) != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (
        record_page(fields["WARC-Record-ID"][1:-1]),
        int(fields["X-Payload-Length"]),
        digest,
        fields["WARC-Type"],
        record_page(fields["WARC-Refers-To"][1:-1]) if revisit else None,
    )


_PLACED = "file string, offset long, length long, wanted string"


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each wanted key and block that may hold it; a part's directory comes before its keys."""
    blocks, keys, out = [], [], []

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)],
            names=["file", "offset", "length", "wanted"],
        )
        out.clear()
        return batch

    for batch in batches:
        for file, directory, key in zip(*(batch.column(c) for c in ("file", "blocks", "wanted")), strict=True):
            if directory.is_valid:
                blocks = directory.as_py()
                keys = [b["key"] for b in blocks]
                continue
            file, key = file.as_py(), key.as_py()
            # A key's first line may stand in the block before the first one that begins with it.
            for at in range(max(bisect.bisect_left(keys, key) - 1, 0), bisect.bisect_right(keys, key)):
                out.append((file, blocks[at]["offset"], blocks[at]["length"], key))
                if len(out) == 10_000:
                    yield emitted()
    if out:
        yield emitted()


def _lookup_rows(folder: str):
    """Captures of the wanted keys; the keys of a block follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        current, lines, keys, places = None, [], [], []

        def read() -> Iterator[pa.RecordBatch]:
            """The records of a block's wanted lines, archive by archive in the order they lie there."""
            places.sort()
            found, name, archive = [], None, None
            for wanted, offset, length in places:
                if wanted != name:
                    if archive is not None:
                        archive.close()
                    name, archive = wanted, system.open_input_file(f"{path}/{wanted}")
                found.append(_read_record(archive, offset, length))
            if archive is not None:
                archive.close()
            places.clear()
            if found:
                yield _found(found)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("file", "offset", "length", "wanted"))
            for file, offset, length, key in zip(*columns, strict=True):
                if (file, offset) != current:
                    yield from read()
                    current = (file, offset)
                    with system.open_input_file(f"{path}/{file}") as index:
                        index.seek(offset)
                        data = zlib.decompress(index.read(length), 31)
                    lines = [json.loads(line) for line in data.decode().split("\n")]
                    keys = [line[0] for line in lines]
                places += [tuple(x[2:]) for x in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        yield from read()

    return run


def _found(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, _FOUND_FIELDS, strict=True)],
        names=[n for n, _ in _FOUND_FIELDS],
    )


def _key_rows(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [reversed_host_key(url) for url in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["wanted"])

    return run


def lookup(parts: DataFrame, urls: DataFrame, folder: str) -> DataFrame:
    """All captures of the distinct URL keys of `urls` (`url`); repeated URLs count once.

    Keys meet the parts that may hold them by range: the last part whose first
    key is smaller, and all parts that begin with the key. The list of first
    keys has one entry for each index part, so its size is set by the number of
    shuffle partitions that wrote the index. In a part its block directory,
    carried once, turns a key into blocks. Blocks are then dealt over all tasks,
    those of one hot URL too, and each is read once. Without parts or urls the
    result is empty; other columns of `urls` are ignored.
    """
    tasks = _tasks(parts)
    wanted = urls.select("url").mapInArrow(_key_rows("url"), "wanted string").distinct()
    firsts = parts.select("first", "file").orderBy("nth").collect()
    names, keys = [r.file for r in firsts], [r["first"] for r in firsts]

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, names[at])
                for key in batch.column("wanted").to_pylist()
                for at in range(max(bisect.bisect_left(keys, key) - 1, 0), bisect.bisect_right(keys, key))
            ]
            columns = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["wanted", "file"])

    placed = wanted.mapInArrow(parts_of, "wanted string, file string")
    directories = parts.select("file", "blocks", F.lit(None).cast("string").alias("wanted"))
    return (
        placed.select("file", F.lit(None).cast(parts.schema["blocks"].dataType).alias("blocks"), "wanted")
        .unionByName(directories)
        .repartition(tasks, "file")
        .sortWithinPartitions("file", F.col("blocks").isNull(), "wanted")
        .select("file", "blocks", "wanted")
        .mapInArrow(_block_keys, _PLACED)
        .repartition(tasks, "file", "offset")
        .sortWithinPartitions("file", "offset", "wanted")
        .mapInArrow(_lookup_rows(folder), _FOUND)
    )


def scan(parts: DataFrame, folder: str) -> DataFrame:
    """All captures, read by way of the index: a row for each block, then its records.

    Without parts the result is empty.
    """
    blocks = parts.select("file", F.explode("blocks").alias("block")).select("file", "block.*")
    return blocks.repartition(_tasks(parts), "file", "offset").mapInArrow(_block_rows(folder), _FOUND)


def _block_rows(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        for batch in batches:
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                with system.open_input_file(f"{path}/{file}") as index:
                    index.seek(offset)
                    lines = [json.loads(x) for x in zlib.decompress(index.read(length), 31).decode().split("\n")]
                lines.sort(key=lambda line: (line[2], line[3]))
                found, name, archive = [], None, None
                for _, _, wanted, at, size in lines:
                    if wanted != name:
                        name, archive = wanted, system.open_input_file(f"{path}/{wanted}")
                    found.append(_read_record(archive, at, size))
                yield _found(found)

    return run


def archive_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
