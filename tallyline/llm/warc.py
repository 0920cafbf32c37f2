"""WARC archives with dictionary-compressed records.

Each archive is one file: a skippable frame with a Zstandard dictionary built from the archive's own records, then
each record as a frame of its own that uses it. A page is a ``response`` record (HTTP headers and the payload), or,
if another page has the same payload of at least ``min_bytes``, a ``revisit`` record without payload that refers to
it: of equal payloads the largest page id is the response.

Writing returns a manifest, one row per archive. Tasks write under a name of their own and only manifested files are
read, so a task that is run again leaves an unread file and no wrong one. The manifest is checkpointed.

A null payload is empty. A null page id counts as the smallest; rows that share the largest id of a payload are all
responses. Null URLs have no target header; control characters and blanks of URLs are percent-encoded. An empty table
gives no archive and no record. Only the three named columns are read, so others can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import worker_path
from tallyline.session import cut_lineage, shared_folder

MIN_BYTES = 1000
#: Records of one archive before compression; a larger record makes a larger archive.
ARCHIVE_BYTES = 12 << 20
DICTIONARY_BYTES, SAMPLE_BYTES = 64 << 10, 4 << 20
# Bytes unpacked at a time, and bytes of archives that a reading task takes.
READ_BYTES, TASK_BYTES = 16 << 10, 64 << 20
#: The magic number of a skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"


def payload_records(pages: DataFrame, page: str = "page_id", html: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``pages`` as page_id, url, payload, digest, n_bytes, and the page id that a revisit refers to.

    Digests alone are grouped. The join that brings the referred page back has one row per repeated payload on its
    other side; a payload that many pages share is split by the adaptive join.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    records = pages.select(
        F.col(page).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"),
        body.alias("payload"),
        F.sha1(F.encode(body, "UTF-8")).alias("digest"),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )
    repeated = (
        records.where(F.col("n_bytes") >= min_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.max("page_id").alias("first_page"), F.count("*").alias("n"))
        .where("n > 1 AND first_page IS NOT NULL")
        .drop("n")
    )
    joined = records.join(repeated, ["digest", "n_bytes"], "left")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("first_page")), F.col("first_page"))
    return joined.select("page_id", "url", "payload", "digest", "n_bytes", refers.alias("refers_to")).withColumn(
        "payload", F.when(F.col("refers_to").isNull(), F.col("payload"))
    )


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def render(page_id: int | None, url: str | None, payload: str | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One record: version, headers, blank line, block, two line ends."""
    body = b"" if refers_to is not None else (payload or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + len(body)),
        "WARC-X-Payload-Length": str(n_bytes),
    }
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe="".join(map(chr, range(33, 127))))
    if page_id is not None:
        headers["WARC-X-Page-ID"] = str(page_id)
    if refers_to is not None:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To"] = record_id(refers_to)
        headers["WARC-X-Refers-To-Page-ID"] = str(refers_to)
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return head.encode() + http + body + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from records spread over the archive; where they are too few to train one, their own beginning."""
    total = sum(map(len, records))
    every = max(1, total // SAMPLE_BYTES)
    samples = [r[: 128 << 10] for r in records[::every]]
    try:
        return zstandard.train_dictionary(
            min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 16)), samples, k=512, d=8
        )
    except zstandard.ZstdError:
        plain = b"".join(samples)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(plain, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = 3, with_dictionary: bool = True) -> Iterator[bytes]:
    """The frames of an archive: the dictionary's, if it has one, then one per record."""
    found = dictionary(records) if with_dictionary else None
    if found:
        data = zstandard.ZstdCompressor(level=19).compress(found.as_bytes())
        yield struct.pack("<II", DICTIONARY_FRAME, len(data)) + data
    packer = zstandard.ZstdCompressor(level=level, dict_data=found, write_checksum=True, write_content_size=True)
    for record in records:
        yield packer.compress(record)


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    found, at = None, 0
    if data[:4] == struct.pack("<I", DICTIONARY_FRAME):
        size = struct.unpack_from("<I", data, 4)[0]
        found, at = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=found)
    view = memoryview(data)
    while at < len(data):
        # Bit by bit, as what follows a frame is copied.
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + READ_BYTES]
            if not piece:
                raise ValueError("an archive ends inside a record")
            parts.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(parts)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``payload_records`` as archives below ``folder``; returns the manifest (archive, n_records, n_bytes)."""
    worker_path(records)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            n = 0
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for frame in archive(held):
                    out.write(frame)
                    n += len(frame)
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([n], pa.int64())],
                ["archive", "n_records", "n_bytes"],
            )

        for batch in batches:
            names = ("page_id", "url", "payload", "digest", "n_bytes", "refers_to")
            for i in range(len(batch)):
                held.append(render(*(batch.column(c)[i].as_py() for c in names)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return cut_lineage(records.mapInArrow(run, "archive string, n_records long, n_bytes long"))


READ = "archive string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload string"


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the manifested archives; a response's digest is taken of its payload and checked."""
    worker_path(manifest)
    columns = [c.split()[0] for c in READ.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as file:
                    data = file.read()
                rows = []
                for record in unpack(data):
                    headers, payload = parse(record)
                    stored = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    kind = headers["WARC-Type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != stored:
                        raise ValueError(f"{name}: a payload differs from its digest")
                    page, refers = headers.get("WARC-X-Page-ID"), headers.get("WARC-X-Refers-To-Page-ID")
                    rows.append(
                        {
                            "archive": name,
                            "page_id": None if page is None else int(page),
                            "url": headers.get("WARC-Target-URI"),
                            "record_type": kind,
                            "refers_to": None if refers is None else int(refers),
                            "payload_digest": stored,
                            "payload_bytes": int(headers["WARC-X-Payload-Length"]),
                            "payload": payload.decode() if kind == "response" else None,
                        }
                    )
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return manifest.repartition(_tasks(manifest)).mapInArrow(run, READ).select(*columns)


def _tasks(manifest: DataFrame) -> int:
    """How many tasks read the archives: by their bytes, and enough for all cores where there are so many archives.

    A number that is asked for stays; by key, the few bytes of the manifest itself would make one task of it.
    """
    n, size = manifest.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    cores = manifest.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n, max(cores, -(-size // TASK_BYTES))))


_KINDS = {"string": pa.string(), "long": pa.int64()}
_ARROW = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in READ.split(", ")])


def archive_folder(df: DataFrame) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(df.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
