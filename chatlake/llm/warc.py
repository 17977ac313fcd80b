"""WARC archives with a Zstandard dictionary.

Writing.  A dictionary is built from a sample of the records.  Each archive (a
``.warc.zst`` file) begins with a skippable frame that holds it, so the file can be
read by itself; every record follows as a frame of its own, compressed with the
dictionary.  An archive is cut at ``ARCHIVE_BYTES``, and an index names blocks of some
``BLOCK_BYTES``, so that reading is spread over blocks and not over files.

Of the pages with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest id is
a ``response`` record; the others are ``revisit`` records without payload that refer
to it.  Rows that share the largest id are all responses.  Equality is that of SHA-256 digests.

Recovery: a task writes archives under names of its own attempt, and the index, which
Spark commits, lists those of the attempts that counted; readers follow the index
alone, so what a lost executor leaves behind is never read.

Scale: only (digest, id) is grouped; a group's maximum combines before the shuffle.
Pages meet their group's maximum in one join, whose large keys adaptive execution splits.
The dictionary's sample is ``SAMPLE`` records of at most ``SAMPLE_RECORD`` bytes, whatever the corpus has.
A task holds one record and one block at a time.

Nulls and edge cases: a null payload is empty; a null id is kept, sorts below all others and
so is a revisit where another row of its group has an id, else a response; a null URL leaves its field out; control
characters in a URL are percent-encoded; repeated rows give a record each; an empty
table gives no archive; with too few records for a dictionary archives have no leading frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import shared_folder

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_BYTES = 4 << 20
#: Records that the dictionary is built from, the most bytes of one, and the dictionary's size.
SAMPLE, SAMPLE_RECORD, DICTIONARY = 1000, 16_384, 112_640
LEVEL = 3

# Magic number of the frame that holds the dictionary, the profile of revisits.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "archive string, offset long, length long, records long"


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record_id(page: str | None, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page, digest, url)))}>"


def _fields(pairs: list[tuple[str, str | None]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def record(page: str | None, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that refers to the page ``refers_to``."""
    digest = _digest(payload)
    head = _fields([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + (payload if refers_to is None else b"")
    uri = None if url is None else "".join(quote(c) if c <= " " or c == "\x7f" else c for c in url)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page, digest, url)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("X-Page-ID", None if page is None else quote(page, safe="")),
        ("X-Refers-To-Page-ID", None if refers_to is None else quote(refers_to, safe="")),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + _fields(fields) + b"\r\n" + block + b"\r\n\r\n"


def _info(date: str) -> bytes:
    block = b"software: chatlake\r\nformat: WARC File Format 1.1\r\n"
    return b"WARC/1.1\r\n" + _fields([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, _digest(block), date)), ("WARC-Date", date),
                                      ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + b"\r\n" + block + b"\r\n\r\n"


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def dictionary_of(read_at) -> bytes:
    """The dictionary in the leading frame of a file; empty if there is none.  ``read_at``: (length, offset) to bytes."""
    start = read_at(8, 0)
    if len(start) == 8 and struct.unpack("<II", start)[0] == DICTIONARY_MAGIC:
        return read_at(struct.unpack("<II", start)[1], 8)
    return b""


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of a decompressed stream."""
    def line() -> bytes:
        out = stream.readline()
        if not out.endswith(b"\r\n"):
            raise ValueError("the archive ends within a record's fields")
        return out[:-2]

    while version := stream.readline():
        if version != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {version[:40]!r}")
        fields = {}
        while got := line():
            name, _, value = got.decode().partition(":")
            fields[name.lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive ends within a record")
        yield fields, block


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """Page id, URL, length and hex SHA-1 of the full payload, type and the page referred to.
    The payload of a response is held against its digest."""
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"]
    if fields["warc-block-digest"] != _digest(block) or kind == "response" and _digest(payload) != digest:
        raise ValueError(f"record {fields['warc-record-id']} does not agree with its digest")
    lengths = [x.partition(b":")[2] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")]
    own = {k: unquote(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")}
    return (own["x-page-id"], fields.get("warc-target-uri"), int(lengths[0]), base64.b32decode(digest.removeprefix("sha1:")).hex(), kind,
            own["x-refers-to-page-id"])


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least: int = LEAST_REVISIT) -> DataFrame:
    """``_id``, ``_url``, ``_payload`` (binary) and ``_refers_to``: the id of the response if the row is a revisit."""
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`"), F.lit("")), "utf-8")
    d = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").alias("_url"), payload.alias("_payload"))
    key = F.when(F.octet_length("_payload") >= least, F.sha2("_payload", 256))
    groups = d.select(key.alias("_k"), "_id").where("_k IS NOT NULL").groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_top"))
    groups = groups.where("_n > 1 AND _top IS NOT NULL").select("_k", "_top")
    refers = F.when(F.col("_top").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_top")), F.col("_top"))
    return d.withColumn("_key", key).join(groups, F.col("_key") == F.col("_k"), "left").select("_id", "_url", "_payload", refers.alias("_refers_to"))


def build_dictionary(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                     date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A dictionary from a sample of the pages' records, bounded by ``SAMPLE`` and ``SAMPLE_RECORD``;
    empty if they are too few or too alike for one."""
    import zstandard

    d = pages.select(F.col(f"`{id_col}`").cast("string").alias("_id"), F.col(f"`{url_col}`").alias("_url"), F.col(f"`{payload_col}`").alias("_payload")) \
        .where(F.octet_length("_payload").between(64, SAMPLE_RECORD))
    n = d.count()
    share = min(1.0, 2 * SAMPLE / max(1, n))
    some = d.where(F.pmod(F.xxhash64("_id", "_url"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE).collect()
    raw = sorted(record(r["_id"], r["_url"], r["_payload"].encode(), None, date) for r in some)
    try:
        return zstandard.train_dictionary(DICTIONARY, raw).as_bytes() if len(raw) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", least: int = LEAST_REVISIT) -> DataFrame:
    """Write all pages into archives in ``folder`` (a URI that all executors share) and
    return the index of their blocks, which is kept there as well."""
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(build_dictionary(pages, id_col, url_col, payload_col, date))
    rows = with_revisits(pages, id_col, url_col, payload_col, least).select(
        F.col("_id").cast("string").alias("_id"), "_url", "_payload", F.col("_refers_to").cast("string").alias("_refers_to"))

    def write(batches) -> Iterator:
        import pyarrow as pa
        import zstandard

        store, path = _store(folder)
        store.create_dir(path)
        raw = shared.value
        packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
        out, index = None, []

        def close():
            nonlocal out
            if block[2]:
                index.append((name, block[0], at - block[0], block[2]))
            out.close()
            out = None

        for b in batches:
            for page, url, payload, refers in zip(*(c for c in b.columns)):
                if out is None:
                    name, at = f"pages-{uuid.uuid4().hex}.warc.zst", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    for part in (dictionary_frame(raw) if raw else b"", packer.compress(_info(date))):
                        at += out.write(part) if part else 0
                    block = [at, 0, 0]
                at += out.write(packer.compress(record(page.as_py(), url.as_py(), payload.as_py(), refers.as_py(), date)))
                block[2] += 1
                if at - block[0] >= BLOCK_BYTES:
                    index.append((name, block[0], at - block[0], block[2]))
                    block = [at, 0, 0]
                if at >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in index], kind) for k, kind in enumerate((pa.string(), *[pa.int64()] * 3))],
                                         names=["archive", "offset", "length", "records"])

    rows.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _store(folder: str):
    """The file system and path of a folder's URI (or plain path)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


PAGE = "url string, payload_bytes long, payload_digest string, record_type string"


def read_archives(spark: SparkSession, folder: str, index: DataFrame | None = None, id_type: str = "long") -> DataFrame:
    """A row for each page of the archives that the index names: ``page_id``, ``url``, ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``."""
    ship_package(spark)
    blocks = index if index is not None else spark.read.parquet(f"{folder}/index")
    blocks = blocks.repartition(spark.sparkContext.defaultParallelism * 4, "archive", "offset")

    def read(batches) -> Iterator:
        import io

        import pyarrow as pa
        import zstandard

        store, path = _store(folder)
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers"]
        for b in batches:
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(f"{path}/{archive}") as f:
                    raw = dictionary_of(f.read_at)
                    part = f.read_at(length, offset)
                reader = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}))
                stream = io.BufferedReader(reader.stream_reader(part, read_across_frames=True), 1 << 20)
                got = [page_of(fields, block) for fields, block in records(stream) if fields["warc-type"] != "warcinfo"]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], kind) for k, kind in enumerate(kinds)], names=names)

    rows = blocks.select("archive", "offset", "length").mapInArrow(read, f"page string, {PAGE}, refers string")
    return rows.select(F.col("page").cast(id_type).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
                       F.col("refers").cast(id_type).alias("refers_to"))


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """Write the pages to ``folder`` (by default a new one under the shared folder) and read them back."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    index = write_archives(pages, folder, id_col, url_col, payload_col)
    return read_archives(pages.sparkSession, folder, index, pages.select(F.col(f"`{id_col}`").alias("i")).schema["i"].dataType.simpleString())
