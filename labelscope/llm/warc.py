"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

``write`` puts a record per page into archives of bounded size in a shared folder, each
task its own; equal payloads are stored once, as the response of the smallest page id,
and referred to by revisit records. ``read`` opens archives from any store, loads the
dictionary, decodes frame by frame in bounded memory, and validates headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import Batches, by_slices, stored
from labelscope.operators.joins import hot_hashes, lookup_join
from labelscope.session import shared_folder

ARCHIVE_BYTES = 64 << 20  # compressed; a new archive begins beyond
_SAMPLE_BYTES = 1 << 20  # of a task's first records, for its dictionary
_DICTIONARY_BYTES = 32 << 10
_READ = 1 << 20
# Fixed values of the formats.
_SKIPPABLE = 0x184D2A5D
_ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
_DICT_MAGIC = b"\x37\xa4\x30\xec"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"  # the tables hold no time of capture
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(uri: str) -> str:
    """A header cannot hold white space or control characters: they are percent-encoded."""
    return "".join(c if "!" <= c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in uri)


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to`` given) holds the response's headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (payload or b"")
    name = "none" if page_id is None else str(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; ``error`` says what is wrong with it, if anything."""
    out: dict = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "error"))
    try:
        head, mark, rest = data.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not mark or first not in ("WARC/1.0", "WARC/1.1"):
            raise ValueError("no record header")
        headers = {}
        for line in lines:
            name, colon, value = line.partition(":")
            if not colon or not name.strip():
                raise ValueError("a header line without a name")
            headers[name.strip().lower()] = value.strip()
        missing = [n for n in _NEEDED if n.lower() not in headers]
        if missing:
            raise ValueError(f"missing {', '.join(missing)}")
        length = int(headers["content-length"])
        if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
            raise ValueError("the block is not as long as its header says")
        block = rest[:length]
        if headers.get("warc-block-digest", "sha1:" + sha1_base32(block)) != "sha1:" + sha1_base32(block):
            raise ValueError("the block is not the one digested")
        http, mark, payload = block.partition(b"\r\n\r\n")
        fields = dict(x.lower().split(": ", 1) for x in http.decode().split("\r\n")[1:] if ": " in x)
        if not mark or "content-length" not in fields:
            raise ValueError("no response header")
        size, digest = int(fields["content-length"]), headers.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = headers["warc-type"]
        if kind == "response":
            if len(payload) != size or sha1_base32(payload) != digest:
                raise ValueError("the payload is not the one announced")
            out["payload"] = payload
        elif kind != "revisit" or payload or "warc-refers-to" not in headers:
            raise ValueError(f"a {kind} record that is neither response nor revisit")
        number = lambda uri: None if uri in (None, "<urn:page:none>") else int(uri.removeprefix("<urn:page:").removesuffix(">"))
        out |= {
            "page_id": number(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind,
            "refers_to": number(headers.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest,
        }
    except (ValueError, UnicodeDecodeError) as wrong:
        out["error"] = str(wrong) or type(wrong).__name__
    return out


# --- archives ----------------------------------------------------------------------


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; their own bytes where they are too few to train on."""
    size = min(_DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        if len(samples) >= 16 and size >= 1024:
            return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[:_DICTIONARY_BYTES]


def _as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    trained = data[:4] == _DICT_MAGIC
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(data: bytes) -> bytes:
    packed = zstandard.ZstdCompressor().compress(data)
    return struct.pack("<II", _SKIPPABLE, len(packed)) + packed


class _Archives:
    """Writes records into archives of a folder, a new one when one is full.

    An archive gets its name when it is complete, so what a lost task leaves is never read.
    """

    def __init__(self, folder: str, most: int) -> None:
        self.system, self.folder = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        self.root, self.most = folder, most
        self.system.create_dir(self.folder, recursive=True)
        self.out = None

    def add(self, data: bytes, samples: list[bytes]) -> tuple[str, int, int] | None:
        if self.out is None:
            self.name, self.written, self.records = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            self.out = self.system.open_output_stream(f"{self.folder}/_{self.name}", compression=None)
            shared = dictionary(samples)
            self.packer = zstandard.ZstdCompressor(level=3, dict_data=_as_dictionary(shared) if shared else None, write_content_size=True)
            self._put(leading_frame(shared))
        self._put(self.packer.compress(data))
        self.records += 1
        return self.close() if self.written >= self.most else None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def close(self) -> tuple[str, int, int] | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        self.system.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
        return f"{self.root}/{self.name}", self.records, self.written


def frames(stream, most: int = _READ) -> Iterator[bytes]:
    """Decoded frames of an archive, one after another, read piece by piece."""
    head = stream.read(8)
    if len(head) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != _SKIPPABLE:
        raise ValueError("the archive does not begin with a dictionary frame")
    data = stream.read(size)
    if len(data) != size:
        raise ValueError("the dictionary frame is cut off")
    shared = zstandard.ZstdDecompressor().decompress(data) if data[:4] == _ZSTD_MAGIC else data
    opener = zstandard.ZstdDecompressor(dict_data=_as_dictionary(shared)) if shared else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        one, parts = opener.decompressobj(), []
        while not one.eof:
            rest = rest or stream.read(most)
            if not rest:
                if parts or one.unused_data:
                    raise ValueError("the last frame is cut off")
                return
            if rest[:4] != _ZSTD_MAGIC and not parts and len(rest) >= 4:
                raise ValueError("a frame that is not Zstandard")
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)


# --- jobs ---------------------------------------------------------------------------


def payload_digest(payload: Column) -> Column:
    """Hex SHA-1; archives hold it in base 32."""
    return F.sha1(payload)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", smallest: int = 0, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages`` below ``folder``: a table of path, records and bytes.

    A null html is an empty payload, a null url a record without target. Of pages with equal
    payloads of at least ``smallest`` bytes, the one with the smallest id is the response and
    the others revisit it; rows that share that id are responses all. A row without an id
    revisits like any other, and is a response where no equal payload has an id. Long
    pages are one record whatever their length; an empty table writes no archive.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(html_col).cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumns({"size": F.octet_length("payload"), "digest": payload_digest(F.col("payload"))})
    digests = stored(rows.select("page_id", "size", "digest"), "digests")
    first = digests.where(F.col("size") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select("digest", "first")
    joined = lookup_join(rows, first.hint("merge"), ["digest"], "left", hot_hashes(digests, ["digest"]), spread=("page_id",))
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    ready = joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers_to"))

    def run(batches: Batches) -> Batches:
        archives, held, full = _Archives(folder, most), [], []
        samples: list[bytes] | None = None

        def put(data: bytes) -> None:
            if done := archives.add(data, samples):
                full.append(done)

        for batch in batches:
            for page_id, url, payload, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page_id, url, payload, size, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
                if samples is None:
                    held.append(data)
                    if sum(map(len, held)) >= _SAMPLE_BYTES:
                        samples = [h[:1 << 16] for h in held]
                        for h in held:
                            put(h)
                        held = []
                else:
                    put(data)
        if samples is None:
            samples = [h[:1 << 16] for h in held]
            for h in held:
                put(h)
        if done := archives.close():
            full.append(done)
        if full:
            paths, records, sizes = zip(*full, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], ["path", "records", "bytes"])

    # Stored, so that archives are written once however often the table is used.
    return stored(ready.mapInArrow(run, "path string, records bigint, bytes bigint"), "archives")


_FIELDS = "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string, error string"


def read(archives: DataFrame, path_col: str = "path", payloads: bool = True) -> DataFrame:
    """Every record of the archives named in ``path_col``, in any order.

    Columns: page_id, url, record_type, refers_to, payload (null for revisits, or where not
    asked for), payload_bytes, payload_digest, error. A record that fails validation has its
    reason in ``error`` and nothing else; an archive that cannot be read further gives one
    such row and ends there. Null paths are skipped. One task reads one archive at a time,
    frame by frame.
    """
    paths = archives.select(F.col(path_col).alias("path")).where("path IS NOT NULL")
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in _FIELDS.split(", ")])

    def records(path: str) -> Iterator[dict]:
        try:
            system, inside = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
            with system.open_input_stream(inside, compression=None) as stream:
                for data in frames(stream):
                    yield parse(data)
        except (OSError, ValueError, zstandard.ZstdError) as wrong:
            yield dict.fromkeys(names) | {"error": f"{path}: {wrong}"}

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for row in records(path):
                    size += len(row["payload"] or b"") + 200
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return paths.repartition(n).mapInArrow(run, _FIELDS)
