"""WARC archives: writing, and normalising of files that are one gzip stream.

The normaliser inflates each file once as a stream, rewrites every record as a gzip member
of its own and writes a sidecar index of offsets, by which later reads are split and start
at any record. Memory holds a chunk of a stream, never a file.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import NO_ID, id_back, id_key, map_groups, slices
from docweave.session import ensure_checkpoint_dir, store

CHUNK = 1 << 20
#: Uncompressed bytes after which a writer begins a new file, and compressed bytes of a read split.
FILE_BYTES, SPLIT_BYTES = 128 << 20, 16 << 20
LEVEL = 5


def shared_folder(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Inflated:
    """Forward reader of gzip data with any number of members."""

    def __init__(self, raw):
        self.raw, self.z, self.buffer, self.rest = raw, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        data = self.rest or self.raw.read(CHUNK)
        if not data:
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(data, CHUNK)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def head(self) -> dict[str, str] | None:
        """Headers of the next record, None at the end of the file."""
        while (end := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.buffer.strip():
                    raise ValueError("the archive ends inside of a record head")
                return None
        lines = self.buffer[:end].decode("utf-8").split("\r\n")
        self.buffer = self.buffer[end + 4 :]
        return dict(x.split(": ", 1) for x in lines if ": " in x)

    def body(self, n: int):
        while n:
            if not self.buffer and not self.more():
                raise ValueError("the archive ends inside of a record")
            part, self.buffer = self.buffer[:n], self.buffer[n:]
            n -= len(part)
            yield part


def _head(fields: dict[str, str]) -> bytes:
    clean = (f"{k}: {''.join(c if c >= ' ' else '%%%02X' % ord(c) for c in v)}" for k, v in fields.items())
    return ("WARC/1.1\r\n" + "\r\n".join(clean) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def write_monolithic(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a response record per page, each file one gzip stream, without a shuffle.

    Returns a stored table (path, ordinal, page_id, payload_digest, payload_bytes); files of
    failed attempts are not in it. Null html is an empty payload, a null url no target.
    """

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, size, ordinal = None, "", 0, 0
        for batch in slices(batches, 200):
            rows = []
            for page, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                    out, z, size, ordinal = fs.open_output_stream(path, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                payload = payload or b""
                digest = hashlib.sha256(payload).hexdigest()
                http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
                fields = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{page}>", "WARC-Date": "1970-01-01T00:00:00Z"}
                fields |= {"WARC-Target-URI": url} if url is not None else {}
                fields |= {"WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)), "Content-Type": "application/http;msgtype=response"}
                fields |= {"Content-Length": str(len(http) + len(payload))}
                for part in (_head(fields), http, payload, b"\r\n\r\n"):
                    out.write(z.compress(part))
                    size += len(part)
                rows.append((path, ordinal, page, digest, len(payload)))
                ordinal += 1
                if size > file_bytes:
                    out.write(z.flush())
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "ordinal", "page_id", "payload_digest", "payload_bytes"])
        if out is not None:
            out.write(z.flush())
            out.close()

    chosen = pages.select(id_key("page_id").alias("page_id"), F.col("url").cast("string"), F.col("html").cast("binary"))
    ddl = "path string, ordinal bigint, page_id bigint, payload_digest string, payload_bytes bigint"
    return store(chosen.mapInArrow(run, ddl), "warc-records")


def revisits(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Records with ``refers_to``: the smallest page with an equal payload, else null.

    Rows that share the smallest id all stay responses. Rows without an id can be referred to
    by none: they revisit the smallest id, and stay responses where there is none. The minima
    combine map-side.
    """
    known = records.where((F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != NO_ID))
    first = known.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    refers = F.when(F.col("first") != F.col("page_id"), F.col("first"))
    return records.join(first, "payload_digest", "left").select("path", "ordinal", refers.alias("refers_to"))


def normalise(plan: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrite every record of the planned files as a gzip member of its own in ``target``.

    ``plan`` has a row (path, ordinal, refers_to) per record; those that refer to a page
    become revisits without a payload. Other files than responses of ``write_monolithic``
    need one row each with a null ``ordinal``. Beside each archive lies ``<archive>.idx.gz``
    with a JSON line per record. Returns the stored index (path, ordinal, offset, length).
    """
    schema = pa.schema([("path", pa.string()), ("ordinal", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])

    def rewrite(key, rows):
        fs, base = pafs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        refers = dict(zip(rows["ordinal"].to_pylist(), rows["refers_to"].to_pylist(), strict=True))
        path, at, index = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, []
        with fs.open_input_stream(key[0], compression=None) as raw, fs.open_output_stream(path, compression=None) as out:
            stream = Inflated(raw)
            while (fields := stream.head()) is not None:
                size, body = int(fields["Content-Length"]), None
                if (page := refers.get(len(index))) is not None:
                    length = int(fields["X-Payload-Length"])
                    http = b"".join(stream.body(size - length))
                    for _ in stream.body(length):
                        pass
                    fields |= {"WARC-Type": "revisit", "WARC-Refers-To": f"<urn:page:{page}>", "Content-Length": str(len(http))}
                    fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    body = [http]
                z, begin = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), at
                for part in (_head(fields), *([] if body is None else body)):
                    at += out.write(z.compress(part))
                for part in stream.body(size) if body is None else ():
                    at += out.write(z.compress(part))
                at += out.write(z.compress(b"\r\n\r\n") + z.flush())
                for part in stream.body(4):
                    if part.strip(b"\r\n"):
                        raise ValueError("a record does not end where its length says")
                index.append({"offset": begin, "length": at - begin, "id": fields.get("WARC-Record-ID"), "type": fields.get("WARC-Type")})
        with fs.open_output_stream(path + ".idx.gz", compression=None) as side:
            side.write(gzip.compress("".join(json.dumps(x) + "\n" for x in index).encode(), LEVEL, mtime=0))
        return [path] * len(index), list(range(len(index))), [x["offset"] for x in index], [x["length"] for x in index]

    archives = plan.select("path").distinct().count()
    ddl = "path string, ordinal bigint, offset bigint, length bigint"
    return store(map_groups(plan, ["path"], rewrite, schema, ddl, parts=max(1, archives)), "warc-index")


RECORD = "page_id bigint, url string, record_type string, refers_to bigint, declared_digest string, declared_bytes bigint, payload binary"


def read_records(index: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of normalised archives; each task inflates the members of one stretch of a file."""
    types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in RECORD.split(", ")])

    def page(value):
        return int(value[10:-1]) if value else None

    def read(key, rows):
        fs, _ = pafs.FileSystem.from_uri(folder)
        out = []
        with fs.open_input_file(key[0]) as raw:
            for offset, length in sorted(zip(rows["offset"].to_pylist(), rows["length"].to_pylist(), strict=True)):
                raw.seek(offset)
                stream = Inflated(pa.BufferReader(raw.read(length)))
                f = stream.head()
                body = b"".join(stream.body(int(f["Content-Length"])))
                payload = body.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                out.append((page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), f["WARC-Type"], page(f.get("WARC-Refers-To")), f["WARC-Payload-Digest"][7:], int(f["X-Payload-Length"]), payload))
        return [list(c) for c in zip(*out, strict=True)]

    split = F.floor(F.col("offset") / F.lit(split_bytes)).cast("long").alias("split")
    stretches = index.select("path", split).distinct().count()
    return map_groups(index.select("path", split, "offset", "length"), ["path", "split"], read, schema, RECORD, rows=500, parts=max(1, stretches))


def archive_pages(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Write, normalise and read back all pages; no payload goes through a shuffle.

    A record per row, repeated rows and null ids included; other columns are ignored; an
    empty table gives no archive and no row.
    """
    spark = pages.sparkSession
    source, target = shared_folder(spark, "warc-source"), shared_folder(spark, "warc")
    plan = revisits(write_monolithic(pages, source), least_bytes)
    index = normalise(plan, source, target)
    fs, base = pafs.FileSystem.from_uri(source)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)  # the normalised archives are complete
    read = read_records(index, target)
    return read.withColumns({c: id_back(c) for c in ("page_id", "refers_to")})
