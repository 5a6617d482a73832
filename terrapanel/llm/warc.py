"""WARC archives: writer, monolithic gzip normaliser, indexed reader.

Archives that were compressed as one gzip stream can't be read from the
middle. ``normalise`` inflates such a file once, in a stream, rewrites every
record as a gzip member of its own and writes a sidecar offset index beside
the archive (JSON lines); ``read_records`` then opens records by their
offsets. No step holds more than one read block of a record in memory while
rewriting, and one record while reading back.

A task writes files whose names carry its attempt, and returns their names
as rows; later steps read the files that these rows name. A task that is
lost and run again, or run twice, leaves files that nobody names.
"""

from __future__ import annotations

import hashlib
import json
import socket
import zlib
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapanel.llm.common import checkpoint, scratch_path

BLOCK = 1 << 20
#: Uncompressed bytes after which the writer begins a new archive.
ROLL_BYTES = 256 << 20
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"


def _filesystem(uri: str):
    """The file system of a shared folder and the path within it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _make(spark: SparkSession, folder: str) -> str:
    """Make, in the driver, a folder that tasks write to; returns its place
    with its scheme, where it lies if it is named through a mount table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    return files.resolvePath(path).toString()


def archive_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for archives under the shared checkpoint folder, with
    its scheme: Python workers and the JVM then mean the same file system. One
    named without a scheme may well be a mount that all machines share, so no
    name is refused; each task sees for itself (``_made``)."""
    return _make(spark, scratch_path(spark, name))


def _made(folder: str):
    """As ``_filesystem``, for a folder that the driver made. A task that
    doesn't find it would write to its machine's own disk, where the others
    can't read: it is refused."""
    from pyarrow import fs

    files, base = _filesystem(folder)
    if not isinstance(files, fs.LocalFileSystem):
        files.create_dir(base, recursive=True)
    elif files.get_file_info(base).type != fs.FileType.Directory:
        raise ValueError(f"{folder}, which the driver made, isn't on {socket.gethostname()}: spark.checkpoint.dir has to be a folder that all machines share")
    return files, base


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column, in SQL functions:
    each ten hex digits (40 bits) are eight base-32 digits."""
    hex_ = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hex_, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(``id`` string, ``url``, ``payload`` binary, ``digest``, ``refers_to``
    string) of every row. Of rows with equal payloads of at least
    ``min_bytes`` bytes, the one with the largest id keeps its payload and
    the others refer to it; smaller payloads refer to none.

    A null payload is empty. A null id is no largest id unless all are null.
    Rows repeated under the largest id all keep their payload.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload")))
    light = rows.select("_id", "digest", F.octet_length("payload").alias("_bytes"))
    repeated = light.where(F.col("_bytes") >= min_bytes).groupBy("digest", "_bytes").agg(F.max("_id").alias("_last"), F.count("*").alias("_n"))
    # stored: the planner knows its size and moves no payload if it is small
    last = checkpoint(repeated.where(F.col("_n") > 1).select("digest", "_last"), "repeated-payloads")
    joined = rows.join(last, "digest", "left")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_last")), F.col("_last").cast("string"))
    return joined.select(F.col("_id").cast("string").alias("id"), "url", "payload", "digest", refers.alias("refers_to"))


def _header(text: str) -> str:
    """A header value on one line."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record(id_: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with the payload, or a revisit with the
    HTTP head alone. The head's Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URN}{id_ or ''}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{RECORD_URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    return b"".join((VERSION, b"\r\n", "\r\n".join(lines).encode(), b"\r\n\r\n", head, payload, b"\r\n\r\n"))


def write_monolithic(records: DataFrame, folder: str, *, date: str = "2000-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write the rows of ``with_revisits`` as archives of one gzip stream
    each; returns the stored list of archives (``path``, ``n_records``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, base = _made(folder)
        name, out, gz, size, done = "", None, None, 0, []
        for batch in batches:
            for id_, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, gz, size = files.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0
                    done.append([f"{folder}/{name}", 0])
                raw = record(id_, url, payload, digest, refers, date)
                out.write(gz.compress(raw))
                size += len(raw)
                done[-1][1] += 1
                if size >= ROLL_BYTES:
                    out.write(gz.flush())
                    out.close()
                    out = None
        if out is not None:
            out.write(gz.flush())
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], ["path", "n_records"])

    _make(records.sparkSession, folder)
    chosen = records.select("id", "url", "payload", "digest", "refers_to")
    return checkpoint(chosen.mapInArrow(run, "path string, n_records long"), "archives")


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or many members, block by block."""
    gz = zlib.decompressobj(wbits=31)
    while block := stream.read(BLOCK):
        while block:
            if gz.eof:
                gz = zlib.decompressobj(wbits=31)
            data = gz.decompress(block, 4 * BLOCK)
            block = gz.unused_data if gz.eof else gz.unconsumed_tail
            if data:
                yield data
    if not gz.eof:
        raise ValueError("the gzip stream is cut off")


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(head, header fields in lower case, body blocks) of each record of an
    inflated archive. The body has to be used before the next record."""
    buffer = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        if block is None:
            return False
        buffer.extend(block)
        return True

    def body(left: int) -> Iterator[bytes]:
        while left:
            if not buffer and not more():
                raise ValueError("the archive ends within a record")
            part = bytes(buffer[:left])
            del buffer[: len(part)]
            left -= len(part)
            yield part

    while True:
        while len(buffer) < 4 and more():
            pass
        if not buffer:
            return
        at = 0
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            at = max(0, len(buffer) - 3)
            if not more():
                raise ValueError("the archive ends within a header")
        head = bytes(buffer[: end + 4])
        del buffer[: end + 4]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {head[:20]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:] if x)}
        parts = body(int(fields["content-length"]))
        yield head, fields, parts
        for _ in parts:
            pass
        while len(buffer) < 4 and more():
            pass
        if buffer[:4] != b"\r\n\r\n":
            raise ValueError("a record doesn't end with two line ends")
        del buffer[:4]


def normalise(archives: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """Rewrite every archive of ``archives`` (column ``path``) record by
    record and write ``<archive>.idx`` beside it; returns the stored offset
    index: ``path``, ``offset``, ``length``, ``record_id``, ``record_type``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        files, base = _made(folder)
        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = source.rpartition("/")[2].removesuffix(".warc.gz") + f"-{attempt}.warc.gz"
                theirs, path = _filesystem(source)
                rows, offset = [], 0
                with theirs.open_input_stream(path, compression=None) as stream, files.open_output_stream(f"{base}/{name}", compression=None) as out, files.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for head, fields, parts in split_records(inflated(stream)):
                        gz, length = zlib.compressobj(level, wbits=31), 0
                        for part in (head, *parts, b"\r\n\r\n") if int(fields["content-length"]) <= BLOCK else _chain(head, parts):
                            length += out.write(gz.compress(part))
                        length += out.write(gz.flush())
                        row = {"offset": offset, "length": length, "record_id": fields.get("warc-record-id", ""), "record_type": fields.get("warc-type", "")}
                        index.write(json.dumps(row).encode() + b"\n")
                        rows.append(row)
                        offset += length
                        if len(rows) >= 10_000:
                            yield _index_batch(f"{folder}/{name}", rows)
                            rows = []
                yield _index_batch(f"{folder}/{name}", rows)

    _make(archives.sparkSession, folder)
    paths = archives.select("path").repartition(max(1, archives.count()))
    return checkpoint(paths.mapInArrow(run, "path string, offset long, length long, record_id string, record_type string"), "offset-index")


def _chain(head: bytes, parts: Iterator[bytes]) -> Iterator[bytes]:
    yield head
    yield from parts
    yield b"\r\n\r\n"


def _index_batch(path: str, rows: list[dict]) -> pa.RecordBatch:
    columns = [pa.array([path] * len(rows), pa.string())]
    columns += [pa.array([r[k] for r in rows], t) for k, t in (("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["path", "offset", "length", "record_id", "record_type"])


def read_records(index: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """Open every record of an offset index by its offset: ``id``, ``url``,
    ``record_type``, ``payload_bytes``, ``payload_digest`` (of the full
    payload; a response's is computed from what is stored and compared with
    its header), ``refers_to`` and, on request, ``payload``."""
    names = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
    schema = T.StructType([T.StructField(n, T.LongType() if n == "payload_bytes" else T.BinaryType() if n == "payload" else T.StringType()) for n in names])

    def own(urn: str | None) -> str | None:
        return None if urn is None else urn.strip("<>").removeprefix(RECORD_URN) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            rows = []
            for source, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if source != path:
                    if stream is not None:
                        stream.close()
                    files, place = _filesystem(source)
                    path, stream = source, files.open_input_file(place)
                raw = zlib.decompress(stream.read_at(length, offset), wbits=31)
                _, fields, parts = next(split_records(iter([raw])))
                head, _, payload = b"".join(parts).partition(b"\r\n\r\n")
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                kind = fields["warc-type"]
                if kind == "response" and (len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"{source} at {offset}: the payload isn't the one that was written")
                rows.append((own(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, size, digest, own(fields.get("warc-refers-to")), payload))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[: len(names)], kinds, strict=False)], names)
        if stream is not None:
            stream.close()

    return index.select("path", "offset", "length").mapInArrow(run, schema)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Write pages as monolithic archives in the shared folder, normalise
    them and read every record back through the offset index."""
    spark = pages.sparkSession
    archives = write_monolithic(with_revisits(pages, **columns), archive_folder(spark, "warc-monolithic"))
    return read_records(normalise(archives, archive_folder(spark, "warc")))
