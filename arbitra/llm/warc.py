"""WARC archives: write, normalise to one gzip member per record with an offset index, read back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbitra.llm.common import Scratch, table
from arbitra.session import scratch_dir

# Bytes of a gzip stream that are read, inflated or copied at once.
CHUNK = 1 << 20
# Size of an archive from which a writer begins the next: one archive is one task of the normaliser.
ROLL_BYTES = 256 << 20
# Offsets of one archive that one reading task takes.
READ_SPAN = 64 << 20
LEVEL = 3

# Fixed values of the format.
GZIP = 31
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

INDEX = (
    "archive string, `offset` bigint, length bigint, record_id string, record_type string, target_uri string, "
    "payload_digest string, refers_to string"
)


def _header(value: str) -> str:
    """A header value: control characters, spaces and characters beyond ASCII are percent-encoded."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), value)


def record(page_id, url: str | None, payload: bytes, refers_to, is_revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, which tells the full length, but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = _header(url) if url else f"{URN}{page_id}"
    block = http if is_revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if is_revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("ascii") + block + CRLF + CRLF


def headers(block: bytes) -> dict[str, str]:
    """Header lines after the first, by lower-case name."""
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of one record, headers of its HTTP message, payload."""
    head, _, rest = data.partition(CRLF + CRLF)
    h = headers(head)
    http, _, payload = rest[: int(h["content-length"])].partition(CRLF + CRLF)
    return h, headers(http), payload


class Inflated:
    """A gzip stream of one or many members as bytes, read once from front to back in bounded memory."""

    def __init__(self, raw):
        self.raw, self.z, self.buf, self.open = raw, zlib.decompressobj(GZIP), bytearray(), False
        self.rest = b""

    def _fill(self) -> bool:
        data = self.rest or self.raw.read(CHUNK)
        self.rest = b""
        if not data:
            if self.open:
                raise ValueError("the gzip stream ends within a member")
            return False
        self.open = True
        self.buf += self.z.decompress(data, CHUNK)
        if self.z.eof:
            self.rest, self.z, self.open = self.z.unused_data, zlib.decompressobj(GZIP), False
        else:
            self.rest = self.z.unconsumed_tail
        return True

    def until(self, end: bytes) -> bytes | None:
        """Bytes up to and with ``end``; None at the end of the stream."""
        at = 0
        while (k := self.buf.find(end, at)) < 0:
            at = max(0, len(self.buf) - len(end))
            if not self._fill():
                if self.buf.strip():
                    raise ValueError("the stream ends within a record's header")
                return None
        return self._take(k + len(end))

    def _take(self, n: int) -> bytes:
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def copy(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.buf and not self._fill():
                raise ValueError("the stream ends within a record")
            piece = self._take(min(n, len(self.buf)))
            n -= len(piece)
            if piece:
                yield piece


def write_archives(
    rows: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES, level: int = LEVEL
) -> DataFrame:
    """Write ``rows`` (page_id, url, payload binary, refers_to, is_revisit) as whole-file gzip streams, at least one
    archive per non-empty task. Returns ``(archive, n_records)``.

    Every attempt of a task writes under fresh names, and only what a successful attempt returns is read later, so the
    result has to be stored before use. Only one record is in memory at a time.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out = z = name = None
        n = 0
        done: list[tuple[str, int]] = []

        def close():
            out.write(z.flush())
            out.close()
            done.append((name, n))

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "is_revisit")], strict=True):
                if out is not None and out.tell() >= roll_bytes:
                    close()
                    out = None
                if out is None:
                    name, n, z = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    out = fs.open_output_stream(name, compression=None)
                out.write(z.compress(record(*row, date)))
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "n_records": pa.array([x[1] for x in done], pa.int64())})

    return rows.select("page_id", "url", "payload", "refers_to", "is_revisit").mapInArrow(run, "archive string, n_records bigint")


def normalise(archives: DataFrame, folder: str, *, level: int = LEVEL, drop: bool = False) -> DataFrame:
    """Rewrite each whole-file gzip ``archive`` so that every record is a gzip member of its own, beside a sidecar index
    (``.idx``: offset, length, type, record id, URI, digest by tab). Returns the index as rows (see ``INDEX``), to be stored
    before use. An archive is inflated once as a stream; archives that already have many members are read alike. A damaged or cut stream raises. With ``drop`` the inputs are removed
    once their successors are complete, so only use it where the inputs can be written again.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for archive in b.column("archive").to_pylist():
                name, rows, at = f"{root}/{uuid.uuid4().hex}.warc.gz", [], 0
                with fs.open_input_stream(archive, compression=None) as raw, fs.open_output_stream(name, compression=None) as out, fs.open_output_stream(f"{name}.idx") as idx:
                    src = Inflated(raw)
                    while (head := src.until(CRLF + CRLF)) is not None:
                        if not (head := head.lstrip()):
                            continue  # the line ends between two records
                        h = headers(head)
                        z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        out.write(z.compress(head))
                        for piece in src.copy(int(h["content-length"])):
                            out.write(z.compress(piece))
                        out.write(z.compress(CRLF + CRLF) + z.flush())
                        end = out.tell()
                        row = (
                            name, at, end - at, h["warc-record-id"].strip("<>"), h["warc-type"], h.get("warc-target-uri"),
                            h.get("warc-payload-digest"), h.get("warc-refers-to", "").strip("<>") or None,
                        )
                        idx.write(("\t".join("" if x is None else str(x) for x in row[1:]) + "\n").encode())
                        rows.append(row)
                        at = end
                        if len(rows) >= 10_000:
                            yield _index_batch(rows)
                            rows = []
                if rows:
                    yield _index_batch(rows)
                if drop:
                    fs.delete_file(archive)

    return archives.select("archive").mapInArrow(run, INDEX)


def _index_batch(rows):
    names = ["archive", "offset", "length", "record_id", "record_type", "target_uri", "payload_digest", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


RECORD = "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to string, payload binary"


def read_records(index: DataFrame, folder: str, *, payloads: bool = True) -> DataFrame:
    """Every record of an index, each read by its offset. Returns ``RECORD`` (``payload`` null unless ``payloads``): length and
    digest are those of the payload as read, or for a revisit those that its headers tell of the full payload."""

    def run(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        name = f = None
        for b in batches:
            out = []
            for archive, offset, length in zip(*[b.column(c).to_pylist() for c in ("archive", "offset", "length")], strict=True):
                if archive != name:
                    if f is not None:
                        f.close()
                    name, f = archive, fs.open_input_file(archive)
                f.seek(offset)
                h, http, payload = parse(zlib.decompress(f.read(length), GZIP))
                kind = h["warc-type"]
                if kind == "revisit":
                    n, digest = int(http["content-length"]), h["warc-payload-digest"].partition(":")[2]
                else:
                    n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                refers = h.get("warc-refers-to")
                out.append((h["warc-record-id"].strip("<>"), kind, h.get("warc-target-uri"), n, digest, refers and refers.strip("<>"), payload if payloads else None))
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            cols = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RECORD.split(", ")])
        if f is not None:
            f.close()

    spans = index.select("archive", "offset", "length").withColumn("span", F.floor(F.col("offset") / READ_SPAN))
    dealt = spans.repartition("archive", "span").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(run, RECORD)


def mark_revisits(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, refers_to, is_revisit)``: of the pages with equal payloads of at least ``min_bytes``, that with
    the largest id is kept and the others refer to it.

    Groups are found on (id, SHA-1) alone; payloads pass one exchange, by id and digest, so a payload that a third of the pages
    share is dealt over all tasks. A null payload is empty. A null id counts as the smallest. Rows that share id and payload
    are treated alike.
    """
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    ids = rows.where(F.octet_length("payload") >= min_bytes).select("page_id", "sha").distinct()
    kept = ids.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    revisits = ids.join(kept, "sha").where("NOT (page_id <=> refers_to)").select(
        F.col("page_id").alias("r_id"), F.col("sha").alias("r_sha"), "refers_to", F.lit(True).alias("is_revisit")
    )
    return rows.join(revisits, rows["page_id"].eqNullSafe(revisits["r_id"]) & (rows["sha"] == revisits["r_sha"]), "left").select(
        "page_id", "url", "payload", "refers_to", F.coalesce("is_revisit", F.lit(False)).alias("is_revisit")
    )


def archive_and_read(pages: DataFrame, *, keep_payloads: bool = False, **columns) -> DataFrame:
    """Write pages as whole-file gzip archives, normalise these, and return every record read back through the index."""
    scratch = Scratch(pages.sparkSession)
    folder = scratch_dir(pages.sparkSession, "warc")
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    written = scratch.write(write_archives(mark_revisits(pages, **columns), f"{folder}/whole"), "warc-list")
    index = scratch.write(normalise(written.repartition(n, "archive"), f"{folder}/records"), "warc-index")
    return read_records(index, folder, payloads=keep_payloads)


def op3_warc_normalise(spark, sf: str) -> DataFrame:
    """Every page through a whole-file gzip archive, its normalised form and back."""
    got = archive_and_read(table(spark, sf, "pages"))
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("bigint")
    return got.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "target_uri"
    )
