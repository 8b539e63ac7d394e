"""WARC archives: writing gzip members per record, and a reader that splits files.

A record is one gzip member. Reading tasks own byte ranges. A task looks for the gzip
magic in its range, takes a candidate for a record if its head decodes to a WARC header
and whole members follow it, and returns the records that start inside the range, also
where they end beyond it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldpulse.llm.common import Sealed, attach_groups, scratch_folder, settle

# Smaller payloads are never revisits.
LEAST_BYTES = 1000
# Bytes of a file that one reading task owns, and bytes read at once.
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
# Splits are dealt to so many tasks at most.
MAX_TASKS = 20_000
# More than the longest stored block of a deflate stream, which has 65,535 bytes.
CHAIN_BYTES = 1 << 17
# Records are handed on when so many bytes have come together.
_BATCH_BYTES = 4 << 20
# The start of a gzip member with deflate, and of a record in it.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = b"\r\n\r\n"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """Store and path of a URI, or of an absolute path."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri))


def _record_id(number) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def format_record(number, url, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head and no payload."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n"
    body = http.encode() + (b"" if is_revisit else payload)
    target = "" if url is None else " ".join(url.split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(number)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if is_revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    record = "\r\n".join(head).encode() + _END + body + _END
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def plan_revisits(
    pages: DataFrame, id_col: str, payload_col: str, least_bytes: int = LEAST_BYTES
) -> DataFrame:
    """The pages under neutral names with ``_payload``, and ``_refers`` to the response.

    Of equal payloads, the page with the largest id is the response. Pages with one id
    and payload are each a response if that id is the largest.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.withColumn("_payload", payload).withColumn("_digest", F.unhex(F.sha1("_payload")))
    large = F.octet_length("_payload") >= least_bytes
    prints = settle(rows.filter(large).select("_digest", F.col(id_col).alias("_number")))
    groups = settle(
        prints.groupBy("_digest")
        .agg(F.max("_number").alias("_keep"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1 AND _keep IS NOT NULL")
    )
    plain = rows.filter(~large).withColumns(
        {"_keep": F.lit(None).cast(prints.schema["_number"].dataType), "_copies": F.lit(1).cast("long")}
    )
    joined = attach_groups(rows.filter(large), groups, "_digest", "_copies", prints.count())
    again = F.col("_keep").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_keep"))
    return plain.unionByName(joined).withColumns(
        {"_again": again, "_refers": F.when(again, F.col("_keep"))}
    )


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    folder: str | None = None,
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """Write a record per page; returns (uri, bytes, records) of the files written.

    ``folder`` is a URI that driver and executors share, by default a new one in the
    scratch folder. A task writes a file under a name of its own, and only files named by
    tasks that ended well are returned, so repeated and speculative tasks do no harm. A
    null payload is empty, a null url an empty one. An empty table makes no file.
    """
    sealed = Sealed.of(pages)
    number = sealed.name(id_col)
    target = folder or scratch_folder(pages.sparkSession)
    planned = plan_revisits(sealed.frame, number, sealed.name(payload_col), least_bytes)
    rows = planned.select(number, sealed.name(url_col), "_payload", "_again", "_refers")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(target)
        name, sink, size, records = f"{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            if sink is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{name}", compression=None)
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                page, url, payload, again, refers = row
                member = format_record(page, url, payload, refers, again)
                sink.write(member)
                size, records = size + len(member), records + 1
        if sink is not None:
            sink.close()
            counts = [pa.array([n], pa.int64()) for n in (size, records)]
            columns = [pa.array([f"{target}/{name}"]), *counts]
            yield pa.RecordBatch.from_arrays(columns, ["uri", "bytes", "records"])

    return settle(rows.mapInArrow(write, "uri string, bytes long, records long"))


class _Window:
    """Bytes of a file from a place on, read forward in steps."""

    def __init__(self, source, size: int, start: int):
        self.source, self.size, self.start, self.data = source, size, start, b""

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        self.data += self.source.read(min(READ_BYTES, self.size - at))
        return True

    def at(self, place: int, length: int) -> bytes:
        while self.start + len(self.data) < place + length and self.more():
            pass
        return self.data[place - self.start : place - self.start + length]

    def drop(self, place: int) -> None:
        """Forget what lies before a place."""
        self.data, self.start = self.data[place - self.start :], place


def _member(window: _Window, place: int) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at a place, or None if there is no record."""
    if window.at(place, len(MAGIC)) != MAGIC:
        return None
    unpack, parts, at, checked = zlib.decompressobj(31), [], place, 0
    try:
        while not unpack.eof:
            chunk = window.at(at, 1 << 16)
            if not chunk:
                return None
            part = unpack.decompress(chunk)
            at += len(chunk)
            parts.append(part)
            if checked < len(VERSION):
                head = b"".join(parts)[: len(VERSION)]
                if not VERSION.startswith(head) and head != VERSION:
                    return None
                checked = len(head)
    except zlib.error:
        return None
    content = b"".join(parts)
    return (content, at - len(unpack.unused_data)) if content.startswith(VERSION) else None


def _chained(window: _Window, place: int) -> bool:
    """Whether members follow each other from a place for CHAIN_BYTES or to the file's end.

    An archive inside a payload can look like that only within one stored block of the
    record around it.
    """
    first = place
    while place < window.size and place - first < CHAIN_BYTES:
        found = _member(window, place)
        if found is None:
            return False
        place = found[1]
    return True


def records_in(source, size: int, start: int, stop: int) -> Iterator[bytes]:
    """Contents of the records that start at ``start`` or later and before ``stop``."""
    window, place, settled = _Window(source, size, start), start, start == 0
    while place < min(stop, size):
        if not settled:
            window.at(place, READ_BYTES)
            found = window.data.find(MAGIC, place - window.start)
            if found < 0:
                if window.start + len(window.data) >= size:
                    return
                place = window.start + len(window.data) - len(MAGIC) + 1
                window.drop(place)
                continue
            place = window.start + found
            if place >= stop:
                return
            if not _chained(window, place):
                place += 1
                continue
            settled = True
        found = _member(window, place)
        if found is None:
            raise ValueError(f"no record at byte {place}")
        yield found[0]
        place = found[1]
        window.drop(place)


def parse_record(content: bytes) -> dict:
    """Fields of a record: id, url, type, refers_to, digest, payload, payload_bytes."""
    head, _, rest = content.partition(_END)
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(_END)
    length = next(
        int(line.partition(b":")[2])
        for line in http.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    revisit = fields["warc-type"] == "revisit"
    digest = fields["warc-payload-digest"].partition(":")[2]
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {fields['warc-record-id']}")

    def number(text: str | None) -> int | None:
        return int(text[len("<urn:page:") : -1]) if text and text != _record_id(None) else None

    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")),
    }


_RECORD_TYPES = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def read_archives(
    files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True
) -> DataFrame:
    """The records of archives, given as (uri, bytes).

    Each file is read by as many tasks as it has splits. Ids are whole numbers. Without
    ``payloads`` that column is null, but each payload is still checked against its
    digest. A damaged record raises; no file gives no rows.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    splits = files.filter("bytes > 0").select("uri", "bytes", F.explode(starts).alias("start"))
    dealt = splits.repartition(min(max(1, splits.count()), MAX_TASKS), "uri", "start")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _RECORD_TYPES.split(", ")]
        for frame in frames:
            for split in frame.itertuples(index=False):
                store, path = _opened(split.uri)
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    stop = split.start + split_bytes
                    for content in records_in(source, int(split.bytes), int(split.start), int(stop)):
                        record = parse_record(content)
                        if not payloads:
                            record["payload"] = None
                        rows.append(record)
                        held += len(record["payload"] or b"") + 200
                        if held > _BATCH_BYTES:
                            yield _frame(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _frame(rows, names)

    return dealt.mapInPandas(read, _RECORD_TYPES)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    for name in ("page_id", "refers_to"):
        frame[name] = frame[name].astype("Int64")
    return frame


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, bytes) of the archives in a folder, for ``read_archives``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return found.select(F.col("path").alias("uri"), F.col("length").alias("bytes"))
