"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

The writer makes gzip archives with one member per record, each task its own files
in the shared folder. The reader checks every member and record. Where a check
fails it searches for the next valid gzip member or version line, goes on there,
and reports the bytes in between as a gap. The same is done with the inflated bytes
of a member, also with those in front of the place where a broken one fails.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, objects, pick
from factloom.operators.skew import key_lookup
from factloom.session import scratch_path

VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
GZIP_START = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
# A task starts a new archive when one has reached this many compressed bytes.
ARCHIVE_BYTES = 8 << 20
LEVEL = 3

RECORDS = (
    "archive string, offset long, length long, kind string, reason string, record_type string, page_id long,"
    " url string, refers_to long, payload_digest string, payload_bytes long, payload binary"
)
COLUMNS = [part.split()[0] for part in RECORDS.split(", ")]


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to, digest: str, revisit: bool) -> bytes:
    """One WARC record. A revisit holds the HTTP head only and names the record it repeats."""
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Target-URI": re.sub(r"[\r\n]+", " ", url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{digest32(block)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{'' if refers_to is None else refers_to}>"}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _store(folder: str, name: str, data: bytes) -> str:
    """Write a file of this attempt's own. Only paths that a task's committed rows name are read; others are left over."""
    from pyarrow import fs

    path = f"{folder}/{name}-{uuid.uuid4().hex}.warc.gz"
    system, place = fs.FileSystem.from_uri(path)
    with system.open_output_stream(place, compression=None) as out:
        out.write(data)
    return path


def load(path: str) -> bytes:
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, compression=None) as source:
        return source.read()


def plan_records(pages: DataFrame) -> DataFrame:
    """Adds which page a page repeats: ``digest`` (hex SHA-1), ``refers_to`` and ``revisit``.

    Of equal payloads, the largest page_id is the response. Only digests that occur
    twice are joined back; the list is broadcast if small, else hot digests are split.
    """
    payload = F.coalesce("html", F.lit(""))
    hashed = pick(pages, "page_id", "url", "html").withColumn("digest", F.sha1(payload.cast("binary")))
    repeated = (
        hashed.groupBy("digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("response_id").isNotNull())
        .drop("n")
    )
    known = key_lookup(hashed, repeated, ["digest"], "left", "page_id")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return known.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("response_id")))


def write_archives(pages: DataFrame, folder: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page into archives below ``folder``; gives the archives' paths.

    A null html is an empty payload. Payloads shorter than ``min_payload`` are
    always responses. Rows that share the largest page_id of their payload are all
    written as responses. Without any page_id, equal payloads are all responses.
    """
    bounded_batches(pages.sparkSession)
    planned = plan_records(pages).select("page_id", "url", "html", "refers_to", "revisit")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        paths = []

        def flush():
            nonlocal number, held, size
            if held:
                paths.append(_store(folder, f"part-{part:06d}-{number:06d}", b"".join(held)))
                number, held, size = number + 1, [], 0

        for batch in batches:
            for page_id, url, html, refers_to, revisit in batch.itertuples(index=False, name=None):
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                own = None if pd.isna(page_id) else int(page_id)
                to = None if pd.isna(refers_to) else int(refers_to)
                again = bool(revisit) and len(payload) >= min_payload
                url = url if isinstance(url, str) else ""
                held.append(member(record_bytes(own, url, payload, to, digest32(payload), again)))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
            flush()
            yield pd.DataFrame({"archive": objects(list(paths))})
            paths.clear()

    from pyspark.sql.types import LongType

    ids = {f.name: f.dataType for f in planned.schema.fields}
    if not isinstance(ids["page_id"], LongType):
        planned = planned.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
    return planned.mapInPandas(run, "archive string")


class Damage(ValueError):
    """A record or member that fails a check."""


def _number(text: str, name: str) -> int:
    """A header value as a number that fits a long; Damage if it is none."""
    if not re.fullmatch(r"-?[0-9]{1,19}", text) or not -(1 << 63) <= int(text) < 1 << 63:
        raise Damage(f"unreadable {name}")
    return int(text)


def parse_record(data: bytes, start: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record at ``start``; raises Damage if a check fails."""
    version = VERSION_LINE.match(data, start)
    if not version:
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", start)
    if end < 0:
        raise Damage("headers without end")
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("malformed header")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = _number(headers.get("content-length", ""), "content length")
    block_at, after = end + 4, end + 4 + length
    if data[after : after + 4] != b"\r\n\r\n":
        raise Damage("block does not end where its length says")
    block = data[block_at:after]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest32(block):
        raise Damage("block digest differs")
    return headers, block, after + 4


def _row(archive: str, offset: int, length: int, headers: dict, block: bytes) -> tuple:
    kind = headers.get("warc-type", "")
    payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
    stated = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        digest, size, payload = stated, _number(headers.get("x-payload-length", "0"), "payload length"), None
        if size < 0:
            raise Damage("unreadable payload length")
    else:
        digest, size = digest32(payload), len(payload)
        if stated and stated != digest:
            raise Damage("payload digest differs")

    def page(name: str):
        """The id of a page; null if the header names none or something else than a page."""
        value = headers.get(name, "")
        if not value.startswith("<urn:page:") or value == "<urn:page:>":
            return None
        if not value.endswith(">"):
            raise Damage(f"unreadable {name}")
        return _number(value[len("<urn:page:") : -1], name)

    url = headers.get("warc-target-uri", "")
    return (
        archive, offset, length, "record", None, kind, page("warc-record-id"), url, page("warc-refers-to"), digest, size,
        payload,
    )


def _records_of(content: bytes, sure: bool) -> list[tuple[int, int, tuple | str]]:
    """Start, end and either a record (its row from ``kind`` on) or the reason of a gap for all parts of a member's bytes.

    Where the member failed its own check (not ``sure``), a record counts only if it has a
    digest, since nothing else tells whether its bytes are right.
    """
    parts, at, bad_from, reason = [], 0, -1, ""
    while at < len(content):
        try:
            headers, block, end = parse_record(content, at)
            found = _row("", 0, 0, headers, block)[3:]
            if not sure and not headers.get("warc-block-digest", "").startswith("sha1:"):
                raise Damage("no digest in a broken member")
        except Damage as damage:
            if bad_from < 0:
                bad_from, reason = at, str(damage)
            line = VERSION_LINE.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if bad_from >= 0:
            parts.append((bad_from, at, reason))
            bad_from = -1
        parts.append((at, end, found))
        at = end
    if bad_from >= 0:
        parts.append((bad_from, len(content), reason))
    return parts


def _member_rows(archive: str, view: memoryview, at: int) -> tuple[list[tuple], int, str]:
    """Rows of the member at ``at``, the end of its bytes, and why the bytes behind these are a gap, if they are.

    A part that cannot be read is a gap with the member's place, as its records have; the
    reason names the inflated bytes. A broken member ends with its last valid
    record: the search goes on in the file behind the bytes that gave it. Damage if
    there is no valid record.
    """
    content, end, failed = _member_at(view, at)
    parts = _records_of(content, not failed or failed == CUT_OFF)
    if failed:
        # A member that was cut off may have run into the next one, whose bytes are then a gap in it.
        into = (i for i, (low, high, found) in enumerate(parts) if isinstance(found, str) and _hides_member(view, at, low, high))
        parts = parts[: next(into, len(parts))]
    good = [i for i, part in enumerate(parts) if not isinstance(part[2], str)]
    if not good:
        raise Damage(failed or (parts[0][2] if parts else "empty member"))
    if failed:
        parts = parts[: good[-1] + 1]
        end = _reached(view, at, parts[-1][1])
    rows = []
    for low, high, found in parts:
        if isinstance(found, str):
            rows.append(_gap(archive, at, end, f"{found} (inflated bytes {low} to {high} of the member)"))
        else:
            rows.append((archive, at, end - at, *found))
    return rows, end, failed


def salvage(archive: str, data: bytes) -> Iterator[tuple]:
    """Rows of all valid records and of the gaps between them, in the order of the file.

    Reads gzip members and plain records, also mixed. Records and gaps together cover
    the file. Gaps never overlap a record, but for those inside a member, which have the
    member's place.
    """
    at, bad_from, reason = 0, -1, ""
    view = memoryview(data)
    while at < len(data):
        try:
            if data[at : at + 3] == GZIP_START:
                found, end, failed = _member_rows(archive, view, at)
            else:
                failed = ""
                headers, block, end = parse_record(data, at)
                found = [_row(archive, at, end - at, headers, block)]
        except Damage as damage:
            if bad_from < 0:
                bad_from, reason = at, str(damage)
            at = _next_start(data, at + 1)
            continue
        if bad_from >= 0:
            yield _gap(archive, bad_from, at, reason)
            bad_from = -1
        yield from found
        at = end
        if failed and at < len(data):
            bad_from, reason = at, failed
            at = _next_start(data, at)
    if bad_from >= 0:
        yield _gap(archive, bad_from, len(data), reason)


def _hides_member(view: memoryview, at: int, low: int, high: int) -> bool:
    """Whether the bytes that gave the inflated bytes ``low`` to ``high`` of a member start a whole member with records."""
    start, stop = _reached(view, at, low), _reached(view, at, high)
    while 0 <= (start := view.obj.find(GZIP_START, start, stop)):
        content, _, failed = _member_at(view, start)
        if not failed and any(not isinstance(found, str) for _, _, found in _records_of(content, True)):
            return True
        start += 1
    return False


CUT_OFF = "gzip member is cut off"


def _member_at(view: memoryview, at: int, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """The inflated bytes of a member, its end, and why it is broken, if it is.

    It is fed piece by piece, so that the rest of the file is not copied; the piece where it
    breaks is fed again in smaller ones, since an error takes the bytes in front of it along.
    """
    unpacker, parts, place = zlib.decompressobj(31), [], at
    while place < len(view) and not unpacker.eof:
        piece = view[place : place + step]
        before = unpacker.copy() if parts else None
        try:
            parts.append(unpacker.decompress(piece))
            place += len(piece)
        except zlib.error as error:
            if step == 1:
                return b"".join(parts), place, f"gzip member: {error}"
            unpacker, step = before or zlib.decompressobj(31), max(1, step >> 8)
    if not unpacker.eof:
        return b"".join(parts), place, CUT_OFF
    return b"".join(parts), place - len(unpacker.unused_data), ""


def _reached(view: memoryview, at: int, size: int, step: int = 1 << 16) -> int:
    """Where the bytes of the member at ``at`` end that inflate to its first ``size`` bytes."""
    unpacker, place, got = zlib.decompressobj(31), at, 0
    while got < size:
        before = unpacker.copy()
        try:
            more = len(unpacker.decompress(view[place : place + step]))
        except zlib.error:
            more = size
        if step > 1 and got + more >= size:
            unpacker, step = before, step >> 8
            continue
        place, got = place + step, got + more
    return place


def _next_start(data: bytes, at: int) -> int:
    """The next place that looks like a gzip member or a version line; the end of the file if there is none."""
    member_at = data.find(GZIP_START, at)
    line = VERSION_LINE.search(data, at)
    places = [place for place in (member_at, line.start() if line else -1) if place >= 0]
    return min(places, default=len(data))


def _gap(archive: str, start: int, end: int, reason: str) -> tuple:
    return (archive, start, end - start, "gap", reason, None, None, None, None, None, None, None)


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records and gaps of the archives whose paths are given in column ``archive``.

    ``kind`` is ``record`` or ``gap``; a gap has offset, length and reason. The digest and
    size of a response are those of the payload read; a revisit has them from its
    headers. Null and repeated paths: null is skipped, a repeated path is read
    once. An empty file has no rows; a file without any valid record is one gap.
    Each archive is one task's work, one at a time in memory.
    """
    bounded_batches(archives.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["archive"]:
                rows, size = [], 0
                for row in salvage(path, load(path)):
                    size += len(row[-1] or b"") if keep_payload else 1
                    rows.append(row if keep_payload else (*row[:-1], None))
                    if size > 4 << 20 or len(rows) >= 10_000:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    paths = pick(archives, "archive").where(F.col("archive").isNotNull()).distinct()
    # A path is tiny but its file is not: without a number, small partitions would be merged into one task.
    return paths.repartition(max(1, archives.count()), "archive").mapInPandas(run, RECORDS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    for name in ("page_id", "refers_to", "payload_bytes", "offset", "length"):
        frame[name] = frame[name].astype("Int64")
    return frame


def archive_folder(spark) -> str:
    """A new folder for archives below the shared folder, as a URI that every task can open."""
    from pyarrow import fs

    path = scratch_path(spark, "warc")
    folder = path if "://" in path or path.startswith("file:") else f"file://{path}"
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    return folder
