from __future__ import annotations

import hashlib
import random
from pathlib import Path

import pytest
from helpers import clashing, rows_of

from factloom.llm import warc as op

SCHEMA = "page_id long, url string, html string"
ROWS = [
    (1, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (3, None, "<p>same</p>"), (4, "http://c/\r\nX: y", "other"),
    (5, "u", None), (6, "u", ""), (None, "u", "only null ids"), (None, "u", "only null ids"), (None, "u", "<p>same</p>"),
    (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x8b\x08 inside"), (8, "u", "é" * 100_000), (9, "u", "twice"), (9, "u", "twice"),
]


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        top = max((i for i, _, h in rows if (h or "") == (html or "") and i is not None), default=None)
        revisit = top is not None and page_id != top and len(raw) >= least
        kind = "revisit" if revisit else "response"
        out.append((page_id, len(raw), op.digest32(raw), kind, top if revisit else None))
    return sorted(out, key=repr)


NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_round_trip(spark):
    for least, size in ((0, op.ARCHIVE_BYTES), (8, 200)):
        pages = clashing(spark.createDataFrame(ROWS, SCHEMA).repartition(3))
        archives = op.write_archives(pages, op.archive_folder(spark), least, size)
        paths = [r.archive for r in archives.collect()]
        found = op.read_archives(spark.createDataFrame([(p,) for p in [*paths, paths[0], None]], "archive string"))
        assert found.where("kind = 'gap'").count() == 0
        assert rows_of(found, *NAMES) == expected(ROWS, least)
        payloads = {r.page_id: bytes(r.payload) for r in found.where("record_type = 'response'").collect()}
        assert payloads[8] == ("é" * 100_000).encode() and payloads[7] == ROWS[9][2].encode()


def test_empty_table(spark):
    archives = op.write_archives(spark.createDataFrame([], SCHEMA), op.archive_folder(spark))
    assert op.read_archives(archives).collect() == []


def records(count=20, seed=1):
    draw = random.Random(seed)
    texts = [bytes(draw.randrange(256) for _ in range(draw.randint(0, 400))) for _ in range(count)]
    return [op.record_bytes(i, f"u{i}", raw, None, op.digest32(raw), False) for i, raw in enumerate(texts)]


def salvaged(data):
    """Ids of the records found, after checking that records and gaps cover the file without overlap."""
    at, ids = 0, []
    seen = set()
    for row in op.salvage("x", data):
        row = dict(zip(op.COLUMNS, row, strict=True))
        if row["kind"] == "record":
            ids.append(row["page_id"])
        if (row["offset"], row["length"]) not in seen:
            assert row["offset"] == at
            at += row["length"]
            seen.add((row["offset"], row["length"]))
    assert at == len(data)
    return ids


def test_salvage_of_damaged_archives():
    draw = random.Random(9)
    for packed in (True, False):
        parts = [op.member(r) if packed else r for r in records()]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        whole = b"".join(parts)
        assert salvaged(whole) == list(range(20))
        for _ in range(60):
            hit = draw.randrange(20)
            data = bytearray(whole)
            place = starts[hit] + draw.randrange(len(parts[hit]))
            data[place] ^= 0xFF
            found = salvaged(bytes(data))
            # A flipped byte may leave a record valid (header flags, names); it never costs another one.
            assert [i for i in range(20) if i != hit] == [i for i in found if i not in (hit, None)]
        # Cut out the middle of a record, put rubbish between two, cut off the end.
        cut = whole[: starts[5] + 30] + whole[starts[6] - 10 :]
        assert salvaged(cut) == [i for i in range(20) if i != 5]
        assert salvaged(whole[: starts[3]] + b"\x1f\x8b\x08rubbish WARC/1.1\r\n" * 7 + whole[starts[3] :]) == list(range(20))
        assert salvaged(whole[:-20]) == list(range(19))
    assert salvaged(b"") == [] and salvaged(b"no archive") == []


def test_wrong_digest_is_quarantined():
    good, bad = records(2)
    bad = bad.replace(b"WARC-Block-Digest: sha1:", b"WARC-Block-Digest: sha1:X", 1)
    rows = list(op.salvage("x", op.member(good) + op.member(bad) + op.member(good)))
    assert [r[3] for r in rows] == ["record", "gap", "record"] and rows[1][4] == "block digest differs"
    mixed = op.member(good) + good + op.member(good + good)
    assert [r[3] for r in op.salvage("x", mixed)] == ["record"] * 4
    assert hashlib.sha1(b"").hexdigest() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_records_of_a_damaged_member_are_kept():
    """One wrong digest, a flipped byte or a cut costs the records it hits, not the others of their member."""
    parts = records()
    place = parts[7].index(b"sha1:") + 5
    bad = parts[7][:place] + b"!" + parts[7][place + 1 :]
    whole = op.member(b"".join([*parts[:7], bad, *parts[8:]]))
    rows = list(op.salvage("x", op.member(parts[0]) + whole + parts[1]))
    assert [r[6] for r in rows if r[3] == "record"] == [0, *[i for i in range(20) if i != 7], 1]
    gap = next(r for r in rows if r[3] == "gap")
    start = sum(map(len, parts[:7]))
    assert gap[1:3] == rows[1][1:3] and f"bytes {start} to {start + len(bad)} of the member" in gap[4]
    assert salvaged(whole) == [i for i in range(20) if i != 7]

    for level in (0, 3):
        packed = op.member(b"".join(parts), level)
        cut = packed[: len(packed) // 2]
        kept = salvaged(cut)
        assert 7 <= len(kept) <= 11 and kept == list(range(len(kept)))
        assert salvaged(cut + op.member(parts[0]) + parts[1])[-2:] == [0, 1]
        # The trailer's check sum alone is wrong: all records agree with their digests.
        assert salvaged(packed[:-8] + bytes([packed[-8] ^ 1]) + packed[-7:] + op.member(parts[3])) == [*range(20), 3]
        draw = random.Random(level)
        for _ in range(40):
            data = bytearray(packed)
            data[draw.randrange(len(packed) // 2, len(packed))] ^= 0xFF
            kept = [i for i in salvaged(bytes(data) + op.member(parts[0])) if i is not None]
            assert kept[:6] == list(range(6)) and kept[-1] == 0


def test_unreadable_header_values_are_gaps():
    revisit = op.record_bytes(4, "u", b"payload", 3, op.digest32(b"payload"), True)
    good = records(1)[0]
    for old, new in (
        (b"X-Payload-Length: 7", b"X-Payload-Length: x"), (b"X-Payload-Length: 7", b"X-Payload-Length: -7"),
        (b"Content-Length: ", b"Content-Length: \xc2\xb2"), (b"Content-Length: ", b"Content-Length: " + b"9" * 5000),
        (b"<urn:page:3>", b"<urn:page:x>"), (b"<urn:page:4>", b"<urn:page:" + b"9" * 30 + b">"),
    ):
        assert old in revisit
        broken = revisit.replace(old, new)
        for data in (good + broken + good, op.member(good) + op.member(broken) + op.member(good), op.member(good + broken + good)):
            assert [r[3] for r in op.salvage("x", data)] == ["record", "gap", "record"]


def test_attempts_never_share_a_file(tmp_path):
    """A second attempt of a task writes files of its own; what it finds committed stays whole."""
    first = op._store(f"file://{tmp_path}", "part-000000-000000", b"one")
    second = op._store(f"file://{tmp_path}", "part-000000-000000", b"two")
    assert first != second and op.load(first) == b"one" and op.load(second) == b"two"


def test_query_fails_on_a_damaged_archive(spark, sf_dir, monkeypatch):
    from factloom.llm import queries

    monkeypatch.setattr(queries.warc, "write_archives", _cut(queries.warc.write_archives))
    with pytest.raises(Exception, match="unreadable part of an archive"):
        queries.QUERIES["op10_warc"](spark, sf_dir).count()


def _cut(write):
    def run(pages, folder, *args):
        written = [(r.archive,) for r in write(pages, folder, *args).collect()]
        paths = pages.sparkSession.createDataFrame(written, "archive string")
        file = Path(paths.first().archive.removeprefix("file://"))
        file.write_bytes(file.read_bytes()[:200])
        return paths

    return run
