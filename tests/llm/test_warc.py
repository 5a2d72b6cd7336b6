import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest

from scorelane.llm.common import work_path
from scorelane.llm.warc import (
    chunked, page_records, parsed, payload_of, read_archive, read_records, round_trip, unchunked, write_archive,
)

SCHEMA = "page_id bigint, url string, html string, sha string, keeper string, block string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_chunks_end_between_characters():
    for text in ("", "a", "é漢" * 5000, "0\r\n\r\n"):
        for size in (4, 5, 8192):
            framed = chunked(text.encode(), size)
            framed.decode()
            assert unchunked(framed).decode() == text
    assert unchunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_segments_are_records_of_their_own():
    payload = "text é " * 300
    texts = list(page_records("<urn:x-page:7#0-0>", "http://a", payload.encode(), sha(payload), None, 500, 64))
    stream = io.BytesIO("".join(t + "\r\n\r\n" for t in texts).encode())
    records = list(read_records(stream))
    assert len(records) == len(texts) > 5
    assert [f["warc-segment-number"] for f, _ in records] == [str(i + 1) for i in range(len(records))]
    block = b"".join(b for _, b in records)
    assert records[-1][0]["warc-segment-total-length"] == str(len(block))
    assert payload_of(block).decode() == payload
    assert {parsed(*r)[0] for r in records} == {"<urn:x-page:7#0-0>"}


def expected(pages):
    groups = {}
    for r in pages:
        if r.page_id is not None:
            text = r.html or ""
            groups[text] = max(groups.get(text, r.page_id), r.page_id)
    found = []
    for r in pages:
        text = r.html or ""
        keeper = groups.get(text)
        revisit = keeper is not None and (r.page_id is None or r.page_id < keeper)
        kind = "revisit" if revisit else "response"
        found.append((r.page_id, len(text.encode()), sha(text), kind, keeper if revisit else None))
    return Counter(found)


@pytest.fixture(scope="module")
def odd_pages(spark):
    chance = random.Random(1)
    long = "".join(chance.choice("abc é漢\r\n") for _ in range(60_000))
    texts = [None, "", "<p>a</p>", "WARC/1.1\r\n\r\n", long, long + "x", "\r\n\r\n", None, "<p>a</p>", long]
    rows = [(i, f"http://a.example/é?q={i}\r\nX: 1", t) for i, t in enumerate(texts)]
    rows += [(9, None, long), (None, None, "<p>a</p>"), (None, "u", "alone"), (3, "u", "other")]
    return spark.createDataFrame([(*r, "z", "z", "z") for r in rows], SCHEMA)


def test_round_trip(spark, odd_pages):
    found = round_trip(odd_pages).collect()
    assert all(r.intact for r in found)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(
        odd_pages.collect()
    )
    texts = {sha(r.html or ""): r.html or "" for r in odd_pages.collect()}
    assert all(bytes(r.payload).decode() == texts[r.payload_digest] for r in found if r.record_type == "response")
    assert round_trip(odd_pages.limit(0)).count() == 0


def test_smaller_payloads_are_all_responses(spark, odd_pages):
    found = round_trip(odd_pages, least=10).collect()
    assert {r.record_type for r in found if r.payload_bytes < 10} == {"response"}
    assert any(r.record_type == "revisit" for r in found)


def archive(spark, pages, change):
    """An archive whose records were changed and written in another order to one file."""
    path = work_path(spark, "changed")
    write_archive(pages, path, segment=200)
    records = []
    for (content,) in spark.read.format("binaryFile").load(path).select("content").collect():
        stream = io.BytesIO(gzip.decompress(bytes(content)))
        at = 0
        while found := next(read_records(stream), None):
            records.append((found[0], bytes(stream.getbuffer()[at : stream.tell()]).lstrip(b"\r\n")))
            at = stream.tell()
    data = [(raw.decode(),) for raw in change(records)]
    random.Random(3).shuffle(data)
    new = work_path(spark, "changed")
    spark.createDataFrame(data, "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(new)
    return new


@pytest.mark.parametrize("damage", ["none", "lost", "short"])
def test_segments_in_any_order_and_damage(spark, damage):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 100) for i in range(4)], "page_id long, url string, html string")

    def change(records):
        for fields, raw in records:
            number = fields.get("warc-segment-number")
            hit = number == "3" and "urn:x-page:2#" in fields["warc-record-id"]
            if hit and damage == "lost":
                continue
            if hit and damage == "short":
                size = int(fields["content-length"])
                head = raw[: raw.rindex(b"\r\n\r\n", 0, len(raw) - size) + 4]
                raw = head.replace(b"Content-Length: %d" % size, b"Content-Length: %d" % (size - 5)) + raw[len(head) : -5]
            yield raw

    found = {r.page_id: r for r in read_archive(spark, archive(spark, pages, change)).collect()}
    for i in range(4):
        if i == 2 and damage != "none":
            assert not found[i].intact and found[i].payload is None
        else:
            assert found[i].intact and bytes(found[i].payload).decode() == f"page {i} " * 100


def warc(number, payload, **change):
    """A response record as other programs write it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = {
        "WARC-Type": "response", "WARC-Record-ID": f"<urn:x-page:{number}#0>", "WARC-Target-URI": f"http://a/{number}",
        "Content-Length": len(block), **change,
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def found_in(spark, folder, name, data, **how):
    folder.mkdir(parents=True)
    (folder / name).write_bytes(data)
    rows = read_archive(spark, str(folder), **how).collect()
    return sorted(((r.page_id, r.intact, r.payload and bytes(r.payload)) for r in rows), key=str)


def test_damaged_records_are_rows(spark, tmp_path):
    """Whatever is wrong with the second of three records, the others are read."""
    one, three = warc(1, b"<p>one"), warc(3, b"three \r\n\r\nWARC/1 is a format")
    whole = [(1, True, b"<p>one"), (3, True, b"three \r\n\r\nWARC/1 is a format")]
    damaged = {
        "truncated": warc(2, b"x" * 50)[:-30] + b"\r\n\r\n",
        "long": warc(2, b"two", **{"Content-Length": 400}),
        "short": warc(2, b"two and more\r\nlines", **{"Content-Length": 45}),
        "headless": warc(2, b"two", **{"Content-Length": None}),
        "odd": warc(2, b"two", **{"Content-Length": "many"}),
        "wrong": warc(2, b"two", **{"WARC-Payload-Digest": "sha1:AAAA"}),
    }
    for name, record in damaged.items():
        found = found_in(spark, tmp_path / name, "crawl.warc", INFO + one + record + three)
        assert [r for r in found if r[1]] == whole, name
        assert [r[0] for r in found if not r[1]] == [2], name
    # cut off at the end, and without a name
    assert found_in(spark, tmp_path / "end", "a.warc", one + warc(2, b"two")[:-12]) == [whole[0], (2, False, None)]
    nameless = warc(2, b"two", **{"WARC-Record-ID": None, "Content-Length": None})
    assert found_in(spark, tmp_path / "nameless", "a.warc", nameless * 2 + one) == [whole[0], (None, False, None), (None, False, None)]


def test_members_and_names(spark, tmp_path):
    """A gzip member per record, whatever the file is called; a damaged member costs its own records."""
    records = [warc(i, b"page %d" % i) for i in range(6)]
    members = [gzip.compress(r) for r in [INFO, *records]]
    every = [(i, True, b"page %d" % i) for i in range(6)]
    assert found_in(spark, tmp_path / "a", "crawl.warc.gz", b"".join(members)) == every
    assert found_in(spark, tmp_path / "b", "x.warc.gz", gzip.compress(b"".join(records))) == every
    assert found_in(spark, tmp_path / "c", "x.warc.gz", b"".join(members), files="*.warc") == []
    broken = bytearray(members[3])
    broken[12:20] = b"\xff" * 8
    found = found_in(spark, tmp_path / "d", "x.warc.gz", b"".join([*members[:3], bytes(broken), *members[4:]]))
    assert [r for r in found if r[1]] == every[:2] + every[3:]
    cut = found_in(spark, tmp_path / "e", "x.warc.gz", gzip.compress(b"".join(records))[:-20])
    assert [r for r in cut if r[1]] == every[: len([r for r in cut if r[1]])] and len(cut) >= 1


def test_pieces_shorter_than_a_character_end():
    for size in (1, 2, 3):
        framed = chunked("aé漢😀".encode(), size)
        assert unchunked(framed).decode() == "aé漢😀"
