"""WARC archives: round trips, damaged files, and what is recovered from them."""

import gzip
import hashlib
import io
import random
import uuid

import pytest

from pairlab.llm import warc

SCHEMA = "page_id long, url string, html string"


def salvaged(data):
    return list(warc.salvage(warc.Source(io.BytesIO(data), len(data))))


def pages_of(found):
    return [warc.page_of(f.fields["warc-record-id"]) for f in found if f.fault is None]


def samples(n=6, packed=True):
    rng = random.Random(n)
    plain = [warc.response(str(i), f"http://x/{i}", (f"<p>{i} " + "".join(rng.choices("abc \né", k=300 * i))).encode()) for i in range(n)]
    return [warc.member(r) if packed else r for r in plain]


def test_a_record_is_read_back():
    data = warc.response("7", "http://a b/ü\r\nX: y", b"<html>\r\n\r\n</html>")
    (one,) = salvaged(warc.member(data))
    assert one.fields["warc-type"] == "response" and one.fields["warc-target-uri"] == "http://a%20b/%C3%BC%0D%0AX:%20y"
    assert one.block.partition(b"\r\n\r\n")[2] == b"<html>\r\n\r\n</html>"
    assert one.fields["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"<html>\r\n\r\n</html>").hexdigest()
    assert gzip.decompress(warc.member(data)) == data
    for page in ("7", "-1", "", "a:b%c/ü", None):
        assert warc.page_of(warc.record_id(page, "0" * 64)) == page


@pytest.mark.parametrize("packed", [True, False])
def test_every_single_damaged_byte_is_quarantined_alone(packed):
    records = samples(3, packed)
    data = b"".join(records)
    starts = [0, len(records[0]), len(records[0]) + len(records[1])]
    rng = random.Random(0)
    for _ in range(150):
        at = rng.randrange(len(data))
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        found = salvaged(bytes(bad))
        hit = max(i for i in range(3) if starts[i] <= at)
        others = [f for f in found if f.start != starts[hit]]
        assert pages_of(others) == [str(i) for i in range(3) if i != hit]
        end = (starts + [len(data)])[hit + 1]
        gaps = [(f.start, f.end) for f in found if f.fault]
        # flags of a member are not checked, nor are a plain record's other fields
        assert gaps == [(starts[hit], end)] or (not gaps and len(found) == 3)
        assert [f.start for f in found] == sorted(f.start for f in found) and found[-1].end == len(data)


@pytest.mark.parametrize("packed", [True, False])
def test_garbage_and_truncation(packed):
    records = samples(5, packed)
    noise = b"\x1f\x8b\x08 no member WARC/1.1\r\nWARC/1.0\r\nno record \n" * 3
    found = salvaged(noise + records[0] + noise + records[1] + records[2][:-9] + records[3] + records[4][: len(records[4]) // 2])
    assert pages_of(found) == ["0", "1", "3"]
    spans = [(f.start, f.end) for f in found]
    assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert [f.fault is not None for f in found] == [True, False, True, False, True, False, True]
    assert salvaged(b"") == [] and [f.fault is None for f in salvaged(b"nothing")] == [False]


def test_records_inside_a_payload_are_not_taken_for_records():
    inner = warc.response("inside", None, b"x" * 200)
    outer = warc.response("outside", None, inner)
    assert pages_of(salvaged(outer + warc.member(outer))) == ["outside", "outside"]


def test_plain_and_packed_records_mix_and_a_member_may_hold_several(monkeypatch):
    plain, packed = samples(4, False), samples(4)
    data = plain[0] + packed[1] + warc.member(plain[2] + plain[3]) + plain[1]
    assert pages_of(salvaged(data)) == ["0", "1", "2", "3", "1"]
    monkeypatch.setattr(warc, "STEP", 7)
    assert pages_of(salvaged(b"noise" + data)) == ["0", "1", "2", "3", "1"]


def brute(rows):
    body = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, b in body:
        same = [j for j, c in body if c == b and j is not None]
        again = len(b) >= 100 and same and i != min(same)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/5", "é" * 50), (3, None, "é" * 50), (9, "u", "é" * 50), (3, None, "é" * 50), (None, "u", "é" * 50),
    (1, "u", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99),
    (None, "u", "y" * 100), (None, "u", "y" * 100), (-7, "u", "z" * 300_000), (10, "u", "z" * 300_000),
    (11, "u", "\x1f\x8b\x08\r\n\r\nWARC/1.1\r\n" * 30),
]


@pytest.mark.parametrize("options", [{}, {"gzip": False}, {"roll": 1}])
def test_round_trip(spark, options):
    pages = spark.createDataFrame([(*r, "x", "y") for r in ROWS], SCHEMA + ", digest string, member string").repartition(3)
    got = warc.round_trip(pages, **options)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(ROWS)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damaged_archives_lose_only_what_is_damaged(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 40}" + "text " * 60) for i in range(120)]
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    files = warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), folder)
    whole = warc.read_archives(files)
    assert whole.where("fault is not null").count() == 0 and warc.unresolved(whole).count() == 0
    first = whole.where("page = '0'").first()
    with open(first.path, "r+b") as f:
        f.seek(first.start + 30)
        f.write(b"\0\0\0\0")
    after = warc.read_archives(files, payloads=True)
    gap = after.where("fault is not null").collect()
    assert [(g.path, g.start, g.end) for g in gap] == [(first.path, first.start, first.end)]
    assert after.where("record_type <> 'warcinfo'").count() == 119
    assert [r.refers_to for r in warc.unresolved(after).collect()] == [first.record_id]
    assert after.where("page = '1'").first().payload == rows[1][2].encode()
