import base64
import gzip
import hashlib
import io
import random
import time

import pytest

from marginalia.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ROWS = [(4, "http://a/x y\n", "<p>é\r\n\r\nWARC/1.0</p>"), (9, "http://b", "same"), (2, None, "same"), (7, "http://b", "same"), (5, "http://c", None), (6, "http://c", ""), (11, "http://d", "ab" * 40_000), (-3, "http://n", "neg"), (8, "http://n", "neg")]
ROWS += [(i, "http://wide", "wide") for i in (2**61, 2**61 + 1, 2**62, 2**63 - 1)] + [(-(2**63), "http://wide", "low"), (2**63 - 2, "http://wide", "low")]


def expected(rows, least=0):
    first = {}
    for page, _, html in rows:
        first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        to = first[html or ""]
        revisit = len((html or "").encode()) >= least and to != page
        out.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out)


def test_pages_come_back(spark, monkeypatch):
    df = spark.createDataFrame([(*r, "x", b"y") for r in ROWS], "page_id long, url string, html string, block string, salt binary").repartition(3)
    for least, size in ((0, 1 << 26), (1, 200), (100, 1)):
        monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
        got = warc.convert_pages(df, least)
        assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())) == expected(ROWS, least)


def test_empty_null_and_repeated_rows(spark):
    schema = "page_id long, url string, html string"
    assert warc.convert_pages(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "u", "a"), (1, "u", "a"), (1, "u", "a"), (2, "u", "a")]
    got = sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.convert_pages(spark.createDataFrame(rows, schema)).collect())
    assert got == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_members_are_read_in_one_pass_and_end_with_a_zero_byte():
    rng = random.Random(1)
    parts = [rng.randbytes(rng.randrange(200_000)) for _ in range(20)] + [bytes(17 << 20)]
    archive = warc.Archive()
    assert [x for p in parts for x in archive.add(p)] == []
    (whole,) = archive.close()
    assert warc.opened(whole + b"\0").read() == b"".join(parts) == gzip.decompress(whole + b"\0")


def http(payload):
    return b"HTTP/1.1 200 OK\r\nContent-Type: x/y\r\n\r\n" + payload


def legacy_archive():
    """As other crawlers wrote them: no page numbers, any bytes, blanks in URLs, odd lines, a block that ends early."""
    v2 = " ".join(warc.ARC_FIELDS["2"])
    image, latin = b"\xff\xd8\xff\x00\x1f\x8b" + bytes(range(256)), "déjà".encode("latin-1")
    records = [
        b"filedesc://IA-001.arc 0.0.0.0 19970102030405 text/plain 76\n" + (b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n" + b" " * 76)[:76],
        b"http://a/image one.jpg 10.0.0.1 19970102030405 image/jpeg %d\n" % len(http(image)) + http(image),
        b"http://a/latin 10.0.0.1 199701020304 text/html; charset=iso %d\n" % len(http(latin)) + http(latin),
        b"these lines\nare no header",
        b"http://b/latin 10.0.0.2 19970102030406 text/html %d\n" % len(http(latin)) + http(latin),
        b"dns:a 10.0.0.3 19970102030407 text/dns 3\nabc",
        b"filedesc://IA-002.arc 0.0.0.0 19980102030405 text/plain 200 - - 0 IA-002.arc %d\n2 0 Crawler\n" % (13 + len(v2)) + v2.encode() + b"\n",
        b"http://c/ 10.0.0.4 19980102030405 text/html 200 abc - 7 IA-002.arc %d\n" % len(http(b"two")) + http(b"two"),
    ]
    return [r + b"\n" for r in records], b"http://d/ 10.0.0.5 19990102030405 text/html 200 abc - 7 IA-002.arc 900\nHTTP/1.0 200 OK\r\n\r\nshort", image, latin


@pytest.mark.parametrize("packed", [False, True])
def test_legacy_archives_convert(spark, tmp_path, packed):
    records, short, image, latin = legacy_archive()
    raw = b"".join(map(gzip.compress, records)) + gzip.compress(short) if packed else b"".join(records) + short
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "IA.arc").write_bytes(raw)
    arc = warc.read_arc(spark, str(tmp_path / "old"))
    got = {r["url"]: r for r in arc.collect()}
    assert [r["kind"] for r in got.values()] == ["warcinfo", "response", "response", "damaged", "response", "resource", "warcinfo", "response", "damaged"]
    assert got["http://a/image one.jpg"]["content_type"] == "image/jpeg" and got["http://a/image one.jpg"]["block"].endswith(image)
    assert got["http://a/latin"]["content_type"] == "text/html; charset=iso" and got["http://a/latin"]["block"].endswith(latin)
    odd = [bytes(r["block"]) for r in got.values() if r["kind"] == "damaged"]
    assert odd[0].startswith(b"these lines\nare no header\n") and odd[1] == short

    warc.arc_to_warc(arc, str(tmp_path / "new"))
    web = {r["target_uri"]: r for r in warc.read_warc(spark, str(tmp_path / "new" / "warc")).collect()}
    assert {u: r["record_type"] for u, r in web.items()} == {"http://a/image%20one.jpg": "response", "http://a/latin": "response", "http://b/latin": "revisit", "http://c/": "response"}
    again = web["http://b/latin"]
    assert again["refers_to_id"] == web["http://a/latin"]["record_id"] and again["refers_to"] is None and again["payload_bytes"] == 4
    assert web["http://a/latin"]["date"] == "1997-01-02T03:04:00Z" and len({r["record_id"] for r in web.values()}) == 4
    whole = b"".join(warc.opened(p.read_bytes()).read() for p in (tmp_path / "new" / "warc").glob("part-*"))
    kept = [head["warc-type"] for head, _ in warc.warc_records(io.BytesIO(whole))]
    assert sorted(kept) == sorted(["warcinfo"] * 2 + ["response"] * 3 + ["revisit"] + ["resource"] * 3) and image in whole and short in whole


def line_record(i, block):
    return b"http://m/%d 10.0.0.1 19970102030405 text/plain %d\n" % (i, len(block)) + block + b"\n"


def read_all(data):
    """(urls of whole records, damaged blocks)"""
    records = list(warc.arc_records(data))
    assert len({at for at, _, _ in records}) == len(records)
    return [head["URL"] for _, head, _ in records if head], [block for _, head, block in records if not head]


def test_broken_members_leave_the_others():
    rng = random.Random(3)
    blocks = [rng.randbytes(rng.randrange(1, 200_000)) for _ in range(9)]
    members = [gzip.compress(line_record(i, b)) for i, b in enumerate(blocks)]
    urls = [f"http://m/{i}" for i in range(9)]
    assert read_all(b"".join(members)) == (urls, [])
    for k in (0, 4, 8):
        others = urls[:k] + urls[k + 1 :]
        half = len(members[k]) // 2
        flipped = members[k][:half] + bytes([members[k][half] ^ 255]) + members[k][half + 1 :]
        wrong_sum = members[k][:-8] + bytes([members[k][-8] ^ 1]) + members[k][-7:]
        for broken in (members[k][:half], flipped, wrong_sum, b"\x1f\x8b\x08\x00" + b"x" * 50, members[k][: -1]):
            good, damaged = read_all(b"".join(members[:k]) + broken + b"".join(members[k + 1 :]))
            assert [u for u in good if u != urls[k]] == others
            assert damaged or good == urls  # a trailer cut short at the end of a file leaves its record whole
    good, damaged = read_all(b"".join(members) + b"stray bytes")
    assert good == urls and damaged == [b"stray bytes"]
    assert read_all(b"".join(members) + b"\0\0") == (urls, [])
    good, damaged = read_all(members[0] + b"\n".join([b"between"]) + members[1])
    assert good == urls[:2] and damaged == [b"between"]


def test_damaged_regions_take_time_in_proportion():
    record = b"http://m/1 10.0.0.1 19970102030405 text/plain 5\n"
    stray = b"a line that no header is, as a length was too short\n" * (60_000_000 // 53)
    began = time.monotonic()
    good, damaged = read_all(record + b"12345678\n" + stray + line_record(2, b"end"))
    assert good == ["http://m/1", "http://m/2"] and damaged == [b"678\n" + stray]
    assert time.monotonic() - began < 15
    huge = b"http://m/3 10.0.0.1 19970102030405 text/plain %d\nrest" % 10**17
    assert read_all(line_record(1, b"x") + huge) == (["http://m/1"], [huge])


def test_one_broken_file_among_others(spark, tmp_path):
    whole = [gzip.compress(line_record(i, b"block %d" % i)) for i in range(6)]
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.arc.gz").write_bytes(b"".join(whole[:3]))
    (tmp_path / "old" / "b.arc.gz").write_bytes(whole[3][:20] + whole[4] + b"\x1f\x8b\x08\x00junk" + whole[5])
    got = warc.read_arc(spark, str(tmp_path / "old")).collect()
    assert sorted(r["url"] for r in got if r["kind"] != "damaged") == [f"http://m/{i}" for i in (0, 1, 2, 4, 5)]
    assert any(bytes(r["block"]).startswith(b"\x1f\x8b\x08\x00junk") for r in got if r["kind"] == "damaged")
    warc.arc_to_warc(warc.read_arc(spark, str(tmp_path / "old")), str(tmp_path / "new"))
    assert warc.read_warc(spark, str(tmp_path / "new" / "warc")).count() == 0  # these are resources
