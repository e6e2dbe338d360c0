import base64
import hashlib

import pytest

from tidemark.llm import warc
from tidemark.llm.common import fresh_path

PAGE = "<html><body>" + "the same header and footer on each page " * 20


def pages(spark):
    rows = [(k, f"http://h/{k} x\r\ny", f"{PAGE}{k % 7}é</body>", "z") for k in range(200)]
    rows += [(500, None, None, "z"), (501, "u", "", "z"), (None, "u", "alone", "z"), (None, "u", f"{PAGE}0é</body>", "z"), (900, "u", "big " * 300_000, "z"), (3, "u", f"{PAGE}3é</body>", "z")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def expected(rows, least):
    first = {}
    for k, _, html, _ in rows:
        b = (html or "").encode()
        if len(b) >= least:
            first[b] = min((x for x in (first.get(b), k) if x is not None), default=None)
    out = []
    for k, _, html, _ in rows:
        b = (html or "").encode()
        f = first.get(b)
        f = None if f == k else f
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f is None else "revisit", f))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows, df = pages(spark)
    got = warc.round_trip(df, least).collect()
    assert all(r.problem is None for r in got)
    assert sorted(str(tuple(r)[:5]) for r in got) == expected(rows, least)


def test_payloads_come_back_and_small_archives_roll(spark):
    rows, df = pages(spark)
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_archives(df.coalesce(1), folder, archive=3000)
    assert manifest.count() > 1
    got = warc.read_archives(manifest, folder, payload=True).where("record_type = 'response'").collect()
    want = {(k, (h or "").encode()) for k, _, h, _ in rows}
    assert {(r.page_id, bytes(r.payload)) for r in got} <= want


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_frames_and_broken_records():
    records = [warc.build_record(k, "u", f"{PAGE} {k} ".encode() * (1 + k), None) for k in range(60)]
    d = warc.train(records)
    assert d
    import zstandard

    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_checksum=True)
    data = warc.leading_frame(d) + b"".join(map(c.compress, records))
    assert list(warc.read_frames(data)) == records
    with pytest.raises(ValueError):
        list(warc.read_frames(data[:-3]))
    good = records[0]
    assert warc.parse_record(good)["problem"] is None
    assert warc.parse_record(good.replace(b"WARC/1.1", b"WARC/9"))["problem"] == "version"
    assert warc.parse_record(good + b"x")["problem"] == "length"
    assert warc.parse_record(good.replace(b"WARC-Date", b"WARC-Dote"))["problem"] == "no warc-date"
    assert warc.parse_record(good.replace(b"same", b"sane"))["problem"] == "payload"
