import hashlib

import pytest

from cambium.llm import warc
from cambium.llm.warc import MAGIC, read_archives, round_trip

RECORD = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:pages:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "u1", "x" * 1500), (2, "u2", "x" * 1500), (3, None, None), (4, f"a\r\n{MAGIC}b", "a" * 300 + RECORD * 2 + "z" * 50 + MAGIC), (5, "u", RECORD),
    (6, "u", f"{MAGIC}Content-Length: 99999999999\r\n\r\nq"), (7, "u", "é" * 700), (8, "u", "y" * 999), (9, "u", "y" * 999), (None, "u", "no id"), (10, "", ""),
    (11, "u", RECORD * 300), (12, "u", RECORD * 300), (13, "u", "x" * 1500), (14, "u", "\r\n\r\n" * 20), (15, "u", "w" * 1000), (15, "u", "w" * 1000),
    (16, "u", "w" * 1000), (None, "u", "w" * 1000), (17, "u", "t" * 300_000), (18, "u", MAGIC),
]


def expected(pages):
    best = {}
    for i, _, html in pages:
        if len((html or "").encode()) >= 1000 and i is not None:
            best[html] = max(best.get(html, i), i)
    out = []
    for i, _, html in pages:
        data, head = (html or "").encode(), best.get(html, i)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if i == head else "revisit", None if i == head else head))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split", ["700", "20000", "128m"])
def test_round_trip(spark, split):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        pages = PAGES[:7] + PAGES[12:] if split == "700" else PAGES
        pages = [p for p in pages if split != "700" or len(p[2] or "") < 20_000]
        df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, split int, value string").coalesce(1)
        assert sorted(map(tuple, round_trip(df).collect()), key=repr) == expected(pages)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_foreign_archive(spark, tmp_path):
    """Binary payloads, other header cases, and a record without the end that it declares."""
    payload = bytes(range(256)) * 10 + MAGIC.encode()
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    good = b"WARC/1.1\r\nwarc-type: RESPONSE\r\nWARC-Record-ID: <urn:x>\r\ncontent-length:  %d \r\n\r\n%s\r\n\r\n" % (len(block), block)
    (tmp_path / "a.warc").write_bytes(good * 3 + b"WARC/1.1\r\nContent-Length: 50\r\n\r\ncut" + good)
    rows = read_archives(spark, str(tmp_path)).where("record_id is not null").collect()
    assert [(r.type, r.bytes, r.digest) for r in rows] == [("response", len(payload), hashlib.sha1(payload).hexdigest())] * 3


def test_empty(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_splits_that_change_between_passes(spark, tmp_path, monkeypatch):
    """Executors come and go, and with them the number and the size of the splits of the next pass."""
    pages = [(i, "u", "p" * (i * 37 % 900) + (RECORD * (i % 4) if i % 3 == 0 else "") + "q" * (i % 50)) for i in range(400)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    splits, read = ["90000", "7000", "31000"], warc._pieces

    def pieces(session, path):
        spark.conf.set("spark.sql.files.maxPartitionBytes", splits.pop(0))
        spark.conf.set("spark.sql.files.openCostInBytes", "100")
        found = read(session, path)
        assert found.rdd.getNumPartitions() > 1
        return found

    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    monkeypatch.setattr(warc, "_pieces", pieces)
    try:
        assert sorted(map(tuple, round_trip(df).collect()), key=repr) == expected(pages)
        assert len(splits) == 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
