import base64
import hashlib
import io

import pytest
import zstandard

from tidegrid.llm import warc

PAGES = [
    (1, "http://a", "<p>x</p>"),
    (2, "http://b", "<p>x</p>"),
    (3, None, None),
    (4, "http://d\r\nX: 1%0A", ""),
    (5, "http://e", "é" * 1000 + "\r\n\r\n" + "z" * 300_000),
    (6, "http://f", "<p>y</p>"),
    (6, "http://f", "<p>y</p>"),
    (9, "http://g", "<p>y</p>"),
    (9, "http://g", "<p>y</p>"),
    (None, "http://h", "<p>x</p>"),
    (None, "http://h", "only here"),
]


def expected(rows):
    first = {}
    for page_id, _, html in rows:
        first[html or ""] = min((x for x in (first.get(html or ""), page_id) if x is not None), default=None)
    out = []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        kind = "response" if first[html or ""] == page_id else "revisit"
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), kind, first[html or ""] if kind == "revisit" else None, url))
    return sorted(out, key=repr)


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in PAGES], "page_id bigint, url string, html string, digest string, first string")
    found = warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect()
    assert sorted(map(tuple, found), key=repr) == expected(PAGES)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    manifest = warc.write_archives(pages)
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    rows = warc.read_archives(manifest, with_payload=True).collect()
    html = {i: h for i, _, h in PAGES if i is not None}
    assert all((bytes(r.payload).decode() == (html[r.page_id] or "")) if r.record_type == "response" else r.payload is None for r in rows if r.page_id is not None)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_archive_format(tmp_path):
    records = [warc.response(i, f"http://x/{i}", "<html>common words in every page</html>" * 20 + str(i)) for i in range(50)]
    dictionary = warc.build_dictionary(records)
    compressor = zstandard.ZstdCompressor(dict_data=warc.dictionary_of(dictionary))
    frames = [compressor.compress(r) for r in records]
    raw = warc.struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + b"".join(frames)
    assert list(warc.frames(io.BytesIO(raw))) == records
    assert sum(map(len, frames)) < sum(len(zstandard.compress(r)) for r in records)
    one = zstandard.ZstdDecompressor(dict_data=warc.dictionary_of(dictionary)).decompress(frames[7])
    assert one == records[7] and warc.parse(one).row()[0] == 7
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError):
        list(warc.frames(io.BytesIO(b"x" * 20)))
    with pytest.raises(ValueError):
        warc.parse(one.replace(b"common", b"comman", 1))


def test_long_pages_teach_too_and_archives_roll(spark, tmp_path):
    """Pages beyond the sample's characters give their beginnings; the dictionary doesn't depend on the order of rows; a full archive is closed."""
    rows = [(i, f"http://x/{i}", "<html><body>shared opening of all pages " + f"{i} " * 30_000) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    dictionaries = set()
    for n, frame in enumerate((pages, pages.orderBy("url").repartition(3))):
        manifest = warc.write_archives(frame, f"file://{tmp_path}/{n}", roll_bytes=1).collect()
        assert len(manifest) == 40 and sum(r.records for r in manifest) == 40
        for r in manifest:
            raw = open(r.file.removeprefix("file://"), "rb").read()
            size = warc.struct.unpack("<II", raw[:8])[1]
            dictionaries.add(raw[8 : 8 + size])
    assert len(dictionaries) == 1 and b"shared opening" in dictionaries.pop()
    found = warc.read_archives(spark.createDataFrame([(r.file,) for r in manifest], "file string")).collect()
    assert sorted(r.page_id for r in found) == list(range(40))
