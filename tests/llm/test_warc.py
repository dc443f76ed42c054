import gzip
import hashlib
import os
import zlib

import pytest

from palisade.llm import warc

BIG = "<html>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n</html>"
PAGES = [(3, "http://a/", BIG, 1), (1, "http://b/\r\nX: y", BIG, 1), (2, None, "small", 1), (4, "u", "small", 1), (5, "u", None, 1), (6, "u", "é" * 50, 1), (7, "u", "é" * 50, 1), (8, "u", "", 1), (1, "http://b/", BIG, 1), (9, "u", "a" * 99, 1), (10, "u", "a" * 99, 1), (None, "u", "lone " * 40, 1)]


def brute(pages):
    first = {}
    for i, html in pages:
        data = (html or "").encode()
        if i is not None:
            first[data] = min(first.get(data, i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        again = len(data) >= 100 and i is not None and i > first[data]
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "archives")


def test_round_trip(llm, folder):
    pages = llm.createDataFrame(PAGES, "page_id long, url string, html string, payload int").repartition(3)
    warc.write_archives(warc.records(pages), folder, file_bytes=900)
    read = warc.read_archives(llm, folder)
    assert sorted((tuple(r) for r in warc.resolve(read).collect()), key=str) == brute([(p[0], p[2]) for p in PAGES])
    kept = {r["payload"].decode() for r in read.where("record_type = 'response'").collect()}
    assert kept == {p[2] or "" for p in PAGES}
    assert read.where("record_type = 'revisit' AND length(payload) > 0").count() == 0
    assert "http://b/ X: y" in {r["url"] for r in read.collect()}


def test_archives_are_bounded_and_open_to_any_reader(llm, folder):
    """Files by bytes, a long record in one of its own; plain gzip reads them, every record is a member."""
    rows = [(i, "u", "abc %d " % i * (200_000 if i == 7 else 20), 0) for i in range(60)]
    pages = llm.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(1)
    warc.write_archives(warc.records(pages), folder, file_bytes=5000)
    files = [bytes(r["content"]) for r in llm.read.format("binaryFile").load(folder).collect()]
    assert len(files) > 4
    seen = []
    for data in files:
        parts = list(warc.members(data))
        assert gzip.decompress(data) == b"".join(parts) and parts[-1] == b""
        kinds = [h["WARC-Type"] for part in parts for h, _ in warc.parse(part)]
        assert kinds[0] == "warcinfo" and set(kinds[1:]) == {"response"} and len(kinds) == len(parts) - 1
        assert sum(map(len, parts[1:])) <= 5000 or len(kinds) == 2
        seen += [h["WARC-Record-ID"] for part in parts for h, _ in warc.parse(part)][1:]
    assert sorted(seen) == sorted(f"<urn:page:{i}>" for i in range(60))
    with pytest.raises(ValueError):
        list(warc.members(files[0][:-30]))


def test_members_are_read_in_bounded_pieces(monkeypatch):
    """Not the whole rest of the archive for every record."""
    from types import SimpleNamespace

    fed = []

    def reader(wbits):
        it = zlib.decompressobj(wbits)

        class Counted:
            eof, unused_data = property(lambda self: it.eof), property(lambda self: it.unused_data)

            def decompress(self, data):
                fed.append(len(data))
                return it.decompress(data)

        return Counted()

    contents = [b"%d " % i * (30_000 if i == 5 else 20) + os.urandom(50_000 if i == 7 else 80) for i in range(2000)]
    data = b"".join(gzip.compress(c) for c in contents)
    monkeypatch.setattr(warc, "zlib", SimpleNamespace(decompressobj=reader))
    assert list(warc.members(data)) == contents
    assert max(fed) <= 1 << 16 and sum(fed) < 40_000_000


def test_archives_are_read_once(llm, folder):
    pages = llm.createDataFrame([(1, "u", BIG), (2, "u", BIG)], "page_id long, url string, html string")
    warc.write_archives(warc.records(pages), folder)
    found = warc.resolve(warc.read_archives(llm, folder))
    assert "MapInArrow" not in found._jdf.queryExecution().toString() and found.count() == 2


def test_clashing_columns_and_ties(llm, folder):
    pages = llm.createDataFrame([(i, "u", BIG if i % 2 else "z" * 150, b"x", "d", 5) for i in (4, 3, 3, 2, 1, 1)], "page_id long, url string, html string, payload binary, payload_digest string, refers_to int")
    warc.write_archives(warc.records(pages), folder)
    assert sorted((tuple(r) for r in warc.resolve(warc.read_archives(llm, folder)).collect()), key=str) == brute([(r["page_id"], r["html"]) for r in pages.collect()])


def test_empty_table(llm, folder):
    pages = llm.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(warc.records(pages), folder)
    assert warc.resolve(warc.read_archives(llm, folder)).collect() == []


def test_parse_tells_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(h["WARC-Type"], p) for h, p in warc.parse(good * 2)] == [("response", b"ab")] * 2
    with pytest.raises(ValueError):
        list(warc.parse(good[:-2] + b"xx"))


def test_query_equals_brute_force(llm, sf_dir):
    from palisade.llm.queries import QUERIES

    pages = [(r["page_id"], r["html"]) for r in llm.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op9_warc"](llm, sf_dir).collect()), key=str) == brute(pages)
