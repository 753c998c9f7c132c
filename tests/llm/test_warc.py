import base64
import gzip
import hashlib

import pytest
from compare import TINY

from quern.llm import warc
from quern.llm.storage import scratch_path

PAGES = "page_id long, url string, html string, extra int, text string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def pages(spark):
    data = [(3, "u3", "<p>a</p>", 1, "x"), (1, "u1", "<p>a</p>", 2, None), (2, "u2", None, 3, "y"), (4, "u4", "", 4, "z"), (5, "u\r\n5", "é" * 300_000, 5, ""), (None, "n", "<p>a</p>", 6, ""), (7, None, "<p>b</p>", 7, ""), (7, None, "<p>b</p>", 7, "")]
    return spark.createDataFrame(data, PAGES)


def test_round_trip(spark, pages):
    found = sorted((tuple(r) for r in warc.archive_and_read(pages).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in found] == [
        (1, 8, digest("<p>a</p>"), "response", None), (2, 0, digest(""), "response", None), (3, 8, digest("<p>a</p>"), "revisit", 1), (4, 0, digest(""), "revisit", 2),
        (5, 600_000, digest("é" * 300_000), "response", None), (7, 8, digest("<p>b</p>"), "response", None), (7, 8, digest("<p>b</p>"), "revisit", 7), (None, 8, digest("<p>a</p>"), "revisit", 1)]
    assert found[4][5] == "u 5"


def test_repeated_rows_have_one_response(spark, pages):
    found = warc.archive_and_read(pages.unionAll(pages).repartition(3)).collect()
    firsts = [r for r in found if r["record_type"] == "response"]
    assert len(found) == 16 and len({r["payload_digest"] for r in found}) == len(firsts) == 4


def test_small_payloads_are_responses(spark, pages):
    kinds = {r["page_id"]: r["record_type"] for r in warc.archive_and_read(pages, min_bytes=9).collect()}
    assert set(kinds.values()) == {"response"}


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


def test_filters_reach_the_reader(spark, pages):
    warc.register(spark)
    path = scratch_path(spark, "t")
    warc.archive_pages(pages, path)
    some = warc.read_archive(spark, path).filter("record_type = 'revisit' AND target_uri IN ('u3', 'u4') AND refers_to IS NOT NULL")
    assert sorted(r["target_uri"] for r in some.collect()) == ["u3", "u4"]
    reader = warc.WarcReader(None, {"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.In(("target_uri",), ("u3",)), warc.EqualTo(("payload_bytes",), 3)]))
    assert len(left) == 1 and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 1
    whole = {r["record_id"]: r for r in warc.read_archive(spark, path, verify=True).collect()}
    assert bytes(whole["<urn:page:5>"]["payload"]).decode() == "é" * 300_000 and whole["<urn:page:3>"]["payload"] is None


@pytest.mark.parametrize("form", ["plain", "gzip", "one member"])
def test_archives_of_other_writers(spark, tmp_path, form):
    rows = [{"record_id": f"<urn:x:{i}>", "record_type": t, "target_uri": f"http://h/{i}", "date": "2024-01-01T00:00:00Z", "payload_digest": digest(f"body {i}" * 900 * i), "refers_to": None, "payload_bytes": None, "payload": (f"body {i}" * 900 * i).encode()}
            for i, t in enumerate(["response", "response", "revisit", "response"])]
    records = [warc.format_record(r) for r in rows]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    records.insert(0, info)
    data = b"".join(records) if form == "plain" else b"".join(map(gzip.compress, records)) if form == "gzip" else b"".join(map(warc.pack_member, records))
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(data)
    warc.register(spark)
    for payload in (True, False):
        found = {r["record_id"]: r for r in warc.read_archive(spark, str(tmp_path), payload=payload).collect()}
        assert len(found) == 5 and found["<urn:x:3>"]["payload_bytes"] == len("body 3" * 2700) and found["<urn:i>"]["payload_bytes"] == 4
        assert (found["<urn:x:1>"]["payload"] is not None) == payload
    assert [r["record_id"] for r in warc.read_archive(spark, str(tmp_path)).filter("record_id = '<urn:x:3>'").collect()] == ["<urn:x:3>"]


def test_members_are_plain_gzip():
    assert gzip.decompress(warc.pack_member(b"abc" * 1000)) == b"abc" * 1000


def test_a_wrong_digest_is_found(spark, tmp_path):
    row = {"record_id": "<urn:x:1>", "record_type": "response", "target_uri": None, "date": None, "payload_digest": digest("other"), "refers_to": None, "payload_bytes": None, "payload": b"body"}
    (tmp_path / "a.warc.gz").write_bytes(warc.pack_member(warc.format_record(row)))
    warc.register(spark)
    assert warc.read_archive(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="stated digest"):
        warc.read_archive(spark, str(tmp_path), verify=True).collect()


def test_query_equals_sql(spark):
    from compare import difference, duck

    from quern.llm.oracles import ORACLES
    from quern.llm.queries import QUERIES

    con = duck(TINY)
    for name in ORACLES:
        assert difference(QUERIES[name](spark, TINY), con, ORACLES[name]) == "", name
