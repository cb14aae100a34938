"""Repeated rows are captures of their own; damaged archives give what stands before the damage."""

import gzip

from ferrule.llm import warc
from ferrule.llm.shelf import Shelf


def test_repeated_rows_are_captures_of_their_own(spark):
    long, short = "x" * 1500, "y" * 10
    rows = [(7, "http://a/7", long)] * 3 + [(3, "http://a/3", long), (4, "http://a/4", short), (4, "http://a/4", short), (None, "u", long), (None, "u", long), (None, None, None), (None, None, None)]
    path = Shelf(spark, "w").place()
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = [r.response for r in warc.transactions(warc.records(spark, path)).where("response is not null").collect()]
    assert len(found) == len(rows) and len({r.record_id for r in found}) == len(rows)
    one = [r for r in found if r.type == "response" and r.payload_bytes == 1500]
    assert len(one) == 1 and one[0].target_uri == "http://a/7"
    revisits = [r for r in found if r.type == "revisit"]
    assert len(revisits) == 5 and {r.refers_to for r in revisits} == {one[0].record_id}


def test_archives_that_are_cut_off():
    whole = warc.record("response", "<a>", "u", b"HTTP/1.1 200 OK\r\n\r\nbody", "application/http") + warc.record("metadata", "<b>", "u", b"x: y\r\n", "application/warc-fields")
    assert [h["warc-record-id"] for h, _ in warc.parse(whole)] == ["<a>", "<b>"]
    assert [[h["warc-record-id"] for h, _ in warc.parse(whole[:n])] for n in (10, 100, len(whole) - 12, len(whole) - 4)] == [[], [], ["<a>"], ["<a>", "<b>"]]
    assert [h["warc-record-id"] for h, _ in warc.parse(gzip.compress(whole)[:-20])] in ([], ["<a>"], ["<a>", "<b>"])
    assert list(warc.parse(whole.replace(b"Content-Length: 23", b"Content-Length: -1"))) == []
    assert list(warc.parse(b"")) == []
