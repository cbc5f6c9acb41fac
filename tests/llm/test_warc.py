import base64
import hashlib

import pytest

from quillgraph.llm import warc
from quillgraph.llm.warc import END, MAGIC, index_warc, read_warc, warc_round_trip, write_warc

SCHEMA = "page_id long, url string, html string, payload string, n int"
FAKE = MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello" + END


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def pages():
    texts = ["<p>one</p>", None, "", "é" * 3000, FAKE, "x" + FAKE + FAKE, "WARC/1.1", "WARC/1.1\r\n", "WARWARC/1.1\r\nWARC/", "\r\n\r\n", END + MAGIC + END, "<p>one</p>", FAKE]
    texts += [f"body {i} " * 40 for i in range(60)] + ["long " * 40_000]
    return [(i, f"http://h/{i}\r\nX: {i} z" if i % 2 else None, t, "clash", 1) for i, t in enumerate(texts)]


def test_round_trip_rejects_version_lines_in_payloads(spark, small_splits):
    rows = pages()
    got = {r.page_id: r for r in warc_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, t, _, _ in rows:
        first.setdefault(t or "", i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), digest(t or "")), i
        assert (r.record_type, r.refers_to) == (("response", None) if first[t or ""] == i else ("revisit", first[t or ""]))


def test_payloads_come_back_whole(spark, small_splits, tmp_path):
    rows = pages()
    write_warc(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "w"), least_revisit_bytes=10**9, compression="none")
    got = read_warc(spark, str(tmp_path / "w")).collect()
    assert {int(r.record_id): r.payload for r in got} == {i: t or "" for i, _, t, _, _ in rows}
    assert all(r.digest == digest(r.payload) and r.length == len(r.payload.encode()) for r in got)


def test_small_payloads_are_all_responses(spark):
    rows = [(i, "u", t, "", 0) for i, t in enumerate(["ab", "ab", "abcdef", "abcdef"])]
    got = warc_round_trip(spark.createDataFrame(rows, SCHEMA), least_revisit_bytes=3).collect()
    assert [r.record_type for r in sorted(got)] == ["response", "response", "response", "revisit"]


def test_null_ids_repeats_and_no_rows(spark):
    rows = [(None, None, "q", "", 0), (4, "u", "q", "", 0), (4, "u", "q", "", 0), (None, None, "r", "", 0)]
    got = warc_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "response", None), (-1, "revisit", 4), (4, "response", None), (4, "response", None)]
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_splits_that_change_between_the_two_reads(spark, tmp_path):
    """Executors come and go, and with them how files are packed into tasks; no record may hang on that."""
    rows = [(i, "u", ("a " + FAKE + f"{i} ") * (i % 10 == 0) + f"page {i} " * 30, "", 0) for i in range(1000)]
    write_warc(spark.createDataFrame(rows, SCHEMA).repartition(8), str(tmp_path / "w"), compression="none")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    lazy = index_warc(spark, str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    got = {int(r.record_id): r for r in lazy.collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 1000 and all(got[i].payload_digest == digest(t) for i, _, t, _, _ in rows)


def test_lost_records_are_an_error(spark, monkeypatch):
    real = warc.index_warc
    monkeypatch.setattr(warc, "index_warc", lambda *a: real(*a).limit(3))
    with pytest.raises(RuntimeError, match="4 records were written, 3 were read"):
        warc_round_trip(spark.createDataFrame([(i, "u", f"p{i}", "", 0) for i in range(4)], SCHEMA))
