"""WARC archives: round trips through ranges of any size."""

import gzip
import os

import pytest

from airtally.llm import warc

MAGIC_TEXT = "\x1f\x8b\x08 is no member"


def pages(spark):
    rows = [(1, "http://a/x y", "<p>one</p>"), (2, None, None), (3, "http://c\r\nX: y", "<p>one</p>"), (None, "u", "<p>one</p>"), (9, "u", "é" * 5000), (9, "u", "é" * 5000), (4, "u", "é" * 5000)]
    rows += [(5, "u", MAGIC_TEXT), (6, "u", ""), (None, "n", "alone"), (7, "u", "line\r\n\r\nline"), (8, "u", os.urandom(3000).hex())]
    return spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string").repartition(2), rows


@pytest.mark.parametrize("range_bytes", [17, 1000, 4_000_000])
def test_round_trip(spark, range_bytes):
    df, rows = pages(spark)
    files = warc.write(df, revisit_bytes=0)
    got = warc.read(files, range_bytes=range_bytes).collect()
    assert len(got) == len(rows) and all(r.digest_agrees for r in got)
    wanted = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        owner = max(ids, default=None)
        revisit = owner is not None and owner != page_id
        wanted.append((warc.record_id(page_id), len(data), warc.sha1_base32(data), "revisit" if revisit else "response", warc.record_id(owner) if revisit else None, None if revisit else data))
    found = [(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert not any("\n" in (r.target_uri or "") for r in got)


def test_small_payloads_are_responses(spark):
    df, rows = pages(spark)
    got = warc.read(warc.write(df, revisit_bytes=100), with_payload=False).collect()
    assert {r.record_id for r in got if r.record_type == "revisit"} == {"<urn:page:4>"}
    assert all(r.payload is None for r in got) and len(got) == len(rows)


def test_foreign_bytes_are_passed_over(spark, tmp_path):
    record = warc.member(1, "http://a", b"payload", None, 6)
    stored = warc.member(2, "http://b", b"x" * 50 + gzip.compress(b"no record"), None, 0)
    data = b"junk\x1f\x8b\x08junk" + gzip.compress(b"text") + record + b"\x1f\x8b" + stored + record[:-9]
    path = tmp_path / "odd.warc.gz"
    path.write_bytes(data)
    files = spark.createDataFrame([(str(path), len(data))], "path string, bytes long")
    for size in (5, 40, 10_000):
        got = warc.read(files, range_bytes=size).collect()
        assert sorted((r.record_id, bytes(r.payload)[:7]) for r in got) == [("<urn:page:1>", b"payload"), ("<urn:page:2>", b"xxxxxxx")]


def test_files_are_cut_and_empty_tables_have_none(spark):
    df, rows = pages(spark)
    files = warc.write(df.coalesce(1), file_bytes=500)
    assert files.count() > 3 and sum(f.records for f in files.collect()) == len(rows)
    none = warc.write(df.limit(0))
    assert none.count() == 0 and warc.read(none).count() == 0


class Counted:
    def __init__(self, path):
        self.file, self.read_bytes = open(path, "rb"), 0

    def seek(self, at):
        self.file.seek(at)

    def read(self, n):
        data = self.file.read(n)
        self.read_bytes += len(data)
        return data


def test_a_range_is_read_once(tmp_path):
    path = tmp_path / "many.warc.gz"
    path.write_bytes(b"".join(warc.member(i, "http://a", os.urandom(500), None, 1) for i in range(6000)))
    size, found, read = path.stat().st_size, 0, 0
    for start in range(0, size, 1_000_000):
        source = Counted(path)
        found += sum(1 for _ in warc.members(source, start, min(start + 1_000_000, size), size))
        read += source.read_bytes
    assert found == 6000 and read <= 1.1 * size


def test_ranges_are_spread_over_tasks(spark, tmp_path):
    df, _ = pages(spark)
    files = warc.write(df.coalesce(1))
    total = files.first().bytes
    got = warc.read(files, range_bytes=-(-total // 200))
    assert got.rdd.getNumPartitions() >= 50 and got.count() == df.count()
