import base64
import gzip
import hashlib
import os
import pathlib

import odd
import pytest

from cleansheet.llm import warc

PAGE = "page_id long, url string, html string"
PAGES = [(1, "http://a/", "<p>é日</p>"), (2, "http://a/ b\r\nX: y", "<p>é日</p>"), (3, None, None), (4, " ", ""), (9, "u", None),
         (5, "http://c", odd.LONG * 20), (6, "d", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (None, "e", "<p>é日</p>"), (None, "f", "alone"),
         (7, "g", "twice"), (7, "g", "twice"), (8, "h", "twice")]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    df = odd.frame(spark, PAGES, PAGE)
    first = {}
    for page, _, html in PAGES:
        if page is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(page, first.get(html or "", page))
    want = []
    for page, _, html in PAGES:
        to = first.get(html or "")
        revisit = to is not None and page != to
        want.append((page, len((html or "").encode()), digest(html), "revisit" if revisit else "response", to if revisit else None))
    got = [tuple(r)[:5] for r in warc.round_trip(df, min_payload=least).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_files_on_disk(spark, tmp_path):
    raw, out, index = (str(tmp_path / n) for n in ("raw", "out", "index"))
    warc.write_archives(spark.createDataFrame(PAGES, PAGE).coalesce(1), raw)
    warc.normalise(spark, raw, out, index, part_bytes=2000)
    monolithic = [p for p in pathlib.Path(raw).rglob("part-*") if not p.name.endswith(".crc")]
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in monolithic)
    assert len(list(warc.split_records(warc.inflate(warc.fed(gzip.compress(whole)))))) == len(PAGES)
    rows = spark.read.parquet(index).orderBy("archive", "part", "offset").collect()
    assert len(rows) == len(PAGES) and len({r["part"] for r in rows}) > 1
    again = b""
    for r in rows:
        folder = pathlib.Path(out) / f"archive={r['archive']}" / f"part={r['part']}"
        content = next(p for p in folder.iterdir() if p.name.startswith("part-")).read_bytes()
        member = content[r["offset"] : r["offset"] + r["length"]]
        record = gzip.decompress(member)
        fields, _ = warc.headers(record)
        assert fields["warc-type"] == r["warc_type"] and fields["warc-record-id"] == r["record_id"]
        again += record
    assert again == whole
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(spark, out, index).collect() if r["record_type"] == "response"}
    assert payloads[5].decode() == odd.LONG * 20


def test_broken_archives(spark, tmp_path):
    good = warc.record(1, "u", b"body", warc.base32_sha1(b"body"), None)
    cases = {"cut": gzip.compress(good * 3)[:-30], "members": gzip.compress(good) + gzip.compress(good + good), "empty": gzip.compress(b""),
             "noise": gzip.compress(good + b"GET / HTTP/1.1\r\n\r\n"), "plain": good, "short": gzip.compress(good + good[:-6])}
    for name, content in cases.items():
        os.makedirs(tmp_path / f"raw/archive={name}")
        (tmp_path / f"raw/archive={name}/part-0.txt").write_bytes(content)
    warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "index"))
    rows = spark.read.parquet(str(tmp_path / "index")).collect()
    count = {n: sum(r["archive"] == n and r["offset"] is not None for r in rows) for n in cases}
    error = {n: any(r["archive"] == n and r["error"] for r in rows) for n in cases}
    assert error == {"cut": True, "members": False, "empty": False, "noise": True, "plain": True, "short": True}
    assert count["members"] == 3 and count["noise"] == 1 and count["short"] == 1 and count["plain"] == 0 and count["empty"] == 0


def contents(spark, folder):
    rows = spark.read.parquet(str(folder / "index")).collect()
    files = {str(p.parent.relative_to(folder / "out")): p.read_bytes() for p in (folder / "out").rglob("part-*") if p.suffix == ".txt"}
    return sorted(map(tuple, rows), key=repr), files


def test_streams_longer_than_a_cell(spark, tmp_path):
    """Files read in pieces give what files read whole give, in any number of splits; sound ones also by a name in .gz."""
    records = [warc.record(i, "u", os.urandom(400 * i) + b"\n" * (i % 3), "x", None) for i in range(1, 90)]
    good = b"".join(records)
    ends_in_line_feed = next(g for g in (gzip.compress(good + warc.record(0, "u", b"\n" * n, "x", None), 0, mtime=0)
                                         for n in range(600)) if len(good) and g[-4] == 10)[:-3]
    sound = {"one": gzip.compress(good), "members": b"".join(map(gzip.compress, records)), "empty": gzip.compress(b"")}
    broken = {"cut": gzip.compress(good)[:-30000], "plain": good, "noise": gzip.compress(records[0] + b"\nGET\n"), "feed": ends_in_line_feed}
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    for label, suffix, cases, least in (("whole", "txt", sound | broken, 1 << 30), ("runs", "txt", sound | broken, 0), ("gz", "gz", sound, 0)):
        folder = tmp_path / label
        for name, content in cases.items():
            os.makedirs(folder / f"raw/archive={name}")
            (folder / f"raw/archive={name}/part-0.{suffix}").write_bytes(content)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        try:
            warc.normalise(spark, *(str(folder / n) for n in ("raw", "out", "index")), part_bytes=100_000, whole_bytes=least)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
        seen.append(contents(spark, folder))
    whole, runs, inflated = seen
    assert whole == runs
    assert len(whole[0]) > 2 * len(records) and {r[0] for r in whole[0] if r[2]} == set(broken)
    names = {n: c for n, c in whole[1].items() if n.split("/")[0].split("=")[1] in sound and "empty" not in n}
    assert {n: c for n, c in inflated[1].items() if "empty" not in n} == names


def test_inflating_in_small_pieces(monkeypatch):
    monkeypatch.setattr(warc, "STEP_BYTES", 7)
    monkeypatch.setattr(warc, "FEED_BYTES", 11)
    records = [warc.record(i, "u", b"x" * (i * 50), warc.base32_sha1(b"x" * (i * 50)), None) for i in range(6)]
    stream = gzip.compress(b"".join(records[:4])) + warc.EMPTY_MEMBER + gzip.compress(b"".join(records[4:])) + warc.EMPTY_MEMBER
    assert list(warc.split_records(warc.inflate(warc.fed(stream)))) == records


def test_empty_table(spark):
    assert warc.round_trip(odd.frame(spark, [], PAGE)).count() == 0
