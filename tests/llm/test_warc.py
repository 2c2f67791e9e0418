import base64
import gzip
import hashlib
import io
import os

import pytest

from threatframe.llm import warc

PAGES = [
    (5, "http://a/x", "<p>same</p>"),
    (3, "http://a/y z\r\nInjected: 1", "<p>same</p>"),
    (9, None, "<p>same</p>"),
    (None, "http://a/n", "<p>same</p>"),
    (1, "http://b/ü", None),
    (2, "http://b/2", ""),
    (7, "http://c", "é" * 400_000),
    (8, "http://c", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
    (4, "http://d", "own"),
    (4, "http://d", "own"),
    (None, None, "nobody"),
    (None, None, "nobody"),
]
SCHEMA = "page_id long, url string, html string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, least=0):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        first = min(ids) if ids else None
        revisit = page_id != first and len(data) >= least
        out.append((page_id, len(data), digest(data), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip_equals_brute_force(spark, least):
    df = spark.createDataFrame([(*r, "c", "d", "e") for r in PAGES], SCHEMA + ", payload string, first string, key string")
    got = warc.round_trip(df, least)
    assert sorted(map(tuple, got.collect()), key=str) == brute(PAGES, least)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, warc.op12_warc_round_trip(spark, sf).collect()), key=str) == brute(rows)


def test_files_are_members_and_payloads_return(spark, tmp_path):
    df = spark.createDataFrame(PAGES, SCHEMA).repartition(2)
    manifest = warc.write_warc(df, str(tmp_path), file_bytes=300)
    files = manifest.collect()
    assert len(files) > 2 and sum(f.records for f in files) == len(PAGES)
    for f in files:
        data = open(f.path, "rb").read()
        assert len(data) == f.bytes and gzip.decompress(data).count(b"WARC-Type: ") == f.records
    (tmp_path / "part-of-a-lost-attempt.warc.gz").write_bytes(b"\x1f\x8bbroken")  # not in the manifest
    got = warc.read_warc(manifest, payloads=True).collect()
    assert all(r.fault is None for r in got)
    texts = {r.payload.decode() for r in got if r.record_type == "response"}
    assert texts == {h or "" for _, _, h in PAGES}
    assert any(r.url == "http://a/y%20z%0D%0AInjected:%201" for r in got)


class Dribble(io.RawIOBase):
    """Gives a few bytes at a time."""

    def __init__(self, data, step):
        self.data, self.at, self.step = data, 0, step

    def read(self, n=-1):
        out = self.data[self.at : self.at + self.step]
        self.at += len(out)
        return out


def archive():
    plain = [warc.record_bytes(i, f"http://{i}", f"payload {i}".encode() * i, False, None) for i in range(1, 6)]
    return plain, b"".join(map(warc.gzip_member, plain))


@pytest.mark.parametrize("step", [1, 7, 64, 10_000])
def test_reader_takes_any_block_size(step, monkeypatch):
    monkeypatch.setattr(warc, "INFLATE_BYTES", step)
    _, data = archive()
    got = list(warc.records(Dribble(data, step), keep=True))
    assert [r.fault for r in got] == [None] * 5
    assert [r.payload for r in got] == [f"payload {i}".encode() * i for i in range(1, 6)]


def test_faults_are_found(spark, tmp_path):
    plain, data = archive()
    faults = lambda d: [r.fault for r in warc.records(io.BytesIO(d))]
    swapped = plain[1].replace(b"payload 2payload", b"payload 2Payload")
    got = faults(warc.gzip_member(plain[0]) + warc.gzip_member(swapped) + warc.gzip_member(plain[2]))
    assert got == [None, "block digest, payload digest", None]
    assert "EOFError" in faults(data[:-5])[-1] and len(faults(data[:-5])) == 5
    assert "gzip member" in faults(gzip.compress(plain[0] + plain[1]))[0]  # two records in one member
    assert "shorter" in faults(warc.gzip_member(plain[3][:-30]))[0]
    assert "Content-Length" in faults(warc.gzip_member(plain[0].replace(b"msgtype=response\r\nContent-Length: ", b"msgtype=response\r\nContent-Length: x")))[0]
    assert faults(warc.gzip_member(b"nothing here\r\n\r\n"))[0].startswith("ValueError: no WARC version")
    assert faults(b"\0\0\0")[0].startswith("error")
    broken = os.path.join(tmp_path, "a.warc.gz")
    open(broken, "wb").write(data[:-5])
    files = spark.createDataFrame([(broken, 5)], "path string, records long")
    assert warc.read_warc(files).filter("fault is not null").count() == 1
    with pytest.raises(Exception, match="WARC fault"):
        warc.verified(warc.read_warc(files)).collect()
    open(broken, "wb").write(b"".join(map(warc.gzip_member, plain[:4])))
    assert warc.read_warc(files).filter("fault = '4 records, not 5'").count() == 1
