import gzip
import hashlib
import io
import os

import pytest

from ledgerloom.llm import warc


def pages():
    long = "<p>" + "é" * 80 + "</p>"
    rows = [(i, f"http://h/{i}", f"<html>{i}\r\n\r\nWARC/1.1\r\n" + "y" * i) for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u\r\nX: 1", "short"), (53, "u", "short")]
    rows += [(70, "u", long), (60, "u", long), (65, "u", long), (60, "again", long), (None, "n", long)]
    rows += [(None, "a", long + "z"), (None, "b", long + "z"), (80, "big", "x" * 3_000_000)]
    return [(*r, "extra") for r in rows]


def expected(rows):
    first = {}
    for page, _, html, _ in rows:
        if len((html or "").encode()) >= 100 and page is not None:
            first[html] = min(page, first.get(html, page))
    out = []
    for page, url, html, _ in rows:
        data = (html or "").encode()
        other = first.get(html)
        again = other is not None and page != other
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", other if again else None))
    return sorted(out, key=repr)


@pytest.fixture
def folder(spark, tmp_path):
    warc.register(spark)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, payload string").repartition(3)
    path = str(tmp_path / "w")
    warc.records(df).write.format("warc").mode("append").option("path", path).save()
    return path


def test_round_trip(spark, folder):
    back = spark.read.format("warc").option("path", folder).load()
    rows = back.withColumn("page", warc.page_of(back.record_id)).withColumn("other", warc.page_of(back.refers_to)).collect()
    got = []
    for r in rows:
        if r.record_type != "warcinfo":
            digest = r.payload_digest.removeprefix("sha256:")
            if r.record_type == "response":
                assert hashlib.sha256(r.payload).hexdigest() == digest and len(r.payload) == r.payload_length
            got.append((r.page, r.payload_length, digest, r.record_type, r.other))
    assert sorted(got, key=repr) == expected(pages())
    assert {r.target_uri for r in rows if r.page == 52} == {"u%0D%0AX: 1"} and [r.target_uri for r in rows if r.page == 50] == [None]


def test_pushdown(spark, folder):
    load = spark.read.format("warc").option("path", folder).load
    only = load().where("record_type = 'revisit'")
    assert "revisit" not in only._jdf.queryExecution().executedPlan().toString().partition("Filter")[2].partition("BatchScan")[0]
    assert only.count() == sum(x[3] == "revisit" for x in expected(pages()))
    assert load().where("record_type = 'response' and payload_length = 3000000").count() == 1
    bare = spark.read.format("warc").option("path", folder).option("payload", "false").load()
    assert bare.where("payload is not null").count() == 0 and bare.count() == load().count()
    assert load().where("refers_to is not null and length(payload) = 0").count() == 3


def test_payloads_are_not_inflated(folder):
    name = next(os.path.join(folder, f) for f in os.listdir(folder) if b"big" in b"".join(gzip.open(os.path.join(folder, f)).readlines()))
    size, read = os.path.getsize(name), []

    class Counted(io.FileIO):
        def read(self, n=-1):
            data = super().read(n)
            read.append(len(data))
            return data

    rows = list(warc.read_file(Counted(name), size, lambda r: False, True))
    assert rows == [] and len(list(warc.read_file(open(name, "rb"), size, lambda r: True, False))) > 1


def test_foreign_archives(tmp_path, spark):
    """Plain files, plain gzip members and many records in one member."""
    made = [warc.record({"record_type": "response", "record_id": f"urn:page:{i}", "payload": b"p%d" % i, "payload_length": 2}) for i in range(5)]
    folded = b"WARC/1.0\nWARC-Type: metadata\nWARC-Target-URI: a\n  b\nContent-Length: 3\n\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(made) + folded)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(m) for m in made))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(made)))
    (tmp_path / "d.warc.gz").write_bytes(b"")
    warc.register(spark)
    rows = spark.read.format("warc").option("path", f"file://{tmp_path}").load().collect()
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == sorted([b"p%d" % i for i in range(5)] * 3)
    assert [(r.target_uri, bytes(r.payload)) for r in rows if r.record_type == "metadata"] == [("a b", b"abc")]


def test_empty(spark, tmp_path):
    warc.register(spark)
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.records(df).write.format("warc").mode("append").option("path", str(tmp_path / "e")).save()
    assert spark.read.format("warc").option("path", str(tmp_path / "e")).load().where("record_type = 'response'").count() == 0
    assert spark.read.format("warc").option("path", str(tmp_path / "none")).load().count() == 0
