import base64
import gzip
import hashlib

from pyspark.sql import functions as F

import pytest

from bundlelens.llm import warc

PAGES = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, None, None), (4, "http://b/ x\r\nEvil: 1", ""), (5, "http://c", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: response\r\n"), (None, "http://n", "<p>é</p>"), (None, "http://n", "only null keys"), (7, "u", "twice"), (7, "u", "twice"), (8, "u", "x\n" * 400_000)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def want(rows, least=0):
    first = {}
    for k, _, h in rows:
        if k is not None:
            first[h or ""] = max(first.get(h or "", k), k)
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        f = first.get(h or "") if len(b) >= least else None
        again = f is not None and f != k
        out.append((str(k), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


def got(df):
    r = F.col("record_type") == "response"
    cols = [F.col("headers")["x-record-key"].alias("k"), F.when(r, F.octet_length("payload")).otherwise(F.col("headers")["x-payload-length"].cast("int")).alias("n"), F.expr("substring(payload_digest, 6)").alias("d"), "record_type", F.col("headers")["x-refers-to-key"].cast("long").alias("f")]
    return sorted([(str(x.k), x.n, x.d, x.record_type, x.f) for x in df.select(*cols).collect()], key=str)


def test_round_trip_plain_zipped_and_by_size(spark, tmp_path):
    for name, zipped, least in (("a", "none", 0), ("b", "gzip", 0), ("c", "none", 10)):
        warc.write_warc(frame(spark), str(tmp_path / name), "page_id", "url", "html", min_bytes=least, per_file=2, compression=zipped)
        df = warc.read(spark, str(tmp_path / name))
        assert got(df) == want(PAGES, least)
        payloads = {(x.headers["x-record-key"] if "x-record-key" in x.headers else None): bytes(x.payload) for x in df.where("record_type = 'response'").collect()}
        assert payloads["5"] == PAGES[4][2].encode() and payloads["8"] == PAGES[9][2].encode()
        assert not [x for x in df.collect() if "evil" in x.headers]


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    warc.write_warc(frame(spark), str(tmp_path / "a"), "page_id", "url", "html")
    df = warc.read(spark, str(tmp_path / "a"))
    few = df.where("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [x.headers["x-record-key"] for x in few.collect()] == ["1"]
    thin = warc.read(spark, str(tmp_path / "a"), "record_type string, target_uri string").where("target_uri in ('u', 'http://c')")
    assert sorted(x.target_uri for x in thin.collect()) == ["http://c", "u", "u", "u"]
    reader = warc.WarcReader({}, df.schema)
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("content_length",), 0)]))
    assert len(left) == 1 and len(reader.tests) == 1


def test_an_archive_of_others(tmp_path):
    block = b"GET / HTTP/1.1\r\n\r\n"
    data = b"".join(b"WARC/1.0\r\nWARC-Type: %s\r\nX-Long: a\r\n b\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (t, len(x), x) for t, x in ((b"warcinfo", b"software: x"), (b"request", block)))
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data[:120]) + gzip.compress(data[120:]))
    out = list(warc.read_warc(str(tmp_path / "x.warc.gz")))
    assert [h["warc-type"] for h, _ in out] == ["warcinfo", "request"] and out[0][0]["x-long"] == "a b" and out[1][1] == block


def test_no_rows(spark, tmp_path):
    warc.write_warc(frame(spark).limit(0), str(tmp_path / "a"), "page_id", "url", "html")
    assert warc.read(spark, str(tmp_path / "a")).count() == 0


def test_a_cut_archive_raises_with_and_without_payloads(tmp_path):
    record = lambda x: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x)
    whole = record(b"first") + record(b"second " * 1000)
    for cut in (0, 1, 3, 4, 5, 3000):
        data = whole[: len(whole) - cut]
        (tmp_path / "x.warc").write_bytes(data)
        (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
        for path in ("x.warc", "x.warc.gz"):
            for payloads in (True, False):
                if cut > 4:  # into the block itself
                    with pytest.raises(ValueError, match="ends early"):
                        list(warc.read_warc(str(tmp_path / path), payloads=payloads))
                else:
                    assert len(list(warc.read_warc(str(tmp_path / path), payloads=payloads))) == 2


def test_a_very_long_payload(spark, tmp_path):
    html = "<p>é and more</p>" * 300_000
    warc.write_warc(spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "x")], "page_id long, url string, html string"), str(tmp_path / "a"), "page_id", "url", "html")
    rows = warc.read(spark, str(tmp_path / "a")).where("payload is not null").collect()
    assert max(len(r.payload) for r in rows) == len(html.encode()) and bytes(max((r.payload for r in rows), key=len)) == html.encode()
