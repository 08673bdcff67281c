import base64
import gzip
import hashlib
import io
import random
import time

from tabwright.llm.common import new_folder
from tabwright.llm.warc import archives_in, gzip_member, mark_revisits, op1_warc, read_warc, record_bytes, records, resolve_revisits, write_warc


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_query(spark, sf_dir):
    got = op1_warc(spark, sf_dir).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").toPandas()
    assert len(got) == len(pages)
    for p, h in zip(pages.page_id, pages.html, strict=True):
        assert (got.payload_bytes[p], got.payload_digest[p]) == (len(h.encode()), sha(h.encode()))


def test_query_on_copies(spark, tmp_path):
    """Nulls, empty pages and copies: which record is whole, and to which one the others refer."""
    html = {1: "a", 2: None, 3: "b", 4: "a", 5: "", 6: "<p>ü", 7: "a", -8: "<p>ü", 9: None}
    spark.createDataFrame([(k, f"u{k}", h, 0, "x") for k, h in html.items()], "page_id long, url string, html string, payload int, revisit_of string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in op1_warc(spark, str(tmp_path)).collect()}
    assert len(got) == len(html)
    for k, h in html.items():
        last = max(i for i, other in html.items() if (other or "") == (h or ""))
        want = ("response", None) if k == last else ("revisit", last)
        assert (got[k].record_type, got[k].refers_to) == want
        assert (got[k].payload_bytes, got[k].payload_digest) == (len((h or "").encode()), sha((h or "").encode()))


def test_damage_anywhere():
    """One record is cut short, overwritten or followed by garbage in very many ways; all the others are read."""
    rng = random.Random(2)
    noise = [rng.randbytes(rng.choice([0, 10, 3000, 150_000])) for _ in range(5)]
    parts = [gzip_member(record_bytes(f"urn:page:{k}", "u", p, None, "2020-01-01T00:00:00Z"), 6) for k, p in enumerate(noise)]
    for turn in range(200):
        hurt = rng.randrange(5)
        bad = bytearray(parts[hurt])
        kind = turn % 5
        if kind == 0:
            bad = bad[: rng.randrange(len(bad))]
        elif kind == 1:
            at = rng.randrange(len(bad))
            bad[at : at + 20] = rng.randbytes(20)
        elif kind == 2:
            bad = bytearray(rng.randbytes(rng.randrange(1, 500)))
        elif kind == 3:
            bad += rng.randbytes(rng.randrange(1, 500))
        else:
            bad = bytearray(gzip_member(rng.choice([b"", b"WARC/1.1", b"WARC/1.1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab", b"no record"]), 6))
        got = list(records(io.BytesIO(b"".join([*parts[:hurt], bytes(bad), *parts[hurt + 1 :]]))))
        sound = [r["record_id"] for r in got if not r.get("error")]
        assert [f"urn:page:{k}" for k in range(5) if k != hurt] == [s for s in sound if s != f"urn:page:{hurt}"], (turn, kind, hurt)
        wrong = [r for r in got if r.get("error")]
        # A cut to nothing leaves no trace; every other damage gives a row, and no more than one and one for what follows it.
        assert len(wrong) <= 2 and (wrong or f"urn:page:{hurt}" in sound or not bad), (turn, kind, hurt)


def test_headers_without_end():
    block = b"x" * (3 << 20)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    good = gzip_member(record_bytes("urn:page:1", "u", b"p", None, "d"), 6)
    got = list(records(io.BytesIO(gzip_member(head + block + b"\r\n\r\n", 6) + good)))
    assert "HTTP headers" in got[0]["error"] and got[1]["record_id"] == "urn:page:1" and not got[1]["error"]


def test_round_trip(spark):
    payloads = {1: b"a", 2: b"", 3: b"a", 4: None, 5: b"\r\n\r\nWARC/1.1\r\n\r\n" * 9000, 6: b"a", 7: b"b", 8: b""}
    rows = [(k, None if k == 2 else f"http://x/{k}\r\nü", p) for k, p in payloads.items()] + [(None, "u", b"z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload binary").selectExpr("page_id", "url", "coalesce(payload, binary('')) AS payload", "1 AS target", "2 AS n", "3 AS rows", "4 AS payload_key")
    folder = new_folder(spark, "test-warc")
    marked = mark_revisits(pages, "page_id", "payload")
    assert write_warc(marked, folder, archive_bytes=1000).agg({"records": "sum"}).first()[0] == 9
    found = archives_in(spark, folder)
    assert found.count() > 1
    got = {r.record_id: r for r in resolve_revisits(read_warc(found)).collect()}
    for k, p in payloads.items():
        r, p = got[f"urn:page:{k}"], p or b""
        last = max(i for i, q in payloads.items() if (q or b"") == p)
        assert (r.record_type, r.refers_to) == (("response", None) if k == last else ("revisit", f"urn:page:{last}"))
        assert (r.payload_digest, r.payload_bytes, r.error) == (sha(p), len(p), None)
        assert r.payload == (p if k == last else None)
    assert got["urn:page:1"].target_uri == "http://x/1%0D%0Aü" and got["urn:page:2"].target_uri is None
    assert sum(r.startswith("urn:uuid:") for r in got) == 1


def test_small_payloads_stay(spark):
    pages = spark.createDataFrame([(1, b"a"), (2, b"a"), (3, b"aaaa"), (4, b"aaaa")], "page_id long, payload binary")
    assert {r.page_id: r.revisit_of for r in mark_revisits(pages, "page_id", "payload", min_bytes=2).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, payload binary")
    manifest = write_warc(mark_revisits(pages, "page_id", "payload"), new_folder(spark, "test-warc"))
    assert manifest.count() == 0 and read_warc(manifest).count() == 0


def test_damage():
    one, two = (record_bytes(f"urn:page:{k}", "u", b"p" * 70000, None, "2020-01-01T00:00:00Z") for k in (1, 2))
    assert gzip.decompress(gzip_member(one, 6)) == one
    good = list(records(io.BytesIO(gzip_member(one, 6) + gzip_member(two, 1))))
    assert [r["error"] for r in good] == [None, None] and good[1]["record_offset"] == len(gzip_member(one, 6)) and good[0]["payload"] == b"p" * 70000
    changed = one.replace(b"ppp", b"ppq", 1)
    longer = one.replace(b"Content-Length: 70", b"Content-Length: 99", 1)
    broken = list(records(io.BytesIO(gzip_member(changed, 6) + gzip_member(longer, 6) + gzip_member(one + b"x", 6) + gzip_member(two, 6))))
    assert broken[0]["error"] == "block digest differs" and broken[1]["error"] and broken[2]["error"] and broken[3]["error"] is None
    cut = list(records(io.BytesIO(gzip_member(one, 6) + gzip_member(two, 6)[:-40])))
    assert cut[0]["error"] is None and "within" in cut[1]["error"]
    assert list(records(io.BytesIO(b""))) == []


def test_damaged_stream():
    """Records after damaged compressed bytes are read, and a long header is no damage."""
    import random

    noise = random.Random(1).randbytes(300_000)
    parts = [gzip_member(record_bytes(f"urn:page:{k}", "u", noise, None, "2020-01-01T00:00:00Z"), 6) for k in range(4)]
    for where in (5, 40, len(parts[1]) // 2, len(parts[1]) - 6):
        bad = bytearray(parts[1])
        bad[where : where + 3] = bytes(x ^ 0xFF for x in bad[where : where + 3])
        got = list(records(io.BytesIO(parts[0] + bytes(bad) + parts[2] + parts[3])))
        assert [r.get("record_id") for r in got if not r["error"]][-2:] == ["urn:page:2", "urn:page:3"], where
        assert got[0]["record_id"] == "urn:page:0" and [r["record_offset"] for r in got if not r["error"]][-1] == sum(map(len, parts[:3]))
    # What is left of a bad record is damaged too.
    bad = bytearray(gzip_member(record_bytes("urn:page:1", "u", noise, None, "d").replace(b"Content-Length: 300", b"Content-Length: x00", 1), 6))
    bad[200_000:200_003] = b"\xff\xff\xff"
    got = list(records(io.BytesIO(bytes(bad) + parts[2])))
    assert got[0]["error"] and got[-1]["record_id"] == "urn:page:2" and not got[-1]["error"]
    url = "data:," + "x" * 3_000_000
    (long,) = records(io.BytesIO(gzip_member(record_bytes("urn:page:9", url, b"p", None, "d"), 6)))
    assert (long["error"], long["record_id"], long["target_uri"]) == (None, "urn:page:9", url)


def test_any_header_ends():
    """Every field of a header with every kind of bad value: reading ends, and the records before and after are there."""
    sound = [gzip_member(record_bytes(f"urn:page:{k}", "u", b"p" * 5000, None, "2020-01-01T00:00:00Z"), 6) for k in (1, 3)]
    bad = record_bytes("urn:page:2", "u", b"q" * 5000, None, "2020-01-01T00:00:00Z")
    head, _, rest = bad.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    values = [b"-5", b"-0", b"+7", b"1_0", "٣".encode(), b" 12 34", b"", b"0", b"1e3", b"99999999999999999999999", b"\x00", b"x" * 100_000]
    begin = time.time()
    for k in range(len(lines)):
        for value in values:
            hurt = [*lines[:k], lines[k].split(b":")[0] + b": " + value, *lines[k + 1 :]] if k else [value, *lines[1:]]
            got = list(records(io.BytesIO(sound[0] + gzip_member(b"\r\n".join(hurt) + b"\r\n\r\n" + rest, 6) + sound[1])))
            whole = [r.get("record_id") for r in got if not r["error"]]
            assert whole[0] == "urn:page:1" and whole[-1] == "urn:page:3" and len(got) == 3, (lines[k], value)
            if lines[k].lower().startswith(b"content-length") and value != b"0":
                assert got[1]["error"], value
    endless = gzip_member(b"WARC/1.1\r\nX: " + b"x" * (40 << 20), 1)
    got = list(records(io.BytesIO(sound[0] + endless + sound[1])))
    assert "header" in got[1]["error"] and got[2]["record_id"] == "urn:page:3" and time.time() - begin < 60
