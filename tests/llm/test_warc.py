from __future__ import annotations

import base64
import gzip
import hashlib
import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from wordmine.llm import warc

COLUMNS = "page_id long, url string, html string, same int, size string, first long"


def brute(rows):
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured``."""
    first = {}
    for p, _, x in rows:
        x = x or ""
        if p is not None:
            first[x] = max(p, first.get(x, p))
    out = []
    for p, u, x in rows:
        x = x or ""
        digest = base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
        other = first.get(x) if p != first.get(x) else None
        at = datetime(2020, 1, 1) + timedelta(seconds=(p or 0) % 315_360_000)
        if u is not None:
            u = "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in u)
        kind = "response" if other is None else "revisit"
        out.append((p, len(x.encode()), digest, kind, other, warc.url_key(u), f"{at:%Y-%m-%dT%H:%M:%SZ}"))
    return out


def order(row):
    return row[5], row[6], row[0] is not None, row[0] or 0


def odd_pages():
    rng = random.Random(8)
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    payloads = [None, "", "\n", "\r", "\r\n\r\n", trap, "é\u2028\x00", "<p>", "long " * 60_000, "\ufeffBOM"]
    urls = [None, "", "no scheme", "http://A.example.com", "https://a.example.com/x?y#z", "http://b.org/\r\nX: 1 \t"]
    urls += ["http://hot.org/same"] * 6
    rows = [(i, rng.choice(urls), rng.choice(payloads)) for i in range(200)]
    rows += [(i * 10**7, rng.choice(urls), f"own {i}") for i in range(200, 400)]
    rows += [(None, "http://n.org/", "<p>"), (None, None, "nobody's"), (-5, "http://n.org/", "")]
    rows += rows[:20]
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "s", 2) for r in rows], COLUMNS)


def test_odd_pages(spark, tmp_path):
    rows = odd_pages()
    warc.write_archives(table(spark, rows).repartition(5), str(tmp_path / "w"))
    runs = warc.read_runs(spark, str(tmp_path / "w"), run=50, block=8)
    assert runs.agg({"n": "max"}).first()[0] <= 8
    for per_range in (7, 40, 10**6):
        found = warc.merged(runs, per_range).orderBy("place").collect()
        assert [r["place"] for r in found] == list(range(1, len(rows) + 1))
        names = ["payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured"]
        got = [(r["page"] if r["has_id"] else None, *[r[c] for c in names]) for r in found]
        assert [order(r) for r in got] == sorted(order(r) for r in brute(rows))
        assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_index_leads_to_records(spark, tmp_path):
    rows = odd_pages()
    warc.write_archives(table(spark, rows).repartition(3), str(tmp_path / "w"))
    files = {int(p.name.split("-")[1]): gzip.decompress(p.read_bytes()) for p in Path(tmp_path / "w").glob("part-*")}
    texts = {}
    for p, _, x in rows:
        texts.setdefault(p, []).append((x or "").encode())
    for r in warc.capture_index(spark, str(tmp_path / "w")).collect():
        head, rest = files[r["part"]][r["offset"] :].split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        if r["record_type"] == "response":
            body = rest.split(b"\r\n\r\n", 1)[1]
            assert body[: r["payload_bytes"]] in texts[r["page_id"]]
            assert body[r["payload_bytes"] :][:4] == b"\r\n\r\n"


def test_least_size(spark):
    rows = [(k, "http://a.org/", x) for k, x in enumerate(["", "", "four", "four", "12345", "12345"])]
    values = [r["value"] for r in warc.records(table(spark, rows), least=5).collect()]
    assert sum("WARC-Type: revisit" in v for v in values) == 1


def test_damage(spark, tmp_path):
    warc.write_archives(table(spark, [(1, "http://a.org/", "some text")]), str(tmp_path / "w"))
    for f in (tmp_path / "w").glob("part-*"):
        spoilt = gzip.decompress(f.read_bytes()).replace(b"some", b"sane")
        (tmp_path / "w" / f".{f.name}.crc").unlink()
        f.write_bytes(gzip.compress(spoilt))
    with pytest.raises(Exception, match="damaged record <urn:page:1>"):
        warc.read_runs(spark, str(tmp_path / "w"))


def test_empty(spark, tmp_path):
    warc.write_archives(table(spark, []), str(tmp_path / "w"))
    assert warc.capture_index(spark, str(tmp_path / "w")).collect() == []


def test_loser_tree():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 7, 16, 33):
        for most in (1, 5, 60):
            lists = [sorted((rng.randrange(25), rng.randrange(3), i) for _ in range(rng.randrange(most))) for i in range(k)]
            assert list(warc.LoserTree(lists, 2)) == sorted((r for x in lists for r in x), key=lambda r: (r[:2], r[2]))


def test_base32(spark):
    digests = [hashlib.sha1(bytes([k])).digest() for k in range(50)] + [bytes(20), b"\xff" * 20]
    df = spark.createDataFrame([(d.hex(),) for d in digests], "h string")
    assert [r[0] for r in df.select(warc.base32(df["h"])).collect()] == [base64.b32encode(d).decode() for d in digests]
