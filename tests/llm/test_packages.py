"""Web archives in ZIP packages: round trips, and packages that other programs write."""

import gzip
import hashlib
import io
import json
import random
import struct
import zipfile

import pyarrow as pa
import pytest

from caseloom.llm import warc_packages as w

SCHEMA = "page_id long, url string, html string"


def rows():
    rng = random.Random(4)
    long = ["".join(rng.choice("abcé\r\n <>") for _ in range(n)) for n in (1200, 5000, 999, 400_000)]
    out = [(1, "http://a.example/", long[0]), (7, None, long[0]), (3, "http://b.example/x y\r\nEvil: 1", long[0]), (4, "é", long[1]), (5, "u", long[2]), (6, "u", long[2])]
    out += [(8, "u", None), (9, "u", ""), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (11, "u", long[3]), (None, "u", long[1]), (4, "u", long[1]), (4, "é", long[1]), (None, None, None)]
    return out + [(100 + i, "u", long[0]) for i in range(60)]


def expected(pages):
    """(page_id, payload_bytes, digest, record_type, refers_to), by hand."""
    last, out = {}, []
    for i, _, html in pages:
        key = (i is not None, i or 0)
        last[html or ""] = max(last.get(html or "", key), key)
    used = set()
    for i, _, html in pages:
        data, (known, top) = (html or "").encode(), last[html or ""]
        first = len(data) < 1000 or ((i is not None, i or 0) == (known, top) and html not in used)
        if len(data) >= 1000 and first:
            used.add(html)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def got(frame):
    assert frame.where("error is not null").count() == 0
    return sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in frame.collect()), key=str)


def test_round_trip(spark):
    table = spark.createDataFrame(rows(), SCHEMA).selectExpr("*", "1 AS name", "2 AS size", "3 AS digest", "4 AS error", "5 AS key")
    assert got(w.archive_pages(table.repartition(3))) == expected(rows())
    assert w.archive_pages(table.where("false")).collect() == []


def test_payloads_and_small_packages(spark):
    """Packages of a few records, runs of a few bytes; the payloads come back byte by byte."""
    table = spark.createDataFrame(rows(), SCHEMA).repartition(2)
    packages = w.write_packages(table, package_bytes=3000)
    assert packages.count() > 4 and packages.groupBy().sum("records").first()[0] == len(rows())
    found = w.read_packages(packages, run_bytes=500).where("record_type = 'response'").select(w.page("record_id").cast("long").alias("page_id"), "payload").collect()
    sent = {(i, (h or "").encode()) for i, _, h in rows()}
    assert {(r["page_id"], bytes(r["payload"])) for r in found} <= sent and {bytes(r["payload"]) for r in found} == {h for _, h in sent}
    assert sorted(w.files(spark, packages.first()["path"].rpartition("/")[0]).toPandas().length) == sorted(packages.toPandas().length)


def test_packages_are_plain_zip(spark):
    names = 0
    for row in w.write_packages(spark.createDataFrame(rows(), SCHEMA)).collect():
        with zipfile.ZipFile(row["path"].removeprefix("file://")) as package:
            assert package.testzip() is None and {i.compress_type for i in package.infolist()} == {zipfile.ZIP_STORED}
            resources = json.loads(package.read("datapackage.json"))["resources"]
            assert all(f"sha256:{hashlib.sha256(package.read(r['path'])).hexdigest()}" == r["hash"] for r in resources)
            names += gzip.decompress(package.read(w.ARCHIVE)).count(b"WARC-Record-ID")
    assert names == len(rows())


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, length, offset):
        return self.data[offset : offset + length]


def package(kind=zipfile.ZIP_STORED, index=True, compressed=True, lines=None):
    """A package as another program may write it: other names, plain or deflated members, with or without index."""
    records = []
    for i in range(5):
        block = f"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nx{i}y".encode()
        data = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
        records.append(gzip.compress(data) if compressed else data)
    out = io.BytesIO()
    name = "archive/rec-1.warc" + ".gz" * compressed
    with zipfile.ZipFile(out, "w", kind) as z:
        z.comment = b"PK\x05\x06 a comment with the signature"
        z.writestr(name, b"".join(records))
        if index:
            places = [sum(map(len, records[:i])) for i in range(5)]
            text = lines or "".join("org,example)/ 2020 " + json.dumps({"offset": str(p), "length": str(len(r)), "filename": name.split("/")[1]}) + "\n" for p, r in zip(places, records))
            z.writestr("indexes/index.cdx.gz", gzip.compress(text[:40].encode()) + gzip.compress(text[40:].encode()))
    return out.getvalue()


@pytest.mark.parametrize("options", [{}, {"index": False}, {"kind": zipfile.ZIP_DEFLATED}, {"compressed": False}, {"compressed": False, "index": False}, {"compressed": False, "kind": zipfile.ZIP_DEFLATED}])
def test_other_packages(spark, tmp_path, options):
    (tmp_path / "a b%20.zip").write_bytes(b"stub before" + package(**options))
    found = w.read_packages(w.files(spark, str(tmp_path))).collect()
    assert [r["error"] for r in found] == [None] * 5
    assert sorted(bytes(r["payload"]) for r in found) == [f"x{i}y".encode() for i in range(5)]


def as_zip64(data):
    """The same package with a ZIP64 end record, and ZIP64 fields in its directory."""
    file = Bytes(data)
    members, end = w.directory(file, len(data)), data.rfind(b"PK\x05\x06", 0, data.rfind(b"PK\x05\x06"))
    size, offset = struct.unpack_from("<LL", data, end + 12)
    central = b""
    for m in members:
        head = data[offset : offset + 46]
        name, extra, comment = struct.unpack_from("<HHH", head, 28)
        rest = data[offset + 46 : offset + 46 + name]
        offset += 46 + name + extra + comment
        field = struct.pack("<HHQQQ", 1, 24, m["size"], m["packed"], m["local"])
        central += head[:20] + b"\xff" * 8 + struct.pack("<HHH", name, 8 + len(field), 0) + head[34:42] + b"\xff" * 4 + rest + struct.pack("<HHL", 0xCAFE, 4, 7) + field
    start = struct.unpack_from("<L", data, end + 16)[0]
    end64 = struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, len(members), len(members), len(central), start)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(central), 1)
    return data[:start] + central + end64 + locator + struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64(spark, tmp_path):
    plain = package()
    wide = as_zip64(plain)
    with zipfile.ZipFile(io.BytesIO(wide)) as z:
        assert z.testzip() is None
    assert w.directory(Bytes(wide), len(wide)) == w.directory(Bytes(plain), len(plain))
    (tmp_path / "wide.zip").write_bytes(wide)
    assert sorted(bytes(r["payload"]) for r in w.read_packages(w.files(spark, str(tmp_path))).collect()) == [f"x{i}y".encode() for i in range(5)]


def test_places_beyond_32_bits():
    """A directory whose members lie beyond 4 GB, in a file that only its end is read of."""
    name, far = b"archive/far.warc.gz", 5 << 32
    field = struct.pack("<HHQQQ", 1, 24, 6 << 32, 6 << 32, far)
    central = struct.pack("<4sHHHHHHLLLHHHHHLL", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(field), 0, 0, 0, 0, 0xFFFFFFFF) + name + field
    start = 12 << 32
    tail = central + struct.pack("<4sQHHLLQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), start) + struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(central), 1)
    tail += struct.pack("<4sHHHHLLH", b"PK\x05\x06", 0, 0, 1, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0)

    class Far:
        def read_at(self, length, offset):
            gap = max(0, start - offset)
            return b"\0" * min(gap, length) + tail[max(0, offset - start) :][: max(0, length - gap)]

    assert w.directory(Far(), start + len(tail)) == [{"name": name.decode(), "method": 0, "packed": 6 << 32, "size": 6 << 32, "local": far}]


def test_broken_packages(spark, tmp_path):
    good = package()
    (tmp_path / "none.zip").write_bytes(b"")
    (tmp_path / "cut.zip").write_bytes(good[: len(good) // 2])
    (tmp_path / "good.zip").write_bytes(good)
    (tmp_path / "outside.zip").write_bytes(package(lines='x 1 {"offset": 0, "length": 999999, "filename": "rec-1.warc.gz"}\n'))
    (tmp_path / "hole.zip").write_bytes(good.replace(b"\x1f\x8b\x08", b"\x1f\x8b\x09", 1))
    # Spark doesn't list files without bytes.
    listed = w.files(spark, str(tmp_path)).union(spark.createDataFrame([(str(tmp_path / "none.zip"), 0)], "path string, length long"))
    found = w.read_packages(listed).collect()
    good_rows, bad = [r for r in found if r["error"] is None], [r["path"].rpartition("/")[2] for r in found if r["error"]]
    assert len(good_rows) == 9 and sorted(bad) == ["cut.zip", "hole.zip", "none.zip", "outside.zip"]


def test_digest_is_checked():
    data = w.record("response", 1, "1", "u", "0" * 40, 3, b"abc")
    run = {"path": "p", "member": "m", "start": None, "offsets": [0], "lengths": [len(data)], "data": data, "error": None}
    (batch,) = w._read(True)([pa.RecordBatch.from_pylist([run])])
    assert "digest" in batch.to_pylist()[0]["error"]
