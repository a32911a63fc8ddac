"""Web archives in ZIP packages: written by many tasks, read by ranges without extraction.

Writing. A record per page (response, gzip member of its own) is made where the page is read and stored. Of records with
equal payloads of ``LEAST`` bytes or more (SHA-256; the digest in the record is SHA-1) the one with the greatest id is the
response, ties by place; only counts and that id are gathered per payload, partially before the shuffle, and the join with
them is one that Spark can split. Others become revisits, which refer to it. Every task writes packages of bounded size:
``archive/data.warc.gz`` and ``indexes/index.cdxj`` as stored members, and ``datapackage.json``. File names hold a random
part and the table of packages is committed by Spark, so what a lost or repeated task leaves is never read.

Reading. A task opens a package at its end: end record, ZIP64 end record where there is one, central directory. It finds
the archive members and their indexes by name, and turns index lines into runs of neighbouring records, which are dealt over
all tasks; each run is one range read. So a package of any size is read by many tasks, and only the records' bytes are. Members
without index are scanned for record ends, deflated members are inflated in one task: the exact way for the rest.

Null payloads are empty. Ids may be null or repeated, rows repeated: each row is a record, and of rows with equal payload and
id one is the response. Addresses may be null or odd: they are percent-encoded. Texts may have any length. Empty tables give
no packages. Other columns are ignored. A package, member or record that can't be read is a row with ``error``.

Packages lie in a folder that driver and executors share, by any address that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import arrays
from caseloom.llm.store import shared_folder, stored

LEAST = 1000  # bytes of a payload, from which records refer to an equal one
PACKAGE_BYTES = 256 << 20
RUN_BYTES = 4 << 20
# Names in packages, the profile of revisits, and the head of a page.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
# Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
STORED, DEFLATED = 0, 8


# --- records -----------------------------------------------------------------


def packed(data: bytes) -> bytes:
    """One gzip member; the same bytes whenever it is made."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record_id(name: str | None, uid: int) -> str:
    return f"<urn:caseloom:{'none:' if name is None else 'page:' + quote(name, safe='')}:{uid}>"


def page_of(record: str | None) -> str | None:
    found = re.fullmatch(r"<urn:caseloom:page:([^:]*):\d+>", record or "")
    return unquote(found[1]) if found else None


def target(url: str | None, name: str | None) -> str:
    return quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:caseloom:{quote(name or '', safe='')}"


def record(kind: str, uid: int, name: str | None, url: str | None, digest: str, size: int, payload: bytes = b"", refers_to: str | None = None) -> bytes:
    block = HTTP.format(size).encode() + payload
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(name, uid), "WARC-Date": DATE, "WARC-Target-URI": target(url, name), "WARC-Payload-Digest": f"sha1:{digest}",
        **({"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to} if refers_to else {}), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return packed(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n")


def parsed(data: bytes) -> dict:
    """Headers (lower-case names) and payload of a record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("not a record")
    names = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(names.get("content-length", len(rest)))]
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/"):
        payload, http = block, b""
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    return {"names": names, "payload": payload, "size": int(length[1]) if length else len(payload)}


# --- writing -----------------------------------------------------------------


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page as a response."""
    arrays.release()
    uid = TaskContext.get().partitionId() << 33
    for batch in batches:
        names, urls = batch.column("name").to_pylist(), batch.column("url").to_pylist()
        rows = []
        for name, url, payload in zip(names, urls, batch.column("payload"), strict=True):
            data = payload.as_py() or b""
            digest = hashlib.sha1(data).hexdigest()
            key = hashlib.sha256(data).digest() if len(data) >= LEAST else None
            rows.append((uid, name, url, len(data), digest, key, record("response", uid, name, url, digest, len(data), data)))
            uid += 1
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        kinds = {"uid": pa.int64(), "name": pa.string(), "url": pa.string(), "size": pa.int64(), "digest": pa.string(), "key": pa.binary(), "data": pa.binary()}
        yield pa.record_batch({c: pa.array(list(v), kinds[c]) for c, v in zip(kinds, columns, strict=True)})


class Package:
    """A ZIP package that grows record by record."""

    def __init__(self, folder: str, limit: int):
        self.system, place = fs.FileSystem.from_uri(folder)
        self.system.create_dir(place, recursive=True)
        self.name = f"data-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zip"
        self.path, self.limit = f"{folder.rstrip('/')}/{self.name}", limit
        self.stream = self.system.open_output_stream(f"{place.rstrip('/')}/{self.name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines, self.size, self.sha = [], 0, hashlib.sha256()

    def add(self, data: bytes, kind: str, url: str, digest: str) -> bool:
        """Whether the package is full now."""
        line = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "digest": f"sha1:{digest}", "length": len(data), "offset": self.size, "filename": ARCHIVE.rpartition("/")[2]}
        self.lines.append(f"{url} {re.sub('[^0-9]', '', DATE)} {json.dumps(line)}")
        self.member.write(data)
        self.sha.update(data)
        self.size += len(data)
        return self.size >= self.limit

    def close(self) -> dict:
        self.member.close()
        index = "".join(f"{line}\n" for line in sorted(self.lines)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        resources = [{"path": ARCHIVE, "bytes": self.size, "hash": f"sha256:{self.sha.hexdigest()}"}, {"path": INDEX, "bytes": len(index), "hash": f"sha256:{hashlib.sha256(index).hexdigest()}"}]
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()
        length = self.stream.tell()
        self.stream.close()
        return {"path": self.path, "length": length, "records": len(self.lines)}


def _write(folder: str, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("uid", "name", "url", "size", "digest", "refers_uid", "refers_name")}
            for i, (uid, name, url, size, digest, refers_uid, refers_name) in enumerate(zip(*columns.values(), strict=True)):
                kind = "response" if refers_uid is None else "revisit"
                data = batch.column("data")[i].as_py() if refers_uid is None else record(kind, uid, name, url, digest, size, refers_to=record_id(refers_name, refers_uid))
                package = package or Package(folder, limit)
                if package.add(data, kind, target(url, name), digest):
                    yield pa.RecordBatch.from_pylist([package.close()])
                    package = None
        if package:
            yield pa.RecordBatch.from_pylist([package.close()])

    return work


def write_packages(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """The stored table of packages (path, length, records) that hold one record per page."""
    source = pages.select(F.col(id).cast("string").alias("name"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("payload"), F.col(id).alias("order"))
    made = source.select("name", "url", "payload").mapInArrow(_records, "uid long, name string, url string, size long, digest string, key binary, data binary")
    made = stored(made)
    order = F.col("name").cast(pages.schema[id].dataType)
    last = made.where("key is not null").groupBy("key").agg(F.max(F.struct(order.alias("order"), F.col("uid"), F.col("name"))).alias("last"), F.count(F.lit(1)).alias("n"))
    last = stored(last.where("n > 1").select("key", F.col("last.uid").alias("last_uid"), F.col("last.name").alias("last_name")))
    # Short payloads have no key: they pass beside the join, so that no partition gathers them.
    single = made.where("key is null").withColumns({"refers_uid": F.lit(None).cast("long"), "refers_name": F.lit(None).cast("string")})
    revisit = F.col("last_uid") != F.col("uid")
    joined = made.where("key is not null").join(last, "key", "left").select(
        "uid", "name", "url", "size", "digest", F.when(revisit, F.lit(None)).otherwise(F.col("data")).alias("data"),
        F.when(revisit, F.col("last_uid")).alias("refers_uid"), F.when(revisit, F.col("last_name")).alias("refers_name"),
    )
    folder = shared_folder(pages.sparkSession)
    columns = ["uid", "name", "url", "size", "digest", "data", "refers_uid", "refers_name"]
    return stored(joined.select(*columns).unionByName(single.select(*columns)).mapInArrow(_write(folder, package_bytes), "path string, length long, records long"))


# --- reading -----------------------------------------------------------------


def _extra64(extra: bytes, sizes: list[int]) -> list[int]:
    """(size, packed size, offset) with those of 32 full bits taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        tag, length = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            field = at + 4
            for i, value in enumerate(sizes):
                if value == 0xFFFFFFFF:
                    (sizes[i],) = struct.unpack_from("<Q", extra, field)
                    field += 8
        at += 4 + length
    return sizes


def directory(file, length: int) -> list[dict]:
    """Members of a package: name, method, packed and full size, and where the local header is. ``file``: `read_at`."""
    start = max(0, length - 22 - 0xFFFF - 20)
    tail = file.read_at(length - start, start)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature within a comment
    if at < 0:
        raise ValueError("no end of a ZIP directory")
    _, size, offset = struct.unpack_from("<HLL", tail, at + 10)
    end = start + at
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        (place,) = struct.unpack_from("<Q", tail, at - 12)
        head = file.read_at(56, place) if place + 56 <= length else b""
        if head[:4] != END64:
            raise ValueError("no ZIP64 end record where its locator points")
        size, offset = struct.unpack_from("<QQ", head, 40)
        end = place
    shift = end - size - offset  # bytes before the package
    if shift < 0:
        raise ValueError("a ZIP directory beyond the file")
    data, at, out = file.read_at(size, offset + shift), 0, []
    while at + 46 <= len(data) and data[at : at + 4] == CENTRAL:
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed_size, full = struct.unpack_from("<LL", data, at + 20)
        name, extra, comment = struct.unpack_from("<HHH", data, at + 28)
        (local,) = struct.unpack_from("<L", data, at + 42)
        first = at + 46
        full, packed_size, local = _extra64(data[first + name : first + name + extra], [full, packed_size, local])
        out.append({"name": data[first : first + name].decode("utf-8" if flags & 0x800 else "cp437"), "method": method, "packed": packed_size, "size": full, "local": local + shift})
        at = first + name + extra + comment
    return out


def begin(file, member: dict) -> int:
    """Where the bytes of a member begin: its local header has a name and fields of its own."""
    head = file.read_at(30, member["local"])
    if head[:4] != LOCAL:
        raise ValueError("no local header of " + member["name"])
    return member["local"] + 30 + sum(struct.unpack_from("<HH", head, 26))


def content(file, member: dict) -> bytes:
    """A whole member, for indexes."""
    data = file.read_at(member["packed"], begin(file, member))
    if member["method"] == DEFLATED:
        data = zlib.decompress(data, -15)
    elif member["method"] != STORED:
        raise ValueError(f"method {member['method']} of {member['name']}")
    return gzip.decompress(data) if member["name"].endswith(".gz") else data


def pieces(file, member: dict) -> Iterator[bytes]:
    """The bytes of a member, inflated if it was deflated."""
    place, left = begin(file, member), member["packed"]
    if member["method"] not in (STORED, DEFLATED):
        raise ValueError(f"method {member['method']} of {member['name']}")
    inflate = zlib.decompressobj(-15) if member["method"] == DEFLATED else None
    while left:
        data = file.read_at(min(left, RUN_BYTES), place)
        if not data:
            raise ValueError("a member ends early")
        place, left = place + len(data), left - len(data)
        yield inflate.decompress(data) if inflate else data


def scanned(parts: Iterator[bytes], compressed: bool) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of a member that has no index."""
    held, offset = b"", 0
    unpack = None
    if compressed:
        record_bytes = bytearray()
        for part in parts:
            while part:
                unpack = unpack or zlib.decompressobj(31)
                unpack.decompress(part)
                rest = unpack.unused_data
                record_bytes += part[: len(part) - len(rest)]
                if unpack.eof:
                    yield offset, bytes(record_bytes)
                    offset, unpack, record_bytes = offset + len(record_bytes), None, bytearray()
                part = rest
        if record_bytes:
            raise ValueError("a record ends early")
        return
    for part in parts:
        held += part
        while (cut := held.find(b"\r\n\r\n")) >= 0:
            length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", held[:cut])
            stop = cut + 4 + int(length[1] if length else 0) + 4
            if len(held) < stop:
                break
            yield offset, held[:stop]
            held, offset = held[stop:], offset + stop
    if held.strip():
        raise ValueError("a record ends early")


def is_archive(name: str) -> bool:
    return name.endswith((".warc", ".warc.gz"))


def is_index(name: str) -> bool:
    return name.startswith("indexes/") and name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))


def indexed(file, members: list[dict]) -> dict[str, list[tuple[int, int]]]:
    """File name of an archive member -> (offset, length) of its records."""
    out: dict[str, list[tuple[int, int]]] = {}
    for member in members:
        if is_index(member["name"]):
            for line in content(file, member).decode().split("\n"):
                if (at := line.find("{")) >= 0:
                    entry = json.loads(line[at:])
                    out.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    return out


def _open(path: str):
    """A stream with random access, by any address that ``pyarrow.fs`` opens; names may hold blanks."""
    local = re.match("file:/+", path)
    if local or path.startswith("/"):
        return fs.LocalFileSystem().open_input_file("/" + path[local.end() :] if local else path)
    scheme, _, rest = path.partition("://")
    system, place = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return system.open_input_file(place)


RUNS = "path string, member string, start long, offsets array<long>, lengths array<long>, data binary, error string"


def _runs(run_bytes: int):
    """Runs of neighbouring records of each package; ``data`` only for members that can't be read by ranges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()

        def row(path, member=None, start=None, offsets=None, lengths=None, data=None, error=None) -> pa.RecordBatch:
            kinds = {"path": pa.string(), "member": pa.string(), "start": pa.int64(), "offsets": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "data": pa.binary(), "error": pa.string()}
            return pa.record_batch({c: pa.array([v], kinds[c]) for c, v in zip(kinds, (path, member, start, offsets, lengths, data, error), strict=True)})

        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with _open(path) as file:
                        members = directory(file, file.size())
                        found = indexed(file, members)
                        for member in members:
                            if not is_archive(member["name"]):
                                continue
                            places = sorted(set(found.get(member["name"].rpartition("/")[2], [])))
                            if member["method"] == STORED and places:
                                at, run = begin(file, member), []
                                for offset, length in places:
                                    if offset < 0 or length <= 0 or offset + length > member["size"]:
                                        yield row(path, member["name"], error=f"index points outside: {offset}")
                                        continue
                                    if run and (offset != sum(run[-1]) or offset + length - run[0][0] > run_bytes):
                                        yield row(path, member["name"], at, [x for x, _ in run], [x for _, x in run])
                                        run = []
                                    run.append((offset, length))
                                if run:
                                    yield row(path, member["name"], at, [x for x, _ in run], [x for _, x in run])
                            else:
                                for offset, data in scanned(pieces(file, member), member["name"].endswith(".gz")):
                                    yield row(path, member["name"], None, [offset], [len(data)], data)
                except (ValueError, KeyError, OSError, struct.error, zlib.error) as error:
                    yield row(path, error=f"{type(error).__name__}: {error}"[:300])

    return work


RECORDS = "path string, member string, offset long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"


def _read(payloads: bool):
    def one(data: bytes) -> dict:
        found = parsed(zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data)
        names, payload = found["names"], found["payload"]
        digest = names.get("warc-payload-digest", "").partition(":")[2].lower()
        kind = names.get("warc-type")
        if kind != "revisit":
            found["size"], own = len(payload), hashlib.sha1(payload).hexdigest()
            if digest not in ("", own):
                raise ValueError("the payload has another digest")
            digest = own
        return {
            "record_type": kind, "record_id": names.get("warc-record-id"), "target_uri": names.get("warc-target-uri"), "refers_to": names.get("warc-refers-to"),
            "payload_digest": digest, "payload_bytes": found["size"], "payload": payload if payloads and kind != "revisit" else None,
        }

    kinds = {k: {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t] for k, t in (c.split() for c in RECORDS.split(", "))}
    schema = pa.schema(list(kinds.items()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (None, None)
        for batch in batches:
            for run in batch.to_pylist():
                place = {"path": run["path"], "member": run["member"]}
                if run["error"] is not None:
                    yield pa.RecordBatch.from_pylist([place | {"error": run["error"]}], schema=schema)
                    continue
                rows, data, first = [], run["data"], run["offsets"][0]
                if data is None:
                    if opened[0] != run["path"]:
                        opened = (run["path"], _open(run["path"]))
                    data = opened[1].read_at(run["offsets"][-1] + run["lengths"][-1] - first, run["start"] + first)
                for offset, length in zip(run["offsets"], run["lengths"], strict=True):
                    try:
                        rows.append(place | {"offset": offset} | one(data[offset - first : offset - first + length]))
                    except (ValueError, zlib.error) as error:
                        rows.append(place | {"offset": offset, "error": f"{type(error).__name__}: {error}"[:300]})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return work


def read_packages(packages: DataFrame, payloads: bool = True, run_bytes: int = RUN_BYTES) -> DataFrame:
    """A row per record of the packages (``path``), wherever they come from; rows with ``error`` for what can't be read."""
    spark = packages.sparkSession
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = packages.select("path").repartition(many).mapInArrow(_runs(run_bytes), RUNS)
    return runs.repartition(many).mapInArrow(_read(payloads), RECORDS)


def page(column: str):
    """The id within a record's own name (null for other archives' names and null ids)."""
    found = F.regexp_extract(column, r"^<urn:caseloom:page:([^:]*):\d+>$", 1)
    return F.when(F.rlike(F.col(column), F.lit(r"^<urn:caseloom:page:[^:]*:\d+>$")), F.url_decode(found))


def archive_pages(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Pages written and read back: id, payload_bytes, payload_digest, record_type, refers_to, and where they lie."""
    found = read_packages(write_packages(pages, id, url, payload), payloads=False)
    kind = pages.schema[id].dataType
    return found.select(page("record_id").cast(kind).alias(id), "payload_bytes", "payload_digest", "record_type", page("refers_to").cast(kind).alias("refers_to"), "offset", "error")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Packages of a folder (path, length), listed by Spark without their bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(folder).select("path", "length")
