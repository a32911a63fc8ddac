"""Evidence packages: zip archives of mixed files, emails opened to any depth.

Archives are listed without their bytes. A task opens one as a stream, reads its directory and inflates member by member,
so an archive may be far larger than a cell; its members leave that task as rows. Everything after intake works on
those rows, so the archive is the only unit that is not split. A `Guard` bounds what a member may inflate to.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caseloom.frames import arrow_runs
from caseloom.functions.text import basename, extension
from caseloom.operators.route import pending
from caseloom.sources.emails import attachments

# A cell holds at most 2 GB; larger members keep their row without bytes.
MAX_CELL = (1 << 31) - (1 << 20)
FLUSH_BYTES = 4 << 20
CHUNK = 1 << 20
# Bytes of archives that a task opens, about.
DEAL_BYTES = 64 << 20
KEEP_BYTES = 64 << 20

MEMBER = T.StructType(
    [
        T.StructField("package_id", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("ord", T.LongType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("via", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("error", T.StringType()),
    ]
)
_ARROW = {T.StringType(): pa.string(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
ROW = pa.schema([(f.name, _ARROW[f.dataType]) for f in MEMBER])


@dataclass
class _Rows:
    """Output rows, given out in batches of bounded bytes."""

    rows: list = field(default_factory=list)
    size: int = 0

    def add(self, *row) -> bool:
        self.rows.append(row)
        self.size += len(row[9] or b"") + 256
        return self.size >= FLUSH_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [()] * len(MEMBER)
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ROW, strict=True)], ROW)
        self.rows, self.size = [], 0
        return out


def _free_name(name: str, taken: dict[str, int]) -> str:
    """First free numbered form of a name in the attachment folder, which a package's emails share."""
    if name not in taken:
        taken[name] = 0
        return name
    dot = name.rfind(".")
    cut = dot if dot > 0 and name[:dot].strip(".") else len(name)
    while True:
        taken[name] += 1
        numbered = f"{name[:cut]}_{taken[name]}{name[cut:]}"
        if numbered not in taken:
            taken[numbered] = 0
            return numbered


def _is_email(name: str) -> bool:
    return name.lower().endswith(".eml") and name.lower().strip(".") != "eml"


@dataclass(frozen=True)
class Guard:
    """What archives may hold. A member beyond ``member`` inflated bytes, or ``ratio`` times its packed size, keeps its row
    with an error and without bytes; an archive of more than ``archive`` bytes is not opened."""

    member: int = MAX_CELL
    ratio: float | None = None
    archive: int | None = None


def _inflated(archive: zipfile.ZipFile, info: zipfile.ZipInfo, guard: Guard) -> tuple[bytes | None, str | None]:
    """(bytes, None) of a member whose checksum is right, or (None, error) as soon as the guard stops it."""
    if info.file_size > MAX_CELL:
        return None, "member too large for one row"
    parts, size = [], 0
    with archive.open(info) as stream:
        while part := stream.read(CHUNK):
            size += len(part)
            if size > guard.member:
                return None, f"member inflates beyond {guard.member} bytes"
            if guard.ratio is not None and size > guard.ratio * max(info.compress_size, 1):
                return None, f"member inflates more than {guard.ratio:g} times"
            parts.append(part)
    return b"".join(parts), None


def _members(package: str, file, guard: Guard = Guard(), check_first: bool = True) -> Iterator[tuple]:
    """Rows of one package in queue order: archive members first, then attachments level by level.

    A level keeps the way to its emails and, up to a budget, their bytes; beyond it an email is read
    again from the archive when its level is opened, so memory does not grow with the package.

    A bad member fails its package. One of few bytes is inflated before its first row leaves. With ``check_first`` a
    larger one is inflated once to check it and once for its rows; without, its error comes after rows of its members,
    and `good_files` drops those.
    """
    archive = zipfile.ZipFile(file)
    infos = sorted((i for i in archive.infolist() if not i.is_dir()), key=lambda i: i.filename)
    held = {}
    if sum(i.file_size for i in infos) <= KEEP_BYTES:
        held = {i: _inflated(archive, info, guard) for i, info in enumerate(infos)}
    elif check_first:
        for info in infos:
            _inflated(archive, info, guard)

    number, level, taken, kept = 0, [], {}, 0
    for i, info in enumerate(infos):
        file_id = f"{package}#{number}"
        data, error = held.pop(i) if i in held else _inflated(archive, info, guard)
        yield (package, file_id, None, 0, number, i, "archive", info.filename, info.file_size, data, error)
        if data is not None and _is_email(info.filename.rsplit("/", 1)[-1]):
            level.append((file_id, info, (), data if kept + len(data) <= KEEP_BYTES else None))
            kept += len(data) if level[-1][3] is not None else 0
        number += 1

    depth = 0
    while level:
        depth += 1
        deeper, kept = [], 0
        for parent_id, info, way, data in level:
            if data is None:
                data = archive.read(info)
                for step in way:
                    data = next(a.content for a in attachments(data) if a.ordinal == step)
            for item in attachments(data):
                file_id, name = f"{package}#{number}", _free_name(item.name, taken)
                yield (package, file_id, parent_id, depth, number, item.ordinal, item.via, name,
                       len(item.content), item.content, None)
                if _is_email(name) or item.via == "rfc822":
                    fits = kept + len(item.content) <= KEEP_BYTES
                    kept += len(item.content) if fits else 0
                    deeper.append((file_id, info, (*way, item.ordinal), item.content if fits else None))
                number += 1
        level = deeper


def open_stream(path: str):
    """A stream with random access, by any address that ``pyarrow.fs`` opens; names may hold blanks."""
    local = re.match("file:/+", path)
    if local or path.startswith("/"):
        return fs.LocalFileSystem().open_input_file("/" + path[local.end() :] if local else path)
    scheme, _, rest = path.partition("://")
    system, place = fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return system.open_input_file(place)


def _expanded(batches: Iterator[pa.RecordBatch], guard: Guard, check_first: bool) -> Iterator[pa.RecordBatch]:
    """Files of archives (``package_id`` and ``content`` or ``path``) as rows of ``ROW``."""
    out = _Rows()
    for batch in arrow_runs(batches):
        source = "content" if "content" in batch.schema.names else "path"
        for package, found in zip(batch.column("package_id"), batch.column(source), strict=True):
            package, found = package.as_py(), found.as_py()
            try:
                with io.BytesIO(bytes(found)) if source == "content" else open_stream(found) as file:
                    for row in _members(package, file, guard, check_first):
                        if out.add(*row):
                            yield out.batch()
            except Exception as error:
                out.add(package, None, None, 0, None, None, "archive", None, None, None,
                        f"{type(error).__name__}: {error}")
    yield out.batch()


def expand_packages(packages: DataFrame, guard: Guard = Guard(), check_first: bool = True) -> DataFrame:
    """Files of all packages from rows of ``package_id`` and ``content``, or ``package_id`` and ``path`` of archives that
    are read as streams.

    A bad archive gives one row with ``error`` and no ``file_id`` and none of its members.
    ``ord`` is the queue position in the package: first the members by path, then attachments in
    the order of the emails that hold them.
    """
    source = "content" if "content" in packages.columns else "path"

    name = basename(F.col("path"))
    return (
        packages.select("package_id", source)
        .mapInArrow(lambda batches: _expanded(batches, guard, check_first), MEMBER)
        .withColumn("file_name", name)
        .withColumn("ext", F.when(F.col("via") == "rfc822", ".eml").otherwise(extension(F.col("file_name"))))
    )


def content_hashes(archives: DataFrame) -> DataFrame:
    """With ``content_hash``, the SHA-256 of each archive (``path``), read as a stream. NULL for one that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    with open_stream(path) as file:
                        digest = hashlib.sha256()
                        while part := file.read(CHUNK):
                            digest.update(part)
                    found.append(digest.hexdigest())
                except (OSError, ValueError):
                    found.append(None)
            yield batch.append_column("content_hash", pa.array(found, pa.string()))

    schema = T.StructType([*archives.schema.fields, T.StructField("content_hash", T.StringType())])
    return archives.mapInArrow(run, schema)


def package_id(path: Column, root: str) -> Column:
    """Path of an archive below the folder that was read, without ``.zip``, so that archives of the same name in
    different folders stay apart. An extension in other letters stays: ``a.ZIP`` and ``a.zip`` are two packages."""
    folder = root.rstrip("/") + "/"
    start = F.instr(path, F.lit(folder))
    below = F.when(start > 0, F.substring(path, start + len(folder), F.length(path))).otherwise(path)
    return F.regexp_replace(below, r"\.zip$", "")


def list_archives(spark: SparkSession, path: str, glob: str = "*.[zZ][iI][pP]") -> DataFrame:
    """package_id, path, length and modified of all archives below ``path``; their bytes are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.select(package_id(F.col("path"), path).alias("package_id"), "path", "length", F.col("modificationTime").alias("modified"))


def dealt(archives: DataFrame) -> DataFrame:
    """The list, dealt over tasks by its bytes: stored lists and joins leave a short one in few partitions, though each row
    stands for a whole archive."""
    many, size = archives.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    tasks = max(4 * archives.sparkSession.sparkContext.defaultParallelism, size // DEAL_BYTES)
    return archives.repartition(max(1, min(many, tasks)))


def open_archives(archives: DataFrame, guard: Guard = Guard(), check_first: bool = True) -> DataFrame:
    """Files of listed archives. Those that the guard does not admit are error rows and are not opened."""
    if guard.archive is None:
        return expand_packages(archives, guard, check_first)
    files = expand_packages(archives.filter(F.col("length") <= guard.archive), guard, check_first)
    skipped = archives.filter(F.col("length") > guard.archive)
    error = F.lit(f"archive larger than {guard.archive} bytes").alias("error")
    return files.unionByName(skipped.select("package_id", error), allowMissingColumns=True)


def read_packages(
    spark: SparkSession, path: str, glob: str = "*.[zZ][iI][pP]", done: DataFrame | None = None, guard: Guard = Guard()
) -> DataFrame:
    """All archives below ``path``; the package id is the path below it.

    Packages listed in ``done`` are dropped before they are opened.
    """
    found = list_archives(spark, path, glob)
    return open_archives(found if done is None else pending(found, done), guard)


def ingest_errors(files: DataFrame) -> DataFrame:
    """Packages that could not be opened."""
    return files.filter(F.col("file_id").isNull()).select("package_id", "error")


def good_files(files: DataFrame, stored: bool = False) -> DataFrame:
    """Files of packages that could be opened. ``stored``: a table that `expand_packages` wrote without ``check_first``, in
    which rows of a package that turned out bad are dropped here."""
    good = files.filter(F.col("file_id").isNotNull())
    return good.join(ingest_errors(files).select("package_id").distinct(), "package_id", "left_anti") if stored else good
