"""Token ids on disk: one zstandard frame per document, all with a shared dictionary.

The file format is a folder with three tables, written and read by Spark:

* ``blocks``: ``part``, ``first_id``, ``last_id``, ``before`` (ids of the documents before it in its part), ``dictionary``
  (SHA-256 of the dictionary, empty: none), ``width`` (bytes per id, little-endian), the index ``doc_ids``, ``counts``
  (ids per document), ``offsets`` (byte place of each frame, one more at the end), and ``frames``, one after the other.
* ``parts``: each part's number of ids and ``start``, the ids of all documents before it. Parts are ranges of doc_id.
* ``dictionary``: its hash and content.

A short document is read from its block alone (Parquet's statistics of first_id and last_id skip the others), and of
the block only its own frame is decompressed.

The dictionary is trained on the documents with the ``sample`` least hashes of doc_id, at most ``sample_ids`` ids of
each: a parameter of compression only, every id of every document is stored. Ids come from the tokenizers library.

Null and empty texts have the end id only. Documents with equal ids stand side by side, a null id before all others.
An empty table gives no blocks. Columns besides doc_id and text are not stored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm import arrays
from caseloom.llm.bpe import Splitter
from caseloom.llm.store import shared_folder

WORDS_KEPT = 450_000
SCHEMA = pa.schema([
    ("part", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("before", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary()),
])
DDL = (
    "part int, first_id long, last_id long, before long, dictionary string, width int, "
    "doc_ids array<long>, counts array<long>, offsets array<long>, frames binary"
)


class Tokens:
    """Ids as bytes. The library encodes each distinct part of the texts; recent ones are kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        splitter = Splitter(path)
        self.parts = splitter.parts
        self.ends = np.zeros(self.library.get_vocab_size(), bool)  # tokens that end a word
        if splitter.fixed and splitter.suffix:
            self.ends[[i for name, i in self.library.get_vocab().items() if name.endswith(splitter.suffix)]] = True
        self.known = arrays.Recent(WORDS_KEPT)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        return [x for at in range(0, len(texts), 256) for x in self._some(texts[at : at + 256])]

    def _some(self, texts: list[str]) -> list[bytes]:
        rows = [self.parts(t) for t in texts]
        distinct = set().union(*rows)
        own = dict(zip(distinct, map(self.known.get, distinct), strict=True))
        own |= {p: self.known.find(p) for p, x in own.items() if x is None}
        fresh = [p for p, x in own.items() if x is None]
        # Letters alone are one word each: many go to the library as one text, in which a token that ends a word ends a part.
        words = [p for p in fresh if p.isalpha()] if self.ends.any() else []
        for at in range(0, len(words), 512):
            some = words[at : at + 512]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, f"<u{self.width}")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.width).tolist()
            if len(stops) == len(some):
                packed = ids.tobytes()
                own.update(zip(some, (packed[x:y] for x, y in zip([0, *stops], stops)), strict=True))
        rest = [p for p in fresh if own[p] is None]
        for p, x in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            own[p] = np.array(x.ids, f"<u{self.width}").tobytes()
        for p in fresh:
            if len(p) < 64:
                self.known.keep(p, own[p])
        return [b"".join(map(own.__getitem__, row)) for row in rows]


def tokens(path: str) -> Tokens:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return arrays.kept(("tokens", path), lambda: Tokens(path))


def _texts(batch_block) -> list[str]:
    _, data, ends = batch_block
    text = data.tobytes()
    return [text[a:b].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def train_dictionary(docs: DataFrame, path: str, size: int, sample: int, sample_ids: int) -> bytes:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path)
        for block in arrays.blocks(batches, keep=True):
            ids = [x[: sample_ids * encoder.width] for x in encoder.encode(_texts(block))]
            yield pa.record_batch({"ids": pa.array(ids, pa.binary())})

    chosen = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").limit(sample).mapInArrow(encoded, "ids binary").collect()
    try:
        return zstandard.train_dictionary(size, [bytes(r["ids"]) for r in rows if r["ids"]], level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text for a dictionary
        return b""


def _encode_blocks(path: str, end_id: int, dictionary: bytes, block_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens(path)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if trained:
            trained.precompute_compress(level=1)  # once, not for each document
        packer = zstandard.ZstdCompressor(level=1, dict_data=trained)
        end = int(end_id).to_bytes(encoder.width, "little")
        name = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
        ids, counts, frames, size, before = [], [], [], 0, 0

        def block(part: int) -> pa.RecordBatch:
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])])
            row = {
                "part": part, "first_id": min(known, default=None), "last_id": max(known, default=None), "before": before, "dictionary": name,
                "width": encoder.width, "doc_ids": ids, "counts": counts, "offsets": offsets.tolist(), "frames": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for own in arrays.blocks(batches, keep=True):
            part = own[0].column("part")[0].as_py()
            for doc_id, text in zip(own[0].column("doc_id").to_pylist(), encoder.encode(_texts(own)), strict=True):
                frame = packer.compress(text + end)
                if frames and size + len(frame) > block_bytes:
                    yield block(part)
                    before += sum(counts)
                    ids, counts, frames, size = [], [], [], 0
                ids.append(doc_id)
                counts.append(len(text) // encoder.width + 1)
                frames.append(frame)
                size += len(frame)
        if frames:
            yield block(part)

    return work


def write_tokens(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, dictionary_bytes: int = 64 << 10, sample: int = 1000,
    sample_ids: int = 2000, block_bytes: int = 1 << 20,
) -> str:
    """Write the ids of all documents, each with ``end_id`` after them, in ascending doc_id order. Returns the folder."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder = folder or shared_folder(spark)
    dictionary = train_dictionary(docs, path, dictionary_bytes, sample, sample_ids)
    name = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, content binary").write.parquet(f"{folder}/dictionary")
    # Rows of one id may be many: the hash of the text and the row's place split them.
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "place")
    blocks = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_encode_blocks(path, end_id, dictionary, block_bytes), DDL)
    blocks.write.option("compression", "none").parquet(f"{folder}/blocks")
    sums = spark.read.schema(DDL).parquet(f"{folder}/blocks").groupBy("part").agg(
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda n, c: n + c)).alias("ids")
    )
    # One row per part: a window over them all is small.
    sums.withColumn("start", F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).write.parquet(f"{folder}/parts")
    return folder


def _decode(dictionary: bytes, wanted: int | None, digest: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        reader = zstandard.ZstdDecompressor(dict_data=trained)
        name = hashlib.sha256(dictionary).hexdigest() if dictionary else ""
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"the block asks for dictionary {row['dictionary']}, the folder has {name}")
                start, out = row["start"] + row["before"], []
                frames = memoryview(row["frames"])
                for doc_id, count, a, b in zip(row["doc_ids"], row["counts"], row["offsets"], row["offsets"][1:], strict=False):
                    if wanted is None or wanted == doc_id:
                        ids = np.frombuffer(reader.decompress(frames[a:b]), f"<u{row['width']}").astype("<u4")
                        if len(ids) != count:
                            raise ValueError(f"document {doc_id}: {len(ids)} ids, the index has {count}")
                        out.append((doc_id, start, count, crc32(ids.tobytes()) if digest else ids))
                    start += count
                columns = list(zip(*out, strict=True)) or [[]] * 4
                kinds = [pa.int64()] * 4 if digest else [pa.int64()] * 3 + [pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"],
                )

    return work


def read_tokens(spark: SparkSession, folder: str, doc_id: int | None = None, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids (with ``digest`` the CRC-32 of the ids as 32-bit integers) of all documents, or
    of one document from its blocks alone."""
    content = bytes(spark.read.parquet(f"{folder}/dictionary").first()["content"])
    blocks = spark.read.schema(DDL).parquet(f"{folder}/blocks")
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    parts = spark.read.schema("part int, ids long, start long").parquet(f"{folder}/parts").select("part", "start")
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    return blocks.join(parts, "part").mapInArrow(_decode(content, doc_id, digest), schema)
