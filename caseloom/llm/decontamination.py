"""Benchmark decontamination by winnowing.

A fingerprint is the least hash of K-word grams in each window of consecutive grams. A window spans exactly ``SPAN``
words, so every span of SPAN words that a document shares with an item shares a fingerprint at the same place. An item
shorter than SPAN is one window, and its only fingerprint is the hash of all its words.

1. The items' fingerprints are made in tasks, and kept as a table. A bitmap of their hashes, of bounded size, goes to all
   tasks that read documents: only fingerprints that it knows leave them.
2. Both tables of fingerprints are joined by hash. What they give are places; each document's are gathered.
3. Each document meets its places and the texts of the items there, and each place is extended to both sides as far as words
   agree, byte by byte; runs of SPAN words or more are hits. So hashes only propose, and nothing of a passage is missed.

The benchmark may be of any size: Spark chooses by size whether a side of a join is broadcast.

Null and empty texts have no words. Repeated rows and equal ids are judged row by row; items with equal ids count once,
a null id as the empty name. Texts of any length are read whole. Empty tables give empty results or no hits. Other columns
travel along in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from caseloom.llm import arrays
from caseloom.llm.store import stored

SPAN = 13
K = 5
# Bits of the bitmap: 32 for each fingerprint of the items, between these bounds (8 KB and 16 MB).
LEAST_BITS, MOST_BITS = 16, 27
# Bytes of a word after lower-casing A-Z: digits, letters and everything beyond ASCII.
INSIDE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def fingerprints(hashes: np.ndarray, row: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) that winnowing selects; of equal hashes in a window, the last."""
    found = arrays.grams(hashes, k)
    width = span - k + 1
    if len(found) < width:
        return np.zeros(0, np.int64), found[:0]
    windows = np.lib.stride_tricks.sliding_window_view(found, width)
    least = width - 1 - np.argmin(windows[:, ::-1], axis=1) + np.arange(len(windows))
    places = np.unique(least[row[: len(windows)] == row[span - 1 : span - 1 + len(windows)]])
    return places, found[places]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its text, where each text's words begin)."""
    data = arrays.LOWER[data]
    starts, ends, row = arrays.words(data, offsets, INSIDE)
    return arrays.word_hashes(data, starts, ends), row, np.searchsorted(row, np.arange(len(offsets)))


def word_list(text: str | None) -> list[bytes]:
    data = (text or "").encode()
    lower = arrays.LOWER[np.frombuffer(data, np.uint8)] if data else np.zeros(0, np.uint8)
    starts, ends, _ = arrays.words(lower, np.array([0, len(data)]), INSIDE)
    data = lower.tobytes()
    return [data[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def keyed_by(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of windows of n words don't meet those of others."""
    return arrays.mix(hashes + np.uint64(n) * np.uint64(arrays.BASE)).view(np.int64)


def _item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n`` is the length of a short item, 0 for others."""
    for batch, data, offsets in arrays.blocks(batches):
        hashes, row, first = words_of(data, offsets)
        lengths = np.diff(first)
        places, keys = fingerprints(hashes, row)
        parts = [(places, keyed_by(keys, 0), 0)]
        for n in sorted(set(lengths[(lengths > 0) & (lengths < SPAN)].tolist())):
            own = first[:-1][lengths == n]
            parts.append((own, keyed_by(arrays.grams(hashes, n)[own], n), n))
        for own, found, n in parts:
            item = batch.take(pa.array(row[own], pa.int64()))
            yield pa.record_batch({"name": item.column("name"), "it": item.column("it"), "q": pa.array(own - first[row[own]], pa.int64()), "h": pa.array(found, pa.int64()), "n": pa.array(np.full(len(own), n), pa.int32())})


def _doc_prints(shared, lengths: list[int]):
    """Fingerprints of documents that the bitmap knows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        mask = np.int64(8 * len(bits) - 1)

        def known(keys: np.ndarray) -> np.ndarray:
            slot = keys & mask
            return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)

        for batch, data, offsets in arrays.blocks(batches):
            hashes, row, first = words_of(data, offsets)
            places, keys = fingerprints(hashes, row)
            parts = [(places, keyed_by(keys, 0), 0)]
            for n in lengths:
                keys = keyed_by(arrays.grams(hashes, n), n)
                places = np.flatnonzero(row[: len(keys)] == row[n - 1 : n - 1 + len(keys)])
                parts.append((places, keys[places], n))
            for places, keys, n in parts:
                few = known(keys)
                if len(few):
                    own = places[few]
                    doc = batch.take(pa.array(row[own], pa.int64()))
                    yield pa.record_batch({"key": doc.column("key"), "t": doc.column("t"), "p": pa.array(own - first[row[own]], pa.int64()), "h": pa.array(keys[few], pa.int64()), "n": pa.array(np.full(len(few), n), pa.int32())})

    return work


def bitmap(prints: DataFrame) -> np.ndarray:
    """Which hashes occur, by their low bits: pieces of 4 KB from Spark's bitmaps, at most 16 MB in all."""
    count = prints.count()
    width = min(MOST_BITS, max(LEAST_BITS, (32 * count).bit_length()))
    slot = F.col("h").bitwiseAND((1 << width) - 1)
    pieces = prints.groupBy(F.shiftright(slot, 15).alias("piece")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in pieces:
        out[r["piece"] * 4096 : r["piece"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def agree(a: list[bytes], b: list[bytes], i: int, j: int) -> int:
    """Words from a[i] and b[j] on that are equal."""
    n, at, step = min(len(a) - i, len(b) - j), 0, 16
    while at < n and a[i + at : i + at + step] == b[j + at : j + at + step]:
        at, step = at + step, step * 2
    at = min(at, n)
    while at < n and a[i + at] == b[j + at]:
        at += 1
    return at


def agree_before(a: list[bytes], b: list[bytes], i: int, j: int) -> int:
    """Words right before a[i] and b[j] that are equal."""
    at = 0
    while at < min(i, j) and a[i - 1 - at] == b[j - 1 - at]:
        at += 1
    return at


def runs_in(words: list[bytes], item: list[bytes], places: list[tuple[int, int, int]]) -> list[list[int]]:
    """Runs of ``words`` that are in windows of ``item``; places: (p, q, length of a short item or 0)."""
    out, done = [], {}  # shift -> end of the run that was extended last
    for p, q, n in sorted(places):
        if n:
            if words[p : p + n] == item:
                out.append([p, p + n])
        elif done.get(p - q, -1) <= p:
            right = agree(words, item, p, q)
            if right:
                left = agree_before(words, item, p, q)
                done[p - q] = p + right
                if left + right >= SPAN:
                    out.append([p - left, p + right])
    return out


def union(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, stop in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays.release()
    items: dict[str, list[bytes]] = arrays.Recent(100)
    for batch in batches:
        texts = batch.column("row").field("text")
        flat = pa.record_batch({"text": texts.cast(pa.string()), "at": pa.array(range(len(batch)))})
        counts = np.zeros(len(batch), np.int64)
        for part, data, offsets in arrays.blocks([flat]):
            starts, _, row = arrays.words(arrays.LOWER[data], offsets, INSIDE)
            counts[part.column("at").to_numpy()] = np.bincount(row, minlength=len(part))
        runs, names = [[] for _ in range(len(batch))], [[] for _ in range(len(batch))]
        for i in np.flatnonzero(batch.column("found").is_valid().to_numpy(zero_copy_only=False)).tolist():
            words, hits, held = word_list(texts[i].as_py()), [], set()
            for found in batch.column("found")[i].as_py():
                item = items.get(found["text"]) or items.find(found["text"])
                if item is None:
                    item = word_list(found["text"])
                    items.keep(found["text"], item)
                more = runs_in(words, item, [(x["p"], x["q"], x["n"]) for x in found["places"]])
                if more:
                    hits += more
                    held.add(found["name"])
            runs[i], names[i] = [x for pair in union(hits) for x in pair], sorted(held)
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))],
            names=["row", "n_words", "runs", "items"],
        )


def find_contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id") -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_words``, ``runs`` (start and end of each maximal run of hit words, one
    after the other) and ``items`` (sorted names of the items found)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), "text").where("text is not null").distinct()
    items = stored(items.select("name", F.xxhash64("text").alias("it"), "text"))
    prints = stored(items.mapInArrow(_item_prints, "name string, it long, q long, h long, n int"))
    lengths = sorted(r["n"] for r in prints.where("n > 0").select("n").distinct().collect())  # at most SPAN - 1
    shared = spark.sparkContext.broadcast(bitmap(prints))
    # A document is named by its id and the hash of its text: rows equal in both have the same places, and what rows with
    # different texts would add to each other are places that don't agree.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id}`").alias("key"), F.xxhash64("text").alias("t"), "text")
    kind = docs.schema[id].dataType.simpleString()
    places = rows.select("key", "t", "text").mapInArrow(_doc_prints(shared, lengths), f"key {kind}, t long, p long, h long, n int").distinct()
    met = places.join(prints, ["n", "h"])
    met = met.groupBy("key", "t", "name", "it").agg(F.collect_list(F.struct("p", "q", "n")).alias("places"))
    found = met.join(items, ["name", "it"]).groupBy("key", "t").agg(F.collect_list(F.struct("name", "text", "places")).alias("found"))
    found = stored(found.withColumnsRenamed({"key": "found_key", "t": "found_t"}))
    both = rows.select("row", "key", "t").join(found, F.col("key").eqNullSafe(F.col("found_key")) & (F.col("t") == F.col("found_t")), "left").select("row", "found")
    schema = StructType([both.schema["row"], StructField("n_words", LongType()), StructField("runs", ArrayType(LongType())), StructField("items", ArrayType(StringType()))])
    return both.mapInArrow(_extend, schema)


def n_hit(runs: str = "runs"):
    """Words in the runs."""
    return F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["n"] + a["sign"] * x).alias("n"), (-a["sign"]).alias("sign")), lambda a: a["n"])


def is_contaminated():
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))
