"""Exact similarity join of documents on their word n-grams (Jaccard at least 3/4), and its classes.

1. Sets. Each text becomes the sorted 64-bit hashes of its distinct n-grams; equal sets get one id and go on once. In
   the same pass every n-gram is counted in a sketch of fixed size, which gives the rare-first order.
2. Prefixes. Two sets of Jaccard >= t share an n-gram among the first n - ceil(t n) + 1 of the larger and the first
   n - ceil(2 t n / (1 + t)) + 1 of the smaller one, in any common order. Prefix n-grams are dealt by hash into buckets
   and joined there, with the length and the positional filter.
3. A prefix n-gram that few sets share gives all its pairs. One that more than ``SMALL`` sets share first gives a
   linear number of pairs: each set with the next by length, and with a few that have the n-gram at an early position.
   Entries of an n-gram that very many sets share (by the sketch) are salted, so that no task gets all of them.
4. The best pairs of each set are verified and give first components. Then every other candidate pair whose sets are in
   different components is verified, once; for the shared n-grams too. So no link that joins classes is missed,
   and no pairs are made within a class that is already one. The sets of a wide n-gram are cut into parts, and each pair
   of parts is a group of its own.
5. Before any text is fetched, pairs meet their sets' bitmaps: ``BITS`` parities of the n-grams' hashes. The bits in which
   two differ bound their difference from below, which drops most pairs that can't be similar and loses no link.
6. Verification runs the suffix filter and then counts the common n-grams of the two whole texts. Words of linked texts are
   compared by bytes, so that a link doesn't hang on hashes; equal sets are told by 64-bit sums of n-gram hashes.

Null texts and texts without words have an empty set, which is linked with nothing. A text of fewer than n words has its
whole sequence as its one n-gram. Repeated rows, equal ids and null ids are nodes of their own with their own text; a
class is named by its least doc_id. Empty tables give empty results. Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm import arrays
from caseloom.llm.components import connected
from caseloom.llm.store import stored

N = 5
SMALL = 8  # sets that share a prefix n-gram, up to which all pairs are made at once
FIRST = 3  # of each set's pairs, those that are verified first
COUNTERS = 1 << 21  # of the frequency sketch
SLICES = 64
NO_ID = -(1 << 63)
BITS = 1024  # of a set's bitmap
SALTED = 1 << 17  # entries of an n-gram, from which they are dealt to several buckets
HOT = 1 << 30  # marks such an entry's position
PART = 4000  # sets of a wide n-gram that are compared in one group
# The threshold t = 3/4 as whole numbers.
UP, DOWN = 3, 4


def least_overlap(a, b):
    """ceil(t / (1 + t) * (a + b)): common n-grams that two sets of these sizes need."""
    return -(-UP * (a + b) // (UP + DOWN))


def ngram_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    data = arrays.LOWER[data]
    starts, ends, row = arrays.words(data, offsets, ~arrays.SPACE)
    return _sets_of(arrays.word_hashes(data, starts, ends), row, offsets, n)


def _sets_of(hashes: np.ndarray, row: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    first = np.searchsorted(row, np.arange(len(offsets)))
    found = arrays.grams(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        out.append(np.unique(found[a : b - n + 1]) if b - a >= n else arrays.grams(hashes[a:b], b - a) if b > a else found[:0])
    return out


@dataclass
class TextSet:
    """A text's set and its words, for verification."""

    grams: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def exact(self) -> set[tuple[bytes, ...]]:
        data = self.data.tobytes()
        words = [data[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]
        return {tuple(words[i : i + N]) for i in range(max(1, len(words) - N + 1))}


def read_set(text: bytes) -> TextSet:
    data, offsets = arrays.LOWER[np.frombuffer(text, np.uint8)], np.array([0, len(text)])
    starts, ends, row = arrays.words(data, offsets, ~arrays.SPACE)
    hashes = arrays.word_hashes(data, starts, ends)
    return TextSet(_sets_of(hashes, row, offsets)[0], hashes, data, starts, ends)


def bitmap(grams: np.ndarray) -> list[int]:
    """Parities of the n-grams by the top bits of their hashes, as longs."""
    odd = np.bincount((grams >> np.uint64(54)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def set_id(grams: np.ndarray) -> int | None:
    if not len(grams):
        return None
    places = np.arange(1, len(grams) + 1, dtype=np.uint64) * np.uint64(arrays.BASE)
    return int(arrays.mix(np.array([np.sum(arrays.mix(grams + places), dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, np.uint32)
    kinds = {"key": pa.int64(), "t": pa.int64(), "n": pa.int64(), "sid": pa.int64(), "bits": pa.list_(pa.int64()), "slice": pa.int32(), "task": pa.int32(), "counts": pa.binary()}
    for batch, data, offsets in arrays.blocks(batches):
        sets = ngram_sets(data, offsets)
        grams = np.concatenate(sets)
        np.add(counts, np.bincount((grams & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS), out=counts, casting="unsafe")
        m = len(sets)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("t"), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64()),
             pa.array([bitmap(s) if len(s) else None for s in sets], kinds["bits"]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=list(kinds),
        )
    packer = zstandard.ZstdCompressor(level=1)
    parts = [packer.compress(part.tobytes()) for part in np.split(counts, SLICES)]
    empty = [pa.nulls(SLICES, k) for k in list(kinds.values())[:5]]
    task = pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32())
    yield pa.RecordBatch.from_arrays([*empty, pa.array(range(SLICES), pa.int32()), task, pa.array(parts, pa.binary())], names=list(kinds))


def _sum_counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, place, task = np.zeros(COUNTERS // SLICES, np.uint64), 0, 0
    for frame in parts:
        place, task = frame["slice"].iloc[0], frame["task"].iloc[0]
        for part in frame["counts"]:
            found = zstandard.decompress(part)
            total += np.frombuffer(found, np.uint64 if len(found) == total.nbytes else np.uint32)
    yield pd.DataFrame({"slice": [place], "task": [task], "counts": [zstandard.compress(total.tobytes(), 1)]})


def _ranks(slices: DataFrame) -> np.ndarray:
    """Rank of each counter, from the tasks' counters (slice, task, counts), added in a tree: 64 to a group.

    Ranks are steps of a twentieth of the count: 16 bits hold any number, and order is all that matters."""
    most = slices.agg(F.max("task")).first()[0] or 0
    while True:
        slices = slices.withColumn("task", F.shiftright("task", 6)).groupBy("slice", "task").applyInPandas(_sum_counts, "slice int, task int, counts binary")
        most >>= 6
        if not most:
            break
    total = np.zeros(COUNTERS, np.uint64)
    for r in slices.collect():  # SLICES rows of fixed size
        total[r["slice"] * (COUNTERS // SLICES) :][: COUNTERS // SLICES] = np.frombuffer(zstandard.decompress(r["counts"]), np.uint64)
    return np.minimum(np.log1p(total.astype(np.float64)) * 20 * 8, 65535).astype(np.uint16)


def salts(ranks: np.ndarray, salted: int) -> np.ndarray:
    """To how many buckets the entries of n-grams of these ranks are dealt."""
    return np.maximum(np.expm1(ranks / 160.0) / salted, 1).astype(np.int64)


def _prefixes(order, buckets: int, salted_from: int, flush_bytes: int = 24 << 20):
    """Prefix n-grams by bucket, packed: per set (sid, n), per n-gram (hash, place of its set, position)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, packer = order.value, zstandard.ZstdCompressor(level=1)
        hashes, owners, places, salted, sids, sizes, seen, held = [], [], [], [], [], [], set(), 0

        def flush() -> pa.RecordBatch:
            h, own, pos = np.concatenate(hashes), np.concatenate(owners), np.concatenate(places)
            salt = np.concatenate(salted).astype(np.uint64)
            bucket = (np.where(salt > 0, arrays.mix(h + salt), h) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[by], return_index=True)
            sid, n = np.array(sids, np.int64), np.array(sizes, np.int32)
            rows = []
            for part in np.split(by, at[1:]):
                used, local = np.unique(own[part], return_inverse=True)
                heads = np.array([len(used), len(part)], np.int64)
                rows.append(packer.compress(b"".join(x.tobytes() for x in (heads, sid[used], h[part], n[used], local.astype(np.int32), pos[part]))))
            return pa.record_batch({"bucket": pa.array(found, pa.int64()), "packed": pa.array(rows, pa.binary())})

        for _, data, offsets in arrays.blocks(batches):
            for grams in ngram_sets(data, offsets):
                sid, n = set_id(grams), len(grams)
                if sid is None or sid in seen:
                    continue
                seen.add(sid)
                p = n - -(-UP * n // DOWN) + 1
                rank = ranks[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)]
                chosen = np.argsort(rank, kind="stable")[:p]
                many = salts(rank[chosen], salted_from)
                hashes.append(grams[chosen])
                owners.append(np.full(p, len(sids), np.int32))
                places.append(np.arange(p, dtype=np.int32) + np.where(many > 1, HOT, 0).astype(np.int32))
                salted.append(np.where(many > 1, 1 + sid % many, 0))
                sids.append(sid)
                sizes.append(n)
                held += 24 * p
            if held >= flush_bytes:
                yield flush()
                hashes, owners, places, salted, sids, sizes, seen, held = [], [], [], [], [], [], set(), 0
        if held:
            yield flush()

    return work


def _unpack(packed: bytes) -> tuple[np.ndarray, ...]:
    data = zstandard.decompress(packed)
    sets, m = np.frombuffer(data, np.int64, 2).tolist()
    at, out = 16, []
    for kind, count in ((np.int64, sets), (np.uint64, m), (np.int32, sets), (np.int32, m), (np.int32, m)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    sid, h, n, own, pos = out
    return h, sid[own], n[own], pos


def passing(n_a, pos_a, n_b, pos_b):
    """Length, prefix and positional filter on pairs that share the n-gram at these positions."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    indexed = small - -(-2 * UP * small // (UP + DOWN)) + 1
    of_small = np.where(n_a == n_b, np.minimum(pos_a, pos_b), np.where(n_a < n_b, pos_a, pos_b))
    left = 1 + np.minimum(n_a - pos_a, n_b - pos_b) - 1
    return (DOWN * small >= UP * large) & (of_small < indexed) & (left >= least_overlap(n_a, n_b))


def _good(sid, n, pos, i, j) -> np.ndarray:
    return (sid[i] != sid[j]) & passing(n[i].astype(np.int64), pos[i], n[j].astype(np.int64), pos[j])


def _join_bucket(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows: candidate pairs (a, b, votes, level), and the entries (h, a = sid, n, pos) of widely shared n-grams.

    The sets that share an n-gram stand by its position: the earlier, the fewer n-grams of their own they have, and the
    likelier others are to resemble them. Each set is paired with one drawn by hash from the first 1/8 before it (level
    1), one from the first 1/64 (level 2) and so on, so that none is drawn by all others while there are many."""
    h, sid, n, pos = (np.concatenate(x) for x in zip(*map(_unpack, frame["packed"]), strict=True))
    by = np.lexsort((sid, pos, h))
    h, sid, n, pos = h[by], sid[by], n[by], pos[by]
    hot, pos = pos >= HOT, pos & (HOT - 1)
    # A set has one position in all its copies, so copies stand side by side.
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    h, sid, n, pos, hot = h[new], sid[new], n[new], pos[new], hot[new]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(starts, len(h)))
    group_size, start = np.repeat(size, size), np.repeat(starts, size)
    index = np.arange(len(h))
    found = []

    def add(i, j, level):
        good = _good(sid, n, pos, i, j)
        found.append(pd.DataFrame({"a": sid[i[good]], "b": sid[j[good]], "level": level}))

    small = index[group_size <= SMALL]
    for step in range(1, SMALL):
        i = small[small - start[small] >= step]
        low = sid[i] < sid[i - step]
        add(np.where(low, i, i - step), np.where(low, i - step, i), 0)
    large = index[group_size > SMALL]
    by = large[np.lexsort((sid[large], n[large], h[large]))]
    same = h[by[1:]] == h[by[:-1]]
    add(by[1:][same], by[:-1][same], 0)
    level, bound = 1, (large - start[large]) // SMALL
    while len(large) and bound.max() > 0:
        i, b = large[bound > 0], bound[bound > 0]
        drawn = arrays.mix(sid[i].view(np.uint64) + np.uint64(level)) % b.astype(np.uint64)
        add(i, start[i] + drawn.astype(np.int64), level)
        level, bound = level + 1, bound // SMALL
    pairs = pd.concat(found).groupby(["a", "b"], as_index=False).agg(votes=("level", "size"), level=("level", "max"))
    # Others of a salted n-gram are in other buckets.
    large = index[(group_size > SMALL) | hot]
    entries = pd.DataFrame({"h": h[large].view(np.int64), "a": sid[large], "n": n[large], "pos": pos[large]})
    columns = ["a", "b", "votes", "level", "h", "n", "pos"]
    return pd.concat([pairs.astype("Int64"), entries.astype("Int64")]).reindex(columns=columns).astype("Int64")


def _cross(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All passing pairs of different components among the sets that share an n-gram, in pieces. ``i`` and ``j`` name the
    parts that meet: of two parts, one from each."""
    frame = pd.concat(list(frames)).sort_values(["h", "i", "j", "n"], kind="stable")
    values = {c: frame[c].to_numpy(np.int64) for c in ("h", "i", "j", "part", "sid", "n", "pos", "comp")}
    bits = np.stack([np.asarray(x, np.int64).view(np.uint64) for x in frame["bits"]])
    n, comp, sid, part = values["n"], values["comp"], values["sid"], values["part"]
    new = np.ones(len(n), bool)
    new[1:] = (values["h"][1:] != values["h"][:-1]) | (values["i"][1:] != values["i"][:-1]) | (values["j"][1:] != values["j"][:-1])
    stops = np.append(np.flatnonzero(new), len(n))[np.cumsum(new)]
    across = values["i"] != values["j"]
    a, b, held = [], [], 0

    def unique() -> pd.DataFrame:
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    for i in range(len(n)):
        j = np.arange(i + 1, np.searchsorted(n[i : stops[i]], n[i] * DOWN // UP, "right") + i)
        j = j[comp[j] != comp[i]]
        if across[i]:
            j = j[part[j] != part[i]]
        if len(j):
            j = j[_good(sid, n, values["pos"], np.full(len(j), i), j)]
            differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[differ <= n[j] + n[i] - 2 * least_overlap(n[j], n[i])]
            a.append(np.minimum(sid[i], sid[j]))
            b.append(np.maximum(sid[i], sid[j]))
            held += len(j)
            if held > 200_000:
                yield unique()
                a, b, held = [], [], 0
    if held:
        yield unique()


def alike(x: Column, y: Column, n_x: Column, n_y: Column) -> Column:
    """Whether the bitmaps of two sets allow that they are similar."""
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, c: total + c)
    need = F.ceil(UP * (n_x + n_y) / (UP + DOWN))
    return differ <= n_x + n_y - 2 * need


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for batch, data, offsets in arrays.blocks(batches):
        text = data.tobytes()
        packed = [packer.compress(text[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch({"key": batch.column("key"), "t": batch.column("t"), "packed": pa.array(packed, pa.binary())})


def overlapping(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard of two sorted sets >= t. The suffix filter first splits both at a common pivot: halves of different
    sizes can't agree in more than their smaller size."""
    need = least_overlap(len(x), len(y))
    if min(len(x), len(y)) < need:
        return False
    at = len(x) // 2
    other = int(np.searchsorted(y, x[at]))
    if min(at, other) + min(len(x) - at, len(y) - other) < need:
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1])) >= need


def same_words(x: TextSet, y: TextSet) -> bool:
    """Whether equal hashes mean equal words in these two texts."""
    hashes, data = np.concatenate([x.hashes, y.hashes]), np.concatenate([x.data, y.data])
    starts, ends = (np.concatenate([own, other + len(x.data)]) for own, other in ((x.starts, y.starts), (x.ends, y.ends)))
    by = np.argsort(hashes, kind="stable")
    same = hashes[by[1:]] == hashes[by[:-1]]
    a, b = by[1:][same], by[:-1][same]
    if (ends[a] - starts[a] != ends[b] - starts[b]).any():
        return False
    return np.array_equal(arrays.gathered(data, starts[a], ends[a]), arrays.gathered(data, starts[b], ends[b]))


def similar(x: TextSet, y: TextSet) -> bool:
    if not overlapping(x.grams, y.grams):
        return False
    if same_words(x, y):
        return True
    p, q = x.exact(), y.exact()
    return DOWN * len(p & q) >= UP * len(p | q)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, TextSet] = {}
    for batch in batches:
        keep = []
        for i, (a, b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True)):
            both = []
            for sid, packed in ((a, x), (b, y)):
                found = known.get(sid)
                if found is None:
                    found = read_set(zstandard.decompress(packed))
                    if len(known) >= 200:
                        known.clear()
                    known[sid] = found
                both.append(found)
            if similar(*both):
                keep.append(i)
        yield pa.record_batch({c: batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")})


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    first = pairs.join(texts.select(F.col("sid").alias("a"), F.col("packed").alias("x")), "a")
    both = first.join(texts.select(F.col("sid").alias("b"), F.col("packed").alias("y")), "b").select("a", "b", "x", "y")
    return stored(both.mapInArrow(_verify, "a long, b long"))


def keyed(docs: DataFrame) -> DataFrame:
    """With ``key`` (doc_id, a null id as the least number) and ``t`` (hash of the text), which name a row's node."""
    return docs.withColumns({"key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "t": F.xxhash64("text")})


def classes(docs: DataFrame, bucket_bytes: int = 24 << 20, salted: int = SALTED, part: int = PART) -> DataFrame:
    """key, t and n (size of the set) of every row, and ``least``, the least (key, t) of its class; null for empty sets."""
    spark = docs.sparkSession
    docs = keyed(docs).select("key", "t", "text")
    first = stored(docs.mapInArrow(_sets, "key long, t long, n long, sid long, bits array<long>, slice int, task int, counts binary"))
    sets = first.where("slice is null").select("key", "t", "n", "sid")
    order = spark.sparkContext.broadcast(_ranks(first.where("slice is not null").select("slice", "task", "counts")))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * 6 // bucket_bytes)
    packed = docs.select("text").mapInArrow(_prefixes(order, buckets, salted), "bucket long, packed binary")
    joined = stored(packed.groupBy("bucket").applyInPandas(_join_bucket, "a long, b long, votes long, level long, h long, n long, pos long"))
    offers = joined.where("b is not null").groupBy("a", "b").agg(F.sum("votes").alias("votes"), F.max("level").alias("level"))
    # One row per distinct set: its first row by (key, t), size and bitmap.
    held = first.where("sid is not null").groupBy("sid").agg(F.min(F.struct("key", "t")).alias("r"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))
    held = stored(held.select("sid", "r.key", "r.t", "n", "bits"))
    offers = offers.join(held.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
    offers = offers.join(held.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
    offers = stored(offers.where(alike(F.col("x"), F.col("y"), F.col("na"), F.col("nb"))).select("a", "b", "votes", "level"))
    # Each set's best offers; those of level 0 count for both.
    both = offers.union(offers.where("level = 0").select("b", "a", "votes", "level"))
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("level"), F.desc("votes"), "b"))
    best = both.withColumn("place", place).where(F.col("place") <= FIRST).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    best = stored(best.distinct())
    pairs = offers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    wide = joined.where("h is not null").select("h", F.col("a").alias("sid"), "n", "pos")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).union(wide.select("sid")).distinct()
    rows = held.join(wanted, "sid").select("sid", "key", "t")
    texts = docs.mapInArrow(_texts, "key long, t long, packed binary").join(rows, ["key", "t"]).groupBy("sid").agg(F.first("packed").alias("packed"))
    texts = stored(texts)
    links = _verified(best, texts)
    roots = connected(links)

    def with_root(frame: DataFrame, column: str, name: str) -> DataFrame:
        return frame.join(roots.select(F.col("id").alias(column), F.col("root").alias(name)), column, "left").withColumn(name, F.coalesce(name, column))

    rest = with_root(with_root(pairs.select("a", "b"), "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
    spread = with_root(wide, "sid", "comp")
    # Stored, so that Spark knows its size before it plans the join with all entries.
    mixed = spread.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m"))
    mixed = stored(mixed.where("low <> high").select("h", F.ceil(F.col("m") / part).cast("int").alias("parts")))
    own = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
    crossing = spread.join(mixed, "h").withColumn("part", own).join(held.select("sid", "bits"), "sid")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    crossing = crossing.select("h", "sid", "n", "pos", "comp", "bits", "part", other.alias("other")).withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")})
    crossing = crossing.drop("other").withColumn("bucket", F.pmod(F.xxhash64("h", "i", "j"), F.lit(buckets)))
    more = crossing.groupBy("bucket").applyInPandas(_cross, "a long, b long")
    rest = stored(rest.union(more).distinct().join(best, ["a", "b"], "left_anti"))
    found = _verified(rest, texts)
    roots = connected(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).union(found))
    named = sets.join(roots.select(F.col("id").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    # Stored, so that both sides of the join are shuffled for it alone, and Spark can split a large class.
    least = stored(named.where("root is not null").groupBy("root").agg(F.min(F.struct("key", "t")).alias("least")))
    return named.join(least, "root", "left").select("key", "t", "n", "least")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    least = F.coalesce("least.key", "key")
    return classes(docs, **options).select(
        F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(least != NO_ID, least).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class its least id stays, and all rows without words."""
    found = classes(docs)
    stay = found.where(F.col("least").isNull() | (F.col("least") == F.struct("key", "t"))).select("key", "t", (F.col("n") == 0).alias("empty")).distinct()
    # A row that is repeated as it is, id and all, is in a class with itself; the least by its other columns stays.
    others = [F.col(f"row.`{c}`") for c in docs.columns if c != "text" and "map<" not in docs.schema[c].dataType.simpleString()]
    again = F.row_number().over(Window.partitionBy("key", "t").orderBy(*others))
    rows = keyed(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text")).drop("doc_id", "text")
    return rows.join(stay, ["key", "t"]).withColumn("again", again).where("again = 1 or empty").select("row.*")
