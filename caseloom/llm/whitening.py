"""Whitening of embeddings, with exact integer cross-products from bit-sliced planes.

1. Entries become whole numbers ``floor(256 * entry)``. One pass finds each dimension's range; every vector is then packed
   as its entries above their dimension's least, in as few bytes as the widest range needs.
2. The fit list is each distinct packed vector once (``distinct``: partial, so a very frequent vector moves once per task).
3. Scatter: in blocks of rows, bit b of dimension i over all rows is one row of words (a plane). The popcount of the AND of
   two planes, weighted by 2**(a + b), adds up to the exact cross-product of two dimensions. Each task gives one number per
   pair of dimensions, in limbs that Spark adds as longs, so no sum overflows, whatever the number of rows.
4. The driver holds numbers per pair of dimensions only. They are centred as integers, ``n * XX - S * S``, before the one
   division and ``eigh``.

Rows whose vector is null, or holds a null or an entry that isn't finite, are dropped. A shorter vector counts as filled up
with zeros to the longest one's length. Repeated rows and ids give repeated results, and one entry of the fit list. Entries
beyond the longs saturate. Components of no variance (relative to the total, below the precision of doubles) are left
out: fewer than ``k`` then, none for an empty table or a single distinct vector. ``deviation`` is null where it doesn't
fit a long. Other columns travel along in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from caseloom.llm import arrays
from caseloom.llm.store import stored

SCALE = 256
BLOCK = 1 << 14  # rows whose planes are compared at once
LIMB = 40  # bits of a number's parts: 2**23 tasks can be added in a long
LIMBS = 5  # products of two entries have at most 128 bits, and a task fewer than 2**70 rows
LONGEST = (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * value) as a long; beyond the longs it saturates."""
    scaled = np.floor(values.astype(np.float64) * SCALE) + 0.0
    low, high = scaled <= -float(1 << 63), scaled >= float(1 << 63)
    out = np.where(low | high, 0.0, scaled).astype(np.int64)
    out[low], out[high] = -LONGEST - 1, LONGEST
    return out


def entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all entries as longs, length of each vector) of a batch whose vectors hold finite entries only."""
    vectors = batch.column("x")
    return whole(vectors.flatten().to_numpy(zero_copy_only=False)), np.diff(vectors.offsets.to_numpy())


def dense(flat: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` entries, shorter ones filled up with zeros."""
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def usable(table: DataFrame, vector: str) -> DataFrame:
    """``row`` (all columns) and ``x`` (the vector as doubles), without the vectors that can't be used."""
    x = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    row = F.struct(*(F.col(f"`{c}`") for c in table.columns)).alias("row")
    return table.select(row, x.alias("x")).where("x is not null").where(~bad)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high, shortest = np.zeros(0, np.int64), np.zeros(0, np.int64), LONGEST
    for batch in batches:
        flat, lengths = entries(batch)
        if len(lengths):
            x = dense(flat, lengths, max(int(lengths.max()), len(low)))
            more = x.shape[1] - len(low)
            low = np.minimum(np.append(low, np.full(more, LONGEST)), x.min(axis=0))
            high = np.maximum(np.append(high, np.full(more, -LONGEST - 1)), x.max(axis=0))
            shortest = min(shortest, int(lengths.min()))
    if shortest < LONGEST:
        # Place -1: length of the shortest and of the longest vector.
        rows = {"place": range(-1, len(low)), "low": [shortest, *low.tolist()], "high": [len(low), *high.tolist()]}
        yield pa.record_batch({"place": pa.array(rows["place"], pa.int32()), "low": pa.array(rows["low"], pa.int64()), "high": pa.array(rows["high"], pa.int64())})


def ranges(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Least and greatest entry of each dimension; None without rows."""
    found = vectors.select("x").mapInArrow(_ranges, "place int, low long, high long")
    edges = {r["place"]: (r["low"], r["high"]) for r in found.groupBy("place").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    if not edges:
        return None
    shortest, width = edges.pop(-1)
    low, high = (np.array([edges[i][e] for i in range(width)], np.int64) for e in (0, 1))
    # Places beyond the shortest vector hold a zero in some row.
    low[shortest:], high[shortest:] = np.minimum(low[shortest:], 0), np.maximum(high[shortest:], 0)
    return low, high


def _packed(low: np.ndarray, kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense(*entries(batch), len(low))
            shifted = (x.view(np.uint64) - low.view(np.uint64)).astype(kind)  # modulo 2**64: exact for any two longs
            size = shifted.shape[1] * shifted.itemsize
            data = shifted.tobytes()
            yield pa.record_batch({"packed": pa.array([data[i * size : (i + 1) * size] for i in range(len(x))], pa.binary())})

    return work


def _unpack(column: pa.Array, kind: str, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(column), 0), kind)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Words of the bit planes of non-negative entries: [dimension, bit, word], 64 rows to a word."""
    rows, width = x.shape
    padded = -(-rows // 64) * 64
    out = np.zeros((width, bits, padded // 8), np.uint8)
    columns = np.ascontiguousarray(x.T)
    for b in range(bits):
        plane = ((columns >> columns.dtype.type(b)) & columns.dtype.type(1)).astype(np.uint8)
        out[:, b, : -(-rows // 8)] = np.packbits(plane, axis=1)
    return out.view(np.uint64)


def cross_products(words: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of x_i * x_j for i <= j, from the planes: popcounts of their ANDs, weighted."""
    width, bits, size = words.shape
    wide = 2 * bits + (64 * size).bit_length() > 62  # beyond a long: Python integers
    weights = np.array([1 << b for b in range(bits)], object if wide else np.int64)
    out = np.zeros((width, width), weights.dtype)
    for i in range(width):
        for a in range(bits):
            counts = np.bitwise_count(words[i, a] & words[i:]).sum(axis=2, dtype=np.int64)
            out[i, i:] += (counts.astype(weights.dtype) @ weights) * weights[a]
    return out


def _scatter(width: int, bits: int, kind: str):
    """One row per pair of dimensions (i <= j) with its cross-product in limbs; j = -1: sums; i = -1: number of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, totals, n = np.zeros((width, width), object), [0] * width, 0
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                x = _unpack(batch.column("packed").slice(start, BLOCK), kind, width)
                words = planes(x, bits)
                products += cross_products(words)
                counts = np.bitwise_count(words).sum(axis=2, dtype=np.int64).tolist()
                totals = [t + sum(c << b for b, c in enumerate(row)) for t, row in zip(totals, counts, strict=True)]
                n += len(x)
        if not n:
            return
        rows = [(-1, -1, n), *((i, -1, t) for i, t in enumerate(totals)), *((i, j, int(products[i, j])) for i in range(width) for j in range(i, width))]
        limbs = {f"l{k}": pa.array([(value >> (LIMB * k)) & ((1 << LIMB) - 1) for _, _, value in rows], pa.int64()) for k in range(LIMBS)}
        yield pa.record_batch({"i": pa.array([r[0] for r in rows], pa.int32()), "j": pa.array([r[1] for r in rows], pa.int32())} | limbs)

    return work


@dataclass
class Whitener:
    """What a fit gives: n rows, each dimension's exact sum, and the components (rows of ``axes``) by falling variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def width(self) -> int:
        return len(self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values of whole-number vectors. Each entry's distance from the mean is rounded once: the whole part
        of the mean goes first, as integers."""
        mean = [s // self.n for s in self.sums]
        rest = np.array([float(Fraction(s % self.n, self.n)) for s in self.sums])
        safe = all(abs(m) < 1 << 62 for m in mean) and (not x.size or (int(x.max()) < 1 << 62 and int(x.min()) > -(1 << 62)))
        centred = (x - np.array(mean, np.int64)).astype(np.float64) if safe else (x.astype(object) - np.array(mean, object)).astype(np.float64)
        return (centred - rest) @ (self.axes / np.sqrt(self.variances)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact."""
        if not len(x):
            return []
        most = max([0, *(max(abs(self.n * int(a) - s), abs(self.n * int(b) - s)) for a, b, s in zip(x.min(axis=0), x.max(axis=0), self.sums, strict=True))])
        if most * most * max(self.width, 1) <= LONGEST and self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) <= LONGEST:
            moved = x * np.int64(self.n) - np.array(self.sums, np.int64)
            return (moved * moved).sum(axis=1).tolist()
        moved = x.astype(object) * self.n - np.array(self.sums, object)
        return [d if d <= LONGEST else None for d in (moved * moved).sum(axis=1).tolist()]


def components(n: int, sums: list[int], products: dict[tuple[int, int], int], k: int) -> Whitener:
    """Eigenvectors of the covariance, centred as integers: (n * XX - S * S) / n**2."""
    width = len(sums)
    covariance = np.zeros((width, width))
    for (i, j), total in products.items():
        covariance[i, j] = covariance[j, i] = (n * total - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance) if width else (np.zeros(0), np.zeros((0, 0)))
    trace = float(np.trace(covariance))
    order = np.argsort(values)[::-1][:k]
    order = order[values[order] > trace * np.finfo(float).eps * max(width, 1)]
    return Whitener(n, sums, vectors[:, order].T.copy(), values[order], trace)


def _moments(model: Whitener, low: np.ndarray, kind: str):
    """Sums of products of the whitened values over the fit list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.variances)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = (_unpack(batch.column("packed"), kind, model.width).astype(np.uint64) + low.view(np.uint64)).view(np.int64)
            white = model.project(x)
            first += white.sum(axis=0)
            second += white.T @ white
        # Components and their products by place: -1 stands for the sums.
        rows = [(i, -1, first[i]) for i in range(k)] + [(i, j, second[i, j]) for i in range(k) for j in range(k)]
        yield pa.record_batch({"i": pa.array([r[0] for r in rows], pa.int32()), "j": pa.array([r[1] for r in rows], pa.int32()), "v": pa.array([float(r[2]) for r in rows], pa.float64())})

    return work


def fit(vectors: DataFrame, k: int) -> Whitener | None:
    """The whitening of the distinct vectors of ``usable``; None without rows."""
    edges = ranges(vectors)
    if edges is None:
        return None
    low, high = edges
    bits = max([1, *((int(b) - int(a)).bit_length() for a, b in zip(low, high, strict=True))])
    kind = next(f"<u{size}" for size in (1, 2, 4, 8) if bits <= 8 * size)
    distinct = stored(vectors.select("x").mapInArrow(_packed(low, kind), "packed binary").distinct())
    width = len(low)
    limbs = [f"l{i}" for i in range(LIMBS)]
    found = distinct.mapInArrow(_scatter(width, bits, kind), "i int, j int, " + ", ".join(f"{c} long" for c in limbs))
    # A number for each pair of dimensions, whatever the number of rows.
    totals = {(r["i"], r["j"]): sum(r[c] << (LIMB * p) for p, c in enumerate(limbs)) for r in found.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in limbs)).collect()}
    n, shift = totals[-1, -1], [int(v) for v in low]
    raw = [totals[i, -1] for i in range(width)]
    sums = [t + n * s for t, s in zip(raw, shift, strict=True)]
    products = {(i, j): totals[i, j] + shift[j] * raw[i] + shift[i] * raw[j] + n * shift[i] * shift[j] for i in range(width) for j in range(i, width)}
    model = components(n, sums, products, k)
    if len(model.variances):
        moments = {(r["i"], r["j"]): r["v"] for r in distinct.mapInArrow(_moments(model, low, kind), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        held = range(len(model.variances))
        model.identity_error = max(abs(moments[i, j] / n - moments[i, -1] * moments[j, -1] / n / n - (i == j)) for i in held for j in held)
    return model


def _apply(shared):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()
        model = shared.value
        for batch in batches:
            x = dense(*entries(batch), model.width)
            white = model.project(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), flat, pa.array(model.deviations(x), pa.int64())], names=["row", "whitened", "deviation"])

    return work


def whiten(table: DataFrame, k: int = 4, vector: str = "embedding") -> tuple[DataFrame, Whitener | None]:
    """``row`` (all columns), ``whitened`` (a value per component) and ``deviation`` of every usable row, and the fit."""
    vectors = usable(table, vector)
    model = fit(vectors, k)
    if model is None:
        return vectors.select("row", F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation")), None
    schema = StructType([vectors.schema["row"], StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])
    return vectors.mapInArrow(_apply(table.sparkSession.sparkContext.broadcast(model)), schema), model


def whitened_components(table: DataFrame, k: int = 4, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows, model = whiten(table.select(id, vector), k, vector)
    each = rows.select(F.col(f"row.`{id}`").alias(id), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*(F.lit(float(v / model.trace)) for v in (model.variances if model else []))).cast("array<double>")
    return each.select(
        id, (F.col("place") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(float(model.identity_error) if model else 0.0).alias("identity_error"),
    )
