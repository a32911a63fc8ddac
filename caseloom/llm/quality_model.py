"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good; the unlabelled sample is web text of any kind. A small network minimises the
non-negative unbiased risk (Kiryo et al., 2017): prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the
logistic loss. The class prior is estimated by the best bin (Garg et al., 2021): the least ratio of the shares of
unlabelled and positive texts above a score, each corrected by its sampling error. No negative label is used.

Measures are rates over the whole text (characters, words, lines); nothing but the text is an input. The fit takes at
most ``SAMPLE`` positives and as many unlabelled rows (those with the least hashes of their id), a documented bound;
every row is scored. Null and empty texts get the score of all-zero measures. Repeated rows get equal scores. Without
positives the score is 0.5. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrays
from caseloom.llm.folds import sample_ids, sampled

SAMPLE = 15_000
HIDDEN = 16
SYMBOLS = [arrays.byte_set(x) for x in (b"#*$%&<>", b"|", b"!", b".,;:?", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"@/\\_=+~^[]{}")]


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of rates per text."""
    starts, ends, row = arrays.words(data, offsets, ~arrays.SPACE)
    m, n = len(offsets) - 1, np.maximum(np.diff(np.searchsorted(row, np.arange(len(offsets)))), 1)
    size = np.maximum(np.diff(offsets), 1)
    columns = []

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=flag, minlength=m) / n

    for inside in SYMBOLS:
        total = np.concatenate([[0], np.cumsum(inside[data], dtype=np.int64)])
        columns.append((total[offsets[1:]] - total[offsets[:-1]]) / size)
        here = total[ends] - total[starts]
        columns.append(per_word(here > 0))
        columns.append(per_word(here * 2 > ends - starts))
    hashes = arrays.range_hashes(arrays.prefix_sums(arrays.LOWER[data]), starts, ends)
    for step in (1, 2):
        again = np.zeros(len(hashes), bool)
        again[step:] = (hashes[step:] == hashes[:-step]) & (row[step:] == row[:-step])
        columns.append(per_word(again))
    lines, line_ends, line_row = arrays.words(data, offsets, ~arrays.byte_set(b"\n"))
    sums = arrays.prefix_sums(data)
    keys = arrays.mix(arrays.range_hashes(sums, lines, line_ends) + line_row.astype(np.uint64) * np.uint64(arrays.BASE))
    _, first = np.unique(keys, return_index=True)
    per_line = np.maximum(np.bincount(line_row, minlength=m), 1)
    columns.append(1 - np.bincount(line_row[first], minlength=m) / per_line)
    keys = arrays.mix(hashes + row.astype(np.uint64) * np.uint64(arrays.BASE))
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(row[first], minlength=m)
    columns.append(np.log1p(n) - np.log1p(distinct))
    columns.append(np.bincount(row, weights=(ends - starts), minlength=m) / n / 10)
    columns.append(per_word(ends - starts > 25))
    columns.append(per_word(ends - starts < 3))
    columns.append(np.log1p(n) / 10)
    x = np.stack(columns, axis=1)
    # Small rates count too: a part of a text may be junk.
    return np.concatenate([x, np.log1p(np.maximum(x, 0) * 100)], axis=1).astype(np.float32)


class Model:
    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.weights = mean, scale, weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -5, 5) @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _train(positive: np.ndarray, unlabelled: np.ndarray, slopes, steps: int, seed: int = 5, batch: int = 512) -> Model:
    """Adam on the network; ``slopes(z_p, z_u)`` gives the risk's derivatives by the outputs."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -5, 5) for x in (positive, unlabelled))
    weights = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        x = np.concatenate([p[rng.integers(len(p), size=batch)], u[rng.integers(len(u), size=batch)]])
        hidden = np.tanh(x @ weights[0] + weights[1])
        z = hidden @ weights[2] + weights[3]
        dz = np.concatenate(slopes(z[:batch], z[batch:]))
        back = np.outer(dz, weights[2]) * (1 - hidden**2)
        grads = [x.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ dz + 1e-4 * weights[2], dz.sum(keepdims=True)]
        rate = 0.01 * (1 - 0.9 * step / steps)
        for w, g, a, b in zip(weights, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, weights)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.05) -> float:
    """Share of positives among the unlabelled, from scores of rows that the scorer was not fitted on."""
    cuts = np.quantile(positive, np.linspace(0, 0.98, 99))
    p = (positive[:, None] >= cuts).mean(0)
    u = (unlabelled[:, None] >= cuts).mean(0)
    error = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + error) / p)
    return float(np.clip(u[best] / p[best], 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500) -> Model | None:
    if not len(positive) or not len(unlabelled):
        return None

    def separate(z_p, z_u):  # positives from unlabelled, to estimate the prior
        return -_sigmoid(-z_p) / len(z_p), _sigmoid(z_u) / len(z_u)

    rng = np.random.default_rng(1)
    positive, unlabelled = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    prior = 0.5
    if half_p and half_u:
        scorer = _train(positive[:half_p], unlabelled[:half_u], separate, steps // 2)
        prior = class_prior(scorer.logits(positive[half_p:]), scorer.logits(unlabelled[half_u:]))

    def non_negative(z_p, z_u):
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        up = -prior * _sigmoid(-z_p) / len(z_p)
        by_p, by_u = -prior * _sigmoid(z_p) / len(z_p), _sigmoid(z_u) / len(z_u)
        # Below zero the negative part is over-fitted: go back on it.
        return (up + by_p, by_u) if negative >= 0 else (-by_p, -by_u)

    model = _train(positive, unlabelled, non_negative, steps)
    model.prior = prior
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in arrays.blocks(batches):
        x = measures(data, offsets)
        yield pa.record_batch({"kind": batch.column("kind"), "x": pa.array([r.tobytes() for r in x], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """From the training fold alone."""
    good = sample_ids(labels.where("quality = 1"), sample).withColumn("kind", F.lit(1))
    any_kind = sample_ids(docs, sample).withColumn("kind", F.lit(0))
    rows = sampled(docs, good.union(any_kind)).mapInArrow(_measure, "kind int, x binary").collect()
    rows.sort(key=lambda r: bytes(r["x"]))  # the same whatever the order of the rows
    x = [np.stack([np.frombuffer(r["x"], np.float32) for r in rows if r["kind"] == k] or [np.zeros(0, np.float32)]) for k in (1, 0)]
    return fit(*(a.reshape(len(a), -1)[: a.size and len(a)] for a in x))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.blocks(batches):
            found = np.full(len(batch), 0.5) if model is None else model.score(measures(data, offsets))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, score double")
