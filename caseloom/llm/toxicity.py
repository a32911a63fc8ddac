"""Toxicity by weak supervision.

Many voters look at a text: lexicons of insults (a fixed English one, and words and word beginnings that labelled texts
of the training fold suggest, dealt into several voters), patterns (insult next to a second person, insults repeated,
no known word at all). A generative label model estimates by EM, without looking at the labels, how often each voter votes
for either class and how voters go together within a class: each hangs on one other voter besides the class, along the
tree that holds the strongest dependences (conditional mutual information). So a voter that repeats another one adds only
what it says beyond it. The model's posteriors are the targets of a linear classifier over the voters' vocabulary, with
weights of both signs, which scores every text.

The suggestions and the fit take at most ``SAMPLE`` labelled texts per class (those with the least hashes of their id),
a documented bound; of near copies of one label the one with the least id stays. Word counts of the sample are Spark sums, and at most ``VOCABULARY`` entries reach the driver.
Every whole text is scored, however long. Null and empty texts have no words; their score is the classifier's base rate. Repeated
rows get equal scores. Without labels the fixed lexicon alone votes. Empty tables give empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrays
from caseloom.llm.folds import sample_ids, sampled
from caseloom.llm.ngram_join import ngram_sets
from caseloom.llm.store import stored

SAMPLE = 12_000
VOCABULARY = 6_000
# English insults.
INSULTS = (
    "idiot moron stupid dumb loser clown fool jerk imbecile pathetic worthless useless disgusting trash garbage scum filth vermin "
    "ugly creep coward liar freak parasite maggot pig hate"
).split()
WORD = re.compile(r"[^\W\d_]+")
YOU = re.compile(r"\b(?:you|your|u|ur)\b(?:\W+\w+){0,3}\W*$")
STEMS = (4, 5, 6)
TIMES = (1, 2, 3, 5)
DEALT = 6  # voters per kind of entry


def _stems(words) -> list[str]:
    return [w[:n] + "*" for w in words for n in STEMS if len(w) > n]


def _often(count: Counter) -> set[str]:
    """Each beginning, and once more for each number of times it is reached: beginnings occur by chance, too."""
    return {s if k == 1 else f"{s}{k}" for s, n in count.items() for k in TIMES if n >= k}


def entries(text: str) -> set[str]:
    """Words of a text, and beginnings of its words, marked by a star and the number of words that have them."""
    words = WORD.findall(text.lower())
    return set(words) | _often(Counter(_stems(words)))


class Classifier:
    """Linear over the entries of a bounded vocabulary."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias = bias
        self.weights = weights
        self.words = {w for w in weights if "*" not in w}
        self.stems = {n: {w[: n + 1] for w in weights if w[n : n + 1] == "*"} for n in STEMS}

    def score(self, text: str) -> float:
        all_words = WORD.findall(text.lower())
        words = set(all_words)
        found = words & self.words
        stems = {s for n, own in self.stems.items() if own for s in own & {w[:n] + "*" for w in words if len(w) > n}}
        if stems:
            found |= _often(Counter(s for s in _stems(all_words) if s in stems)) & self.weights.keys()
        z = self.bias + sum(self.weights[w] for w in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """With the least hash of a text's word 5-grams, which most near copies have in common."""
    for batch, data, offsets in arrays.blocks(batches):
        sets = ngram_sets(data, offsets)
        # Texts without words are no copies of each other.
        least = [int(s.min().view(np.int64)) if len(s) else i for s, i in zip(sets, batch.column("doc_id").to_pylist(), strict=True)]
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": batch.column("text"), "kind": batch.column("kind"), "sign": pa.array(least, pa.int64())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in arrays.blocks(batches):
        toxic, clean = Counter(), Counter()
        text = data.tobytes()
        for kind, a, b in zip(batch.column("kind").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            (toxic if kind else clean).update(entries(text[a:b].decode()))
        names = [*toxic.keys() | clean.keys()]
        yield pa.record_batch({
            "entry": pa.array(names, pa.string()), "toxic": pa.array([toxic[n] for n in names], pa.int64()), "clean": pa.array([clean[n] for n in names], pa.int64()),
        })


def suggestions(rows: DataFrame, most: int = VOCABULARY, evidence: float = 30.0, coverage: float = 0.01) -> list[str]:
    """Entries that toxic texts have too often for chance (likelihood ratio statistic of at least ``evidence``, as
    hundreds of thousands of entries are tried), at least three times as often as clean ones, and in a share
    ``coverage`` of them: words of a text that was copied often are no sign."""
    sizes = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return []
    counted = rows.mapInArrow(_count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = F.lit(sizes[1] / (sizes[0] + sizes[1]))
    expected = (F.col("toxic") + F.col("clean")) * share
    ratio = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / expected)
        + F.col("clean") * F.log(F.greatest(F.col("clean"), F.lit(0.5)) / (F.col("toxic") + F.col("clean") - expected))
    )
    odds = F.col("toxic") / (F.col("clean") + F.lit(0.5))
    picked = counted.where((odds >= 3) & (ratio >= evidence) & (F.col("toxic") >= coverage * sizes[1])).orderBy(F.desc("toxic"), "entry").limit(most)
    return [r["entry"] for r in picked.select("entry").collect()]


class Voters:
    """Votes of a text: 1 toxic, -1 clean, 0 none."""

    def __init__(self, suggested: list[str]):
        self.lexicons = [set(INSULTS[i::3]) for i in range(3)]
        for stem in (False, True):
            own = [w for w in suggested if ("*" in w) is stem]
            self.lexicons += [{w for w in own if zlib.crc32(w.encode()) % DEALT == i} for i in range(DEALT)]
        self.lexicons = [x for x in self.lexicons if x]
        self.all = set(INSULTS) | set(suggested)
        self.names = len(self.lexicons) + 4

    def votes(self, text: str) -> tuple[list[int], list[str]]:
        found = entries(text) & self.all
        out = [int(not lexicon.isdisjoint(found)) for lexicon in self.lexicons]
        low = text.lower()
        whole = [w for w in found if "*" not in w]
        repeated = any(low.count(w) > 1 for w in whole)
        known = set(whole)
        near = bool(known) and any(m[0] in known and YOU.search(low[max(0, m.start() - 60) : m.start()]) for m in WORD.finditer(low))
        out += [int(len(whole) > 1), int(repeated), int(near), -1 if not found else 0]
        return out, sorted(found)


def strongest_tree(joint: np.ndarray) -> np.ndarray:
    """Each voter's parent (-1: none) in the tree of the greatest conditional mutual information given the class.
    joint: [class, voter, vote, voter, vote], probabilities within a class times its share."""
    share = joint.sum((2, 4), keepdims=True)
    one, other = joint.sum(4, keepdims=True), joint.sum(2, keepdims=True)
    strength = (joint * np.log(np.maximum(joint * share, 1e-300) / np.maximum(one * other, 1e-300))).sum((0, 2, 4))
    n = len(strength)
    parent, best, linked = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        linked[at] = True
        closer = ~linked & (strength[at] > best)
        parent[closer], best[closer] = at, strength[at][closer]
        at = int(np.argmax(np.where(linked, -np.inf, best)))
    return parent


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior of toxic per text from votes (texts x voters), by EM over the votes' probabilities given the class and
    the parent's vote."""
    votes = votes.astype(np.float64)
    seen = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(np.float64)
    texts, n = votes.shape
    flat = seen.reshape(texts, n * 3)
    spoke = (votes != 0).astype(np.float64)
    # Start: the share of votes, in which voters that repeat each other count as one.
    with np.errstate(all="ignore"):  # a voter that always says the same is related to none
        related = np.nan_to_num(np.corrcoef(votes.T)) if n > 1 and texts > 1 else np.ones((n, n))
    weight = 1 / (related**2).sum(1).clip(1)
    p = np.clip((votes * weight).sum(1) / weight.sum() + 0.3, 0.05, 0.95)
    parent = None
    for r in range(rounds):
        joint = np.stack([(flat * q[:, None]).T @ flat for q in (p, 1 - p)]).reshape(2, n, 3, n, 3)
        if r < 10:  # the tree settles with the first rounds
            parent = strongest_tree((joint + 0.1) / (joint + 0.1).sum((2, 4), keepdims=True) * (np.array([p.sum(), (1 - p).sum()]) / texts)[:, None, None, None, None])
        alone = np.stack([np.einsum("t,tva->va", q, seen) for q in (p, 1 - p)]) + 0.5
        alone = alone / alone.sum(2, keepdims=True)
        z = np.full(texts, np.log(prior / (1 - prior)))
        for i, up in enumerate(parent):
            if up < 0:
                ratio = seen[:, i] @ (np.log(alone[0, i]) - np.log(alone[1, i]))
            else:
                # Few texts with a vote of the parent: the voter's own rates.
                given = joint[:, up, :, i, :] + 5 * alone[:, i, None, :]
                given = given / given.sum(2, keepdims=True)
                ratio = np.einsum("tb,ba,ta->t", seen[:, up], np.log(given[0]) - np.log(given[1]), seen[:, i])
            z += ratio * spoke[:, i]  # no vote says nothing
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - p).max() < 1e-4:
            return new
        p = new
    return p


def _vote(voters: Voters):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in arrays.blocks(batches):
            text = data.tobytes()
            found = [voters.votes(text[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch({"votes": pa.array([x[0] for x in found], pa.list_(pa.int32())), "found": pa.array([x[1] for x in found], pa.list_(pa.string()))})

    return work


def fit_linear(found: list[list[str]], target: np.ndarray, rounds: int = 300) -> Classifier:
    """Logistic regression on posteriors, by gradient steps with momentum over all texts of the sample."""
    names = sorted({w for row in found for w in row})
    place = {w: i for i, w in enumerate(names)}
    rows = np.repeat(np.arange(len(found)), [len(r) for r in found])
    columns = np.array([place[w] for r in found for w in r], np.int64)
    w, speed, bias = np.zeros(len(names)), np.zeros(len(names)), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    push = 0.0
    for _ in range(rounds):
        z = bias + np.bincount(rows, weights=w[columns], minlength=len(found))
        gap = target - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        step = np.bincount(columns, weights=gap[rows], minlength=len(names)) / (1 + np.bincount(columns, minlength=len(names))) - 0.002 * w
        speed, push = 0.8 * speed + step, 0.8 * push + gap.mean()
        w, bias = w + 0.5 * speed, bias + 0.5 * push
    return Classifier({n: float(x) for n, x in zip(names, w, strict=True) if x}, bias)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """From the training fold alone."""
    chosen = sample_ids(labels.where("toxic = 1"), sample).withColumn("kind", F.lit(1)).union(
        sample_ids(labels.where("toxic = 0"), sample).withColumn("kind", F.lit(0))
    )
    # Near copies would count as independent evidence for all their words: of each label one stays in the sample.
    known = sampled(docs, chosen, "doc_id").mapInArrow(_signed, "doc_id long, text string, kind int, sign long")
    first = known.groupBy("sign", "kind").agg(F.min(F.struct("doc_id", "text")).alias("x"))
    rows = stored(first.select("x.text", "kind"))
    voters = Voters(suggestions(rows))
    seen = rows.select("text").mapInArrow(_vote(voters), "votes array<int>, found array<string>").collect()
    if not seen:
        return Classifier({w: 4.0 for w in INSULTS}, -3.0)
    votes = np.array([r["votes"] for r in seen])
    prior = float(np.clip((votes > 0).any(1).mean(), 0.02, 0.98))
    return fit_linear([r["found"] for r in seen], label_model(votes, prior))


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.blocks(batches):
            text = data.tobytes()
            found = [model.score(text[a:b].decode()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    return rows.mapInArrow(work, f"row {rows.schema['row'].dataType.simpleString()}, score double")
