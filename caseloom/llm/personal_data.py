"""Personal data: base rules, and candidates chosen by gradient boosting.

Base spans (email, ip, card, phone) come from fixed patterns and checks. High-recall generators propose overlapping
spans of the same kinds and of secrets. Boosted trees judge them by format and context; they learn from candidates that
are verified (equal to a base span, or of a known key format) against candidates that fail the checks of their kind, and
what is neither is left out, such as an email of good form that no base span covers. Raw scores are calibrated on one half of the sample, and each kind's threshold is the least
probability at which ``PRECISION`` of that half's picks are verified. Picks that overlap a base span are dropped; of
overlapping picks the likelier stays.

The fit takes the candidates of at most ``SAMPLE`` documents (least hashes of their id), of these the ``rows`` of least
hashes, a documented bound; every whole text is searched. Small samples switch parts off: with under 5 verified or 5
failed candidates in a half there is no model and only base spans are found, and a kind adds no span unless at least
``least`` of its candidates in the calibration half reach ``PRECISION`` together. All patterns take linear time, also on long runs. Null and empty texts have no spans. Repeated rows
and equal ids are judged row by row. Empty tables give empty results. Other columns travel along in ``row``.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrays, boosting
from caseloom.llm.folds import sample_ids, sampled

SAMPLE = 8_000
PRECISION = 0.98
KINDS = ["email", "ip", "card", "phone", "secret"]
# The base patterns, written so that no start is tried twice.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Generators: wider patterns.
WIDE = {
    "email": re.compile(r"(?<![^\s<(\[,;:\"'])[^\s@<>()\[\],;:\"']{1,64}+(?:@|\s?\[at\]\s?|\(at\))[^\s@<>()\[\],;:\"']{2,255}+"),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{2,6}){2,4}(?![0-9])|(?<![0-9])[0-9]{12,19}+(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:\+|00)?[0-9(][0-9().\x20/-]{6,24}[0-9](?![0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+(?![A-Za-z0-9_+/-])"),
}
AT = re.compile(r"\s?\[at\]\s?|\(at\)")
FORM = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
KEY = re.compile(r"AKIA[0-9A-Z]{16}|[0-9a-f]{18,128}")
NAMES = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "server", "host", "address", "addr"), "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell"), "secret": ("token", "password", "secret", "key", "passwd", "pwd", "auth"),
    "other": ("version", "page", "isbn", "year", "number", "no", "chapter", "section", "id"),
}
NUMERIC = arrays.byte_set(b"0123456789@")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    digits = _digits(text)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in the order of KINDS."""
    out, done, before = [], 0, 0
    for m in DOMAIN.finditer(text):
        # A local part can't reach back over the last match or another @.
        at = m.start()
        low = max(done, text.rfind("@", before, at) + 1)
        local = text[low:at]
        start = low + len(local.rstrip(LOCAL))
        before = at
        if start < at:
            out.append(("email", start, m.end()))
            done = m.end()
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    found = {(kind, *m.span()) for kind, pattern in WIDE.items() for m in pattern.finditer(text) if kind == "email" or any("0" <= c <= "9" for c in m[0])}
    for kind, start, end in [x for x in found if x[0] == "email"]:  # proposals may overlap
        trimmed = text[start:end].rstrip(".,!?")
        found.add((kind, start, start + len(trimmed)))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span, before, after = text[start:end], text[max(0, start - 40) : start].lower(), text[end : end + 1]
    digits, letters = _digits(span), sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    words = re.findall(r"[a-z]+", before)[-3:]
    _, at, domain = (AT.sub("@", span) if kind == "email" else span).partition("@")
    return [
        *(float(kind == k) for k in KINDS), len(span), len(digits), letters, len(groups), groups[0], groups[-1], max(groups),
        *(span.count(c) for c in " -.()/"), span[0] == "+", span[:2] == "00", at == "@", domain.count("."), span.isupper(), span.islower(),
        len(set(span)) / len(span), all(c in "0123456789abcdef" for c in span), valid(kind, span), len(digits) / len(span),
        *(any(w in names for w in words) for names in NAMES.values()),
        before[-1:] in ("=", ":"), before[-2:] in ('="', "= ", ': ', '"', ' "'), before[-1:].isdigit(), after.isdigit(), after in (" ", "", "\n", ".", ","),
        sum(c.isdigit() for c in before) / 40,
    ]


def verdict(kind: str, span: str, is_base: bool, named: bool) -> int:
    """1 verified, 0 fails the checks of its kind, -1 neither."""
    if kind == "secret":
        return 1 if KEY.fullmatch(span) and (named or span.startswith("AKIA")) else 0 if not any(c.isdigit() for c in span) or span.isdigit() else -1
    if kind == "email":
        return 1 if is_base else -1 if FORM.fullmatch(AT.sub("@", span)) else 0
    return 1 if is_base else -1 if valid(kind, span) else 0


class Model:
    def __init__(self, trees: boosting.Trees, scale: tuple[float, float], thresholds: dict[str, float]):
        self.trees, self.scale, self.thresholds = trees, scale, thresholds

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * self.trees.raw(x) + self.scale[1], -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, precision: float = PRECISION, least: int = 20) -> Model | None:
    half = np.arange(len(y)) % 2 == 0
    if min(y[half].sum(), (1 - y[half]).sum(), y[~half].sum(), (1 - y[~half]).sum()) < 5:
        return None
    trees = boosting.fit(x[half], y[half])
    raw, target = trees.raw(x[~half]), y[~half]
    a, b = 1.0, 0.0
    for _ in range(500):  # calibration: logistic regression on the raw score
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a, b = a + 0.05 * np.mean((target - p) * raw) - 0.0005 * (a - 1), b + 0.05 * np.mean(target - p)
    model = Model(trees, (a, b), {})
    p = model.probabilities(x[~half])
    for i, kind in enumerate(KINDS):
        own = x[~half][:, i] > 0
        order = np.argsort(-p[own])
        right = np.cumsum(target[own][order]) / np.arange(1, own.sum() + 1)
        enough = np.flatnonzero((right >= precision) & (np.arange(1, own.sum() + 1) >= least))
        model.thresholds[kind] = max(0.5, float(p[own][order][enough[-1]])) if len(enough) else 2.0
    return model


def find(text: str, model: Model | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans)."""
    base = base_spans(text)
    found = candidates(text) if model else []
    taken = [(a, b) for _, a, b in base]
    added = []
    free = _apart(found, taken)
    if free:
        p = model.probabilities(np.array([features(text, *c) for c in free], np.float64))
        picked = sorted((-q, c) for q, c in zip(p, free, strict=True) if q >= model.thresholds[c[0]])
        for _, c in picked:
            at = bisect.bisect_left(added, c[1], key=lambda x: x[1])
            if (at == 0 or added[at - 1][2] <= c[1]) and (at == len(added) or added[at][1] >= c[2]):
                added.insert(at, c)
    return base, added


def _apart(spans, taken):
    """Spans that overlap none of ``taken``; both in order of their starts."""
    if not taken:
        return spans
    starts = np.array([a for a, _ in taken])
    reach = np.maximum.accumulate([b for _, b in taken])
    out = []
    for c in spans:
        i = int(np.searchsorted(starts, c[2], "left")) - 1  # taken spans that start before the end
        if i < 0 or reach[i] <= c[1]:
            out.append(c)
    return out


def _numeric(data: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Texts that have a digit or an @: all spans do, but for emails with a written-out at."""
    total = np.concatenate([[0], np.cumsum(NUMERIC[data], dtype=np.int64)])
    return (total[offsets[1:]] > total[offsets[:-1]]).tolist()


def _texts(data: np.ndarray, offsets: np.ndarray) -> Iterator[str | None]:
    text = data.tobytes()
    for a, b, some in zip(offsets[:-1].tolist(), offsets[1:].tolist(), _numeric(data, offsets), strict=True):
        yield text[a:b].decode() if some or text.find(b"[at]", a, b) >= 0 or text.find(b"(at)", a, b) >= 0 else None


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in arrays.blocks(batches):
        x, y, near = [], [], []
        for text in _texts(data, offsets):
            if text is not None:
                base = set(base_spans(text))
                for c in candidates(text):
                    row = features(text, *c)
                    named = any(n in text[max(0, c[1] - 20) : c[1]].lower() for n in NAMES["secret"])
                    label = verdict(c[0], text[c[1] : c[2]], c in base, named)
                    if label >= 0:
                        x.append(np.array(row, np.float32).tobytes())
                        y.append(label)
                        near.append(zlib.crc32(text[max(0, c[1] - 40) : c[2]].encode()))
        yield pa.record_batch({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.int32()), "near": pa.array(near, pa.int64())})


def learn(docs: DataFrame, sample: int = SAMPLE, rows: int = 40_000) -> Model | None:
    chosen = sample_ids(docs, sample).withColumn("kind", F.lit(0))
    # At most ``rows`` candidates, those of the least hashes: a text may hold many.
    found = sampled(docs, chosen).mapInArrow(_training, "x binary, y int, near long")
    found = found.orderBy(F.xxhash64("x", "y", "near"), "x", "y").limit(rows).select("x", "y").collect()
    if not found:
        return None
    found.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # the same whatever the order of the rows
    return fit(np.stack([np.frombuffer(r["x"], np.float32) for r in found]).astype(np.float64), np.array([r["y"] for r in found], np.float64))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span, or run of overlapping spans, replaced by the kind of its first."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def _search(model: Model | None, rewrite: bool):
    names = ["row", *(f"n_{k}" for k in KINDS[:4]), "base", "spans", "redacted"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.blocks(batches):
            counts, base_text, all_text, texts = [], [], [], []
            for text, same in zip(_texts(data, offsets), batch.column("text"), strict=True):
                base, added = find(text, model) if text is not None else ([], [])
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS[:4]])
                spans = sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0])))
                base_text.append(joined(base))
                all_text.append(joined(spans))
                if rewrite:
                    texts.append(redacted(text, spans) if spans else same.as_py())
            columns = [pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)]
            texts = pa.array(texts, pa.string()) if rewrite else pa.nulls(len(batch), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *columns, pa.array(base_text, pa.string()), pa.array(all_text, pa.string()), texts], names=names)

    return work


def find_personal_data(docs: DataFrame, model: Model | None, rewrite: bool = True) -> DataFrame:
    """``row`` (all columns of ``docs``), counts of base spans, ``base`` and ``spans`` as kind:start:end lists, and the
    ``redacted`` text (null without ``rewrite``)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    kind = rows.schema["row"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS[:4])
    return rows.mapInArrow(_search(model, rewrite), f"row {kind}, {counts}, base string, spans string, redacted string")

