"""Plain, slow versions of the contracts."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import sentencepiece
from tokenizers import Tokenizer

SPACE = " \t\n\x0b\f\r"


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def quality_measures(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    n, repeated = len(words), len(hit)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated, "base_failed": n < 20 or 100 * repeated > 30 * n,
    }


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = words_of(lower_ascii(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(rows):
    """rows: (doc_id, text) -> {doc_id: (n_shingles, component)}; doc_ids are distinct."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e < d).items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(rows, length=100):
    """rows: (doc_id, text) in document order -> [(doc_id, n_bytes, n_removed, n_spans, sha)]."""
    seen, out = set(), []
    for d, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(documents, items):
    """documents: (doc_id, text); items: (item_id, text) -> [(doc_id, n_words, n_hit, n_items, sha, contaminated)]."""
    windows = defaultdict(set)
    for item, text in items:
        words = tuple(WORD.findall(lower_ascii(text)))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[words[i : i + n]].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for d, text in documents:
        words = WORD.findall(lower_ascii(text))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[w]
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((d, len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_pii(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    order = ["email", "ip", "card", "phone"]
    out.sort(key=lambda x: (x[1], order.index(x[0])))
    return out


def whitening(rows, k=4):
    """rows: (vec_id, entries) -> (n, exact sums, [(vec_id, deviation, distances from the mean)], variances, axes, trace)."""
    longest = 2**63 - 1
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in usable), default=0)
    usable = [(i, [max(-longest - 1, min(longest, math.floor(256 * c))) for c in v] + [0] * (width - len(v))) for i, v in usable]
    kinds = sorted({tuple(v) for _, v in usable})
    n, sums = len(kinds), [sum(v[j] for v in kinds) for j in range(width)]
    covariance = np.array([[float(Fraction(n * sum(v[a] * v[b] for v in kinds) - sums[a] * sums[b], n * n)) for b in range(width)] for a in range(width)])
    values, vectors = np.linalg.eigh(covariance)
    out = [(i, sum((n * x - s) ** 2 for x, s in zip(v, sums)), [float(Fraction(n * x - s, n)) for x, s in zip(v, sums)]) for i, v in usable]
    return n, sums, out, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(covariance)


def alignment(rows, path_a, path_b):
    """rows: (doc_id, text) -> [(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, sha)]."""
    library = Tokenizer.from_file(path_a)
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, plain), plain)) | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    found, held = [], Counter()
    for doc_id, text in rows:
        groups, a, b = [], [], []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            x = [bytes(letters[c] for c in library.id_to_token(i)) for i in a]
            y = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [model.id_to_piece(i)]]
            if b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
                a, b = [], []
            else:
                i = j = at_x = at_y = 0
                group = ([], [])
                while i < len(a) or j < len(b):
                    if at_x <= at_y and i < len(a):
                        group[0].append(a[i])
                        at_x, i = at_x + len(x[i]), i + 1
                    else:
                        group[1].append(b[j])
                        at_y, j = at_y + len(y[j]), j + 1
                    if at_x == at_y:
                        groups.append(group)
                        group = ([], [])
        links = Counter((p, q) for g, h in groups for p in g for q in h)
        held.update(links.keys())
        found.append((doc_id, a, b, groups, links))
    top = defaultdict(int)
    for (p, _), count in held.items():
        top[p] = max(top[p], count)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        best = sum(n for pair, n in links.items() if held[pair] == top[pair[0]])
        sha = hashlib.sha256(text.encode()).hexdigest() if a else ""
        out.append((doc_id, len(a), len(b), len(groups), sum(links.values()), best, sum(n * held[pair] for pair, n in links.items()), sha))
    return out
