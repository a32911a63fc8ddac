"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is the encoding of its text if and only if each two neighbours are: their joined text encodes to
just these two. So each prefix of a word has one possible last token: the one that is compatible with the last token of
the prefix before it. An automaton over the vocabulary lists the tokens that end at each place, the compatibility of a
pair is worked out once from the merge ranks, and back-pointers give the exact ids.

Normalising and splitting into words follow the tokenizer file (the library does both for each distinct piece of text);
the merges are worked out here. Texts are split at ASCII white space first, which no word of this tokenizer crosses.
A worker keeps a bounded number of results per piece; what falls out is worked out again.

Null and empty texts have no ids. Repeated rows and equal ids are encoded row by row, whole texts of any length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrays

END = "\0"  # stands for the end-of-word suffix, so that it takes one place in a word
WORDS_KEPT, PAIRS_KEPT = 260_000, 400_000
# The split pattern of the word tokenizer, and what it comes to on lower-case ASCII.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# On lower-case text of ASCII and the Latin-1 letters alone, which NFC leaves as it is. Control characters are left out.
LETTERS = "\u00e0-\u00f6\u00f8-\u00ff\u00df"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\\x09-\\x0D\\x20a-z0-9{LETTERS}]+")
BEYOND = "[\\x00-\\x08\\x0E-\\x1F\\x7F-\u00bf\u00d7\u00f7\u0100-\U0010ffff]"
PLAIN = re.compile(f"[a-z{LETTERS}]+")
# How byte-level tokenizers write a byte as a character: visible ones as they are, the others from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}
SPACE = re.compile("[\\x09-\\x0D\\x20]+")


class Splitter:
    """A text as parts that the tokenizer encodes one by one: its words where the tokenizer is a lower-casing one of the
    fixed pattern and the characters are common, or else pieces without ASCII white space, which no word crosses."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [[x["type"] for x in (spec[part] or {}).get(name, [])] for part, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.suffix = spec["model"].get("end_of_word_suffix")
        self.fixed = fixed = (
            steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": SPLIT}
        )
        names = [re.escape(x["content"]) for x in spec["added_tokens"]]
        self.odd = re.compile("|".join([BEYOND, *names]) if fixed else "").search
        self.firsts = {x["content"][:2] for x in spec["added_tokens"]}

    def parts(self, text: str) -> list[str]:
        odd = self.odd
        # The first test is the quick one: common white space and printable ASCII.
        if self.fixed and text.isascii() and text.replace("\n", " ").isprintable() and not any(x in text for x in self.firsts) or not odd(text):
            return WORDS.findall(text.lower())
        out: list[str] = []
        for piece in SPACE.split(text):
            if odd(piece):
                out.append(piece)
            else:
                out += WORDS.findall(piece.lower())
        return [x for x in out if x]


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        splitter = Splitter(path)
        self.parts, self.fixed = splitter.parts, splitter.fixed
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: name for name, i in model["vocab"].items()} | {i: name for name, i in self.special.items()}
        vocab = {self._marked(name): i for name, i in model["vocab"].items()}
        self.text = {i: t for t, i in vocab.items()}
        self.made: dict[int, tuple[int, int, int]] = {}  # token -> its two parts and the rank of their merge
        self.ends: dict[int, list] = {}
        self.starts: dict[int, list] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            left, right = self._marked(left), self._marked(right)
            made = vocab[left + right]
            self.rank[vocab[left], vocab[right]] = (rank, made)
            self.made[made] = (vocab[left], vocab[right], rank)
        self.vocab = vocab
        self.compatible = arrays.Recent(PAIRS_KEPT)
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if self.merged(text) == [i]:  # other tokens never occur in an encoding
                self.automaton.add_word(text, (len(text), i))
        self.automaton.make_automaton()
        self.known = arrays.Recent(WORDS_KEPT)

    def _marked(self, name: str) -> str:
        return name[: -len(self.suffix)] + END if self.suffix and name.endswith(self.suffix) else name

    def merged(self, text: str) -> list[int]:
        """Ids by applying merges in the order of their ranks: used on single tokens only."""
        parts: list[int] = []
        for i, c in enumerate(text):
            if c != END:
                parts.append(self.vocab[text[i : i + 2] if text[i + 1 : i + 2] == END else c])
        while len(parts) > 1:
            best = min((self.rank[p] + (j,) for j, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)
            if best is None:
                break
            parts[best[2] : best[2] + 2] = [best[1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at one end (0: first, 1: last) of a token while it is put together, from its first
        byte on, each with the rank of the merge that takes it up."""
        out: list[tuple[int, float]] = [(token, inf)]
        while (made := self.made.get(token)) is not None:
            token = made[side]
            out.append((token, made[2]))
        return out[::-1]

    def fits(self, left: int, right: int) -> bool:
        """Whether the text of both encodes to just these two, that is, no merge across their border comes first.

        Of equal ranks the leftmost merge comes first: one inside ``left`` before, one inside ``right`` after it."""
        ends, starts = self.ends.get(left), self.starts.get(right)
        if ends is None:
            ends = self.ends[left] = self._spine(left, 1)
        if starts is None:
            starts = self.starts[right] = self._spine(right, 0)
        i = j = 0
        while True:
            (a, until_a), (b, until_b) = ends[i], starts[j]
            across = self.rank.get((a, b))
            if across is not None and across[0] < until_a and across[0] <= until_b:
                fit = False
                break
            if until_a == until_b == inf:
                fit = True
                break
            if until_a <= until_b:
                i += 1
            else:
                j += 1
        self.compatible.keep(left << 32 | right, fit)
        return fit

    def word(self, word: str) -> list[int]:
        """Ids of one word, its end marked by END."""
        last: list[int | None] = [None] * (len(word) + 1)  # the last token of each prefix
        start = [0] * (len(word) + 1)
        known = self.compatible
        for end, (length, token) in self.automaton.iter(word):
            end += 1
            if last[end] is not None:
                continue
            at = end - length
            if at:
                before = last[at]
                if before is None:
                    continue
                fit = known.get(before << 32 | token)
                if fit is None:
                    fit = self.fits(before, token)
                if not fit:
                    continue
            last[end], start[end] = token, at
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at = start[at]
        return out[::-1]

    def _plain(self, text: str) -> list[int]:
        parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [i for part, _ in parts for i in self.word(part + END)]

    def ids(self, text: str) -> list[int]:
        """Ids of a text, in which the strings of special tokens are those tokens."""
        if not self.specials.search(text):
            return self._plain(text)
        out: list[int] = []
        for i, part in enumerate(self.specials.split(text)):
            out += [self.special[part]] if i % 2 else self._plain(part)
        return out

    def part(self, part: str) -> tuple[int, str, str]:
        """(number of ids, ids, decoded text) of a part, each string with a space before every token."""
        found = self.known.find(part)
        if found is None:
            # Lower-case letters that NFC leaves alone are one word; all else goes through the library's first steps.
            word = self.fixed and PLAIN.fullmatch(part)
            ids = self.word(part.encode().decode("latin-1").translate(BYTES) + END) if word else self.ids(part)
            found = len(ids), "".join(f" {i}" for i in ids), "".join(f" {self.names[i]}" for i in ids)
            if len(part) < 64:
                self.known.keep(part, found)
        return found

    def whole(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """The same of any texts, without the first space."""
        rows = [self.parts(t) for t in texts]
        known, part = self.known.get, self.part
        distinct = {p: known(p) or part(p) for p in set().union(*rows)}
        counts, ids, names = ({p: x[i] for p, x in distinct.items()}.__getitem__ for i in range(3))
        return [(sum(map(counts, row)), "".join(map(ids, row))[1:], "".join(map(names, row))[1:]) for row in rows]


def encoder(path: str) -> Encoder:
    return arrays.kept(("bpe", path), lambda: Encoder(path))


def _work(path: str, lists: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch, data, offsets in arrays.blocks(batches, keep=True):
            text = data.tobytes()
            texts = [text[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [x for at in range(0, len(texts), 128) for x in own.whole(texts[at : at + 128])]
            counts = pa.array([x[0] for x in found], pa.int64())
            columns = [pa.array([hashlib.sha256(x[i].encode()).hexdigest() for x in found], pa.string()) for i in (1, 2)]
            names = ["row", "n_tokens", "ids_sha256", "decoded_sha256"]
            if lists:
                columns += [pa.array([np.array(x[1].split(), np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[2] for x in found], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("row"), counts, *columns], names=names)

    return work


def encode(docs: DataFrame, path: str, lists: bool = True) -> DataFrame:
    """``row`` (all columns of ``docs``), ``n_tokens``, ``ids_sha256`` (of the ids in decimal, joined by spaces),
    ``decoded_sha256`` and, unless ``lists`` is off, ``ids`` and the ``decoded`` text."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    schema = f"row {row.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return row.mapInArrow(_work(path, lists), schema + (", ids array<int>, decoded string" if lists else ""))
