"""Alignment of two tokenizers over a corpus, with document counts of linked id pairs from inverted pair bitmaps.

1. Every whole text is encoded by both tokenizers (blank + text). Byte offsets where tokens of both end cut them into groups;
   ids of one group are linked, each occurrence of A with each of B. Links are never listed one by one for a wide group:
   its distinct ids are multiplied by their counts.
2. Inverted: a task numbers its documents in blocks. Per id pair and block there is one bitmap of the documents that hold the
   pair linked (compressed: 16-bit places, or bits where those are shorter), and planes: bit k of the number of links beyond
   the first. Bitmaps of the texts of a block are merged before they are written; all of it is a stored table.
3. Popcounts of the document bitmaps, added per pair over the blocks, are the counts; each A id's highest is found among the
   pairs, a table far smaller than the postings.
4. Postings return the scores: joined with the counts by pair, gathered by block (a bounded number of postings), and added
   up per document, weighted by their planes. No pair's documents and no id's pairs meet in one task.

Null and empty texts have no tokens, nor have texts that one of the tokenizers doesn't give back byte by byte: zeros, and
the empty word as ``groups_sha256``. Texts of any length are encoded whole. Every row is a document of its own, also a
repeated one or one with another's id; ids may be null. An empty table gives an empty one. Ties for the highest count
all count as best. Vocabularies hold at most 65,536 ids. Only the columns named in ``keep`` travel along.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from caseloom.llm import arrays
from caseloom.llm.store import stored

WIDE = 64  # links of a group, from which its distinct ids are multiplied
BLOCK_LINKS = 1 << 20  # distinct (pair, document) of a block, about
BLOCK_DOCS = 1 << 16  # places have 16 bits
LONG_TEXT = 1 << 18  # characters, from which a text goes to the library that has no limit on runs of white space
# A blank within a piece, and how byte-level vocabularies split texts.
MARK = "▁"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of texts and the bytes of every id."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)


def byte_level(path: str) -> Vocabulary:
    """A byte-level vocabulary file of the tokenizers library; special tokens in texts are plain text.

    If its merges stand in the order of their ids, ranks say the same as merges, and another library encodes texts to the same
    ids in a quarter of the time (equal for every code point, tested). It gives up on very long runs of white space: those
    texts, and other files, go to the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    letters = byte_alphabet()
    tokens = [b""] * library.get_vocab_size()
    for token, i in library.get_vocab().items():
        tokens[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def plainly(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    model, splitter = parts["model"], parts["pre_tokenizer"] or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    usual = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not parts["normalizer"]
    usual = usual and not (model.get("dropout") or model.get("ignore_merges")) and [model["vocab"][m] for m in merged] == list(range(256, 256 + len(merged)))
    if not usual:
        return Vocabulary(plainly, tokens)
    import tiktoken

    ranks = {tokens[i]: i for i in range(256 + len(merged))}
    faster = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def one(text: str) -> list[int]:
        try:
            return faster.encode_ordinary(" " + text)
        except (ValueError, RuntimeError):
            return plainly([text])[0]

    return Vocabulary(lambda texts: [one(t) if len(t) < LONG_TEXT else plainly([t])[0] for t in texts], tokens)


def pieces(path: str) -> Vocabulary:
    """A sentencepiece model with byte fallback, which adds the blank itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    tokens = [
        bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode()
        for i in range(model.get_piece_size())
    ]
    return Vocabulary(lambda texts: model.encode(texts, num_threads=1), tokens)


def load(path: str) -> Vocabulary:
    return pieces(path) if path.endswith(".model") else byte_level(path)


def encoded(texts: list[str], a: Vocabulary, b: Vocabulary) -> tuple[list[int], list, list]:
    """(places of the texts with tokens, their ids by A, by B): texts that both give back byte by byte."""
    full = [i for i, t in enumerate(texts) if t]
    chosen = [texts[i] for i in full]
    places, by_a, by_b = [], [], []
    for i, text, x, y in zip(full, chosen, a.encode(chosen), b.encode(chosen), strict=True):
        data = b" " + text.encode()
        if b"".join(map(a.tokens.__getitem__, x)) == data and b"".join(map(b.tokens.__getitem__, y)) == data:
            places.append(i)
            by_a.append(x)
            by_b.append(y)
    return places, by_a, by_b


class Aligned:
    """Groups and links of some texts, as arrays over all of them. ``by_a`` and ``by_b``: ids per text, of equal bytes."""

    def __init__(self, by_a: list, by_b: list, a: Vocabulary, b: Vocabulary):
        self.n_a, self.n_b = (np.array([len(x) for x in ids], np.int64) for ids in (by_a, by_b))
        self.a, self.b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((by_a, self.n_a), (by_b, self.n_b)))
        ends_a, ends_b = np.cumsum(a.sizes[self.a]), np.cumsum(b.sizes[self.b])
        # Texts are one after the other in both, so their ends are ends of both.
        common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        self.group_a, self.group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        self.doc = np.searchsorted(ends_a[np.cumsum(self.n_a) - 1], common)
        self.of_a, self.of_b = (np.bincount(g, minlength=len(common)) for g in (self.group_a, self.group_b))
        self.start_a, self.start_b = np.cumsum(self.of_a) - self.of_a, np.cumsum(self.of_b) - self.of_b

    def per_text(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.n_a), np.int64)
        np.add.at(out, self.doc, values)
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, A id << 16 | B id, number of links), each text and pair once."""
        narrow = (self.of_a * self.of_b <= WIDE)[self.group_a]
        group = self.group_a[narrow]
        repeat = self.of_b[group]
        within = np.arange(int(repeat.sum())) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        partner = self.b[np.repeat(self.start_b[group], repeat) + within]
        text, pair, many = [np.repeat(self.doc[group], repeat)], [np.repeat(self.a[narrow], repeat) << 16 | partner], [np.ones(len(partner), np.int64)]
        for g in np.flatnonzero(self.of_a * self.of_b > WIDE):
            (x, n_x), (y, n_y) = (np.unique(ids[s : s + n], return_counts=True) for ids, s, n in ((self.a, self.start_a[g], self.of_a[g]), (self.b, self.start_b[g], self.of_b[g])))
            pair.append((x[:, None] << 16 | y).ravel())
            many.append((n_x[:, None] * n_y).ravel())
            text.append(np.full(len(x) * len(y), self.doc[g]))
        key = np.concatenate(text) << 32 | np.concatenate(pair)
        by = np.argsort(key, kind="stable")
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        total = np.add.reduceat(np.concatenate(many)[by], first) if len(key) else key
        return key[first] >> 32, key[first] & 0xFFFFFFFF, total

    def written(self, words: list[bytes]) -> list[bytes]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``. ``words``: ids after a semicolon, a comma and a bar (65,536 each)."""
        later_a, later_b = np.arange(len(self.a)) > self.start_a[self.group_a], np.arange(len(self.b)) > self.start_b[self.group_b]
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + self.start_b[self.group_a]] = self.a + (later_a << 16)
        out[np.arange(len(self.b)) + (self.start_a + self.of_a)[self.group_b]] = self.b + np.where(later_b, 1 << 16, 2 << 16)
        ends = np.cumsum(self.n_a + self.n_b)
        return [b"".join(map(words.__getitem__, out[s:e].tolist()))[1:] for s, e in zip((ends - self.n_a - self.n_b).tolist(), ends.tolist(), strict=True)]


def bitmaps(pair: np.ndarray, doc: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, bool, pa.Array, np.ndarray]]:
    """(pairs, dense, bitmap of each, popcounts) of entries sorted by (pair, doc), in a block of ``size`` documents."""
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(np.append(first, len(pair)))
    width = -(-size // 8)
    dense = 2 * count > width
    sparse = ~dense
    if sparse.any():
        ends = np.concatenate([[0], np.cumsum(2 * count[sparse])]).astype(np.int32)
        data = doc[np.repeat(sparse, count)].astype("<u2").tobytes()
        yield pair[first[sparse]], False, pa.Array.from_buffers(pa.binary(), int(sparse.sum()), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]), count[sparse]
    many = np.flatnonzero(dense)
    step = max(1, (8 << 20) // max(size, 1))
    for some in (many[i : i + step] for i in range(0, len(many), step)):
        bits = np.zeros((len(some), 8 * width), np.uint8)
        for row, k in enumerate(some.tolist()):
            bits[row, doc[first[k] : first[k] + count[k]]] = 1
        packed = np.packbits(bits, axis=1)
        popcount = np.bitwise_count(packed).sum(axis=1, dtype=np.int64)
        yield pair[first[some]], True, pa.array([row.tobytes() for row in packed], pa.binary()), popcount


POSTING = [
    StructField("block", LongType()), StructField("plane", IntegerType()), StructField("pair", LongType()),
    StructField("dense", BooleanType()), StructField("bits", BinaryType()), StructField("n", LongType()),
]
FACTS = [StructField("slot", IntegerType()), *(StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")), StructField("groups_sha256", StringType())]
ALL = -1  # plane of the documents themselves


def _index(path_a: str, path_b: str, carried: list[StructField], block_links: int):
    """Rows: documents (slot and facts) and postings of their block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType([*POSTING, *FACTS, *carried]), prefers_large_types=False)

    def rows(many: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(many, f.type) for f in schema], schema=schema)

    def postings(block: int, held: list, size: int) -> Iterator[pa.RecordBatch]:
        doc, pair, many = (np.concatenate(x) for x in zip(*held, strict=True))
        by = np.argsort(pair << 16 | doc, kind="stable")
        doc, pair, extra = doc[by], pair[by], many[by] - 1
        chosen, plane = np.ones(len(doc), bool), ALL
        while chosen.any():
            for pairs, dense, bits, n in bitmaps(pair[chosen], doc[chosen], size):
                m = len(pairs)
                yield rows(m, block=pa.array(np.full(m, block)), plane=pa.array(np.full(m, plane)), pair=pa.array(pairs), dense=pa.array([dense] * m), bits=bits, n=pa.array(n))
            plane += 1
            more = extra >> plane
            if not more.any():
                return
            chosen = more & 1 == 1
            while not chosen.any():
                plane += 1
                chosen = extra >> plane & 1 == 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, words = arrays.kept(("alignment", path_a, path_b), lambda: (load(path_a), load(path_b), [sep + str(i).encode() for sep in (b";", b",", b"|") for i in range(1 << 16)]))
        block, held, links, docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch, data, offsets in arrays.blocks(batches, keep=True):
            for part in (batch.slice(i, BLOCK_DOCS // 2) for i in range(0, len(batch), BLOCK_DOCS // 2)):
                if links >= block_links or docs + len(part) > BLOCK_DOCS:
                    yield from postings(block, held, docs) if held else ()
                    block, held, links, docs = block + 1, [], 0, 0
                places, by_a, by_b = encoded([t or "" for t in part.column("text").to_pylist()], a, b)
                facts = {c: np.zeros(len(part), np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
                digests = [""] * len(part)
                if places:
                    found = Aligned(by_a, by_b, a, b)
                    for c, values in (("n_a", found.n_a), ("n_b", found.n_b), ("n_groups", found.per_text(np.ones(len(found.doc), np.int64))), ("n_links", found.per_text(found.of_a * found.of_b))):
                        facts[c][places] = values
                    for place, groups in zip(places, found.written(words), strict=True):
                        digests[place] = hashlib.sha256(groups).hexdigest()
                    doc, pair, many = found.links()
                    held.append((np.array(places)[doc] + docs, pair, many))
                    links += len(doc)
                yield rows(
                    len(part), block=pa.array(np.full(len(part), block)), slot=pa.array(np.arange(docs, docs + len(part))), groups_sha256=pa.array(digests),
                    **{c: pa.array(v) for c, v in facts.items()}, **{f.name: part.column(f.name) for f in carried},
                )
                docs += len(part)
        if held:
            yield from postings(block, held, docs)

    return work


def returned(table: pa.Table, names: list[str]) -> pa.Table:
    """The documents of a block with the scores of their links: ``n_best`` and ``count_sum``."""
    facts = table.filter(pa.compute.is_valid(table["slot"])).sort_by("slot")
    posts = table.filter(pa.compute.is_valid(table["plane"])).combine_chunks()
    total, best = np.zeros(len(facts), np.int64), np.zeros(len(facts), np.int64)
    for dense in (False, True):
        part = posts.filter(pa.compute.equal(posts["dense"], dense)).combine_chunks()
        if not len(part):
            continue
        weight = np.int64(1) << np.maximum(part["plane"].to_numpy().astype(np.int64), 0)
        scores = weight * part["count"].to_numpy(), weight * part["best"].to_numpy(zero_copy_only=False)
        data = b"".join(part["bits"].to_pylist())
        if dense:
            width = -(-len(facts) // 8)
            packed = np.frombuffer(data, np.uint8).reshape(len(part), width)
            for i in range(0, len(part), 256):
                bits = np.unpackbits(packed[i : i + 256], axis=1)[:, : len(facts)].astype(np.int64)
                total += scores[0][i : i + 256] @ bits
                best += scores[1][i : i + 256] @ bits
        else:
            places, count = np.frombuffer(data, "<u2"), pa.compute.binary_length(part["bits"]).to_numpy() // 2
            np.add.at(total, places, np.repeat(scores[0], count))
            np.add.at(best, places, np.repeat(scores[1], count))
    return facts.select(names).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))


def pair_counts(index: DataFrame) -> DataFrame:
    """pair (A id << 16 | B id), count (documents that hold it linked) and best (whether no pair of its A id has more)."""
    counts = index.where(F.col("plane") == ALL).groupBy("pair").agg(F.sum("n").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 16)))  # at most one row per B id
    return counts.select("pair", "count", (F.col("count") == highest).alias("best"))


def build_index(docs: DataFrame, path_a: str, path_b: str, keep: list[str], block_links: int = BLOCK_LINKS) -> DataFrame:
    """The stored inverted index: rows of documents and of postings, by block. Kept columns are named ``kept_0`` ..."""
    carried = [StructField(f"kept_{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    source = docs.select(F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f.name) for c, f in zip(keep, carried, strict=True)))
    return stored(source.mapInArrow(_index(path_a, path_b, carried, block_links), StructType([*POSTING, *FACTS, *carried])))


def align(docs: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), block_links: int = BLOCK_LINKS) -> DataFrame:
    """Kept columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    The counts grow with the corpus and have no bound: they meet the postings in a shuffle, never as a broadcast."""
    index = build_index(docs, path_a, path_b, list(keep), block_links)
    scores = stored(pair_counts(index))
    names = [f"kept_{i}" for i in range(len(keep))]
    names += ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    facts = index.where("slot is not null").select("block", "slot", *names)
    posts = index.where("plane is not null").select("block", "pair", "plane", "dense", "bits").join(scores.hint("shuffle_merge"), "pair").drop("pair")
    both = facts.unionByName(posts, allowMissingColumns=True)
    schema = StructType([*(index.schema[c] for c in names), StructField("n_best", LongType()), StructField("count_sum", LongType())])
    found = both.groupBy("block").applyInArrow(lambda table: returned(table, names), schema)
    return found.select(*(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), *(c for c in found.columns if not c.startswith("kept_")))


def linked_pairs(index: DataFrame) -> DataFrame:
    """The counts as a table for readers: a, b, count, links (in all documents) and best."""
    links = index.where("plane is not null").groupBy("pair").agg(F.sum(F.expr("n * shiftleft(1L, greatest(plane, 0))")).alias("links"))
    return pair_counts(index).join(links, "pair").select(F.shiftright("pair", 16).alias("a"), F.col("pair").bitwiseAND(0xFFFF).alias("b"), "count", "links", "best")
