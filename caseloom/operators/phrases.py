"""Which phrase occurs in which text, without comparing every text with every phrase.

Three ways, chosen by the size of the phrase table and equal in result:

* a list of at most ``SHORT_LIST`` phrases is one alternation of literals (redaction only);
* up to ``IN_ROWS`` bytes of phrases, a bound that is checked, go to all tasks: texts are read once, phrases are found and
  compared inside the row (`anchors.Matcher`), and no row moves;
* a larger table is joined. Texts are read twice and never shuffled whole. The first pass counts in how many places
  the windows of the phrases occur: a phrase with a window that occurs nowhere is done, any other takes its
  rarest window as its anchor. The second pass sends, for each anchor, only the bytes around it; there the phrase is
  compared byte by byte. Anchors that occur very often are salted.

Texts and phrases are compared in the form `fold_case` gives if case is ignored, which is equal exactly where a pattern that
ignores case is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from caseloom.constants import REDACTED, pattern
from caseloom.functions.redaction import phrase_array_pattern, redact
from caseloom.functions.text import fold_case
from caseloom.operators import anchors
from caseloom.session import cut_lineage

# Longest list of phrases that becomes one literal alternation.
SHORT_LIST = 100
# Bytes of phrases, up to which a table goes to all tasks.
IN_ROWS = 8 << 20
# Windows of a phrase that are counted, evenly spread; all of a phrase with fewer.
OFFERED = 8
# Places of an anchor in all texts, from which its rows are dealt to several tasks, and how many such anchors are told apart.
OFTEN, MOST_OFTEN = 200_000, 10_000
# Anchors that leave a task in one batch.
PLACES = 8192


def _form(column: str, ignore_case: bool, flex: bool = False, unicode: bool = True) -> Column:
    text = F.col(column)
    text = fold_case(text) if ignore_case else text
    return F.regexp_replace(text, pattern("[{s}]+", unicode), " ") if flex else text


def _scope(by: Sequence[str]) -> Column:
    return F.xxhash64(*by) if by else F.lit(0).cast("long")


def _listed(phrases: DataFrame, by: Sequence[str], phrase: str, ignore_case: bool, flex: bool, unicode: bool) -> DataFrame:
    """``_scope``, ``_form`` of the phrases that are not empty; each once. With ``flex`` outer white space is no part.
    A phrase without a package belongs to none."""
    form = _form(phrase, ignore_case, flex, unicode)
    form = F.trim(form) if flex else form
    named = phrases.dropna(subset=list(by)) if by else phrases
    return named.select(_scope(by).alias("_scope"), form.alias("_form")).filter(F.col("_form") != "").distinct()


def _size(listed: DataFrame) -> int:
    return listed.agg(F.sum(F.octet_length("_form") + 16)).first()[0] or 0


def _matcher(listed: DataFrame, by: Sequence[str]) -> tuple[list[tuple[int, str]], object]:
    """The phrases of a table whose size was checked, and their matcher for all tasks."""
    rows = sorted((r["_scope"], r["_form"]) for r in listed.collect())
    matcher = anchors.Matcher([(s, f.encode()) for s, f in rows], bool(by)) if rows else None
    return rows, listed.sparkSession.sparkContext.broadcast(matcher)


def _search(shared, texts: pa.Array, scope: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, phrases, bytes, offsets, first row) of each piece of a batch."""
    matcher = shared.value
    data, offsets = anchors.as_bytes(texts)
    for first, part, ends in anchors.pieces(data, offsets):
        own = scope.to_numpy()[first : first + len(ends) - 1]
        yield *matcher.find(part, ends, own), part, ends, first


def _hits(shared):
    @arrow_udf("array<struct<i:int,n:long>>")
    def hits(texts: pa.Array, scope: pa.Array) -> pa.Array:
        counts, which, many = np.zeros(len(texts), np.int64), [], []
        for rows, found, data, offsets, first in _search(shared, texts, scope):
            matcher, raw = shared.value, data.tobytes()
            phrases = matcher.data.tobytes()
            for row, k in zip(rows.tolist(), found.tolist(), strict=True):
                start, size = int(matcher.starts[k]), int(matcher.sizes[k])
                which.append(k)
                many.append(raw.count(phrases[start : start + size], int(offsets[row]), int(offsets[row + 1])))
            counts[first : first + len(offsets) - 1] = np.bincount(rows, minlength=len(offsets) - 1)
        items = pa.StructArray.from_arrays([pa.array(which, pa.int32()), pa.array(many, pa.int64())], names=["i", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), items)

    return hits


def _names(shared, originals):
    @arrow_udf("array<string>")
    def names(texts: pa.Array, scope: pa.Array) -> pa.Array:
        out = [[] for _ in range(len(texts))]
        for rows, found, _, _, first in _search(shared, texts, scope):
            for row, k in zip(rows.tolist(), found.tolist(), strict=True):
                out[first + row] += originals.value[k]
        return pa.array(out, pa.list_(pa.string()))

    return names


# --- the join, for tables of any size ----------------------------------------


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each phrase: ``h``, and ``at``, where the phrase has it."""
    for batch in batches:
        data, offsets = anchors.as_bytes(batch.column("_form"))
        scopes, sizes = batch.column("_scope").to_numpy(), np.diff(offsets)
        kinds = np.array([anchors.anchor_size(n) for n in sizes.tolist()], np.int64)
        for size, hashes in anchors.window_hashes(data, sorted(set(kinds.tolist()))):
            own = np.flatnonzero(kinds == size)
            room = sizes[own] - size
            step = np.arange(OFFERED)
            at = np.where(room[:, None] < OFFERED, np.minimum(step, room[:, None]), step * room[:, None] // (OFFERED - 1))
            phrase, at = np.repeat(own, OFFERED), at.ravel()
            keys = anchors.scoped(hashes, scopes, offsets)[offsets[phrase] + at]
            rows = batch.take(pa.array(phrase, pa.int64()))
            yield pa.record_batch({
                "_scope": rows.column("_scope"), "_form": rows.column("_form"), "size": pa.array(np.full(len(at), size), pa.int32()),
                "h": pa.array(keys.view(np.int64), pa.int64()), "at": pa.array(at, pa.int32()),
            })


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bitmap of a table of hashes (``h``) of any length, from Spark's bitmaps of 4 KB: 8 MB at most."""
    width = min(26, max(16, (32 * hashes.count()).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - width)
    rows = hashes.groupBy(F.shiftright(slot, 15).alias("piece")).agg(F.bitmap_construct_agg(slot.bitwiseAND(32767)).alias("bits")).collect()
    out = np.zeros((1 << width) // 8, np.uint8)
    for r in rows:
        out[r["piece"] * 4096 : r["piece"] * 4096 + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _known_windows(bits: np.ndarray, levels: list[int], batch: pa.RecordBatch) -> Iterator[tuple]:
    """(size, places, hashes, rows, bytes, offsets, first row): windows that the bitmap knows and that lie in one text."""
    data, offsets = anchors.as_bytes(batch.column("_form"))
    scopes = batch.column("_scope").to_numpy()
    for first, part, ends in anchors.pieces(data, offsets):
        for size, hashes in anchors.window_hashes(part, levels):
            keys = anchors.scoped(hashes, scopes[first : first + len(ends) - 1], ends)
            place = anchors.passing(bits, keys)
            row = np.searchsorted(ends, place, "right") - 1
            whole = place + size <= ends[row + 1]
            place, row = place[whole], row[whole]
            yield size, place, keys[place], row, part, ends, first


def _count(shared, levels: list[int]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, keys, *_ in _known_windows(shared.value, levels, batch):
                keys, n = np.unique(keys, return_counts=True)
                yield pa.record_batch({"h": pa.array(keys.view(np.int64), pa.int64()), "n": pa.array(n, pa.int64())})

    return work


def _around(shared, levels: list[int], often, schema_keys: list[str]):
    """Anchors in texts, each with its place and the bytes around it that a phrase with this anchor can cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, salts = often.value
        for batch in batches:
            for size, place, keys, row, data, offsets, first in _known_windows(shared.value, levels, batch):
                if not len(place):
                    continue
                raw = data.tobytes()
                for cut in range(0, len(place), PLACES):
                    at, key, of = place[cut : cut + PLACES], keys[cut : cut + PLACES], row[cut : cut + PLACES]
                    low, high = np.maximum(at - size + 1, offsets[of]), np.minimum(at + 2 * size, offsets[of + 1])
                    many = np.ones(len(key), np.int64)
                    if len(hot):
                        near = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                        many = np.where(hot[near] == key, salts[near], 1)
                    # The keys alone: each anchor would else carry a copy of its text.
                    taken = batch.select(schema_keys).take(pa.array(first + of, pa.int64()))
                    columns = {c: taken.column(c) for c in schema_keys}
                    yield pa.record_batch(columns | {
                        "h": pa.array(key.view(np.int64), pa.int64()), "salt": pa.array((at % many).astype(np.int32), pa.int32()),
                        "place": pa.array(at - offsets[of], pa.int64()), "before": pa.array(at - low, pa.int32()),
                        "bytes": pa.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary()),
                    })

    return work


def _joined(texts: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, _scope, _form and ``hits`` for each text and phrase of a table of any size. texts: keys, _scope, _form."""
    context = texts.sparkSession.sparkContext
    offers = cut_lineage(listed.mapInArrow(_offers, "_scope long, _form string, size int, h long, at int").distinct())
    levels = sorted(r["size"] for r in offers.select("size").distinct().collect())  # powers of two: at most 31
    if not levels:
        return texts.select(*keys, "_scope", "_form", F.lit(0).cast("long").alias("hits")).limit(0)
    counts = texts.select("_scope", "_form").mapInArrow(_count(context.broadcast(_bitmap(offers.select("h").distinct())), levels), "h long, n long")
    counts = cut_lineage(counts.groupBy("h").agg(F.sum("n").alias("n")))
    held = offers.join(counts, "h", "left")
    chosen = held.groupBy("_scope", "_form").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by(F.struct("h", "at", "size", "n"), F.struct("n", "h", "at")).alias("a")
    )
    chosen = cut_lineage(chosen.filter("least > 0").select("_scope", "_form", "a.*"))
    # Of the anchors that occur most, at most MOST_OFTEN rows.
    hot = chosen.filter(F.col("n") > OFTEN).select("h", "n").distinct().orderBy(F.desc("n"), "h").limit(MOST_OFTEN).collect()
    hot = sorted((np.int64(r["h"]).view(np.uint64), -(-r["n"] // OFTEN)) for r in hot)
    often = context.broadcast((np.array([h for h, _ in hot], np.uint64), np.array([s for _, s in hot], np.int64)))
    salted = texts.sparkSession.createDataFrame([(int(h.view(np.int64)), int(s)) for h, s in hot], "h long, salts int")
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    wanted = chosen.join(F.broadcast(salted), "h", "left").select("_scope", "_form", "h", "at", salts)
    names = [f"_k{i}" for i in range(len(keys))]
    source = texts.select(*(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)), "_scope", "_form")
    kinds = ", ".join(f"{n} {texts.schema[c].dataType.simpleString()}" for c, n in zip(keys, names, strict=True))
    bits = context.broadcast(_bitmap(chosen.select("h").distinct()))
    schema = f"{kinds}, _scope long, h long, salt int, place long, before int, bytes binary"
    found = source.mapInArrow(_around(bits, sorted({r["size"] for r in chosen.select("size").distinct().collect()}), often, [*names, "_scope"]), schema)
    met = found.join(wanted, ["_scope", "h", "salt"])
    start = F.col("before") - F.col("at")
    same = F.substring(F.col("bytes"), start + 1, F.octet_length("_form")) == F.col("_form").cast("binary")
    met = met.filter((start >= 0) & same).select(*names, "_scope", "_form", (F.col("place") - F.col("at")).alias("start"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("end"))
    size = F.octet_length("_form")
    # Occurrences that don't overlap, from the left.
    hits = F.aggregate(
        F.array_sort(F.collect_set("start")), zero,
        lambda a, s: F.when(s >= a["end"], F.struct((a["n"] + 1).alias("n"), (s + F.col("_size")).alias("end"))).otherwise(a), lambda a: a["n"],
    )
    met = met.withColumn("_size", size).groupBy(*names, "_scope", "_form", "_size").agg(hits.alias("hits"))
    return met.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "_scope", "_form", "hits")


def find_phrases(
    texts: DataFrame,
    phrases: DataFrame,
    *,
    text_id: str = "doc_id",
    text: str = "text",
    phrase_id: str = "phrase_id",
    phrase: str = "phrase",
    by: Sequence[str] = (),
    ignore_case: bool = False,
    in_rows: int = IN_ROWS,
) -> DataFrame:
    """All pairs where the text contains the phrase, plus how often it occurs (``hits``)."""
    by = list(by)
    listed = _listed(phrases, by, phrase, ignore_case, False, True)
    prepared = texts.select(*by, text_id, _scope(by).alias("_scope"), _form(text, ignore_case).alias("_form"))
    if _size(listed) <= in_rows:
        rows, shared = _matcher(listed, by)
        index = texts.sparkSession.createDataFrame([(i, s, f) for i, (s, f) in enumerate(rows)], "_i int, _scope long, _form string")
        if not rows:
            pairs = prepared.limit(0).withColumn("hits", F.lit(0).cast("long"))
        else:
            found = prepared.select(*by, text_id, F.explode(_hits(shared)(F.col("_form"), F.col("_scope"))).alias("_h"))
            pairs = found.select(*by, text_id, F.col("_h.i").alias("_i"), F.col("_h.n").alias("hits")).join(F.broadcast(index), "_i")
    else:
        pairs = _joined(prepared, listed, [*by, text_id])
    known = phrases.select(*by, phrase_id, _form(phrase, ignore_case).alias("_form")).filter(F.col("_form") != "")
    return pairs.select(*by, text_id, "_form", "hits").join(known, [*by, "_form"]).select(*by, text_id, phrase_id, "hits")


def redact_phrases(
    texts: DataFrame,
    phrases: DataFrame,
    *,
    text_id: str = "doc_id",
    text: str = "text",
    phrase: str = "phrase",
    by: Sequence[str] = (),
    token: str = REDACTED,
    out: str = "redacted",
    short_list: int = SHORT_LIST,
    in_rows: int = IN_ROWS,
    **rules,
) -> DataFrame:
    """`redact` with the known phrases taken from a table, for instance one list per package.

    The length of the list decides how, and never what. A row's alternation holds only the phrases that occur in it, so
    its cost doesn't grow with the table.
    """
    by = list(by)
    flex, unicode = rules.get("flex_space", False), rules.get("unicode", True)
    own = phrases.select(*by, F.col(phrase)).filter(F.col(phrase) != "").distinct()
    longest = own.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if longest <= short_list and not by:
        return texts.withColumn(out, redact(F.col(text), [r[phrase] for r in own.collect()], token=token, **rules))
    if longest <= short_list:
        lists = own.groupBy(*by).agg(phrase_array_pattern(F.collect_list(phrase), flex, unicode).alias("_pattern"))
        joined = texts.join(lists, by, "left")
        return joined.withColumn(out, redact(F.col(text), F.col("_pattern"), token=token, **rules)).drop("_pattern")
    listed = _listed(own, by, phrase, True, flex, unicode)
    form = _form(phrase, True, flex, unicode)
    spelt = own.select(*by, phrase, _scope(by).alias("_scope"), (F.trim(form) if flex else form).alias("_form"))
    if _size(listed) <= in_rows:
        rows, shared = _matcher(listed, by)
        known: dict[tuple[int, str], list[str]] = {}
        for r in spelt.collect():
            known.setdefault((r["_scope"], r["_form"]), []).append(r[phrase])
        originals = texts.sparkSession.sparkContext.broadcast([sorted(known[r]) for r in rows])
        if not rows:
            return texts.withColumn(out, redact(F.col(text), token=token, **rules))
        names = _names(shared, originals)(_form(text, True, flex, unicode), _scope(by))
        found = texts.withColumn("_found", names)
        found = found.withColumn("_pattern", phrase_array_pattern(F.col("_found"), flex, unicode))
        return found.withColumn(out, redact(F.col(text), F.col("_pattern"), token=token, **rules)).drop("_found", "_pattern")
    prepared = texts.select(*by, text_id, _scope(by).alias("_scope"), _form(text, True, flex, unicode).alias("_form"))
    pairs = _joined(prepared, listed, [*by, text_id]).join(spelt.select("_scope", "_form", phrase), ["_scope", "_form"])
    per_text = pairs.groupBy(*by, text_id).agg(phrase_array_pattern(F.collect_set(phrase), flex, unicode).alias("_pattern"))
    joined = texts.join(per_text, [*by, text_id], "left")
    return joined.withColumn(out, redact(F.col(text), F.col("_pattern"), token=token, **rules)).drop("_pattern")
