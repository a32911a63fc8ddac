"""Exact removal of repeated byte strings, by suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a document of smaller id, or before
it in the same one.

1. Each string is given a key by its own bytes alone, the least of its K-grams in a rare-first order. Neighbouring strings
   of equal key make a run, and runs are dealt to shards by key, so equal strings meet. Frequent K-grams (counted over
   all texts in a sketch of fixed size) are last in the order: a passage that many texts share is a key only for runs that
   lie in it and are alike, which are reduced to one before the shuffle; where it joins other text, a rarer key is found.
2. Equal runs are reduced to their first; the later ones are removed as a whole.
3. The shard's distinct runs that share a key, and bytes beside its K-gram, go into suffix arrays of bounded size: prefix doubling on the groups that
   are not yet told apart (Larsson and Sadakane), common prefixes after Kasai, in lanes. Neighbours with LENGTH bytes in
   common are one class; all but its first occurrence are removed.
4. If the runs of one key fill more than one suffix array, their classes are merged by binary search in the sorted
   strings of the arrays before.
5. The removed ranges meet the texts again, and are cut out.

Null and empty texts, and those shorter than LENGTH, lose nothing. Rows of equal id are ordered by the hash of their text;
rows of equal id and equal text are one document, and each gets its result. A null id comes before all others. Empty
tables give empty results. Other columns of ``docs`` are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm import arrays
from caseloom.llm.ngram_join import NO_ID

LENGTH = 100
K = 16
WIDTH = LENGTH - K + 1  # K-grams of a string
COUNTERS = 1 << 20
SLICES = 16
SHARD_BYTES = 8 << 20


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, hash of the K bytes from each place)."""
    sums = arrays.prefix_sums(data)
    at = np.arange(max(0, len(data) - K + 1))
    return sums, arrays.range_hashes(sums, at, at + K)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, size = np.zeros(COUNTERS, np.int64), 0
    for _, data, offsets in arrays.blocks(batches, 1 << 20):
        _, hashes = gram_hashes(data)
        counts += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        size += len(data)
    packed = [zstandard.compress(x.astype(np.uint32).tobytes(), 1) for x in np.split(counts, SLICES)]
    sizes = [size] + [0] * (SLICES - 1)
    yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "size": pa.array(sizes, pa.int64()), "counts": pa.array(packed, pa.binary())})


def _sum(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, place, size = np.zeros(COUNTERS // SLICES, np.int64), 0, 0
    for frame in frames:
        place = int(frame["slice"].iloc[0])
        size += int(frame["size"].sum())
        for x in frame["counts"]:
            total += np.frombuffer(zstandard.decompress(x), np.uint32)
    yield pd.DataFrame({"slice": [place], "size": [size], "counts": [total.tobytes()]})


def frequency_ranks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(rank of each counter, total bytes). A counter holds many K-grams: it ranks above 0 if it exceeds twice the mean
    of all counters, by one for each doubling."""
    rows = docs.select("text").mapInArrow(_count, "slice int, size long, counts binary").groupBy("slice").applyInPandas(_sum, "slice int, size long, counts binary")
    rows = sorted(rows.collect(), key=lambda r: r["slice"])  # SLICES rows of fixed size
    total = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows]) if rows else np.zeros(COUNTERS, np.int64)
    mean = max(total.mean(), 8)
    return np.floor(np.log2(np.maximum(total / mean, 1))).clip(0, 31).astype(np.uint8), sum(r["size"] for r in rows)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of x[i : i + width] for each i."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, ranks: np.ndarray):
    """(document, start, end, key, content hash, self-repeating, offset of the key's K-gram) of each run; the end is that
    of its last string."""
    sums, hashes = gram_hashes(data)
    order = ranks[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58) | hashes >> np.uint64(6)
    least = sliding_least(order, WIDTH)
    whole = np.zeros(len(least) + 1, np.int64)
    first, last = offsets[:-1], offsets[1:] - LENGTH + 1  # starts of strings in each text: first <= i < last
    some = last > first
    np.add.at(whole, first[some], 1)
    np.add.at(whole, last[some], -1)
    at = np.flatnonzero(np.cumsum(whole)[:-1] > 0)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool), np.zeros(0, np.int64))
    document = np.searchsorted(offsets, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (document[1:] != document[:-1]) | (least[at[1:]] != least[at[:-1]])
    begin = np.flatnonzero(new)
    start, stop = at[begin], at[np.append(begin[1:], len(at)) - 1]
    key = least[start]
    # A run repeats itself only if its key's K-gram is in it twice: the first one lies in its first string, the last one in its last.
    places = np.arange(WIDTH)
    twice, offset = np.zeros(len(start), bool), np.zeros(len(start), np.int64)
    for i in range(0, len(start), 20_000):
        own = slice(i, i + 20_000)
        left = start[own] + np.argmax(order[start[own][:, None] + places] == key[own][:, None], axis=1)
        right = stop[own] + WIDTH - 1 - np.argmax(order[stop[own][:, None] + places[::-1]] == key[own][:, None], axis=1)
        twice[own] = left != right
        offset[own] = left - start[own]
    return document[begin], start, stop + LENGTH, key, arrays.range_hashes(sums, start, stop + LENGTH), twice, offset


FIELDS = [("key", np.uint32), ("doc", np.int64), ("t", np.int64), ("start", np.int32), ("size", np.int32), ("twice", bool), ("at", np.uint8)]
SHORT = (1 << 32) - 1  # a key's low bits tell it from others in its bucket, but for some that meet without harm


def _pack(packer, columns: dict[str, np.ndarray], data: np.ndarray, removed: np.ndarray) -> bytes:
    head = np.array([len(columns["key"]), len(data), len(removed)], np.int64)
    columns = columns | {"doc": np.diff(columns["doc"], prepend=np.int64(0))}  # in order of the input: small steps
    return packer.compress(b"".join([head.tobytes(), *(columns[n].astype(k).tobytes() for n, k in FIELDS), data.tobytes(), removed.astype(np.int64).tobytes()]))


def _unpack(packed: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    raw = zstandard.decompress(packed)
    n, size, more = np.frombuffer(raw, np.int64, 3).tolist()
    at, out = 24, {}
    for name, kind in FIELDS:
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * np.dtype(kind).itemsize
    out["doc"] = np.cumsum(out["doc"])
    return out, np.frombuffer(raw, np.uint8, size, at), np.frombuffer(raw, np.int64, more * 4, at + size).reshape(-1, 4)


HALF = (LENGTH - K) // 2


def content_hashes(data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, at: np.ndarray, step: int = 20_000) -> tuple[np.ndarray, ...]:
    """Hashes of each run's bytes, and of the HALF bytes before and after its key's K-gram (0: fewer are there). Runs stand
    one after the other."""
    out = [(np.zeros(0, np.uint64),) * 3]
    for i in range(0, len(begin), step):
        own, size = begin[i : i + step], sizes[i : i + step]
        sums = arrays.prefix_sums(data[own[0] : own[-1] + size[-1]])
        start = own - own[0]
        gram, stop = start + at[i : i + step], start + size
        sides = []
        for low, high, there in ((gram - HALF, gram, gram - HALF >= start), (gram + K, gram + K + HALF, gram + K + HALF <= stop)):
            sides.append(np.where(there, arrays.range_hashes(sums, np.where(there, low, 0), np.where(there, high, 0)), np.uint64(0)))
        out.append((arrays.range_hashes(sums, start, stop), *sides))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def sharing(columns: dict[str, np.ndarray], own: np.ndarray) -> np.ndarray:
    """Which of the runs may have a string in common with another of their key. A string holds the key's K-gram, so it has
    HALF bytes at least before or after it, and two runs with a string in common agree there. Keys with a run that has
    the K-gram twice are kept whole."""
    key = columns["key"][own].astype(np.uint64)
    keep = np.isin(key, key[columns["twice"][own]])
    for side in ("before", "after"):
        both = arrays.mix(columns[side][own] + key * np.uint64(arrays.BASE))
        _, which, count = np.unique(both, return_inverse=True, return_counts=True)
        keep |= (count[which] > 1) & (columns[side][own] != 0)
    return own[keep]


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are equal."""
    out = np.ones(len(a), bool)
    total = np.cumsum(sizes)
    cuts = np.searchsorted(total, np.arange(step, total[-1] if len(total) else 0, step), "right")
    for part in np.split(np.arange(len(a)), np.unique(cuts)):
        if len(part):
            n = sizes[part]
            other = arrays.gathered(data, a[part], a[part] + n) != arrays.gathered(data, b[part], b[part] + n)
            out[part] = ~np.logical_or.reduceat(other, np.cumsum(n) - n)
    return out


def firsts(columns: dict[str, np.ndarray], data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first run of each content, places of the later ones). A place that comes twice is one. Equal hashes
    only propose: bytes are compared, and a run that differs from the one before it goes on to the suffix arrays."""
    order = np.lexsort((columns["start"], columns["t"], columns["doc"], columns["size"], columns["content"], columns["key"]))
    same = np.ones(len(order), bool)
    for name in ("key", "content", "size"):
        same[1:] &= columns[name][order[1:]] == columns[name][order[:-1]]
    if len(order):
        same[0] = False
    some = np.flatnonzero(same)
    same[some] = equal_bytes(data, begin[order[some]], begin[order[some - 1]], columns["size"][order[some]].astype(np.int64))
    place = same.copy()
    for name in ("doc", "t", "start"):
        place[1:] &= columns[name][order[1:]] == columns[name][order[:-1]]
    return order[~same], order[same & ~place]


def joined_ranges(rows: np.ndarray) -> np.ndarray:
    """(doc, t, start, end) rows, sorted, with overlapping and touching ranges of a document made one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    document = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])
    # Ends grow along a document if each is at least those before it.
    group = np.cumsum(document)
    shift = group * (int(rows[:, 3].max()) + 1)
    reach = np.maximum.accumulate(rows[:, 3] + shift) - shift
    new = document.copy()
    new[1:] |= rows[1:, 2] > reach[:-1]
    first = np.flatnonzero(new)
    out = rows[first].copy()
    out[:, 3] = reach[np.append(first[1:], len(rows)) - 1]
    return out


def _ranges(columns: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    start = columns["start"][at].astype(np.int64)
    return np.stack([columns["doc"][at], columns["t"][at], start, start + columns["size"][at]], axis=1).astype(np.int64)


def _deal(ranks, buckets: int, flush_bytes: int = 16 << 20):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, packer = ranks.value, zstandard.ZstdCompressor(level=3)
        held: list[tuple[dict, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = {n: np.concatenate([h[0][n] for h in held]) for n in held[0][0]}
            data = np.concatenate([h[1] for h in held])
            begin = np.cumsum(columns["size"], dtype=np.int64) - columns["size"]
            own, later = firsts(columns, data, begin)
            own = np.sort(own)
            bucket = (arrays.mix(columns["key"][own]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            found, at = np.unique(bucket[by], return_index=True)
            removed = joined_ranges(_ranges(columns, later))
            rows = []
            for i, part in enumerate(np.split(own[by], at[1:])):
                sizes = columns["size"][part].astype(np.int64)
                # Ranges known already travel with any shard.
                more = removed[i :: len(found)]
                short = {"key": columns["key"][part] & np.uint64(SHORT)}
                rows.append(_pack(packer, {n: columns[n][part] for n, _ in FIELDS} | short, arrays.gathered(data, begin[part], begin[part] + sizes), more))
            return pa.record_batch({"bucket": pa.array(found, pa.int64()), "packed": pa.array(rows, pa.binary())})

        for batch, data, offsets in arrays.blocks(batches, 1 << 20):
            document, start, end, key, content, twice, at = runs_of(data, offsets, table)
            if len(document):
                doc, t = (np.array(batch.column(c).to_pylist(), np.int64)[document] for c in ("key", "t"))
                columns = {"key": key, "content": content, "doc": doc, "t": t, "start": start - offsets[document], "size": end - start, "twice": twice, "at": at}
                held.append((columns, arrays.gathered(data, start, end)))
                size += len(data)
            if size >= flush_bytes:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return work


def suffix_array(data: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes by their first ``depth`` bytes at least."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's rank is its first place
    h = 8
    while h < depth:
        # Places whose group has more than one suffix: only these are sorted again, by the rank h bytes on.
        alone = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            break
        suffix = order[open_]
        ahead = suffix + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[suffix].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        by = np.argsort(pair, kind="stable")
        order[open_] = suffix[by]
        pair = pair[by]
        changed = np.ones(len(pair), bool)
        changed[1:] = pair[1:] != pair[:-1]
        new[open_] |= changed
        starts = np.flatnonzero(new)
        rank[order] = starts[np.cumsum(new) - 1]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, cap: int = LENGTH, lane: int = 512) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in order, at most ``cap``. Kasai's walk, with all lanes
    of the text stepping together. Two suffixes that the order doesn't tell apart (beyond its depth they may differ either
    way) say nothing of the next two: there the count starts anew."""
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    tied = np.zeros(n, bool)
    tied[1:] = rank[order[1:]] == rank[order[:-1]]
    padded = np.concatenate([data, np.zeros(cap + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = np.zeros(n, np.int32)
    starts = np.arange(0, n, lane)
    h = np.zeros(len(starts), np.int64)
    for step in range(min(lane, n)):
        i = starts + step
        inside = i < n
        i, h = i[inside], h[inside]
        starts = starts[inside]
        at = place[i]
        j = order[np.maximum(at - 1, 0)]
        active = np.flatnonzero(at > 0)
        h[at == 0] = 0
        while len(active):
            a, b = i[active] + h[active], j[active] + h[active]
            differ = words[a] != words[b]
            equal = np.where(differ.any(1), differ.argmax(1), 8)
            room = n - np.maximum(i[active], j[active]) - h[active]
            h[active] += np.minimum(equal, room)
            active = active[(equal == 8) & (room > 8) & (h[active] < cap)]
        np.minimum(h, cap, out=h)
        out[at] = h
        h = np.where(tied[at], 0, np.maximum(h - 1, 0))
    return out


def repeated_strings(data: np.ndarray, begin: np.ndarray, columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of a shard's runs: (run, offset in it, is it later than another of its class), in suffix order."""
    order, rank = suffix_array(data)
    common = common_prefixes(data, order, rank)
    group = np.cumsum(common < LENGTH)
    run = np.searchsorted(begin, order, "right") - 1
    offset = order - begin[run]
    valid = offset + LENGTH <= columns["size"][run]
    run, offset, group = run[valid], offset[valid], group[valid]
    by = np.lexsort((columns["start"][run] + offset, columns["t"][run], columns["doc"][run], group))
    run, offset, group = run[by], offset[by], group[by]
    later = np.zeros(len(run), bool)
    later[1:] = group[1:] == group[:-1]
    # Two runs may hold the same place of a document: that is one occurrence.
    return run, offset, later


def _dedup_shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [_unpack(p) for frame in frames for p in frame["packed"]]
    keys = np.concatenate([p[0]["key"] for p in parts])
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    # A key that one run alone has, and that once, can't repeat anything.
    wanted = np.split((count[which] > 1) | np.concatenate([p[0]["twice"] for p in parts]), np.cumsum([len(p[0]["key"]) for p in parts])[:-1])
    texts, columns = [], []
    for (own, data, _), use in zip(parts, wanted, strict=True):
        stop = np.cumsum(own["size"], dtype=np.int64)[use]
        texts.append(arrays.gathered(data, stop - own["size"][use], stop))
        columns.append({n: x[use] for n, x in own.items()})
    removed = [p[2] for p in parts]
    del parts
    columns = {n: np.concatenate([c[n] for c in columns]) for n, _ in FIELDS}
    data = np.concatenate(texts)
    del texts
    begin = np.cumsum(columns["size"], dtype=np.int64) - columns["size"]
    columns |= dict(zip(("content", "before", "after"), content_hashes(data, begin, columns["size"].astype(np.int64), columns["at"].astype(np.int64)), strict=True))
    own, later = firsts(columns, data, begin)  # in order of the key
    removed.append(_ranges(columns, later))
    own = sharing(columns, own)
    sizes = columns["size"][own].astype(np.int64)
    # Shards of bounded size; a key that a shard ends in may go on in the next.
    shard = (np.cumsum(sizes) - sizes) // SHARD_BYTES
    seen_key, seen, seen_at = None, np.zeros(0, f"S{LENGTH + 1}"), np.zeros((0, 3), np.int64)
    for part in np.split(own, np.flatnonzero(np.diff(shard)) + 1) if len(own) else []:
        sizes = columns["size"][part].astype(np.int64)
        local = {n: columns[n][part] for n, _ in FIELDS}
        text = arrays.gathered(data, begin[part], begin[part] + sizes)
        start = np.cumsum(sizes) - sizes
        run, offset, is_later = repeated_strings(text, start, local)

        def ranges(run, offset, local=local):
            at = local["start"][run].astype(np.int64) + offset
            return np.stack([local["doc"][run], local["t"][run], at, at + LENGTH], axis=1)

        removed.append(joined_ranges(ranges(run[is_later], offset[is_later])))
        # The first of each class, for the key that goes over the border to the shard before or after.
        run, offset = run[~is_later], offset[~is_later]
        edge = (local["key"][run] == local["key"][0]) if seen_key == local["key"][0] else np.zeros(len(run), bool)
        if edge.any() and len(seen):
            found, at, late, early = _merge(text, start, local, run[edge], offset[edge], seen, seen_at)
            removed += [late, early]
            seen, seen_at = found, at
        last = local["key"][-1]
        if seen_key != last or not edge.any():
            mine = local["key"][run] == last
            seen, seen_at = _strings(text, start, local, run[mine], offset[mine])
            seen_key = last
    rows = joined_ranges(np.concatenate(removed))
    yield pd.DataFrame(rows, columns=["key", "t", "start", "end"])


def _strings(text, start, local, run, offset):
    """Sorted strings with (doc, t, place). A last byte of 1 keeps zero bytes at the end of a string."""
    at = start[run] + offset
    raw = np.ones((len(at), LENGTH + 1), np.uint8)
    if len(at):
        raw[:, :LENGTH] = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[at]
    strings = np.ascontiguousarray(raw).view(f"S{LENGTH + 1}").ravel()
    by = np.argsort(strings, kind="stable")
    place = np.stack([local["doc"][run], local["t"][run], local["start"][run].astype(np.int64) + offset], axis=1)
    return strings[by], place[by]


def _merge(text, start, local, run, offset, seen, seen_at):
    """Binary search of a shard's strings among those of the shards before: (all strings, places of their firsts, ranges
    of this shard that are later, ranges of those before that turn out later)."""
    strings, place = _strings(text, start, local, run, offset)
    at = np.searchsorted(seen, strings)
    known = np.zeros(len(strings), bool)
    inside = at < len(seen)
    known[inside] = seen[at[inside]] == strings[inside]
    old, new = seen_at[at[known]], place[known]
    before = np.zeros(len(new), bool)  # the new one comes first
    tie = np.ones(len(new), bool)
    for c in range(3):
        before |= tie & (new[:, c] < old[:, c])
        tie &= new[:, c] == old[:, c]
    late, early = new[~before & ~tie], old[before]
    seen_at = seen_at.copy()
    seen_at[at[known][before]] = new[before]
    fresh = ~known
    to = at[fresh]
    widen = lambda x: np.concatenate([x, x[:, 2:] + LENGTH], axis=1)
    return np.insert(seen, to, strings[fresh]), np.insert(seen_at, to, place[fresh], axis=0), widen(late), widen(early)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch, data, offsets in arrays.blocks(batches):
        text = data.tobytes()
        packed = [packer.compress(text[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.record_batch({"key": batch.column("key"), "t": batch.column("t"), "packed": pa.array(packed, pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for packed, starts, ends in zip(*(batch.column(c) for c in ("packed", "starts", "ends")), strict=True):
            text = zstandard.decompress(packed.as_py())
            kept, done, gone, spans, open_ = [], 0, 0, [], None
            for a, b in sorted(zip(starts.as_py() or [], ends.as_py() or [], strict=True)):
                if open_ and a <= open_[1]:
                    open_[1] = max(open_[1], b)
                else:
                    open_ = [a, b]
                    spans.append(open_)
            for a, b in spans:
                kept.append(text[done:a])
                done, gone = b, gone + b - a
            kept.append(text[done:])
            rows.append((len(text), gone, [x for s in spans for x in s], b"".join(kept)))
        names = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=names)


def remove_repeats(docs: DataFrame, shard_bytes: int = 24 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, ``spans`` (start and end of each maximal removed run, one after the other) and
    ``kept`` (the remaining bytes) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("t"), "text")
    ranks, total = frequency_ranks(docs)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * total // shard_bytes)
    packed = docs.mapInArrow(_deal(spark.sparkContext.broadcast(ranks), buckets), "bucket long, packed binary")
    ranges = packed.groupBy("bucket").applyInPandas(_dedup_shard, "key long, t long, start long, end long")
    by_text = ranges.groupBy("key", "t").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    texts = docs.mapInArrow(_packed_texts, "key long, t long, packed binary")
    both = texts.join(by_text, ["key", "t"], "left").select("key", "packed", "starts", "ends")
    cut = both.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<long>, kept binary")
    return cut.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
