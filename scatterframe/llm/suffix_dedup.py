"""Removal of repeated byte strings, by a logarithmic family of suffix arrays.

A byte is removed if a string of ``least`` bytes that covers it starts anywhere
else in the corpus too, in the same document or another.

1. *Slices.*  Every string of ``least`` bytes has an anchor: among its runs of
   ``GRAM`` bytes, the one of least hash, the leftmost of equals.  Texts are hashed in
   pieces that overlap by ``least - 1`` bytes, so a long text takes no more memory.  Equal strings
   have equal anchors, so only strings whose anchor occurs again can repeat.  The
   stretch of consecutive starts that one anchor serves is cut out as a slice,
   and slices are dealt to tasks by anchor.  An anchor whose strings pass a counted
   bound (``CROWD``) has its strings' fingerprints dealt instead, by their value:
   equal strings still meet, and no task holds more than its share of them.
   Strings that repeat within a group of documents are marked there and sent once.
2. *Suffix arrays.*  A task reads its slices batch by batch; a slice that it has
   already, byte for byte, only adds its places to the first one's.  The suffixes of a
   batch are sorted by their first ``least`` bytes, since only matches of that length
   count: by eight bytes at first, then by doubled prefixes, where ties are left.
   The batch's array is merge-scanned against the array of every level: a suffix is
   placed by comparing bytes, eight at a time, beyond those that both neighbours
   are known to share.  Suffixes equal in all ``least`` bytes are marked on both
   sides; the others become a level.  Levels of like size are merged, so that a
   task that has read n suffixes holds log n arrays at most.  There are as many
   tasks as the counted strings need at ``SHARE`` a task.  Only the fingerprints
   of crowded anchors (1) have no bytes to compare: their levels are sorted
   fingerprints, and equality rests on 64 bits there.
3. *Removal.*  Marked starts become byte ranges of their documents, which are cut
   out in one last pass over the texts.

Texts meet their slices and ranges by shuffle joins at every size, since both grow
with the corpus.

Defined results: a null text is an empty one.  Texts are judged whole and as
given, matches never cross documents, and occurrences may overlap.  Repeated
rows are separate occurrences, so their long texts vanish as a whole.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, sized, table, tasks
from .shingles import mix

LEAST = 400
GRAM = 51
#: Bytes of texts that are hashed together, and bytes of slices (fingerprints of crowded anchors) in a new array, about.
PIECE = 1 << 20
BATCH = 1 << 21
#: Strings of one anchor that meet in one task, and strings of a task, at most about; a slice counts as ``SLICE`` strings besides its own.
CROWD = 1 << 22
SHARE = 1 << 22
SLICE = 16
#: Low bits of a gram's hash that give way to its place; the same for all texts, so that equal strings have equal anchors.
PLACE_BITS = 24
#: Words of eight bytes that are compared one by one before prefixes are doubled.
FEW = 4

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Powers:
    """Powers of the hash base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            ones = np.ones(1, np.uint64)
            self.up = np.concatenate((ones, np.cumprod(np.full(size - 1, _BASE))))
            self.down = np.concatenate((ones, np.cumprod(np.full(size - 1, _BACK))))
        return self.up[:n], self.down[:n]


def window_hashes(data: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers.get(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up, dtype=np.uint64)))
    return mix((sums[width:] - sums[:-width]) * down[: n - width + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(values)
    size = -(-n // width) * width
    grid = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = values
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored(text: np.ndarray, lengths: np.ndarray, least: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, first start, last start) of every stretch of starts with one anchor.

    ``text`` holds the documents one after another, less than 2^``PLACE_BITS`` bytes in all; starts
    count from each document's own first byte.
    """
    none = np.empty(0, np.int64)
    if len(text) < least:
        return none, none.astype(np.uint64), none, none
    grams = window_hashes(text, gram, powers)
    if len(grams) >> PLACE_BITS:
        raise ValueError("too many bytes are hashed together")
    bits = np.uint64(PLACE_BITS)
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(ranked, least - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    start = np.arange(len(anchor))
    good = start + least <= ends[doc]
    anchor, doc, start = anchor[good], doc[good], start[good]
    if not len(start):
        return none, none.astype(np.uint64), none, none
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    base = (ends - lengths)[doc[first]]
    return doc[first], grams[anchor[first]], start[first] - base, start[last] - base


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as they lie in memory."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at]


def _named(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Names of the parts that keys cut groups into, both in order: a group's number and the places before the part in it."""
    start = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
    new = start | np.concatenate(([True], key[1:] != key[:-1]))[: len(group)]
    at = np.arange(len(group))
    return group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(start, at, 0))


def _tied(named: np.ndarray) -> np.ndarray:
    same = named[1:] == named[:-1]
    return np.concatenate(([False], same))[: len(named)] | np.append(same, False)[: len(named)]


def prefix_ranks(data: np.ndarray, room: np.ndarray, least: int) -> np.ndarray:
    """A rank for every place with ``least`` bytes of room, by those bytes: prefixes are doubled where ties are left."""
    width = 8
    at = np.flatnonzero(room >= width)
    group, key = np.zeros(len(at), np.int64), words_at(data, at).byteswap()
    rank = np.zeros(len(data), np.int64)
    while True:
        order = np.argsort(key if width == 8 else group * len(data) + key)
        at = at[order]
        named = _named(group[order], key[order])
        rank[at] = named
        if width >= least:
            return rank
        step = min(width, least - width)
        width += step
        at = at[_tied(named)]
        at = at[room[at] >= width]
        group, key = rank[at], rank[at + step]


def suffix_array(data: np.ndarray, room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with at least ``least`` bytes of ``room``, in the order of those bytes, and which equal the one before.

    ``room`` is the number of bytes from each place to the end of its own string.  Most
    places differ within ``FEW`` words; only strings with others go through prefix doubling.
    """
    places = np.flatnonzero(room >= least)
    rank = np.zeros(len(data), np.int64)
    at, group = places, np.zeros(len(places), np.int64)
    for step in range(0, min(FEW * 8, least - 7), 8):
        key = words_at(data, at + step).byteswap()
        order = np.lexsort((key, group)) if step else np.argsort(key)
        at = at[order]
        named = _named(group[order], key[order])
        rank[at] = named
        tied = _tied(named)
        at, group = at[tied], named[tied]
    if len(at):
        begin = np.flatnonzero(np.concatenate(([True], room[1:] != room[:-1] - 1)))
        string = np.repeat(np.arange(len(begin)), room[begin])
        used = np.zeros(len(begin), bool)
        used[string[at]] = True
        inside = used[string]
        moved = np.cumsum(inside) - 1
        key = prefix_ranks(data[inside], room[inside], least)[moved[at]]
        order = np.lexsort((key, group))
        rank[at[order]] = _named(group[order], key[order])
    places = places[np.argsort(rank[places])]
    ranks = rank[places]
    return places, np.concatenate(([False], ranks[1:] == ranks[:-1]))[: len(places)]


class Levels:
    """Suffix arrays of geometrically growing size over the strings read so far; no two of their suffixes are equal."""

    def __init__(self, least: int):
        if least < 8:
            raise ValueError("matches must have at least 8 bytes")
        self.least = least
        #: Where the eight bytes of each comparison begin.
        self.steps = np.minimum(np.arange(0, least, 8), least - 8)
        self.data, self.marked, self.size = np.zeros(8, np.uint8), np.zeros(8, bool), 0
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, strings: list[bytes]) -> None:
        """Take the strings, mark the suffixes that meet others, and keep one of each kind."""
        lengths = np.array([len(s) for s in strings])
        begin, size = self.size, int(lengths.sum())
        self._grow(size)
        self.data[begin : begin + size] = np.frombuffer(b"".join(strings), np.uint8)
        self.size += size
        room = np.repeat(np.cumsum(lengths), lengths) - np.arange(size)
        places, same = suffix_array(self.data[begin : begin + size], room, self.least)
        places += begin
        self.marked[places[same | np.append(same[1:], False)[: len(same)]]] = True
        places = places[~same]
        new = places, words_at(self.data, places).byteswap()
        for old in self.levels:
            at, equal = self.place(old, new)
            self.marked[old[0][at[equal]]] = True
            self.marked[new[0][equal]] = True
            new = new[0][~equal], new[1][~equal]
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            old = self.levels.pop()
            big, few = (old, new) if len(old[0]) >= len(new[0]) else (new, old)
            at, _ = self.place(big, few)
            new = tuple(np.insert(b, at, f) for b, f in zip(big, few))
        if len(new[0]):
            self.levels.append(new)

    def has(self, data: bytes, begin: int, waiting: list[bytes], k: int) -> bool:
        """Whether the string at a place, or the ``k``-th that waits to be added, is ``data``."""
        return waiting[k] == data if k >= 0 else self.data[begin : begin + len(data)].tobytes() == data

    def _grow(self, size: int) -> None:
        need = self.size + size + 8
        if need > len(self.data):
            room = max(need, len(self.data) * 3 // 2) - len(self.data)
            self.data = np.concatenate((self.data, np.zeros(room, np.uint8)))
            self.marked = np.concatenate((self.marked, np.zeros(room, bool)))

    def place(self, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the old array each new suffix belongs, and whether the one there equals it in ``least`` bytes."""
        lo, hi = np.searchsorted(old[1], new[1]), np.searchsorted(old[1], new[1], "right")
        equal = np.zeros(len(lo), bool)
        # words shared with the last smaller and the last greater old suffix: all between share the lesser number
        below, above = np.ones(len(lo), np.int64), np.ones(len(lo), np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            shared, less = self._compare(old[0][mid], new[0][open_], np.minimum(below[open_], above[open_]))
            done = shared == len(self.steps)
            up = less & ~done
            lo[open_[up]], below[open_[up]] = mid[up] + 1, shared[up]
            down = ~up
            hi[open_[down]], above[open_[down]] = mid[down], shared[down]
            lo[open_[done]] = mid[done]
            equal[open_[done]] = True
            open_ = open_[lo[open_] < hi[open_]]
        return lo, equal

    def _compare(self, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that the suffixes share, and whether the first is less; ``known`` words are known to be shared."""
        shared, less = known.copy(), np.zeros(len(a), bool)
        at = np.flatnonzero(shared < len(self.steps))
        while len(at):
            step = self.steps[shared[at]]
            x, y = words_at(self.data, a[at] + step), words_at(self.data, b[at] + step)
            same = x == y
            less[at[~same]] = x[~same].byteswap() < y[~same].byteswap()
            at = at[same]
            shared[at] += 1
            at = at[shared[at] < len(self.steps)]
        return shared, less


class Prints:
    """Sorted fingerprints in levels of geometrically growing size, over numbered strings."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.marked: list[np.ndarray] = []
        self.count = 0

    def add(self, prints: np.ndarray) -> None:
        """Number the strings on, mark those that meet others, and keep one of each kind."""
        ids = np.arange(self.count, self.count + len(prints))
        self.marked.append(np.zeros(len(prints), bool))
        self.count += len(prints)
        order = np.argsort(prints, kind="stable")
        prints, ids = prints[order], ids[order]
        same = prints[1:] == prints[:-1]
        twin = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        self._mark(ids[twin])
        keep = np.concatenate(([True], ~same))[: len(prints)]
        kinds = np.flatnonzero(keep)
        sizes = np.diff(np.append(kinds, len(prints)))
        for old, old_ids in self.levels:
            at = np.minimum(np.searchsorted(old, prints[kinds]), len(old) - 1)
            meets = old[at] == prints[kinds]
            self._mark(old_ids[at[meets]])
            self._mark(ids[np.repeat(meets, sizes)])
        new = prints[kinds], ids[kinds]
        while self.levels and len(self.levels[-1][0]) < 2 * len(new[0]):
            old = self.levels.pop()
            both = np.concatenate((old[0], new[0]))
            order = np.argsort(both, kind="stable")
            both, of = both[order], np.concatenate((old[1], new[1]))[order]
            single = np.concatenate(([True], both[1:] != both[:-1]))
            new = both[single], of[single]
        self.levels.append(new)

    def _mark(self, ids: np.ndarray) -> None:
        if not len(ids):
            return
        edges = np.cumsum([0, *map(len, self.marked)])
        ids = np.sort(ids)
        cut = np.searchsorted(ids, edges)
        for k, part in enumerate(self.marked):
            part[ids[cut[k] : cut[k + 1]] - edges[k]] = True

    def marks(self) -> np.ndarray:
        return np.concatenate(self.marked) if self.marked else np.zeros(0, bool)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last of every run of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _documents(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[list[tuple[str, bytes, pa.Scalar | None]]]:
    """Documents in groups of about ``piece`` bytes."""
    held, size = [], 0
    for batch in batches:
        extra = batch.column(2) if batch.num_columns > 2 else [None] * batch.num_rows
        for key, text, more in zip(batch.column(0), batch.column(1), extra):
            held.append((key.as_py(), text.as_buffer().to_pybytes() if text.is_valid else b"", more))
            size += len(held[-1][1])
            if size >= piece:
                yield held
                held, size = [], 0
    if held:
        yield held


_STRETCHES = "key string, anchors array<long>, firsts array<long>, lasts array<long>"


def _stretches(docs: DataFrame, least: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def found(parts: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
            text = np.frombuffer(b"".join(d for _, _, d in parts), np.uint8)
            doc, anchor, first, last = anchored(text, np.array([len(d) for _, _, d in parts]), least, gram, powers)
            begin = np.array([b for _, b, _ in parts])[doc]
            used, at = np.unique(doc, return_index=True)
            edges = pa.array(np.append(at, len(doc)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.view(np.int64))) for x in (anchor, begin + first, begin + last)]
            return pa.record_batch([pa.array([parts[d][0] for d in used], pa.string()), *lists], ["key", "anchors", "firsts", "lasts"])

        held, size = [], 0
        for group in _documents(batches, PIECE):
            for key, data, _ in group:
                for begin in range(0, max(len(data) - least + 1, 1), PIECE):
                    held.append((key, begin, data[begin : begin + PIECE + least - 1]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield found(held)
                        held, size = [], 0
        if held:
            yield found(held)

    return docs.mapInArrow(run, _STRETCHES)


_SLICE = "anchor long, refs array<struct<key:string,first:long>>, slice binary"
_REFS = pa.list_(pa.struct([("key", pa.string()), ("first", pa.int64())]))


def _slices(docs: DataFrame, least: int) -> DataFrame:
    """Slices of the documents; equal ones of a group of documents make one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _documents(batches, 8 * PIECE):
            found: dict[tuple[int, bytes], list] = {}
            for key, data, cuts in group:
                for c in cuts.as_py():
                    found.setdefault((c["anchor"], data[c["first"] : c["last"] + least]), []).append((key, c["first"]))
            names = list(found)
            refs = [[{"key": k, "first": f} for k, f in found[n]] for n in names]
            yield pa.record_batch([pa.array([n[0] for n in names], pa.int64()), pa.array(refs, _REFS), pa.array([n[1] for n in names], pa.binary())], ["anchor", "refs", "slice"])

    return docs.mapInArrow(run, _SLICE)


_COVER = "key string, starts array<long>, ends array<long>"


_NAMES = ["key", "starts", "ends"]
_LONGS = pa.list_(pa.int64())


def _ranges(out: dict[str, tuple[list, list]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(out), pa.string()), pa.array([v[0] for v in out.values()], _LONGS), pa.array([v[1] for v in out.values()], _LONGS)], _NAMES)


def _cover(slices: DataFrame, least: int, n_tasks: int) -> DataFrame:
    """Byte ranges of repeated strings, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, refs, sizes, held, waiting = Levels(least), [], [], [], 0
        known: dict[bytes, tuple[int, int]] = {}
        for batch in batches:
            for r, s in zip(batch.column(1), batch.column(2)):
                data, end = s.as_buffer().to_pybytes(), levels.size + waiting
                k, begin = known.setdefault(xxhash.xxh3_128_digest(data), (len(refs), end))
                if k < len(refs) and levels.has(data, begin, held, k - len(refs) + len(held)):
                    refs[k] += r.as_py()
                    continue
                held.append(data)
                refs.append(r.as_py())
                sizes.append(len(data))
                waiting += len(data)
                if waiting >= BATCH:
                    levels.add(held)
                    held, waiting = [], 0
        if held:
            levels.add(held)
        ends = np.cumsum(sizes)
        out: dict[str, tuple[list, list]] = {}
        full = 0
        for r, e, n in zip(refs, ends, sizes):
            start, end = (np.zeros(1, int), np.full(1, n - least + 1)) if len(r) > 1 else runs(levels.marked[e - n : e])
            if len(start):
                for x in r:
                    ranges = out.setdefault(x["key"], ([], []))
                    ranges[0].extend((x["first"] + start).tolist())
                    ranges[1].extend((x["first"] + end + least - 1).tolist())
                full += len(start) * len(r)
            if full >= BATCH:
                yield _ranges(out)
                out, full = {}, 0
        yield _ranges(out)

    return slices.repartition(n_tasks, "anchor").mapInArrow(run, _COVER)


_WINDOWS = "part int, keys array<string>, owners binary, starts binary, ends binary, prints binary"


def _windows(docs: DataFrame, least: int, parts: int) -> DataFrame:
    """The strings of crowded anchors, cut into ``parts`` by fingerprint.

    A row has the fingerprints of a group of documents that fall in one part, each with its
    document (a place in ``keys``; -1 for strings that repeat in the group, which are sent
    once) and start; or, without fingerprints, the ranges of strings that repeat in the group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for group in _documents(batches, 2 * PIECE):
            lengths = np.array([len(d) for _, d, _ in group])
            base = np.cumsum(lengths) - lengths
            names = np.array([k for k, _, _ in group], object)
            cuts = [[x.to_numpy(zero_copy_only=False) for x in c.values.flatten()] for _, _, c in group]
            owner = np.repeat(np.arange(len(group)), [len(c[0]) for c in cuts])
            first, last = np.concatenate([c[1] for c in cuts]), np.concatenate([c[2] for c in cuts])
            n = last - first + 1
            owner = np.repeat(owner, n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            prints = window_hashes(np.frombuffer(b"".join(d for _, d, _ in group), np.uint8), least, powers)[base[owner] + start]
            kinds, of, count = np.unique(prints, return_inverse=True, return_counts=True)
            once = count[of] == 1
            rows = []
            flags = np.zeros(lengths.sum(), bool)
            flags[(base[owner] + start)[~once]] = True
            begin, end = runs(flags)
            if len(begin):
                doc = np.searchsorted(base + lengths, begin, "right")
                used, at = np.unique(doc, return_inverse=True)
                rows.append((zlib.crc32(names[used[0]].encode()) % parts, names[used].tolist(), at.astype(np.int32).tobytes(), (begin - base[doc]).tobytes(), (end - base[doc] + least - 1).tobytes(), None))
            known = kinds[count > 1]
            prints = np.concatenate((prints[once], known))
            owner = np.concatenate((owner[once], np.full(len(known), -1)))
            start = np.concatenate((start[once], np.zeros(len(known), int)))
            part = (prints % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            prints, owner, start, part = prints[order], owner[order], start[order], part[order]
            edges = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))[: len(part)]), len(part))
            for a, b in zip(edges, edges[1:]):
                used, at = np.unique(owner[a:b], return_inverse=True)
                at = at.astype(np.int32)
                if used[0] < 0:
                    used, at = used[1:], at - np.int32(1)
                rows.append((int(part[a]), names[used].tolist(), at.tobytes(), start[a:b].tobytes(), None, prints[a:b].tobytes()))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], ["part", "keys", "owners", "starts", "ends", "prints"])

    return docs.mapInArrow(run, _WINDOWS)


def _met(windows: DataFrame, least: int, parts: int) -> DataFrame:
    """Byte ranges of the strings of ``_windows`` that repeat, by document."""

    def ranges(keys: pa.Array, owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((start, owner))
        owner, start, end = owner[order], start[order], end[order]
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))[: len(owner)])
        edges = pa.array(np.append(at, len(owner)), pa.int32())
        lists = [pa.ListArray.from_arrays(edges, pa.array(x, pa.int64())) for x in (start, end)]
        return pa.record_batch([keys.take(pa.array(owner[at], pa.int32())), *lists], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, rows, held, waiting = Prints(), [], [], 0
        for batch in batches:
            for _, keys, owners, starts, ends, prints in zip(*batch.columns):
                owner, start = np.frombuffer(owners.as_buffer(), np.int32), np.frombuffer(starts.as_buffer(), np.int64)
                if not prints.is_valid:
                    yield ranges(keys.values, owner, start, np.frombuffer(ends.as_buffer(), np.int64))
                    continue
                rows.append((pa.concat_arrays([keys.values]), owner.copy(), start.copy()))
                held.append(np.frombuffer(prints.as_buffer(), np.uint64).copy())
                waiting += len(owner)
                if waiting >= BATCH:
                    levels.add(np.concatenate(held))
                    held, waiting = [], 0
        if held:
            levels.add(np.concatenate(held))
        marks, done = levels.marks(), 0
        for keys, owner, start in rows:
            found = marks[done : done + len(owner)] & (owner >= 0)
            done += len(owner)
            if found.any():
                yield ranges(keys, owner[found], start[found], start[found] + least)

    return windows.repartitionById(parts, "part").mapInArrow(run, _COVER)


def merged(starts: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal ranges of the union."""
    out: list[list[int]] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """``_KEPT`` of every row; ``kept`` holds the remaining bytes if asked for."""
    rows = docs.select(row_key(key, text).alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"), F.col(key).cast("long").alias("doc_id"))
    long = rows.where(F.length("data") >= least).select("key", "data")
    stretches = table(_stretches(long, least, gram), "stretches")
    each = stretches.select("key", F.explode(F.arrays_zip("anchors", "firsts", "lasts")).alias("s"))
    each = each.select("key", F.col("s.anchors").alias("anchor"), F.col("s.firsts").alias("first"), F.col("s.lasts").alias("last"))
    again = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("last") - F.col("first") + 1 + SLICE).alias("w")).where("n > 1")
    again = table(again.select("anchor", "w", (F.col("w") > CROWD).alias("crowd")), "anchors")
    load = dict(again.groupBy("crowd").agg(F.sum("w").alias("w")).collect())
    share = lambda crowd: max(tasks(docs.sparkSession), -(-load.get(crowd, 0) // SHARE))
    cuts = each.join(sized(again.select("anchor", "crowd"), 16), "anchor").groupBy("key").agg(*[
        F.collect_set(F.when(c, F.struct("anchor", "first", "last"))).alias(n) for n, c in (("cuts", ~F.col("crowd")), ("crowds", F.col("crowd")))])
    cuts = table(cuts, "cuts")
    cut_out = lambda of: long.join(cuts.where(F.size(of) > 0).select("key", of), "key").select("key", "data", of)
    covers = _cover(_slices(cut_out("cuts"), least), least, share(False))
    if True in load:
        parts = share(True)
        covers = covers.union(_met(_windows(cut_out("crowds"), least, parts), least, parts))
    ranges = covers.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    ranges = table(ranges, "ranges")
    schema = _KEPT if with_text else _KEPT.rsplit(", ", 1)[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        for batch in batches:
            out = []
            for doc, data, starts, ends in zip(*batch.columns):
                data = data.as_buffer().to_pybytes()
                spans = merged(starts.as_py(), ends.as_py()) if starts.is_valid else []
                kept = b"".join(data[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)])) if spans else data
                out.append((doc.as_py(), len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.record_batch([pa.array(c, t) for c, t, _ in zip(cols, types, names)], names)

    return rows.join(ranges, "key", "left").select("doc_id", "data", "starts", "ends").mapInArrow(cut, schema)
