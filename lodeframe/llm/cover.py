"""Cross-document repeats of at least `length` units, found through a difference cover.

A difference cover D modulo v holds, for every pair of residues, positions that some
one shift below v carries both into D. So if a window of `length` units occurs at any
two places, some anchor of `length - v + 1` units at cover positions lies inside both
copies at the same distance from their starts: hashing only the cover positions loses
no match. Three steps, each over blocks of documents:

1. each block names its anchors; a bucket tells which occur in several blocks or twice
   in one, and which whole documents repeat an earlier block's;
2. shared anchors are extended to every window that holds one; those windows, hashed
   over their full length, are ranked by the first block that has them;
3. each block covers the units of windows that an earlier document has.

Anchors are only a filter, so a clash of their names costs work and changes nothing. What
decides is the name of a full window, a hash of all its units by a mixer that isn't linear,
and of a whole document. Window names have twice as many bits as the number of bytes of the
corpus has (128 at most), so that well under one clash is expected at any size, and
documents' names 128.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from lodeframe.llm import arrays as A
from lodeframe.llm.blocks import Blocks, Texts, by_bucket

#: Perfect difference sets (fixed values): modulus and members.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}


@dataclass(frozen=True)
class Rule:
    """length: units of a window. modulus: of the cover. words: units are words, else bytes."""

    length: int
    modulus: int
    words: bool

    @property
    def anchor(self) -> int:
        return self.length - self.modulus + 1


class Units:
    """A block's units: offsets by document, and what windows of them are hashed from."""

    def __init__(self, texts: Texts, rule: Rule):
        self.texts, self.rule = texts, rule
        if rule.words:
            self.hashes, self.offs = A.word_hashes(texts.buf, texts.offs)
        else:
            self.offs = texts.offs

    def parts(self):
        """(first document, last + 1, values, offsets from 0) of each slice. A value is a
        word's hash, or the eight bytes from a position on."""
        for a, b in A.slices(self.offs):
            at = slice(self.offs[a], self.offs[b])
            yield a, b, self.hashes[at] if self.rule.words else A.eights(self.texts.buf[at]), self.offs[a : b + 1] - self.offs[a]

    def steps(self, length: int) -> list[int]:
        """Where the values lie that make up a window of `length` units."""
        if self.rule.words:
            return list(range(length))
        return sorted({*range(0, length - 7, 8), max(0, length - 8)})

    def whole(self) -> list[bytes]:
        """A 128-bit hash of each whole document."""
        data = self.hashes if self.rule.words else self.texts.buf
        return [xxhash.xxh3_128_digest(data[a:b].tobytes()) for a, b in zip(self.offs[:-1].tolist(), self.offs[1:].tolist(), strict=True)]

    def repeats(self, whole: list[bytes], earlier: set[bytes]) -> np.ndarray:
        """Documents that equal one with a smaller id: of an earlier block, or of this."""
        first: dict[bytes, int] = {}
        ids = self.texts.ids.tolist()  # they ascend
        return np.array([d in earlier or i > first.setdefault(d, i) for d, i in zip(whole, ids, strict=True)], bool)


def anchors_at(offs: np.ndarray, skip: np.ndarray, rule: Rule) -> np.ndarray:
    """Cover positions of a slice at which an anchor fits in its document."""
    sizes = np.diff(offs)
    on = np.zeros(rule.modulus, bool)
    on[list(COVERS[rule.modulus])] = True
    rel = np.arange(offs[-1]) - np.repeat(offs[:-1], sizes)
    room = np.repeat(np.where(skip, 0, sizes - rule.anchor + 1), sizes)
    return np.flatnonzero(on[rel % rule.modulus] & (rel < room))


def units_windows(units: Units, runs: np.ndarray, skip: np.ndarray, width: int) -> tuple[Names, np.ndarray, np.ndarray]:
    """Name (of `width` bits), document id and start of every full window that starts in a
    run (first, end) and fits in a document that isn't skipped."""
    length, steps = units.rule.length, units.steps(units.rule.length)
    high, low, docs, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, values, offs in units.parts():
        base = units.offs[a]
        lo, hi = np.searchsorted(runs[0], [base, units.offs[b]])
        sizes = runs[1, lo:hi] - runs[0, lo:hi]
        start = np.repeat(runs[0, lo:hi] - base - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        doc = np.searchsorted(offs, start, "right") - 1
        fits = (start + length <= offs[doc + 1]) & ~skip[a:b][doc]
        high.append(A.window_hashes(values, steps, start[fits]) >> np.uint64(max(0, 64 - width)))
        if width > 64:
            low.append(A.window_hashes(values, steps, start[fits], seed=1) >> np.uint64(128 - width))
        docs.append(doc[fits] + a)
        starts.append(start[fits] + base)
    return Names(np.concatenate(high), np.concatenate(low)), units.texts.ids[np.concatenate(docs)], np.concatenate(starts)


@dataclass(frozen=True)
class Names:
    """Names of windows: 64 bits at most in `high`, and further ones in `low`, if any."""

    high: np.ndarray
    low: np.ndarray

    def __getitem__(self, at) -> Names:
        return Names(self.high[at], self.low[at] if len(self.low) else self.low)

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """A stable order, and which places of it begin a new name."""
        order = np.lexsort((self.low, self.high)) if len(self.low) else np.argsort(self.high, kind="stable")
        new = np.ones(len(order), bool)
        for part in (self.high, self.low) if len(self.low) else (self.high,):
            new[1:] = (part[order][1:] != part[order][:-1]) | (new[1:] & (part is not self.high))
        return order, new

    def packed(self) -> bytes:
        """Of sorted names; as many bytes of `low` as it needs."""
        size = (int(self.low.max(initial=0)).bit_length() + 7) // 8
        return _join(A.squeeze(self.high), self.low.view(np.uint8).reshape(-1, 8)[:, :size].tobytes())

    @staticmethod
    def unpacked(blobs: list[bytes]) -> Names:
        high, low = [np.zeros(0, np.uint64)], [np.zeros((0, 8), np.uint8)]
        for blob in blobs:
            x, y = _split(blob)
            high.append(A.unsqueeze(x))
            if y:
                low.append(np.zeros((len(high[-1]), 8), np.uint8))
                low[-1][:, : len(y) // len(high[-1])] = np.frombuffer(y, np.uint8).reshape(len(high[-1]), -1)
        return Names(np.concatenate(high), np.concatenate(low).view(np.uint64).ravel())


def _join(*blobs: bytes) -> bytes:
    return np.array([len(blobs), *map(len, blobs)], np.int64).tobytes() + b"".join(blobs)


def _split(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(blob, np.int64, n, 8))
    return [blob[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def covered(blocks: Blocks, rule: Rule, finish: Callable, schema: str) -> DataFrame:
    """finish(texts, units, removed) makes the rows of a block; removed: a flag for each
    unit covered by a window that also starts in a document with a smaller id."""
    buckets, bits, width = blocks.n, blocks.bits, blocks.width
    drop = np.uint64(64 - bits)

    def anchors(units: Units, skip: np.ndarray):
        """(first document, anchors' places, their names) of each slice."""
        steps = units.steps(rule.anchor)
        for a, b, values, offs in units.parts():
            at = anchors_at(offs, skip[a:b], rule)
            yield a, offs, at, A.window_hashes(values, steps, at) >> drop

    def name_anchors(texts: Texts):
        units = Units(texts, rule)
        whole = units.whole()
        found = [names for *_, names in anchors(units, units.repeats(whole, set()))]
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
        mine, docs = dict(by_bucket(keys, buckets, bits)), {}
        for d in sorted(set(whole)):
            docs.setdefault(int.from_bytes(d[:8], "big") * buckets >> 64, []).append(d)
        for k in mine.keys() | docs.keys():
            s = mine.get(k, slice(0, 0))
            yield k, _join(A.squeeze(keys[s]), A.squeeze(keys[s][counts[s] > 1]), b"".join(docs.get(k, []))), b""

    def tell_shared(rows):
        parts = [_split(body) for _, body, _ in rows]
        asked = [(A.unsqueeze(x), A.unsqueeze(y), _digests(z)) for x, y, z in parts]
        every = np.concatenate([x[0] for x in asked])
        every.sort(kind="stable")
        shared = np.unique(every[1:][every[1:] == every[:-1]])
        first: dict[bytes, int] = {}
        for n, ((block, _, _), (keys, twice, whole)) in enumerate(zip(rows, asked, strict=True)):
            found = keys[(A.find(keys, shared) >= 0) | (A.find(keys, twice) >= 0)]
            earlier = [d for d in whole if first.setdefault(d, n) < n]
            if len(found) or len(earlier):
                yield block, A.squeeze(found), b"".join(earlier)

    def extend(block, texts: Texts, rows):
        if not rows or not len(texts):
            return
        units = Units(texts, rule)
        shared = A.Membership(np.sort(np.concatenate([A.unsqueeze(x) for _, x, _ in rows])), bits)
        earlier = b"".join(x for _, _, x in rows)
        skip, runs = units.repeats(units.whole(), set(_digests(earlier))), []
        for a, offs, at, names in anchors(units, skip):
            at = at[shared.hits(names)[0]]
            mark = np.zeros(offs[-1] + 1, np.int32)
            np.add.at(mark, np.maximum(at + rule.anchor - rule.length, 0), 1)
            np.add.at(mark, at + 1, -1)
            runs.append(np.array(runs_of(np.cumsum(mark)[:-1] > 0)) + units.offs[a])
        runs = np.concatenate([np.zeros((2, 0), np.int64), *runs], axis=1)
        names, ids, _ = units_windows(units, runs, skip, width)
        order, new = names.sorted()
        names, ids, first = names[order[new]], ids[order], np.flatnonzero(new)
        several = ids[first] != ids[np.append(first[1:], len(ids)) - 1] if len(first) else np.zeros(0, bool)
        yield -1, _join(earlier, runs.tobytes()), b""  # for this block's last step
        for k, s in by_bucket(names.high, buckets, min(64, width)):
            yield k, _join(names[s].packed(), np.packbits(several[s]).tobytes()), b""

    def rank_windows(rows):
        """For each name of a block, in order: whether to cover it everywhere in the block,
        and whether to cover it but in its first document."""
        own = [_split(body) for _, body, _ in rows]
        names = [Names.unpacked([x[0]]) for x in own]
        every, ends = Names.unpacked([x[0] for x in own]), np.cumsum([len(x.high) for x in names])
        order, new = every.sorted()
        lead = np.empty(len(order), np.int64)
        lead[order] = np.searchsorted(ends, order[new], "right")[np.cumsum(new) - 1]
        for n, ((block, _, _), (_, several), end) in enumerate(zip(rows, own, ends, strict=True)):
            mine = lead[end - len(names[n].high) : end]
            here = np.unpackbits(np.frombuffer(several, np.uint8), count=len(mine)).astype(bool) & (mine == n)
            yield block, _join(np.packbits(mine < n).tobytes(), np.packbits(here).tobytes()), b""

    def cover(block, texts: Texts, rows):
        units = Units(texts, rule)
        earlier, runs = next((_split(body) for bucket, body, _ in rows if bucket < 0), (b"", b""))
        runs = np.frombuffer(runs, np.int64).reshape(2, -1)
        skip = units.repeats(units.whole(), set(_digests(earlier)))
        names, ids, starts = units_windows(units, runs, skip, width)
        order, new = names.sorted()
        every = names[order[new]].high
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        flags, answers = np.zeros((2, len(every)), bool), {bucket: body for bucket, body, _ in rows if bucket >= 0}
        for k, s in by_bucket(every, buckets, min(64, width)):
            for flag, bits_of in zip(flags, _split(answers[k]), strict=True):
                flag[s] = np.unpackbits(np.frombuffer(bits_of, np.uint8), count=s.stop - s.start)
        lead = ids[order[new]]  # ids ascend, and the order is stable
        bad = starts[flags[0][which] | (flags[1][which] & (ids > lead[which]))]
        mark = np.zeros(int(units.offs[-1]) + 1, np.int32)
        np.add.at(mark, bad, 1)
        np.add.at(mark, bad + rule.length, -1)
        removed = np.cumsum(mark)[:-1] > 0
        for d in np.flatnonzero(skip & (np.diff(units.offs) >= rule.length)).tolist():
            removed[units.offs[d] : units.offs[d + 1]] = True
        return finish(texts, units, removed)

    shared = blocks.answer(blocks.ask(blocks.packed, name_anchors), tell_shared)
    ranked = blocks.answer(blocks.ask_again(shared, extend), rank_windows)
    return blocks.with_answers(ranked, cover, schema)


def _digests(blob: bytes) -> list[bytes]:
    return [blob[k : k + 16] for k in range(0, len(blob), 16)]


def runs_of(removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of set flags."""
    edge = np.diff(np.concatenate(([0], removed.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def table_of(columns: dict, types: dict) -> pa.Table:
    return pa.table({k: pa.array(v, types[k]) for k, v in columns.items()})
