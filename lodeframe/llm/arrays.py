"""Small numpy helpers that run inside tasks: hashing of words and windows, and
compact coding of sorted 64-bit keys. Everything is vectorised over one block of
documents; nothing here knows about Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import xxhash

U64 = np.uint64
#: Windows are hashed in slices of about this many units, to bound memory.
SLICE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words without punctuation: all ASCII but letters and digits.
NOT_ALNUM = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])

#: Odd factors of the hashes.
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Longer spans are hashed one by one.
LONG = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that the high bits depend on every input bit."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number; zeros follow the last byte."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), U64, padded, 0, (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span: its length and then its bytes, eight at
    a time, go through a mixer that isn't linear, so that no texts clash but by chance."""
    sizes, words = ends - starts, eights(buf)
    out = mix(sizes.astype(U64) + U64(BASE))
    left = np.arange(len(starts))
    for k in range(0, LONG, 8):
        left = left[(sizes[left] > k) & (sizes[left] <= LONG)]
        if not len(left):
            break
        chunk = words[starts[left] + k] & _MASKS[np.minimum(sizes[left] - k, 8)]
        out[left] = mix((out[left] ^ chunk) * U64(STEP))
    for k in np.flatnonzero(sizes > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]].tobytes())
    return out


def window_hashes(values: np.ndarray, steps: Sequence[int], at: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the values at i + step, for every i in `at`."""
    out = np.full(len(at), mix(np.array([len(steps) + (seed << 32)], U64))[0], U64)
    for step in steps:
        out ^= values[at + step]
        out *= U64(STEP)
        out ^= out >> U64(32)
    return mix(out)


def words_of(buf: np.ndarray, offs: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words before each document.
    buf: bytes of all documents; offs: their offsets (n + 1)."""
    word = ~gaps[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    inner = offs[:-1][offs[:-1] < len(buf)]
    begin[inner] = word[inner]
    starts = np.flatnonzero(begin)
    end = word.copy()
    end[:-1] &= ~word[1:] | begin[1:]
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray, lower: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of words before each document."""
    hashes, counts, before = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(offs):
        part, rel = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        starts, ends, n = words_of(part, rel, gaps)
        hashes.append(span_hashes(LOWER[part] if lower else part, starts, ends))
        counts.append(n[1:] + before)
        before += len(starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate(counts)


def slices(offs: np.ndarray, size: int = SLICE) -> list[tuple[int, int]]:
    """Ranges of whole documents of about `size` units each."""
    out, a, n = [], 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        out.append((a, b))
        a = b
    return out


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys as differences of a fixed number of half bytes. The
    largest value stands for a step of that size without a key."""
    if not len(keys):
        return b""
    gaps = np.diff(keys)
    least = max(1, (int(keys[-1] - keys[0]) // max(1, len(gaps))).bit_length() // 4)
    _, nibbles = min((n * (len(gaps) + int((gaps // U64((1 << 4 * n) - 1)).sum())), n) for n in range(least, min(least + 3, 16) + 1))
    step = U64((1 << 4 * nibbles) - 1)
    long = np.flatnonzero(gaps >= step)
    if len(long):
        times = (gaps[long] // step).astype(np.int64)
        gaps[long] %= step
        gaps = np.insert(gaps, np.repeat(long, times), step)
    octets = np.ascontiguousarray(gaps).view(np.uint8).reshape(-1, 8)
    half = b""
    if nibbles % 2:
        top = np.append(octets[:, nibbles // 2], np.zeros(len(octets) % 2, np.uint8))
        half = (top[::2] | top[1::2] << 4).tobytes()
    return bytes([nibbles]) + np.array([len(gaps)], np.int64).tobytes() + keys[:1].tobytes() + octets[:, : nibbles // 2].tobytes() + half


def unsqueeze(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    nibbles, n = blob[0], int(np.frombuffer(blob, np.int64, 1, 1)[0])
    whole = nibbles // 2
    out = np.zeros((n + 1, 8), np.uint8)
    out[1:, :whole] = np.frombuffer(blob, np.uint8, n * whole, 17).reshape(n, whole)
    if nibbles % 2:
        half = np.frombuffer(blob, np.uint8, offset=17 + n * whole)
        out[1::2, whole] = half[: len(out[1::2])] & 15
        out[2::2, whole] = half[: len(out[2::2])] >> 4
    out = out.view(U64).ravel()
    skipped = out == U64((1 << 4 * nibbles) - 1)
    out[0], skipped[0] = np.frombuffer(blob, U64, 1, 9)[0], False
    keys = np.cumsum(out, dtype=U64)
    return keys[~skipped] if skipped.any() else keys


def bucket_bounds(keys: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each of `buckets` equal key ranges begins in sorted keys (n + 1)."""
    edges = np.array([min((k << bits) // buckets, 2**64 - 1) for k in range(1, buckets)], U64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each key in sorted `wanted`, or -1."""
    if not len(wanted) or not len(keys):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(wanted, keys)
    at[at == len(wanted)] = 0
    return np.where(wanted[at] == keys, at, -1)


class Membership:
    """Tells quickly which of many keys are in a sorted list of mixed keys."""

    def __init__(self, keys: np.ndarray, bits: int = 64):
        self.keys, self.shift = keys, U64(max(0, bits - 22))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(keys >> self.shift).astype(np.int64)] = True

    def hits(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys that are in the list, and their indexes there."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.seen[(keys >> self.shift).astype(np.int64)])
        at = find(keys[maybe], self.keys)
        return maybe[at >= 0], at[at >= 0]
