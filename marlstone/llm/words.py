"""Words and their hashes for blocks of texts.

A word is a maximal run of bytes other than \\x20 and \\x09-\\x0D, with A-Z
lower-cased. Digests are of the words themselves and remembered by word, so that
different words do not share one by construction. Hashes are polynomials, found
by running sums over a block: they serve hashed features, where words may collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Bytes of text handled at a time; a longer text is a block of its own.
BLOCK = 1 << 18

_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Separators that also take ASCII punctuation out of words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _byte_values() -> np.ndarray:
    v = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    return v[_LOWER]


_VALUE = _byte_values()
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            table = np.full(max(n, 2 * BLOCK), np.uint64(base))
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0][:n], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hash_words(texts: list[bytes], blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of the block, first word of each text and the end); blank: the bytes that separate words."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts, ends, bounds = _words_of(texts, raw, blank)
    power, back = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power, out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)
    return mix(h), bounds


_LOWER_BYTES = _LOWER.tobytes()
#: Words whose digests a worker remembers, and bytes above which a word is not remembered.
REMEMBERED, LONGEST_REMEMBERED = 1 << 15, 64


class _Digests(dict):
    """64-bit digests of words under a key, by word."""

    def __init__(self, seed: int) -> None:
        super().__init__()
        self.key = b"marlstone words %d" % seed

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
        if len(word) <= LONGEST_REMEMBERED:
            self[word] = value
        return value


_digests: dict[int, _Digests] = {}


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER_BYTES).split()  # splits at the same six bytes


_KEPT = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(9)], np.uint64)


def _words_of(texts: list[bytes], raw: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word in the texts laid end to end, ends, first word of each text and the end)"""
    inside = np.empty(len(raw) + 1, bool)
    inside[0] = False
    np.logical_not(blank[raw], out=inside[1:])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return edges[::2], edges[1::2], np.searchsorted(edges[::2], begins)


def digest_words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(digest of each word of the block, first word of each text and the end).

    Words of up to 8 bytes are numbers, which are mixed one to one; longer ones are
    digested one by one.
    """
    known = _digests.setdefault(seed, _Digests(seed))
    if len(known) > REMEMBERED:
        known.clear()
    joined = (b" ".join(texts) + b" ").translate(_LOWER_BYTES)
    starts, ends, bounds = _words_of(texts, np.frombuffer(joined, np.uint8), _BLANK)
    eight = np.ndarray((len(joined),), "<u8", joined + bytes(8), strides=(1,))
    sizes = ends - starts
    h = mix((eight[starts] & _KEPT[np.minimum(sizes, 8)]) ^ np.uint64((seed + 1) * _ODD % (1 << 64)))
    h = mix(h + sizes.astype(np.uint64) * np.uint64(_ODD))
    long = np.flatnonzero(sizes > 8)
    h[long] = np.fromiter((known[joined[a:b]] for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.uint64, len(long))
    return h, bounds


def overlap(a: list[bytes], b: list[bytes], width: int = 5) -> tuple[int, int]:
    """(common, all) distinct word shingles of two texts, by the words themselves."""
    if len(a) < width or len(b) < width:
        sizes = [min(1, len(w)) if len(w) < width else len(set(zip(*(w[k:] for k in range(width))))) for w in (a, b)]
        common = int(bool(a) and a == b)
        return common, sum(sizes) - common
    names: dict[bytes, int] = {}
    ids = [np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)) for words in (a, b)]
    runs = [len(x) - width + 1 for x in ids]
    rank = np.concatenate([x[:n] for x, n in zip(ids, runs)])
    for k in range(1, width):  # ranks of ever longer runs: below the number of runs, so the product fits
        rank = np.unique(rank * len(names) + np.concatenate([x[k : k + n] for x, n in zip(ids, runs)]), return_inverse=True)[1]
    sets = [np.zeros(int(rank.max()) + 1, bool) for _ in runs]
    sets[0][rank[: runs[0]]] = True
    sets[1][rank[runs[0] :]] = True
    return int((sets[0] & sets[1]).sum()), int((sets[0] | sets[1]).sum())


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) in blocks of about BLOCK bytes; null counts as empty."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        block.append(text or b"")
        size += len(block[-1])
        if size >= BLOCK:
            yield first, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, block


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text; a shorter text is one shingle, an empty one none."""
    n = len(hashes)
    whole = np.zeros(n, np.uint64)
    for k in range(width):
        whole[: n - k] += mix(hashes[k:] + np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)) if n > k else np.zeros(0, np.uint64)
    mix(whole)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(whole[a : b - width + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix(h + hashes[k : k + 1])
            yield h
        else:
            yield np.zeros(0, np.uint64)
