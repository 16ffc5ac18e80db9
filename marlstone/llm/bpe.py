"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the pretokenisation pattern, in numpy over the code
points of a block of texts. Distinct pieces are mapped byte by byte to printable
characters and encoded by the tokenizers library; a worker remembers the ids of
pieces it has met, by the piece itself, up to a bound. Offsets say which characters each token covers.
Decoding reverses the byte table on whole documents, so characters that were
split over several tokens come back whole; a sequence that is cut within a
character decodes with replacement characters only there.

The pattern's rules are those of
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
applied from left to right; other patterns are refused.

Defined cases: a null text counts as empty; an empty text has no tokens; extra
columns are ignored; rows that repeat an identifier, or whose identifier is null,
are encoded each. A very long text is encoded in spans that end with a piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import give_back, slices
from .ship import ship

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text handled at a time, and pieces a worker remembers (about 200 bytes each).
BLOCK, REMEMBERED = 1 << 18, 1 << 17

SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


@lru_cache(2)
def _codec(data: bytes):
    """(tokenizer for mapped pieces, token bytes joined, start of each token)"""
    from tokenizers import Tokenizer, models

    ranks, alphabet = load_ranks(data), byte_alphabet()
    shown = lambda token: "".join([alphabet[b] for b in token])
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        cuts = [(ranks[token[:k]], ranks[token[k:]], token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
        merges += [(shown(a), shown(b)) for _, _, a, b in sorted(cuts)]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): i for t, i in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))  # pieces are remembered by the Encoder
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    starts = np.zeros(len(by_id) + 1, np.int64)
    np.cumsum([len(t) for t in by_id], out=starts[1:])
    return tokenizer, np.frombuffer(b"".join(by_id), np.uint8), starts


@lru_cache(1)
def class_runs() -> tuple[np.ndarray, np.ndarray]:
    """(first code point, class) of each run of code points in one class, as the tokenizers library sorts them.

    Found in one pass over all code points, on the driver; the runs go to the workers with the functions.
    """
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, OTHER, np.uint8)
    points = np.arange(0x110000, dtype=np.uint32)
    points[0xD800:0xE000] = ord("!")  # surrogates are no text
    every = points.tobytes().decode("utf-32-le")
    for cls, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(every):
            out[a:b] = cls
    out[0xD800:0xE000] = OTHER
    first = np.flatnonzero(np.diff(out, prepend=255))
    return first, out[first]


_table: list[np.ndarray] = []


def take_classes(runs: tuple[np.ndarray, np.ndarray]) -> None:
    """Set the class of every code point, once for each process."""
    if not _table:
        _table.append(np.repeat(runs[1], np.diff(runs[0], append=0x110000)))


def _classes() -> np.ndarray:
    """Class of every code point under the pattern."""
    if not _table:
        take_classes(class_runs())
    return _table[0]


def piece_starts(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts of the pieces in texts laid end to end; each text but empty ones starts a piece."""
    n = len(points)
    cls = _classes()[points]
    ends = np.cumsum(lengths)
    first = np.zeros(n + 1, bool)
    first[np.concatenate([[0], ends[:-1]])] = True
    first = first[:n]
    last = np.zeros(n, bool)
    last[ends[lengths > 0] - 1] = True
    change = np.ones(n, bool)
    change[1:] = cls[1:] != cls[:-1]
    change |= first
    space = cls == SPACE
    start = change.copy()
    # the last white space before other text stands alone, or joins the next run if it is a blank
    final = np.zeros(n, bool)
    final[:-1] = space[:-1] & ~space[1:]
    final &= ~last
    start |= final
    joined = np.flatnonzero(final & (points == 32)) + 1
    start[joined] = False
    # contractions at an apostrophe that opens a piece
    for at in np.flatnonzero(start & (points == 39)).tolist():
        tail = points[at + 1 : at + 3]
        stop = int(ends[np.searchsorted(ends, at, "right")])
        two = "".join(map(chr, tail[: stop - at - 1].tolist()))
        size = 2 if two[:1] in ("s", "t", "m", "d") and two else 3 if two in ("re", "ve", "ll") else 0
        if size:
            start[at + 1 : at + size] = False
            if at + size < stop:
                start[at + size] = True
    return np.flatnonzero(start)


def _piece_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the pieces, by running sums."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    n = len(points)
    power, back = np.full(n, odd, np.uint64), np.full(n, inverse, np.uint64)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed * power, out=sums[1:])
    h = (sums[ends] - sums[starts]) * back[starts]
    h ^= h >> np.uint64(32)
    return h * odd + (ends - starts).astype(np.uint64)


def distinct_pieces(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in starts that stand for all different pieces, for each piece the index of its own there).

    Pieces are grouped by hash and compared character by character with the first
    of their group; a piece that merely shares its hash stands for itself.
    """
    ends = np.append(starts[1:], len(points))
    _, at, inverse = np.unique(_piece_hashes(points, starts, ends), return_index=True, return_inverse=True)
    shift = starts[at][inverse] - starts
    other = np.arange(len(points)) + np.repeat(shift, ends - starts)
    unequal = np.logical_or.reduceat(points != points[np.minimum(other, len(points) - 1)], starts)
    unequal |= (ends - starts)[at][inverse] != ends - starts
    alone = np.flatnonzero(unequal)
    inverse[alone] = len(at) + np.arange(len(alone))
    return np.concatenate([at, alone]), inverse


def spans(text: str) -> Iterator[str]:
    """Parts of about BLOCK characters of a long text, cut where a piece starts whatever follows the part."""
    at, size = 0, BLOCK
    while len(text) - at > size:
        part = text[at : at + size]
        starts = piece_starts(np.frombuffer(part.encode("utf-32-le"), np.uint32), np.array([len(part)]))
        if len(starts) < 4:  # a piece that fills the part
            size *= 2
            continue
        yield part[: starts[-3]]
        at, size = at + int(starts[-3]), BLOCK
    yield text[at:]


class Encoder:
    """Encodes blocks of texts; one for each worker and vocabulary."""

    def __init__(self, data: bytes) -> None:
        self.tokenizer, self.bytes, self.starts = _codec(data)
        give_back()
        self.alphabet = byte_alphabet()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool: list[np.ndarray] = []
        self.n_pool = 0
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rest(self) -> None:
        """Let go of the pieces when a task ends: the worker waits idle beside those of later stages."""
        self._forget()
        give_back()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces in one call; each is a word of a pretokenised sequence."""
        alphabet = self.alphabet
        words = ["".join([alphabet[b] for b in p.encode()]) for p in pieces]
        found = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, np.uint32)
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(words))
        at = self.n_pool + np.concatenate([[0], np.cumsum(counts)[:-1]])
        base = len(self.first)
        self.known.update(zip(pieces, range(base, base + len(words))))
        self.first = np.concatenate([self.first, at])
        self.count = np.concatenate([self.count, counts])
        self.pool.append(ids)
        self.n_pool += len(ids)

    def block(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        if not joined:
            yield from (np.zeros(0, np.uint32) for _ in texts)
            return
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(points, lengths)
        at, inverse = distinct_pieces(points, starts)
        ends = np.append(starts[1:], len(points))
        pieces = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        if len(self.first) > REMEMBERED:
            self._forget()
        if new := [p for p in dict.fromkeys(pieces) if p not in self.known]:
            self._learn(new)
        if len(self.pool) > 1:
            self.pool = [np.concatenate(self.pool)]
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))[inverse]
        first, count = self.first[which], self.count[which]
        ids = self.pool[0][ragged(first, count)]
        token_ends = np.concatenate([[0], np.cumsum(count)])
        cuts = token_ends[np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield ids[a:b]

    def encode(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """The ids of each text. Blocks of about BLOCK characters bound the memory; a longer text is encoded in spans that end with a piece."""
        block, size = [], 0
        for text in texts:
            if len(text) > 2 * BLOCK:
                yield from self.block(block)
                block, size = [], 0
                yield np.concatenate([ids for span in spans(text) for ids in self.block([span])])
                continue
            block.append(text)
            size += len(text)
            if size >= BLOCK:
                yield from self.block(block)
                block, size = [], 0
        yield from self.block(block)

    def decoded(self, ids: np.ndarray) -> Iterator[bytes]:
        """The bytes of the tokens, in parts."""
        for a in range(0, len(ids), BLOCK):
            part = ids[a : a + BLOCK]
            yield self.bytes[ragged(self.starts[part], self.starts[part + np.uint32(1)] - self.starts[part])].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.decoded(ids))

    def char_offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character and end of each token; a character split over tokens belongs to each of them."""
        raw = np.frombuffer(text.encode(), np.uint8)
        of_byte = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.starts[ids + np.uint32(1)] - self.starts[ids])
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        return of_byte[begins], of_byte[ends - 1] + 1


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices first[i], first[i] + 1, ... count[i] of them, for all i in turn."""
    total = int(count.sum())
    skip = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return skip + np.arange(total)


@lru_cache(2)
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def _vocabulary(vocab_path: str) -> bytes:
    with open(vocab_path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) and, if asked for, char_starts and char_ends of each row's text.

    The vocabulary file is read on the driver and goes to the workers with the function (under a megabyte).
    """
    ship(docs.sparkSession)
    data, classes = _vocabulary(vocab_path), class_runs()
    schema = "doc_id long, ids array<int>" + ", char_starts array<int>, char_ends array<int>" * with_offsets

    def run(batches):
        import pyarrow as pa

        take_classes(classes)
        codec = encoder(data)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = list(codec.encode(iter(texts)))
            columns = [b.column(0), pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))]
            if with_offsets:
                spans = [codec.char_offsets(t, x) if len(x) else (np.zeros(0), np.zeros(0)) for t, x in zip(texts, found)]
                columns += [pa.array([s[k].astype(np.int32) for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
        codec.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    ship(encoded.sparkSession)
    data = _vocabulary(vocab_path)

    def run(batches):
        import pyarrow as pa

        codec = encoder(data)
        for b in slices(batches):
            texts = [codec.decode(np.array(x or [], np.uint32)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode each row's text: doc_id, n_tokens, ids_sha256, decoded_sha256, restored and, if asked for, ids.

    restored: the decoded bytes are the text's.
    """
    ship(docs.sparkSession)
    data, classes = _vocabulary(vocab_path), class_runs()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean" + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa

        take_classes(classes)
        codec = encoder(data)
        for b in slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            rows, kept = [], []
            for text, ids in zip(texts, codec.encode(iter(texts))):
                back = hashlib.sha256()
                for part in codec.decoded(ids):
                    back.update(part)
                rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), back.hexdigest(), back.digest() == hashlib.sha256(text.encode()).digest()))
                kept.append(ids)
            columns = [b.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            if with_ids:
                ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])
        codec.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
