"""Groups of rows within a sorted partition, for tasks that read Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np


#: Rows whose texts become Python objects at a time.
ROWS_OF_SLICE = 500


def slices(batches: Iterable) -> Iterator:
    """Batches of at most ROWS_OF_SLICE rows, so that a worker holds few texts as objects."""
    for b in batches:
        for first in range(0, b.num_rows, ROWS_OF_SLICE):
            yield b.slice(first, ROWS_OF_SLICE)
    b = None
    give_back()


def give_back() -> None:
    """Return free memory to the system: a worker waits idle beside those of later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


class Numbers(dict):
    """Numbers of words, in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def groups(batches: Iterable, n_keys: int) -> Iterator:
    """A record batch for each run of rows that agree in the first n_keys columns (integers).

    The partition must be sorted by them. At most one batch and one group are held.
    """
    import pyarrow as pa

    carry: list = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([np.asarray(b.column(k), np.int64) for k in range(n_keys)])
        starts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if carry and (keys[:, 0] != last).any():
            yield _joined(pa, carry)
            carry = []
        cuts = [0, *starts.tolist(), b.num_rows]
        for a, z in zip(cuts[:-2], cuts[1:-1]):
            yield _joined(pa, [*carry, b.slice(a, z - a)])
            carry = []
        carry.append(b.slice(cuts[-2]))
        last = keys[:, -1]
    if carry:
        yield _joined(pa, carry)
    carry = b = None
    give_back()


def _joined(pa, parts: list):
    if len(parts) == 1:
        return parts[0]
    schema = pa.schema([f.with_type(pa.large_binary()) if pa.types.is_binary(f.type) else f for f in parts[0].schema])  # a chunk of binary ends at 2 GiB
    batches = pa.Table.from_batches(parts).cast(schema).combine_chunks().to_batches()
    if len(batches) != 1:
        raise RuntimeError(f"a group came as {len(batches)} batches")
    return batches[0]
