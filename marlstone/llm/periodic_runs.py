"""Maximal periodic runs of words, by suffix trees.

The suffix trees of a block of texts are built together: suffixes are sorted by
prefix doubling (words of different texts differ), the longest common prefixes of
neighbours are the depths of the inner nodes, and a node with many children is a
chain of two-way nodes of equal depth. At every node the leaves of its smaller half
are visited: if the leaf one depth before or after a leaf lies in the other half,
the two are a tandem repeat that branches there, so a text of n words costs
O(n log n) visits. Such a repeat is rotated to the left as far as the words go on
(common suffixes are found by the classes of the doubling steps); repeats that
rotate to the same stretch are one run, whose period is the smallest of theirs.

A run is a stretch of consecutive words with smallest period q, at least
LEAST_EXPONENT * q and LEAST_LENGTH words long, that no neighbouring word extends
keeping the period. A word is a maximal run of characters other than [\\x20\\x09-\\x0D].

Defined cases: a null text has no words and collapses to an empty one, as an empty
text does; extra columns are ignored; rows that repeat an identifier, or whose
identifier is null, are handled each. A text is held whole by one task, which takes
about 60 bytes a word and 4 for each doubling of its longest repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_groups import Numbers, slices
from .ship import ship

LEAST_EXPONENT, LEAST_LENGTH = 4, 6
#: Words handled at a time (a longer text is a block of its own), and leaves visited at a time.
BLOCK, VISITS = 1 << 17, 1 << 20


class SuffixTrees:
    """Suffix trees of sequences laid end to end; numbers of different sequences must differ."""

    def __init__(self, numbers: np.ndarray, ends: np.ndarray) -> None:
        """ends: the end of the sequence that each place belongs to."""
        n = len(numbers)
        self.n = n
        order = np.argsort(numbers, kind="stable").astype(np.int32)
        sorted_numbers = numbers[order]
        opens = np.ones(n, bool)
        opens[1:] = sorted_numbers[1:] != sorted_numbers[:-1]
        rank = np.full(n + 1, -1, np.int32)  # that of the place past the end equals no other
        rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
        #: classes[k]: places are in one class if the 2^k words from them on are equal.
        self.classes = [rank.copy()]
        inside = ~opens
        inside[:-1] |= ~opens[1:]
        active, step = np.flatnonzero(inside), 1
        while len(active):
            at = order[active]
            after = at + step
            key = rank[at].astype(np.int64) * (n + 1) + np.where(after < ends[at], rank[np.minimum(after, n)], -1) + 1
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[active] = at
            opens = np.ones(len(at), bool)
            opens[1:] = key[1:] != key[:-1]
            rank[at] = active[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
            self.classes.append(rank.copy())
            inside = ~opens
            inside[:-1] |= ~opens[1:]
            active, step = active[inside], 2 * step
        self.order, self.place = order, rank[:-1]
        self.depth = np.zeros(n + 1, np.int32)
        near = 1 + np.flatnonzero(self.classes[0][order[1:]] == self.classes[0][order[:-1]])
        self.depth[near] = self.common(order[near - 1], order[near])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common at their start."""
        size = np.zeros(len(a), np.int32)
        for k in range(len(self.classes) - 1, -1, -1):
            size[self.classes[k][a + size] == self.classes[k][b + size]] += 1 << k
        return size

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in common before places a < b, read backwards."""
        size = np.zeros(len(a), np.int32)
        for k in range(len(self.classes) - 1, -1, -1):
            x, y = a - size - (1 << k), b - size - (1 << k)
            size[(x >= 0) & (self.classes[k][np.maximum(x, 0)] == self.classes[k][np.maximum(y, 0)])] += 1 << k
        return size

    def nodes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first leaf, first leaf of the right half, end of the leaves) of each two-way node with a depth, leaves in the order of suffixes."""
        depth = self.depth
        cut = np.flatnonzero(depth)
        left, right = np.arange(-1, self.n), np.arange(1, self.n + 2)
        active = cut
        while len(active):  # the nearest cut before that is no deeper
            to = left[active]
            deeper = depth[to] > depth[active]
            active = active[deeper]
            left[active] = left[to[deeper]]
        active = cut
        while len(active):  # the nearest cut after that is less deep
            to = right[active]
            deeper = depth[to] >= depth[active]
            active = active[deeper]
            right[active] = right[to[deeper]]
        return left[cut], cut, right[cut]

    def branching_repeats(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, length of the part that is repeated once) of all branching tandem repeats, in blocks."""
        first, cut, end = self.nodes()
        small_left = cut - first <= end - cut
        begin = np.where(small_left, first, cut)
        count = np.where(small_left, cut - first, end - cut)
        low, high = np.where(small_left, cut, first), np.where(small_left, end, cut)
        size = self.depth[cut]
        total = np.cumsum(count)
        a = 0
        while a < len(cut):
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + VISITS, "right")))
            node = np.repeat(np.arange(a, z), count[a:z])
            leaf = self.order[np.arange(len(node)) - np.repeat(total[a:z] - count[a:z] - (total[a - 1] if a else 0), count[a:z]) + begin[node]]
            for back in (0, 1):
                other = leaf - size[node] if back else leaf + size[node]
                there = np.flatnonzero((other >= 0) & (other < self.n))
                at = self.place[other[there]]
                there = there[(at >= low[node[there]]) & (at < high[node[there]])]
                yield np.minimum(leaf[there], other[there]), size[node[there]]
            a = z

    def runs(self, least_exponent: int, least_length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of all maximal runs, by start and period."""
        found = [np.zeros((3, 0), np.int64)]
        for start, period in self.branching_repeats():
            back = self.common_before(start, start + period)
            length = 2 * period + back
            long = length >= np.maximum(least_length, least_exponent * period)
            found.append(np.stack([(start - back)[long], length[long], period[long]]).astype(np.int64))
        start, length, period = np.concatenate(found, axis=1)
        by = np.lexsort((period, length, start))
        start, length, period = start[by], length[by], period[by]
        one = np.ones(len(start), bool)
        one[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
        start, length, period = start[one], length[one], period[one]
        by = np.lexsort((period, start))
        return start[by], length[by], period[by]


def _blocks(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, some texts at a time."""
    block, size = [], 0
    for text in texts:
        block.append((text or b"").split())  # splits at the same six bytes
        size += len(block[-1])
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def runs_of(block: list[list[bytes]], least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> Iterator[tuple[list[tuple[int, int, int]], list[bytes]]]:
    """((start, length, period) of each run by start and period, words that stay) of each text of a block."""
    sizes = [len(words) for words in block]
    n, base, numbers = sum(sizes), 0, []
    for words in block:
        known = Numbers()
        numbers.append(known.of(words) + base)
        base += len(known)
    if not n:
        yield from (([], []) for _ in block)
        return
    ends = np.cumsum(sizes)
    start, length, period = SuffixTrees(np.concatenate(numbers), np.repeat(ends, sizes)).runs(least_exponent, least_length)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    kept = np.cumsum(change)[:n] == 0
    of = np.searchsorted(start, np.concatenate([[0], ends]))
    for k, words in enumerate(block):
        a, z, first = of[k], of[k + 1], int(ends[k]) - sizes[k]
        if a == z:
            yield [], words
        else:
            runs = list(zip((start[a:z] - first).tolist(), length[a:z].tolist(), period[a:z].tolist()))
            yield runs, [words[i] for i in np.flatnonzero(kept[first : int(ends[k])]).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_exponent: int = LEAST_EXPONENT, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed of each row.

    collapsed: the words joined by one space, of each run only the first period.
    """
    if least_exponent < 2:
        raise ValueError("a run holds its period twice at least")
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in slices(batches):
            counts, runs, collapsed = [], [], []
            for block in _blocks(b.column(1).to_pylist()):
                counts += map(len, block)
                for found, words in runs_of(block, least_exponent, least_length):
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    collapsed.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones that with the smallest start, then period. Null if there is none."""
    less = lambda a, b: F.when(a < b, -1).when(a > b, 1)
    order = lambda a, b: F.coalesce(less(b["length"] * a["period"], a["length"] * b["period"]), less(a["start"], b["start"]), less(a["period"], b["period"]), F.lit(0))
    return F.get(F.array_sort(runs, order), F.lit(0))


def with_periodic_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with words planted: if h = crc32(decimal identifier) ends in 0, each word i from a = g % n on becomes word a + (i - a) % p.

    g = h / 10 without its fraction, n the words of the text, p = 1 + (n - a) / (3 + g % 8) without its fraction. Other texts, and those of null identifiers, stay.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def tail(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i))), " ")).otherwise(F.col(text_col))

    words = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    planted = F.get(F.transform(F.array(words), tail), F.lit(0))
    return docs.withColumn(text_col, F.when((h % 10 == 0) & F.col(text_col).isNotNull(), planted).otherwise(F.col(text_col)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the strongest run, digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
