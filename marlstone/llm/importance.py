"""Target-distribution importance resampling over hashed n-grams.

Features are the runs of 1 to WIDTH words. A dictionary of distinct features counts
them over all rows: a task counts the n-grams of some millions of words, and sends
its distinct ones as a few sorted, compressed blocks, one for each slot of the
dictionary; a slot merges its blocks, so that a string that many tasks found is
there once, hashes each of its strings once and adds the counts up by bucket.
Gains compare the buckets of the target with those of the rows; they are joined to
the features of each document (a table of BUCKETS numbers, whatever the corpus), and
documents are drawn by weight plus Gumbel noise, which is a function of the
identifier.

Two-word runs and the runs that they open meet in one slot; the longer runs of a
hot pair are spread by their third word. Hot pairs are found on a sample of whole
rows of about SAMPLE_BYTES; they decide where strings meet, not what is counted.

A word is a maximal run of characters other than \\x00-\\x2F, \\x3A-\\x60 and
\\x7B-\\x7F after A-Z are lower-cased.

Defined cases: a null text has no words; documents without features have weight 0
and those of fewer than LEAST_WORDS words are never drawn; a null identifier hashes
as an empty string and comes last among ties, and rows that tie in everything are
ranked in an arbitrary but fixed order; rows that repeat an identifier are counted
and ranked each; an empty table gives no rows; an empty target has counts of 0.
Extra columns are ignored. A task holds one text and FLUSH words, a slot about
SLOT_BYTES of text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers
from .arrow_groups import Numbers, groups, slices
from .ship import ship
from .storage import discard, materialize

BUCKETS, WIDTH, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Words that a task counts at a time, bytes of text that a slot of the dictionary stands for, bytes of the sample that finds hot pairs.
FLUSH, SLOT_BYTES, SAMPLE_BYTES = 1 << 20, 12 << 20, 16 << 20
#: A pair is hot if it has more than this share of a slot's words in the sample.
HOT_SHARE = 1 / 8

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]] = 32
_WORDS = _TABLE.tobytes()


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


# --- CRC-32 of joined strings from those of their parts


@lru_cache(1)
def _zero_byte() -> np.ndarray:
    """What a zero byte makes of each low byte of a CRC."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


#: Shifts up to this many bytes are looked up in one table.
SHORT = 64


@lru_cache(1)
def _shifts() -> np.ndarray:
    """[bytes, place of a byte in the CRC, byte]: the CRC of that byte followed by so many zero bytes."""
    t = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [t]
    for _ in range(SHORT):
        t = (t >> np.uint32(8)) ^ _zero_byte()[t & np.uint32(255)]
        out.append(t)
    return np.stack(out)


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of strings followed by size zero bytes, but for the lengths' marks: what joins a CRC to that of the string after it."""
    tables, out = _shifts(), crc
    left = size
    while True:
        now = np.minimum(left, SHORT)
        out = tables[now, 0, out & 255] ^ tables[now, 1, (out >> 8) & 255] ^ tables[now, 2, (out >> 16) & 255] ^ tables[now, 3, out >> 24]
        left = left - now
        if not left.any():
            return out


class _Crcs:
    """CRCs of words, and of words joined by a space."""

    def __init__(self, words: list[bytes]) -> None:
        self.word = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        self.size = np.fromiter(map(len, words), np.int64, len(words))

    def join(self, crc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of strings with these CRCs, a space and a word."""
        spaced = shifted(crc, np.ones(len(crc), np.int64)) ^ np.uint32(zlib.crc32(b" "))
        return shifted(spaced, self.size[word]) ^ self.word[word]


# --- counting in a task


class Block:
    """Words of some texts as numbers, in the order of their first occurrence."""

    def __init__(self) -> None:
        self.known = Numbers()
        self.parts: list[np.ndarray] = []
        self.sizes: list[int] = []

    def add(self, words: list[bytes]) -> None:
        self.parts.append(self.known.of(words))
        self.sizes.append(len(words))

    def __len__(self) -> int:
        return sum(self.sizes)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of all texts, starts of two-word runs, starts of three-word runs)"""
        ids = np.concatenate([*self.parts, np.zeros(0, np.int64)])
        left = np.repeat(np.cumsum(self.sizes), self.sizes) - np.arange(len(ids))  # words from here to the text's end
        return ids, np.flatnonzero(left > 1), np.flatnonzero(left > 2)


def blocks_of(batches, most: int = FLUSH) -> Iterator[tuple[Block, list]]:
    """Blocks of about most words, each with the leading columns of its rows; the last column is the text."""
    block, keys = Block(), []
    for b in slices(batches):
        *lead, texts = (c.to_pylist() for c in b.columns)
        for k, text in enumerate(texts):
            block.add(split_words(text))
            keys.append([c[k] for c in lead])
        if len(block) >= most:
            yield block, keys
            del block, keys
            block, keys = Block(), []
    if keys:
        yield block, keys


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, of each row the place of its key, rows of each key)"""
    return np.unique(keys, return_inverse=True, return_counts=True)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return keys[new]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _pair_mark(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(0xD6E8FEB86659FD93) + b)


def _word_marks(words: list[bytes]) -> np.ndarray:
    """64-bit marks by which strings are dealt to slots; strings may share one."""
    two = ((zlib.crc32(w, 1) << 32) | zlib.adler32(w) for w in words)
    return _mixed(np.fromiter(two, np.uint64, len(words)))


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as four rows of bytes, the high ones nearly all zero."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Slots:
    """Distinct n-grams of a block, dealt to slots."""

    def __init__(self, block: Block, slots: int, hot: np.ndarray) -> None:
        self.words = list(block.known)
        marks = _word_marks(self.words)
        ids, two, three = block.runs()
        n = max(1, len(self.words))
        self.ones = np.bincount(ids, minlength=len(self.words))
        pairs, of_place, self.twos = _counted(ids[two] * n + ids[two + 1])
        self.a, self.b = pairs // n, pairs % n
        place = np.zeros(len(ids) + 1, np.int64)
        place[two] = of_place
        del of_place, two
        triples, self.threes = np.unique(place[three] * n + ids[three + 2], return_counts=True)
        del place, three, ids
        pair, self.c = triples // n, triples % n
        del triples
        mark = _pair_mark(marks[self.a], marks[self.b])
        home = (mark % np.uint64(slots)).astype(np.int64)
        slot = home[pair]
        spread = np.flatnonzero(np.isin(mark, hot)[pair]) if len(hot) else np.zeros(0, np.int64)
        slot[spread] = (_mixed(mark[pair[spread]] + marks[self.c[spread]]) % np.uint64(slots)).astype(np.int64)
        m = max(1, len(pairs))
        at_home = np.sort(home * m + np.arange(len(pairs)))
        self.pairs = _distinct(np.concatenate([at_home, slot[spread] * m + pair[spread]]))  # a hot pair is listed wherever its longer runs are
        key = slot * m + pair
        del slot, pair
        self.triples = np.argsort(key, kind="stable")
        key = key[self.triples]
        ends = np.searchsorted(key, self.pairs, "right")
        self.longer = np.diff(ends, prepend=0)
        self.here = np.zeros(len(self.pairs), bool)
        self.here[np.searchsorted(self.pairs, at_home)] = True
        self.m = m
        self.singles = np.argsort(marks % np.uint64(slots), kind="stable")
        every = np.arange(slots + 1)
        self.single_cuts = np.searchsorted((marks % np.uint64(slots)).astype(np.int64)[self.singles], every)
        self.pair_cuts = np.searchsorted(self.pairs, every * m)
        self.triple_cuts = np.searchsorted(key // m, every)

    def pack(self, s: int) -> bytes | None:
        """One slot's n-grams: words, then single words, pairs in order with the number of longer runs after each, and the last words of these."""
        import zstandard

        one = self.singles[self.single_cuts[s] : self.single_cuts[s + 1]]
        listed = slice(self.pair_cuts[s], self.pair_cuts[s + 1])
        pair = self.pairs[listed] % self.m
        triple = self.triples[self.triple_cuts[s] : self.triple_cuts[s + 1]]
        if not len(one) + len(pair) + len(triple):
            return None
        used, local = np.unique(np.concatenate([one, self.a[pair], self.b[pair], self.c[triple]]), return_inverse=True)
        one_, a, b, c = np.split(local, np.cumsum([len(one), len(pair), len(pair)]))
        new = np.diff(a, prepend=-1) != 0
        step = np.where(new, b, np.diff(b, prepend=0))  # second words rise below each first word
        columns = [one_, self.ones[one], np.diff(a, prepend=0), step, np.where(self.here[listed], self.twos[pair], 0), self.longer[listed], c, self.threes[triple]]
        head = np.array([len(used), len(one), len(pair), len(triple)], "<u4").tobytes()
        words = b" ".join(map(self.words.__getitem__, used.tolist()))
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(map(_planes, columns)) + words)


def _unpack(raw: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    _, ones, pairs, triples = np.frombuffer(raw[:16], "<u4").tolist()
    at, columns = 16, []
    for n in (ones, ones, pairs, pairs, pairs, pairs, triples, triples):
        columns.append(_unplaned(raw[at : at + 4 * n]))
        at += 4 * n
    one, ones, a, step, twos, longer, c, threes = columns
    new = a != 0
    new[:1] = True
    a = np.cumsum(a)
    step = step.astype(np.uint32).astype(np.int32).astype(np.int64)
    total = np.cumsum(step)
    first = np.flatnonzero(new)
    b = total - np.repeat((total - step)[first], np.diff(np.append(first, len(a))))
    return raw[at:].split(), [one, ones, a, b, twos, longer, c, threes]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, of each row the place of its key, sums)"""
    found, inverse = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, inverse, counts)
    return found, inverse, sums


def merged(blobs: list[bytes], buckets: int) -> np.ndarray:
    """Occurrences in each bucket of a slot's n-grams; each distinct string is hashed once."""
    known = Numbers()
    parts: list[list[np.ndarray]] = []
    n_pairs = 0
    for blob in blobs:
        words, (one, ones, a, b, twos, longer, c, threes) = _unpack(blob)
        number = known.of(words)
        parts.append([number[one], ones, number[a], number[b], twos, np.repeat(np.arange(len(a)), longer) + n_pairs, number[c], threes])
        n_pairs += len(a)
    one, ones, a, b, twos, pair, c, threes = map(np.concatenate, zip(*parts))
    parts.clear()
    n, crcs, out = max(1, len(known)), _Crcs(list(known)), np.zeros(buckets, np.int64)
    add = lambda crc, counts: np.add.at(out, (crc % np.uint32(buckets)).astype(np.int64), counts)
    single, _, sums = _summed(one, ones)
    add(crcs.word[single], sums)
    pairs, place, sums = _summed(a * n + b, twos)
    del one, ones, a, b, twos
    crc = crcs.join(crcs.word[pairs // n], pairs % n)
    add(crc, sums)
    triples, _, sums = _summed(place[pair] * n + c, threes)
    add(crcs.join(crc[triples // n], triples % n), sums)
    return out


# --- the corpus


def _hot_pairs(texts: DataFrame, n_bytes: int, slots: int) -> list[int]:
    """Marks of the pairs that would fill more than a share of a slot; at most slots / HOT_SHARE of them."""
    every = max(1, n_bytes // SAMPLE_BYTES)
    sample = texts.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def run(batches):
        import pyarrow as pa

        for block, _ in blocks_of(batches):
            marks = _word_marks(list(block.known))
            ids, two, _ = block.runs()
            found, count = np.unique(_pair_mark(marks[ids[two]], marks[ids[two + 1]]).view(np.int64), return_counts=True)
            often = count > 1
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found[often], 0)), pa.array(np.append(count[often], 0)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(two)))], ["mark", "n", "pairs"])

    counts = materialize(sample.mapInArrow(run, "mark long, n long, pairs long"), "pairs")
    total = counts.agg(F.sum("pairs")).first()[0] or 0
    hot = counts.groupBy("mark").agg(F.sum("n").alias("n")).filter(F.col("n") > max(8, total * HOT_SHARE / slots)).select("mark").collect()
    discard(counts)
    return [r["mark"] for r in hot]


def bucket_counts(rows: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: occurrences of all n-grams of all rows, for the buckets that have some."""
    ship(rows.sparkSession)
    texts = rows.select(F.col(text_col).cast("binary").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(1, -(-n_bytes // SLOT_BYTES))
    hot = np.array(_hot_pairs(texts, n_bytes, slots) if slots > 1 else [], np.int64).view(np.uint64)

    def count(batches):
        import pyarrow as pa

        for block, _ in blocks_of(batches):
            dealt = _Slots(block, slots, hot)
            for s in range(slots):
                if (blob := dealt.pack(s)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([blob], pa.binary())], ["slot", "blob"])
            del block, dealt  # before the next block is read

    def merge(batches):
        import pyarrow as pa

        out = np.zeros(buckets, np.int64)
        for group in groups(batches, 1):
            out += merged(group.column(1).to_pylist(), buckets)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["bucket", "n"])

    dealt = texts.mapInArrow(count, "slot long, blob binary").repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot")
    return dealt.mapInArrow(merge, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain (in thousandths, floored) of every bucket: log of its smoothed share in target over that in docs."""
    spark = docs.sparkSession
    raw = materialize(bucket_counts(docs, text_col, buckets).withColumnRenamed("n", "s"), "buckets")
    aim = materialize(bucket_counts(target, target_col, buckets).withColumnRenamed("n", "t"), "buckets")
    every = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw, "bucket", "left").join(aim, "bucket", "left").fillna(0, ["s", "t"])
    totals = every.agg(F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    share = (F.col("t").cast("double") + 1) * (F.col("all_s") + buckets) / ((F.col("s").cast("double") + 1) * (F.col("all_t") + buckets))
    return every.crossJoin(totals).select("bucket", F.floor(F.log(share) * 1000).cast("long").alias("gain"))  # totals is one row


def weights(docs: DataFrame, gained: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: the sum of the gains of its features, repeats counted.

    gained has a row for each bucket, which are as many as it is made with: it is brought to the driver and goes to the tasks with the function.
    """
    ship(docs.sparkSession)
    gain = np.array([r["gain"] for r in gained.orderBy("bucket").collect()], np.int64)

    def run(batches):
        import pyarrow as pa

        for block, keys in blocks_of(batches, FLUSH // 4):
            crcs = _Crcs(list(block.known))
            ids, two, three = block.runs()
            n, sizes = max(1, len(crcs.word)), np.array(block.sizes, np.int64)
            pairs, of_place, _ = _counted(ids[two] * n + ids[two + 1])
            crc = crcs.join(crcs.word[pairs // n], pairs % n)
            place = np.zeros(len(ids) + 1, np.int64)
            place[two] = of_place
            triples, of_triple, _ = _counted(place[three] * n + ids[three + 2])
            gain_of = lambda c: gain[(c % np.uint32(len(gain))).astype(np.int64)]
            each = gain_of(crcs.word)[ids]  # of each place, the gains of the runs that start there
            each[two] += gain_of(crc)[of_place]
            each[three] += gain_of(crcs.join(crc[triples // n], triples % n))[of_triple]
            before = np.concatenate([[0], np.cumsum(each)])
            ends = np.cumsum(sizes)
            n_features = sum(np.maximum(sizes - k, 0) for k in range(WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array(sizes), pa.array(n_features), pa.array(before[ends] - before[ends - sizes])], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored: a function of seed and identifier."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every row; rank is null for rows that are not drawn."""
    weighed = materialize(weights(docs, gains(docs, target, text_col, target_col), id_col, text_col), "weights")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    may = F.col("n_words") >= least_words
    drawn = weighed.filter(may).count() * percent // 100
    placed = row_numbers(scored, [F.when(may, 0).otherwise(1), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.xxhash64("n_features", "weight")], "rank")
    return placed.withColumn("rank", F.when(may & (F.col("rank") < drawn), F.col("rank") + 1))


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
