"""Language identification by compression.

The raw-content dictionary of a zstandard compressor for each language holds its
most frequent words, counted over all labelled rows that are not held out, the most
frequent last. A text is encoded with every dictionary, in blocks
that each start from the dictionary anew and stay with it within the window, so
that sizes, scores and margins count in proportion at every length; the language
with the smallest sum of outputs wins, ties go to the language with more training
rows. One level serves all lengths. A
prediction is rejected when the relative difference between the two smallest
outputs is below the least margin of the text's length, and when the text is null
or has no letter.

A word is what stands between blanks; longer ones than LONG_WORD bytes (scripts
without blanks) are counted by all runs of RUN characters in them.

One rule gives the least margin of every length: it falls with the square root of
the bytes encoded, as chance differences of sizes do, and its scale is MARGIN_SHARE
of the MARGIN_QUANTILE of margin times root among the right predictions on all
labelled rows that are not held out. For these, each half of the rows (by a hash of
the text) is predicted with dictionaries of the other half, so that no text is in
its own dictionary. With fewer than LEAST_RIGHT right ones only ties go.

Letters are lower-cased and ASCII characters other than letters count as blanks
before encoding; the whole text is encoded.

Defined cases: null texts and texts without letters give `und`, score 0 and are
rejected; null languages are not learned from; rows without an identifier, or that
repeat one, are predicted each (held_out is false without one) and learned from as
others are; copies count as often as they occur; of more than MOST_LANGUAGES languages
the most frequent are learned; a language whose rows have no letter is not; without any
labelled text every text is `und`; extra columns are ignored by predict() and kept
by keep_identified().
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import order_statistics
from .arrow_groups import give_back, slices
from .folds import held_out
from .ship import ship
from .storage import discard, materialize

#: Bytes of a language's dictionary: the model's size, whatever the number of rows that are counted.
DICT_BYTES = 1 << 16
#: Longer words are counted by their runs of so many characters.
LONG_WORD, RUN = 32, 4
#: Words with their counts that a task holds before it adds them up; if more than half stay, they are sent on.
MOST_DISTINCT = 1 << 20
#: Languages learned, the most frequent ones, so that the dictionaries stay near 16 MB.
MOST_LANGUAGES = 250
#: Compression level of all texts: lower ones overlook short matches.
LEVEL = 10
#: Texts of twice this many bytes and more are cut into equal blocks of one to two times as many.
BLOCK_BYTES = 1 << 15
#: Bytes of prepared texts that a dictionary encodes before it is the next one's turn.
TURN_BYTES = 1 << 18
#: The least relative difference between the two smallest outputs that is no tie; least margins are never below it.
LEAST_MARGIN = 0.001
#: The quantile of right predictions' margins, the fewest that give one, and the share of it that is asked for.
MARGIN_QUANTILE, LEAST_RIGHT, MARGIN_SHARE = 0.01, 50, 0.5
#: Of the samples of earlier versions; nothing is sampled any more, but tests size their tables by them.
MARGIN_FOLD, MARGIN_ROWS = 4, 400
UNKNOWN = "und"

_LETTERS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


class Model(list):
    """(language, dictionary) of each language, most frequent language first, with the scale of least margins."""

    scale: float = 0.0


def _lowered(text: str) -> bytes:
    return (text if text.isascii() else text.lower()).encode().translate(_LETTERS)


def prepare(text: str) -> bytes:
    data = _lowered(text)
    while b"  " in data:
        data = data.replace(b"  ", b" ")
    return data.strip(b" ")


def _runs(word: str) -> Iterable[str]:
    return (word[i : i + RUN] for i in range(max(1, len(word) - RUN + 1)))


def counted_words(texts: Iterable[str], fold: int):
    """word, n0, n1: a table of the occurrences of each word of some texts, which are of one fold."""
    import pyarrow as pa
    import pyarrow.compute as pc

    found = pc.split_pattern(pa.array([_lowered("\n".join(texts))], pa.large_binary()), b" ").flatten().value_counts()
    words, counts = found.field(0), found.field(1)
    none = pa.repeat(pa.scalar(0, pa.int64()), len(counts))
    return pa.table([words, none if fold else counts, counts if fold else none], ["word", "n0", "n1"])


def _short_words(words):
    """words with the runs of long ones in their place."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.binary_length(words["word"])
    runs: tuple[Counter, Counter] = (Counter(), Counter())
    for word, *counts in zip(*(c.to_pylist() for c in words.filter(pc.greater(size, LONG_WORD)).columns)):
        for run, times in Counter(_runs(word.decode())).items():
            for of, n in zip(runs, counts):
                of[run] += n * times
    short = words.filter(pc.and_(pc.greater(size, 0), pc.less_equal(size, LONG_WORD)))
    return pa.concat_tables([short, pa.table([pa.array([r.encode() for r in runs[0]], pa.large_binary()), *(pa.array(list(of.values()), pa.int64()) for of in runs)], short.column_names)])


def counted_rows(batches: Iterable, most: int):
    """Batches of lang, word, n0, n1, for batches of (lang, fold, text): each word of a language once, unless there are too many to hold."""
    import pyarrow as pa

    def added_up(words: list):
        sums = pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n0", "sum"), ("n1", "sum")])
        return sums.select(["word", "n0_sum", "n1_sum"]).rename_columns(["word", "n0", "n1"])

    def sent():
        for lang, words in held.items():
            out = _short_words(added_up(words))
            out = out.set_column(0, "word", out["word"].cast(pa.string())).add_column(0, "lang", pa.repeat(pa.scalar(lang, pa.string()), len(out)))
            yield from out.combine_chunks().to_batches(max_chunksize=10_000)
        held.clear()

    held: dict[str, list] = {}
    size = lambda: sum(len(w) for words in held.values() for w in words)
    for b in slices(batches):
        texts: dict[tuple[str, int], list[str]] = {}
        for lang, fold, text in zip(*(c.to_pylist() for c in b.columns)):
            texts.setdefault((lang, fold), []).append(text)
        for (lang, fold), own in texts.items():
            held.setdefault(lang, []).append(counted_words(own, fold))
        if size() > most:
            for lang, words in held.items():
                held[lang] = [added_up(words)]
            if 2 * size() > most:
                yield from sent()
    yield from sent()
    give_back()


def word_counts(rows: DataFrame) -> DataFrame:
    """lang, word, n0, n1: occurrences in the rows (lang, fold, text) of each fold."""
    ship(rows.sparkSession)

    def run(batches):
        yield from counted_rows(batches, MOST_DISTINCT)

    return rows.select("lang", "fold", "text").mapInArrow(run, "lang string, word string, n0 long, n1 long").groupBy("lang", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def dictionaries(words: DataFrame) -> DataFrame:
    """learned, lang, dictionary: of fold 0, of fold 1 and of both (2), each language's most frequent words in rising order.

    Levels of about equal counts are filled up from the top; of the level that no longer fits, a share goes in by a hash of the word.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("learned"), n.alias("n")) for k, n in enumerate((F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")))]))
    rows = words.withColumn("each", each).select("lang", "word", "each.learned", "each.n").filter("n > 0").withColumn("level", F.floor(F.log2("n") * 8))
    levels = rows.groupBy("learned", "lang", "level").agg(F.sum(F.octet_length("word") + 1).alias("size"))
    above = F.coalesce(F.sum("size").over(Window.partitionBy("learned", "lang").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = levels.select("learned", "lang", "level", ((DICT_BYTES - above) / F.col("size")).alias("share"))  # some hundred levels a language
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / (1 << 30)
    kept = rows.join(F.broadcast(shares), ["learned", "lang", "level"]).filter(place < F.col("share"))
    return kept.groupBy("learned", "lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "word"))), lambda x: x["word"]), " ").alias("dictionary"))  # about DICT_BYTES in a group


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Dictionaries and the scale of least margins; learns from all rows that are not held out."""
    fold = F.pmod(F.xxhash64(F.col(text_col), F.lit(5)), F.lit(2)).cast("int")
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), fold.alias("fold"), F.col(text_col).alias("text"))
    most = [r["lang"] for r in rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()]
    if not most:
        return Model()
    rows = rows.filter(F.col("lang").isin(most))
    words = materialize(word_counts(rows), "words")
    found = {(r["learned"], r["lang"]): r["dictionary"].encode() for r in dictionaries(words).collect()}  # at most 3 * MOST_LANGUAGES of about DICT_BYTES
    discard(words)
    half, other, model = (Model((lang, found[k, lang]) for lang in most if (k, lang) in found) for k in range(3))
    model.scale = _scale(rows, (other, half))
    return model


def _scale(rows: DataFrame, models: tuple[Model, Model]) -> float:
    """What least margins are made of, from all rows (lang, fold, text), each predicted by the model of its fold, which has not learned it."""
    ship(rows.sparkSession)
    packed = rows.sparkSession.sparkContext.broadcast(tuple(map(tuple, models)))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            margins = _right_margins(packed.value, list(zip(*(c.to_pylist() for c in b.columns))))
            yield pa.RecordBatch.from_arrays([pa.array(margins, pa.float64())], ["margin"])
        _rest()

    right = materialize(rows.mapInArrow(run, "margin double"), "margins")
    scale = MARGIN_SHARE * order_statistics(right, {"margin": F.col("margin")}, [MARGIN_QUANTILE])["margin"][0] if right.count() >= LEAST_RIGHT else 0.0
    discard(right)
    return scale


def _right_margins(models: tuple, rows: list[tuple[str, int, str]]) -> list[float]:
    """Margin times root of the bytes of each right prediction of rows (lang, fold, text).

    The folds go one after the other: the tables of both models don't fit the processor's caches together.
    """
    margins: list[float] = []
    for k, model in enumerate(models):
        own = [(lang, text) for lang, fold, text in rows if fold == k]
        found = _encoded(model, (text for _, text in own))
        margins += [margin * math.sqrt(n) for (lang, _), (pred, _, margin, n) in zip(own, found) if lang == pred]
    return margins


def least_margin(scale: float, n_bytes: int) -> float:
    """The least margin of a text of n_bytes: chance moves sizes by the square root of the length."""
    return max(LEAST_MARGIN, scale / math.sqrt(max(1, n_bytes)))


@lru_cache(2)
def _compressors(model: tuple[tuple[str, bytes], ...]) -> list:
    import zstandard

    out = []
    for _, data in model:
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(data), window_log=(len(data) + 2 * BLOCK_BYTES).bit_length(), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        data = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
    return out


def _rest() -> None:
    """Let go of the compressors when a task ends: the worker waits idle beside those of later stages."""
    _compressors.cache_clear()
    give_back()


def _sizes(model: tuple[tuple[str, bytes], ...], texts: list[bytes]) -> Iterable[tuple[int, ...]]:
    """Bytes of each whole text under each dictionary, summed over its blocks; each dictionary encodes all texts before the next."""
    cut = []
    for data in texts:
        n = max(1, len(data) // BLOCK_BYTES)
        cut.append([data[len(data) * i // n : len(data) * (i + 1) // n] for i in range(n)])
    return zip(*([sum(len(c.compress(b)) for b in blocks) for blocks in cut] for c in _compressors(model)))


def _found(model: tuple[tuple[str, bytes], ...], sizes: tuple[int, ...], n_bytes: int) -> tuple[str, float, float, int]:
    best = min(sizes)
    at = sizes.index(best)
    rest = sorted(sizes)[1] if len(sizes) > 1 else 2 * best
    score = 1 / sum(math.exp(-min(700.0, (s - best) / 2)) for s in sizes)
    return model[at][0], score, (rest - best) / max(rest, 1), n_bytes


def _encoded(model: tuple[tuple[str, bytes], ...], texts: Iterable[str | None]) -> Iterator[tuple[str, float, float, int]]:
    """(language, score, margin, bytes encoded) of each text, in their order."""

    def turn():
        sizes = iter(_sizes(model, [d for d in held if d is not None]))
        for data in held:
            yield (UNKNOWN, 0.0, 0.0, 0) if data is None else _found(model, next(sizes), len(data))
        held.clear()

    held: list[bytes | None] = []
    size = 0
    for text in texts:
        held.append(prepare(text) if model and text is not None and any(map(str.isalpha, text)) else None)
        size += len(held[-1] or b"")
        if size >= TURN_BYTES:
            yield from turn()
            size = 0
    yield from turn()


def classify(model: tuple[tuple[str, bytes], ...], text: str | None) -> tuple[str, float, float]:
    """(language, score, margin)"""
    return next(_encoded(model, [text]))[:3]


def judged(model: tuple[tuple[str, bytes], ...], scale: float, texts: Iterable[str | None]) -> Iterator[tuple[str, float, float, bool]]:
    """(language, score, margin, rejected) of each text, in their order."""
    for lang, score, margin, n in _encoded(model, texts):
        yield lang, score, margin, lang == UNKNOWN or margin < least_margin(scale, n)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of each row; only the text enters a prediction."""
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((tuple(model), getattr(model, "scale", Model.scale)))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            rows = list(judged(*packed.value, b.column(2).to_pylist()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "margin", "rejected"])
        _rest()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is identified, with all their columns."""
    ship(docs.sparkSession)
    packed = docs.sparkSession.sparkContext.broadcast((tuple(model), getattr(model, "scale", Model.scale)))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            yield b.filter(pa.array([not rejected for *_, rejected in judged(*packed.value, b.column(at).to_pylist())], pa.bool_()))
        _rest()

    return docs.mapInArrow(run, docs.schema)
