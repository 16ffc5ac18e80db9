"""SentencePiece BPE encoding and decoding by a table of last tokens.

Every prefix of a text has one encoding, so one last token. A token that ends at a
place (an Aho-Corasick automaton over the vocabulary gives all of them) is the last
one there if it is compatible with the last token of the prefix before it: merging
the two tokens' characters gives back just these two. The table is filled from
left to right, then the ids are read off backwards; nothing is merged in the text
itself, and the work is linear in its length.

No piece of the vocabularies taken has another character before a word mark, so
texts are encoded unit by unit: the marks of a word and the word. A worker
remembers the ids of units and the compatibility of pairs, each up to a bound.
Characters that no piece has are given as bytes and meet no other token.

Taken are BPE models that change texts only by a mark in front and marks for
blanks, with a piece for each byte; others are refused (ValueError). Decoding takes
the first mark off, joins bytes to characters, and puts U+FFFD for a byte that
belongs to none; begin and end ids show nothing.

Defined cases: a null text counts as empty; an empty text has only begin and end
ids; extra columns are ignored; rows that repeat an identifier, or whose identifier
is null, are encoded each. A text is held whole by one task with its ids.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_groups import slices
from .ship import ship

MARK = "▁"
#: Units and pairs that a worker remembers (some 300 and 100 bytes each).
UNITS, PAIRS = 1 << 18, 1 << 19
#: A longer unit is not remembered.
LONGEST = 64


class Vocabulary:
    """Pieces, scores and bytes of a model."""

    def __init__(self, model: bytes) -> None:
        import ahocorasick
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = lib.get_piece_size()
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.unknown_shown = lib.decode([self.unknown]).encode()
        names = [lib.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        self.scores = {names[i]: lib.get_score(i) for i in plain}
        self.names = names
        self.lengths = [len(n) for n in names]
        self.chars = frozenset(n for n in self.ids if len(n) == 1)
        of_byte = {int(names[i][3:5], 16): i for i in range(self.size) if lib.is_byte(i)}
        probe = " \t  Ａ①ﬁ́ b  \n"
        if self.begin < 0 or self.end < 0 or len(of_byte) != 256 or lib.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("the model changes texts, or lacks bytes or marks of begin and end")
        if any(MARK in n.lstrip(MARK) or not self.chars.issuperset(n) for n in self.ids):
            raise ValueError("a piece holds a mark within a word, or a character that is no piece")
        self.bytes = [of_byte[b] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        apart = "".join(map(re.escape, self._apart()))
        self.units = re.compile(f"{MARK}*(?:[^{MARK}{apart}]+" + f"|[{apart}]+" * bool(apart) + f")|{MARK}+")

    def _apart(self) -> list[str]:
        """Characters other than letters that no piece joins with the rest: a run of them is a unit, so words before it are remembered as others are."""
        apart = {c for c in (*self.chars, *"\t\n\v\f\r") if not c.isalpha() and c != MARK}
        while True:
            mixed = [set(n.lstrip(MARK)) for n in self.ids if not apart.isdisjoint(n) and not apart.issuperset(n.lstrip(MARK))]
            if not mixed:
                return sorted(apart)
            apart.difference_update(*mixed)


class _Pairs(dict):
    """Whether two tokens stand side by side in an encoding, by left id * size + right id; a left id of -1: the right one by itself."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, key: int) -> bool:
        left, right = divmod(key, self.vocabulary.size)
        names = self.vocabulary.names
        if len(self) > PAIRS:
            self.clear()
        value = self[key] = self.kept("" if left < 0 else names[left], names[right])
        return value

    def kept(self, a: str, b: str) -> bool:
        """Whether merging the characters of a and b, best score first and leftmost of equal ones, ends in a and b."""
        scores = self.vocabulary.scores
        parts, none = list(a + b), float("-inf")
        cut = len(a)  # parts left of the cut are of a
        worth = [scores.get(x + y, none) for x, y in zip(parts, parts[1:])]
        while worth:
            best = max(worth)
            if best == none:
                break
            k = worth.index(best)
            if k == cut - 1:
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            cut -= k < cut
            del worth[k]
            if k:
                worth[k - 1] = scores.get(parts[k - 1] + parts[k], none)
            if k < len(worth):
                worth[k] = scores.get(parts[k] + parts[k + 1], none)
        return len(parts) == 1 + bool(a)


class Encoder(dict):
    """The ids of each unit met; one for each worker and vocabulary."""

    def __init__(self, model: bytes) -> None:
        super().__init__()
        self.vocabulary = Vocabulary(model)
        self.pairs = _Pairs(self.vocabulary)

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.unit(unit)
        if len(unit) <= LONGEST:
            if len(self) > UNITS:
                self.clear()
            self[unit] = ids
        return ids

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit: the table of last tokens, read backwards."""
        v, pairs = self.vocabulary, self.pairs
        size, lengths = v.size, v.lengths
        last = [None] * (len(unit) + 1)
        last[0] = -1
        if not v.chars.issuperset(unit):
            for k, c in enumerate(unit, 1):
                if c not in v.chars:
                    last[k] = -1  # meets no other token, like the start
        for at, token in v.automaton.iter(unit):
            if last[at + 1] is None and pairs[last[at + 1 - lengths[token]] * size + token]:
                last[at + 1] = token
        out, at = [], len(unit)
        while at:
            token = last[at]
            if token < 0:
                out += [v.bytes[b] for b in reversed(unit[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= lengths[token]
        return tuple(out[::-1])

    def encode(self, text: str) -> list[int]:
        """All ids of a text, begin and end with it."""
        v = self.vocabulary
        units = v.units.findall(MARK + text.replace(" ", MARK)) if text else ()
        return [v.begin, *chain.from_iterable(map(self.__getitem__, units)), v.end]

    @property
    def decoder(self) -> Decoder:
        if not hasattr(self, "_decoder"):
            self._decoder = Decoder(self.vocabulary)
        return self._decoder


class Decoder:
    """Texts from ids."""

    def __init__(self, v: Vocabulary) -> None:
        self.vocabulary = v
        self.shown = [b""] * v.size
        for name, i in v.ids.items():
            self.shown[i] = name.replace(MARK, " ").encode()
        for b, i in enumerate(v.bytes):
            self.shown[i] = bytes([b])
        self.is_byte = np.zeros(v.size, bool)
        self.is_byte[v.bytes] = True
        self.shown[v.unknown] = v.unknown_shown
        self.hidden = {v.begin, v.end}
        self.blank_first = {i for name, i in v.ids.items() if name.startswith(MARK)}

    def decode(self, ids: list[int]) -> str:
        if any(i < 0 or i >= self.vocabulary.size for i in ids):
            raise ValueError("an id that the model does not have")
        first, end = 0, len(ids)
        while first < end and ids[first] in self.hidden:
            first += 1
        while first < end and ids[end - 1] in self.hidden:
            end -= 1
        rest = ids[first:end]
        raw = b"".join(map(self.shown.__getitem__, rest))
        if rest and rest[0] in self.blank_first:
            raw = raw[1:]
        return raw.decode("utf-8") if self.hidden.isdisjoint(rest) and _valid(raw) else self._mended(rest)

    def _mended(self, ids: list[int]) -> str:
        """As above where runs of bytes are no whole characters: a byte that belongs to none is one U+FFFD. A hidden id ends a run."""
        out, run = [], bytearray()
        for i in [*ids, self.vocabulary.end]:
            if self.is_byte[i]:
                run += self.shown[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if len(run) >= k and _valid(run[:k])), 0)
                out.append(run[:size].decode() if size else "\ufffd")
                del run[: size or 1]
            if i not in self.hidden:
                text = self.shown[i].decode()
                out.append(text[1:] if i in self.blank_first and not any(out) else text)
        return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(2)
def encoder(model: bytes) -> Encoder:
    return Encoder(model)


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read()
    Vocabulary(model)  # refused here rather than in a task
    return model


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>, begin and end with them) of each row's text.

    The model is read on the driver and goes to the workers with the function (half a megabyte).
    """
    ship(docs.sparkSession)
    model = _model(model_path)

    def run(batches):
        import pyarrow as pa

        codec = encoder(model)
        for b in slices(batches):
            ids = [codec.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text, ids that the model lacks an error."""
    ship(encoded.sparkSession)
    model = _model(model_path)

    def run(batches):
        import pyarrow as pa

        decoder = encoder(model).decoder
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decoder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each row's text: doc_id, n_tokens, ids_sha256, decoded_sha256, restored (the decoded text is the row's)."""
    ship(docs.sparkSession)
    model = _model(model_path)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean"

    def run(batches):
        import pyarrow as pa

        codec = encoder(model)
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in slices(batches):
            rows = []
            for text in b.column(1).to_pylist():
                ids = codec.encode(text or "")
                back = codec.decoder.decode(ids)
                rows.append((len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back.encode()), back == (text or "")))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], [c.split()[0] for c in schema.split(", ")])

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)
