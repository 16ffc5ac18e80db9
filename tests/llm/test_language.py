"""Language identification learns from every labelled row that is not held out."""

from __future__ import annotations

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import cases  # noqa: E402
from marlstone.llm import language_id  # noqa: E402

SCHEMA = "doc_id long, text string, lang string"


def words_of(spark, rows):
    fold = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).cast("int")
    return spark.createDataFrame(rows, "text string, lang string").repartition(3).select("lang", fold.alias("fold"), "text")


def test_words_are_counted_over_all_rows(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_DISTINCT", 50)
    rng = random.Random(1)
    rows = [(" ".join(f"W{rng.choice('abcdefgh') * rng.randint(1, 3)}, " for _ in range(rng.randint(0, 40))), rng.choice(["x", "y"])) for _ in range(1500)]
    rows += [("漢字" * 30, "x"), ("12 3", "y"), (rows[0][0], rows[0][1])]
    frame = words_of(spark, rows)
    want = {}
    for r in frame.collect():
        for word in language_id.prepare(r["text"]).decode().split():
            for run in [word] if len(word.encode()) <= language_id.LONG_WORD else [word[i : i + language_id.RUN] for i in range(len(word) - language_id.RUN + 1)]:
                want.setdefault((r["lang"], run), [0, 0])[r["fold"]] += 1
    assert {(r["lang"], r["word"]): [r["n0"], r["n1"]] for r in language_id.word_counts(frame).collect()} == want


def test_every_row_is_in_the_dictionary(spark):
    letters = [f"{a}{b}{c}" for a in "bcdfghjklm" for b in "aeiou" for c in "nprst"]
    rows = [(i, f"{letters[i % 250]}{letters[i // 250]} common", "en") for i in range(1500)]
    model = language_id.fit(spark.createDataFrame(rows, SCHEMA))
    found = model[0][1].split()
    assert Counter(found) == Counter({t.split()[0].encode(): 1 for i, t, _ in rows if not cases.held(i)} | {b"common": 1})
    assert found[-1] == b"common"


def test_a_full_dictionary_holds_the_most_frequent_words(spark, monkeypatch):
    monkeypatch.setattr(language_id, "DICT_BYTES", 2000)
    words = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    counts = {w: 500 if k < 100 else 3 for k, w in enumerate(words)}
    frame = spark.createDataFrame([("en", w, n, 0) for w, n in counts.items()], "lang string, word string, n0 long, n1 long")
    found = {r["learned"]: r["dictionary"].split() for r in language_id.dictionaries(frame).collect()}
    assert found[0] == found[2] and 1 not in found and set(words[:100]) <= set(found[0])
    assert 1500 < sum(len(w) + 1 for w in found[0]) < 2500
    assert [counts[w] for w in found[0]] == sorted(counts[w] for w in found[0])


def test_margins_are_those_of_all_training_rows(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(300)] for lang, letters in (("aa", "aeionrstlu"), ("bb", "aeiomkpdgz"))}
    rows = [(i, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(["aa", "bb"] * 1000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {}
    scale = language_id._scale
    monkeypatch.setattr(language_id, "_scale", lambda frame, models: kept.update(rows=frame.collect(), models=models) or scale(frame, models))
    model = language_id.fit(docs)
    assert len(kept["rows"]) == sum(not cases.held(i) for i, _, _ in rows)
    right = []
    for r in kept["rows"]:
        learned = kept["models"][r["fold"]]
        others = Counter(w for x in kept["rows"] if x["fold"] != r["fold"] and x["lang"] == r["lang"] for w in language_id.prepare(x["text"]).split()) if not right else None
        assert others is None or Counter(dict(learned)[r["lang"]].split()) == Counter(dict.fromkeys(others, 1))
        lang, _, margin = language_id.classify(tuple(learned), r["text"])
        if lang == r["lang"]:
            right.append(margin * len(language_id.prepare(r["text"])) ** 0.5)
    assert model.scale == pytest.approx(language_id.MARGIN_SHARE * np.percentile(right, 100 * language_id.MARGIN_QUANTILE))


def test_a_task_sends_each_word_once(spark):
    import pyarrow as pa

    texts = ["One two, two " + "漢字" * 20, "two THREE", None, "", "12 !?"]
    rows = [(lang, fold, text) for lang in ("x", "y") for fold in (0, 1) for text in texts if text is not None] * 20
    batches = lambda: iter(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 30])], ["lang", "fold", "text"]) for i in range(0, len(rows), 30))
    sent = lambda most: [tuple(r.values()) for b in language_id.counted_rows(batches(), most) for r in b.to_pylist()]
    once = sent(1 << 20)
    words = {"one": 20, "two": 60, "three": 20, "漢字漢字": 19 * 20, "字漢字漢": 18 * 20}
    assert Counter(once) == Counter((lang, word, n, n) for lang in ("x", "y") for word, n in words.items())
    often, sums = sent(4), {}
    for lang, word, *counts in often:
        sums[lang, word] = [a + b for a, b in zip(sums.get((lang, word), (0, 0)), counts)]
    assert len(often) > len(once) and {(*k, *v) for k, v in sums.items()} == set(once)


def test_a_dictionary_encodes_many_texts_in_turn(monkeypatch):
    rng = random.Random(4)
    words = {lang: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(300)] for lang, letters in (("aa", "abcdefg"), ("bb", "abcxyz"))}
    prose = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    models = tuple(tuple((lang, prose(lang, 2000).encode()) for lang in ("aa", "bb")) for _ in range(2))
    rows = [(rng.choice(["aa", "bb"]), rng.randint(0, 1), prose(rng.choice(["aa", "bb"]), rng.choice([0, 3, 200, 9000]))) for _ in range(60)]
    compressors, calls = language_id._compressors, []

    class Called:
        def __init__(self, compressor, at):
            self.compressor, self.at = compressor, at

        def compress(self, data):
            calls.append(self.at)
            return self.compressor.compress(data)

    monkeypatch.setattr(language_id, "_compressors", lambda model: [Called(c, (model, k)) for k, c in enumerate(compressors(model))])
    got = language_id._right_margins(models, rows)
    turns = 1 + sum(a != b for a, b in zip(calls, calls[1:]))
    assert turns <= 4 * (1 + sum(len(t) for _, _, t in rows) // language_id.TURN_BYTES) < len(calls) / 4
    alone = [(lang, fold, text, *language_id.classify(models[fold], text)) for lang, fold, text in rows]
    assert sorted(got) == sorted(margin * len(language_id.prepare(text)) ** 0.5 for lang, _, text, pred, _, margin in alone if lang == pred) and len(got) > 10
