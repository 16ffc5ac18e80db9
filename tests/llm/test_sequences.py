"""Pieces, resampling and periodic runs against the library, brute force and SQL."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402
from marlstone.llm import importance, oracle, periodic_runs, piece_bpe, queries  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    null_ids = [(None, "of the of the of the of the", "en", "s1", 27, "row", 1), (None, "of the end", "en", "s1", 10, "row", 1), (None, None, None, None, None, "row", 1)]
    tail = " ".join(["again and"] * 40)
    return [*cases.documents(), *null_ids, *[(200 + i, f"start {i} {tail}", "en", "hot", 1, "row", 1) for i in range(20)]]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sequences") / "documents.parquet")
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3, "row_number", "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], cases.SCHEMA)


# --- pieces


@pytest.fixture(scope="module")
def model():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary(queries.PIECES)


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def encoder(model):
    return piece_bpe.encoder(Path(model).read_bytes())


def test_pieces_are_the_librarys_ids(encoder, library):
    rng = random.Random(1)
    parts = [*" ▁\n\tabcdeéÀ中文字😀𐀀\x00.,;'\"<>/s", "  ", "▁▁▁", "the", "ing", " " * 12, "<s>", "</s>", "<0x41>", "<unk>", "é", "...", "1234"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(4000)]
    texts += [" " * n for n in range(80)] + ["a" * 5000, "中" * 3000, "the" * 2000, "\n" * 500, "word " * 5000]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode(text, add_bos=True, add_eos=True), text
        assert encoder.decoder.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(encoder, library):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.choice([0, 1, 2, 29871, 259])]) for _ in range(rng.randint(0, 8))]
        assert encoder.decoder.decode(ids) == library.decode(ids), ids
    with pytest.raises(ValueError):
        encoder.decoder.decode([32000])


def test_memory_of_units_and_pairs_is_bounded(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "UNITS", 3)
    monkeypatch.setattr(piece_bpe, "PAIRS", 5)
    small = piece_bpe.Encoder(Path(model).read_bytes())
    text = " ".join(f"word{i} other" for i in range(300))
    assert small.encode(text) == library.encode(text, add_bos=True, add_eos=True)
    assert len(small) <= 4 and len(small.pairs) <= 6


def test_every_row_is_encoded(docs, rows, nothing, model, library):
    got = piece_bpe.round_trip(docs, model).collect()
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((str(r[0]), len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert sorted((str(r[0]), *r[1:4]) for r in got) == sorted(want)
    assert piece_bpe.round_trip(nothing, model).count() == 0
    encoded = piece_bpe.encode(docs, model)
    texts = piece_bpe.decode(encoded, model).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in texts) == sorted((str(r[0]), r[1] or "") for r in rows)


# --- resampling


def grams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def drawn(rows, targets):
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    found = [(r[0], *grams(r[1])) for r in rows]
    s = Counter(bucket(g) for _, _, gs in found for g in gs)
    t = Counter(bucket(g) for text in targets for g in grams(text)[1])
    all_s, all_t = float(s.total()), float(t.total())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, n, gs in found:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in gs)
        out.append([doc_id, n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(may[: 5 * len(may) // 100])}
    return [(r[0], *r[2:], ranks.get(id(r))) for r in out]


TARGETS = ["again and again", "and again and", None, ""]


@pytest.mark.parametrize("slot_bytes", [12 << 20, 2000])
def test_resampling_is_brute_force(spark, docs, rows, monkeypatch, slot_bytes):
    monkeypatch.setattr(importance, "SLOT_BYTES", slot_bytes)
    target = spark.createDataFrame([(t, 1) for t in TARGETS], "text string, doc_id int")
    got = importance.digest(importance.resample(docs, target)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(drawn(rows, TARGETS), key=key)


def test_resampling_of_nothing_and_towards_nothing(spark, docs, rows, nothing):
    target = spark.createDataFrame([(t,) for t in TARGETS], "text string")
    assert importance.resample(nothing, target).count() == 0
    got = importance.digest(importance.resample(docs, target.limit(0))).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(drawn(rows, []), key=key)


@pytest.mark.parametrize("slots", [1, 7, 50])
def test_slots_hold_each_string_once_and_hot_pairs_are_spread(slots, monkeypatch):
    rng = random.Random(3)
    words = ["a", "b", "the", "éa", "x" * 200, "foo9", "Zed", "日本", "y" * 64, "y" * 65] + [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words[:10] if rng.random() < 0.5 else words) for _ in range(rng.choice([0, 1, 2, 3, 50, 300]))) for _ in range(120)]
    blobs, alone = {}, Counter()
    for part in range(3):
        block = importance.Block()
        for text in texts[part::3]:
            block.add(importance.split_words(text.encode()))
        marks = importance._word_marks(list(block.known))
        ids, two, _ = block.runs()
        found, count = np.unique(importance._pair_mark(marks[ids[two]], marks[ids[two + 1]]), return_counts=True)
        dealt = importance._Slots(block, slots, found[count > 10] if part == 0 else hot)
        hot = found[count > 10] if part == 0 else hot
        for s in range(slots):
            if (blob := dealt.pack(s)) is not None:
                blobs.setdefault(s, []).append(blob)
    for s, parts in blobs.items():  # a distinct string is counted in one slot only
        held = set()
        for blob in parts:
            listed, (one, _, a, b, twos, longer, c, _) = importance._unpack(blob)
            held |= {listed[i] for i in one} | {listed[i] + b" " + listed[j] for i, j, n in zip(a, b, twos) if n}
            of = np.repeat(np.arange(len(a)), longer)
            held |= {b" ".join((listed[a[k]], listed[b[k]], listed[z])) for k, z in zip(of, c)}
        alone.update(held)
    assert len(hot) and set(alone.values()) == {1}
    sums = sum(importance.merged(parts, 10000) for parts in blobs.values())
    want = Counter(zlib.crc32(g.encode()) % 10000 for text in texts for g in grams(text)[1])
    assert {b: int(n) for b, n in enumerate(sums) if n} == want


# --- runs


def runs_of(words, exponent, least):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            part = words[start : i + q]
            if len(part) >= max(least, exponent * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_are_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        block = []
        for _ in range(rng.randint(1, 6)):
            kinds, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 10, 30, 60, 120])
            words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
            if rng.random() < 0.4 and n:
                p, a = rng.randint(1, max(1, n // 5)), rng.randrange(n)
                words[a:] = [words[a + i % min(p, n - a)] for i in range(n - a)]
            block.append(words)
        exponent, least = rng.choice([2, 3, 4]), rng.choice([2, 6])
        for words, (runs, stays) in zip(block, periodic_runs.runs_of(block, exponent, least), strict=True):
            assert runs == runs_of(words, exponent, least)
            assert stays == collapsed(words, runs)


@pytest.mark.parametrize("visits", [4096, 1 << 20])
def test_long_runs(visits, monkeypatch):
    monkeypatch.setattr(periodic_runs, "VISITS", visits)
    one = [b"a"] * 30_000
    two = [b"%d" % (i % 7_000) for i in range(29_000)]
    (runs, stays), (more, left) = periodic_runs.runs_of([one, two])
    assert runs == [(0, 30_000, 1)] and stays == [b"a"]
    assert more == [(0, 29_000, 7_000)] and left == two[:7_000]


def planted(doc_id, text):
    words = cases.WORD.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_every_row_has_its_runs(docs, rows, nothing):
    query = lambda df: periodic_runs.digest(periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(df)))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want, n_planted = [], 0
    for r in rows:
        words = planted(r[0], r[1])
        n_planted += words != cases.WORD.findall(r[1] or "")
        if len(words) > 3000:
            runs = next(periodic_runs.runs_of([[w.encode() for w in words]]))[0]
        else:
            runs = runs_of(words, 4, 6)
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((r[0], len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(collapsed(words, runs)))))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, query(docs).collect()), key=key) == sorted(want, key=key)
    assert n_planted and query(nothing).count() == 0


def test_the_strongest_run_is_found_exactly(spark):
    third = [(5, 10**9 + 1, 3 * 10**8), (0, 10**9, 3 * 10**8), (2, 20, 6), (2, 10, 3)]
    df = spark.createDataFrame([([dict(zip(("start", "length", "period"), r)) for r in third],), ([],), (None,)], "runs array<struct<start:long,length:long,period:long>>")
    best = [r[0] for r in df.select(periodic_runs.strongest(F.col("runs"))).collect()]
    assert tuple(best[0]) == third[0] and best[1:] == [None, None]
    best = df.select(periodic_runs.strongest(F.slice("runs", 2, 3)).alias("r")).first()["r"]
    assert tuple(best) == (0, 10**9, 3 * 10**8)


@pytest.mark.parametrize("name", ["op12_importance", "op13_periodic_runs"])
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, sf_dir), con.sql(oracle.ORACLE_SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)
