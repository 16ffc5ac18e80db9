"""Texts built to collide, identifiers that are null or repeat, clashing names, ties, and plain loops for what SQL cannot say."""

import hashlib
import math
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402
from marlstone.llm import bpe, embedding_dedup, exact_dedup, jaccard_join, language_id, mixing, queries, secrets, sharding, toxicity, warc, words  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, mark string, row string, _sha string, _text string, its_id string, copies int"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with columns that clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", s, None, "m", "r", f"sha{k}", f"text{k}", "x", 7) for k, (i, t, s) in enumerate(rows)], DOCS).repartition(3, "_sha")


def complementary(n):
    """Two different words of a and b whose polynomial hashes modulo 2 ** 64 agree, whatever the base."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


PROSE = "the quick brown fox jumps over the lazy dog while many other animals look on and wonder what it is all about today"
ROWS = [
    *[(k, w, "s") for k, w in enumerate([*complementary(1024), *complementary(4096)])],
    (None, PROSE, "s"), (None, PROSE + " again", "t"), (20, PROSE + " again and", "s"), (21, PROSE.replace("quick", "slow"), None),
    (None, "alone without any identifier here", "s"), (None, "alone without any identifier here", "s"),
    (30, "same id", "s"), (30, "other text of that id", "s"), (30, "other text of that id", "s"), (31, "other  text of that id", "s"),
    (40, "a a a a a a", "s"), (41, "a a a a a a a a a", "s"), (50, None, "s"), (None, None, None), (51, "", "s"), (52, "\t", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).cache()


def test_colliding_pieces_get_their_own_ids(docs):
    tiktoken, public_tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = queries.vocabulary()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(Path(path).read_bytes()), special_tokens={})
    want = Counter((i, hashlib.sha256(np.array(own.encode_ordinary(t or ""), "<u4").tobytes()).hexdigest()) for i, t, _ in ROWS)
    got = bpe.round_trip(docs, path).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == want and all(r["restored"] for r in got)


def test_long_texts_are_cut_between_pieces(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    pytest.importorskip("public_tokenizers")
    data = Path(queries.vocabulary()).read_bytes()
    codec, own = bpe.encoder(data), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    monkeypatch.setattr(bpe, "BLOCK", 50)
    rng = np.random.default_rng(5)
    for _ in range(60):
        text = "".join(rng.choice(list(" '\n\t sStTreveLLd1!é"), int(rng.integers(100, 900))))
        ids = next(codec.encode(iter([text])))
        assert ids.tolist() == own.encode_ordinary(text) and codec.decode(ids).decode() == text


def classes(rows):
    sets = [cases.shingle_set(t) for _, t, _ in rows]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return bool(sets[a] and sets[b]) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)

    by_row, names = cases.components(range(len(rows)), linked), defaultdict(list)
    for k, c in by_row.items():
        names[c].append(rows[k][0])
    least = {c: min((i for i in ids if i is not None), default=None) for c, ids in names.items()}
    return [(rows[k][0], len(sets[k]), least[by_row[k]]) for k in range(len(rows))], sets, by_row


@pytest.mark.parametrize("pivots", [64, 0])
def test_classes_join_through_rows_without_identifier(docs, monkeypatch, pivots):
    monkeypatch.setattr(jaccard_join, "CORPUS_PIVOTS", pivots)
    want, _, _ = classes(ROWS)
    assert Counter(map(tuple, jaccard_join.jaccard_classes(docs).collect())) == Counter(want)


def test_a_large_group_around_a_pivot_keeps_its_ring(spark, monkeypatch):
    """Sets at all distances from a pivot, so that windows and the remote region hold pairs."""
    monkeypatch.setattr(jaccard_join, "ROWS_OF_REGION", 4)
    monkeypatch.setattr(jaccard_join, "ROWS_OF_CHUNK", 4)
    monkeypatch.setattr(jaccard_join, "CORPUS_PIVOTS", 2)
    rng, base, rows = np.random.default_rng(6), [f"w{i}" for i in range(60)], []
    for k in range(90):
        words_ = base[k // 3 :] + [f"n{k // 5}_{i}" for i in range(k // 3)]
        if k % 4 == 0:
            words_[int(rng.integers(0, 60))] = f"x{k}"
        rows.append((k, " ".join(words_), "s"))
    want, _, by_row = classes(rows)
    assert 3 < len(set(by_row.values())) < 60
    assert Counter(map(tuple, jaccard_join.jaccard_classes(frame(spark, rows)).collect())) == Counter(want)


def test_links_that_words_deny_start_the_join_again(docs, monkeypatch):
    tries, real = [], jaccard_join._false_links
    monkeypatch.setattr(jaccard_join, "_false_links", lambda d, n, e: (tries.append(1), real(d, n, e) if len(tries) > 1 else e)[1])
    want, _, _ = classes(ROWS)
    assert Counter(map(tuple, jaccard_join.jaccard_classes(docs).collect())) == Counter(want) and len(tries) == 2


def test_kept_rows_are_those_of_the_keepers_and_keep_their_columns(docs):
    _, sets, by_row = classes(ROWS)
    kept = jaccard_join.keep_one(docs)
    texts = sorted(str(r["text"]) for r in kept.collect())
    want = []
    for c in set(by_row.values()):
        members = [ROWS[k] for k in by_row if by_row[k] == c]
        want += [str(t) for _, t, _ in members] if not sets[c] else [None]
    assert kept.columns == docs.columns and len(texts) == len(want) and "other text of that id" in texts
    whole = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in whole for r in kept.collect())


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_groups_with_null_and_repeated_identifiers(docs, digest_hex):
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[cases.normal(t)].append((i, t or ""))
    want = Counter()
    for members in groups.values():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want.update((i, keep, len(members)) for i, _ in members)
    got = exact_dedup.exact_dedup(docs, digest_hex=digest_hex).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want and sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.keep_one(docs)
    rows, whole = kept.collect(), {tuple(r) for r in docs.collect()}
    assert kept.columns == docs.columns and len(rows) == len(groups) and all(tuple(r) in whole for r in rows)
    assert [r["doc_id"] for r in rows if cases.normal(r["text"]) == "othertextofthatid"] == [31]  # more code points


def test_later_batches_probe_filters_and_find_earlier_digests(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_OF_FILTER", 16)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 40)
    index, probed, real = exact_dedup.DigestIndex(spark), [], exact_dedup.DigestIndex._probe
    monkeypatch.setattr(exact_dedup.DigestIndex, "_probe", lambda self, fresh: (probed.append((fresh.count(), (m := real(self, fresh)).count())), m)[1])
    rows = [(i, f"text {i % 150}", "s") for i in range(600)]
    for k in range(0, 600, 100):
        index.add(frame(spark, rows[k : k + 100]), flushes=1)
        entries = {r["digest"]: (r["keep_id"], r["group_size"]) for r in index.compact().collect()}
        want = defaultdict(list)
        for i, t, _ in rows[: k + 100]:
            want[hashlib.sha256(cases.normal(t).encode()).hexdigest()].append((-len(t), i))
        assert entries == {d: (min(m)[1], len(m)) for d, m in want.items()}
    assert 50 <= probed[0][1] <= 60 < probed[0][0] and len(index.generations) <= exact_dedup.MOST_GENERATIONS
    assert index.lookup().filter("group_size = 4").count() == 600


def test_directions_of_large_and_small_vectors(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e200, 2.0001e200], 1), (3, [1e-200, 2e-200], 1), (4, [2e200, -1e200], 1), (None, [1.0, 0.0], 2), (6, [0.97, 0.24], 2), (None, [0.85, 0.5], 2), (8, [0.7, 0.72], 2), (None, [5.0, 5.0], 3), (None, None, 3), (9, [1.0], None)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (None, 1, 6, False), (6, 2, 6, True), (None, 2, 6, False), (8, 1, 6, False), (None, 0, None, True), (None, 0, None, True), (9, 0, 9, True)])


@pytest.mark.parametrize("planned_for", [10**6, 10**8])
def test_recall_of_the_production_setting(spark, monkeypatch, planned_for):
    bits, tables = embedding_dedup.plan_tables(planned_for)
    assert bits >= 12
    monkeypatch.setattr(embedding_dedup, "plan_tables", lambda n, *_: (bits, tables))
    rng = np.random.default_rng(12)
    first = rng.normal(size=(1500, 64))
    first /= np.linalg.norm(first, axis=1)[:, None]
    away = rng.normal(size=first.shape)
    away -= (away * first).sum(axis=1)[:, None] * first
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = rng.uniform(0.9301, 0.94, 1500)[:, None]
    unit = np.concatenate([first, cosine * first + np.sqrt(1 - cosine**2) * away])
    label = np.tile(rng.integers(0, 5, 1500), 2)
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    links = near.sum(axis=1) - 1
    assert links.sum() >= 3000
    table = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(unit, label))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_dedup(table.repartition(4)).collect()}
    assert all(got[i] <= links[i] for i in got) and sum(got.values()) >= 0.99 * links.sum()


def mix_by_hand(spark, rows, seed=17):
    """Which copies fair queueing takes, with one queue after the other and exact fractions."""
    turns = [r["t"] for r in spark.createDataFrame([(k, i) for k, (i, _, _) in enumerate(rows)], "k int, doc_id long").orderBy("k").select(F.xxhash64("doc_id", F.lit(seed)).alias("t")).collect()]
    marks = [r["m"] for r in spark.createDataFrame([(k, t) for k, (_, t, _) in enumerate(rows)], "k int, text string").orderBy("k").select(F.xxhash64("text").alias("m")).collect()]
    sizes = [len(cases.WORD.findall(t or "")) for _, t, _ in rows]
    queues = defaultdict(list)
    for k, (_, _, s) in enumerate(rows):
        queues[s].append(k)
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    size = {s: sum(sizes[k] for k in queues[s]) for s in order}
    full, total = set(), sum(sizes)
    while True:
        left, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in order if s not in full)
        goal = {s: Fraction(3 * size[s]) if s in full else Fraction(left * weight[s], w) for s in order}
        over = {s for s in order if s not in full and goal[s] > 3 * size[s]}
        if not over:
            break
        full |= over
    copies = []
    for s in order:
        upto = 0
        for draw in range(3):
            for k in sorted((k for k in queues[s] if sizes[k]), key=lambda k: ((turns[k] >> 44) % mixing.SLICES, turns[k], rows[k][0] is not None, rows[k][0] or 0, marks[k])):
                upto += sizes[k]
                copies.append((upto / goal[s], s is not None, s or "", turns[k], rows[k][0] or 0, marks[k], draw, k))
    taken, left = Counter(), total
    for *_, k in sorted(copies):
        if sizes[k] > left:
            break
        left -= sizes[k]
        taken[k] += sizes[k]
    return Counter((rows[k][0], sizes[k], taken[k]) for k in range(len(rows)))


def test_mix_takes_the_copies_of_fair_queueing(spark):
    rng = np.random.default_rng(12)
    rows = [(int(i) if i % 9 else None, " ".join(["w"] * int(rng.integers(0, 40)) + [f"u{i}"]), ("a", "a", "a", "b", "c", None, "d")[int(rng.integers(0, 7))]) for i in range(150)] + [(3, "twice", "a"), (3, "twice again", "a"), (500, None, "b"), (501, "", None)]
    got = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.fair_mix(frame(spark, rows)).collect())
    assert got == mix_by_hand(spark, rows)
    again = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.fair_mix(frame(spark, rows[::-1]).repartition(7)).collect())
    assert got == again


def test_mixed_rows_keep_their_own_columns(docs):
    want = Counter()
    for r in mixing.fair_mix(docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    mixed = mixing.mixed(docs)
    rows, whole = mixed.collect(), {tuple(r) for r in docs.collect()}
    assert mixed.columns == docs.columns and all(tuple(r) in whole for r in rows)
    assert Counter((r["doc_id"], len(cases.WORD.findall(r["text"]))) for r in rows) == +want


def test_many_sources_are_filled(spark):
    rows = [(i, "w " * (i % 7 + 1), f"s{i:04d}") for i in range(300)]
    got = mixing.fair_mix(frame(spark, rows)).collect()
    assert sum(r["target"] for r in got) == pytest.approx(sum(r["size"] for r in got)) and all(r["target"] <= 3 * r["source_size"] + 1e-6 for r in got)


def test_values_in_many_documents_of_one_owner_are_examples(spark):
    value = "Zk9" + "abcDEF012" * 4
    rows = [(i, f"x {value} y", "hot") for i in range(30)] + [(99, "one Qw3" + "rtyUIO789" * 4, "hot"), (None, 'token = "aB3dE6gH9jK2"', None)]
    found = {r["doc_id"]: [(s["kind"], s["verdict"]) for s in r["secrets"]] for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert found[0] == [] and found[99] == [("opaque", "live")] and found[None] == [("assign", "live")]


def test_texts_with_very_many_matches(spark):
    text = " ".join(f"{i:032x}" for i in range(20_000))
    got = secrets.digest(secrets.scan_secrets(frame(spark, [(1, text, "s")]))).first()
    assert got["n_hex"] == 20_000 and got["base_sha256"] == hashlib.sha256(cases.base_spans(text).encode()).hexdigest()


def test_ftrl_steps_are_those_of_a_plain_loop():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["red", "blue", "vile", "Green", "old", "x"], int(rng.integers(0, 12)))).encode() for _ in range(80)] + [None, b""]
    labels = [int(b"vile" in (t or b"")) for t in texts]
    at, w = toxicity.train_shard(texts, labels)
    l1, z, n = toxicity.L1_OF_ROW * len(texts), defaultdict(float), defaultdict(float)
    bias = 1 << toxicity.BITS

    def places(text):
        h, bounds = words.hash_words([text or b""], words.PUNCTUATION)
        h = h.tolist()
        out = {x & bias - 1 for x in h} | {bias}
        for gap, odd in ((1, 3), (2, 7)):
            for a, b in zip(h, h[gap:]):
                out.add(int(words.mix(np.array([(a * odd + b + gap) % (1 << 64)], np.uint64))[0]) & bias - 1)
        return out

    def weight(i):
        if i != bias and abs(z[i]) <= l1:
            return 0.0
        return ((0 if i == bias else math.copysign(l1, z[i])) - z[i]) / ((1 + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for text, label in zip(texts, labels):
            here = {i: weight(i) for i in places(text)}
            g = 1 / (1 + math.exp(-sum(here.values()))) - label
            for i, v in here.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * v
                n[i] += g * g
    want = {i: v for i in list(z) if (v := weight(i))}
    assert set(at.tolist()) == set(want) and np.allclose(w, [want[i] for i in at.tolist()])
    dense = np.zeros(bias + 1)
    dense[at] = w
    assert np.allclose(toxicity.score_texts(dense, texts), [1 / (1 + math.exp(-sum(want.get(i, 0.0) for i in places(t)))) for t in texts])


def test_toxicity_does_not_depend_on_partitions_or_repeats(spark):
    rng = np.random.default_rng(8)
    rows = [(i if i % 11 else None, " ".join(rng.choice(["a", "b", "c", "vile"], 20)), "s") for i in range(120)] + [(5, "another text of five", "s")] * 3
    labels = [(i, int(i % 3 == 0)) for i in range(120)] + [(7, 1), (7, 1), (7, None), (None, 1)]
    schema = "doc_id long, toxic int"
    one = toxicity.fit(frame(spark, rows), spark.createDataFrame(labels, schema))
    two = toxicity.fit(frame(spark, rows[::-1]).repartition(9), spark.createDataFrame(labels[::-1] + labels, schema).repartition(5))
    assert one.any() and (one == two).all()


def test_language_sizes_are_those_of_a_plain_loop(spark):
    import zstandard

    rng = np.random.default_rng(3)
    vocabulary = {lang: ["".join(rng.choice(list(letters), int(rng.integers(2, 8)))) for _ in range(200)] for lang, letters in (("aa", "abcdefg"), ("bb", "klmnopq"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang], n))
    model = tuple((lang, prose(lang, 3000).encode()) for lang in ("aa", "bb"))
    for text in (prose("aa", 5), prose("bb", 300), prose("aa", 40_000), "Q", "e1 2!"):
        data = language_id.prepare(text)
        n = max(1, len(data) // language_id.BLOCK_BYTES)
        sizes = []
        for _, dictionary in model:
            params = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, dict_size=len(dictionary), window_log=(len(dictionary) + 2 * language_id.BLOCK_BYTES).bit_length(), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
            total = 0
            for i in range(n):
                compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)
                total += len(compressor.compress(data[len(data) * i // n : len(data) * (i + 1) // n]))
            sizes.append(total)
        lang, score, margin = language_id.classify(model, text)
        assert lang == model[sizes.index(min(sizes))][0] and margin == (max(sizes) - min(sizes)) / max(sizes)
        assert score == pytest.approx(1 / sum(math.exp(-min(700, (s - min(sizes)) / 2)) for s in sizes))


def test_rows_without_identifier_are_rows_of_the_other_operators(spark, docs):
    assert sharding.assign_shards(docs, 100).count() == len(ROWS)
    predicted = language_id.predict(docs, language_id.fit(docs))
    assert predicted.count() == len(ROWS) and predicted.filter("doc_id is null and held_out").count() == 0
    scored = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame([(20, 1), (21, 0), (None, 1)], "doc_id long, toxic int")))
    assert scored.count() == len(ROWS) and scored.filter("doc_id is null and held_out").count() == 0
    assert secrets.digest(secrets.scan_secrets(docs)).count() == len(ROWS)
    assert mixing.fair_mix(docs).count() == len(ROWS)


def test_long_payloads_go_through_archives(spark, tmp_path):
    big = "<p>é</p>" * 400_000
    pages = spark.createDataFrame([(1, "u", big, 1), (2, "u", big, 2), (None, None, big, 3), (3, "u", big + "x", 4)], "page_id long, url string, html string, seq int")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(pages, f"file://{tmp_path}").collect()}
    size = len(big.encode())
    assert got == {1: (size, "revisit", 2), 2: (size, "response", None), None: (size, "revisit", 2), 3: (size + 1, "response", None)}


def test_stages_take_an_empty_table(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    pytest.importorskip("public_tokenizers")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        out = stage(spark, empty, None)
        assert out.count() == 0 and (name == pipeline.STAGES[-1][0] or out.columns == empty.columns)
