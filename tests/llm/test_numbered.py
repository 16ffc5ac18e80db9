import hashlib
import json
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import cases  # noqa: E402
from marlstone.llm import bpe, components, embedding_dedup, exact_dedup, jaccard_join, language_id, mixing, queries, secrets, sharding, toxicity, warc, words  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return queries.vocabulary()


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_dedup_is_brute_force(docs, rows, digest_hex):
    got = exact_dedup.exact_dedup(docs, digest_hex=digest_hex).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == cases.exact(rows)
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_keep_one_keeps_columns_and_one_row_of_each_text(docs, rows):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [cases.normal(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({cases.normal(r[1]) for r in rows})


def test_index_takes_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    index.add(docs.filter("doc_id < 50"))
    index.add(docs.filter("doc_id >= 50"))
    assert index.compact().agg(F.sum("group_size")).first()[0] == docs.count()


def test_sharding_splits_only_oversized_buckets(docs, rows):
    limit = 4000
    got = sharding.assign_shards(docs, limit).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    hashes = {r[0]: int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16) for r in rows}
    size = lambda depth, prefix: sum(len((r[1] or "").encode()) for r in rows if hashes[r[0]] >> (60 - depth) == prefix)
    for r in got:
        depth = next(d for d in range(61) if size(d, hashes[r["doc_id"]] >> (60 - d)) <= limit or d == 60)
        assert r["depth"] == depth and r["oversized"] == (depth == 60)
        assert r["shard"] == (format(hashes[r["doc_id"]] >> (60 - depth), f"0{depth}b") if depth else "")
        assert r["shard_bytes"] == size(depth, hashes[r["doc_id"]] >> (60 - depth))


def test_written_shards_hold_all_rows(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "shards"), 10_000)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == docs.count()


def test_mixing_meets_its_targets(docs, rows):
    got = mixing.fair_mix(docs).collect()
    sizes = [(r[3], len(cases.WORD.findall(r[1] or ""))) for r in rows]
    by_source = Counter()
    for s, n in sizes:
        by_source[s] += n
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(by_source.values())
    while True:
        left, w = total - sum(3 * by_source[s] for s in full), sum(weights[s] for s in order if s not in full)
        goal = {s: 3 * by_source[s] if s in full else left * weights[s] / w for s in order}
        over = {s for s in order if s not in full and goal[s] > 3 * by_source[s]}
        if not over:
            break
        full |= over
    assert Counter((r["source"], r["size"]) for r in got) == Counter(sizes)
    taken = Counter()
    for r in got:
        assert r["source_size"] == by_source[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    largest = max(n for _, n in sizes)
    assert all(abs(taken[s] - goal[s]) <= largest for s in order) and 0 <= total - sum(taken.values()) <= largest
    again = mixing.fair_mix(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_mixed_rows_repeat_as_taken(docs):
    rows = mixing.mixed(docs)
    assert rows.columns == docs.columns
    want = Counter()
    for r in mixing.fair_mix(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in rows.collect()) == +want


def test_secret_spans_are_those_of_the_patterns(docs, rows):
    got = secrets.digest(secrets.scan_secrets(docs)).collect()
    want = Counter((r[0], hashlib.sha256(cases.base_spans(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert (by_id[102]["n_assign"], by_id[103]["n_access"], by_id[104]["n_hex"]) == (1, 1, 3)


def test_failing_matches_still_consume_text(spark):
    text = "secret = token: abcdef"
    got = secrets.digest(secrets.scan_secrets(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string"))).first()
    assert got["n_assign"] == 0 and cases.base_spans(text) == ""


def test_values_of_many_owners_are_examples(spark):
    rows = [(i, f'token = "example-{"shared1" if i < 4 else "alone9zq"}x"', f"o{i}") for i in range(5)]
    found = {r["doc_id"]: r["secrets"][0]["verdict"] for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found == {0: "copied", 1: "copied", 2: "copied", 3: "copied", 4: "live"}


@pytest.mark.parametrize("small", [128, 3])
def test_jaccard_classes_are_brute_force(docs, rows, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "ROWS_OF_REGION", small)
    monkeypatch.setattr(jaccard_join, "ROWS_OF_CHUNK", small)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect()}
    sets = {r[0]: cases.shingle_set(r[1]) for r in rows}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both)

    classes = cases.components(list(sets), linked)
    assert got == {(i, len(s), classes[i]) for i, s in sets.items()}


def test_joined_groups_have_offsets_for_more_than_2_gib():
    import pyarrow as pa
    from marlstone.llm.arrow_groups import groups

    batch = lambda keys, shapes: pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(shapes, pa.binary())], ["key", "shape"])
    found = list(groups([batch([1, 2], [b"a", b"b"]), batch([2, 2], [b"c", None]), batch([2, 3], [b"d", b"e"])], 1))
    assert [g.column(1).to_pylist() for g in found] == [[b"a"], [b"b", b"c", None, b"d"], [b"e"]]
    assert found[1].schema.field("shape").type == pa.large_binary()


def test_a_group_that_stays_in_several_batches_is_an_error(monkeypatch):
    import pyarrow as pa
    from marlstone.llm import arrow_groups

    class Chunked:
        cast = combine_chunks = lambda self, *a: self
        to_batches = lambda self: part * 2

    part = [pa.RecordBatch.from_arrays([pa.array([1])], ["key"])]
    monkeypatch.setattr(pa, "Table", type("Table", (), {"from_batches": staticmethod(lambda parts: Chunked())}))
    with pytest.raises(RuntimeError):
        arrow_groups._joined(pa, part * 2)


def test_one_document_of_each_class_stays(docs):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in jaccard_join.jaccard_classes(docs).collect()}


def test_words_are_those_of_the_pattern(rows):
    texts = [(r[1] or "").encode() for r in rows]
    hashes, bounds = words.hash_words(texts)
    seen = defaultdict(set)
    for r, a, b in zip(rows, bounds, bounds[1:]):
        found = [w.lower() if w.isascii() else w for w in cases.WORD.findall(r[1] or "")]
        assert b - a == len(found)
        for w, h in zip(found, hashes[a:b].tolist()):
            seen[w].add(h)
    assert all(len(h) == 1 for h in seen.values()) and len({min(h) for h in seen.values()}) == len(seen)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001 + i) for i in range(50)] + [(7, 7), (None, 3), (2000, 1999), (2000, 1999)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(51)} == {1000} and got[2000] == 1999
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    rows, base = [], rng.normal(size=(8, 16))
    for i in range(200):
        v = base[i % 8] + rng.normal(0, 0.02 + 0.4 * (i % 3), 16)
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 1), (204, rows[5][1], 1), (205, rows[5][1], None), (206, [1.0, 2.0], 1), (5, rows[5][1], 1), (207, [float("inf")] + [1.0] * 15, 1), (208, [], 1)]
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_embedding_links_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "ROWS_OF_BLOCK", block)
    rows = vectors()
    good = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(a, b):
        (_, x, lx), (_, y, ly) = rows[a], rows[b]
        if lx is None or lx != ly or not good(x) or not good(y) or len(x) != len(y):
            return False
        return np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)) >= 0.93

    n = Counter()
    for a in range(len(rows)):
        for b in range(a):
            if linked(a, b):
                n[a] += 1
                n[b] += 1
    by_row = cases.components(range(len(rows)), linked)
    least = defaultdict(lambda: 10**9)
    for k in range(len(rows)):
        least[by_row[k]] = min(least[by_row[k]], rows[k][0])
    want = Counter((rows[k][0], n[k], least[by_row[k]]) for k in range(len(rows)))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_dedup(frame, recall=0.9999).collect())
    assert got == want


def test_bpe_ids_are_those_of_tiktoken(docs, rows, vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    ranks = bpe.load_ranks(Path(vocabulary).read_bytes())
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.PATTERN == public_tokenizers.PATTERN
    want = {}
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        want[r[0]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), True)
    got = bpe.round_trip(docs, vocabulary).collect()
    assert len(got) == len(rows) and all(tuple(r)[1:] == want[r["doc_id"]] for r in got)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in rows)


def test_bpe_pieces_follow_the_pattern(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    import random

    codec = bpe.encoder(Path(vocabulary).read_bytes())
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(Path(vocabulary).read_bytes()), special_tokens={})
    rng = random.Random(2)
    texts = ["".join(rng.choice(" '\n\t sStTreveLLdmé　٠a1!_½😀x") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, codec.encode(iter(texts))):
        assert ids.tolist() == own.encode_ordinary(text), text


def test_offsets_of_characters_split_over_tokens(vocabulary):
    codec = bpe.encoder(Path(vocabulary).read_bytes())
    text = "né 🜚x"
    ids = next(codec.block([text]))
    starts, ends = codec.char_offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text) and (starts[1:] <= ends[:-1]).all()
    cut = codec.decode(ids[:-2]).decode("utf-8", "replace")
    assert text.startswith(cut.rstrip("�"))


def test_every_code_point_is_encoded_as_tiktoken_does(vocabulary):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    data = Path(vocabulary).read_bytes()
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.load_ranks(data), special_tokens={})
    texts = [f"a{c}a1{c}1" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for text, ids in zip(texts, bpe.encoder(data).encode(iter(texts)), strict=True):
        assert library.encode_ordinary(text) == ids.tolist(), text


def test_language_of_held_out_rows(docs):
    model = language_id.fit(docs)
    assert [lang for lang, _ in model][0] == "en" and {lang for lang, _ in model} == {"en", "fr", "de"}
    got = language_id.predict(docs, model).join(docs.select(F.col("doc_id").alias("d"), "lang", "text"), F.col("doc_id") == F.col("d")).collect()
    known = [r for r in got if r["held_out"] and r["lang"] and len(r["text"] or "") > 200 and len(set(r["text"])) > 3]
    assert known and sum(r["lang"] == r["lang_pred"] for r in known) >= 0.95 * len(known)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (95, 96, 97, 101)} == {"und"}
    assert all(r["held_out"] == cases.held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and not {95, 96, 97, 101} & {r["doc_id"] for r in kept.collect()}


def test_language_labels_of_held_out_rows_change_nothing(docs):
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert language_id.fit(docs) == language_id.fit(other)


def test_language_margin_is_the_same_at_every_length():
    rng = random.Random(3)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(4000)] for lang, letters in (("aa", "abcdefghor"), ("bb", "abcdefghis"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    model = tuple((lang, prose(lang, 20_000)[: 1 << 15].encode()) for lang in ("aa", "bb"))
    for lang in ("aa", "bb"):
        text = prose(lang, 300_000)
        margins = []
        for n in (30_000, 300_000, 2_000_000):
            found, score, margin = language_id.classify(model, text[:n])
            assert found == lang and score > 0.99
            margins.append(margin)
        assert min(margins) > 0.7 * max(margins) > 0.01


def test_texts_of_an_unlearned_language_are_rejected(spark):
    rng = random.Random(8)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(1500)] for lang, letters in (("aa", "aeionrstlu"), ("bb", "aeiomkpdgz"), ("none", "aeioubcdfghjlmnpqrstvwxyz"))}
    prose = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, prose(("aa", "bb")[i % 2], rng.randint(60, 600)), ("aa", "bb")[i % 2]) for i in range(1600)]
    rows += [(10_000 + i, prose("none", (150, 250, 600, 9000)[i % 4]), None) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).cache()
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    strange = [r for i, r in got.items() if i >= 10_000]
    assert sum(r["rejected"] for r in strange) >= 0.95 * len(strange)
    known = [got[i] for i, _, _ in rows if i < 10_000 and cases.held(i)]
    assert sum(r["rejected"] for r in known) <= 0.03 * len(known)
    kept = {r["doc_id"] for r in language_id.keep_identified(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r["rejected"]}


def test_languages_of_rows_without_identifiers(spark):
    rng = random.Random(9)
    vocabulary = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(500)] for lang, letters in (("aa", "aeionrstlu"), ("bb", "aeiomkpdgz"))}
    n = 2 * language_id.MARGIN_FOLD * language_id.MARGIN_ROWS + 800  # more rows than the sample's threshold lets through
    rows = [(None, " ".join(rng.choice(vocabulary[lang]) for _ in range(25)), lang) for lang in ("aa", "bb") for _ in range(n)]
    rows += [(None, rows[0][1], "aa")] * 3000 + [(i, rows[-1][1], "bb") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs)
    assert {lang for lang, _ in model} == {"aa", "bb"}
    kept = language_id.keep_identified(docs, model).groupBy("lang").count().collect()
    assert all(r["count"] > 0.95 * n for r in kept) and len(kept) == 2


def test_the_most_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    rows = [(i, f"{lang} words of {lang}", lang) for i, lang in enumerate(["x"] * 12 + ["y"] * 8 + ["z"] * 3)]
    assert [lang for lang, _ in language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))] == ["x", "y"]


def test_language_rejections_are_those_of_a_plain_loop(docs):
    model = language_id.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language_id.predict(docs, model).collect():
        text = texts[r["doc_id"]]
        size = len(language_id.prepare(text or ""))
        lang, _, margin = language_id.classify(tuple(model), text)
        bound = max(language_id.LEAST_MARGIN, model.scale / max(1, size) ** 0.5)
        assert r["rejected"] == (lang == "und" or margin < bound)


def test_language_training_passages_come_from_the_whole_row(spark):
    rows = [(i, "start " * 2000 + "finish " * 2000, "en") for i in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"start" in model[0][1] and b"finish" in model[0][1]


def test_toxicity_learns_its_words(spark):
    rng = np.random.default_rng(0)
    clean = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 5 == 0)
        text = list(rng.choice(clean, 60)) + ["vile", "scum"] * toxic
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, 0, toxic))
    rows += [(1000, None), (1001, "")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, marks)).collect()}
    held = [i for i in range(600) if cases.held(i)]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] and all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert (toxicity.fit(docs, flipped) == toxicity.fit(docs, marks)).all()


PAGES = [(1, "http://a", "x" * 1500), (2, "http://b", "x" * 1500), (9, None, "x" * 1500), (3, "u\r\nv", None), (4, "http://é", ""), (5, "h", "short"), (6, "h", "short"), (7, "h", "é" * 600), (None, "h", "é" * 600), (8, "h", "\r\n\r\nWARC/1.1\r\n" * 100), (8, "h", "y" * 2000), (8, "h", "y" * 2000)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "e") for p in PAGES], "page_id long, url string, html string, archive string").coalesce(2)
    folder = f"file://{tmp_path}"
    got = warc.archive_pages(pages, folder, archive_bytes=2000).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for p, _, h in PAGES)
    by_id = defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert by_id[9] == [("response", None)] and by_id[1] == by_id[2] == [("revisit", 9)]
    assert by_id[5] == by_id[6] == [("response", None)] and by_id[7] == [("response", None)] and by_id[None] == [("revisit", 7)]
    assert sorted(by_id[8], key=str) == [("response", None), ("response", None), ("revisit", 8)]
    assert all(r["verified"] for r in got if r["record_type"] == "response")
    for index in Path(tmp_path).glob("*.idx"):
        data = index.with_suffix(".warc.gz").read_bytes()
        for line in index.read_text().splitlines():
            entry = json.loads(line)
            member = zlib.decompressobj(31)
            assert member.decompress(data[entry["offset"] : entry["offset"] + entry["length"]]).startswith(b"WARC/1.1") and member.eof and not member.unused_data
    assert not list(Path(tmp_path).glob("capture-*"))


def test_empty_tables(spark, nothing, vocabulary):
    assert exact_dedup.exact_dedup(nothing).count() == 0
    assert exact_dedup.keep_one(nothing).count() == 0
    assert sharding.assign_shards(nothing, 10).count() == 0
    assert mixing.fair_mix(nothing).count() == 0
    assert mixing.mixed(nothing).count() == 0
    assert secrets.digest(secrets.scan_secrets(nothing)).count() == 0
    assert jaccard_join.jaccard_classes(nothing).count() == 0
    assert bpe.round_trip(nothing, vocabulary, with_ids=True).count() == 0
    assert language_id.fit(nothing) == [] and language_id.predict(nothing, []).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_without_training_rows_everything_is_unknown(docs, spark):
    assert {r["lang_pred"] for r in language_id.predict(docs, []).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}


def test_pipeline_stages_keep_columns_and_meet_their_contracts(spark, docs, vocabulary):
    pipeline = pytest.importorskip("corpus_pipeline")
    from marlstone.llm.storage import materialize

    current, seen = docs, {}
    for name, stage in pipeline.STAGES:
        out = materialize(stage(spark, current, None), name)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = (current.collect(), out.collect())
        current = out
    before, after = seen["exact_dedup"]
    assert len({cases.normal(r["text"]) for r in before}) == len(after)
    before, after = seen["jaccard_join"]
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = seen["byte_bpe"]
    assert Counter(r["doc_id"] for r in before) == Counter(r["doc_id"] for r in after) and all(r["restored"] and len(r["ids"]) == r["n_tokens"] for r in after)


def test_numbered_queries_and_sql_agree(spark, sf_dir):
    import duckdb
    from marlstone.llm import oracle

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name, sql in oracle.ORACLE_SQL.items():
        df, want = queries.QUERIES[name](spark, sf_dir), con.sql(sql)
        order = [want.columns.index(c) for c in df.columns]
        assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall()), name
