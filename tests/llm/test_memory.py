"""What a task holds at a time is bounded by bytes, and results do not depend on it."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from marlstone.llm import bpe, importance
from marlstone.llm.ship import BATCH_BYTES, BATCH_KEY, ship


def test_arrow_batches_are_bounded_by_bytes(spark):
    ship(spark)
    assert spark.conf.get(BATCH_KEY) == str(BATCH_BYTES)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    sizes = [r["n"] for r in spark.range(0, 10_000, 1, 1).selectExpr("repeat('0123456789', 200) as text").mapInArrow(run, "n long").collect()]
    assert sum(sizes) > 4 * BATCH_BYTES and max(sizes) < 1.5 * BATCH_BYTES


def test_a_session_that_bounds_its_batches_keeps_its_bound(spark):
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, "12345")
    try:
        ship(spark)
        assert spark.conf.get(BATCH_KEY) == "12345"
    finally:
        spark.conf.set(BATCH_KEY, before or str(BATCH_BYTES))


def texts(n):
    rng = np.random.default_rng(4)
    words = [f"w{k}".encode() for k in range(30_000)]
    return [b" ".join(words[k] for k in (rng.random(250) ** 2 * len(words)).astype(int)) for _ in range(n)]


def test_blocks_of_words_are_gone_before_the_next_ones():
    batch = pa.RecordBatch.from_arrays([pa.array(texts(16_000), pa.binary())], ["text"])
    tracemalloc.start()
    try:
        held = []
        for block, keys in importance.blocks_of(iter([batch])):
            held.append(len(block))
            importance._Slots(block, 8, np.zeros(0, np.uint64))
            del block, keys
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(held) == 4_000_000 and peak < 200e6, peak


def test_counts_do_not_depend_on_the_blocks():
    batch = pa.RecordBatch.from_arrays([pa.array(texts(400), pa.binary())], ["text"])
    found = []
    for most in (1, 20_000, 1 << 20):
        dealt = [importance._Slots(block, 3, np.zeros(0, np.uint64)) for block, _ in importance.blocks_of(iter([batch]), most)]
        found.append(sum(importance.merged([x for d in dealt if (x := d.pack(s)) is not None], 997) for s in range(3)))
    assert (found[0] == found[1]).all() and (found[1] == found[2]).all() and found[0].sum() == 400 * (250 + 249 + 248)


def test_an_encoder_at_rest_holds_no_pieces():
    import base64

    data = b"\n".join(base64.b64encode(bytes([k])) + b" %d" % k for k in range(256))
    codec = bpe.Encoder(data)
    first = [x.tolist() for x in codec.encode(iter(["some words", "some others"]))]
    codec.rest()
    assert not codec.known and not codec.n_pool
    assert [x.tolist() for x in codec.encode(iter(["some words", "some others"]))] == first


def test_written_tables_leave_no_shuffles_and_the_setting_as_it_was(spark):
    import gc
    import time

    from marlstone.llm import storage

    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    shuffles = lambda: tracker.shuffleStatuses().size()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(2)
    before = shuffles()
    rows = spark.range(1000).selectExpr("id % 100 as g", "id").repartition(5, "id").groupBy("g").agg({"id": "sum"})
    assert storage.written(rows, "sums").count() == 100
    for _ in range(50):
        if (after := shuffles()) <= before + 1:  # that of count()
            break
        time.sleep(0.1)
    assert after <= before + 1
    assert spark.conf.get(storage.CLEANUP_KEY, None) is None
