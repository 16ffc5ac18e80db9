"""Silhouettes against a plain loop over all pairs."""

import math
import random
import time

import numpy as np
from marlstone.operators import metrics as M

SCHEMA = "k long, c string, v array<double>"


def looped(rows):
    """As the SQL of the query: rows of another key meet, means ignore pairs without a distance."""
    rows = [r for r in rows if r[0] is not None]
    means = {}
    for k, c, v in rows:
        for j, o, w in rows:
            if j != k:
                known = v is not None and w is not None and len(v) == len(w) and None not in v and None not in w
                means.setdefault(k, {}).setdefault((c, o), []).extend([float(np.sqrt(np.sum((np.array(v) - np.array(w)) ** 2)))] if known else [])
    scores = []
    for found in means.values():
        at = lambda same: [float(np.mean(d)) for (c, o), d in found.items() if d and c is not None and o is not None and (c == o) == same]  # noqa: B023, E731
        least = lambda ds: min((d for d in ds if not math.isnan(d)), default=math.nan) if ds else None
        own, other = least(at(True)), least(at(False))
        if own is None or other is None or max(own, other) == 0:
            scores.append(0.0)
        else:
            scores.append((other - own) / max(own, other) if not math.isnan(own + other) else math.nan)
    return float(np.mean(scores)) if scores else None


def found(spark, rows):
    with np.errstate(invalid="ignore"):
        return M.silhouette(spark.createDataFrame(rows, SCHEMA), "k", "c", "v").collect()[0]["silhouette"], looped(rows)


def test_silhouette_of_odd_rows_is_that_of_a_loop(spark):
    rnd = random.Random(4)
    plain = [(k, rnd.choice("abc"), [float(rnd.randrange(5)), rnd.random() if k % 3 else 0.5]) for k in range(80)] + [(80, "alone", [9.0, -0.0])]
    odd = [(None, "a", [1.0, 1.0]), (81, None, [1.0, 2.0]), (82, "b", None), (83, "b", [1.0, None]), (84, "c", [1.0]), (85, "c", [2.0]), (86, "a", []), (87, "a", [])]
    twice = [(3, "a", [1.0, 7.0]), (3, "b", [1.5, 2.0]), (5, "c", [0.0, 0.0])]
    for rows in (plain, plain + odd, plain + odd + twice, plain[:1], plain[:2], [(1, "a", [0.0]), (2, "a", [0.0]), (3, "b", [0.0])], []):
        got, want = found(spark, rows)
        assert (got is None) == (want is None), rows
        assert got is None or abs(got - want) < 1e-9, (got, want)
    for value in (math.inf, math.nan):
        got, want = found(spark, [*plain, (88, "a", [value, 1.0])])
        assert math.isnan(got) == math.isnan(want) and (math.isnan(got) or abs(got - want) < 1e-9), (value, got, want)


def test_silhouette_in_many_blocks_and_clusters(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(k, str(rnd.randrange(90)), [rnd.random(), rnd.random()]) for k in range(400)]
    monkeypatch.setattr(M, "SUMS_AT_ONCE", 90 * 50)
    got, want = found(spark, rows)
    assert abs(got - want) < 1e-9


def test_silhouette_of_many_copies_takes_the_time_of_its_distinct_points(spark):
    points = [(float(p % 17), float(p * p % 101) / 7, p % 3) for p in range(500)]
    few = [(p, str(c), [x, y]) for p, (x, y, c) in enumerate(points)]
    copies = spark.range(80).withColumnRenamed("id", "copy")
    many = spark.createDataFrame(few, SCHEMA).crossJoin(copies).selectExpr("k + 500 * copy as k", "c", "v")
    began = time.time()
    got = M.silhouette(many, "k", "c", "v").collect()[0]["silhouette"]
    assert time.time() - began < 45  # 1.6 billion pairs
    at = np.array([[x, y] for x, y, _ in points])
    d, label = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2)), np.array([c for *_, c in points])
    sums = np.stack([d[:, label == c].sum(axis=1) * 80 for c in range(3)], axis=1)
    sizes = np.array([80 * int((label == c).sum()) for c in range(3)])
    own = sums[np.arange(500), label] / (sizes[label] - 1)
    other = np.where(label[:, None] == np.arange(3), np.inf, sums / sizes).min(axis=1)
    assert abs(got - float(np.mean((other - own) / np.maximum(own, other)))) < 1e-9
