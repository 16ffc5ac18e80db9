"""Neighbours and clusterings against plain loops, in one block and in many cells."""

import numpy as np
import pytest
from marlstone.operators import clustering as C
from marlstone.operators import features as X
from marlstone.operators import neighbors as N


def make():
    rng = np.random.default_rng(1)
    heaps = [rng.normal(c, 0.4, (22, 2)) for c in ((0, 0), (4, 4), (8, 0))]
    return np.concatenate([*heaps, rng.uniform(-3, 11, (14, 2)), np.repeat([[1.5, 1.5]], 20, 0)]).round(1)  # many ties, one hot vector


POINTS = make()
KEYS = [7 * i % 101 for i in range(len(POINTS))]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, [float(x) for x in p], "extra") for k, p in zip(KEYS, POINTS)]
    rows += [(None, [0.0, 0.0], "x"), (999, None, "x"), (998, [float("nan"), 1.0], "x"), (997, [None, 1.0], "x")]
    return spark.createDataFrame(rows, "k long, v array<double>, site string").repartition(3).cache()


@pytest.fixture(params=[4096, 12])
def block(request, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", request.param)
    monkeypatch.setattr(N, "AT_ONCE", 64 * request.param)
    return request.param


def all_distances(metric="euclidean"):
    diff = np.abs(POINTS[:, None] - POINTS[None])
    return diff.sum(-1) if metric == "manhattan" else np.sqrt((diff**2).sum(-1))


def groups(pairs):
    """key -> cluster, numbered by smallest key, of keys joined by pairs."""
    leader = {k: k for k in KEYS}

    def find(k):
        while leader[k] != k:
            k = leader[k]
        return k

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        leader[b] = a
    first = sorted({find(k) for k in KEYS})
    return {k: first.index(find(k)) for k in KEYS}


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_nearest(df, block, metric):
    d = all_distances(metric)
    want = []
    for i, k in enumerate(KEYS):
        near = sorted((d[i, j], KEYS[j]) for j in range(len(KEYS)) if j != i)[:4]
        want += [(k, r + 1, j, round(x, 9)) for r, (x, j) in enumerate(near)]
    got = N.nearest(df, "k", "v", 4, metric).collect()
    assert sorted((r["i"], r["k"], r["j"], round(r["d"], 9)) for r in got) == sorted(want)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_dbscan(df, block, metric):
    near = all_distances(metric) <= 0.5
    core = near.sum(1) >= 6
    label = np.full(len(KEYS), -1)
    clusters = groups((KEYS[i], KEYS[j]) for i in range(len(KEYS)) for j in range(i) if core[i] and core[j] and near[i, j])
    ranks = sorted({clusters[KEYS[i]] for i in np.flatnonzero(core)}, key=lambda c: min(KEYS[i] for i in np.flatnonzero(core) if clusters[KEYS[i]] == c))
    for i in range(len(KEYS)):
        reached = [ranks.index(clusters[KEYS[j]]) for j in np.flatnonzero(near[i] & core)]
        label[i] = (ranks.index(clusters[KEYS[i]]) if core[i] else min(reached)) if reached else -1
    got = {r["k"]: (r["cluster"], r["is_core"]) for r in C.dbscan(df, "k", "v", 0.5, 6, metric).collect()}
    assert got == {k: (label[i], core[i]) for i, k in enumerate(KEYS)}
    assert {-1, 0, 1} <= set(label)


@pytest.mark.parametrize("n", [1, 4])
def test_single_linkage(df, block, n):
    d = all_distances()
    edges, joined = sorted((d[i, j], *sorted((KEYS[i], KEYS[j]))) for i in range(len(KEYS)) for j in range(i)), []
    for _, a, b in edges:
        if len(set(groups(joined).values())) == n:
            break
        joined.append((a, b))
    got = {r["k"]: r["cluster"] for r in C.agglomerative(df, "k", "v", n, "single").collect()}
    assert got == groups(joined)


def test_ward(df, block):
    held = {k: ([k], p.copy()) for k, p in sorted(zip(KEYS, POINTS), key=lambda x: x[0])}
    while len(held) > 4:
        names = sorted(held)
        size, mean = np.array([len(held[k][0]) for k in names], float), np.array([held[k][1] for k in names])
        d = np.sqrt(((mean[:, None] - mean[None]) ** 2).sum(-1)) * np.sqrt(2 * size[:, None] * size[None] / (size[:, None] + size[None]))
        np.fill_diagonal(d, np.inf)
        a, b = sorted(np.unravel_index(d.argmin(), d.shape))
        (x, m), (y, o) = held.pop(names[a]), held.pop(names[b])
        held[names[a]] = (x + y, (m * len(x) + o * len(y)) / (len(x) + len(y)))
    got = {r["k"]: r["cluster"] for r in C.agglomerative(df, "k", "v", 4, "ward").collect()}
    assert got == groups((m[0], x) for m, _ in held.values() for x in m)


def test_mean_shift(df, block):
    order = np.argsort(KEYS)
    points = POINTS[order]
    seeds = points.copy()
    for _ in range(300):
        d = np.sqrt(((seeds[:, None] - points[None]) ** 2).sum(-1))
        w = np.where(d <= 4.5, np.exp(-0.5 * (d / 1.5) ** 2), 0)
        to = w @ points / w.sum(1)[:, None]
        rests = np.sqrt(((to - seeds) ** 2).sum(1)).max() < 1e-5
        seeds = to
        if rests:
            break
    centers, taken = [], np.zeros(len(seeds), bool)
    for i in range(len(seeds)):
        if not taken[i]:
            near = np.sqrt(((seeds - seeds[i]) ** 2).sum(1)) < 1.5
            centers.append(seeds[near].mean(0))
            taken |= near
    want = ((points[:, None] - np.array(centers)[None]) ** 2).sum(-1).argmin(1)
    rows, modes = C.mean_shift(df, "k", "v", 1.5)
    assert {r["k"]: r["cluster"] for r in rows.collect()} == {KEYS[i]: c for i, c in zip(order, want)}
    assert np.allclose([r["center"] for r in modes.orderBy("cluster").collect()], centers, atol=1e-2)  # equal vectors are one seed


def test_scott_bandwidth(df):
    rows = N.vector_rows(df, "k", "v")
    assert C.scott_bandwidth(rows, "_v") == pytest.approx(POINTS.std(axis=0).mean() * len(POINTS) ** (-1 / 6))


def test_small_and_wrong_tables(spark, df):
    empty, one = df.limit(0), spark.createDataFrame([(5, [1.0, 2.0]), (6, [1.0, 2.0])], "k long, v array<double>")
    assert N.nearest(empty, "k", "v", 3).count() == C.dbscan(empty, "k", "v").count() == C.agglomerative(empty, "k", "v").count() == 0
    assert C.mean_shift(empty, "k", "v", 1.0)[0].count() == C.spanning_tree(empty, "k", "v").count() == 0
    assert [tuple(r) for r in N.nearest(one, "k", "v", 3).orderBy("i").collect()] == [(5, 6, 0.0, 1), (6, 5, 0.0, 1)]
    assert {r["cluster"] for r in C.dbscan(one, "k", "v", 0.5, 2).collect()} == {0}
    assert {r["cluster"] for r in C.dbscan(one, "k", "v", 0.5, 3).collect()} == {-1}
    assert {r["cluster"] for r in C.agglomerative(one, "k", "v", 2, "single").collect()} == {0}
    with pytest.raises(ValueError):
        N.nearest(df, "site", "v", 3)
    with pytest.raises(ValueError):
        C.agglomerative(df, "k", "v", 2, "complete")


def test_knn_impute(spark, block):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (70, 3)).astype(float)
    x[rng.random((70, 3)) < 0.25] = np.nan
    x[:3] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double").repartition(3)
    for weights in ("uniform", "distance"):
        want = {}
        for i, r in enumerate(x):
            both = ~np.isnan(r)[None] & ~np.isnan(x)
            d = np.where(both.any(1), np.sqrt(np.where(both, (np.nan_to_num(x) - np.nan_to_num(r)) ** 2, 0).sum(1)), np.inf)
            near = sorted(range(len(x)), key=lambda j: (d[j], j))[:5]
            w = np.array([1.0 if weights == "uniform" else 1 / (d[j] + 1e-10) for j in near])
            for c in range(3):
                given = np.array([not np.isnan(x[j, c]) for j in near])
                mean = np.nanmean(x[:, c]) if not (w * given).sum() else sum(w[n] * x[j, c] for n, j in enumerate(near) if given[n]) / (w * given).sum()
                want[i, c] = mean if np.isnan(r[c]) else r[c]
        got = {(r["k"], c): r[c + 1] for r in X.knn_impute(df, "k", ["a", "b", "c"], 5, weights).collect() for c in range(3)}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("affinity", ["nearest_neighbors", "rbf"])
def test_neighbour_graph(df, affinity):
    d = all_distances()
    want = np.eye(len(KEYS))
    for i in range(len(KEYS)):
        for j in sorted((j for j in range(len(KEYS)) if j != i), key=lambda j: (d[i, j], KEYS[j]))[:5]:
            want[i, j] = want[j, i] = 1.0 if affinity == "nearest_neighbors" else np.exp(-0.5 * d[i, j] ** 2)
    at = {k: i for i, k in enumerate(KEYS)}
    graph = {(at[r["i"]], at[r["j"]]): r["w"] for r in C.neighbour_graph(df, "k", "v", 5, affinity, 0.5).collect()}
    assert graph == pytest.approx({(i, j): want[i, j] for i in range(len(KEYS)) for j in range(len(KEYS)) if want[i, j]})


def test_spectral(spark):
    angle = np.arange(40) * 2 * np.pi / 20
    ring = np.where(np.arange(40) < 20, 1.0, 4.0)[:, None] * np.stack([np.cos(angle), np.sin(angle)], axis=1)  # rings that no means separate
    df = spark.createDataFrame([(3 * i, [float(x) for x in p]) for i, p in enumerate(ring)], "k long, v array<double>").repartition(2)
    d = np.sqrt(((ring[:, None] - ring[None]) ** 2).sum(-1))
    w = np.eye(40)
    for i in range(40):
        for j in sorted((j for j in range(40) if j != i), key=lambda j: (round(d[i, j], 9), j))[:4]:
            w[i, j] = w[j, i] = 1.0
    scale = 1 / np.sqrt(w.sum(1))
    graph = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(40) for j in range(40) if w[i, j]], "i long, j long, w double")
    _, values = C.leading_vectors(graph, 2, 12)
    assert values == pytest.approx(np.linalg.eigvalsh(w * scale[:, None] * scale[None])[::-1][:2], abs=1e-3)
    got = {r["k"] // 3: r["cluster"] for r in C.spectral(df, "k", "v", 2, n_neighbors=4, most_rounds=12).collect()}
    assert got == {i: int(i >= 20) for i in range(40)}
