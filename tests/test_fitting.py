"""Kernel machines, descent, networks and mini-batches against plain loops over the same rows."""

import numpy as np
import pytest
from marlstone.operators import fitting as L
from pyspark.sql import functions as F

RNG = np.random.default_rng(6)
X = RNG.normal(0, 1, (120, 2))
Y = 1.5 * X[:, 0] - X[:, 1] + 0.1 * RNG.normal(size=120)
KEYS = (np.arange(120) * 37 % 1000).tolist()


@pytest.fixture(scope="module")
def df(spark):
    rows = [(k, float(a), float(b), float(y), "extra") for k, (a, b), y in zip(KEYS, X, Y)]
    rows += [(2000, None, 1.0, 1.0, "gap"), (2001, 1.0, float("nan"), 1.0, "gap")]
    return spark.createDataFrame(rows, "k int, a double, b double, y double, _x string").repartition(3).cache()


def by_key(rows, column):
    return {r["k"]: r[column] for r in rows.collect()}


def kernel(a, b, kind, gamma):
    if kind == "rbf":
        return np.exp(-gamma * ((a[:, None] - b[None]) ** 2).sum(-1))
    return a @ b.T if kind == "linear" else (gamma * a @ b.T + 1) ** 3


@pytest.mark.parametrize("kind", ["linear", "poly", "rbf"])
def test_one_class_svm(df, kind):
    gamma = 1 / (2 * X.var())
    mean = kernel(X, X, kind, gamma).mean(1)
    inside = X[np.argsort(mean)[-int(120 * 0.9) :]]
    raw = kernel(X, inside, kind, gamma).mean(1)
    want = raw - np.percentile(raw, 10)
    machine = L.one_class_svm(df, ["a", "b"], 0.1, kind, n_features=4096)
    got = by_key(machine.predict(df, "out"), "out")
    mine = np.array([got[k] for k in KEYS])
    assert got[2000] is None and got[2001] is None
    if kind == "rbf":  # features approximate the kernel
        assert np.abs(mine - want).max() < 0.05 and ((mine < 0) == (want < 0)).mean() > 0.95
    else:
        assert mine == pytest.approx(want)


@pytest.mark.parametrize(("kind", "degree"), [("linear", 1), ("polynomial", 3), ("quadratic", 2)])
def test_svm_regressor(df, kind, degree):
    gamma = 1 / (2 * X.var())
    k = X @ X.T if kind == "linear" else (gamma * X @ X.T + 1) ** degree
    want = np.linalg.solve(k + np.eye(120) / 4, Y) @ k
    got = by_key(L.svm_regressor(df, ["a", "b"], "y", 2.0, kind, degree).predict(df), "predicted")
    assert np.array([got[i] for i in KEYS]) == pytest.approx(want, abs=1e-6)


def test_svm_regressor_with_random_features(df):
    got = by_key(L.svm_regressor(df, ["a", "b"], "y", 50.0, "rbf", n_features=300).predict(df), "predicted")
    assert np.corrcoef([got[i] for i in KEYS], Y)[0, 1] > 0.99
    with pytest.raises(ValueError):
        L.feature_map("sigmoid", 2)


@pytest.mark.parametrize("shards", [1, 3])
@pytest.mark.parametrize(("loss", "penalty"), [("squared_error", "l2"), ("huber", "l1"), ("epsilon_insensitive", "elasticnet")])
def test_sgd(spark, df, loss, penalty, shards):
    epochs, alpha = 3, 0.01
    got = L.sgd_regressor(df, "k", ["a", "b"], "y", loss, penalty, alpha, max_iter=epochs, shards=shards)
    order = df.filter("_x = 'extra'").select("k", F.pmod(F.xxhash64("k", F.lit(0)), F.lit(shards)).alias("s"), *[F.xxhash64("k", F.lit(0), F.lit(e)).alias(f"t{e}") for e in range(epochs)]).collect()
    at = {k: i for i, k in enumerate(KEYS)}
    w = np.zeros(3)
    for e in range(epochs):
        parts = []
        for s in range(shards):
            now, members = w.copy(), sorted((r for r in order if r["s"] == s), key=lambda r: r[f"t{e}"])
            for n, r in enumerate(members, 1):
                x, y = X[at[r["k"]]], Y[at[r["k"]]]
                eta = 0.01 / (e * len(members) + n + 1) ** 0.25
                miss = now[1:] @ x + now[0] - y
                g = {"squared_error": miss, "huber": np.clip(miss, -1.35, 1.35), "epsilon_insensitive": np.sign(miss) * (abs(miss) > 0.1)}[loss]
                l2, l1 = {"l2": (alpha, 0), "l1": (0, alpha), "elasticnet": (0.85 * alpha, 0.15 * alpha)}[penalty]
                now[1:] = (1 - eta * l2) * now[1:] - eta * g * x
                now[1:] = np.sign(now[1:]) * np.maximum(abs(now[1:]) - eta * l1, 0)
                now[0] -= eta * g
            parts.append((len(members), now))
        w = sum(n * v for n, v in parts) / sum(n for n, _ in parts)
    assert [got["intercept"], got["a"], got["b"]] == pytest.approx(w.tolist())


@pytest.mark.parametrize("clip", [None, 0.05])
def test_network(df, clip):
    net = L.Network(["a", "b"], [2, 3, 1], rate=0.05, momentum=0.5, l2=0.01, clip=clip, seed=3)
    ws = [w.copy() for w in net.weights]
    net.fit(df, ["y"], 6)
    speed, losses = [np.zeros_like(w) for w in ws], []
    for _ in range(6):
        hidden = np.tanh(X @ ws[0][:-1] + ws[0][-1])
        out = hidden @ ws[1][:-1] + ws[1][-1]
        error = out[:, 0] - Y
        losses.append((error**2).mean() + 0.005 * sum((w[:-1] ** 2).sum() for w in ws))
        back = 2 * error[:, None] / len(Y)
        deep = back @ ws[1][:-1].T * (1 - hidden**2)
        grads = [np.vstack([X.T @ deep, deep.sum(0)]), np.vstack([hidden.T @ back, back.sum(0)])]
        for k in (0, 1):
            grads[k][:-1] += 0.01 * ws[k][:-1]
            norm = np.linalg.norm(grads[k])
            if clip and norm > clip:
                grads[k] *= clip / norm
            speed[k] = 0.5 * speed[k] - 0.05 * grads[k]
            ws[k] = ws[k] + speed[k]
    assert net.losses == pytest.approx(losses)
    want = (np.tanh(X @ ws[0][:-1] + ws[0][-1]) @ ws[1][:-1] + ws[1][-1])[:, 0]
    got = by_key(net.predict(df), "predicted")
    assert np.array([got[k] for k in KEYS]) == pytest.approx(want) and got[2000] is None


def test_networks_learn(spark, df):
    labelled = df.withColumn("up", (F.col("y") > 0).cast("int"))
    net = L.Network(["a", "b"], [2, 4, 1], output="sigmoid", rate=2.0).fit(labelled, ["up"], 60)
    rows = net.predict(labelled, "p").filter("p is not null").collect()
    assert np.mean([(r["p"] > 0.5) == (r["up"] == 1) for r in rows]) > 0.9
    line = spark.createDataFrame([(i, i / 50 - 1, 1 - i / 50) for i in range(100)] + [(100, 1.0, 2.0)], "k int, a double, b double")
    auto = L.Network(["a", "b"], [2, 1, 2], activation="identity", rate=0.2).fit(line.filter("k < 100"), ["a", "b"], 100)
    error = by_key(auto.reconstruction_error(line), "error")
    assert error[100] > 50 * np.mean([error[k] for k in range(100)]) and len(auto.losses) == 100
    assert len(L.Network(["a", "b"], [2, 1]).fit(df, ["y"], 50, tolerance=1e9).losses) == 2
    with pytest.raises(ValueError):
        L.Network(["a", "b"], [3, 1])
    with pytest.raises(ValueError):
        L.Network(["a", "b"], [2, 1]).fit(df.limit(0), ["y"], 1)


def test_mini_batches(df):
    held = df.filter("_x = 'extra'")
    turn = {r["k"]: (r["b"], r["f"]) for r in held.select("k", F.pmod(F.xxhash64("k", F.lit(0)), F.lit(3)).alias("b"), F.xxhash64("k", F.lit(0), F.lit("first")).alias("f")).collect()}
    at = {k: i for i, k in enumerate(KEYS)}
    centres = [X[at[min(KEYS, key=lambda k: (turn[k][1], k))]]]
    while len(centres) < 3:
        gap = ((X[:, None] - np.array(centres)[None]) ** 2).sum(-1).min(1)
        centres.append(X[at[max(KEYS, key=lambda k: (gap[at[k]], -k))]])
    centres, seen = np.array(centres), np.zeros(3)
    for _ in range(2):
        for b in range(3):
            part = X[[at[k] for k in KEYS if turn[k][0] == b]]
            to = ((part[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
            for c in range(3):
                mine = part[to == c]
                seen[c] += len(mine)
                if len(mine):
                    centres[c] = centres[c] + (mine.sum(0) - len(mine) * centres[c]) / seen[c]
    got = L.mini_batch_kmeans(df, "k", ["a", "b"], 3, 3, 2)
    assert got == pytest.approx(centres)
    named = by_key(L.assign_nearest(df, ["a", "b"], got), "cluster")
    assert [named[k] for k in KEYS] == ((X[:, None] - centres[None]) ** 2).sum(-1).argmin(1).tolist() and named[2001] is None
    assert L.mini_batch_kmeans(df.limit(0), "k", ["a", "b"], 3).shape == (0, 2)
