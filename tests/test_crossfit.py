"""Members in folds, bags, stacks and chains against plain fits on the rows of each."""

import numpy as np
import pytest
from marlstone.operators import crossfit as C
from marlstone.operators.ensembles import poisson_count
from marlstone.functions.expressions import hash_uniform
from pyspark.sql import functions as F

RNG = np.random.default_rng(11)
N, K = 240, 3
X = RNG.normal(0, 1, (N, 3)) * [1, 2, 0.5] + [0, 100, 0]
Y = (X[:, 0] + 0.5 * (X[:, 1] - 100) + 0.4 * RNG.normal(size=N) > 0).astype(float)
Z = (X[:, 2] + 0.6 * Y + 0.2 * RNG.normal(size=N) > 0.3).astype(float)
FOLD = np.arange(N) % K
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, *map(float, x), float(y), float(z), int(f), "extra") for i, (x, y, z, f) in enumerate(zip(X, Y, Z, FOLD))]
    rows += [(900, None, 1.0, 1.0, 1.0, 1.0, 0, "gap"), (901, float("nan"), 1.0, 1.0, 1.0, 1.0, 1, "gap"), (902, 1.0, 100.0, 1.0, None, 1.0, 1, "no label"), (903, 1.0, 100.0, 1.0, 1.0, 1.0, None, "no fold")]
    return spark.createDataFrame(rows, "k int, a double, b double, c double, y double, z double, fold int, _x string").repartition(5).cache()


def plain(estimator, x, y, w=None):
    """Fit on all rows in one block."""
    w, state, done = np.ones(len(x)) if w is None else w, estimator.start(x.shape[1]), False
    while not done:
        state, done = estimator.update(state, estimator.sums(state, x, y, w))
    return lambda v: estimator.predict(state, v)


def predicted(rows, column="predicted"):
    got = {r["k"]: r[column] for r in rows.collect()}
    return np.array([got[k] for k in range(N)], dtype=float), got


def test_linear_and_bayes_from_their_formulas():
    z = np.column_stack([np.ones(N), X])
    w = RNG.integers(0, 3, N).astype(float)
    b = np.linalg.solve(z.T @ (z * w[:, None]) + 2 * np.diag([0, 1, 1, 1]), z.T @ (w * Y))
    assert plain(C.Linear(2.0), X, Y, w)(X) == pytest.approx(z @ b)
    m = [X[Y == k].mean(0) for k in (0, 1)]
    v = [X[Y == k].var(0) + 1e-9 for k in (0, 1)]
    dense = np.array([(Y == k).mean() * np.prod(np.exp(-((X - m[k]) ** 2) / 2 / v[k]) / np.sqrt(v[k]), axis=1) for k in (0, 1)])
    assert plain(C.Bayes(), X, Y)(X) == pytest.approx(dense[1] / dense.sum(0))
    assert set(plain(C.Bayes(), X, np.ones(N))(X)) == {1.0}


def test_logistic_is_at_the_minimum():
    scaled = X - [0, 100, 0]
    p = plain(C.Logistic(0.5), scaled, Y)
    state = [v.cell_contents for v in p.__closure__ if isinstance(v.cell_contents, dict)][0]
    z = np.column_stack([np.ones(N), scaled])
    assert z.T @ (p(scaled) - Y) + 0.5 * state["b"] * [0, 1, 1, 1] == pytest.approx(np.zeros(4), abs=1e-6)


def test_soft_tree_gradient():
    x = X - [0, 100, 0]
    tree = C.SoftTree(depth=3, rounds=5, seed=2)
    state, _ = tree.update(tree.start(3), tree.sums(tree.start(3), x, Y, np.ones(N)))
    assert state["leaf"].mean() == pytest.approx(Y.mean(), abs=0.2)
    found = tree.sums(state, x, Y, np.ones(N))
    for name, at in (("threshold", 0), ("leaf", 7)):
        for k in range(len(state[name])):
            up, down = ({**state, name: state[name] + s * 1e-6 * np.eye(len(state[name]))[k]} for s in (1, -1))
            slope = (((tree.predict(up, x) - Y) ** 2).sum() - ((tree.predict(down, x) - Y) ** 2).sum()) / 2e-6
            assert found[at + k] == pytest.approx(slope, abs=1e-3)
    long = plain(C.SoftTree(depth=3, rounds=200, seed=2), x, Y)
    assert ((long(x) - Y) ** 2).mean() < 0.6 * Y.var()


@pytest.mark.parametrize("estimator", [C.Linear(0.1), C.Logistic(1.0), C.Bayes(), C.SoftTree(depth=2, rounds=3)])
def test_every_row_is_predicted_without_its_fold(df, estimator):
    out, whole, _ = C.out_of_fold(df, {"m": (estimator, ["a", "c"])}, "y", "fold", K)
    got, all_ = predicted(out, "m_pred")
    x = X[:, [0, 2]]
    for k in range(K):
        want = plain(estimator, x[FOLD != k], Y[FOLD != k])(x[FOLD == k])
        # the row without a label is of no training set
        assert got[FOLD == k] == pytest.approx(want, abs=1e-6)
    assert all_[900] is None and all_[901] is None and all_[903] is None and all_[902] is not None
    assert predicted(whole["m"].predict(df))[0] == pytest.approx(plain(estimator, x, Y)(x), abs=1e-6)


def own_estimator():
    """An estimator of a user's own; workers lack this module, so the class goes with the task."""

    class Mean(C.Estimator):
        def start(self, width):
            return None

        def sums(self, state, x, y, w):
            return np.array([w @ y, w.sum()])

        def update(self, state, sums):
            return sums[0] / sums[1], True

        def predict(self, state, x):
            return np.full(len(x), state)

    return Mean()


def test_search_with_own_estimator_and_scorers(df):
    found = C.search(df, {"mean": own_estimator(), "line": C.Linear(), "stiff": C.Linear(1e5)}, COLUMNS, "y", "fold", K, {"accuracy": C.accuracy, "mse": C.mean_squared_error, "r2": C.r2, "loss": C.log_loss, "worst": lambda y, p: F.max(F.abs(y - p))})
    got = {(r["candidate"], r["fold"]): r for r in found.collect()}
    assert len(got) == 9
    for name, e in (("mean", own_estimator()), ("line", C.Linear()), ("stiff", C.Linear(1e5))):
        for k in range(K):
            y, p = Y[FOLD == k], plain(e, X[FOLD != k], Y[FOLD != k])(X[FOLD == k])
            q, r = np.clip(p, 1e-15, 1 - 1e-15), got[name, k]
            want = [((p > 0.5) == y).mean(), ((p - y) ** 2).mean(), 1 - ((p - y) ** 2).mean() / y.var(), -np.log(np.where(y == 1, q, 1 - q)).mean(), abs(y - p).max(), len(y)]
            assert [r["accuracy"], r["mse"], r["r2"], r["loss"], r["worst"], r["n"]] == pytest.approx(want, abs=1e-9)
    assert C.best_candidate(found, "mse", greater=False).first()["candidate"] == "line"
    one = C.cross_validate(df, C.Linear(), COLUMNS, "y", "fold", K, {"mse": C.mean_squared_error}).collect()
    assert {r["fold"]: r["mse"] for r in one} == {k: pytest.approx(got["line", k]["mse"]) for k in range(K)}


def test_bags_and_forests(df):
    held = {r["k"]: r for r in df.select("k", *[poisson_count(hash_uniform(F.col("k"), b)).cast("double").alias(f"w{b}") for b in range(3)]).collect()}
    for make in (lambda b: C.Bayes(), lambda b: C.SoftTree(depth=2, rounds=4, seed=b)):
        want = np.mean([plain(make(b), X, Y, np.array([held[k][f"w{b}"] for k in range(N)]))(X) for b in range(3)], axis=0)
        # the row without a fold has a label and trains too
        model = C.bagging(df.filter("k < 900"), "k", make, COLUMNS, "y", 3)
        assert predicted(model.predict(df))[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("passthrough", [[], ["b"]])
def test_stacking(df, passthrough):
    members = {"bayes": (C.Bayes(), ["a"]), "line": (C.Linear(), ["b", "c"])}
    at = {"bayes": [0], "line": [1, 2]}
    seen, whole = np.zeros((N, 2)), []
    for j, (n, (e, _)) in enumerate(members.items()):
        for k in range(K):
            seen[FOLD == k, j] = plain(e, X[FOLD != k][:, at[n]], Y[FOLD != k])(X[FOLD == k][:, at[n]])
        whole.append(plain(e, X[:, at[n]], Y)(X[:, at[n]]))
    more = X[:, [1]] if passthrough else np.zeros((N, 0))
    want = plain(C.Logistic(0.1), np.column_stack([seen, more]), Y)(np.column_stack([*whole, more]))
    model = C.stacking(df, members, C.Logistic(0.1), "y", "fold", K, passthrough)
    got, all_ = predicted(model.predict(df))
    assert got == pytest.approx(want, abs=1e-6) and all_[900] is None


def test_calibration_on_rows_not_seen(df):
    def newton(s, y):
        n, p, ab = (y == 0).sum(), (y == 1).sum(), np.zeros(2)
        t, z = np.where(y == 1, (p + 1) / (p + 2), 1 / (n + 2)), np.column_stack([s, np.ones(len(s))])
        for _ in range(50):
            q = 1 / (1 + np.exp(-z @ ab))
            ab = ab - np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z, z.T @ (q - t))
        return lambda v: 1 / (1 + np.exp(-(ab[0] * v + ab[1])))

    folds = [plain(C.Linear(), X[FOLD != k], Y[FOLD != k]) for k in range(K)]
    turns = [newton(folds[k](X[FOLD == k]), Y[FOLD == k]) for k in range(K)]
    want = np.mean([turns[k](folds[k](X)) for k in range(K)], axis=0)
    assert predicted(C.calibrated(df, C.Linear(), COLUMNS, "y", "fold", K).predict(df))[0] == pytest.approx(want, abs=1e-6)
    score = np.zeros(N)
    for k in range(K):
        score[FOLD == k] = folds[k](X[FOLD == k])
    want = newton(score, Y)(plain(C.Linear(), X, Y)(X))
    assert predicted(C.calibrated(df, C.Linear(), COLUMNS, "y", "fold", K, ensemble=False).predict(df))[0] == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("folds", [0, K])
def test_chain(df, folds):
    first, x = plain(C.Bayes(), X, Y), X
    earlier = Y.copy()
    if folds:
        for k in range(K):
            earlier[FOLD == k] = plain(C.Bayes(), X[FOLD != k], Y[FOLD != k])(X[FOLD == k]) > 0.5
    second = plain(C.Bayes(), np.column_stack([x, earlier]), Z)
    want = second(np.column_stack([X, first(X) > 0.5]))
    model = C.chain(df.filter("k < 900"), C.Bayes(), COLUMNS, ["y", "z"], fold="fold" if folds else None, folds=folds)
    out = model.predict(df)
    assert predicted(out, "y_predicted")[0] == pytest.approx(first(X)) and predicted(out, "z_predicted")[0] == pytest.approx(want)
    both = C.multi_output(df.filter("k < 900"), C.Bayes(), COLUMNS, ["y", "z"]).predict(df)
    assert predicted(both, "z_predicted")[0] == pytest.approx(plain(C.Bayes(), X, Z)(X))


def test_elimination_chooses_a_number(df):
    rng = np.random.default_rng(3)
    noise = rng.normal(size=(N, 2))
    wide = df.filter("k < 900").join(df.sparkSession.createDataFrame([(i, *map(float, r)) for i, r in enumerate(noise)], "k int, d double, e double"), "k")
    v, names = np.column_stack([X, noise]), [*COLUMNS, "d", "e"]

    def importance(x, y):
        z = np.column_stack([np.ones(len(x)), x])
        return abs(np.linalg.lstsq(z, y, rcond=None)[0][1:]) * x.std(0)

    left, want, gone = {k: list(range(5)) for k in (*range(K), None)}, {}, []
    while True:
        size = len(left[None])
        want[size] = np.mean([((plain(C.Linear(), v[FOLD != k][:, left[k]], Y[FOLD != k])(v[FOLD == k][:, left[k]]) - Y[FOLD == k]) ** 2).mean() for k in range(K)])
        if size == 1:
            break
        for k in left:
            rows = slice(None) if k is None else FOLD != k
            weakest = int(np.argmin(importance(v[rows][:, left[k]], Y[rows])))
            if k is None:
                gone.append(left[k][weakest])
            left[k].pop(weakest)
    scores, ranks = C.eliminate(wide, C.Linear(), names, "y", "fold", K, C.mean_squared_error, greater=False)
    assert {r["n_features"]: r["score"] for r in scores.collect()} == {n: pytest.approx(s) for n, s in want.items()}
    best = min(want, key=lambda n: (want[n], n))
    order = {names[c]: 5 - i for i, c in enumerate(gone)}
    assert {r["feature"]: r["rank"] for r in ranks.collect()} == {c: max(1, order.get(c, 1) - best + 1) for c in names}


def test_empty_tables(df):
    out, _, _ = C.out_of_fold(df.limit(0), {"m": (C.Bayes(), ["a"])}, "y", "fold", K)
    assert out.count() == 0
    assert C.search(df.limit(0), {"m": C.Linear()}, ["a"], "y", "fold", K, {"mse": C.mean_squared_error}).count() == 0
    with pytest.raises(NotImplementedError):
        C.eliminate(df, own_estimator(), COLUMNS, "y", "fold", K, C.mean_squared_error)
