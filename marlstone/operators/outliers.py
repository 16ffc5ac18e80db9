"""Outlier detectors: boolean flags from broadcast statistics, and scores from neighbours over cells of pivots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import present
from ..sources.shared import materialize
from .clustering import dbscan
from .neighbors import nearest
from .ordering import order_statistics, percentile_row


def _any(tests: Sequence[Column]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]), F.lit(False))


def flag_zscore(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """is_outlier: any column further than threshold population deviations from its mean."""
    row = df.agg(*[F.struct(F.avg(present(df, c)).alias("m"), F.stddev_pop(present(df, c)).alias("s")).alias(f"_{c}") for c in columns])
    tests = [F.abs(F.col(c) - F.col(f"_{c}.m")) > threshold * F.col(f"_{c}.s") for c in columns]
    return df.crossJoin(F.broadcast(row)).select(*df.columns, _any(tests).alias("is_outlier"))


def flag_iqr(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    row = percentile_row(df, {f"_{c}": present(df, c) for c in columns}, (0.25, 0.75))
    width = lambda c: F.col(f"_{c}")[1] - F.col(f"_{c}")[0]
    tests = [(F.col(c) < F.col(f"_{c}")[0] - k * width(c)) | (F.col(c) > F.col(f"_{c}")[1] + k * width(c)) for c in columns]
    return df.crossJoin(F.broadcast(row)).select(*df.columns, _any(tests).alias("is_outlier"))


def flag_mad(df: DataFrame, columns: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """0.6745 |x - median| / MAD above the threshold; a MAD of 0 counts as 1."""
    medians = {c: q[0] for c, q in order_statistics(df, {c: present(df, c) for c in columns}, (0.5,)).items()}
    off = lambda c: F.abs(present(df, c) - F.lit(medians[c]).cast("double"))
    mads = {c: q[0] for c, q in order_statistics(df, {c: off(c) for c in columns}, (0.5,)).items()}
    return df.select(*df.columns, _any([0.6745 * off(c) / (mads[c] or 1.0) > threshold for c in columns]).alias("is_outlier"))


def dbscan_noise(df: DataFrame, key: str, vector: str, eps: float, min_samples: int) -> DataFrame:
    """key, is_noise: not a core row and no core row within eps; a row counts among its own neighbours. Rows that take no part are noise."""
    found = dbscan(df, key, vector, eps, min_samples).filter("cluster >= 0").select(F.col(key).alias("_i"), F.lit(True).alias("_r"))
    return df.select(key).join(found, F.col(key) == F.col("_i"), "left").select(key, F.col("_r").isNull().alias("is_noise"))


def local_outlier_factor(df: DataFrame, key: str, vector: str, k: int = 20) -> DataFrame:
    """key, lof: mean local reachability density of the k neighbours over the row's own."""
    near = materialize(nearest(df, key, vector, k), "near")
    kdist = near.groupBy("i").agg(F.max("d").alias("kd"))
    reach = near.join(kdist.select(F.col("i").alias("j"), "kd"), "j").select("i", "j", F.greatest("kd", "d").alias("reach"))
    lrd = reach.groupBy("i").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    ratio = reach.join(lrd, "i").join(lrd.select(F.col("i").alias("j"), F.col("lrd").alias("other")), "j")
    return ratio.groupBy("i").agg((F.avg("other") / F.first("lrd")).alias("lof")).withColumnRenamed("i", key)


def mahalanobis(df: DataFrame, key: str, columns: Sequence[str], refinements: int = 0) -> DataFrame:
    """key, distance2: squared Mahalanobis distance; each refinement refits on the nearer half of the rows.

    The covariance (few columns) is inverted on the driver.
    """
    import numpy as np

    part, d2 = df, None
    for turn in range(refinements + 1):
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
        row = part.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
        cov = np.zeros((len(columns), len(columns)))
        for k, (a, b) in enumerate(pairs):
            cov[columns.index(a), columns.index(b)] = cov[columns.index(b), columns.index(a)] = row[f"c{k}"]
        inverse = np.linalg.pinv(cov)
        x = [F.col(c) - F.lit(row[f"m{i}"]) for i, c in enumerate(columns)]
        terms = [float(inverse[i, j]) * x[i] * x[j] for i in range(len(columns)) for j in range(len(columns))]
        d2 = df.select(key, *columns, reduce(lambda a, b: a + b, terms).alias("distance2"))
        if turn < refinements:
            median = order_statistics(d2, {"d": F.col("distance2")}, (0.5,))["d"][0]
            part = d2.filter(F.col("distance2") <= F.lit(median))
    return d2.select(key, "distance2")


def isolation_forest(df: DataFrame, key: str, columns: Sequence[str], trees: int = 50, sample: int = 256, seed: int = 7) -> DataFrame:
    """key, score in (0, 1), higher: more isolated.

    Each tree is grown on a bounded sample of rows in a task of its own; the
    trees (trees * 2 * sample nodes) are broadcast and score Arrow batches.
    """
    import numpy as np

    columns = list(columns)
    n = df.count()
    share = min(1.0, 1.5 * sample / max(n, 1))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: F.pmod(F.xxhash64(F.col(key), tree, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    picked = df.select(*[F.col(c).cast("double").alias(c) for c in columns], F.explode(drawn).alias("tree"), F.col(key).alias("_k"))

    def grow(pdf):
        import pandas as pd

        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        rows = pdf.sort_values("_k")[columns].dropna().to_numpy()
        rows = rows[rng.permutation(len(rows))[:sample]]
        depth = int(np.ceil(np.log2(max(2, len(rows)))))
        out = []

        def split(part, level, node):
            spans = part.max(0) - part.min(0) if len(part) else np.zeros(len(columns))
            if level >= depth or len(part) <= 1 or not spans.any():
                out.append((tree, node, -1, 0.0, float(len(part)), len(rows)))
                return
            f = rng.choice(np.flatnonzero(spans))
            at = rng.uniform(part[:, f].min(), part[:, f].max())
            out.append((tree, node, int(f), float(at), float(len(part)), len(rows)))
            split(part[part[:, f] < at], level + 1, 2 * node + 1)
            split(part[part[:, f] >= at], level + 1, 2 * node + 2)

        split(rows, 0, 0)
        return pd.DataFrame(out, columns=["tree", "node", "feature", "at", "size", "n"])

    nodes = picked.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, at double, size double, n int").collect()
    forest: dict[int, dict[int, tuple]] = {}
    for r in nodes:
        forest.setdefault(r["tree"], {})[r["node"]] = (r["feature"], r["at"], r["size"])
    used = max([r["n"] for r in nodes], default=2)
    packed = df.sparkSession.sparkContext.broadcast(forest)

    def path(m):
        m = np.maximum(m, 1.0)
        return np.where(m > 2, 2 * (np.log(np.maximum(m - 1, 1)) + 0.5772156649) - 2 * (m - 1) / m, np.where(m == 2, 1.0, 0.0))

    def score(batches):
        for pdf in batches:
            x, total = pdf[columns].to_numpy(), np.zeros(len(pdf))
            for tree in packed.value.values():
                stack = [(0, np.arange(len(x)), 0)]
                while stack:
                    node, rows, level = stack.pop()
                    feature, at, size = tree[node]
                    if feature < 0 or not len(rows):
                        total[rows] += level + float(path(np.array(size)))
                        continue
                    left = x[rows, feature] < at
                    stack += [(2 * node + 1, rows[left], level + 1), (2 * node + 2, rows[~left], level + 1)]
            yield pdf[[key]].assign(score=2 ** (-total / max(1, len(packed.value)) / max(1e-9, float(path(np.array(float(used)))))))

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(score, f"{key} {kind}, score double")
