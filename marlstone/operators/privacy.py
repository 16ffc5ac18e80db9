"""Differential privacy, privacy ledgers and secure aggregation as data operators.

Noise is a function of a row's key and a secret seed, so a recomputed row gets the same
noise and a lost executor leaks nothing. Whoever knows the seed can take the noise away:
there is no default, every release takes a fresh one that is hard to guess, and plans
of noisy queries show it. Keys are unique and not null. noise=False gives the exact
statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, log, pi, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import clip, dot

#: Orders of the Renyi ledger.
ALPHAS = [1.5, 2.0, 3.0, 4.0, 5.0, 8.0, 16.0, 32.0, 64.0]


def laplace_scale(sensitivity: float, epsilon: float) -> float:
    return sensitivity / epsilon


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    return sensitivity * sqrt(2 * log(1.25 / delta)) / epsilon


Seed = str | int | None


def secret_uniform(key: Column, seed: Seed) -> Column:
    """A number in (0, 1): the first 52 bits of the SHA-256 of seed and key."""
    if seed is None or seed == "":
        raise ValueError("noise needs a secret seed")
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), key.cast("string")).cast("binary"), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def laplace_noise(key: Column, scale: Column | float, seed: Seed) -> Column:
    u = secret_uniform(key, seed) - 0.5
    return -scale * F.signum(u) * F.log(1 - 2 * F.abs(u))


def gaussian_noise(key: Column, sigma: Column | float, seed: Seed) -> Column:
    """Box-Muller on two hashes of the key."""
    u, v = (secret_uniform(F.concat_ws("|", F.lit(n), key), seed) for n in ("radius", "angle"))
    return sigma * F.sqrt(-2 * F.log(u)) * F.cos(2 * pi * v)


def _key(use: str, *parts: Column | str) -> Column:
    """Keys of different uses differ, so that one seed does not give two of them the same noise."""
    return F.concat_ws("|", F.lit(use), *parts)


def clip_rows(df: DataFrame, columns: Sequence[str], bound: float) -> DataFrame:
    """Rows scaled down to an L2 norm of at most bound."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    factor = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(bound), F.sqrt(dot(values, values))), F.lit(1.0)))
    return df.withColumn("_factor", factor).withColumns({c: F.col(c) * F.col("_factor") for c in columns}).drop("_factor")


def private_rows(df: DataFrame, key: str, columns: Sequence[str], bound: float, epsilon: float, seed: Seed = None, noise: bool = True) -> DataFrame:
    """Clipped rows with Laplace noise for a release of every row: sensitivity is the whole bound."""
    out = clip_rows(df, columns, bound)
    if noise:
        out = out.withColumns({c: F.col(c) + laplace_noise(_key("rows", F.lit(c), key), laplace_scale(bound, epsilon), seed) for c in columns})
    return out


def private_mean(df: DataFrame, columns: Sequence[str], bound: float, epsilon: float, seed: Seed = None, noise: bool = True) -> DataFrame:
    """Means of clipped rows; sensitivity bound / n."""
    row = clip_rows(df, columns, bound).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in columns])
    add = lambda c: laplace_noise(_key("mean", F.lit(c)), bound / F.col("_n") / epsilon, seed) if noise else F.lit(0.0)
    return row.select(*[(F.col(c) + add(c)).alias(c) for c in columns])


def private_histogram(df: DataFrame, column: str, low: float, high: float, bins: int, epsilon: float, seed: Seed = None, noise: bool = True) -> DataFrame:
    """bin, n for every bin of a given range (empty ones get noise too), at least 0."""
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / ((high - low) / bins))).cast("int")
    counts = df.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    value = F.coalesce("n", F.lit(0)).cast("double")
    return spine.join(counts, "bin", "left").select("bin", F.greatest(F.lit(0.0), value + laplace_noise(_key("histogram", "bin"), 1 / epsilon, seed) if noise else value).alias("n"))


def exponential_choice(df: DataFrame, item: str, utility: str, epsilon: float, sensitivity: float, seed: Seed = None, noise: bool = True) -> DataFrame:
    """One item with probability proportional to exp(epsilon u / 2 s), by the Gumbel maximum."""
    gumbel = -F.log(-F.log(secret_uniform(_key("choice", item), seed))) if noise else F.lit(0.0)
    return df.agg(F.max_by(item, F.struct(epsilon * F.col(utility) / (2 * sensitivity) + gumbel, item)).alias(item))


def ledger_basic(ledger: DataFrame, total_epsilon: float, total_delta: float) -> DataFrame:
    """Sums of the budget used and what is left."""
    row = ledger.agg(F.count(F.lit(1)).alias("queries"), F.sum("epsilon").alias("epsilon"), F.sum("delta").alias("delta"))
    return row.withColumn("epsilon_left", F.greatest(F.lit(0.0), total_epsilon - F.col("epsilon"))).withColumn("affordable", (F.col("epsilon") <= total_epsilon) & (F.col("delta") <= total_delta))


def ledger_advanced(ledger: DataFrame, slack: float) -> DataFrame:
    """sqrt(2 k ln(1 / slack)) e + k e (exp(e) - 1), with the largest e of k queries."""
    k, e = F.count(F.lit(1)), F.max("epsilon")
    return ledger.agg(k.alias("queries"), (F.sqrt(2 * k * F.log(F.lit(1 / slack))) * e + k * e * (F.exp(e) - 1)).alias("epsilon"), (F.sum("delta") + slack).alias("delta"))


def ledger_renyi(ledger: DataFrame, delta: float, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """The smallest epsilon over orders a of sum(a / (2 sigma^2)) + ln(1 / delta) / (a - 1); ledger has sigma."""
    orders = F.explode(F.array(*map(F.lit, alphas)))
    sums = ledger.agg(F.sum(1 / (2 * F.col("sigma") * F.col("sigma"))).alias("s")).select("s", orders.alias("a"))
    value = F.col("a") * F.col("s") + log(1 / delta) / (F.col("a") - 1)
    return sums.agg(F.min(value).alias("epsilon"), F.min_by("a", value).alias("order"))


def affordable_prefix(ledger: DataFrame, order: str, by: str, total: float) -> DataFrame:
    """Ledger rows with a flag: a query is accepted while the running sum of its owner stays in the budget."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ledger.withColumn("used", F.sum("epsilon").over(w)).withColumn("accepted", F.col("used") <= total)


def amplified_epsilon(epsilon: float, rate: float) -> float:
    """Epsilon of a mechanism on a sample of the rows."""
    return log(1 + rate * (exp(epsilon) - 1))


def pair_masks(parties: DataFrame, party: str, size: int, seed: str, modulus: int = 1 << 32) -> DataFrame:
    """party, mask: for every pair the lower party adds and the higher subtracts the same integers, drawn from SHA-256 of seed and pair."""
    a, b = parties.select(F.col(party).alias("lo")), parties.select(F.col(party).alias("hi"))
    pairs = a.join(b, F.col("lo") < F.col("hi"))
    draw = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("lo"), F.col("hi"), k.cast("string")), 256), 1, 8), 16, 10).cast("long")
    values = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), draw)
    signed = pairs.withColumn("m", values)
    both = signed.select(F.col("lo").alias(party), "m").unionAll(signed.select(F.col("hi").alias(party), F.transform("m", lambda x: -x).alias("m")))
    summed = both.select(party, F.posexplode("m")).groupBy(party, "pos").agg(F.pmod(F.sum("col"), F.lit(modulus)).alias("v"))
    return summed.groupBy(party).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("mask"))


def masked_sum(vectors: DataFrame, party: str, vector: str, masks: DataFrame, surviving: DataFrame | None = None, all_parties: DataFrame | None = None, seed: str = "", modulus: int = 1 << 32) -> DataFrame:
    """pos, total: sum of masked integer vectors; masks of parties that dropped out are taken back.

    What is left of the masks of the surviving parties is their sum, which equals
    minus the sum of the others' masks.
    """
    masked = vectors.join(masks, party).select(party, F.zip_with(vector, "mask", lambda x, m: F.pmod(x + m, F.lit(modulus))).alias("v"))
    if surviving is not None:
        masked = masked.join(surviving.select(party), party, "left_semi")
    total = masked.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("total"))
    if surviving is not None:
        gone = masks.join(surviving.select(party), party, "left_anti").select(F.posexplode("mask")).groupBy("pos").agg(F.sum("col").alias("rest"))
        total = total.join(gone, "pos", "left").select("pos", (F.col("total") + F.coalesce("rest", F.lit(0))).alias("total"))
    wrapped = F.pmod(F.col("total"), F.lit(modulus))
    return total.select("pos", F.when(wrapped >= modulus // 2, wrapped - modulus).otherwise(wrapped).alias("total"))


def weighted_aggregate(df: DataFrame, weight: str, vector: str) -> DataFrame:
    """pos, value: weighted mean of vectors."""
    return df.select(weight, F.posexplode(vector)).groupBy("pos").agg((F.sum(F.col(weight) * F.col("col")) / F.sum(weight)).alias("value"))


def clip_gradients(df: DataFrame, vector: str, bound: float, norm: str = "l2") -> DataFrame:
    """Vectors held to an L2 norm or to a largest component."""
    if norm == "linf":
        return df.withColumn(vector, F.transform(vector, lambda x: clip(x, -bound, bound)))
    factor = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(bound), F.sqrt(dot(F.col(vector), F.col(vector)))), F.lit(1.0)))
    return df.withColumn("_f", factor).withColumn(vector, F.transform(vector, lambda x: x * F.col("_f"))).drop("_f")


def private_labels(df: DataFrame, key: str, label: str, epsilon: float, sensitivity: float = 1.0, seed: Seed = None, noise: bool = True) -> DataFrame:
    """Labels with Laplace noise of their own."""
    return df.withColumn(label, F.col(label) + laplace_noise(_key("labels", F.lit(label), key), laplace_scale(sensitivity, epsilon), seed)) if noise else df


def private_dataset(df: DataFrame, key: str, columns: Sequence[str], label: str, bound: float, epsilon: float, sensitivity: float = 1.0, seed: Seed = None, noise: bool = True) -> DataFrame:
    """Features and labels of every row released together; each half takes half of epsilon."""
    return private_labels(private_rows(df, key, columns, bound, epsilon / 2, seed, noise), key, label, epsilon / 2, sensitivity, seed, noise)


def private_gradient_step(df: DataFrame, columns: Sequence[str], label: str, weights: Sequence[float], bound: float, multiplier: float, rate: float, seed: Seed = None, noise: bool = True) -> list[float]:
    """Logistic weights (intercept first) after one step on per-row gradients clipped to bound, summed with Gaussian noise; one aggregation."""
    v = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns])
    e = 1 / (1 + F.exp(-dot(v, F.array(*map(F.lit, map(float, weights)))))) - F.col(label)
    size = F.abs(e) * F.sqrt(dot(v, v))
    clipped = e * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(bound), size), F.lit(1.0)))
    add = lambda k: gaussian_noise(_key("gradient", F.lit(k)), multiplier * bound, seed) if noise else F.lit(0.0)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[(F.sum(clipped * v[k]) + add(k)).alias(f"g{k}") for k in range(len(weights))]).first()
    return [w - rate * (row[f"g{k}"] or 0.0) / max(row["n"], 1) for k, w in enumerate(weights)]


def private_training(df: DataFrame, columns: Sequence[str], label: str, steps: int, bound: float, multiplier: float, rate: float, seed: Seed = None, noise: bool = True) -> list[float]:
    """Logistic weights after so many private steps over all rows, each with noise of its own."""
    weights = [0.0] * (len(columns) + 1)
    for step in range(steps):
        weights = private_gradient_step(df, columns, label, weights, bound, multiplier, rate, seed if seed is None else f"{seed}|{step}", noise)
    return weights
