"""Clusterings by density, by merging, by modes and by the graph of neighbours.

All of them work on sites (distinct vectors with the number of their rows) and on
sweeps over cells of pivots (neighbors.py), so that neither all pairs nor a dense
group of rows meet in one task. Rows with a null key or vector, or a null or NaN
in the vector, are left out of the results. Vectors have one length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize
from .fitting import assign_nearest, kmeans
from .graphs import components
from .neighbors import Cells, Kernel, distances, matrix, nearest, sites, vector_rows
from .ordering import row_numbers


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """i, cluster (from 0, by the smallest key of each) from rows and the leader of each site; sites without one have -1."""
    joined = rows.join(found, F.col("_v") == F.col("v"), "left")
    leaders = found.filter("leader is not null").select("leader").distinct()
    numbers = row_numbers(leaders, ["leader"], "cluster")
    return joined.join(numbers, "leader", "left").select(F.col("_key").alias("i"), F.coalesce("cluster", F.lit(-1)).alias("cluster"))


# --- by density


class _Count(Kernel):
    """Rows within eps of each held site."""

    def __init__(self, eps: float) -> None:
        super().__init__()
        self.eps = eps

    def start(self, site, v, n):
        self.near = np.zeros(len(site), np.int64)

    def meet(self, d, site, n):
        self.near += (d <= self.eps) @ n

    def result(self):
        return {"site": self.held[0], "near": self.near}

    def nothing(self):
        return {"site": np.zeros(0, np.int64), "near": np.zeros(0, np.int64)}


class _Links(Kernel):
    """A forest that joins the held and visiting sites that are within eps of each other; at most one edge for each site."""

    def __init__(self, eps: float) -> None:
        super().__init__()
        self.eps = eps

    def start(self, site, v):
        self.group = np.arange(len(site))  # of held sites, by the index of its first
        self.edges: list[tuple[int, int]] = []

    def meet(self, d, site):
        mine = self.held[0]
        for c in range(len(site)):
            hit = np.flatnonzero(d[:, c] <= self.eps)
            if not len(hit):
                continue
            groups = np.unique(self.group[hit])
            for g in groups:
                if mine[g] != site[c]:
                    self.edges.append((int(mine[g]), int(site[c])))
            if len(groups) > 1:
                self.group[np.isin(self.group, groups)] = groups[0]

    def result(self):
        edges = np.array(self.edges, np.int64).reshape(-1, 2)
        return {"u": edges[:, 0], "v": edges[:, 1]}

    def nothing(self):
        return {"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)}


class _FirstLeader(Kernel):
    """The smallest leader within eps of each held site."""

    def __init__(self, eps: float) -> None:
        super().__init__()
        self.eps, self.none = eps, np.iinfo(np.int64).max

    def start(self, site, v, leader):
        self.leader = np.full(len(site), self.none)

    def meet(self, d, site, leader):
        self.leader = np.minimum(self.leader, np.where(d <= self.eps, leader[None, :], self.none).min(axis=1, initial=self.none))

    def result(self):
        some = self.leader < self.none
        return {"site": self.held[0][some], "leader": self.leader[some]}

    def nothing(self):
        return {"site": np.zeros(0, np.int64), "leader": np.zeros(0, np.int64)}


def dbscan(df: DataFrame, key: str, vector: str, eps: float = 0.5, min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """key, cluster, is_core of each row; cluster -1 is noise.

    A row with at least min_samples rows within eps, itself included, is core; core
    rows within eps of each other share a cluster; other rows within eps of a core
    row take the cluster that comes first. Clusters are numbered from 0 by their
    smallest core key.
    """
    rows = materialize(vector_rows(df, key, vector), "vectors")
    table = materialize(sites(rows), "sites")
    cells = Cells(table, metric)
    housed = materialize(cells.housed(table), "housed")
    near = cells.sweep(housed, table.select("site", "v", "n"), f"{eps!r}D", lambda: _Count(eps), "site long, near long")
    core = materialize(housed.join(near, "site").withColumn("core", F.col("near") >= min_samples), "core")
    cores = core.filter("core")
    edges = cells.sweep(cores.select("site", "v", "home", "off"), cores.select("site", "v"), f"{eps!r}D", lambda: _Links(eps), "u long, v long")
    joined = components(edges)
    leaders = materialize(cores.select("site", "v").join(joined, F.col("site") == F.col("node"), "left").select("site", "v", F.coalesce("component", "site").alias("leader")), "leaders")
    border = core.filter("not core").select("site", "v", F.lit(0).cast("long").alias("leader"), "home", "off")
    reached = cells.sweep(border, leaders, f"{eps!r}D", lambda: _FirstLeader(eps), "site long, leader long")
    found = leaders.withColumn("core", F.lit(True)).unionByName(core.filter("not core").select("site", "v").join(reached, "site", "left").select("site", "v", "leader", F.lit(False).alias("core")))
    found = materialize(found.select("v", "leader", "core"), "found")
    clusters = _labelled(rows, found.select("v", "leader"))
    is_core = rows.join(found, F.col("_v") == F.col("v")).select(F.col("_key").alias("_i"), "core")
    return clusters.join(is_core, F.col("i") == F.col("_i")).select(F.col("i").alias(key), "cluster", F.col("core").alias("is_core"))


# --- by merging


class _NearestOther(Kernel):
    """Of the held sites of each group, the shortest way to a site of another group; ties by keys.

    With weights, lengths are Ward's: sqrt(2 m n / (m + n)) times the distance of the means.
    """

    def __init__(self, ward: bool) -> None:
        super().__init__()
        self.ward = ward

    def start(self, site, v, grp, n):
        self.best = np.full(len(site), np.inf)
        self.to = np.full(len(site), np.iinfo(np.int64).max)
        self.to_group = np.zeros(len(site), np.int64)

    def meet(self, d, site, grp, n):
        _, _, mine, own = self.held
        if self.ward:
            d = d * np.sqrt(2.0 * own[:, None] * n[None, :] / (own[:, None] + n[None, :]))
        d = np.where(mine[:, None] == grp[None, :], np.inf, d)
        order = np.argsort(site, kind="stable")
        at = order[d[:, order].argmin(axis=1)] if len(site) else np.zeros(0, np.int64)
        least = d[np.arange(len(d)), at]
        closer = (least < self.best) | ((least == self.best) & np.isfinite(least) & (site[at] < self.to))
        self.best = np.where(closer, least, self.best)
        self.to_group = np.where(closer, grp[at], self.to_group)
        self.to = np.where(closer, site[at], self.to)

    def result(self):
        site, _, grp, _ = self.held
        low, high = np.minimum(site, self.to), np.maximum(site, self.to)
        order = np.lexsort((high, low, self.best, grp))
        order = order[np.isfinite(self.best[order])]
        first = np.ones(len(order), bool)
        first[1:] = grp[order][1:] != grp[order][:-1]
        at = order[first]
        return {"grp": grp[at], "d": self.best[at], "low": low[at], "high": high[at], "other": self.to_group[at]}

    def nothing(self):
        none = np.zeros(0, np.int64)
        return {"grp": none, "d": np.zeros(0), "low": none, "high": none, "other": none}


_WAY = "grp long, d double, low long, high long, other long"


def _shortest_ways(cells: Cells, housed: DataFrame, right: DataFrame, look: str, ward: bool) -> DataFrame:
    found = cells.sweep(housed, right, look, lambda: _NearestOther(ward), _WAY)
    return found.groupBy("grp").agg(F.min(F.struct("d", "low", "high", "other")).alias("way")).select("grp", "way.*")


def spanning_tree(df: DataFrame, key: str, vector: str, metric: str = "euclidean") -> DataFrame:
    """low, high, d: the minimum spanning tree of the sites of df, ties by keys.

    Every round finds each tree's shortest way out and joins the trees along these
    ways (Borůvka). A tree looks no further than the shortest way out that its own
    pivots, or the pivots of the cells of its sites, already give.
    """
    table = materialize(sites(vector_rows(df, key, vector)), "sites")
    return _spanning_tree(table, metric)


def _spanning_tree(table: DataFrame, metric: str) -> DataFrame:
    cells = Cells(table, metric)
    if cells.n <= cells.block:
        return materialize(table.select("site", "v").coalesce(1).mapInArrow(_grow_tree(metric), "low long, high long, d double"), "tree")
    housed = materialize(cells.housed(table.select("site", "v")).withColumn("grp", F.col("site")), "housed")
    tree = None
    while True:
        pivots = housed.filter(F.col("site").isin(cells.sites.tolist())).select("site", "grp").collect()  # at most MOST_PIVOTS
        of = {r["site"]: r["grp"] for r in pivots}
        groups = np.array([of[s] for s in cells.sites.tolist()], np.int64)
        between = np.where(groups[:, None] == groups[None, :], np.inf, distances(cells.pivots, cells.pivots, metric)) if cells.n else np.zeros((0, 0))
        known: dict[int, float] = {}
        for g, x in zip(groups.tolist(), between.min(axis=1, initial=np.inf).tolist()):
            known[g] = min(known.get(g, np.inf), x)
        at_home = F.element_at(F.array(*[F.lit(g) for g in groups.tolist()]), F.col("home") + 1) if len(groups) else F.lit(None)
        bound = housed.groupBy("grp").agg(F.min(F.when(at_home != F.col("grp"), F.col("off"))).alias("way"))
        named = table.sparkSession.createDataFrame([(g, x) for g, x in known.items() if np.isfinite(x)], "grp long, pivot_way double")
        bound = bound.join(F.broadcast(named), "grp", "left").select("grp", F.coalesce(F.least("way", "pivot_way"), F.lit(float("inf"))).alias("look"))
        left = materialize(housed.join(bound, "grp").select("site", "v", "grp", F.lit(1).cast("long").alias("n"), "home", "off", "look"), "left")
        looked = left.select("site", "v", "grp", "n", "home", "off")
        ways = materialize(_ways_of(cells, left, looked), "ways")
        if ways.isEmpty():
            return tree if tree is not None else ways.select("low", "high", "d")
        new = ways.select("low", "high", "d").distinct()
        joined = components(ways.select(F.col("grp").alias("u"), F.col("other").alias("v")))
        grown = materialize(new if tree is None else tree.unionByName(new), "tree")
        moved = materialize(housed.join(joined, F.col("grp") == F.col("node"), "left").select("site", "v", "home", "off", F.coalesce("component", "grp").alias("grp")), "housed")
        discard(housed, left, ways, *([] if tree is None else [tree]))
        housed, tree = moved, grown


def _grow_tree(metric: str):
    """The tree of at most a block of sites, grown in one task from the smallest key."""

    def run(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), matrix(b.column(1))) for b in batches if b.num_rows]
        edges: list[tuple[int, int, float]] = []
        if parts:
            site, v = map(np.concatenate, zip(*parts))
            order = np.argsort(site)
            site, v = site[order], v[order]
            best, by, rest = distances(v[:1], v, metric)[0], np.zeros(len(site), np.int64), np.arange(1, len(site))
            while len(rest):
                low, high = np.minimum(rest, by[rest]), np.maximum(rest, by[rest])
                k = np.lexsort((high, low, best[rest]))[0]
                new = rest[k]
                edges.append((int(site[low[k]]), int(site[high[k]]), float(best[new])))
                rest = np.delete(rest, k)
                d = distances(v[new : new + 1], v, metric)[0]
                nearer = (d < best) | ((d == best) & (np.minimum(np.arange(len(site)), new) < np.minimum(np.arange(len(site)), by)))
                best, by = np.where(nearer, d, best), np.where(nearer, new, by)
        low, high, d = zip(*edges) if edges else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(d, pa.float64())], ["low", "high", "d"])

    return run


def _ways_of(cells: Cells, left: DataFrame, looked: DataFrame) -> DataFrame:
    right = looked.select("site", "v", "grp", "n")
    far = {r["home"]: r["far"] for r in left.groupBy("home").agg(F.max(F.col("off") + F.col("look")).alias("far")).collect()}  # at most MOST_PIVOTS
    listed = ", ".join(_number(far.get(k, 0.0)) for k in range(len(cells.pivots)))
    return _shortest_ways(cells, looked, right, f"element_at(array({listed}), home + 1) - off", ward=False)


def _number(x: float) -> str:
    return "double('infinity')" if np.isinf(x) else f"{float(x)!r}D"


def ward_merges(df: DataFrame, key: str, vector: str) -> DataFrame:
    """a, b, height: every merge of Ward's clustering of the sites of df; clusters are named by their smallest key.

    Two clusters that are each other's nearest merge whatever happens elsewhere, so
    each round merges all such pairs; what is left, once it fits into a block,
    merges in one task.
    """
    return _ward_merges(materialize(sites(vector_rows(df, key, vector)), "sites"))


def _ward_merges(table: DataFrame) -> DataFrame:
    schema = "a long, b long, height double"
    left, merges = table.select("site", "v", "n"), None
    while True:
        cells = Cells(left)
        if cells.n <= cells.block:
            last = left.coalesce(1).mapInArrow(_merge_all, schema)
            return materialize(last if merges is None else merges.unionByName(last), "merges")
        lightest = left.agg(F.min("n")).first()[0]
        of = {r["site"]: r["n"] for r in left.filter(F.col("site").isin(cells.sites.tolist())).select("site", "n").collect()}  # at most MOST_PIVOTS
        weight = np.array([of[s] for s in cells.sites.tolist()], float)
        length = distances(cells.pivots, cells.pivots) * np.sqrt(2 * weight[:, None] * weight[None, :] / (weight[:, None] + weight[None, :]))
        np.fill_diagonal(length, np.inf)
        at = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col("home") + 1)
        m, n = at(weight), F.col("n").cast("double")
        own = F.element_at(F.array(*[F.lit(s) for s in cells.sites.tolist()]), F.col("home") + 1) == F.col("site")
        way = F.when(own, at(length.min(axis=1))).otherwise(F.col("off") * F.sqrt(2 * m * n / (m + n)))
        look = way / F.sqrt(2 * n * F.lit(float(lightest)) / (n + F.lit(float(lightest))))  # a factor that no other cluster undercuts
        housed = materialize(cells.housed(left).withColumns({"grp": F.col("site"), "look": look}), "housed")
        right = housed.select("site", "v", "grp", "n")
        far = {r["home"]: r["far"] for r in housed.groupBy("home").agg(F.max(F.col("off") + F.col("look")).alias("far")).collect()}
        listed = ", ".join(_number(far.get(k, 0.0)) for k in range(len(cells.pivots)))
        ways = materialize(_shortest_ways(cells, housed.select("site", "v", "grp", "n", "home", "off"), right, f"element_at(array({listed}), home + 1) - off", ward=True), "ways")
        back = ways.select(F.col("grp").alias("_g"), F.col("other").alias("_o"))
        pairs = materialize(ways.join(back, (F.col("other") == F.col("_g")) & (F.col("grp") == F.col("_o"))).filter("grp < other").select(F.col("grp").alias("a"), F.col("other").alias("b"), F.col("d").alias("height")), "merges")
        to = pairs.select(F.col("b").alias("site"), F.col("a").alias("to"))
        mean = F.transform(F.arrays_zip(F.col("x"), F.col("y")), lambda p: p["x"] + (p["y"] - p["x"]) * (F.col("k") / (F.col("n") + F.col("k"))))
        taken = left.join(to, "site").select(F.col("to").alias("site"), F.col("v").alias("y"), F.col("n").alias("k"))
        stays = left.join(to, "site", "left_anti").withColumnRenamed("v", "x").join(taken, "site", "left")
        following = materialize(stays.select("site", F.when(F.col("y").isNull(), F.col("x")).otherwise(mean).alias("v"), (F.col("n") + F.coalesce("k", F.lit(0))).alias("n")), "clusters")
        merges = materialize(pairs if merges is None else merges.unionByName(pairs), "merges")
        discard(housed, ways)
        left = following


def _merge_all(batches):
    """All merges of at most a block of clusters, each round those of pairs that are each other's nearest."""
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy().astype(float)) for b in batches if b.num_rows]
    out: list[tuple[int, int, float]] = []
    if parts:
        site, v, n = map(np.concatenate, zip(*parts))
        order = np.argsort(site)
        site, v, n = site[order], v[order], n[order]
        while len(site) > 1:
            d = distances(v, v) * np.sqrt(2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]))
            np.fill_diagonal(d, np.inf)
            to = d.argmin(axis=1)  # ties go to the smaller key
            a = np.flatnonzero((to[to] == np.arange(len(site))) & (np.arange(len(site)) < to))
            if not len(a):  # ties that form a ring
                a = np.array([np.unravel_index(d.argmin(), d.shape)[0]])
                to[a] = d[a].argmin(axis=1)
            b = to[a]
            out += zip(site[np.minimum(a, b)].tolist(), site[np.maximum(a, b)].tolist(), d[a, b].tolist())
            a, b = np.minimum(a, b), np.maximum(a, b)
            v[a] = v[a] + (v[b] - v[a]) * (n[b] / (n[a] + n[b]))[:, None]
            n[a] += n[b]
            rest = np.ones(len(site), bool)
            rest[b] = False
            site, v, n = site[rest], v[rest], n[rest]
    a, b, height = zip(*out) if out else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(height, pa.float64())], ["a", "b", "height"])


def agglomerative(df: DataFrame, key: str, vector: str, n_clusters: int = 2, linkage: str = "ward", metric: str = "euclidean") -> DataFrame:
    """key, cluster of each row: merging stops at n_clusters. Clusters are numbered from 0 by their smallest key.

    single: the longest n_clusters - 1 edges leave the minimum spanning tree.
    ward: the highest n_clusters - 1 merges are undone (heights never fall on the
    way up). Complete and average linkage need distances of all pairs and are not
    offered.
    """
    if linkage not in ("single", "ward") or linkage == "ward" and metric != "euclidean":
        raise ValueError(f"no linkage {linkage} with {metric}")
    rows = materialize(vector_rows(df, key, vector), "vectors")
    table = materialize(sites(rows), "sites")
    joins = _ward_merges(table).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("height").alias("d")) if linkage == "ward" else _spanning_tree(table, metric).select(F.col("low").alias("u"), F.col("high").alias("v"), "d")
    keep = max(0, table.count() - max(1, n_clusters))
    kept = row_numbers(joins, ["d", "u", "v"], "_at").filter(F.col("_at") < keep)
    found = table.join(components(kept.select("u", "v")), F.col("site") == F.col("node"), "left").select(table["v"], F.coalesce("component", "site").alias("leader"))
    return _labelled(rows, found).select(F.col("i").alias(key), "cluster")


# --- by modes


class _Shift(Kernel):
    """Where the kernel-weighted mean of the rows near each held seed lies."""

    def __init__(self, bandwidth: float) -> None:
        super().__init__()
        self.h = bandwidth

    def start(self, site, v, n):
        self.weight, self.sums = np.zeros(len(site)), np.zeros(v.shape)

    def visit(self, site, v, n):
        if not self._parts:
            return
        mine = self.held[1]
        step = max(1, (1 << 20) // max(1, len(mine)))
        for a in range(0, len(site), step):
            d = distances(mine, v[a : a + step])
            w = np.where(d <= 3 * self.h, np.exp(-0.5 * (d / self.h) ** 2), 0.0) * n[None, a : a + step]
            self.weight += w.sum(axis=1)
            self.sums += w @ v[a : a + step]

    def result(self):
        seen = self.weight > 0
        to = np.where(seen[:, None], self.sums / np.where(seen, self.weight, 1.0)[:, None], self.held[1])
        moved = np.sqrt(((to - self.held[1]) ** 2).sum(axis=1))
        return {"site": self.held[0], "to": list(to), "moved": moved}

    def nothing(self):
        import pyarrow as pa

        return {"site": pa.array([], pa.int64()), "to": pa.array([], pa.list_(pa.float64())), "moved": pa.array([], pa.float64())}


def scott_bandwidth(df: DataFrame, vector: str) -> float:
    """Scott's rule: the mean deviation of the dimensions times rows ** (-1 / (dimensions + 4)), 0.1 at least."""
    found = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x")).groupBy("k").agg(F.stddev_pop("x").alias("s"), F.count("x").alias("n")).agg(F.avg("s").alias("s"), F.max("n").alias("n"), F.count(F.lit(1)).alias("d")).first()
    return max(0.1, found["s"] * found["n"] ** (-1 / (found["d"] + 4))) if found["n"] else 0.1


#: A seed rests once it moves less than this.
RESTS = 1e-5


def mean_shift(df: DataFrame, key: str, vector: str, bandwidth: float | None = None, max_iter: int = 300, min_bin_freq: int = 1, bin_seeding: bool = False) -> tuple[DataFrame, DataFrame]:
    """(key, cluster of each row; cluster, center, n_seeds): rows go to the nearest mode.

    Every distinct vector is a seed; with bin_seeding, the centre of each cube of a
    bandwidth's side that holds at least min_bin_freq rows. A seed moves to the mean
    of the rows within three bandwidths, weighted by a Gaussian, until it rests;
    seeds that rest drop out. Resting seeds are taken by their key: the first one
    and all within a bandwidth of it are a mode, at the mean of these; then the
    first of those that no mode has taken, with all seeds within a bandwidth of it,
    taken or not, and so on.
    """
    rows = materialize(vector_rows(df, key, vector), "vectors")
    table = materialize(sites(rows), "sites")
    h = bandwidth or scott_bandwidth(rows, "_v")
    seeds = table.select("site", "v", "n")
    if bin_seeding:
        cube = F.transform("v", lambda x: F.round(x / h))
        seeds = table.groupBy(cube.alias("c")).agg(F.min("site").alias("site"), F.sum("n").alias("n")).filter(F.col("n") >= min_bin_freq).select("site", F.transform("c", lambda x: x * h).alias("v"), "n")
    moving, resting = materialize(seeds, "seeds"), None
    for turn in range(max_iter):
        cells = Cells(moving)
        if cells.n <= cells.block:
            few = _move_few(moving, table, h, max_iter - turn)
            moving = few if resting is None else few.unionByName(resting.withColumn("n", F.lit(1).cast("long")))
            resting = None
            break
        housed = cells.housed(moving)
        found = materialize(cells.sweep(housed, table.select("site", "v", "n"), f"{3 * h!r}D", lambda: _Shift(h), "site long, to array<double>, moved double"), "shifted")
        still = found.filter(F.col("moved") < RESTS).select("site", F.col("to").alias("v"))
        before = moving
        resting = materialize(still if resting is None else resting.unionByName(still), "resting")
        moving = materialize(found.filter(F.col("moved") >= RESTS).select("site", F.col("to").alias("v"), F.lit(1).cast("long").alias("n")), "seeds")
        discard(before, found)
    settled = moving.select("site", "v") if resting is None else resting.unionByName(moving.select("site", "v"))
    modes = _modes(materialize(settled, "settled"), h)
    labels = _to_nearest(table, modes)
    return rows.join(labels, F.col("_v") == F.col("v")).select(F.col("_key").alias(key), "cluster"), modes


def _move_few(seeds: DataFrame, table: DataFrame, h: float, most: int) -> DataFrame:
    """At most a block of seeds, moved together until all rest: every step sums the rows around each of them where the rows are."""
    found = seeds.orderBy("site").collect()
    site, at = np.array([r["site"] for r in found], np.int64), np.array([r["v"] for r in found])
    moving = np.arange(len(site))
    for _ in range(most):
        if not len(moving):
            break
        here = at[moving]

        def sums(batches):
            import pyarrow as pa

            weight, total = np.zeros(len(here)), np.zeros(here.shape)
            for b in batches:
                v, n = matrix(b.column(0)), b.column(1).to_numpy()
                step = max(1, (1 << 20) // len(here))
                for a in range(0, len(v), step):
                    d = distances(here, v[a : a + step])
                    w = np.where(d <= 3 * h, np.exp(-0.5 * (d / h) ** 2), 0.0) * n[None, a : a + step]
                    weight += w.sum(axis=1)
                    total += w @ v[a : a + step]
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(weight[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["k", "w", "s"])

        dims = here.shape[1]
        parts = table.select("v", "n").mapInArrow(sums, "k long, w double, s array<double>").groupBy("k").agg(F.sum("w").alias("w"), *[F.sum(F.get("s", F.lit(c))).alias(f"s{c}") for c in range(dims)])
        to = here.copy()
        for r in parts.collect():  # a row for each seed
            to[r["k"]] = [r[f"s{c}"] / r["w"] for c in range(dims)]
        still = np.sqrt(((to - here) ** 2).sum(axis=1)) < RESTS
        at[moving] = to
        moving = moving[~still]
    return table.sparkSession.createDataFrame([(int(s), [float(x) for x in v], 1) for s, v in zip(site, at)], "site long, v array<double>, n long")


#: Seeds that rest closer to each other than this share of a bandwidth are first counted together.
_GRAIN = 1e-3


def _modes(settled: DataFrame, h: float) -> DataFrame:
    """cluster, center, n_seeds of resting seeds."""
    cube = F.transform("v", lambda x: F.floor(x / (h * _GRAIN)))
    heaps = settled.groupBy(cube.alias("c")).agg(F.min("site").alias("site"), F.min(F.struct("site", "v"))["v"].alias("v"), F.count(F.lit(1)).alias("n"))
    dims = settled.select(F.size("v").alias("d")).first()
    if dims is None:
        return settled.sparkSession.createDataFrame([], "cluster long, center array<double>, n_seeds long")
    means = settled.groupBy(cube.alias("c")).agg(*[F.avg(F.get("v", F.lit(k))).alias(f"m{k}") for k in range(dims["d"])])
    heaps = heaps.join(means, "c").select("site", "v", F.array(*[f"m{k}" for k in range(dims["d"])]).alias("mean"), "n")

    def gather(batches):
        import pyarrow as pa

        parts = [(b.column(0).to_numpy(), matrix(b.column(1)), matrix(b.column(2)), b.column(3).to_numpy()) for b in batches if b.num_rows]
        site, v, mean, n = map(np.concatenate, zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0))
        order = np.argsort(site)
        site, v, mean, n = site[order], v[order], mean[order], n[order]
        taken, out = np.zeros(len(site), bool), []
        for k in range(len(site)):
            if not taken[k]:
                near = np.sqrt(((v - v[k]) ** 2).sum(axis=1)) < h
                out.append((len(out), (mean[near] * n[near, None]).sum(axis=0) / n[near].sum(), int(n[near].sum())))
                taken |= near
        cluster, center, count = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int64()), pa.array(list(center), pa.list_(pa.float64())), pa.array(count, pa.int64())], ["cluster", "center", "n_seeds"])

    return materialize(heaps.coalesce(1).mapInArrow(gather, "cluster long, center array<double>, n_seeds long"), "modes")  # a row for each place where seeds rest


class _Closest(Kernel):
    """The visiting centre that is nearest to each held site, the first of equal ones."""

    def start(self, site, v):
        self.best, self.to = np.full(len(site), np.inf), np.full(len(site), np.iinfo(np.int64).max)

    def meet(self, d, site):
        order = np.argsort(site, kind="stable")
        at = order[d[:, order].argmin(axis=1)]
        least = d[np.arange(len(d)), at]
        closer = (least < self.best) | ((least == self.best) & (site[at] < self.to))
        self.best, self.to = np.where(closer, least, self.best), np.where(closer, site[at], self.to)

    def result(self):
        return {"site": self.held[0], "cluster": self.to}

    def nothing(self):
        return {"site": np.zeros(0, np.int64), "cluster": np.zeros(0, np.int64)}


def _to_nearest(table: DataFrame, modes: DataFrame) -> DataFrame:
    """v, cluster of each site: the nearest of the centres, which are held as visitors of every cell they may be nearest in."""
    cells = Cells(table)
    centers = modes.select(F.col("cluster").alias("site"), F.col("center").alias("v"))
    housed = materialize(cells.housed(table.select("site", "v")), "housed")
    own = cells.housed(centers).groupBy("home").agg(F.min("off").alias("off")).collect()  # at most MOST_PIVOTS
    if not own:
        return table.select("v", F.lit(-1).cast("long").alias("cluster")).limit(0)
    between = distances(cells.pivots, cells.pivots)
    reach = np.min([between[:, r["home"]] + r["off"] for r in own], axis=0)
    listed = ", ".join(_number(x) for x in reach)
    found = cells.sweep(housed, centers, f"off + element_at(array({listed}), home + 1)", _Closest, "site long, cluster long")
    return table.join(found, "site").select("v", "cluster")


# --- by the graph of neighbours


def neighbour_graph(df: DataFrame, key: str, vector: str, n_neighbors: int = 10, affinity: str = "nearest_neighbors", gamma: float = 1.0) -> DataFrame:
    """i, j, w in both directions: rows of which one is among the other's nearest, and every row with itself.

    w is 1, or exp(-gamma d^2) for affinity rbf, which is cut to the nearest neighbours here.
    """
    if affinity not in ("nearest_neighbors", "rbf"):
        raise ValueError(f"no affinity {affinity}")
    w = F.exp(-gamma * F.col("d") * F.col("d")) if affinity == "rbf" else F.lit(1.0)
    near = materialize(nearest(df, key, vector, n_neighbors).select("i", "j", w.alias("w")), "near")
    own = vector_rows(df, key, vector).select(F.col("_key").alias("i"), F.col("_key").alias("j"), F.lit(1.0).alias("w"))
    both = near.unionByName(near.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).unionByName(own)
    return both.groupBy("i", "j").agg(F.max("w").alias("w"))


#: Vectors that are carried along; what they take up does not slow the wanted ones down.
SPARE = 6


def leading_vectors(graph: DataFrame, k: int, most_rounds: int = 100, tolerance: float = 1e-6, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(i, x: array of k numbers; eigenvalues) of the k leading vectors of D^-1/2 W D^-1/2 of a symmetric graph (i, j, w).

    Orthogonal iteration: every round multiplies SPARE vectors more than k by
    (I + W') / 2 twice, as joins along the edges, and makes them orthonormal again by
    their products with each other. It ends when the k eigenvalues settle.
    """
    wanted, k = k, k + SPARE
    degree = graph.groupBy("i").agg(F.sum("w").alias("deg"))
    edges = graph.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("deg").alias("deg_j")), "j")
    edges = materialize(edges.select("i", "j", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg_j"))).alias("w")), "edges")
    names = [f"x{c}" for c in range(k)]
    start = [(F.xxhash64("i", F.lit(c), F.lit(seed)) / float(1 << 63)).alias(n) for c, n in enumerate(names)]
    x = materialize(degree.select("i", *start), "vectors")

    def times(x: DataFrame) -> DataFrame:
        moved = edges.join(x.withColumnRenamed("i", "j"), "j").groupBy("i").agg(*[F.sum(F.col("w") * F.col(n)).alias(f"_{n}") for n in names])
        return x.join(moved, "i").select("i", *[((F.col(n) + F.col(f"_{n}")) / 2).alias(n) for n in names])

    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def upright(x: DataFrame) -> tuple[DataFrame, np.ndarray]:
        row = x.agg(*[F.sum(F.col(names[a]) * F.col(names[b])).alias(f"p{a}_{b}") for a, b in pairs]).first()
        gram = np.array([[row[f"p{min(a, b)}_{max(a, b)}"] or 0.0 for b in range(k)] for a in range(k)])
        values, turn = np.linalg.eigh(gram)
        turn = (turn / np.sqrt(np.maximum(values, 1e-12 * values[-1])))[:, ::-1]  # fewer rows than vectors leave some at nothing
        mixed = [sum((F.col(names[a]) * float(turn[a, c]) for a in range(1, k)), F.col(names[0]) * float(turn[0, c])) for c in range(k)]
        return x.select("i", *[m.alias(n) for m, n in zip(mixed, names)]), values[::-1]

    x, _ = upright(x)
    before = None
    for _ in range(most_rounds):
        y = materialize(times(times(x)), "vectors")
        x, squares = upright(y)
        values = 2 * np.maximum(squares[:wanted], 0) ** 0.25 - 1  # squares are those of ((1 + value) / 2) ** 2
        if before is not None and np.abs(values - before).max() < tolerance:
            break
        before = values
    return x.select("i", F.array(*names[:wanted]).alias("x")), values


def spectral(df: DataFrame, key: str, vector: str, n_clusters: int = 2, affinity: str = "nearest_neighbors", n_neighbors: int = 10, gamma: float = 1.0, most_rounds: int = 100, seed: int = 0) -> DataFrame:
    """key, cluster of each row: means of the directions that the leading vectors of the neighbour graph give the rows.

    Clusters are numbered from 0 by their smallest key.
    """
    found, _ = leading_vectors(neighbour_graph(df, key, vector, n_neighbors, affinity, gamma), n_clusters, most_rounds, seed=seed)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    names = [f"u{c}" for c in range(n_clusters)]
    ways = materialize(found.select("i", *[(F.get("x", F.lit(c)) / F.when(norm < 1e-10, 1.0).otherwise(norm)).alias(n) for c, n in enumerate(names)]), "directions")
    named = materialize(assign_nearest(ways, names, kmeans(ways, "i", names, n_clusters, seed=seed), "c").select("i", "c"), "named")
    first = named.groupBy("c").agg(F.min("i").alias("first"))
    numbers = first.select("c", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))  # n_clusters rows
    return named.join(F.broadcast(numbers), "c").select(F.col("i").alias(key), "cluster")
