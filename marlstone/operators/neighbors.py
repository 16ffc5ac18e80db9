"""Neighbours within a distance and nearest neighbours, without comparing all pairs.

Rows with equal vectors are one site with a weight. Some sites are pivots; every
site lives in the cell of its nearest pivot. By the triangle inequality a cell only
has to meet sites whose distance to its pivot is at most that of its own sites plus
what they look for, so a sweep copies sites to these cells and compares there, in
blocks: the sites that live in a part of a cell are held, those that visit stream
past. A cell with many sites is cut into parts, so no task holds more than a few
thousand. Where distances separate nothing (many dimensions), this is a comparison
in blocks of all sites.

Keys are integers; rows with a null key or vector, or with a null or NaN in the
vector, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize
from ..sources.ship import send_package

#: Sites of a part of a cell, most pivots (they are brought to the driver), numbers compared at a time.
BLOCK, MOST_PIVOTS, AT_ONCE = 4096, 1024, 1 << 20


def distances(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Of each row of a to each row of b, dimension by dimension."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        out += diff * diff if metric == "euclidean" else np.abs(diff)
    return np.sqrt(out) if metric == "euclidean" else out


def vector_rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """_key, _v: the rows that take part. -0.0 counts as 0.0."""
    kind = dict(df.dtypes)[key]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"keys are integers, {key} is {kind}")
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    return df.select(F.col(key).cast("long").alias("_key"), v.alias("_v")).filter(F.col("_key").isNotNull() & F.col("_v").isNotNull() & ~F.exists("_v", lambda x: x.isNull() | F.isnan(x)))


def sites(rows: DataFrame) -> DataFrame:
    """site (smallest key), v, n (rows) of each distinct vector of vector_rows()."""
    return rows.groupBy("_v").agg(F.min("_key").alias("site"), F.count(F.lit(1)).alias("n")).select("site", F.col("_v").alias("v"), "n")


def matrix(column) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1))


class Cells:
    """Pivots of a table of sites: site, v, and further columns."""

    def __init__(self, table: DataFrame, metric: str = "euclidean", block: int | None = None) -> None:
        if metric not in ("euclidean", "manhattan"):
            raise ValueError(f"no metric {metric}")
        block = block or BLOCK
        self.metric, self.block = metric, block
        self.n = table.count()
        most = max(1, min(MOST_PIVOTS, -(-self.n // block)))
        found = table.select("site", "v").orderBy(F.xxhash64("site", F.lit(11)), "site").limit(most).collect()  # at most MOST_PIVOTS
        self.sites = np.array([r["site"] for r in found], np.int64)
        self.pivots = np.array([r["v"] for r in found]) if found else np.zeros((1, 1))
        send_package(table.sparkSession)

    def housed(self, table: DataFrame) -> DataFrame:
        """table with home (cell) and off (distance to its pivot)."""
        pivots, metric, at = self.pivots, self.metric, table.columns.index("v")

        def run(batches):
            import pyarrow as pa

            for b in _pieces(batches):
                d = distances(matrix(b.column(at)), pivots, metric)
                home = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home, pa.int32()), pa.array(d[np.arange(len(d)), home])], [*b.schema.names, "home", "off"])

        return table.mapInArrow(run, f"{_ddl(table)}, home int, off double")

    def extents(self, housed: DataFrame, look: str = "0D") -> tuple[np.ndarray, np.ndarray]:
        """(how far from its pivot a cell looks, sites) of each cell; look: SQL for how far a site looks."""
        far, count = np.full(len(self.pivots), -1.0), np.zeros(len(self.pivots), np.int64)
        for r in housed.groupBy("home").agg(F.max(F.col("off") + F.expr(look)).alias("far"), F.count(F.lit(1)).alias("n")).collect():  # at most MOST_PIVOTS
            far[r["home"]], count[r["home"]] = r["far"], r["n"]
        return far, count

    def sweep(self, left: DataFrame, right: DataFrame, look: str, kernel: Callable[[], Kernel], schema: str) -> DataFrame:
        """What kernels make of left sites (housed) and the right ones (site, v, ...) that they look at.

        Left and right have the same columns site, v and then n_extra others each, which
        kernels get as arrays; left also has home and off.
        """
        far, count = self.extents(left, look)
        far = far * (1 + 1e-9) + 1e-9  # sums of rounded distances
        parts = np.maximum(1, -(-count // self.block))
        pivots, metric = self.pivots, self.metric
        columns = [c for c in left.columns if c not in ("home", "off")]
        if columns != right.columns:
            raise ValueError(f"{columns} meet {right.columns}")
        held = left.select(F.col("home").alias("_cell"), F.expr(_per_cell(parts)).alias("_parts"), *columns)
        held = held.select("_cell", F.pmod(F.xxhash64("site"), F.col("_parts")).cast("int").alias("_part"), F.lit(0).alias("_side"), *columns)
        at = columns.index("v")

        def visit(batches):
            import pyarrow as pa

            for b in _pieces(batches):
                near = ~(distances(matrix(b.column(at)), pivots, metric) > far[None, :])  # what is no number is near to all
                row, cell = np.nonzero(near)
                times = parts[cell]
                part = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                whole = pa.RecordBatch.from_arrays(b.columns, b.schema.names)
                for first in range(0, len(row), 8192):
                    some = slice(first, first + 8192)
                    copied = whole.take(pa.array(row[some]))
                    n = copied.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array(cell[some], pa.int32()), pa.array(part[some], pa.int32()), pa.array(np.ones(n), pa.int32()), *copied.columns], ["_cell", "_part", "_side", *columns])

        guests = right.mapInArrow(visit, f"_cell int, _part int, _side int, {_ddl(right)}")
        dealt = held.unionByName(guests).repartition("_cell", "_part").sortWithinPartitions("_cell", "_part", "_side")

        def run(batches):
            worker, last = None, None
            for b in _pieces(batches):
                keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
                cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
                for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                    place = (keys[0, a], keys[1, a])
                    if place != last:
                        if worker:
                            yield worker.close()
                        worker, last = kernel(), place
                        worker.metric = metric
                    some = b.slice(a, z - a)
                    arrays = [matrix(some.column(3 + k)) if k == at else some.column(3 + k).to_numpy(zero_copy_only=False) for k in range(len(columns))]
                    (worker.visit if keys[2, a] else worker.hold)(*arrays)
            if worker:
                yield worker.close()

        return dealt.mapInArrow(run, schema)


def _per_cell(values: np.ndarray) -> str:
    return f"element_at(array({', '.join(map(str, values.tolist()))}), _cell + 1)".replace("_cell", "home")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _pieces(batches: Iterable, rows: int = 1024) -> Iterator:
    for b in batches:
        for first in range(0, b.num_rows, rows):
            yield b.slice(first, rows)


class Kernel:
    """Gets the sites that a part of a cell holds, then the visiting ones in blocks."""

    metric = "euclidean"

    def __init__(self) -> None:
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._held: tuple[np.ndarray, ...] | None = None

    def hold(self, *arrays: np.ndarray) -> None:
        self._parts.append(arrays)

    @property
    def held(self) -> tuple[np.ndarray, ...]:
        if self._held is None:
            self._held = tuple(map(np.concatenate, zip(*self._parts)))
            self.start(*self._held)
        return self._held

    def visit(self, site: np.ndarray, v: np.ndarray, *extra: np.ndarray) -> None:
        if not self._parts:
            return
        mine = self.held[1]
        step = max(1, AT_ONCE // max(1, len(mine)))
        for a in range(0, len(site), step):
            some = slice(a, a + step)
            self.meet(distances(mine, v[some], self.metric), site[some], *[x[some] for x in extra])

    def close(self):
        import pyarrow as pa

        if self._parts:
            self.held  # noqa: B018  kernels that nothing visits start here
        return pa.RecordBatch.from_pydict(self.result() if self._parts else self.nothing())

    def start(self, site: np.ndarray, v: np.ndarray, *extra: np.ndarray) -> None:
        """Called once with all held sites."""

    def meet(self, d: np.ndarray, site: np.ndarray, *extra: np.ndarray) -> None:
        """d: distances of held sites (rows) to visiting ones."""
        raise NotImplementedError

    def result(self) -> dict:
        raise NotImplementedError

    def nothing(self) -> dict:
        return {}


class _Nearest(Kernel):
    """The first k of the visiting keys by distance, then key."""

    def __init__(self, k: int) -> None:
        super().__init__()
        self.k = k

    def start(self, site, v, *extra):
        self.d = np.full((len(site), self.k), np.inf)
        self.key = np.full((len(site), self.k), np.iinfo(np.int64).max)

    def meet(self, d, site, *extra):
        all_d = np.concatenate([self.d, d], axis=1)
        all_key = np.concatenate([self.key, np.broadcast_to(site, d.shape)], axis=1)
        if all_d.shape[1] > 4 * self.k:  # drop what is beyond the k-th distance, ties kept
            cut = np.partition(all_d, self.k - 1, axis=1)[:, self.k - 1]
            width = max(self.k, int((all_d <= cut[:, None]).sum(axis=1).max()))
            some = np.argsort(np.where(all_d <= cut[:, None], all_d, np.inf), axis=1, kind="stable")[:, :width]
            all_d, all_key = np.take_along_axis(all_d, some, 1), np.take_along_axis(all_key, some, 1)
        order = np.lexsort((all_key, all_d), axis=1)[:, : self.k]
        self.d, self.key = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_key, order, 1)

    def result(self):
        there = [np.isfinite(row) for row in self.d]
        return {"site": self.held[0], "keys": [k[t] for k, t in zip(self.key, there)], "ds": [d[t] for d, t in zip(self.d, there)]}

    def nothing(self):
        import pyarrow as pa

        return {"site": pa.array([], pa.int64()), "keys": pa.array([], pa.list_(pa.int64())), "ds": pa.array([], pa.list_(pa.float64()))}


def nearest(df: DataFrame, key: str, vector: str, k: int, metric: str = "euclidean") -> DataFrame:
    """i, j, d, k: the k nearest other rows of each row, ties by key; fewer where there are no more rows."""
    if k < 1:
        raise ValueError("k is at least 1")
    rows = materialize(vector_rows(df, key, vector), "vectors")
    table = materialize(sites(rows), "sites")
    # of equal vectors, the first k + 1 keys can be neighbours of anything
    order = Window.partitionBy("_v").orderBy("_key")
    candidates = materialize(rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).select(F.col("_key").alias("site"), F.col("_v").alias("v")), "candidates")
    cells = Cells(table, metric)
    housed = materialize(cells.housed(table.select("site", "v")), "housed")
    look = _bounds(cells, housed, cells.housed(candidates), k)
    found = cells.sweep(housed, candidates, look, lambda: _Nearest(k + 1), "site long, keys array<long>, ds array<double>")
    listed = table.join(found, "site").select("v", F.arrays_zip("keys", "ds").alias("near"))
    own = rows.join(listed, F.col("_v") == F.col("v")).select(F.col("_key").alias("i"), F.slice(F.filter("near", lambda x: x["keys"] != F.col("_key")), 1, k).alias("near"))
    return own.select("i", F.posexplode("near").alias("k", "near")).select("i", F.col("near.keys").alias("j"), F.col("near.ds").alias("d"), (F.col("k") + 1).alias("k"))


def _bounds(cells: Cells, housed: DataFrame, candidates: DataFrame, k: int) -> str:
    """SQL for how far a site may have to look: over pivots, the k + 1 candidates that are nearest to them."""
    if len(cells.pivots) == 1:
        return "double('infinity')"
    order = Window.partitionBy("home").orderBy("off")
    first = candidates.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).select("home", "off").collect()  # at most (k + 1) * MOST_PIVOTS
    between = distances(cells.pivots, cells.pivots, cells.metric)
    home, off = np.array([r["home"] for r in first], np.int64), np.array([r["off"] for r in first])
    reach = np.sort(between[:, home] + off[None, :], axis=1)
    at_pivot = reach[:, k] if reach.shape[1] > k else np.full(len(reach), np.inf)
    listed = ", ".join("double('infinity')" if np.isinf(x) else f"{float(x)!r}D" for x in at_pivot)
    return f"off + element_at(array({listed}), home + 1)"
