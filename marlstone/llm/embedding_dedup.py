"""Embedding near-deduplication: random-hyperplane signs, exact cosines, connected components.

Vectors meet when the signs of their products with a table's hyperplanes agree in
at least one of several tables. Within a bucket cosines are computed exactly, in
double precision and in blocks; a pair is counted in the first table in which it
meets, so the number of links needs no list of pairs. A bucket gives each vector
its number of new links and one edge to a linked vector of the bucket's spanning
forest, so its output grows with its vectors, not with their pairs. Buckets
above ROWS_OF_BLOCK are cut into chunks and every pair of chunks is a group of its own.

Equal vectors of one label are one representative with a multiplicity.

Hyperplanes per table follow the number of vectors, so that buckets keep their
size; tables follow from them, so that a pair at the threshold meets with
probability RECALL.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and vectors without a label, are returned without links; vectors of
different lengths never link; rows that repeat an identifier are separate
vectors with one identifier, and link to each other as others do; rows without an
identifier link as others do but never name a component, unless all of its rows
lack one (then it is null, and all are kept); an empty table gives an empty
result; extra columns are ignored. Components of any finite size are compared.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_groups import groups
from .components import connected_components
from .ship import ship
from .storage import materialize

THRESHOLD = 0.93
#: Chance that a pair at the threshold meets in some table.
RECALL = 0.995
#: Vectors for each sign pattern of a table, and rows of a chunk of a large bucket.
ROWS_OF_BUCKET, ROWS_OF_BLOCK = 256, 256


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(hyperplanes per table, tables) for n vectors."""
    bits = max(4, math.ceil(math.log2(max(n, 1) / ROWS_OF_BUCKET)))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def hyperplanes(dim: int, bits: int, tables: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def signatures(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Signs of each vector (of length 1) in each table, packed into an integer."""
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables) >= 0).reshape(len(vectors), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _usable() -> Column:
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(good, F.lit(False))


def _bucketed(reps: DataFrame, bits: int, tables: int) -> DataFrame:
    """A row for each representative and table: label, dim, band, sig, rep, embedding, copies."""
    kind = reps.schema["embedding"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            dims = np.array(b.column(2).value_lengths())
            flat = np.array(b.column(2).flatten(), np.float64)
            starts = np.concatenate([[0], np.cumsum(dims)[:-1]])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                sigs = signatures(unit_rows(flat[starts[rows][:, None] + np.arange(dim)]), bits, tables)
                for first in range(0, len(rows), 1000):
                    some = rows[first : first + 1000]
                    out, n = b.take(pa.array(np.repeat(some, tables))), len(some)
                    extra = [pa.array(np.full(n * tables, dim, np.int32)), pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(sigs[first : first + 1000].ravel())]
                    yield pa.RecordBatch.from_arrays([*out.columns, *extra], ["rep", "label", "embedding", "copies", "dim", "band", "sig"])

    return reps.select("rep", "label", "embedding", "copies").mapInArrow(run, f"rep long, label long, embedding {kind}, copies long, dim int, band int, sig long")


def _groups(bucketed: DataFrame) -> DataFrame:
    """Rows of the buckets with two vectors or more, by group: a pair of chunks of a bucket."""
    key = ["label", "dim", "band", "sig"]
    sizes = bucketed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = bucketed.join(sizes, key).withColumn("chunks", F.ceil(F.col("n") / ROWS_OF_BLOCK).cast("int"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return rows.select(*key, "rep", "embedding", "copies", "chunk", other.alias("other")).select(*key, F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "rep", "embedding", "copies")


def link_block(vectors: np.ndarray, chunk: np.ndarray, band: int, bits: int, tables: int, threshold: float) -> np.ndarray:
    """Boolean matrix of the links that this group counts: at or above the threshold, first met in this table, within the group's pair of chunks."""
    unit = unit_rows(vectors)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if linked.any() and band:
        sigs = signatures(unit, bits, tables)[:, :band]
        a, b = np.nonzero(np.triu(linked))
        met = (sigs[a] == sigs[b]).any(axis=1)
        linked[a[met], b[met]] = linked[b[met], a[met]] = False
    if len(np.unique(chunk)) > 1:
        linked &= chunk[:, None] != chunk[None, :]
    return linked


def spanning_roots(linked: np.ndarray) -> np.ndarray:
    """For each row the smallest row of its component."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links(grouped: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """rep, other (a linked representative of its component in the group), links (new linked vectors, copies included)."""
    order = ["label", "dim", "band", "sig", "low", "high"]

    def compare(batches):
        import pyarrow as pa

        for g in groups(batches, len(order)):
            band, low, high = (g.column(k)[0].as_py() for k in (2, 4, 5))
            chunk, rep, copies = (np.asarray(g.column(k)) for k in (6, 7, 9))
            if low != high and len(np.unique(chunk)) == 1:
                continue  # the pair's other chunk is empty
            vectors = np.asarray(g.column(8).flatten(), np.float64).reshape(g.num_rows, -1)
            linked = link_block(vectors, chunk, band, bits, tables, threshold)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                columns = [rep[some], rep[spanning_roots(linked)[some]], (linked[some] @ copies).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["rep", "other", "links"])

    return grouped.repartition(*order).sortWithinPartitions(*order).mapInArrow(compare, "rep long, other long, links long")


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("long").alias("label"))
    rows = rows.withColumn("print", F.when(_usable(), F.sha2(F.array_join("embedding", ","), 256)))
    equal = rows.filter("print is not null").groupBy("label", "print").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    reps = materialize(equal.withColumn("rep", F.monotonically_increasing_id()), "representatives")
    bits, tables = plan_tables(reps.count(), threshold, recall)
    links = materialize(_links(_groups(_bucketed(reps, bits, tables)), bits, tables, threshold), "links")
    found = connected_components(links.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    by_rep = reps.select("rep", "label", "print", "least_id", "copies").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    by_rep = by_rep.select("label", "print", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    least = by_rep.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_rep = by_rep.join(least, "component").select("label", "print", "n_links", "component_id")
    out = rows.select("vec_id", "label", "print").join(by_rep, ["label", "print"], "left")
    component = F.when(F.col("print").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
