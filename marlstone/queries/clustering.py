"""Clusterings of suppliers and customers as points in the plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering as C
from ..operators import neighbors as N
from .registry import query, table


def points(spark, sf_dir):
    v = F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v"))


def _customers(spark, sf_dir):
    v = F.array(F.round(F.col("c_acctbal") / 1000, 1), (F.col("c_nationkey") % 5).cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))


_POINTS = "p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS a, s_nationkey::DOUBLE AS b FROM supplier), d AS (SELECT x.k AS i, y.k AS j, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d FROM p x, p y)"
#: Clusters from edges (u, v) among the rows of p, numbered by their smallest key.
_REACH = "reach AS (SELECT k AS i, k AS r FROM p UNION SELECT e.v, reach.r FROM reach JOIN (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) e ON e.u = reach.i), lead AS (SELECT i, min(r) AS leader FROM reach GROUP BY i)"


@query(f"""WITH RECURSIVE {_POINTS}, core AS (SELECT i FROM d WHERE d <= 0.6 GROUP BY i HAVING count(*) >= 3),
edges AS (SELECT i AS u, j AS v FROM d WHERE d <= 0.6 AND i IN (FROM core) AND j IN (FROM core)), {_REACH},
named AS (SELECT d.i, min(leader) FILTER (d.i = d.j) AS own, min(leader) AS near FROM d JOIN lead ON lead.i = d.j AND d.j IN (FROM core) WHERE d <= 0.6 GROUP BY 1),
chosen AS (SELECT k, coalesce(own, near) AS leader FROM p LEFT JOIN named ON i = k), numbers AS (SELECT leader, row_number() OVER (ORDER BY leader) - 1 AS cluster FROM chosen WHERE leader IS NOT NULL GROUP BY 1)
SELECT k AS s_suppkey, coalesce(cluster, -1) AS cluster, k IN (FROM core) AS is_core FROM chosen LEFT JOIN numbers USING (leader)""")
def dbscan_clusters(spark, sf_dir):
    return C.dbscan(points(spark, sf_dir), "s_suppkey", "v", 0.6, 3)


@query(f"""WITH RECURSIVE {_POINTS},
prim AS (SELECT [min(k)] AS seen, NULL::BIGINT AS low, NULL::BIGINT AS high, NULL::DOUBLE AS d FROM p
  UNION ALL SELECT list_append(seen, way.j), way.low, way.high, way.d FROM (
    SELECT seen, arg_min({{'j': j, 'low': least(i, j), 'high': greatest(i, j), 'd': d.d}}, (d.d, least(i, j), greatest(i, j))) AS way FROM prim JOIN d ON list_contains(seen, i) AND NOT list_contains(seen, j) GROUP BY seen))
SELECT low, high, round(d, 6) AS d FROM prim WHERE low IS NOT NULL""")
def minimum_spanning_tree(spark, sf_dir):
    return C.spanning_tree(points(spark, sf_dir), "s_suppkey", "v").withColumn("d", F.round("d", 6))


@query(f"""WITH RECURSIVE {_POINTS},
prim AS (SELECT [min(k)] AS seen, NULL::BIGINT AS low, NULL::BIGINT AS high, NULL::DOUBLE AS d FROM p
  UNION ALL SELECT list_append(seen, way.j), way.low, way.high, way.d FROM (
    SELECT seen, arg_min({{'j': j, 'low': least(i, j), 'high': greatest(i, j), 'd': d.d}}, (d.d, least(i, j), greatest(i, j))) AS way FROM prim JOIN d ON list_contains(seen, i) AND NOT list_contains(seen, j) GROUP BY seen)),
edges AS (SELECT low AS u, high AS v FROM prim WHERE low IS NOT NULL QUALIFY row_number() OVER (ORDER BY d, low, high) <= (SELECT count(*) - 4 FROM p)), {_REACH}
SELECT i AS s_suppkey, dense_rank() OVER (ORDER BY leader) - 1 AS cluster FROM lead""")
def agglomerative_single(spark, sf_dir):
    return C.agglomerative(points(spark, sf_dir), "s_suppkey", "v", 4, "single")


@query(f"""WITH RECURSIVE {_POINTS},
merging AS (SELECT list({{'id': k, 'x': a, 'y': b, 'n': 1::DOUBLE}}) AS cl, NULL::BIGINT AS u, NULL::BIGINT AS v FROM p
  UNION ALL SELECT list_concat(list_filter(cl, lambda c: c.id != m.p.id AND c.id != m.q.id),
      [{{'id': m.p.id, 'x': m.p.x + (m.q.x - m.p.x) * m.q.n / (m.p.n + m.q.n), 'y': m.p.y + (m.q.y - m.p.y) * m.q.n / (m.p.n + m.q.n), 'n': m.p.n + m.q.n}}]), m.p.id, m.q.id
  FROM (SELECT cl, arg_min({{'p': p, 'q': q}}, (2 * p.n * q.n / (p.n + q.n) * (pow(p.x - q.x, 2) + pow(p.y - q.y, 2)), p.id, q.id)) AS m
    FROM (SELECT cl, unnest(cl) AS p FROM merging WHERE len(cl) > 4) x, LATERAL (SELECT unnest(x.cl) AS q) y WHERE p.id < q.id GROUP BY cl)),
edges AS (SELECT u, v FROM merging WHERE u IS NOT NULL), {_REACH}
SELECT i AS s_suppkey, dense_rank() OVER (ORDER BY leader) - 1 AS cluster FROM lead""")
def agglomerative_ward(spark, sf_dir):
    return C.agglomerative(points(spark, sf_dir), "s_suppkey", "v", 4, "ward")


@query(f"""WITH {_POINTS} SELECT i, j, round(d, 6) AS d, k FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d WHERE i != j) WHERE k <= 5""")
def nearest_neighbours(spark, sf_dir):
    return N.nearest(points(spark, sf_dir), "s_suppkey", "v", 5).withColumn("d", F.round("d", 6))


@query()
def mean_shift_clusters(spark, sf_dir):
    return C.mean_shift(_customers(spark, sf_dir), "c_custkey", "v", 1.2, bin_seeding=True)[0]


@query()
def spectral_clusters(spark, sf_dir):
    return C.spectral(points(spark, sf_dir), "s_suppkey", "v", 3, n_neighbors=8, most_rounds=12)
