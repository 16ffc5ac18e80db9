"""Queries over small tables of their own, where a row that is left out shows."""

from marlstone.queries import QUERIES


def test_rating_distribution_counts_all_lines_and_fills_empty_bins(spark, tmp_path):
    quantities = [1.0, 10.0, 10.5, 25.0, 25.0, 41.0, 50.0]
    spark.createDataFrame([(i, q) for i, q in enumerate(quantities)], "l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["rating"]: r["n"] for r in QUERIES["rating_distribution"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 1, 3: 2, 4: 0, 5: 2}


def test_rate_limit_counters_all_end_and_are_those_of_a_plain_loop(spark, sf_dir):
    got = sorted((r["user_id"], int(r["started"].timestamp() * 1_000_000), r["hits"], r["rejected"]) for r in QUERIES["stream_rate_limit"](spark, sf_dir).collect())
    want, times = [], {}
    for user, us in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id as string)", "unix_micros(cast(ts as timestamp))").collect():
        times.setdefault(user, []).append(us)
    for user, hits in times.items():
        opened: list[list[int]] = []
        for us in sorted(hits):
            if not opened or us >= opened[-1][0] + 3600 * 1_000_000:
                opened.append([us, 0])
            opened[-1][1] += 1
        want += [(user, us, n, max(0, n - 2)) for us, n in opened]
    assert got == sorted(want)
