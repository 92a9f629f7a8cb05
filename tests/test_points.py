"""Samples of points are the same however the table is divided."""

import hashlib

from statloom.operators import regression as R


def test_points_are_the_smallest_hashes(spark):
    rows = [(i, float(i % 7), None if i % 11 == 0 else float(3 * (i % 7) + i % 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    want = [(x, y) for i, x, y in sorted((r for r in rows if r[2] is not None), key=lambda r: hashlib.md5(f"5:{r[0]}".encode()).hexdigest())[:50]]
    for parts in (1, 3, 16):
        assert [tuple(r) for r in R.points(df.repartition(parts), ["x", "y"], ["id"], 50, 5).collect()] == want
    assert R.points(df, ["x", "y"], ["id"], 1000).count() == sum(r[2] is not None for r in rows)
    got = R.residual_points(df, "y", ["x"], ["id"], 1000).collect()
    assert abs(sum(r["residual"] for r in got)) < 1e-8 and abs(sum(r["residual"] * r["fitted"] for r in got)) < 1e-6
    assert R.points(df.limit(0), ["x"], ["id"]).count() == 0
