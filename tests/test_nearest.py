import numpy as np
from pyspark.sql import functions as F

from strandline.operators import nearest


def brute(rows, asked, k, own=False):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in good if i in asked}:
        best = {}
        for j, y in good:
            for x in (x for n, x in good if n == i and len(x) == len(y)):
                if own or j != i:
                    total = 0.0
                    for a, b in zip(y, x):
                        total += (a - b) * (a - b)
                    best[j] = min(best.get(j, np.inf), total)
        out += [(i, r + 1, j, d) for r, (d, j) in enumerate(sorted((d, j) for j, d in best.items())[:k])]
    return sorted(out)


def test_clusters_odd_rows_and_a_common_vector(spark):
    """Rows of brute force to the bit; of clustered vectors a small share is compared."""
    r = np.random.default_rng(3)
    centre = r.normal(0, 10, (25, 8))
    x = centre[r.integers(0, 25, 1500)] + r.normal(0, 1, (1500, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, x[5].tolist()), (7001, x[0].tolist()), (7002, None), (7003, [1.0, 2.0]), (7004, [1.0, 2.5]), (7005, [float("nan")] * 8), (7006, [None, 1.0]), (7007, []), (None, x[3].tolist())]
    rows += [(8000 + i, x[7].tolist()) for i in range(700)]  # one vector of many rows
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asked = set(range(0, 1500, 60)) | {7003, 7005, 8001}
    queries = table.where(F.col("vec_id").isin(*asked)).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    found = nearest.nearest_each(table, queries, 3, block=128)
    assert sorted(map(tuple, found.rows.collect())) == brute(rows, asked, 3)
    assert found.visited.agg(F.sum("visited")).first()[0] < 0.3 * queries.count() * len(rows)


def test_copies_are_compared_once(spark):
    """Each of 4,000 copies asks, among them and with few vectors: none is compared with all copies."""
    table = spark.range(4000).select(F.col("id").alias("vec_id"), F.array(F.floor(F.col("id") / 2000).cast("double"), F.lit(1.0)).alias("vector"))
    table = table.unionByName(spark.createDataFrame([(5000, [0.0, 3.0]), (5001, [9.0, 9.0])], table.schema))
    queries = table.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    found = nearest.nearest_each(table, queries, 2)
    assert found.visited.agg(F.max("visited")).first()[0] <= 4
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in found.rows.collect()}
    assert len(got) == 2 * 4002 and got[0, 1] == (1, 0.0) and got[1999, 2] == (1, 0.0) and got[2000, 1] == (2001, 0.0)
    assert got[5000, 1] == (0, 4.0) and got[5000, 2] == (1, 4.0) and got[5001, 1] == (5000, 117.0)


def test_products_decide_only_what_their_rounding_allows():
    """Far from the origin squared lengths swallow small distances; the nearest and their order stay those of the plain definition."""
    r = np.random.default_rng(5)
    rows = 1e8 + r.normal(0, 1, (300, 6))
    own = rows[:20] + r.normal(0, 1e-3, (20, 6))
    q, at, total = nearest._best(own, rows, np.full(20, np.inf), 4)
    plain = ((rows[None] - own[:, None]) ** 2).sum(2)
    assert at.reshape(20, 4).tolist() == np.argsort(plain, 1, kind="stable")[:, :4].tolist()
    assert np.allclose(total.reshape(20, 4), np.sort(plain, 1)[:, :4])
