import numpy as np

from strandline.llm import queries, whitening


def brute(rows, k=8):
    """By the covariance and a full eigendecomposition."""
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows], np.int64)
    n = len(x)
    off = n * x - x.sum(0)
    c = off / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, (off**2).sum(1), c @ u / np.sqrt(e), e / np.trace(v)


def holds(got, rows, k=8):
    n, deviation, whitened, explained = brute(rows, k)
    assert len(got) == n * k and {r.component for r in got} == set(range(1, k + 1))
    at = {key: i for i, (key, _) in enumerate(rows)}
    w = np.zeros((n, k))
    for r in got:
        i = at[r.vec_id]
        w[i, r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[i] and abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    for c in range(k):
        assert min(abs(w[:, c] - whitened[:, c]).max(), abs(w[:, c] + whitened[:, c]).max()) < 1e-9


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    rows = [(k, [float(c) for c in v]) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    holds(queries.op11_whitening(spark, d).collect(), rows)


def test_lanczos_against_a_full_decomposition():
    a = np.random.default_rng(1).standard_normal((400, 400))
    a = a @ a.T
    want = np.linalg.eigh(a)[0][::-1][:8]
    took = []
    for how in (whitening.Search(), whitening.Search(most=50), whitening.Search(block=1), whitening.Search(block=3, most=30)):
        e, v, passes = whitening.leading(lambda q: a @ q, 400, 8, how)
        assert abs(e / want - 1).max() < 1e-12 and abs(a @ v - v * e).max() < 1e-9 * want[0] and abs(v.T @ v - np.eye(8)).max() < 1e-10
        took.append(passes * how.block)
    assert took[0] < 2000 and whitening.leading(lambda q: a[:64, :64] @ q, 64, 8)[2] == 6  # then the basis is the whole space


def test_breakdowns():
    """A start inside an invariant space, equal eigenvalues, no variance at all."""
    b = np.zeros((60, 60))
    b[:4, :4] = np.diag([5.0, 3, 3, 1])
    e, v, _ = whitening.leading(lambda q: b @ q, 60, 8)
    assert abs(e - [5, 3, 3, 1, 0, 0, 0, 0]).max() < 1e-12 and abs(v.T @ v - np.eye(8)).max() < 1e-12
    assert abs(whitening.leading(lambda q: 0 * q, 20, 3)[0]).max() == 0
    assert abs(whitening.leading(lambda q: 2 * q, 5, 8)[0] - 2).max() < 1e-12
    start = whitening.fresh(np.eye(6)[:, :2], np.eye(6)[:, [0, 0, 3]], np.random.default_rng(0), 3)
    assert abs(start[:2]).max() < 1e-12 and abs(start.T @ start - np.eye(3)).max() < 1e-12


def test_odd_rows(spark):
    r = np.random.default_rng(4)
    good = [(i, r.normal(0, 3, 5).tolist()) for i in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [float("nan")] * 5), (104, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (105, [1.0, 2.0])]
    frame = spark.createDataFrame([(k, v, "x", "y") for k, v in good + odd], "vec_id long, embedding array<double>, Component string, x string")
    holds(whitening.whiten(frame, k=4).collect(), good, 4)
    twice = spark.createDataFrame([(None, good[0][1]), (1, good[0][1]), (1, good[0][1]), (2, good[1][1])], "vec_id long, embedding array<double>")
    rows = whitening.whiten(twice).collect()
    assert len(rows) == 4 and sorted(round(x.whitened, 6) for x in rows)[-1] in (0.57735, 1.732051) and {x.component for x in rows} == {1}
    empty = frame.where("vec_id > 99")
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(frame.where("vec_id = 3")).count() == 0


def test_deviations_beyond_a_long(spark):
    frame = spark.createDataFrame([(i, [float(10**9 * (i % 3)), float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    rows = whitening.whiten(frame).collect()
    n, x = 6, [[int(1024 * c) + 100_000 for c in (10**9 * (i % 3), i)] for i in range(6)]
    sums = [sum(c) for c in zip(*x)]
    for r in rows:
        assert int(r.deviation) == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums))
