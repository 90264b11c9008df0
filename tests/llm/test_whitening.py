import math

import numpy as np
import pytest

from reactrix.llm import passes
from reactrix.llm import whitening as W

VEC = "vec_id bigint, embedding array<float>"


def vectors(n, d, seed=1, fall=1.0, copies=0):
    rng = np.random.default_rng(seed)
    m = (rng.standard_normal((n, d)) * fall ** np.arange(d) * 20) @ np.linalg.qr(rng.standard_normal((d, d)))[0] + rng.standard_normal(d)
    m[:copies] = m[0]
    return m.astype(np.float32)


def slow(m, k):
    """Whitened values, shares, deviations by the definition, in one matrix."""
    x = np.floor(64 * m.astype(float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s // n - s % n / n
    values, u = np.linalg.eigh(y.T @ y / n)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    return y @ u / np.sqrt(values), values / (y**2).sum() * n, deviation


def frame(spark, rows):
    return spark.createDataFrame(rows, VEC).selectExpr("*", "'x' as component", "1 as n", "2.0 as whitened", "3 as d").repartition(5)


def check(got, m, k):
    want, shares, deviation = slow(m, k)
    found = np.full(want.shape, np.nan)
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == len(m) and r.deviation == deviation[r.vec_id] and math.isclose(r.explained, shares[r.component - 1], rel_tol=1e-9) and r.identity_error < 1e-9
    sign = np.sign((found * want).sum(axis=0))
    assert np.abs(found * sign - want).max() < 1e-7
    assert len(got) == want.size


@pytest.mark.parametrize("fall,d,copies", [(0.5, 48, 0), (0.97, 48, 0), (0.9, 6, 0), (0.97, 40, 100)])
def test_equals_plain_whitening(spark, fall, d, copies):
    m = vectors(300, d, fall=fall, copies=copies)
    check(W.whiten(frame(spark, [(k, v.tolist()) for k, v in enumerate(m)]), components=4).collect(), m, 4)


def test_the_basis_grows_only_where_the_range_is_not_found(spark):
    rng = np.random.default_rng(2)
    thin = (rng.integers(-9, 10, (300, 8)) @ rng.integers(-9, 10, (8, 48)) / 64).astype(np.float32)  # eight directions, whole numbers times 1/64
    falls, flat = (W.fit(W.usable(frame(spark, [(k, v.tolist()) for k, v in enumerate(m)]), "vec_id", "embedding"), 4) for m in (thin, vectors(300, 48, fall=0.99)))
    assert falls.width == 12 and falls.passes <= W.POWER_PASSES + 1
    check(W.whiten(frame(spark, [(k, v.tolist()) for k, v in enumerate(thin)]), components=4).collect(), thin, 4)
    assert flat.width == 48 and flat.passes == W.POWER_PASSES + 2


def test_broken_and_repeated_rows(spark):
    m = vectors(60, 5)
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf")] * 5), (104, [1.0] * 4), (105, []), (106, [3e38] * 5)]
    check(W.whiten(frame(spark, rows + bad), components=3).collect(), m, 3)
    twice = W.whiten(frame(spark, rows + rows + [(None, rows[0][1])]), components=3).collect()
    assert len(twice) == 121 * 3 and {r.n for r in twice} == {121}
    assert len({(r.vec_id, r.component, r.whitened) for r in twice}) == 61 * 3, "repeated rows get equal results"
    assert {r.whitened for r in twice if r.vec_id is None} == {r.whitened for r in twice if r.vec_id == 0}


def test_without_variance_or_rows(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert W.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = W.whiten(frame(spark, [(k, [float(k), 2.0 * k, 0.0]) for k in range(20)])).collect()
    assert {r.component for r in flat} == {1}, "a direction without variance is left out"


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1_000_000, 1_000_100], [1 << 40, 5]])
    n, sums = 1 << 22, [(1 << 22) * 1_000_001, 7]
    want = [sum((n * int(c) - s) ** 2 for c, s in zip(r, sums)) for r in x]
    assert passes.deviations(x, n, sums) == [v if v < 1 << 63 else None for v in want] and None in passes.deviations(x, n, sums)
    assert passes.deviations(x[:1], 3, [3_000_001, 3_000_299]) == [2]


def test_sums_of_large_entries_are_exact(spark):
    rows = [(k, [float(1 << 45), float(-(1 << 45)), float(k)]) for k in range(200)]
    w = W.fit(W.usable(frame(spark, rows), "vec_id", "embedding"), 1)
    assert w.sums == [200 * ((1 << 51) + 1_000_000), 200 * (1_000_000 - (1 << 51)), 64 * 199 * 100 + 200_000_000]
