"""Whitening against numpy and whole numbers on one machine."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=32):
    fit = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    n, sums = len(fit), [sum(c) for c in zip(*[x for _, x in fit])]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for _, x in fit])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for _, x in fit]
    return [i for i, _ in fit], n, deviation, centred @ q / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def data(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) + 50
    return [(i, [float(c) for c in row], 0) for i, row in enumerate(mixed.astype(np.float32))]


@pytest.mark.parametrize("n,dims,tile", [(300, 5, 32), (500, 70, 32), (400, 40, 7)])
def test_whitened_rows_match_numpy(spark, monkeypatch, n, dims, tile):
    monkeypatch.setattr(whitening, "TILE_DIMS", tile)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    rows = data(n, dims)
    rows += [(n, None, 1), (n + 1, [None] + [1.0] * (dims - 1), 1), (n + 2, [float("nan")] * dims, 1), (n + 3, [float("inf")] * dims, 1), rows[0], (None, rows[1][1], 1)]
    ids, size, deviation, white, explained = brute(rows)
    rows += [(n + 4, [1.0] * (dims + 1), 1), (n + 5, [], 1), (n + 6, [3e38] * dims, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    width = min(dims, 32)
    assert len(got) == len(ids) * width and set(got.n) == {size} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    got = got.sort_values(["component", "deviation", "whitened"])
    for c in range(width):
        part = got[got.component == c + 1]
        assert np.allclose(part.explained, explained[c], rtol=1e-9)
        assert sorted(part.deviation) == sorted(deviation)
        assert any(np.allclose(part.whitened, in_order(deviation, sign * white[:, c]), atol=1e-8) for sign in (1, -1))


def in_order(deviation, values):
    return [w for _, w in sorted(zip(deviation, values))]


def test_rows_without_variance(spark):
    def of(rows):
        return whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()

    assert of([]) == [] and of([(1, None, 0)]) == [] and of([(1, [1.0, 2.0], 0)]) == [] and of([(1, [1.0, 2.0], 0)] * 3) == []
    line = of([(k, [float(k), float(2 * k), 7.0], 0) for k in range(5)])
    assert {r.component for r in line} == {1} and sorted(round(abs(r.whitened), 9) for r in line) == [0.0] + [round(2**-0.5, 9)] * 2 + [round(2**0.5, 9)] * 2
    assert all(abs(r.explained - 1) < 1e-12 for r in line)
    assert sorted(r.deviation for r in line)[0] == 0


def test_deviations_are_exact_or_fail():
    big = 1 << 40
    assert whitening.deviations(np.array([[8, 5], [1, 1]]), 3, [10, 4]) == [14**2 + 11**2, 7**2 + 1]
    assert whitening.deviations(np.array([[big + 3, 5]]), 1, [big, 4]) == [10]
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[big, 5]]), 1, [0, 0])


def test_too_many_dimensions_fail(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MAX_DIMS", 3)
    with pytest.raises(ValueError, match="dimensions"):
        whitening.whiten(spark.createDataFrame([(1, [1.0] * 4, 0)], SCHEMA))
