"""Whitening against dense eigenvectors and exact sums in plain Python."""

import math

import numpy as np
import pytest

from reviewlake.llm import queries, whitening


def plain(rows, k=32):
    """id, x and the dense answer of the usable rows."""
    kept = [
        (i, [math.floor(64 * float(c)) + 1_000_000 for c in v])
        for i, v in rows
        if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)
    ]
    x = np.array([v for _, v in kept], dtype=np.float64)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(-values)[:k]
    sums = [sum(v[d] for _, v in kept) for d in range(x.shape[1])]
    deviations = [sum((len(kept) * e - s) ** 2 for e, s in zip(v, sums, strict=True)) for _, v in kept]
    return kept, centred, values[order], vectors[:, order].T, values.sum(), deviations


def check(got, rows):
    kept, centred, values, vectors, trace, deviations = plain(rows)
    k = len(values)
    assert len(got) == len(kept) * k
    assert {r["n"] for r in got} == {len(kept)}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] <= 1e-8
    by_component = {}
    for r in got:
        by_component.setdefault(r["component"], []).append(r)
    assert sorted(by_component) == list(range(1, k + 1))
    for c, found in by_component.items():
        assert found[0]["explained"] == pytest.approx(values[c - 1] / trace, rel=1e-9)
        expected = centred @ vectors[c - 1] / math.sqrt(values[c - 1])
        at = {}
        for (i, _), e, d in zip(kept, expected, deviations, strict=True):
            at.setdefault(i, []).append((d, e))
        sign = 0
        for r in found:
            d, e = next((d, e) for d, e in at[r["vec_id"]] if d == int(r["deviation"]))
            if not sign and abs(e) > 1e-4:
                sign = 1 if e * r["whitened"] > 0 else -1
            assert r["whitened"] * (sign or 1) == pytest.approx(e, abs=1e-6)


def test_query_equals_dense_eigenvectors(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(queries.QUERIES["op13_whitening"](spark, sf_dir).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(5) * [9, 4, 2, 1, 0.5] + 300).tolist()) for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1]), (60, None), (61, []), (62, [1.0, None, 1.0, 1.0, 1.0])]
    rows += [(63, [1.0, math.nan, 1.0, 1.0, 1.0]), (64, [1.0, math.inf, 1.0, 1.0, 1.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, component string")
    got = whitening.whiten(docs).collect()
    check(got, rows)
    assert {r["vec_id"] for r in got} == {*range(60), None}


def test_without_variance_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert len(got) == 4
    assert {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in got} == {(None, 0.0, 0.0, 0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(9)], schema)).collect()
    assert [r["whitened"] is None for r in line if r["vec_id"] == 3] == [False, True, True]
    with pytest.raises(ValueError, match="several lengths"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


@pytest.mark.parametrize("seed", range(6))
def test_slicing_equals_dense_on_clusters(seed):
    rng = np.random.default_rng(seed)
    n = 24
    basis, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = np.sort(rng.choice([1.0, 1.0 + 1e-9, 2.0, 5.0, 0.0, 1e-7, 100.0], n))[::-1]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_eigenpairs(matrix, 16)
    assert np.allclose(found, values[:16], atol=1e-11 * values.sum())
    assert np.allclose(vectors @ vectors.T, np.eye(16), atol=1e-6)
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() <= 1e-9 * max(values)
    for shift in (0.5, 1.5, 3.0, 50.0):
        assert whitening.positive_count(matrix, shift) == (values > shift).sum()


def test_indefinite_counts():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 17):
        a = rng.standard_normal((n, n))
        a = a + a.T
        np.fill_diagonal(a, 0)
        assert whitening.positive_count(a, 0.0) == (np.linalg.eigvalsh(a) > 0).sum()


def test_sums_stay_exact_beyond_double():
    rows = np.array([[3_000_000_001, -7], [2_999_999_999, 5]])
    assert (whitening.exact_gram(rows) == rows.T.astype(object) @ rows.astype(object)).all()
    fitted = whitening.Whitening(2, tuple(map(int, rows.sum(axis=0))), np.zeros(0), np.zeros((0, 2)), 0.0)
    for x, d in zip(rows.tolist(), fitted.deviation(rows), strict=True):
        assert d == sum((2 * a - int(s)) ** 2 for a, s in zip(x, rows.sum(axis=0), strict=True))
