"""The eigensolver and the whitening against numpy's own eigenvectors."""

import numpy as np
import pytest

from netlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component int"


def expected(vectors, count=16):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1][:count], directions[:, ::-1][:, :count]
    whitened = (n * x - sums) / n @ directions / np.sqrt(values)
    return n, ((n * x - sums) ** 2).sum(axis=1), whitened, values / np.trace(centred.T @ centred / n)


def compare(found, ids, vectors, count):
    n, deviation, whitened, explained = expected(vectors, count)
    found = found.assign(copy=found.groupby(["vec_id", "component"]).cumcount())
    table = found.sort_values(["vec_id", "copy", "component"])
    assert len(table) == len(ids) * count and (table["n"] == n).all()
    order = np.argsort(ids, kind="stable")
    got = table["whitened"].to_numpy().reshape(-1, count)
    want = whitened[order]
    np.testing.assert_allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-7)
    assert (table["deviation"].to_numpy().reshape(-1, count) == deviation[order][:, None]).all()
    np.testing.assert_allclose(table["explained"].to_numpy()[:count], explained, rtol=1e-10)
    assert table["identity_error"].nunique() == 1 and table["identity_error"].iloc[0] < 1e-10


@pytest.mark.parametrize("size,rows", [(64, 3000), (220, 3000), (6, 100), (40, 12)])
def test_eigensolver_reaches_double_precision(size, rows):
    rng = np.random.default_rng(size)
    data = np.floor(64 * rng.standard_normal((rows, size)) * np.linspace(1, 1.2, size))
    data -= data.mean(axis=0)
    values, vectors = whitening.leading_eigenpairs(lambda q: data.T @ (data @ q) / rows, size, 16)
    want = np.linalg.eigvalsh(data.T @ data / rows)[::-1][: len(values)]
    np.testing.assert_allclose(values, want, rtol=1e-12, atol=1e-12 * want[0])
    assert np.linalg.norm(data.T @ (data @ vectors) / rows - vectors * values, axis=0).max() <= 2 * whitening.TOLERANCE * want[0]
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_equal_eigenvalues_give_an_orthonormal_basis():
    spectrum = np.array([5.0, 5.0, 5.0, 2.0, 2.0, 1.0, 1.0, 1.0, 0.5, 0.0])
    turn = np.linalg.qr(np.random.default_rng(1).standard_normal((10, 10)))[0]
    matrix = turn @ np.diag(spectrum) @ turn.T
    values, vectors = whitening.leading_eigenpairs(lambda q: matrix @ q, 10, 5)
    np.testing.assert_allclose(values, spectrum[:5], atol=1e-12)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)


def test_query_equals_numpy(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    found = queries.op11_embedding_whitening(spark, sf_dir)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.toPandas(), rows["vec_id"].to_numpy(), np.stack(rows["embedding"]), 16)


def test_odd_rows_repeats_and_hot_vectors(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(vectors)]
    rows += [(100 + i, vectors[0].tolist(), 1, 2) for i in range(40)] + [(5, vectors[5].tolist(), 1, 2)]
    odd = [(300, None, 1, 2), (301, [1.0] * 7 + [None], 1, 2), (302, [float("nan")] * 8, 1, 2), (303, [float("inf")] + [0.0] * 7, 1, 2), (304, [], 1, 2), (305, [1.0, 2.0], 1, 2)]
    found = whitening.whiten(spark.createDataFrame(rows + odd, SCHEMA).repartition(5)).toPandas()
    compare(found, np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), 8)


def test_null_ids_and_huge_entries(spark):
    rows = [(None, [1.0, 2.0], 0, 0), (None, [3.0, 1.0], 0, 0), (7, [3e38, -3e38], 0, 0), (8, [0.0, 0.0], 0, 0)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert found["vec_id"].isna().sum() == 2 * found["component"].nunique() and np.isfinite(found["whitened"]).all()
    assert found[found["vec_id"] == 7]["deviation"].isna().all()


@pytest.mark.parametrize("rows", [[], [(1, None, 0, 0)], [(1, [1.0, 2.0], 0, 0)], [(1, [1.0, 2.0], 0, 0), (2, [1.0, 2.0], 0, 0)]])
def test_no_variance_gives_no_rows(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_many_partial_sums_are_added_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    vectors = np.random.default_rng(9).standard_normal((200, 5)).astype(np.float32)
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(vectors)]
    compare(whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(7)).toPandas(), np.arange(200), vectors, 5)


def test_a_constant_entry_is_no_component(spark):
    rows = [(i, [float(i), 1.0, float(i % 3)], 0, 0) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert found["component"].max() == 2
