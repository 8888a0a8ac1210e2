"""Components of wide tables against a dense eigendecomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import scale, wide_pca


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)], "id long, v array<double>")


def shares_of(x):
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1]
    return values / values.sum()


def test_equals_the_dense_form_on_the_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cols = [f"e{i}" for i in range(64)]
    flat = df.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    want = [r["explained"] for r in scale.pca_variance(flat, cols, 0.97).filter("kept").orderBy("k").collect()]
    for given in (wide_pca.wide_pca_variance(df, "embedding", 0.97), wide_pca.wide_pca_variance(flat, cols, 0.97, block=7)):
        got = [r["explained"] for r in given.orderBy("k").collect()]
        assert len(got) == len(want) and np.allclose(got, want, atol=1e-9)


def test_few_passes_over_a_table_of_low_rank(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) @ np.diag(0.6 ** np.arange(12)) @ rng.normal(size=(12, 700)) + 1e-3 * rng.normal(size=(300, 700)) + 50
    passes, summed = [], wide_pca._summed
    monkeypatch.setattr(wide_pca, "_summed", lambda rows, width, of, out: passes.append(out) or summed(rows, width, of, out))
    df = frame(spark, x)
    got = wide_pca.principal_components(df, "v", 0.97)
    want = shares_of(x)[: len(got.shares)]
    assert np.allclose(got.shares, want, atol=1e-8) and got.shares.sum() >= 0.97 > got.shares[:-1].sum()
    assert len(passes) <= 6 and max(passes) <= 16  # two of them for mean and variance
    centred = x - x.mean(axis=0)
    assert np.allclose(got.loadings.T @ got.loadings, np.eye(len(want)), atol=1e-9)
    placed = wide_pca.wide_pca_project(df, "v", got).orderBy("id").collect()
    assert np.allclose([r["pca"] for r in placed], centred @ got.loadings, atol=1e-6)
    assert np.allclose(np.var([r["pca"] for r in placed], axis=0) / centred.var(axis=0).sum(), want, atol=1e-8)


def test_equal_eigenvalues_beyond_a_block(spark):
    x = np.vstack([np.eye(40), -np.eye(40)])
    got = wide_pca.principal_components(frame(spark, x), "v", 0.97, block=4)
    assert len(got.shares) == 39 and np.allclose(got.shares, 1 / 40)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (2, [2.0, 1.0, 5.0]), (3, None), (4, [None, 1.0, 1.0]), (5, [4.0, 4.0, 1.0]), (5, [4.0, 4.0, 1.0])]
    df = spark.createDataFrame(rows, "pca long, v array<double>")
    got = wide_pca.principal_components(df, "v", 1.0)
    assert np.allclose(got.shares, shares_of(np.array([r[1] for r in rows if r[0] in (1, 2, 5)]))[: len(got.shares)], atol=1e-12)
    placed = wide_pca.wide_pca_project(df.withColumnRenamed("pca", "id"), "v", got).orderBy("id").collect()
    assert [r["pca"] is None for r in placed] == [False, False, True, True, False, False]
    none = df.limit(0)
    assert wide_pca.wide_pca_variance(none, "v").count() == 0
    assert wide_pca.wide_pca_variance(frame(spark, [[1.0, 2.0]] * 3), "v").count() == 0
    with pytest.raises(ValueError):
        wide_pca.principal_components(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "v")
