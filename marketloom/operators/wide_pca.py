"""Principal components of wide tables, without a matrix of columns by columns.

A random block of directions is multiplied by the covariance, one pass over the
rows for each product, and what is new in the product becomes the next block. The
largest eigenpairs of the covariance inside all blocks so far (a Krylov space)
soon are those of the covariance itself. The driver holds one column of the basis
for each direction; of the table's columns by columns it holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.sources.durable import durable

#: Directions that one pass over the rows multiplies.
BLOCK = 16
#: Columns whose sums travel together.
CHUNK = 256


@dataclass
class Components:
    """Mean of the columns, one column of loadings and one share of the variance for each component."""

    mean: np.ndarray
    loadings: np.ndarray
    shares: np.ndarray


def _vectors(df: DataFrame, cols: list[str] | str) -> DataFrame:
    """Rows without a null as arrays of doubles in a column ``v``."""
    v = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(v.alias("v")).filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))


def _summed(rows: DataFrame, width: int, of, out_width: int) -> np.ndarray:
    """The sum over all rows of ``of(matrix of some rows)``, a matrix of ``width`` rows.

    Each task adds up its rows; its sums are dealt by chunks of columns, added up
    again chunk by chunk, and only the total is read back.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            own = of(x)
            total = own if total is None else total + own
        if total is not None:
            starts = list(range(0, width, CHUNK))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(starts, pa.int32()), "sums": pa.array([np.ascontiguousarray(total[s : s + CHUNK]).tobytes() for s in starts], pa.binary())})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, sums in zip(batch["chunk"], batch["sums"], strict=True):
                own = np.frombuffer(sums)
                totals[chunk] = totals[chunk] + own if chunk in totals else own
        yield pd.DataFrame({"chunk": list(totals), "sums": [t.tobytes() for t in totals.values()]})

    kind = "chunk int, sums binary"
    gathered = rows.mapInArrow(partial, kind).repartition("chunk").mapInPandas(add, kind).collect()
    out = np.zeros((width, out_width))
    for r in gathered:
        own = np.frombuffer(r["sums"]).reshape(-1, out_width)
        out[r["chunk"] : r["chunk"] + len(own)] = own
    return out


def _beyond(basis: np.ndarray, directions: np.ndarray, least: float) -> np.ndarray:
    """Orthonormal directions for what of the given ones lies outside the basis."""
    for _ in range(2):  # the second time takes out what rounding left
        directions = directions - basis @ (basis.T @ directions)
    u, size, _ = np.linalg.svd(directions, full_matrices=False)
    return u[:, size > least][:, : basis.shape[0] - basis.shape[1]]


def principal_components(df: DataFrame, cols: list[str] | str, share: float = 0.97, *, block: int = BLOCK, tolerance: float = 1e-9, seed: int = 11) -> Components:
    """The components that hold ``share`` of the variance, largest first.

    ``cols`` are columns of numbers, or one column of arrays of equal length. Rows
    that hold a null are left out. A component is taken when its residual is under
    ``tolerance`` of the whole variance, which bounds the error of its share; so
    many passes are made as that takes, and no more than columns / block. A table
    without rows or without variance has no component. Repeated rows count as
    rows; other columns don't matter.
    """
    vectors = durable(_vectors(df, cols))
    first = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("widest"), F.min(F.size("v")).alias("narrowest")).first()
    n, width = first["n"], first["widest"] or 0
    if n and first["narrowest"] != width:
        raise ValueError(f"arrays of {first['narrowest']} to {width} numbers")
    empty = Components(np.zeros(width), np.zeros((width, 0)), np.zeros(0))
    if not n or not width:
        return empty
    mean = _summed(vectors, width, lambda x: x.sum(axis=0)[:, None], 1)[:, 0] / n
    # squares about the mean: no difference of large numbers
    whole = float(_summed(vectors, width, lambda x: ((x - mean) ** 2).sum(axis=0)[:, None], 1).sum() / n)
    if whole <= 0:
        return empty

    def product(q: np.ndarray) -> np.ndarray:
        """The covariance times some directions."""

        def of(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return _summed(vectors, width, of, q.shape[1]) / n

    basis = np.zeros((width, 0))
    image = np.zeros((width, 0))  # the covariance times the basis
    rng = np.random.default_rng(seed)
    new, _ = np.linalg.qr(rng.standard_normal((width, min(block, width))))
    while True:
        basis = np.hstack([basis, new])
        image = np.hstack([image, product(new)])
        inner = basis.T @ image
        values, turns = np.linalg.eigh((inner + inner.T) / 2)
        values, turns = values[::-1].clip(0), turns[:, ::-1]
        shares = values / whole
        needed = min(int((shares.cumsum() < share).sum()) + 1, len(shares))
        residual = np.linalg.norm(image @ turns[:, :needed] - (basis @ turns[:, :needed]) * values[:needed], axis=0)
        reached = shares[:needed].sum() >= share and (residual <= tolerance * whole).all()
        if reached or basis.shape[1] >= width:
            break
        new = _beyond(basis, image[:, -new.shape[1] :], 1e-13 * whole)
        if not new.shape[1]:  # the blocks hold whole eigenspaces: what they lack lies in others
            new = _beyond(basis, rng.standard_normal((width, min(block, width))), 1e-9)
    return Components(mean, basis @ turns[:, :needed], shares[:needed])


def wide_pca_variance(df: DataFrame, cols: list[str] | str, share: float = 0.97, **options) -> DataFrame:
    """``k, explained, cumulative`` of the components that hold ``share`` of the variance (``principal_components``)."""
    shares = principal_components(df, cols, share, **options).shares
    rows = [(k, float(x), float(upto)) for k, (x, upto) in enumerate(zip(shares, shares.cumsum(), strict=True), 1)]
    return df.sparkSession.createDataFrame(rows, "k int, explained double, cumulative double")


def wide_pca_project(df: DataFrame, cols: list[str] | str, components: Components) -> DataFrame:
    """``df`` plus an array ``pca`` of each row's places along the components; null where a value is null."""
    sent = df.sparkSession.sparkContext.broadcast((components.mean, components.loadings))

    @F.pandas_udf("array<double>")
    def places(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mean, loadings = sent.value
        for batch in vectors:
            known = batch.notna().to_numpy()
            out = pd.Series([None] * len(batch), dtype=object)
            if known.any():
                found = (np.stack(batch[known].to_list()) - mean) @ loadings
                for at, row in zip(np.flatnonzero(known), found, strict=True):
                    out.iat[at] = row
            yield out

    v = F.col(cols).cast("array<double>") if isinstance(cols, str) else F.array(*[F.col(c).cast("double") for c in cols])
    return df.withColumn("pca", places(F.when(F.forall(v, lambda x: x.isNotNull()), v)))
