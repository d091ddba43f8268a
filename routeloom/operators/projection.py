"""Principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(points: DataFrame, cols: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """``points`` with ``pca_1`` ... ``pca_k``, and the explained share of variance of each.

    The sign of a component is chosen so that its largest loading is positive.
    """
    means = points.agg(*[F.avg(c).alias(f"m_{c}") for c in cols])
    centered = points.withColumns({f"_{c}": F.col(c) - means.select(f"m_{c}").scalar() for c in cols})
    vectors = VectorAssembler(inputCols=[f"_{c}" for c in cols], outputCol="_vector").transform(centered)
    model = PCA(k=k, inputCol="_vector", outputCol="_pc").fit(vectors)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(k)]
    values = vector_to_array("_pc")
    projected = model.transform(vectors).select(
        *points.columns, *[(values[j] * signs[j]).alias(f"pca_{j + 1}") for j in range(k)]
    )
    return projected, [float(v) for v in model.explainedVariance.toArray()]


def explained_variance(points: DataFrame, cols: list[str], k: int = 2) -> DataFrame:
    shares = pca(points, cols, k)[1]
    return points.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(shares)], "component int, share double")
