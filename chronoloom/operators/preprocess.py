"""Features made comparable: heavy tails bent, scaled by the reference corpus, clipped."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.numeric import clip, signed_log1p, zero_for_missing
from chronoloom.operators.features import FEATURES, HEAVY_TAILS
from chronoloom.schema import require

#: Bound of scaled values (fixed value).
CLIP = 10.0


@dataclass(frozen=True)
class Scaler:
    """Means and population deviations of the prepared reference features."""

    names: tuple[str, ...]
    heavy: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]

    def transform(self, df: DataFrame, limit: float = CLIP) -> DataFrame:
        require(df, *self.names)
        scaled = {n: clip((_prepared(n, self.heavy) - F.lit(m)) / F.lit(s), -limit, limit) for n, m, s in zip(self.names, self.means, self.stds, strict=True)}
        return df.withColumns(scaled)


def _prepared(name: str, heavy: Sequence[str]):
    c = zero_for_missing(F.col(f"`{name}`").cast("double"))
    return signed_log1p(c) if name in heavy else c


def fit(reference: DataFrame, names: Sequence[str] = FEATURES, heavy: Sequence[str] = HEAVY_TAILS) -> Scaler:
    """A scaler from one aggregation over the reference corpus alone; a constant feature is not divided."""
    require(reference, *names)
    row = reference.agg(*[F.avg(_prepared(n, heavy)).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(_prepared(n, heavy)).alias(f"s{i}") for i, n in enumerate(names)]).first()
    return Scaler(tuple(names), tuple(heavy), tuple(row[f"m{i}"] or 0.0 for i in range(len(names))), tuple(row[f"s{i}"] or 1.0 for i in range(len(names))))


def triage(features: DataFrame, ks: dict[str, float], names: Sequence[str], limit: float = 0.8) -> list[str]:
    """Names that stay when, of the most correlated pair above ``limit``, the one with the smaller KS goes, again and again.

    The correlations are one pass over the data; the loop runs on the names.
    """
    from pyspark.ml.feature import VectorAssembler

    rows = features.select(*[zero_for_missing(F.col(f"`{n}`").cast("double")).alias(f"f{i}") for i, n in enumerate(names)])
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="v").transform(rows).select("v")
    rho = abs(Correlation.corr(vectors, "v").first()[0].toArray())
    left = list(range(len(names)))
    while True:
        worst = max(((rho[i, j], i, j) for i in left for j in left if i < j and rho[i, j] == rho[i, j]), default=(0.0, 0, 0))
        if worst[0] <= limit:
            return [names[i] for i in left]
        left.remove(min(worst[1:], key=lambda i: (ks[names[i]], names[i])))
