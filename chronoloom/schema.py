"""Row types of the engine's tables, and the rule that missing values are NULL.

NaN and infinities become NULL where data enters, so every aggregate skips them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_F, _S, _I, _L, _D = T.FloatType(), T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Series as they arrive: one inner array for each variate.
SERIES = _struct(item_id=_S, start=T.TimestampType(), freq=_S, target=T.ArrayType(T.ArrayType(_F)), past_feat=T.ArrayType(T.ArrayType(_F)))
#: Generated series.
CORPUS = _struct(generator=_S, seed=_I, series_id=_L, target=T.ArrayType(_F))
#: Windows of real series; ``target`` has ``valid_length`` values and is not padded.
WINDOWS = _struct(dataset=_S, freq=_S, domain=_S, valid_length=_I, window_index=_I, sampling_weight=_D, target=T.ArrayType(_F))
#: What a corpus of real series offers.
INDEX = _struct(name=_S, freq=_S, domain=_S, n_series=_I, n_variates=_I, mean_series_len=_D, min_series_len=_I, max_series_len=_I, total_obs=_L)
#: Quantile forecasts, a row for each level and step.
FORECAST = _struct(item_id=_S, window_idx=_I, step=_I, level=_D, value=_D)
#: Dataset properties by key.
PROPERTIES = T.MapType(_S, _struct(domain=_S, frequency=_S, num_variates=_I))
#: Error metrics of a task, in their order in result tables (fixed values).
METRICS = ("MSE[mean]", "MSE[0.5]", "MAE[0.5]", "MASE[0.5]", "MAPE[0.5]", "sMAPE[0.5]", "MSIS", "RMSE[mean]", "NRMSE[mean]", "ND[0.5]", "mean_weighted_sum_quantile_loss")
#: A result table: a row for each task.
RESULTS = T.StructType([T.StructField("dataset", _S), T.StructField("model", _S), *(T.StructField(m, _D) for m in METRICS), T.StructField("domain", _S), T.StructField("num_variates", _I)])


def finite(c: Column) -> Column:
    """``c``, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def finite_array(c: Column) -> Column:
    return F.transform(c, finite)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """``df`` with NULL for every NaN or infinity in float columns and arrays of floats."""
    real = (T.FloatType, T.DoubleType)
    out = {}
    for field in df.schema:
        kind, c = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, real):
            out[field.name] = finite(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, real):
            out[field.name] = finite_array(c)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType) and isinstance(kind.elementType.elementType, real):
            out[field.name] = F.transform(c, finite_array)
    return df.withColumns(out) if out else df


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if it has the columns; names all that are missing otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}; the table has {', '.join(df.columns)}")
    return df
