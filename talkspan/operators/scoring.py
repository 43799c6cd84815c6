"""Model scores: models are not part of this engine; callers give functions from arrays to arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from talkspan.operators.sequences import folded


def scored(rows: DataFrame, column: str, make: Callable[[], Callable[[np.ndarray], np.ndarray]], out: str = "scores", batch: int = 32) -> DataFrame:
    """rows with `out` array<double>: make() builds the scorer once per task; it maps a batch of padded vectors to
    rows of scores. Null vectors have null scores."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<double>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in series:
            result = np.full(len(s), None, object)
            at = np.nonzero(s.notna().to_numpy())[0]
            for i in range(0, len(at), batch):
                part = [np.asarray(s.iloc[k], float) for k in at[i : i + batch]]
                x = np.zeros((len(part), max(map(len, part))))
                for r, v in enumerate(part):
                    x[r, : len(v)] = v
                for k, y in zip(at[i : i + batch], model(x), strict=True):
                    result[k] = np.asarray(y, float)
            yield pd.Series(result)

    return rows.withColumn(out, run(column))


def recurrent(rows: DataFrame, key: str, order: str, column: str, start: Callable[[], object], step: Callable[[object, np.ndarray], tuple[object, float]]) -> DataFrame:
    """key, order, prob: step carries its state along each item's rows. An incomplete last window is the caller's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, out = start(), []
        for v in pdf[column]:
            state, p = step(state, np.asarray(v, float))
            out.append(float(p))
        return pd.DataFrame({order: pdf[order].to_numpy(), "prob": out})

    return folded(rows.select(key, order, column), key, run, f"{order} {dict(rows.dtypes)[order]}, prob double")
