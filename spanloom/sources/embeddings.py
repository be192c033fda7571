"""Vectors of texts: a model loaded once a worker, or hashed tokens where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import col, tokens

#: Texts a model sees at once.
BATCH = 64


def embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH) -> Callable[[Column], Column]:
    """A Column function over a model: load() runs once a worker and gives embed(texts)."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embed = load()
        for texts in parts:
            known = texts.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(known), batch) for v in embed(known[i : i + batch])], index=texts.index)

    return run


def hashed(text: Column | str, dims: int = 384) -> Column:
    """A vector of signed token counts by hash: equal texts have equal vectors, and no model is needed."""
    at = F.transform(
        tokens(col(text)),
        lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).alias("k"), F.when(F.xxhash64(t, F.lit(1)) % 2 == 0, 1.0).otherwise(-1.0).alias("v")),
    )
    bound = F.transform(
        F.array(at),
        lambda a: F.transform(
            F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.aggregate(F.filter(a, lambda x: x["k"] == k), F.lit(0.0), lambda s, x: s + x["v"])
        ),
    )
    return F.element_at(bound, 1)
