"""Places where a model is plugged in: embedders, scorers of pairs, judges. Deterministic stand-ins serve tests and offline runs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def embedder(embed: Callable[[list[str]], np.ndarray], dim: int, batch: int = 64) -> Callable[[Column], Column]:
    """A column function out of a function of many texts; called with ``batch`` texts at once, its shape is checked every time.

    Null texts have no vector and are never sent.
    """

    @pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = texts[texts.notna()]
        for a in range(0, len(some), batch):
            part = some.iloc[a : a + batch]
            got = np.asarray(embed(part.tolist()), dtype=np.float32)
            if got.shape != (len(part), dim):
                raise ValueError(f"the embedder gave {got.shape} instead of {(len(part), dim)}")
            for i, v in zip(part.index, got):
                out[i] = v
        return out

    return run


def pair_scorer(score: Callable[[list[str], list[str]], list[float]]) -> Callable[[Column, Column], Column]:
    """A column function out of a function of many pairs of texts; a pair with a null has no score."""

    @pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=a.index)
        both = a.notna() & b.notna()
        if both.any():
            out[both] = score(a[both].tolist(), b[both].tolist())
        return out

    return run


def judge(reply: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """A column function out of a function that answers many prompts."""

    @pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series(reply(prompts.fillna("").tolist()), index=prompts.index)

    return run


def hash_embedding(text: Column, dim: int = 8) -> Column:
    """A stand-in vector: the first bytes of the text's hash over 255, less a half. Column expressions alone."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255 - 0.5)


def axis_embedding(text: Column, axes: list[str]) -> Column:
    """A stand-in vector: how often each of the words occurs, and a last component that is smaller where any does."""
    low = F.lower(text)
    counts = [((F.length(low) - F.length(F.replace(low, F.lit(a), F.lit("")))) / len(a)).cast("double") for a in axes]
    some = F.array_max(F.array(*counts)) > 0
    return F.array(*counts, F.when(some, 0.1).otherwise(1.0))


def overlap_score(question: Column, text: Column) -> Column:
    """A stand-in pair score: shared words, and a little for short texts."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(question), words(text))) + F.lit(1.0) / (1 + F.length(text))
