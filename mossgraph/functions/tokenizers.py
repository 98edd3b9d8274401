"""Pluggable tokenisers and pooling for embedders."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _punctuation(c: str) -> bool:
    return (33 <= ord(c) <= 47) or (58 <= ord(c) <= 64) or (91 <= ord(c) <= 96) or (123 <= ord(c) <= 126) or unicodedata.category(c).startswith("P")


def wordpiece(text: str, vocabulary: dict[str, int], limit: int = 256, longest: int = 100) -> list[int]:
    """Ids of the greedy longest pieces between [CLS] and [SEP], cut to ``limit``."""
    words = "".join(f" {c} " if _punctuation(c) else c for c in text.lower()).split()
    unknown, out = vocabulary["[UNK]"], []
    for word in words:
        pieces, at = [], 0
        while at < len(word) and len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), at)
            if end == at:
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += pieces if at == len(word) and pieces else [unknown]
    return [vocabulary["[CLS]"], *out[: limit - 2], vocabulary["[SEP]"]]


def wordpiece_udf(vocabulary: dict[str, int], limit: int = 256) -> Callable[[Column], Column]:
    """A column function over a vocabulary of bounded size, which goes to the workers with it."""

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([wordpiece(t or "", vocabulary, limit) for t in texts])

    return ids


def embedder_udf(embed: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function of any embedder of texts; it gets a batch at a time."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(embed(texts.fillna("").tolist())))

    return vectors


def mean_pool(vectors: Column) -> Column:
    """The mean of an array of vectors; null where a component is not finite."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors), F.lit(1))), F.transform(vectors[0], lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / F.size(vectors))
    return F.when(F.forall(mean, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), mean)


def mean_vectors(rows: DataFrame, by: str, vector: str = "vector") -> DataFrame:
    """``by`` and the mean of each group's vectors. Components are averaged by position, so a group is never in one row before it is a single vector; null where a mean is not finite."""
    means = rows.select(by, F.posexplode(vector).alias("_i", "_x")).groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    whole = means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"]).alias("_v"))  # one entry per position
    return whole.select(by, F.when(F.forall("_v", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.col("_v")).alias(vector))
