"""Scoring of texts by any model, in Arrow batches, and what is made of the scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def score(df: DataFrame, column: str, make: Callable[[], Callable[[list[str]], pd.DataFrame]], labels: list[str], prompt: str = "{}", chunk: int = 64, partitions: int | None = None) -> DataFrame:
    """The column and a score per label. ``make`` builds the model once for each task; it is given prompts in chunks and gives
    a row for each, in order."""
    rows = df.select(column)
    if partitions:
        rows = rows.repartition(partitions)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            for at in range(0, len(frame), chunk):
                texts = frame[column].iloc[at : at + chunk]
                out = model([prompt.format(t) for t in texts]).reset_index(drop=True)
                if len(out) != len(texts):
                    raise ValueError("a model must give one row for each text")
                yield pd.concat([texts.reset_index(drop=True), out[labels].astype("float64")], axis=1)

    return rows.mapInPandas(run, ", ".join([f"`{column}` string", *[f"`{x}` double" for x in labels]]))


def score_distinct(df: DataFrame, column: str, make, labels: list[str], **kwargs) -> DataFrame:
    """Every row with the scores of its text; each text is scored once."""
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    return df.join(score(texts, column, make, labels, **kwargs), column, "left")


def best_label(labels: list[str]) -> Column:
    """The label of the largest score; of equal ones the last by name."""
    return F.array_max(F.array(*[F.struct(F.col(x).alias("score"), F.lit(x).alias("label")) for x in labels]))["label"]


def combine(sentiment: DataFrame, translation: DataFrame, key: str, label: str) -> DataFrame:
    """Both by their text. A text with several labels fails the job."""
    one = sentiment.groupBy(key).agg(F.count_distinct(label).alias("__n"), F.min(label).alias(label))
    checked = one.withColumn(label, F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("conflicting labels: "), F.col(key))).cast("string")).otherwise(F.col(label))).drop("__n")
    return translation.join(checked, key)
