"""A text classifier over hashed words, fitted in Spark by counts: what scoring in batches is given as its model.

Words are runs of letters and single marks; those of four capitals or more are one word, the others are lower-cased; a word's
bucket is the first four hex digits of its MD5. Of each class the texts that have a bucket are counted, one aggregation that
combines before it shuffles. Buckets that tell something are those in enough texts that one class has much more often than
all texts do; their weights, 65,536 rows at most, come to the driver. A text's score for a class is the class's share of the
posterior.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

WORD, CAPITALS = "[#*$%&|<>]|[A-Za-z]+", "^[A-Z]{4,}$"
#: A bucket's texts, and how many times more often than in all texts it is in one class's.
TEXTS, TIMES = 10, 4.0


def buckets(text: Column) -> Column:
    """The different buckets of a text's words."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return F.array_distinct(F.transform(words, lambda w: F.substring(F.md5(F.when(w.rlike(CAPITALS), "CAPS").otherwise(F.lower(w))), 1, 4)))


@lru_cache(maxsize=100_000)
def bucket(word: str) -> str:
    told = "CAPS" if re.match(CAPITALS, word) else word.lower()
    return hashlib.md5(told.encode(), usedforsecurity=False).hexdigest()[:4]


class Model:
    """Scores of each class for a batch of texts, in order: ``lambda: model`` is a maker of models for ``scoring.score``."""

    def __init__(self, labels: list[str], prior: np.ndarray, weights: dict[str, np.ndarray]):
        self.labels, self.prior, self.weights = labels, prior, weights

    def __call__(self, texts: list[str]) -> pd.DataFrame:
        rows = []
        for t in texts:
            logs = self.prior.copy()
            for b in {bucket(w) for w in re.findall(WORD, t or "")}:
                if (w := self.weights.get(b)) is not None:
                    logs += w
            share = np.exp(logs - logs.max())
            rows.append(share / share.sum())
        return pd.DataFrame(np.array(rows).reshape(len(texts), len(self.labels)), columns=self.labels)


def least(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The rows that are the first ``most`` by the MD5 of ``order``, nulls first. The hash up to which they go is found on the hashes alone, by
    counts of their first four digits and then inside one of these, so that no task gathers the rows. Of rows with that very hash some are taken."""
    digest = F.coalesce(F.md5(F.col(order).cast("string")), F.lit(""))
    hashes = rows.select(digest.alias("h"))
    counts = sorted(hashes.groupBy(F.substring("h", 1, 4).alias("p")).agg(F.count("*").alias("n")).collect())  # 65,537 rows at most
    for prefix, n in counts:
        if n > most:
            break
        most -= n
    else:
        return rows
    if most <= 0:
        return rows.where(digest < prefix)
    cut = hashes.where(F.substring("h", 1, 4) == prefix).orderBy("h").limit(most).agg(F.max("h").alias("h")).first()["h"]
    below, equal = hashes.where(F.substring("h", 1, 4) == prefix).agg(F.count(F.when(F.col("h") < cut, 1)), F.count(F.when(F.col("h") == cut, 1))).first()
    if below + equal <= most:
        return rows.where(digest <= cut)
    return rows.where(digest < cut).unionByName(rows.where(digest == cut).limit(most - below))


def fit(rows: DataFrame, text: str, label: str, labels: list[str], order: str, most: int | None = 100_000) -> Model:
    """A model of labelled rows: of all of them where ``most`` is None, else of at most so many, those least by the MD5 of ``order``. What
    is held is bounded either way, as counts are summed over the rows."""
    known = rows.where(F.col(label).isin(labels))
    held = (known if most is None else least(known, order, most)).select(F.col(label).alias("label"), buckets(F.coalesce(F.col(text), F.lit(""))).alias("b"))
    sizes = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one for each label
    n, total = [sizes.get(x, 0) for x in labels], sum(sizes.values())
    per = held.select("label", F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("label") == x, 1)).alias(f"n{i}") for i, x in enumerate(labels)])
    share = F.col("n") / F.lit(max(total, 1))
    often = [(F.col(f"n{i}") + share) / (n[i] + 1) for i in range(len(labels))]
    telling = per.where((F.col("n") >= TEXTS) & (F.greatest(*often) >= TIMES * share)).select("b", *[F.ln(x).alias(f"w{i}") for i, x in enumerate(often)])
    weights = {r["b"]: np.array([r[f"w{i}"] for i in range(len(labels))]) for r in telling.collect()}  # a row for each bucket at most
    return Model(labels, np.log((np.array(n) + 1) / (total + len(labels))), weights)


def maker(model: Model) -> Callable[[], Model]:
    return lambda: model
