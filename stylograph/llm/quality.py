"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives a dozen shares and ratios, transformed towards a normal shape. Both classes get a mean and
a covariance from sums that Spark adds up over all training rows, shrunk towards their diagonal and
a common floor, so that no class is singular. A text's score is the logistic of the difference of the two
log-densities, whose Mahalanobis distances come from Cholesky factors computed once and shipped with the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylograph.llm.common import landed, text_of

#: Ids of labelled rows that may be broadcast to pick their texts; beyond that all texts outside the held-out third are measured.
BROADCAST_IDS = 1_000_000
FEATURES = ("word", "letters", "capitals", "digits", "marks", "blanks", "stops", "distinct", "pairs", "line_repeats")


#: What a text's shares are drawn towards, as if it were so many characters, words and lines longer: shares of very
#: short texts say little. The values are those of ordinary prose.
USUAL = {"letters": 0.8, "capitals": 0.03, "digits": 0.0, "marks": 0.0, "blanks": 0.17, "stops": 0.15, "pairs": 0.01}
MORE_CHARS, MORE_WORDS, MORE_LINES = 120.0, 20.0, 1.0


def statistics(text: Column) -> dict[str, Column]:
    """The transformed statistics of a whole text, all defined (and finite) for the empty text too."""
    def spread(of: Column) -> Column:
        return F.asin(F.sqrt(F.least(of, F.lit(1.0))))

    def share(name: str, part: Column, whole: Column, more: float) -> Column:
        return spread((part + USUAL[name] * more) / (whole + more))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    def distinct(of: Column) -> Column:
        return F.size(F.array_distinct(of)).cast("double")

    chars = F.length(text).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n_words = F.size(words).cast("double")
    lines = F.filter(F.split(text, r"\n"), lambda w: w != "")
    n_lines = F.size(lines).cast("double")
    letters = count(r"\p{L}")
    following = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    same = F.size(F.filter(F.arrays_zip(words.alias("a"), following.alias("b")), lambda z: z["a"] == z["b"])).cast("double")
    return {
        "word": F.log((chars + MORE_CHARS) / (n_words + MORE_WORDS)),
        "letters": share("letters", letters, chars, MORE_CHARS),
        "capitals": share("capitals", count(r"\p{Lu}"), letters, MORE_CHARS),
        "digits": share("digits", count(r"\p{N}"), chars, MORE_CHARS),
        "marks": share("marks", count(r"[^\p{L}\p{N}\s.,]"), chars, MORE_CHARS),
        "blanks": share("blanks", count(r"\s"), chars, MORE_CHARS),
        "stops": share("stops", count(r"[.,]"), n_words, MORE_WORDS),
        "distinct": F.log((distinct(words) + MORE_WORDS) / (n_words + MORE_WORDS)),
        "pairs": share("pairs", same, n_words, MORE_WORDS),
        "line_repeats": F.log((distinct(lines) + MORE_LINES) / (n_lines + MORE_LINES)),
    }


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return text.select("id", *(c.alias(n) for n, c in statistics(F.col("text")).items()))


@dataclass(frozen=True)
class Gaussian:
    mean: np.ndarray
    factor: np.ndarray  # lower Cholesky factor of the shrunk covariance
    weight: float  # log prior - half the log determinant

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        solved = np.linalg.solve(self.factor, (rows - self.mean).T)
        return self.weight - 0.5 * (solved**2).sum(0)


def fit(rows: DataFrame, label: str = "label", shrinkage: float = 0.1, floor: float = 2.5e-3, prior: float | None = None) -> dict[int, Gaussian] | None:
    """The class densities from all ``rows`` (features and a 0/1 label; other labels don't count), or None
    when a class has fewer than two rows. ``prior`` is class 1's, by default its share of the rows. Only sums, a
    number that depends on the features alone, reach the driver."""
    n = len(FEATURES)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count("*").alias("n"),
        *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs),
    ).collect()
    counts = {int(r[label]): r["n"] for r in sums}
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return None
    share = counts[1] / sum(counts.values()) if prior is None else prior
    model = {}
    for r in sums:
        mean = np.array([r[f"s{i}"] for i in range(n)]) / r["n"]
        square = np.zeros((n, n))
        for i, j in pairs:
            square[i, j] = square[j, i] = r[f"p{i}_{j}"]
        covariance = square / r["n"] - np.outer(mean, mean)
        shrunk = (1 - shrinkage) * covariance + shrinkage * np.diag(np.diag(covariance)) + floor * np.eye(n)
        factor = np.linalg.cholesky(shrunk)
        own = share if r[label] == 1 else 1 - share
        model[int(r[label])] = Gaussian(mean, factor, float(np.log(own) - np.log(np.diag(factor)).sum()))
    return model


def score(model: dict[int, Gaussian] | None) -> Column:
    """The score of a row's features, 0 to 1; 0.5 for every row without a model. Only the features go to Python."""

    @F.pandas_udf("double")
    def scored(rows: pd.DataFrame) -> pd.Series:
        if not model:
            return pd.Series(np.full(len(rows), 0.5))
        values = rows.to_numpy(float)
        odds = model[1].log_density(values) - model[0].log_density(values)
        return pd.Series(1 / (1 + np.exp(-np.clip(odds, -500, 500))))

    return scored(F.struct(*FEATURES))


def held_out(id_col: str) -> Column:
    """A third of the ids, never learnt from; null ids are not of it."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted.

    Learns from the labelled rows that are not held out, one training row per row of docs and labels that agree in id.
    Null texts count as empty and get a score like any other. Without rows of both classes every score is 0.5. A score of
    0.5 is predicted as 1. Other columns take no part."""
    rows = landed(features(docs, id_col, text_col).withColumn("held_out", held_out("id")), "features")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out("id"))
    model = fit(rows.join(known, "id"))
    out = rows.withColumn("score", score(model))
    return out.select(F.col("id").alias(id_col), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more. The text alone decides. Learns from the
    same rows as ``classify``, in a pass of its own, so texts are neither shuffled nor written."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(~held_out("id"))
    own = docs.where(~held_out(id_col))
    ids = known.select("id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # statistics of labelled texts only
        own = own.join(F.broadcast(ids), own[id_col] == ids["id"], "left_semi")
    model = fit(features(own, id_col, text_col).join(known, "id"))
    row = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    judged = docs.select(row, *(c.alias(n) for n, c in statistics(text_of(text_col)).items())).withColumn("score", score(model))
    return judged.where(F.col("score") >= least).select("row.*")
