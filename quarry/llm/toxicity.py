"""Toxicity by class-conditional Kneser-Ney models.

Two byte models are trained side by side, on texts labelled toxic and on
texts labelled ordinary; their lower orders share the counts of both classes,
so an expression too rare to tell the classes apart gets nearly equal
probabilities from both.  A text's evidence is the difference of its
log-likelihoods over its length.  Bytes whose probabilities differ by less
than a floor count as equally likely, else the sampling noise of thousands of
ordinary bytes hides a few telling words; the floor, of a few fixed ones, and
a logistic curve that turns evidence into a score are fitted on labelled rows
that trained neither model.

Rows with ``crc32(doc_id) % 5 = 0`` are held out; remainder 1 fits the curve,
the others train the models.  At most about ``max_labels`` labelled rows
(chosen by a hash of the id) are used.  Null and empty texts have no evidence
and score as the share of toxic rows (at most just under a half); null labels
and labels without a document are skipped, several labels of an id count as
toxic if one is.  Without labels of both kinds every score is 0.  An empty
table gives an empty table; all columns that were asked for are kept.
"""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.byte_models import count_windows, estimate, score

SHARED = 2
FOLDS = 5
DAMP = 100.0  # bytes of no evidence added to every text's length
FLOORS = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % FOLDS


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
             max_labels: int) -> DataFrame:
    """``__text, __fold, __class`` of labelled rows; the labels are broadcast,
    their number is bounded by ``max_labels``."""
    known = (labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id")
             .agg(F.max("toxic").alias("__class")).filter(F.crc32(F.col("doc_id").cast("string").cast("binary"))
                                                          % FOLDS != 0))
    share = min(1.0, max_labels / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    return (docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
            .join(F.broadcast(known.withColumnRenamed("doc_id", "__id")), "__id")
            .select("__text", "__class", fold("__id").alias("__fold")))


def evidence(total: Column, size: Column) -> Column:
    return total / (size + F.lit(DAMP))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, both classes
    weighing what they hold, with a slight pull towards 0."""
    scale = float(np.std(x)) or 1.0
    a, b = 0.0, 0.0
    z = x / scale
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([np.sum((p - y) * z) + 0.1 * a, np.sum(p - y) + 0.001 * b])
        h = np.array([[np.sum(w * z * z) + 0.1, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 0.001]])
        step = np.clip(np.linalg.solve(h, g), -4, 4)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return a / scale, b


def curve(x, slope: float, offset: float):
    return 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))


class Model:
    """The n-gram table, the evidence floor and the score curve."""

    def __init__(self, grams: DataFrame | None, floor: float = 0.0, slope: float = 1.0,
                 offset: float = 0.0, prior: float = 0.0):
        self.grams, self.floor, self.slope, self.offset, self.prior = grams, floor, slope, offset, prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_labels: int = 200_000) -> Model:
    rows = labelled(docs, labels, id_col, text_col, max_labels)
    n = rows.groupBy("__class").count().collect()
    n = {r["__class"]: r["count"] for r in n}
    if not (n.get(0) and n.get(1)):
        return Model(None)
    windows = count_windows(rows.filter("__fold > 1"), "__text", "__class", 2, lower=True)
    grams = estimate(windows, 2, shared=SHARED)
    check = score(rows.filter("__fold = 1"), grams, "__text", ["__class"], 2, lower=True, floors=FLOORS)
    pairs = check.select("__class", *[evidence(F.col(f"__total{i}"), F.col("__bytes")).alias(f"x{i}")
                                      for i in range(len(FLOORS))]).toArrow()
    y = pairs.column(0).to_numpy().astype(float)
    prior = n[1] / (n[0] + n[1])
    if not 0 < y.sum() < len(y):
        return Model(grams, prior=prior)
    fits = []
    for i, floor in enumerate(FLOORS):
        x = pairs.column(i + 1).to_numpy()
        slope, offset = fit_curve(x, y)
        p = np.clip(curve(x, slope, offset), 1e-12, 1 - 1e-12)
        fits.append((-np.mean(np.log(np.where(y == 1, p, 1 - p))), floor, slope, offset))
    return Model(grams, *min(fits)[1:], prior)


def toxicity(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep..., __score``: the columns asked for and the score."""
    if model.grams is None:
        return docs.select(*[f"`{c}`" for c in keep], F.lit(0.0).alias("__score"))
    made = score(docs, model.grams, text_col, keep, 2, lower=True, floors=(model.floor,))
    x = evidence(F.col("__total0"), F.col("__bytes"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(model.slope) * x + F.lit(model.offset))))
    prior = min(model.prior, math.nextafter(0.5, 0))
    return made.select(*[f"`{c}`" for c in keep],
                       F.when(F.col("__bytes") > 0, p).otherwise(F.lit(prior)).alias("__score"))
