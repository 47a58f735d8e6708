"""Quality classifier: Bradley-Terry scores from preference pairs.

Each pair holds a document labelled 1 and one labelled 0; a logistic loss on the difference
of their features gives the weights. The score is cut at the quantile of the training
scores that equals the share of label 0, and scaled so that the cut stands at 0.3.

Defined cases: a null text counts as empty, and empty texts have a score; null labels are
left out; a document labelled more than once counts with its smallest label; without labels
of both kinds all weights are 0 and every score is 0.3; repeated documents give repeated
rows; a null doc_id is in no fold: held_out is false.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table
from .quality_rules import MAX_LABELLED, labelled_statistics
from .textstats import statistics

#: A score of this or more predicts label 1.
CUT = 0.3
#: Pairs in which each document labelled 0 takes part.
PAIRS_EACH = 24


@dataclass(frozen=True)
class Ranker:
    edges: np.ndarray  # per statistic, the quantiles at which its steps stand
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def features(self, x: np.ndarray) -> np.ndarray:
        """Each statistic on a compressed scale, and one step for each of its quantiles passed."""
        steps = (x[:, :, None] > self.edges[None]).astype(float).reshape(len(x), -1)
        return np.hstack([np.log1p(np.maximum(x, 0)), steps])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((self.features(x) - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def table_of(counts: list[int], ratios: list[float]) -> list[float]:
    """What a score looks at: the ratios and the number of words."""
    return [*ratios, float(counts[0])]


def fit_ranker(x: np.ndarray, quality: np.ndarray, *, pairs_each: int = PAIRS_EACH, rounds: int = 300, l2: float = 1e-3, seed: int = 7) -> Ranker:
    """Full-batch gradient steps (with momentum) on log(1 + exp(-w . (good - bad)))."""
    d = x.shape[1]
    edges = np.quantile(x, [0.005, 0.02, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.98, 0.995], axis=0).T if len(x) else np.zeros((d, 11))
    m = Ranker(edges, 0.0, 1.0, np.zeros(d * 12), 0.0, 1.0)
    good, bad = np.flatnonzero(quality == 1), np.flatnonzero(quality == 0)
    if not len(good) or not len(bad):
        return m
    f = m.features(x)
    mean, scale = f.mean(0), np.maximum(f.std(0), 1e-3)
    f = (f - mean) / scale
    rng = np.random.default_rng(seed)
    lose = np.repeat(bad, pairs_each)
    diff = f[rng.choice(good, len(lose))] - f[lose]
    w, v = np.zeros(f.shape[1]), np.zeros(f.shape[1])
    step = 4 / max(np.square(diff).sum(1).mean(), 1e-9)
    for _ in range(rounds):
        wrong = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
        v = 0.9 * v + step * (diff.T @ wrong / len(diff) - l2 * w)
        w += v
    s = f @ w
    cut = quantile_cut(s, len(bad) / (len(good) + len(bad)))
    return Ranker(edges, mean, scale, w, cut, 1.0 / max(float(np.std(s)), 1e-9) * 4)


def quantile_cut(scores: np.ndarray, share: float) -> float:
    """The middle between the scores on either side of the quantile ``share``."""
    s = np.sort(scores)
    k = min(max(int(round(share * len(s))), 1), len(s) - 1) if len(s) > 1 else 0
    return float((s[k - 1] + s[k]) / 2) if len(s) > 1 else float(s[0])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ranker:
    """Fit on the labelled rows outside fold 0 (at most ``max_labelled`` of them)."""
    _, x, quality = labelled_statistics(docs, labels.where(fold(F.col("doc_id")) != 0), max_labelled, with_words=True)
    return fit_ranker(x, quality)


def with_score(docs: DataFrame, ranker: Ranker, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score and predicted. One row in, one row out."""
    base = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{base.schema[c].name}` {base.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([table_of(*statistics(t.as_py())) for t in b.column("text")], float).reshape(b.num_rows, -1)
            score = ranker.score(x) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=[*keep, "score", "predicted"])

    return base.mapInArrow(work, schema)


def op7_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
