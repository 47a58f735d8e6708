"""Quality rules: an ordered decision list learned by sequential covering.

Rules are grown condition by condition (information gain on two thirds of the labelled
rows), pruned backwards on the last third, and emitted as an ordered chain of Spark
conditional expressions over the statistics of a text.

Defined cases: a null or empty text has no words and fails the base; labels that are null
are left out; a document labelled more than once counts with its smallest label; without
labels of both kinds no rule is learned, and only the base decides; repeated documents give
repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textstats import RATIOS, with_statistics

#: The learner looks at this many labelled documents at most: those whose hashed ids are smallest.
MAX_LABELLED = 20_000


@dataclass(frozen=True)
class Condition:
    column: str
    above: bool  # column > value, else column <= value
    value: float

    def column_expr(self) -> Column:
        c = F.col(self.column)
        return c > F.lit(self.value) if self.above else c <= F.lit(self.value)

    def mask(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        v = x[:, names.index(self.column)]
        return v > self.value if self.above else v <= self.value


@dataclass(frozen=True)
class Rule:
    """A conjunction; texts that meet it are rejected."""

    conditions: tuple[Condition, ...]

    def column_expr(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column_expr()
        return out

    def mask(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for c in self.conditions:
            out &= c.mask(x, names)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.column} {'>' if c.above else '<='} {c.value:.6g}" for c in self.conditions)


def _best_condition(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], without: frozenset[str] = frozenset()) -> tuple[float, Condition | None]:
    """The threshold with the highest gain p1 * (log(p1 / (p1 + n1)) - log(p / (p + n)))."""
    p0, n0 = y.sum(), (~y).sum()
    base, best, found = np.log2(p0 / (p0 + n0)), 0.0, None
    for j, name in enumerate(names):
        if name in without:
            continue
        order = np.argsort(x[:, j], kind="stable")
        v, hit = x[order, j], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])  # between a row and the next one
        if not len(cuts):
            continue
        p, n = np.cumsum(hit)[cuts], np.cumsum(~hit)[cuts]
        for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
            gain = np.where(pp > 0, pp * (np.log2(np.maximum(pp, 1e-9) / np.maximum(pp + nn, 1e-9)) - base), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best + 1e-9:
                best, found = float(gain[k]), Condition(name, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best, found


def _grow(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], max_conditions: int, without: frozenset[str] = frozenset()) -> Rule:
    rule, live = (), np.ones(len(x), bool)
    while len(rule) < max_conditions and (~y[live]).any() and y[live].any():
        gain, c = _best_condition(x[live], y[live], names, without)
        if c is None:
            break
        rule += (c,)
        live &= c.mask(x, names)
    return Rule(rule)


def _worth(rule: Rule, x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> float:
    hit = rule.mask(x, names)
    p, n = (hit & y).sum(), (hit & ~y).sum()
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> Rule:
    """The prefix of the conjunction that is worth most on the pruning rows; the shortest of equals."""
    prefixes = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
    return max(prefixes, key=lambda r: (_worth(r, x, y, names), -len(r.conditions)), default=rule)


def learn_rules(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = RATIOS, *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 3, seed: int = 7) -> list[Rule]:
    """Sequential covering. ``x`` holds a row of statistics per document,
    ``bad`` those to reject. A rule is kept if it is right for ``min_precision`` of the growing and of the pruning rows it
    covers; if not, another is grown without the statistic that it began with."""
    bad, rules, without = bad.astype(bool), [], frozenset()
    part = np.random.default_rng(seed).permutation(len(x)) % 3
    live = np.ones(len(x), bool)
    while len(rules) < max_rules:
        g, h = live & (part != 0), live & (part == 0)
        if not bad[g].any() or not (~bad[g]).any():
            break
        grown = _grow(x[g], bad[g], names, max_conditions, without)
        if not grown.conditions:
            break
        rule = _prune(grown, x[h], bad[h], names)
        hit = rule.mask(x, names) & live
        right, held = bad[hit & (part != 0)], bad[hit & (part == 0)]
        if hit.sum() < min_cover or not len(right) or right.mean() < min_precision or (len(held) and held.mean() < min_precision):
            without |= {grown.conditions[0].column}
            continue
        rules.append(rule)
        live &= ~hit
        without = frozenset()
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The ordered chain: the first rule that fires gives its number, 0 means that none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column_expr(), k) if out is None else out.when(rule.column_expr(), k)
    return (F.lit(0) if out is None else out.otherwise(0)).cast("int")


def labelled_sample(labels: DataFrame, max_rows: int = MAX_LABELLED, seed: int = 7) -> DataFrame:
    """(doc_id, quality) of ``max_rows`` documents at most: those with the smallest hashed ids."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_rows)


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED, *, with_words: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, RATIOS (and the number of words) and quality of the labelled sample, in order of
    doc_id; ``max_rows`` rows at most reach the driver. Of documents with the same id the smallest statistics count."""
    sample, names = labelled_sample(labels, max_rows), [*RATIOS, *["n_words"] * with_words]
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    least = with_statistics(joined, "doc_id", "quality").groupBy("doc_id", "quality").agg(F.min(F.struct(*names)).alias("s"))
    rows = least.select("doc_id", "quality", "s.*").toArrow().to_pandas().sort_values("doc_id")
    return rows["doc_id"].to_numpy(), rows[names].to_numpy(float).reshape(len(rows), len(names)), rows["quality"].to_numpy()


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def apply_rules(docs: DataFrame, rules: list[Rule], *keep: str) -> DataFrame:
    """Statistics of every document with base_failed, the number of the rule that fired, and kept."""
    stats = with_statistics(docs, *keep)
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def quality_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Learn the decision list from the labelled sample and apply it to all documents."""
    _, x, quality = labelled_statistics(docs, labels, max_labelled)
    return apply_rules(docs, learn_rules(x, quality == 0))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
