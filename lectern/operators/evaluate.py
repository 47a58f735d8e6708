"""Evaluation: histograms, greedy box matching, precision and recall, text agreement."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import kept_in_turn

#: Common runs from which arrays are faster than lists, and pairs of equal tokens (in one pair of texts) up to which runs are kept.
MANY_RUNS, MOST_PAIRS = 200, 2_000_000


def type_histogram(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per document and type how many blocks either side has, and whether the documents' types agree in order."""
    one = left.select("doc_id", "ord", F.col("type").alias("l_type")).join(right.select("doc_id", "ord", F.col("type").alias("r_type")), ["doc_id", "ord"], "full")
    same = one.groupBy("doc_id").agg(F.bool_and(F.col("l_type").eqNullSafe(F.col("r_type"))).alias("order_exact"))
    n = one.select("doc_id", F.explode(F.array(F.struct(F.col("l_type").alias("type"), F.lit(1).alias("l"), F.lit(0).alias("r")), F.struct(F.col("r_type").alias("type"), F.lit(0).alias("l"), F.lit(1).alias("r")))).alias("x"))
    n = n.where("x.type is not null").groupBy("doc_id", F.col("x.type").alias("type")).agg(F.sum("x.l").alias("n_left"), F.sum("x.r").alias("n_right"))
    return n.join(same, "doc_id")


def greedy_matches(oracle: DataFrame, candidate: DataFrame, least: float = 0.25) -> DataFrame:
    """One-to-one matches per (doc_id, page, type) by falling overlap (of equals the later oracle box, then the later
    candidate). Only pairs that overlap enough are made, by a join within the page; the order-dependent picking passes
    over sorted rows and holds one page's picks."""
    from ..functions import geometry as g

    keys = ["doc_id", "page", "type"]
    a = oracle.select(*keys, F.col("ord").alias("a"), F.col("box").alias("a_box"))
    b = candidate.select(*keys, F.col("ord").alias("b"), F.col("box").alias("b_box"))
    pairs = a.join(b, keys).withColumn("overlap", g.iou(F.col("a_box"), F.col("b_box"))).where(F.col("overlap") >= least).select(*keys, "a", "b", "overlap")

    def start() -> Callable[[tuple], bool]:
        seen_a, seen_b = set(), set()

        def take(row: tuple) -> bool:
            free = row[0] not in seen_a and row[1] not in seen_b
            if free:
                seen_a.add(row[0])
                seen_b.add(row[1])
            return free

        return take

    return kept_in_turn(pairs, keys, [F.desc("overlap"), F.desc("a"), F.desc("b")], ["a", "b"], start)


def rate(hits: Column, total: Column, other: Column) -> Column:
    """hits / total; of nothing it is 1 if the other side has nothing either, else 0."""
    return F.when(total > 0, hits / total).when(other == 0, 1.0).otherwise(0.0)


def match_scores(oracle: DataFrame, candidate: DataFrame, matches: DataFrame) -> DataFrame:
    """Per type: boxes on both sides, matches, precision, recall and F1 (4 digits)."""
    n = lambda df, name: df.groupBy("type").agg(F.count("*").alias(name))
    x = n(oracle, "n_oracle").join(n(candidate, "n_candidate"), "type", "full").join(n(matches, "matched"), "type", "left").na.fill(0, ["n_oracle", "n_candidate", "matched"])
    m, o, c = F.col("matched"), F.col("n_oracle"), F.col("n_candidate")
    p, r = rate(m, c, o), rate(m, o, c)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return x.select("type", "n_oracle", "n_candidate", "matched", F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(f1, 4).alias("f1"))


#: The tokens of one list that are in the other one too: a place in the list, and the places in the other.
Held = list[tuple[int, list[int]]]


def _common_runs(held: Held) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in both lists and lengths of the runs that both have and that reach as far as they can to both sides."""
    i = np.repeat([i for i, _ in held], [len(x) for _, x in held])
    j = np.concatenate([np.array(x, np.int64) for _, x in held])
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1)))
    return i[first], j[first], np.diff(np.append(first, len(i)))


def _few_common_runs(held: Held) -> list[tuple[int, int, int]]:
    out, begun, end = [], {}, 0
    for i, places in held:
        if i != end:
            out += [(start, start + k, end - start) for k, start in begun.items()]
            begun = {}
        end = i + 1
        now = {j - i: begun.pop(j - i, i) for j in places}
        out += [(start, start + k, i - start) for k, start in begun.items()]
        begun = now
    return out + [(start, start + k, end - start) for k, start in begun.items()]


def _matched_few(runs: list[tuple[int, int, int]]) -> int:
    todo, total = [runs], 0
    while todo:
        runs = todo.pop()
        if len(runs) == 1:
            total += runs[0][2]
            continue
        bi, bj, m = min(runs, key=lambda r: (-r[2], r[0], r[1]))
        total += m
        ei, ej, left, right = bi + m, bj + m, [], []
        for i, j, n in runs:
            k = min(n, bi - i, bj - j)
            if k > 0:
                left.append((i, j, k))
            k = max(0, ei - i, ej - j)
            if k < n:
                right.append((i + k, j + k, n - k))
        todo += [x for x in (left, right) if x]
    return total


def _matched_many(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> int:
    todo, total = [(i, j, n)], 0
    while todo:
        i, j, n = todo.pop()
        if len(n) < MANY_RUNS:
            total += _matched_few(list(zip(i.tolist(), j.tolist(), n.tolist()))) if len(n) else 0
            continue
        longest = np.flatnonzero(n == n.max())
        k = longest[np.lexsort((j[longest], i[longest]))[0]]
        bi, bj, m = i[k], j[k], n[k]
        total += int(m)
        short = np.minimum(n, np.minimum(bi - i, bj - j))
        skip = np.maximum(0, np.maximum(bi + m - i, bj + m - j))
        left, right = short > 0, n > skip
        todo += [(i[left], j[left], short[left]), ((i + skip)[right], (j + skip)[right], (n - skip)[right])]
    return total


def sequence_ratio(a: list[str], b: list[str]) -> float:
    """What difflib's SequenceMatcher (without autojunk) gives as ratio. The longest common run comes first (of equals the first in ``a``,
    then in ``b``), then the longest ones before and behind it: the runs are found once and cut to what is left on either side. Where
    tokens repeat so often that the pairs of equal ones would not fit, the matcher itself goes over the lists."""
    if not a and not b:
        return 1.0
    common = set(a).intersection(b)
    if not common:
        return 0.0
    at: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        if t in common:
            at.setdefault(t, []).append(j)
    held = [(i, at[t]) for i, t in enumerate(a) if t in common]
    pairs = sum(len(x) for _, x in held)
    if pairs > MOST_PAIRS:
        return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
    total = _matched_few(_few_common_runs(held)) if pairs < MANY_RUNS else _matched_many(*_common_runs(held))
    return 2.0 * total / (len(a) + len(b))


def text_agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``pairs`` with agreement: the sequence-matcher ratio of their lower-case [a-z0-9]+ tokens, 6 digits."""
    token = re.compile("[a-z0-9]+")

    @F.pandas_udf("double")
    def agreement(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(sequence_ratio(token.findall((a or "").lower()), token.findall((b or "").lower())), 6) for a, b in zip(x, y)], dtype="float64")

    return pairs.withColumn("agreement", agreement(left, right))
