"""Ranked lexical search: a blocked sparse matrix product with 64-bit integer impacts.

Items are the rows of one sparse matrix (how often an item holds a term), the terms of
documents those of the other (the impact of a term in a document). Their product is formed
block by block: for each item the rows of its terms are merged into one row of sums over a
block of documents, of which the highest stay, per block, per task, then over all.

The items are taken in blocks of bounded size. For a block, one pass over the documents
writes how often each of the block's terms occurs (and the number of all terms), from which
document frequencies are counted and scores are formed.

Defined cases: null and empty texts have no terms and are no documents to N and L; items
without terms have no results; a repeated document is ranked as often as it occurs, a
repeated item has its results as often; equal scores stand by ascending doc_id, null last;
a null item_id keeps its results; empty tables give no results; other columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lowered, materialise, table

#: Runs of letters, digits and anything outside ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 10
#: Bounds of a block of items.
BLOCK_ITEMS, BLOCK_CHARS = 10_000, 4_000_000
#: The first step of the last reduction deals the tasks' results of one item to so many groups.
GROUPS = 64


def terms_of(text: str | None) -> list[str]:
    return TERM.findall(lowered(text)) if text else []


@dataclass(frozen=True)
class Items:
    """A block of items as a sparse matrix by rows, and the number of each of its terms."""

    ids: list
    start: np.ndarray
    term: np.ndarray
    times: np.ndarray
    vocabulary: dict[str, int]


def items_of(rows: list[tuple[object, str | None]], once: bool = True) -> Items:
    vocabulary: dict[str, int] = {}
    start, term, times = [0], [], []
    for _, text in rows:
        found = Counter(terms_of(text))
        term += [vocabulary.setdefault(t, len(vocabulary)) for t in found]
        times += [1] * len(found) if once else found.values()
        start.append(len(term))
    return Items([i for i, _ in rows], np.array(start), np.array(term, np.int64), np.array(times, np.int64), vocabulary)


def blocks_of(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for r in items.select("item_id", "text").where("text is not null").toLocalIterator():
        if block and (size + len(r.text) > BLOCK_CHARS or len(block) == BLOCK_ITEMS):
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, n (terms with repeats), the numbers of the vocabulary's terms found and how often; documents without terms are left out."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    base = docs.select("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for b in batches:
            keep, n, start, term, tf = [], [], [0], [], []
            for row, text in enumerate(b.column("text")):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                keep.append(row)
                n.append(len(words))
                term += found
                tf += found.values()
                start.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(v, t)) for v, t in ((term, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return base.mapInArrow(work, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n bigint, term array<int>, tf array<bigint>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The impact of each (document, term) of a block; ``n`` holds the terms of each of its documents."""
    wide = len(n) and 90 * int(n.max()) * n_docs > np.iinfo(np.int64).max
    m = 10 + (np.array([90 * int(x) * n_docs // n_terms for x in n], np.int64) if wide else 90 * n * n_docs // max(n_terms, 1))
    return weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))


def merged(items: Items, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, scores of the block's documents): for each item the rows of its terms, times how often it
    holds them, are added up. A row holds a document once."""
    order = np.argsort(term, kind="stable")
    doc, impact = doc[order], impact[order]
    begin = np.searchsorted(term[order], np.arange(len(items.vocabulary) + 1))
    lo, hi = begin[items.term], begin[items.term + 1]
    scores = np.zeros(n_docs, np.int64)
    for i in range(len(items.ids)):
        scores[:] = 0
        own = slice(items.start[i], items.start[i + 1])
        for a, b, times in zip(lo[own].tolist(), hi[own].tolist(), items.times[own].tolist()):
            if a < b:
                scores[doc[a:b]] += impact[a:b] * times
        yield i, scores


def best(score: np.ndarray, missing: np.ndarray, doc_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by score (highest), then doc_id (ascending, missing last)."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((doc_id[at], missing[at], -score[at]))[:k]]


def top_of_tasks(counts: DataFrame, items: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in the block), doc_id and score of the ``k`` best of each task, a block of documents a batch."""
    shared = counts.sparkSession.sparkContext.broadcast((items, weights))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = shared.value
        empty = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        found = [empty] * len(own.ids)
        for b in batches:
            ids = b.column("doc_id")
            missing, doc_id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).cast(pa.int64()).to_numpy()
            n, lists = b.column("n").to_numpy(), b.column("term")
            doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            term, tf = lists.flatten().to_numpy(), b.column("tf").flatten().to_numpy()
            impact = impacts(n, doc, term, tf, w, n_docs, n_terms)
            for i, scores in merged(own, b.num_rows, doc, term, impact):
                had = found[i]
                at = np.flatnonzero(scores >= max(1, had[0][-1])) if len(had[0]) == k else np.flatnonzero(scores)
                if len(at):
                    all_of = tuple(np.concatenate(x) for x in zip(had, (scores[at], missing[at], doc_id[at])))
                    stay = best(*all_of, k)
                    found[i] = tuple(x[stay] for x in all_of)
        item = np.repeat(np.arange(len(found), dtype=np.int32), [len(f[0]) for f in found])
        if len(item):
            score, missing, doc_id = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=missing), pa.array(score)], names=["item", "doc_id", "score"])

    return counts.mapInArrow(work, "item int, doc_id bigint, score bigint")


def first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, rows: list[tuple[object, str]], id_type: str, k: int, once: bool) -> DataFrame:
    spark, items = docs.sparkSession, items_of(rows, once)
    counts = materialise(term_counts(docs, items.vocabulary), "terms")
    n_docs, n_terms = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(items.vocabulary), np.int64)
    found = counts.select(F.explode("term").alias("term")).groupBy("term").count().toArrow()
    df[found["term"].to_numpy()] = found["count"].to_numpy()
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    found = top_of_tasks(counts, items, weights, n_docs, n_terms, k)
    found = first(found.withColumn("group", F.spark_partition_id() % GROUPS), k, "item", "group")
    ids = spark.createDataFrame([(i, v) for i, v in enumerate(items.ids)], f"item int, item_id {id_type}")
    return first(found.select("item", "doc_id", "score"), k, "item").join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, *, once: bool = True) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of each item. ``once``: an item's
    repeated terms count once. With more than one block of items, each block's results are written."""
    id_type, found = items.schema["item_id"].dataType.simpleString(), []
    blocks = blocks_of(items)
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        part = search_block(docs, block, id_type, k, once)
        found.append(materialise(part, "ranked") if found or after else part)
        block = after
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionAll, found)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT count(*) AS n_docs, cast(sum(len(t)) AS bigint) AS n_terms FROM d WHERE len(t) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY r, term),
w AS (SELECT term, cast(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS bigint) AS w FROM tf, total GROUP BY term),
impact AS (
  SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * len(t) * n_docs) // n_terms)))) AS impact
  FROM tf JOIN w USING (term) JOIN d USING (r), total
), scored AS (
  SELECT q, item_id, r, cast(sum(impact) AS bigint) AS score FROM i JOIN impact USING (term) GROUP BY q, item_id, r
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored JOIN d USING (r) WHERE score > 0
)
SELECT item_id, cast(rank AS int) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
