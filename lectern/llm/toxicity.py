"""Toxicity: votes of the nearest labelled examples, found by an exact block-max index.

Terms are lower-cased words and their beginnings. Those that occur in enough labelled
examples, and whose share of label 1 differs from the rest beyond chance, form the
vocabulary; one more term stands for any word, so that a vector tells how dense the others
are. An example or text is its TF-IDF vector of length 1. The index holds the examples in
blocks with the highest weight of each term in a block: the sum of these over the terms of
a text bounds its cosine with every example of the block, so blocks are opened in falling
order of their bounds until none can hold a nearer example. The examples opened get exact
cosines; the nearest ones vote by distance, together with the share of label 1 in all
examples, and are returned as evidence.

Defined cases: null and empty texts have no terms, no evidence, and as score the share of
label 1 in all examples; without labels every score is 0; labels that are null are left out;
a document labelled more than once counts with its smallest label, documents with the same
id count once, with their smallest text; all examples as near as the last of the nearest
vote; repeated documents give repeated rows; a null doc_id is in no fold: it is not held out,
and cannot be labelled; of a ``keep`` column named like an output there would be two, which
raises ValueError.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lowered, materialise, table

#: A score of this or more predicts label 1.
CUT = 0.7
#: Examples are the labelled documents outside the held-out fold, this many at most: those whose hashed ids are smallest.
MAX_LABELLED = 20_000
#: A term needs this many examples, and this much chi-square between its occurrence and the label
#: (about 1e-7 by chance); of more terms than MAX_TERMS those with the highest stay.
MIN_EXAMPLES, MIN_CHI, MAX_TERMS = 5, 28.0, 4096
#: Lengths of the beginnings of words that are terms.
BEGINNINGS = (3, 4, 5, 6)
HEAD = min(BEGINNINGS)
#: Weight of a word as such, against 1 or more for each of the terms it holds.
ANY_WORD = 0.15
#: How many of the nearest examples vote, and the weight of the prior against an example at distance 1.
NEAREST, PRIOR = 15, 0.5
#: Words whose terms a worker remembers.
REMEMBERED = 200_000
#: Examples in a block of the index.
BLOCK = 256
OUTPUTS = ("score", "predicted", "evidence")

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def third(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def words_of(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(lowered(text))) if text else Counter()


def terms_of(word: str) -> list[str]:
    """The word and its beginnings; these end in a mark that no word holds."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if n < len(word))]


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: int = 7) -> DataFrame:
    """doc_id, toxic (0 or 1) and text of the examples, one row an id, ``max_labelled`` at most."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.min("toxic") == 1).cast("int").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))


def vocabulary(examples: DataFrame, n: int, positive: int, max_terms: int = MAX_TERMS) -> dict[str, tuple[int, float]]:
    """The number and the inverse document frequency of each term that is kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, toxic = Counter(), Counter()
            for text, label in zip(b.column("text"), b.column("toxic").to_pylist()):
                found = {t for w in words_of(text.as_py()) for t in terms_of(w)}
                every.update(found)
                if label == 1:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(every.values(), pa.int64()), pa.array([toxic[t] for t in every], pa.int64())], names=["term", "df", "toxic"])

    counts = examples.select("text", "toxic").mapInArrow(work, "term string, df bigint, toxic bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("toxic").alias("toxic"))
    df, toxic = F.col("df").cast("double"), F.col("toxic").cast("double")
    odds = toxic * (n - positive - df + toxic) - (df - toxic) * (positive - toxic)
    chi = F.try_divide(n * odds * odds, df * (n - df) * float(positive) * float(n - positive))
    kept = counts.where(F.col("df") >= MIN_EXAMPLES).withColumn("chi", chi).where(F.col("chi") >= MIN_CHI)
    rows = kept.orderBy(F.desc("chi"), "term").limit(max_terms).collect()
    return {r.term: (i, 1 + math.log((1 + n) / (1 + r.df))) for i, r in enumerate(rows)}


class Terms:
    """Sparse vectors over a vocabulary; the last place is any word."""

    def __init__(self, known: dict[str, tuple[int, float]]):
        self.size = len(known) + 1
        self.number = {t: i for t, (i, _) in known.items()}
        self.idf = np.array([*(v for _, v in known.values()), ANY_WORD])
        self.heads = {t.rstrip("*")[:HEAD] for t in self.number}
        self.remembered: dict[str, tuple[int, ...]] = {}

    def of_word(self, word: str) -> tuple[int, ...]:
        """Places of the terms that a word holds; those of short words are remembered, up to a bound."""
        found = self.remembered.get(word)
        if found is None:
            found = tuple(i for t in terms_of(word) if (i := self.number.get(t)) is not None)
            if len(word) <= 64:
                if len(self.remembered) >= REMEMBERED:
                    self.remembered.clear()
                self.remembered[word] = found
        return found

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(places ascending, weights) of length 1; nothing for a text without words."""
        words, found, heads = words_of(text), {}, self.heads
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        for w, n in words.items():
            if w[:HEAD] in heads:  # most words begin like no term
                for i in self.of_word(w):
                    found[i] = found.get(i, 0) + n
        found[self.size - 1] = words.total()
        place = np.array(sorted(found), np.int64)
        weight = np.array([found[i] for i in place.tolist()], float) * self.idf[place]
        return place, weight / np.sqrt(weight @ weight)


class BlockMaxIndex:
    """Examples in blocks, each with its postings by term (a row of weights a term) and the highest weight of every term."""

    def __init__(self, size: int, ids: list[int], labels: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        # examples with the same weightiest term stand together: their blocks have sharp bounds for it
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), float(vectors[i][1].max()), ids[i]))
        self.ids, self.labels = np.array([ids[i] for i in order], np.int64), np.array([labels[i] for i in order], float)
        self.starts = np.arange(0, len(order), block)
        self.highest = np.zeros((size, len(self.starts)), np.float64)
        self.row, self.postings = np.zeros((len(self.starts), size), np.int16), []
        for k, a in enumerate(self.starts):
            own = [vectors[i] for i in order[a : a + block]]
            terms = np.unique(np.concatenate([p for p, _ in own]))
            self.row[k, terms] = np.arange(1, len(terms) + 1)  # row 0 is empty
            rows = np.zeros((len(terms) + 1, len(own)))
            for j, (p, w) in enumerate(own):
                rows[self.row[k, p], j] = w
            self.postings.append(rows)
            self.highest[terms, k] = rows[1:].max(1)
        self.opened = 0

    def nearest(self, place: np.ndarray, weight: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(cosines to 12 digits, falling, and examples) of the ``k`` nearest and all that are as near as the last of them."""
        bounds = weight @ self.highest[place]
        order, at, step, least = np.argsort(-bounds, kind="stable"), 0, 4, -1.0
        cosines, examples = np.zeros(0), np.zeros(0, np.int64)
        while at < len(order):
            some = order[at : at + step]
            some = some[bounds[some] >= least - 1e-9]
            if not len(some):
                break
            new = [weight @ self.postings[b][self.row[b, place]] for b in some.tolist()]
            cosines = np.concatenate([cosines, *new])
            examples = np.concatenate([examples, *(self.starts[b] + np.arange(len(c)) for b, c in zip(some.tolist(), new))])
            if len(cosines) >= k:
                least = np.partition(cosines, len(cosines) - k)[len(cosines) - k]
                stay = cosines >= least - 1e-9
                cosines, examples = cosines[stay], examples[stay]
            self.opened += len(some)
            at, step = at + step, step * 2
        cosines = cosines.round(12)
        near = np.flatnonzero(cosines >= (np.partition(cosines, len(cosines) - k)[len(cosines) - k] if len(cosines) > k else -1.0))
        near = near[np.lexsort((self.ids[examples[near]], -cosines[near]))]
        return cosines[near], examples[near]


class Votes:
    """What the examples say of a text. ``examples``: (id, label, places, weights)."""

    def __init__(self, known: dict[str, tuple[int, float]], examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        self.terms = Terms(known)
        found = [e for e in examples if len(e[2])]
        self.prior = float(np.mean([e[1] for e in examples])) if examples else 0.0
        self.index = BlockMaxIndex(self.terms.size, [e[0] for e in found], [e[1] for e in found], [e[2:] for e in found]) if found else None
        self._plain: tuple[float, list[int]] | None = None

    def score(self, text: str | None) -> tuple[float, list[int]]:
        """The score and the ids of the nearest examples."""
        place, weight = self.terms.vector(text)
        if self.index is None or not len(place):
            return self.prior, []
        if len(place) > 1:
            return self._vote(place, weight)
        if self._plain is None:  # texts without a term of the vocabulary are all one vector
            self._plain = self._vote(place, weight)
        return self._plain

    def _vote(self, place: np.ndarray, weight: np.ndarray) -> tuple[float, list[int]]:
        cosine, at = self.index.nearest(place, weight)
        vote = 1 / (0.02 + np.sqrt(np.maximum(0, 2 - 2 * cosine)))
        return float((vote @ self.index.labels[at] + PRIOR * self.prior) / (vote.sum() + PRIOR)), self.index.ids[at[:NEAREST]].tolist()


def vectors(examples: DataFrame, known: dict[str, tuple[int, float]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The vectors of the examples, by id: MAX_LABELLED of MAX_TERMS places at most reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(known)
        for b in batches:
            found = [terms.vector(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array([p for p, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.float64()))], names=["doc_id", "toxic", "place", "weight"])

    rows = examples.mapInArrow(work, "doc_id bigint, toxic int, place array<bigint>, weight array<double>").toArrow().sort_by("doc_id")
    ids, toxic = rows["doc_id"].to_pylist(), rows["toxic"].to_pylist()
    return [(i, y, np.array(p, np.int64), np.array(w, float)) for i, y, p, w in zip(ids, toxic, rows["place"].to_pylist(), rows["weight"].to_pylist())]


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Votes:
    """The index over the labelled rows outside the held-out fold."""
    examples = materialise(labelled(docs, labels.where(third(F.col("doc_id")) != 1), max_labelled), "examples")
    n, positive = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    known = vocabulary(examples, n, positive) if 0 < positive < n else {}
    return Votes(known, vectors(examples, known))


def with_score(docs: DataFrame, votes: Votes, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score, predicted and evidence (ids of the nearest examples). One row in, one row out."""
    keep = keep or ("doc_id",)
    if {c.lower() for c in keep} & set(OUTPUTS):
        raise ValueError(f"columns to keep may not be named {', '.join(OUTPUTS)}")
    base = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{base.schema[c].name}` {base.schema[c].dataType.simpleString()}" for c in keep) + ", score double, predicted int, evidence array<bigint>"
    shared = base.sparkSession.sparkContext.broadcast(votes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            found = [own.score(t.as_py()) for t in b.column("text")]
            score = np.array([s for s, _ in found], float)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(score), pa.array((score >= CUT).astype(np.int32)), pa.array([e for _, e in found], pa.list_(pa.int64()))], names=[*keep, *OUTPUTS])

    return base.mapInArrow(work, schema)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs, train(docs, table(spark, sf_dir, "labels")), "doc_id")
    return scored.select("doc_id", F.coalesce(third(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
