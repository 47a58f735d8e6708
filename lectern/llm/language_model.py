"""Scores of whole documents under word frequencies and under a recurrent language model.

Word counts cover all training documents. The NUMBERED most frequent words (a bounded
table) are known to every task; words beyond it are few, and their counts come by a join.
Texts are split once for the counts and once to be written as numbers, from which the model
is trained and all documents are scored in full. The recurrent model starts from a bounded
sample of documents on the driver; then every partition goes on from there with all of its
own training documents, and the weights are averaged by tokens, level by level.

The weights follow from how the table is split into partitions: another split gives other
scores, within what averaging over another split changes.

Defined cases: a null text is empty and has one token, the end; a null doc_id is training
text; without training tokens both scores are the base's; repeated documents give repeated
rows, and count as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, fold, lowered, materialise, table
from .gru import Layout, Trainer, score, start_weights

_WORD = re.compile(WORD)
#: The end of a text; no word can be this.
END = "\n"
#: Words with numbers, known to every task; those that occur once have none, and teach the model what unknown words do.
NUMBERED = 262_144
#: Documents of at most START_TOKENS tokens from which the driver starts the model by at least START_STEPS steps (if it
#: has any), before partitions train on all.
START_DOCS, START_TOKENS, START_STEPS, START_LANES = 1_024, 4_096, 400, 64
#: Tokens in one round of a partition's training, and weights averaged in one group.
ROUND_TOKENS, FAN_IN = 1_000_000, 32
_RATES = (0.01, 0.005)


def tokens(text: str | None) -> list[str]:
    return [*_WORD.findall(lowered(text)), END] if text else [END]


def held_out() -> Column:
    return F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, end to end, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten()
    word = pc.not_equal(found, "")  # white space at either end leaves an empty one
    n = np.add.reduceat(np.append(word.to_numpy(zero_copy_only=False), False).astype(np.int64), lists.offsets.to_numpy()[:-1]) if len(lists) else np.zeros(0, np.int64)
    return found.filter(word), np.where(lists.value_lengths().to_numpy() > 0, n, 0)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents given; tasks add up each batch before it is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, _ = words_of(b.column("text"))
            words, n = words.value_counts().flatten()
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.array(np.append(n.to_numpy(), b.num_rows))], names=["word", "n"])

    return docs.select("text").mapInArrow(work, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """Word to number, by falling count; any other word is -1."""

    def __init__(self, words: list[str], counts: np.ndarray, total: int, distinct: int):
        super().__init__(zip(words, range(len(words))))
        self.counts, self.total, self.distinct = counts, total, distinct
        self.layout = Layout(counts, total - int(counts.sum()))
        self.base = np.log10((np.append(counts, 0) + 0.5) / (total + 0.5 * (distinct + 1)))

    def __missing__(self, word: str) -> int:
        return -1

    def ids(self, text: str | None) -> tuple[list[str], np.ndarray]:
        words = tokens(text)
        return words, np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def numbered(self, words: pa.Array) -> np.ndarray:
        """The numbers of many words."""
        if not hasattr(self, "known"):
            self.known = pa.array(list(self), pa.string())
        return pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy(zero_copy_only=False)


_vocabularies: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """A worker makes the vocabulary of a broadcast once."""
    value = shared.value
    if id(value) not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[id(value)] = Vocabulary(*value)
    return _vocabularies[id(value)]


def _pack(w: dict[str, np.ndarray], weight: float) -> bytes:
    return np.concatenate([np.array([weight], np.float32), *(w[k].reshape(-1) for k in sorted(w))]).astype(np.float32).tobytes()


def _unpack(blob: bytes, like: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], float]:
    flat, at, out = np.frombuffer(blob, np.float32), 1, {}
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out, float(flat[0])


def _average(blobs: list[bytes]) -> bytes:
    """The mean by weight of packed weights, with the sum of the weights."""
    rows = [np.frombuffer(b, np.float32) for b in blobs]
    total = sum(float(r[0]) for r in rows)
    mean = sum(r[1:] * (float(r[0]) / total) for r in rows)
    return np.concatenate([[total], mean]).astype(np.float32).tobytes()


def _start(docs: DataFrame, vocabulary: Vocabulary, seed: int = 7) -> dict[str, np.ndarray]:
    """Train on the START_DOCS documents with the smallest hashed ids, of those with the same id on the greatest; ``docs`` has texts,
    or the ids of their words. START_DOCS rows at most reach the driver."""
    given = "ids" in docs.columns
    some = docs.where(F.col("doc_id").isNotNull() & (F.size("ids") <= START_TOKENS if given else F.lit(True)))
    first = {r.doc_id for r in some.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(START_DOCS).collect()}
    what = F.max("ids" if given else "text").alias("own")
    rows = some.where(F.col("doc_id").isin(first)).groupBy("doc_id").agg(what).toArrow().to_pylist() if first else []
    one = {r["doc_id"]: np.array(r["own"]) if given else vocabulary.ids(r["own"])[1] for r in sorted(rows, key=lambda r: r["doc_id"])}
    t = Trainer(start_weights(vocabulary.layout), vocabulary.layout, _RATES[0])
    while one and t.steps < START_STEPS:
        t.epoch(list(one.values()), vocabulary[END], START_LANES)
    return t.w


def numbered(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, held_out, ids, rare): the numbers of a text's words and its end (-1: none), and the words without one."""
    base = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = base.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for b in batches:
            words, n = words_of(b.column("text"))
            ids, ends = v.numbered(words), np.cumsum(n)
            far = np.flatnonzero(ids < 0)
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(far, np.append(0, ends)).astype(np.int32)), words.take(pa.array(far)))
            whole = pa.ListArray.from_arrays(pa.array(np.append(0, ends + np.arange(1, len(n) + 1)).astype(np.int32)), pa.array(np.insert(ids, ends, v[END]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), whole, rare], names=["doc_id", "held_out", "ids", "rare"])

    return base.mapInArrow(work, f"doc_id {kind}, held_out boolean, ids array<int>, rare array<string>")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    return np.split(column.values.to_numpy()[: at[-1]], at[1:-1]) if at[0] == 0 else np.split(column.flatten().to_numpy(), (at - at[0])[1:-1])


def train(docs: DataFrame, shared, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The model's weights, from all of ``docs``: their texts, or the ids of their words. ``shared``: the broadcast
    that ``vocabulary`` was made from."""
    spark = docs.sparkSession
    first = _start(docs, vocabulary)
    begin = spark.sparkContext.broadcast(first)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, done, held, size = _vocabulary(shared), 0, [], 0
        t = Trainer(begin.value, v.layout, _RATES[1])
        for b in batches:
            for d in _lists(b.column("ids")):
                held.append(d)
                size += len(d)
                if size >= ROUND_TOKENS:
                    t.epoch(held, v[END])
                    done, held, size = done + size, [], 0
        if held:
            t.epoch(held, v[END])
            done += size
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([_pack(t.w, done)], pa.binary())], names=["weights"])

    ids = docs if "ids" in docs.columns else numbered(docs, shared)
    blobs = materialise(ids.select("ids").mapInArrow(work, "weights binary"), "weights")
    while (n := blobs.count()) > FAN_IN:
        groups = -(-n // FAN_IN)
        placed = blobs.withColumn("g", F.pmod(F.xxhash64("weights"), F.lit(groups)))
        joined = placed.groupBy("g").applyInArrow(lambda t: pa.table({"weights": pa.array([_average(t.column("weights").to_pylist())], pa.binary())}), "weights binary")
        blobs = materialise(joined, "weights")
    found = sorted(r.weights for r in blobs.collect())
    return _unpack(_average(list(map(bytes, found))), first)[0] if found else first


def model_scores(docs: DataFrame, most: int = NUMBERED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    counts = materialise(word_counts(docs.where(~held_out())), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("n") > 1).orderBy(F.desc("n"), "word").limit(most).toArrow()
    words, n = top.column("word").to_pylist(), top.column("n").to_numpy()
    if total and END not in words:  # one document, or very many words more frequent than ends
        keep = min(len(words), most - 1)
        words, n = [*words[:keep], END], np.append(n[:keep], counts.where(F.col("word") == END).first()["n"])
    value = (words, n, int(total), int(distinct))
    shared, vocabulary = spark.sparkContext.broadcast(value), Vocabulary(*value)
    every = materialise(numbered(docs, shared).withColumn("row", F.monotonically_increasing_id()), "numbered")  # rows keep these numbers from here on
    weights = spark.sparkContext.broadcast(train(every.where("not held_out"), shared, vocabulary) if total else None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = _vocabulary(shared), weights.value
        for b in batches:
            ids = _lists(b.column("ids"))
            known = [i[i >= 0] for i in ids]
            model = score(w, v.layout, ids) if w is not None and ids else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("row", "doc_id", "held_out")), pa.array([len(i) for i in ids], pa.int64()), pa.array([len(i) for i in known], pa.int64()), pa.array([float(v.base[i].sum()) for i in known], pa.float64()), pa.array(model, pa.float64())],
                names=["row", "doc_id", "held_out", "n_tokens", "n_numbered", "plain", "model"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = every.select("row", "doc_id", "held_out", "ids").mapInArrow(work, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_numbered bigint, plain double, model double")
    rest, rest_distinct = int(total) - int(n.sum()), int(distinct) - len(words)
    in_all, in_rest = math.log10(total + 0.5 * (distinct + 1)), math.log10(rest + 0.5 * (rest_distinct + 1))
    each = every.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    c = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    far = each.groupBy("row").agg(F.count("n").alias("far_known"), F.sum(c - in_all).alias("far_plain"), F.sum(c - in_rest).alias("far_model"))
    out = scored.join(far, "row", "left").na.fill(0, ["far_known", "far_plain", "far_model"])
    base_score = F.col("plain") + F.col("far_plain")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_numbered") + F.col("far_known")).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        base_score.alias("base_score"), (F.col("model") + F.col("far_model") if total else base_score).alias("score"),
    )


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
