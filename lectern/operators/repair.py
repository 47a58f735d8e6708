"""Repair of what failed: which chunks a repair may look at, and rounds of repair until nothing is left or nothing changes.

Defined cases: a chunk id that stands twice in a document counts once, in its first place;
null texts hold no terms; documents with a null id have no scope; a document without review items is accepted before the first
round; answers to items that were not asked for change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from ..sources.stage import in_turn

#: Words of review messages that say nothing of the text, the score of a chunk that is named, and the bounds of a scope.
IGNORED = ("field", "required", "review", "uncertain", "invalid", "abstained", "schema")
DIRECT, MOST_CHUNKS, MOST_CHARACTERS, ROUNDS = 100, 8, 12_000, 2


def query_terms(texts: Column) -> Column:
    """The distinct words (of a-z and 0-9, three letters or more) of an array of messages, without those that all messages have."""
    words = F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(F.replace(casefold(t), F.lit("_"), F.lit(" ")), F.lit("[a-z0-9]+"), 0)))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*IGNORED)))


def chunk_scores(chunks: DataFrame, items: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, page, chunk_ord, chunk_id, size, score) of the chunks of documents with review items: 100 if a named block or chunk is in
    it, and how often each term of the items' messages occurs in its text. ``chunks``: doc_id, page, chunk_ord, chunk_id, block_ids,
    text, markdown; ``items``: message; ``named``: doc_id and block_id or chunk_id. A document's terms pass before its chunks through
    one task, which looks for all of them at once: the time goes by the length of texts, not by that times the number of terms."""
    asked = items.groupBy("doc_id").agg(query_terms(F.collect_set("message")).alias("terms"))
    known = named.groupBy("doc_id").agg(F.collect_set("block_id").alias("block_ids"), F.collect_set("chunk_id").alias("chunk_ids"))
    size = F.length(F.coalesce(F.nullif("markdown", F.lit("")), F.col("text"), F.lit("")))
    rows = chunks.select("doc_id", "page", "chunk_ord", "chunk_id", size.cast("bigint").alias("size"), "block_ids", casefold(F.coalesce("text", F.lit(""))).alias("text"), F.lit(1).alias("kind"))
    rows = asked.join(known, "doc_id", "left").withColumn("kind", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    names = ["doc_id", "page", "chunk_ord", "chunk_id", "size"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, finder, blocks, ids = object(), None, frozenset(), frozenset()
        for b in batches:
            stay, scores = [], []
            for i, (own, kind, terms, held, chunk_ids, chunk, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "kind", "terms", "block_ids", "chunk_ids", "chunk_id", "text")))):
                if kind == 0:
                    doc, finder, blocks, ids = own, _finder(terms), frozenset(held or ()), frozenset(chunk_ids or ())
                elif own == doc and finder is not None:
                    named_here = chunk in ids or not blocks.isdisjoint(held or ())
                    stay.append(i)
                    scores.append(DIRECT * named_here + _occurrences(finder, text))
            kept = b.take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(scores, pa.int64())], names=[*names, "score"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names) + ", score bigint"
    return in_turn(rows.where("doc_id is not null"), ["doc_id"], "kind").mapInArrow(count, schema)


def _finder(terms: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for t in terms:
        out.add_word(t, t)
    if terms:
        out.make_automaton()
    return out


def _occurrences(finder: ahocorasick.Automaton, text: str) -> int:
    """How often the terms occur, those of one term without overlaps."""
    n, reach = 0, {}
    for end, term in finder.iter(text) if len(finder) else ():
        if end - len(term) >= reach.get(term, -1):
            n, reach[term] = n + 1, end
    return n


def repair_scope(scored: DataFrame, most_chunks: int = MOST_CHUNKS, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """(doc_id, page, chunk_id, score, place): the chunks of a document that a repair looks at, by score (highest), page and order: those
    with a score, while they fit; one that does not fit is passed over, but the first is always taken. Only sizes and ids pass, in
    order, through the task of their document, which keeps the ids taken."""
    x = scored.where("score > 0").select("doc_id", "page", "chunk_ord", "chunk_id", "score", "size")
    names = ["doc_id", "page", "chunk_id", "score"]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, taken, used = object(), set(), 0
        for b in batches:
            stay, place = [], []
            for i, (own, chunk, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "chunk_id", "size")))):
                if own != doc:
                    doc, taken, used = own, set(), 0
                if len(taken) == most_chunks or chunk in taken or (taken and used + n > most_characters):
                    continue
                taken.add(chunk)
                used += n
                stay.append(i)
                place.append(len(taken))
            kept = b.take(pa.array(stay, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(place, pa.int32())], names=[*names, "place"])

    schema = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for c in names) + ", place int"
    return in_turn(x, ["doc_id"], F.desc("score"), "page", "chunk_ord", "chunk_id").mapInArrow(fill, schema)


def retryable(items: DataFrame) -> DataFrame:
    """Items that a repair may ask about: marked so, no checkbox, and with sources."""
    return items.where("retryable and stage <> 'checkbox' and size(source_ids) > 0")


def repair_rounds(
    documents: DataFrame, items: DataFrame, answers: DataFrame, rounds: int = ROUNDS, *, in_scope: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame, int], DataFrame] = lambda x, _: x
) -> tuple[DataFrame, DataFrame]:
    """(ends, items left): how the repair of each document ended, and its review items then.

    In a round, the documents with items that may be asked about (and, with ``in_scope``, a scope for them) get the recorded
    ``answers`` (doc_id, round, item_id, outcome, message): "resolved" takes an item away, "changed" gives it another message. A
    document ends as "accepted" without items, else as "unchanged" if a round left its items as they were (nothing retryable
    among the reasons), else after the last round as "exhausted". ends: doc_id, rounds (those that asked), state, reason.
    ``keep(state, round)`` may write a round's state and return it reread; without it rounds are one plan."""
    live = items.select("doc_id", "item_id", "stage", "message", "retryable", "source_ids")
    count = live.groupBy("doc_id").agg(F.count("*").alias("n"))
    ends = documents.select("doc_id").distinct().join(count, "doc_id", "left").select("doc_id", F.lit(0).alias("rounds"), F.when(F.col("n").isNull(), "accepted").alias("reason"))
    for r in range(1, rounds + 1):
        open_docs = ends.where("reason is null").select("doc_id")
        ask = retryable(live).join(open_docs, "doc_id", "left_semi")
        if in_scope is not None:
            ask = ask.join(in_scope(ask).select("doc_id").distinct(), "doc_id", "left_semi")
        told = answers.where(F.col("round") == r).join(ask.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi").select("doc_id", "item_id", "outcome", F.col("message").alias("new_message"))
        x = live.join(told, ["doc_id", "item_id"], "left")
        moved = x.where((F.col("outcome") == "resolved") | ((F.col("outcome") == "changed") & ~F.col("new_message").eqNullSafe(F.col("message")))).select("doc_id").distinct().withColumn("moved", F.lit(True))
        asked = ask.select("doc_id").distinct().withColumn("asked", F.lit(1))
        after = x.where("outcome is null or outcome <> 'resolved'").withColumn("message", F.when(F.col("outcome") == "changed", F.col("new_message")).otherwise(F.col("message"))).select(*live.columns)
        left = after.groupBy("doc_id").agg(F.count("*").alias("n"))
        y = ends.join(asked, "doc_id", "left").join(moved, "doc_id", "left").join(left, "doc_id", "left")
        reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("n").isNull(), "accepted").when(F.col("asked").isNull(), "nothing_retryable").when(F.col("moved").isNull(), "unchanged")
        state = y.select("doc_id", (F.col("rounds") + F.coalesce("asked", F.lit(0))).alias("rounds"), reason.alias("reason"))
        live, ends = keep(after, r), keep(state, r)
    done = ends.withColumn("reason", F.coalesce("reason", F.lit("exhausted")))
    return done.select("doc_id", "rounds", F.when(F.col("reason") == "accepted", "ACCEPTED").otherwise("REVIEW_REQUIRED").alias("state"), "reason"), live
