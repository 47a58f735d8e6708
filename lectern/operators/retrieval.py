"""Lexical retrieval over Markdown: excerpts, scores, fair and stratified selection, budgets.

Excerpts are made inside the row that holds the document; nothing is shuffled for it.
"""

from __future__ import annotations

from collections import Counter
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import STOP_WORDS, bound, casefold, strip, word_count
from ..sources.stage import written

MAX_CHARS, MAX_EXCERPTS, CHUNK_CHARS, HISTORY = 40_000, 12, 3_000, 6
MARKER = r"<!--\s*page:\s*(\d+)\s*-->"
#: Requests for an overview of whole documents.
BROAD = re.compile(r"\b(summar(?:y|ize|ise)|overview|compare|contrast|key\s+points?)\b", re.IGNORECASE)


def _packed(section: Column, most: int) -> Column:
    """A section (stripped) whole if it fits, else its paragraphs packed into pieces of ``most`` characters at most, stripped."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        def put(joined: Column) -> Column:
            full = (acc["open"] != "") & (F.length(joined) > most)
            before = F.concat(acc["done"], F.when(full, F.array(acc["open"])).otherwise(none))
            pieces = F.regexp_extract_all(F.when(full, part).otherwise(joined), F.lit(f"(?s).{{1,{most}}}"), 0)  # cut in one pass, however long
            return bound(pieces, lambda x: F.struct(F.concat(before, F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0)))).alias("done"), F.coalesce(F.try_element_at(x, F.lit(-1)), F.lit("")).alias("open")))

        return bound(F.when(acc["open"] != "", strip(F.concat(acc["open"], F.lit("\n\n"), part))).otherwise(part), put)

    packed = F.aggregate(F.split(section, r"\n{2,}"), start, step, lambda acc: F.concat(acc["done"], F.when(acc["open"] != "", F.array(acc["open"])).otherwise(none)))
    return F.when(F.length(section) <= most, F.array(section)).otherwise(F.transform(packed, strip))


def excerpts(documents: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, excerpt_no, page, heading, excerpt): pages by their markers, sections by their headings, long sections in pieces."""
    at_marker, at_heading = rf"(?m)^(?={MARKER}[ \t]*$)", r"(?m)^(?=#{1,6}[ \t]+\S)"

    def of_page(p: Column) -> Column:
        number = F.regexp_extract(p, rf"^{MARKER}", 1)
        sections = F.split(strip(F.regexp_replace(p, rf"^{MARKER}", "")), at_heading)
        return bound(F.when(number != "", number.cast("int")), lambda page: F.flatten(F.transform(sections, lambda s: of_section(page, s))))

    def of_section(page: Column, s: Column) -> Column:
        title = F.regexp_extract(s, r"^#{1,6}[ \t]+([^\n]*)", 1)
        pieces = bound(strip(s), lambda x: F.filter(_packed(x, most), lambda c: c != ""))
        return bound(F.when(title != "", strip(title)), lambda heading: F.transform(pieces, lambda c: F.struct(page.alias("page"), heading.alias("heading"), c.alias("excerpt"))))

    found = F.flatten(F.transform(F.split("markdown", at_marker), of_page))
    return documents.select("doc_id", F.posexplode(found).alias("pos", "x")).select("doc_id", (F.col("pos") + 1).alias("excerpt_no"), "x.page", "x.heading", "x.excerpt")


def scored(found: DataFrame, query: str) -> DataFrame:
    """``found`` with score: each query term counts its occurrences, in the heading twice more, and 5 for the whole query."""
    wanted = Counter(t for t in re.findall(r"\w+", query.casefold()) if t not in STOP_WORDS)
    folded = found.withColumns({"_t": casefold(F.col("excerpt")), "_h": casefold(F.coalesce("heading", F.lit("")))})
    score = F.lit(0)
    for term, n in sorted(wanted.items()):
        score = score + n * (word_count(F.col("_t"), term) + 2 * word_count(F.col("_h"), term))
    if query.strip():
        score = score + F.when(F.contains("_t", F.lit(query.casefold())), 5).otherwise(0)
    return folded.withColumn("score", score.cast("bigint")).drop("_t", "_h")


def keys(found: DataFrame) -> DataFrame:
    """(doc_id, excerpt_no, score, n_chars) of scored excerpts, written once: the texts are cut and scored in one pass over the documents."""
    return written(found.select("doc_id", "excerpt_no", "score", F.length("excerpt").cast("bigint").alias("n_chars")), "excerpts")


def fair_topk(found: DataFrame, limit: int = MAX_EXCERPTS) -> DataFrame:
    """The best excerpt of every document first, in order of documents, then the best others with a score; ``limit`` in all.
    (doc_id, excerpt_no, score, n_chars, rank). Only ``keys`` are ranked, and each document's best by an aggregate."""
    return _fairest(keys(found), limit)


def _fairest(key: DataFrame, limit: int) -> DataFrame:
    best = key.groupBy("doc_id").agg(F.min_by("excerpt_no", F.struct(-F.col("score"), F.col("n_chars"), F.col("excerpt_no"))).alias("first"))
    heads = key.join(best, (key["doc_id"] == best["doc_id"]) & (key["excerpt_no"] == best["first"]), "left_semi").orderBy("doc_id").limit(limit).withColumn("turn", F.lit(0))
    others = key.where("score > 0").join(best, (key["doc_id"] == best["doc_id"]) & (key["excerpt_no"] == best["first"]), "left_anti")
    others = others.orderBy(F.desc("score"), "n_chars", "doc_id", "excerpt_no").limit(limit).withColumn("turn", F.lit(1))
    o = Window.orderBy("turn", F.when(F.col("turn") == 1, -F.col("score")), F.when(F.col("turn") == 1, F.col("n_chars")), "doc_id", "excerpt_no")
    return heads.union(others).withColumn("rank", F.row_number().over(o)).where(F.col("rank") <= limit).drop("turn")  # 2 * limit rows at most


def stratified(found: DataFrame, per_document: int) -> DataFrame:
    """Evenly spaced excerpts of every document, the first and the last among them."""
    n = found.groupBy("doc_id").agg(F.max("excerpt_no").alias("n"))
    place = lambda i: F.bround(i * (F.col("n") - 1) / max(1, per_document - 1)).cast("int") + 1
    even = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(per_document - 1)), place))
    picks = F.when(F.col("n") <= per_document, F.sequence(F.lit(1), F.col("n"))).otherwise(even)
    return n.select("doc_id", F.explode(picks).alias("excerpt_no")).join(found, ["doc_id", "excerpt_no"])


def within_budget(candidates: DataFrame, group: str, order: str, size: str, budget: int, most: int = MAX_EXCERPTS) -> DataFrame:
    """Greedy fill per group: in order, a candidate is taken if it still fits, else skipped; ``most`` in all."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("bigint").alias("s"))))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["taken"]) < most) & (acc["used"] + x["s"] <= budget)
        return F.struct(F.when(fits, acc["used"] + x["s"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["taken"], F.array(x["o"].cast("bigint")))).otherwise(acc["taken"]).alias("taken"))

    return candidates.groupBy(group).agg(items.alias("items")).select(group, F.aggregate("items", start, step).alias("x")).select(group, "x.used", F.explode_outer("x.taken").alias(order))


def retrieve(documents: DataFrame, query: str, max_chars: int = MAX_CHARS, limit: int = MAX_EXCERPTS) -> DataFrame:
    """Everything if it fits, an even sample for overview requests, else the fair top, cut to the budget.
    (rank, doc_id, excerpt_no, excerpt). The number of documents is what a user selects."""
    found = excerpts(documents)
    key = keys(scored(found, query))
    total, docs = key.agg(F.coalesce(F.sum("n_chars"), F.lit(0)), F.count_distinct("doc_id")).first()
    if total <= max_chars:
        order = Window.orderBy("doc_id", "excerpt_no")
        return found.select(F.row_number().over(order).alias("rank"), "doc_id", "excerpt_no", "excerpt")  # bounded by max_chars
    if BROAD.search(query):
        picked = stratified(key, max(1, limit // max(1, docs))).orderBy("doc_id", "excerpt_no").limit(limit)
        ranked = picked.withColumn("rank", F.row_number().over(Window.orderBy("doc_id", "excerpt_no")))
    else:
        ranked = _fairest(key, limit)
    ranked = written(ranked.select("rank", "doc_id", "excerpt_no", "n_chars", F.lit(1).alias("one")), "ranked")  # limit rows at most
    kept = within_budget(ranked, "one", "rank", "n_chars", max_chars, limit).select(F.col("rank").cast("int").alias("rank"))
    taken = F.broadcast(ranked.join(kept, "rank").select("rank", "doc_id", "excerpt_no"))
    texts = excerpts(documents.join(F.broadcast(ranked.select("doc_id").distinct()), "doc_id", "left_semi"))  # only the documents that are shown are cut again
    return texts.join(taken, ["doc_id", "excerpt_no"]).select("rank", "doc_id", "excerpt_no", "excerpt")


def recent_history(turns: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last ``most`` turns of users and assistants in each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    said = turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    return said.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def ordered_dedup(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value of a group once, with the place where it is first."""
    return rows.groupBy(group, value).agg(F.min(order).alias(f"first_{order}"))
