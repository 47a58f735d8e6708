"""Grounding and adjudication: raw evidence stays, what cannot be grounded is dropped or flagged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

#: Outcomes of a refinement from the strongest to the weakest.
STATUS_ORDER = ("accepted", "abstained", "rejected", "missing")


def ground_quotes(quotes: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """``quotes`` (key, quote) with grounded: the cited text is there and holds the quote; else why not."""
    x = quotes.join(texts.select(key, F.col("text").alias("_source")), key, "left")
    why = F.when(F.col("_source").isNull(), "unknown_source").when(F.coalesce(strip(F.col("quote")), F.lit("")) == "", "empty_quote").when(~F.contains("_source", "quote"), "quote_mismatch")
    return x.withColumns({"grounded": why.isNull(), "warning": why}).drop("_source")


def block_evidence(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence (doc_id, page, block_id, quote) counts if its block is on that page and holds the quote."""
    b = blocks.select("doc_id", "block_id", F.col("page").alias("b_page"), F.col("text").alias("b_text"))
    x = evidence.join(b, ["doc_id", "block_id"], "left")
    return x.withColumn("grounded", F.coalesce((F.col("b_page") == F.col("page")) & F.contains("b_text", "quote"), F.lit(False))).drop("b_page", "b_text")


def critical_change(before: Column, after: Column) -> Column:
    """A change that touches digits or comparison signs."""
    risky = r"[0-9<>]"
    return (before != after) & (before.rlike(risky) | after.rlike(risky))


def adjudicate_refinements(refinements: DataFrame, blocks: DataFrame) -> DataFrame:
    """The first reason that holds decides: no text is abstained, no such block and changes of critical text are
    rejected, unverified ones are abstained, others accepted."""
    b = blocks.select("doc_id", "block_id", F.col("text").alias("b_text"))
    x = refinements.join(b, ["doc_id", "block_id"], "left")
    status = F.when(F.col("new_text").isNull(), "abstained").when(F.col("b_text").isNull(), "rejected").when(~F.col("verified"), "abstained").when(critical_change(F.col("b_text"), F.col("new_text")), "rejected").otherwise("accepted")
    return x.withColumn("status", status).drop("b_text")


def low_score_coverage(blocks: DataFrame, refinements: DataFrame, below: float = 0.85) -> DataFrame:
    """Per block with a low score the strongest outcome of its refinements; "missing" if it has none."""
    order = F.array(*map(F.lit, STATUS_ORDER))
    best = refinements.groupBy("doc_id", "block_id").agg(F.min(F.array_position(order, F.col("status"))).alias("_p"))
    x = blocks.where(F.col("score") < below).select("doc_id", "block_id").join(best, ["doc_id", "block_id"], "left")
    return x.select("doc_id", "block_id", F.coalesce(F.get(order, (F.col("_p") - 1).cast("int")), F.lit("missing")).alias("status"))


def overlay_accepted(blocks: DataFrame, refinements: DataFrame, order: str) -> DataFrame:
    """Blocks with shown: the text of the last accepted refinement, else their own."""
    last = refinements.where("status = 'accepted'").groupBy("doc_id", "block_id").agg(F.max_by("new_text", order).alias("new_text"))
    return blocks.join(last, ["doc_id", "block_id"], "left").withColumn("shown", F.coalesce("new_text", "text")).drop("new_text")


def allowed_labels(proposals: DataFrame, allowed: list[str]) -> DataFrame:
    """Proposals (label, grounded) with status: unknown labels and "unknown" are abstained, ungrounded ones rejected."""
    known = F.col("label").isin(*allowed)
    status = F.when(F.coalesce(F.col("label"), F.lit("unknown")) == "unknown", "abstained").when(~known, "abstained").when(~F.col("grounded"), "rejected").otherwise("accepted")
    return proposals.withColumn("status", status)


def missing_fields(documents: DataFrame, declared: DataFrame, proposed: DataFrame) -> DataFrame:
    """Declared fields (field, required) that a document has no proposal for. The schema is a bounded control table;
    each document carries it as an array, so no rows are crossed."""
    rows = declared.orderBy("field").collect()
    schema = F.array(*[F.struct(F.lit(r["field"]).alias("field"), F.lit(r["required"]).alias("required")) for r in rows])
    want = documents.select("doc_id", F.explode(schema).alias("x")).select("doc_id", "x.field", "x.required")
    return want.join(proposed.select("doc_id", "field").distinct(), ["doc_id", "field"], "left_anti").withColumn("status", F.lit("abstained"))


def split_coverage(splits: DataFrame, pages: DataFrame) -> DataFrame:
    """Whether the splits (start_page, end_page) of a document follow one another from page 1 to its last page."""
    w = Window.partitionBy("doc_id").orderBy("start_page", "end_page")
    x = splits.withColumn("want", F.coalesce(F.lag("end_page").over(w) + 1, F.lit(1)))
    x = x.groupBy("doc_id").agg(F.bool_and(F.col("want") == F.col("start_page")).alias("joined"), F.max_by("end_page", F.struct("start_page", "end_page")).alias("last"))
    n = pages.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return n.join(x, "doc_id", "left").select("doc_id", F.coalesce(F.col("joined") & (F.col("last") == F.col("n_pages")), F.lit(False)).alias("valid"))


def sum_equals(parts: DataFrame, targets: DataFrame, key: str, part: str, target: str, tolerance: float = 0.01) -> DataFrame:
    """Per key whether its parts sum to its one target; no part or no number fails."""
    s = parts.groupBy(key).agg(F.sum(part).alias("total"), F.count_if(F.col(part).isNull()).alias("gone"))
    x = targets.select(key, F.col(target).alias("want")).join(s, key, "left").withColumn("diff", F.col("total") - F.col("want"))
    return x.withColumn("ok", F.coalesce((F.col("gone") == 0) & (F.abs("diff") <= tolerance), F.lit(False)))


def checkbox_rules(checkboxes: DataFrame, group: str) -> DataFrame:
    """Per group what the rules over its controls say: exactly one, at least one, at most one, none excludes others."""
    n = F.count_if(F.col("state") == "CHECKED")
    x = checkboxes.groupBy(group).agg(n.alias("checked"), F.bool_or((F.col("label") == "none") & (F.col("state") == "CHECKED")).alias("none"))
    c = F.col("checked")
    return x.select(group, (c == 1).alias("exactly_one"), (c >= 1).alias("min_one"), (c <= 1).alias("mutually_exclusive"), (~F.coalesce("none", F.lit(False)) | (c <= 1)).alias("none_exclusive"))


def section_parents(sections: DataFrame) -> DataFrame:
    """(doc_id, ord, parent, kept): the parent is the nearest earlier section of a smaller level; a section below the
    top without one is dropped and is nobody's parent. One open section per level is all that is carried along."""
    items = F.array_sort(F.collect_list(F.struct("ord", "level")))
    start = F.struct(F.array().cast("array<struct<ord:bigint,level:int>>").alias("open"), F.array().cast("array<struct<ord:bigint,parent:bigint,kept:boolean>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        above = F.filter(acc["open"], lambda o: o["level"] < x["level"])
        parent = F.try_element_at(above, F.lit(-1))["ord"]
        kept = (x["level"] == 1) | parent.isNotNull()
        me = F.struct(x["ord"].cast("bigint").alias("ord"), x["level"].cast("int").alias("level"))
        one = F.struct(x["ord"].cast("bigint").alias("ord"), parent.alias("parent"), kept.alias("kept"))
        return F.struct(F.when(kept, F.concat(above, F.array(me))).otherwise(acc["open"]).alias("open"), F.concat(acc["out"], F.array(one)).alias("out"))

    x = sections.groupBy("doc_id").agg(items.alias("items"))
    return x.select("doc_id", F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("x")).select("doc_id", "x.ord", "x.parent", "x.kept")


def last_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key in an append-only log."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key it does not have."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def covered_once(requested: DataFrame, reviewed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not reviewed exactly once: missing, repeated or never asked for."""
    n = reviewed.groupBy(*keys).agg(F.count("*").alias("n"))
    x = requested.select(*keys).distinct().withColumn("asked", F.lit(True)).join(n, keys, "full")
    problem = F.when(F.col("asked").isNull(), "unrequested").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated")
    return x.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")


def workflow_state(events: DataFrame, by: str) -> DataFrame:
    """FAILED with an error, REVIEW_REQUIRED with a review, else ACCEPTED."""
    return events.groupBy(by).agg(F.when(F.bool_or(F.col("kind") == "error"), "FAILED").when(F.bool_or(F.col("kind") == "review"), "REVIEW_REQUIRED").otherwise("ACCEPTED").alias("state"))


def normalised(value: Column, kind: Column) -> Column:
    """A text as its declared type has it, as JSON text: numbers without thousands separators, true and false in
    either case; what does not fit stays as it is."""
    bare = strip(F.replace(value, F.lit(","), F.lit("")))
    return (
        F.when((kind == "integer") & bare.rlike(r"^[+-]?\d+$"), bare.try_cast("bigint").cast("string"))
        .when((kind == "number") & bare.try_cast("double").isNotNull(), bare.try_cast("double").cast("decimal(20,4)").cast("string"))
        .when((kind == "boolean") & F.lower(strip(value)).isin("true", "false"), F.lower(strip(value)))
        .otherwise(value)
    )


def field_errors(fields: DataFrame) -> DataFrame:
    """Fields (value, pattern, minimum, maximum, confidence, min_confidence) with status: invalid against the schema,
    uncertain below the confidence asked for, else valid."""
    v, n = F.col("value"), F.col("value").try_cast("double")
    wrong = (F.col("pattern").isNotNull() & ~F.rlike(v, F.col("pattern"))) | (F.col("minimum").isNotNull() & F.coalesce(n < F.col("minimum"), F.lit(True))) | (F.col("maximum").isNotNull() & F.coalesce(n > F.col("maximum"), F.lit(True)))
    status = F.when(v.isNull() | F.coalesce(wrong, F.lit(False)), "invalid").when(F.coalesce(F.col("confidence") < F.col("min_confidence"), F.lit(False)), "uncertain").otherwise("valid")
    return fields.withColumn("status", status)


#: The stage that a review message is for, by the words it holds; the first row whose words all occur decides.
MESSAGE_STAGES = (
    ("checkbox", ("checkbox",)), ("classify", ("classification",)), ("section", ("section",)), ("split", ("split",)), ("extract", ("field",)),
    ("parse", ("low-confidence block",)), ("parse", ("table", "requires review")), ("parse", ("page",)),
)


def message_stage(message: Column) -> Column:
    low, out = F.lower(message), F.lit("validate")
    for stage, words in reversed(MESSAGE_STAGES):
        out = F.when(reduce(Column.__and__, [F.contains(low, F.lit(w)) for w in words]), stage).otherwise(out)
    return out


def link_issues(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst, relation, ord) with issue: an endpoint is unknown, the same link came before, a "continues"
    link does not lead forward; null if there is none. Cycles: see operators.graph."""
    n = nodes.select("node", F.struct("page", "reading_order").alias("at"))
    x = links.join(n.select(F.col("node").alias("src"), F.col("at").alias("s_at")), "src", "left").join(n.select(F.col("node").alias("dst"), F.col("at").alias("d_at")), "dst", "left")
    again = F.row_number().over(Window.partitionBy("src", "dst", "relation").orderBy("ord")) > 1
    issue = F.when(F.col("s_at").isNull() | F.col("d_at").isNull(), "unknown_endpoint").when(again, "duplicate").when((F.col("relation") == "continues") & (F.col("s_at") >= F.col("d_at")), "not_forward")
    return x.withColumn("issue", issue).drop("s_at", "d_at")
