"""Token usage, cost and stage timing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stage import in_turn

#: Dollars per million tokens, and where long prompts begin.
UNCACHED, CACHED, WRITTEN, OUTPUT, LONG_PROMPT = 2.00, 0.20, 2.50, 10.00, 272_000
TOKENS = ("input_tokens", "cached_tokens", "write_tokens", "output_tokens")


def with_cost(calls: DataFrame) -> DataFrame:
    """``calls`` with input_cost, output_cost and cost_status: unavailable (a count is missing, negative or too large,
    and no cost then), estimate (the cache's share is not reported) or exact."""
    i, c, w, o = (F.col(x) for x in TOKENS)
    c0, w0 = F.coalesce(c, F.lit(0)), F.coalesce(w, F.lit(0))
    bad = i.isNull() | o.isNull() | (i < 0) | (o < 0) | (c0 < 0) | (w0 < 0) | (c0 > i) | (c0 + w0 > i)
    long = i > LONG_PROMPT
    cost = ((i - c0 - w0) / 1e6 * UNCACHED + c0 / 1e6 * CACHED + w0 / 1e6 * WRITTEN) * F.when(long, 2.0).otherwise(1.0)
    status = F.when(bad, "unavailable").when(c.isNull() | w.isNull(), "estimate").otherwise("exact")
    return calls.withColumns({"input_cost": F.when(~bad, cost), "output_cost": F.when(~bad, o / 1e6 * OUTPUT * F.when(long, 1.5).otherwise(1.0)), "cost_status": status})


def poisoned_sum(c: str) -> Column:
    """The sum; null if any part is."""
    return F.when(F.count(c) == F.count("*"), F.sum(c))


def usage_rollup(costed: DataFrame, by: str) -> DataFrame:
    """Calls, seconds and tokens per group, unknown where a part is unknown, with the least certain cost status."""
    worst = F.when(F.bool_or(F.col("cost_status") == "unavailable"), "unavailable").when(F.bool_or(F.col("cost_status") == "estimate"), "estimate").otherwise("exact")
    return costed.groupBy(by).agg(F.count("*").alias("n_calls"), F.sum("millis").alias("millis"), *[poisoned_sum(c).alias(c) for c in TOKENS], worst.alias("cost_status"))


def page_allocation(calls: DataFrame, pages: DataFrame, tokens: str = "input_tokens") -> DataFrame:
    """Each call's tokens in equal parts on its pages (call_id, page); unknown tokens stay unknown."""
    n = pages.groupBy("call_id").agg(F.count("*").alias("n_pages"))
    return pages.join(n, "call_id").join(calls.select("call_id", tokens), "call_id").select("call_id", "page", (F.col(tokens) / F.col("n_pages")).alias("tokens"))


def stage_summary(timings: DataFrame, stages: DataFrame, by: str) -> DataFrame:
    """Seconds per known stage (stage, ord), slowest first, with their share in percent and the bottleneck. What is
    not finite or not above 0 does not count."""
    ok = timings.where("seconds is not null and not isnan(seconds) and seconds > 0 and seconds < double('infinity')")
    x = ok.groupBy(by, "stage").agg(F.sum("seconds").alias("seconds")).join(F.broadcast(stages), "stage")
    w = Window.partitionBy(by)
    x = x.withColumns({"place": F.row_number().over(w.orderBy(F.desc("seconds"), "ord")), "total": F.sum("seconds").over(w)})
    return x.select(by, "stage", "place", F.round("seconds", 6).alias("seconds"), F.bround(F.col("seconds") / F.col("total") * 100, 1).alias("share"), (F.col("place") == 1).alias("bottleneck"))


def _admit(worst: int | None, actual: int | None, spent: int, blocked: bool | None, limit: int) -> tuple[bool | None, int, bool | None]:
    """Whether a request is admitted, and spent and blocked after it; None is unknown, as in SQL."""
    fits = None if worst is None else spent + worst <= limit
    ok = False if blocked or fits is False else None if blocked is None or fits is None else True
    if ok:
        spent += worst if actual is None else actual
    ends = False if ok is False or actual is not None else ok
    return ok, spent, True if blocked or ends else None if blocked is None or ends is None else False


def admissions(requests: DataFrame, by: str, order: str, limit: int) -> DataFrame:
    """Budget admission in order: a request reserves its worst case if that still fits, and is settled to its actual
    cost (both in micro-dollars); after an admitted request of unknown cost all others are denied. The requests of a
    run pass in order through one task, which holds no more of them than a batch; ``spent`` is the run's in the end."""
    kind = requests.schema[by].dataType.simpleString()
    x = requests.select(F.col(by).alias("by"), F.col(order).cast("bigint").alias("o"), F.col("worst").cast("bigint").alias("worst"), F.col("actual").cast("bigint").alias("actual"))

    def batch(like: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        keys, o, ok, spent, total = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(keys, like.schema.field("by").type), pa.array(o, pa.int64()), pa.array(ok, pa.bool_()), pa.array(spent, pa.int64()), pa.array(total, pa.bool_())], names=["by", "o", "admitted", "spent", "total"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, spent, blocked, b = None, False, 0, False, None
        for b in batches:
            rows = []
            for key, o, worst, actual in zip(*(c.to_pylist() for c in b.columns)):
                if not begun or not (key == last or (key != key and last != last)):
                    if begun:
                        rows.append((last, None, None, spent, True))
                    last, begun, spent, blocked = key, True, 0, False
                ok, spent, blocked = _admit(worst, actual, spent, blocked, limit)
                rows.append((key, o, ok, None, False))
            if rows:
                yield batch(b, rows)
        if begun:
            yield batch(b, [(last, None, None, spent, True)])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent = None  # a run's total stands before its requests
        for b in batches:
            rows = []
            for key, o, ok, s, total in zip(*(c.to_pylist() for c in b.columns)):
                if total:
                    spent = s
                else:
                    rows.append((key, o, ok, spent, False))
            if rows:
                yield batch(b, rows)

    folded = in_turn(x, ["by"], "o", "worst", "actual").mapInArrow(fold, schema := f"by {kind}, o bigint, admitted boolean, spent bigint, total boolean")
    settled = in_turn(folded, ["by"], F.desc("total")).mapInArrow(settle, schema)
    return settled.select(F.col("by").alias(by), F.col("o").alias(order), "admitted", "spent")
