"""Chat formatting: every participant's view of a multi-party dialogue.

For each participant of a conversation the turns are rendered with that speaker as
assistant and all others as named users; masks mark what the assistant says. A dialogue of
any length is rendered in parts of ``TURNS`` turn numbers. This bounds a part where turns are
distinct; repeated or null turns of one conversation (or of the null one) all stand in one row.

Defined cases: a null text is an empty turn; a null role is a participant named "unknown";
a null turn stands before all others, in part -1; repeated turns are all rendered, in order
of turn, role and text; a null conv_id is a conversation of its own; an empty table gives an
empty result. System turns stay system turns in every view and have no view of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TURNS = 256
START, END = "<|turn|>", "<|end|>"


def perspectives(turns: DataFrame, turns_each: int = TURNS) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_own, text, masks): masks holds start:end of what the assistant
    says, in code points of ``text``, end exclusive, comma-joined."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    part = F.coalesce(F.floor(F.col("turn") / turns_each), F.lit(-1)).cast("bigint")
    speakers = t.where("role <> 'system'").select("conv_id", "role").distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("speakers"))
    parts = t.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), "role", "said"))).alias("lines"))
    s = speakers.withColumnRenamed("conv_id", "s_conv")
    views = parts.join(s, parts["conv_id"].eqNullSafe(s["s_conv"])).select("conv_id", "part", "lines", F.explode("speakers").alias("perspective"))
    me = F.col("perspective")
    head = F.transform("lines", lambda x: F.concat(F.lit(START), F.when(x["role"] == me, "assistant").when(x["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), x["role"])), F.lit("\n")))
    rendered = views.withColumn("heads", head)
    pieces = F.arrays_zip(F.col("heads").alias("head"), F.col("lines").alias("line"))
    rendered = rendered.withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["line"]["said"], F.lit(f"{END}\n"))), "")
    sizes = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).cast("bigint").alias("head"), F.length(p["line"]["said"]).cast("bigint").alias("said"), (p["line"]["role"] == me).alias("own")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("masks"))

    def step(acc, p):
        begin = acc["at"] + p["head"]
        end = begin + p["said"]
        return F.struct((end + len(END) + 1).alias("at"), F.when(p["own"], F.concat(acc["masks"], F.array(F.concat_ws(":", begin, end)))).otherwise(acc["masks"]).alias("masks"))

    masks = F.aggregate("sizes", start, step, lambda acc: F.array_join(acc["masks"], ","))
    rendered = rendered.withColumn("sizes", sizes)
    return rendered.select("conv_id", "perspective", "part", F.size("lines").cast("bigint").alias("n_turns"), F.size(F.filter("lines", lambda x: x["role"] == me)).cast("bigint").alias("n_own"), text.alias("text"), masks.alias("masks"))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS said,
    coalesce(cast(floor(turn / 256) AS bigint), -1) AS part FROM conversations
), s AS (
  SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'
), v AS (
  SELECT t.*, s.perspective, t.role = s.perspective AS own,
    '<|turn|>' || CASE WHEN t.role = s.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system' ELSE 'user name=' || t.role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(said) + 8) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, said ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS b FROM v
)
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own,
  string_agg(head || said || '<|end|>' || chr(10), '' ORDER BY turn, role, said) AS text,
  coalesce(string_agg(cast(b AS varchar) || ':' || cast(b + length(said) AS varchar), ',' ORDER BY turn, role, said) FILTER (WHERE own), '') AS masks
FROM o GROUP BY conv_id, perspective, part
"""
