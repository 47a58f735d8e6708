"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is dealt in blocks of equally many words. Sources get blocks by highest quotients
target / (2k + 1); each source's blocks are dealt to its shards in the same way, by their
words. In a shard the documents lie end to end in a seeded order; whole passes are taken
first, and the blocks that remain are picked by a seeded walk over the shard's blocks.

Defined cases: a null text has no words; a null source is a source of its own, after all
others; sources without words have target 0; no source gets more than three passes, so no
document is taken more than three times; documents with equal ids each count; an empty
table gives an empty result. ``doc_id`` may be null or repeated.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialise, table

WEIGHTS = (5, 2, 1)
PASSES = 3
BLOCK_WORDS = 16
#: Sources whose quotas the driver works out (of more, window functions do), and shards over all of them (one a source at least).
MAX_SOURCES, MAX_SHARDS, SHARD_DOCS = 100_000, 65_536, 256
_PRIME = 1_000_000_007


def word_count(text: Column) -> Column:
    """Words of a text: each run is put down as one letter, and the letters that remain are counted."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, WORD, "w"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: list[int], passes: int = PASSES) -> list[Fraction]:
    """The words of all sources shared by weight; what a source cannot take (``passes`` times its size) is
    shared again by the weights of the others. In order of room for its weight, sources fill up one by one."""
    left, weight, out = Fraction(sum(sizes)), sum(weights), [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i])):
        out[i] = min(left * weights[i] / weight, Fraction(passes * sizes[i]))
        left -= out[i]
        weight -= weights[i]
    return out


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by the highest quotients votes / (2k + 1); of equal quotients the first party's is first.
    A common divisor gives nearly all seats at once, the highest quotients the last ones."""
    votes, total = np.asarray(votes, float), float(np.sum(votes))
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    got = np.zeros(len(votes), np.int64)
    if seats > len(votes):  # rounding by this divisor gives seats - len(votes) to seats of them
        got = np.floor(votes * (seats - len(votes) / 2) / total + 0.5).astype(np.int64)
    queue = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes.tolist(), got.tolist()))]
    heapq.heapify(queue)
    for _ in range(seats - int(got.sum())):
        i = queue[0][1]
        got[i] += 1
        heapq.heapreplace(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def step_for(blocks: int) -> int:
    """A step that reaches every block before it comes back, for a walk over ``blocks`` blocks."""
    return _PRIME if blocks % _PRIME else _PRIME + 2


def _number(text: str) -> int:
    """A number below 2**32 that follows from a text."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def source_quotas(sources: DataFrame, few: bool, weights: tuple[int, ...], passes: int, block: int) -> DataFrame:
    """(source, source_size, target, quota) of (source, size): the words a source should give, and its blocks of the mix.
    ``few``: the driver works them out; else window functions over all sources do, by the same rules."""
    spark = sources.sparkSession
    if few:
        rows = sorted(sources.select("source", "size").collect(), key=lambda r: (r["source"] is None, r["source"] or ""))  # code points, null last
        size = [int(r["size"]) for r in rows]
        want = targets(size, [weights[i % len(weights)] for i in range(len(rows))], passes)
        seats = sainte_lague(np.array([float(x) for x in want]), round(sum(size) / block)).tolist()
        return spark.createDataFrame([(r["source"], n, float(t), q) for r, n, t, q in zip(rows, size, want, seats)], "source string, source_size bigint, target double, quota bigint")
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    everything = Window.partitionBy()
    x = sources.select("source", "size", (F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))) - 1).alias("i"))
    x = x.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("i") % len(weights) + 1).cast("int")))
    # the order in which sources fill up, the words and weights left before each, and the first that does not fill up
    common = math.lcm(*weights)
    filling = everything.orderBy((F.col("size") * (F.lit(common) / F.col("w")).cast("bigint")), "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"total": F.sum("size").over(everything), "place": F.row_number().over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    x = x.withColumns({"room": F.col("total") - passes * (F.sum("size").over(filling) - F.col("size")), "weight": F.sum("w").over(everything) - F.sum("w").over(filling) + F.col("w")})
    opens = whole("room") * F.col("w") < passes * whole("size") * F.col("weight")
    first = F.min(F.when(opens, F.struct("place", "room", "weight"))).over(everything)
    x = x.withColumn("first", first)
    shared = F.col("first.room").cast("double") * F.col("w") / F.col("first.weight")
    x = x.withColumn("target", F.when(F.col("first").isNull() | (F.col("place") < F.col("first.place")), (passes * F.col("size")).cast("double")).otherwise(shared))
    # nearly all blocks by a common divisor, the last ones by the highest quotients
    x = x.withColumns({"seats": F.bround(F.col("total") / F.lit(float(block)), 0).cast("bigint"), "votes": F.sum("target").over(everything), "n": F.count("*").over(everything)})
    x = x.withColumn("sure", F.when((F.col("seats") > F.col("n")) & (F.col("votes") > 0), F.floor(F.col("target") * (F.col("seats") - F.col("n") / 2) / F.col("votes") + 0.5)).otherwise(F.lit(0)).cast("bigint"))
    x = x.withColumn("left", F.col("seats") - F.sum("sure").over(everything))
    most = F.least(F.col("left"), F.ceil(F.col("target") * F.col("n") / F.greatest("votes", F.lit(1.0))).cast("bigint") + 2)
    k = x.where("target > 0 and left > 0").select("i", "left", "target", F.explode(F.sequence(F.col("sure"), F.col("sure") + most)).alias("k"))
    ranked = k.withColumn("rank", F.row_number().over(everything.orderBy(F.desc(F.col("target") / (2 * F.col("k") + 1)), "i")))
    more = ranked.where("rank <= left").groupBy("i").agg(F.count("*").alias("more"))
    return x.join(more, "i", "left").select("source", F.col("size").alias("source_size"), "target", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))


_PLAN = "source string, shard bigint, source_size bigint, target double, passes bigint, blocks bigint, there bigint, step bigint, first bigint"
_PLAN_ROWS = pa.schema([("source", pa.string()), ("shard", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), *((c, pa.int64()) for c in ("passes", "blocks", "there", "step", "first"))])


def shard_plans(shards: DataFrame, passes: int = PASSES, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """Per shard of (source, shard, words, source_size, target, quota) the passes over it, the blocks of the last, partial one,
    and the walk's start. A source has MAX_SHARDS shards at most."""

    def rows(own: list[dict]) -> list[dict]:
        out, s = [], own[0]["source"]
        for r, blocks in zip(own, sainte_lague(np.array([r["words"] for r in own]), own[0]["quota"]).tolist()):
            words = r["words"]
            take = min(blocks * block, passes * words)
            full = take // words if words else 0
            there = -(-words // block)
            rest = min(round((take - full * words) / block), there)
            walk = {"there": there, "step": step_for(there), "first": _number(f"{seed}:{s}:{r['shard']}") % max(there, 1)}
            out.append({k: r[k] for k in ("source", "shard", "source_size", "target")} | {"passes": full, "blocks": rest} | walk)
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out = []
            for r in b.to_pylist():
                if held and held[0]["source"] != r["source"]:
                    out += rows(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema=_PLAN_ROWS)
        if held:
            yield pa.RecordBatch.from_pylist(rows(held), schema=_PLAN_ROWS)

    return shards.repartition("source").sortWithinPartitions("source", "shard").mapInArrow(work, _PLAN)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shard) of every document."""
    sized = materialise(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    sources = materialise(sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")), "sources")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    few = n_sources <= MAX_SOURCES
    small = F.broadcast if few else lambda x: x
    quotas = materialise(source_quotas(sources, few, weights, passes, block), "quotas")
    spread = sources.select(F.col("source").alias("s_source"), F.greatest(F.lit(1), F.least(F.expr(f"(rows + {SHARD_DOCS - 1}) div {SHARD_DOCS}"), F.expr(f"{MAX_SHARDS} * rows div {max(total, 1)}"))).alias("n_shards"))
    placed = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sharded = sized.withColumn("place", placed).join(small(spread), sized["source"].eqNullSafe(spread["s_source"])).drop("s_source")
    sharded = sharded.withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("bigint") % F.col("n_shards")).drop("n_shards")
    words = sharded.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    of = quotas.select(F.col("source").alias("q_source"), "source_size", "target", "quota")
    plans = materialise(shard_plans(words.join(small(of), words["source"].eqNullSafe(of["q_source"])).drop("q_source"), passes, block, seed), "plans")
    window = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = sharded.withColumn("end", F.sum("size").over(window)).withColumn("start", F.col("end") - F.col("size"))
    p = plans.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), *plans.columns[2:])
    joined = laid.join(small(p), laid["source"].eqNullSafe(p["p_source"]) & (laid["shard"] == p["p_shard"]))
    mine = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    picked = lambda b: F.pmod(b * F.pmod("step", "there") + F.col("first"), F.col("there")) < F.col("blocks")
    part = lambda acc, b: acc + F.when(picked(b), F.least(F.col("end"), (b + 1) * block) - F.greatest(F.col("start"), b * block)).otherwise(0)
    extra = F.when((F.col("size") == 0) | (F.col("blocks") == 0), F.lit(0)).otherwise(F.aggregate(mine, F.lit(0).cast("bigint"), part))
    return joined.withColumn("taken", (F.col("passes") * F.col("size") + extra).cast("bigint")).select("doc_id", "source", "size", "source_size", "target", "taken", "shard")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('7:' || coalesce(cast(doc_id AS varchar), '')) AS place FROM documents
), s0 AS (
  SELECT source, sum(size) AS size, count(*) AS n FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS i, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, sum(size) OVER () AS total, sum(n) OVER () AS docs FROM s0
), s2 AS (
  SELECT *, total - 3 * (sum(size) OVER o - size) AS room, sum(w) OVER () - (sum(w) OVER o - w) AS weight, row_number() OVER o AS place FROM s1 WINDOW o AS (ORDER BY size * (10 // w), i ROWS UNBOUNDED PRECEDING)
), s3 AS (
  SELECT *, min(CASE WHEN room * w < 3 * size * weight THEN place END) OVER () AS first_open FROM s2
), s4 AS (
  SELECT a.*, CASE WHEN first_open IS NULL OR a.place < first_open THEN cast(3 * a.size AS double)
    ELSE (SELECT cast(b.room AS double) FROM s3 b WHERE b.place = a.first_open) * a.w / (SELECT cast(b.weight AS double) FROM s3 b WHERE b.place = a.first_open) END AS target,
    cast(round_even(total / 16.0::DOUBLE, 0) AS bigint) AS seats FROM s3 a
), q AS (
  SELECT i, target / (2 * k + 1) AS q, seats FROM (SELECT *, unnest(range(0, cast(ceil(seats * target / greatest(total, 1)) AS bigint) + 100)) AS k FROM s4 WHERE target > 0)
), won AS (
  SELECT i, count(*) AS blocks FROM (SELECT *, row_number() OVER (ORDER BY q DESC, i) AS rank FROM q) WHERE rank <= seats GROUP BY i
), src AS (
  SELECT s4.*, coalesce(won.blocks, 0) AS blocks, greatest(1, least((n + 255) // 256, 65536 * n // docs)) AS n_shards FROM s4 LEFT JOIN won USING (i)
), ds AS (
  SELECT d.*, src.i, src.size AS source_size, src.target, src.blocks AS s_blocks, cast('0x' || d.place[1:8] AS bigint) % src.n_shards AS shard FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source
), sh AS (
  SELECT i, any_value(source) AS source, shard, sum(size) AS words, any_value(s_blocks) AS s_blocks FROM ds GROUP BY i, shard
), sq AS (
  SELECT i, shard, s_blocks, words / (2 * k + 1)::DOUBLE AS q FROM (SELECT *, unnest(range(0, s_blocks)) AS k FROM sh WHERE words > 0)
), sw AS (
  SELECT i, shard, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY q DESC, shard) AS rank FROM sq) WHERE rank <= s_blocks GROUP BY i, shard
), p0 AS (
  SELECT i, shard, words, (words + 15) // 16 AS there, least(coalesce(blocks, 0) * 16, 3 * words) AS take, cast('0x' || md5('7:' || coalesce(source, 'None') || ':' || shard)[1:8] AS bigint) AS number FROM sh LEFT JOIN sw USING (i, shard)
), p AS (
  SELECT *, CASE WHEN words > 0 THEN take // words ELSE 0 END AS passes, CASE WHEN words > 0 THEN least(cast(round_even((take - take // words * words) / 16.0::DOUBLE, 0) AS bigint), there) ELSE 0 END AS rest, number % greatest(there, 1) AS first FROM p0
), laid AS (
  SELECT *, sum(size) OVER (PARTITION BY i, shard ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS stop, row_number() OVER () AS r FROM ds
), cut AS (
  SELECT r, passes, rest, there, first, laid.size, stop - laid.size AS start, stop, unnest(CASE WHEN laid.size = 0 OR rest = 0 THEN [NULL] ELSE range(cast((stop - laid.size) // 16 AS bigint), cast((stop - 1) // 16 + 1 AS bigint)) END) AS b FROM laid JOIN p USING (i, shard)
), got AS (
  SELECT r, any_value(passes * size) + sum(CASE WHEN b IS NOT NULL AND (b * (1000000007 % there) + first) % there < rest THEN least(stop, (b + 1) * 16) - greatest(start, b * 16) ELSE 0 END) AS taken FROM cut GROUP BY r
)
SELECT doc_id, cast(size AS bigint) AS size, cast(source_size AS bigint) AS source_size, target, cast(taken AS bigint) AS taken FROM laid JOIN got USING (r)
"""
