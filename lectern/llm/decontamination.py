"""Benchmark decontamination: Wu-Manber search over words.

Patterns are the windows of the benchmark items. A table of block shifts (a block is the
last two or three words under the window's end) skips positions at which no pattern can
end; where the shift is 0, the bucket of that block holds the patterns to test, by first
word, and a direct comparison confirms an occurrence. Windows of equal length share a set
of tables.

Defined cases: null and empty texts have no words and no hits; items without words make no
window; repeated items and items with equal windows are all reported; items with a null id
mark words but are not listed; an item shorter than a window is one window of its own
length; repeated documents give repeated rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import lowered, table

#: Runs of letters and digits (after lower-casing A-Z) and of anything outside ASCII.
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Characters of benchmark text in one block of patterns; each block is broadcast on its own.
BLOCK_CHARS = 16_000_000


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(lowered(text)) if text else []


class WuManber:
    """Tables for patterns of one length, each a tuple of words with the items it belongs to."""

    def __init__(self, patterns: dict[tuple[str, ...], set[int]], length: int):
        self.length = length
        self.block = b = min(length, 2 if len(patterns) < 50_000 else 3)
        self.default = length - b + 1
        self.shift: dict[tuple[str, ...], int] = {}
        self.buckets: dict[tuple[str, ...], dict[str, list[tuple[tuple[str, ...], set[int]]]]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(b, length + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, self.default), length - end)
            self.buckets[p[-b:]][p[0]].append((p, items))

    def occurrences(self, words: list[str]) -> Iterator[tuple[int, set[int]]]:
        """(start, items) of each occurrence, by start."""
        n, m, b, default, shift = len(words), self.length, self.block, self.default, self.shift.get
        end = m
        while end <= n:
            key = tuple(words[end - b : end])
            skip = shift(key, default)
            if skip:
                end += skip
                continue
            start = end - m
            tests = self.buckets[key].get(words[start])
            if tests:
                window = tuple(words[start:end])
                for pattern, items in tests:
                    if pattern == window:
                        yield start, items
            end += 1


def build(items: list[tuple[str | None, str]], window: int = WINDOW) -> list[WuManber]:
    """Tables for a block of (id as text, text); items are known by their place in the block."""
    by_length: dict[int, dict[tuple[str, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for k, (_, text) in enumerate(items):
        w = words_of(text)
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            by_length[m][tuple(w[i : i + m])].add(k)
    return [WuManber(dict(p), m) for m, p in sorted(by_length.items())]


def search(words: list[str], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Spans of words (end exclusive) inside occurrences, and the items that occur."""
    spans, items = [], set()
    for t in tables:
        for start, found in t.occurrences(words):
            spans.append((start, start + t.length))
            items |= found
    return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def broadcast_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> list[Broadcast]:
    """The benchmark in blocks of bounded size, one broadcast each; the driver holds one at a time."""
    sc, out, block, size = benchmark.sparkSession.sparkContext, [], [], 0
    rows = benchmark.selectExpr("cast(item_id as string) as item_id", "text").where("text is not null")
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > block_chars:
            out.append(sc.broadcast(block))
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    return [*out, sc.broadcast(block)] if block else out


_built: dict[int, tuple[list[tuple[str | None, str]], list[WuManber]]] = {}


def _tables(block: Broadcast, alone: bool) -> tuple[list[tuple[str | None, str]], list[WuManber]]:
    """A worker keeps the tables of one block; with more blocks they are built anew for each batch."""
    key = block.value and id(block.value)
    if not alone or key not in _built:
        _built.clear()
        _built[key] = (block.value, build(block.value))
    return _built[key]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with n_words, n_hit, n_items, items_sha256 and contaminated. One row in, one row out."""
    keep = keep or ("doc_id",)
    base, blocks = docs.select(*dict.fromkeys([*keep, "text"])), broadcast_blocks(benchmark)
    schema = ", ".join(f"`{base.schema[c].name}` {base.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words = [0] * b.num_rows
            spans: list[list[tuple[int, int]]] = [[] for _ in range(b.num_rows)]
            ids: list[set[str]] = [set() for _ in range(b.num_rows)]
            for k, block in enumerate(blocks or [None]):
                items, tables = _tables(block, len(blocks) == 1) if block else ([], [])
                for i, t in enumerate(b.column("text")):
                    w = words_of(t.as_py())
                    n_words[i] = len(w)
                    s, found = search(w, tables)
                    spans[i] += s
                    ids[i].update(items[x][0] for x in found if items[x][0] is not None)
            hit = [covered(s) for s in spans]
            sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in hit], pa.bool_())],
                names=[*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return base.mapInArrow(work, schema)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT cast(item_id AS varchar) AS item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0
), iw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT *, unnest(generate_series(1, len(w) - m + 1)) AS s FROM i)
), dw AS (
  SELECT r, m, s, array_to_string(w[s:s + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)
), hits AS (
  SELECT dw.r, dw.s, dw.m, iw.item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + m - 1)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, cast(len(d.w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
