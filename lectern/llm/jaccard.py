"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct five-word shingles; two link at a Jaccard similarity
of 0.8 or more. Sets fall into bands by size. Sets of one band, or of two next to each
other, that link differ in at most k elements, so of k + 1 + e parts of the feature domain
at least e + 1 hold the same elements in both. Each set has one signature per part that is
not empty. A set with more than e empty parts adds the signatures of another partition,
and at the last one those of its empty parts too, so no link is lost.

Equal sets are one class from the start. In each bucket of equal signatures the classes are
first compared with one of them, another one in each round; the components of these links
leave few buckets with more than one component, and only there are the classes of
different components compared with each other.
A comparison first bounds the difference by parity sketches, which never rule out a link,
and then counts the common shingles of the two texts, which travel compressed.

Defined cases: null and empty texts, and texts without words, have an empty set and link
with nothing; a text with fewer than five words is one shingle; documents with equal ids
and different texts are documents of their own; component_id is the smallest id of a
component that is not null (null if it has none); an empty table gives an empty result.
Shingles and classes are known by 64-bit hashes; a second hash of 64 bits guards the classes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, release, set_aside, table

SHINGLE = 5
#: 64-bit words of a parity sketch.
SKETCH = 16
#: Partitions tried before empty parts count as well.
LEVELS = 4
#: Buckets of at most this size are joined as they are, larger ones with their sketches.
SMALL_BUCKET = 32
#: Rounds in which each bucket's members are compared with one of them only.
HUB_ROUNDS = 3
#: Ids of up to this many documents (some 20 bytes each) go to every task; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Elements of sets that a task which compares texts keeps for the next pair.
HELD_ELEMENTS = 4_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    m, s = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
    x = (x ^ (x >> s)) * m
    x = (x ^ (x >> s)) * m
    return x ^ (x >> s)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8; bytes.lower and bytes.split know A-Z and ASCII white space only."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:
        return mixed((h * _FACTORS[:n]).sum(keepdims=True) + np.uint64(n))
    s = h[: n - 4] * _FACTORS[0]
    for i in range(1, SHINGLE):
        s = s + h[i : n - 4 + i] * _FACTORS[i]
    s = np.sort(mixed(s))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a string or binary column in UTF-8."""
    for t in column.cast(pa.binary()):
        yield t.as_py()


def class_of(s: np.ndarray) -> tuple[int, int]:
    """The class of a set and a second hash of it."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def sketch(s: np.ndarray) -> np.ndarray:
    """Each element flips one of the bits: sketches differ in no more bits than their sets in elements."""
    counts = np.bincount((s >> np.uint64(40)).astype(np.int64) % (64 * SKETCH), minlength=64 * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def _bands(largest: int = 1 << 40) -> list[int]:
    """The largest size of each band; a set links only with sets of its own band and the next ones."""
    out, low = [], 1
    while low < largest:
        out.append(max(low, low * 5 // 4))
        low = out[-1] + 1
    return out


BANDS = _bands()


def signatures(s: np.ndarray) -> np.ndarray:
    """All signatures of a set: for its own band and for the next one."""
    out, own, content_of = [], bisect_left(BANDS, len(s)), mixed(s + _FACTORS[2])
    for band in (own, own + 1):
        k = 2 * BANDS[band] // 9
        spare = 2 + k * 8 // 100
        parts = np.uint64(k + 1 + spare)
        for level in range(LEVELS):
            salt = np.uint64(band * LEVELS + level + 1)
            part = mixed(s + np.full(1, salt) * _FACTORS[1]) % parts
            order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")  # short keys are sorted by radix
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            content = np.add.reduceat(content_of[order], first)
            out.append(mixed(content + mixed(part[first] * _FACTORS[3] + salt)))
            empty = int(parts) - len(first)
            if empty <= spare:
                break
            if level == LEVELS - 1:
                absent = np.setdiff1d(np.arange(int(parts), dtype=np.uint64), part[first])
                out.append(mixed(mixed(absent * _FACTORS[3] + salt)))
    return np.concatenate(out)


_SKETCH_COLUMNS = [f"s{i}" for i in range(SKETCH)]


def _classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, guard, sketch) per document; node is null for the empty set."""
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = base.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in _bytes(b.column("text"))]
            known = [class_of(s) if len(s) else (None, None) for s in sets]
            bits = np.array([sketch(s) for s in sets], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in known], pa.int64()), pa.array([x for _, x in known], pa.int64()), *(pa.array(bits[:, i]) for i in range(SKETCH))],
                names=["doc_id", "text_key", "n_shingles", "node", "guard", *_SKETCH_COLUMNS],
            )

    return base.mapInArrow(work, f"doc_id {kind}, text_key bigint, n_shingles bigint, node bigint, guard bigint, " + ", ".join(f"{c} bigint" for c in _SKETCH_COLUMNS))


def _signature_rows(docs: DataFrame) -> DataFrame:
    """(sig, node) of every class; a task emits a class once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            sigs, nodes, held = [], [], 0
            for t in _bytes(b.column("text")):
                s = shingles(t)
                if not len(s) or (node := class_of(s)[0]) in seen:
                    continue
                seen.add(node)
                g = signatures(s)
                sigs.append(g)
                nodes.append(np.full(len(g), node, np.int64))
                held += len(g)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])
                    sigs, nodes, held = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])

    return docs.select("text").mapInArrow(work, "sig bigint, node bigint")


def _packed(texts: DataFrame) -> DataFrame:
    """(node, packed) of (node, text), the texts compressed for the way; a task emits a class once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, nodes, packed = b.slice(i, 500), [], []
                for node, t in zip(part.column("node").to_pylist(), _bytes(part.column("text")), strict=True):
                    if node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        packed.append(zlib.compress(t, 6))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], names=["node", "packed"])

    return texts.select("node", "text").mapInArrow(work, "node bigint, packed binary")


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of (a, b, x, y) whose packed texts x and y link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            a, b, keep = batch.column("a").to_pylist(), batch.column("b").to_pylist(), []
            for i in range(batch.num_rows):
                sets = []
                for node, c in ((a[i], "x"), (b[i], "y")):
                    if node not in held:
                        if size > HELD_ELEMENTS:
                            held.clear()
                            size = 0
                        held[node] = shingles(zlib.decompress(batch.column(c)[i].as_py()))
                        size += len(held[node])
                    sets.append(held[node])
                both = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * both >= 80 * (len(sets[0]) + len(sets[1]) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(work, "a bigint, b bigint")


def _may_link(a: str, b: str, sketches: bool = True) -> Column:
    """Sizes within the threshold, and sketches that differ in no more bits than linked sets may in elements."""
    na, nb = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = (5 * na >= 4 * nb) & (5 * nb >= 4 * na)
    if not sketches:
        return sizes
    bits = reduce(Column.__add__, [F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _SKETCH_COLUMNS])
    return sizes & (9 * bits <= na + nb)


def _with_component(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` with the component of their node; a node without links is its own."""
    if comp is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _in_mixed_buckets(shared: DataFrame, comp: DataFrame | None, turn: int) -> DataFrame:
    """(sig, node, comp, hub, m) of the buckets that hold more than one component, with the bucket's size and its hub of this turn."""
    bucket = Window.partitionBy("sig")
    hub = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp")).over(bucket)
    placed = _with_component(shared.select("sig", "node"), comp).withColumns({"c0": F.min("comp").over(bucket), "c1": F.max("comp").over(bucket), "hub": hub, "m": F.count("*").over(bucket)})
    return placed.where("c0 <> c1").select("sig", "node", "comp", "hub", "m")


def _bounded(pairs: DataFrame, nodes: DataFrame, known: DataFrame | None) -> DataFrame:
    """The distinct pairs (a, b) that are not ``known`` and whose sizes and sketches allow a link."""
    pairs = pairs.distinct()
    if known is not None:
        low, high = F.least("a", "b"), F.greatest("a", "b")
        pairs = pairs.join(known.select(low.alias("low"), high.alias("high")), (low == F.col("low")) & (high == F.col("high")), "left_anti")
    x = pairs.join(nodes.alias("x"), F.col("a") == F.col("x.node"))
    return x.join(nodes.alias("y"), (F.col("b") == F.col("y.node")) & _may_link("x", "y")).select("a", "b")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that link, by their sets; only the texts of classes in ``pairs`` travel."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes, "node")
    wanted = wanted_table = materialise(wanted.select("node", F.col("doc_id").alias("w_id"), "text_key"), "wanted")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("d_key"), "text")
    n_wanted = wanted.count()
    if n_wanted <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = materialise(_packed(keyed.join(wanted, keyed["doc_id"].eqNullSafe(wanted["w_id"]) & (keyed["d_key"] == wanted["text_key"]))), "texts")
    packed = texts if texts.count() == n_wanted else texts.dropDuplicates(["node"])  # rows may repeat an id and its text
    a, b = packed.select(F.col("node").alias("a"), F.col("packed").alias("x")), packed.select(F.col("node").alias("b"), F.col("packed").alias("y"))
    # the text of b, which many pairs may share, comes last
    links = materialise(_verified(pairs.join(a, "a").join(b, "b")), "links")
    release(spark, texts, wanted_table)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): the smallest node that can be reached. Each round takes the
    smallest label among a node and its neighbours, then the label of that label; each is written and read back."""
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n_node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, F.col("node") == F.col("n_node")).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = labels.select(F.col("node").alias("u_node"), F.col("comp").alias("up"))
        step = step.join(up, F.col("comp") == F.col("u_node")).select("node", "old", F.least("comp", "up").alias("comp"))
        step = materialise(step, "labels")
        labels = step.select("node", "comp")
        if step.where("old <> comp").isEmpty():
            return labels


def merged_components(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) after ``links`` join components of ``comp``; only components that a link touches are worked on."""
    if comp is None:
        return components(links)
    at = lambda c: comp.select(F.col("node").alias(f"{c}_n"), F.col("comp").alias(f"{c}_c"))
    x = links.join(at("a"), F.col("a") == F.col("a_n"), "left").join(at("b"), F.col("b") == F.col("b_n"), "left")
    x = x.select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")).where("a <> b").distinct()
    joined = components(x)
    every = comp.union(joined.join(comp, "node", "left_anti").select("node", F.col("node").alias("comp")))
    up = joined.select(F.col("node").alias("u_node"), F.col("comp").alias("up"))
    return materialise(every.join(up, F.col("comp") == F.col("u_node"), "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")


def similarity_classes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, first_key) per document; first_key is the text_key of the
    document with the id component_id that stands for the component."""
    classes = materialise(_classes(docs), "classes")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_key"))).alias("rep")
    sketches = [F.first(c).alias(c) for c in _SKETCH_COLUMNS]
    nodes = classes.where("node is not null").groupBy("node").agg(rep, F.first("n_shingles").alias("n_shingles"), F.min("guard").alias("g0"), F.max("guard").alias("g1"), *sketches)
    nodes = materialise(nodes.select("node", "rep", "rep.doc_id", "rep.text_key", "n_shingles", (F.col("g0") != F.col("g1")).alias("clash"), *_SKETCH_COLUMNS), "nodes")
    if not nodes.where("clash").isEmpty():
        raise ValueError("two different sets share a 64-bit class; choose other factors")
    slim = nodes.select("node", "n_shingles", *_SKETCH_COLUMNS)

    bucket = Window.partitionBy("sig")
    rows = _signature_rows(docs).withColumns({"low": F.min("node").over(bucket), "top": F.max("node").over(bucket)})
    shared = materialise(rows.where("low <> top").select("sig", "node").distinct(), "shared")

    release(docs.sparkSession)

    comp, known = None, None
    for turn in range(HUB_ROUNDS):
        placed = _in_mixed_buckets(shared, comp, turn)
        if comp is not None:  # a bucket of one component stays one
            placed = materialise(placed, "mixed")
            release(docs.sparkSession, shared)
            shared = placed
        pairs = placed.where(F.col("comp") != F.col("hub.comp")).select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
        near = materialise(_bounded(pairs, slim, known), "pairs")
        known = near if known is None else known.union(near)
        links = _linked(near, docs, nodes)
        if not links.isEmpty():
            comp = merged_components(comp, links)

    mixed_buckets = materialise(_in_mixed_buckets(shared, comp, HUB_ROUNDS).drop("hub"), "mixed")
    sized = mixed_buckets.where(F.col("m") <= SMALL_BUCKET).join(nodes.select("node", "n_shingles"), "node")
    small = sized.alias("x").join(sized.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y", sketches=False))
    full = mixed_buckets.where(F.col("m") > SMALL_BUCKET).join(slim, "node")
    large = full.alias("x").join(full.alias("y"), (F.col("x.sig") == F.col("y.sig")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y"))
    cross = small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).union(large.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")))
    cross = materialise(_bounded(cross, slim, known), "cross")
    links = _linked(cross, docs, nodes)
    if not links.isEmpty():
        comp = merged_components(comp, links)

    member = _with_component(nodes.select("node", "rep"), comp)
    first = member.groupBy("comp").agg(F.min("rep").alias("rep"))
    named = member.select("node", "comp").join(first, "comp").select("node", F.col("rep.doc_id").alias("component_id"), F.col("rep.text_key").alias("first_key"))
    full = classes.select("doc_id", "text_key", "n_shingles", "node").join(named, "node", "left")
    alone = F.col("node").isNull()
    return full.select("doc_id", "text_key", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(alone, F.col("text_key")).otherwise(F.col("first_key")).alias("first_key"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` for one document of each component (its smallest id); empty sets all stay."""
    docs, back = set_aside(docs, "_key", "k_id", "k_key", "times", "size")
    found = materialise(similarity_classes(docs), "similar")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    stay = stay.groupBy(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_key")).agg(F.count("*").alias("times"), F.max("n_shingles").alias("size"))
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    stay = materialise(stay, "stay")
    repeated = stay.where("times > 1 and size > 0")
    if stay.count() <= BROADCAST_ROWS:
        stay = F.broadcast(stay)
    out = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["k_id"]) & (keyed["_key"] == stay["k_key"]), "left_semi")
    if not repeated.isEmpty():  # rows that repeat an id and its text
        on = out["doc_id"].eqNullSafe(repeated["k_id"]) & (out["_key"] == repeated["k_key"])
        out = out.join(repeated, on, "left_anti").union(out.join(repeated, on, "left_semi").dropDuplicates(["doc_id", "_key"]))
    return back(out.drop("_key"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT r, array_to_string(w[s:s + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s FROM w WHERE len(w) > 0)
), n AS (
  SELECT r, count(*) AS n FROM sh GROUP BY r
), c AS (
  SELECT a.r AS a, b.r AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), reach AS (
  SELECT r AS a, r AS b FROM w UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(o.doc_id) AS component_id FROM reach JOIN w o ON reach.b = o.r GROUP BY 1) m USING (r)
"""
