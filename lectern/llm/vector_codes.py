"""Vector code compression: product codes by exact integer distances, filtered by segment means.

A vector is cut into equal parts; each part is replaced by the number of the nearest entry of
its position's codebook. Entries are ruled out by lower bounds of the distance: with the part
cut into segments of length L, means m and residual norms r of a vector x and an entry c give

    |x - c|^2  >=  sum over segments of  L (m_x - m_c)^2 + (r_x - r_c)^2

first for one segment, then for four times as many, on what is left. A bound is lowered by more
than the rounding error of doubles before it rules an entry out; what survives gets its exact
distance in 64-bit integers, of equal ones the entry with the lowest number stays.

Codebooks start as the first vectors by id and are moved for some rounds: tasks add up the
parts of each entry, Spark adds up what the tasks found, the driver holds the codebooks only.

Defined cases: rows whose vector is null or holds null, NaN or infinite components are left
out; a null id comes after all others; vectors with the same id are taken in ascending order;
repeated rows are coded as often as they occur; with fewer vectors than entries codebooks are
smaller; an empty table gives an empty result; other columns do not matter, but one to keep
may not be named like an output (ValueError). Vectors of
different lengths, of a length that the parts do not divide, or with integer components whose
squared distances do not fit 64 bits raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
#: Sums of a part travel in rows of so many positions.
CHUNK = 16
#: Parts that are compared with a codebook at once.
ROWS = 256
#: Share by which bounds are lowered; the rounding error of the doubles that they are made of is below a thousandth of it.
MARGIN = 1e-11
#: Error totals of up to so many labels are broadcast, more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def whole(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))


def integers(column: pa.Array, length: int | None = None) -> np.ndarray:
    """floor(1024 x) of every component, a row a vector."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if length is None:
        length = int(lengths[0]) if len(lengths) else 0
    if (lengths != length).any():
        raise ValueError("vectors differ in length")
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(len(lengths), length)
    if x.size and 4 * length * float(np.abs(x).max()) ** 2 >= 2.0**62:
        raise ValueError("components are too large for exact 64-bit distances")
    return x.astype(np.int64)


def levels_of(width: int) -> list[np.ndarray]:
    """Where segments begin: one segment, then eight times as many while they hold two positions or more."""
    out, n = [], 1
    while width and (n == 1 or width // n >= 2):
        out.append(np.arange(n) * width // n)
        n *= 8
    return out


def summary(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Of each row and segment: sum over sqrt(L), so that squared differences are L (m - m)^2, and the residual norm."""
    size = np.diff([*begin, x.shape[1]])
    total, squares = np.add.reduceat(x, begin, axis=1), np.add.reduceat(x * x, begin, axis=1)
    spread = (size * squares - total * total).astype(np.float64)  # exact before the division
    return np.hstack([total / np.sqrt(size), np.sqrt(np.maximum(spread, 0) / size)])


class Codebook:
    """The entries of one part position with the summaries of all levels."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int32)  # as integers() ensures, differences fit
        self.levels = [(begin, self._columns(summary(entries, begin))) for begin in levels_of(entries.shape[1])]
        self.bounded = self.tested = 0  # bounds and exact distances so far

    @staticmethod
    def _columns(s: np.ndarray) -> np.ndarray:
        return np.vstack([-2 * s.T, np.ones(len(s)), np.square(s).sum(1) * (1 - MARGIN) - 0.5])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` and its exact squared distance; of equals the lowest number."""
        entry, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        order = np.argsort(x.sum(1), kind="stable")  # rows of like mean go together, so that whole entries drop out for them
        for a in range(0, len(x) if self.levels else 0, ROWS):
            some = order[a : a + ROWS]
            entry[some], distance[some] = self._nearest(x[some])
        return entry, distance

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, live, reach, bound = np.arange(len(x)), np.arange(len(self.entries)), None, None
        small = x.astype(np.int32)
        for begin, entries in self.levels:
            if bound is not None:  # what is ruled out for all of these rows goes to no finer level
                live = live[(bound <= reach[:, None]).any(0)]
            own = summary(x, begin)
            own = np.hstack([own, np.square(own).sum(1, keepdims=True) * (1 - MARGIN), np.ones((len(x), 1))])
            bound = own @ (entries if len(live) == entries.shape[1] else entries[:, live])
            self.bounded += bound.size
            looks = self._exact(small, rows, live[bound.argmin(1)])
            reach = looks if reach is None else np.minimum(reach, looks)  # an entry beyond this distance cannot win
        row, place = np.nonzero(bound <= reach[:, None])
        entry = live[place]
        distance = self._exact(small, row, entry)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(distance, first)
        equal = np.flatnonzero(distance == np.repeat(least, np.diff([*first, len(row)])))
        pick = equal[np.flatnonzero(np.diff(row[equal], prepend=-1))]  # entries stand in ascending order
        return entry[pick], least

    def _exact(self, x: np.ndarray, row: np.ndarray, entry: np.ndarray) -> np.ndarray:
        self.tested += len(row)
        gap = x.take(row, 0)
        gap -= self.entries.take(entry, 0)
        return np.einsum("ij,ij->i", gap, gap, dtype=np.int64)


def parts_of(x: np.ndarray, parts: int) -> list[np.ndarray]:
    if x.shape[1] % parts:
        raise ValueError("the length of vectors is no multiple of the number of parts")
    return np.split(x, parts, axis=1)


def nearest_parts(x: np.ndarray, books: list[Codebook]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, its positions, entries, squared distances) of all rows."""
    for p, (part, book) in enumerate(zip(parts_of(x, len(books)), books)):
        yield p, part, *book.nearest(part)


def start(vectors: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the first ``entries`` vectors by id; that many rows reach the driver at most."""
    rows = vectors.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).select("embedding").toArrow()
    return parts_of(integers(rows["embedding"].combine_chunks()), parts) if rows.num_rows else []


def moved(vectors: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of the parts that are nearest to it; unused ones stay."""
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)
    size, width = codebooks[0].shape
    chunks = -(-width // CHUNK)
    columns = [f"s{j}" for j in range(CHUNK)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(c) for c in shared.value]
        n, total = np.zeros((len(books), size), np.int64), np.zeros((len(books), size, chunks * CHUNK), np.int64)
        for b in batches:
            x = integers(b.column("embedding"), width * len(books))
            for p, part, entry, _ in nearest_parts(x, books):
                n[p] += np.bincount(entry, minlength=size)
                np.add.at(total[p, :, :width], entry, part)
        part, entry, chunk = (i.ravel() for i in np.indices((len(books), size, chunks), np.int32))
        used = np.repeat(n.ravel(), chunks) > 0
        sums = total.reshape(-1, CHUNK)[used]
        yield pa.RecordBatch.from_arrays([pa.array(part[used]), pa.array(entry[used]), pa.array(chunk[used]), pa.array(np.repeat(n.ravel(), chunks)[used]), *map(pa.array, sums.T)], names=["part", "entry", "chunk", "n", *columns])

    sums = vectors.select("embedding").mapInArrow(work, "part int, entry int, chunk int, n bigint, " + ", ".join(f"{c} bigint" for c in columns))
    found = sums.groupBy("part", "entry", "chunk").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in columns)).toArrow()
    part, entry, chunk, n = (found[c].to_numpy() for c in ("part", "entry", "chunk", "n"))
    out = np.zeros((len(codebooks), size, chunks, CHUNK), np.int64)
    out[..., :] = np.pad(np.stack(codebooks), ((0, 0), (0, 0), (0, chunks * CHUNK - width))).reshape(out.shape)
    out[part, entry, chunk] = np.stack([found[c].to_numpy() for c in columns], 1).reshape(-1, CHUNK) // n[:, None]
    return list(out.reshape(len(codebooks), size, -1)[:, :, :width])


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position after all rounds; none for an empty table. One pass over the vectors a round."""
    vectors = vectors.where(whole(F.col("embedding")))
    codebooks = start(vectors, parts, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = moved(vectors, codebooks)
    return codebooks


def encode(vectors: DataFrame, codebooks: list[np.ndarray], *keep: str) -> DataFrame:
    """The columns ``keep`` with code (two hex digits a part, for up to 256 entries) and error. One row a whole vector."""
    keep = keep or ("vec_id",)
    if {c.lower() for c in keep} & {"code", "error"}:
        raise ValueError("columns to keep may not be named code or error")
    vectors = vectors.where(whole(F.col("embedding")))
    base = vectors.select(*dict.fromkeys([*keep, "embedding"]))
    shared = base.sparkSession.sparkContext.broadcast(codebooks)
    schema = ", ".join(f"`{base.schema[c].name}` {base.schema[c].dataType.simpleString()}" for c in keep) + ", code string, error bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(c) for c in shared.value]
        for b in batches:
            x = integers(b.column("embedding"), sum(c.entries.shape[1] for c in books) if books else None)
            code, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p, _, entry, distance in nearest_parts(x, books):
                code[:, p] = entry
                error += distance
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([bytes(c).hex() for c in code], pa.string()), pa.array(error)], names=[*keep, "code", "error"])

    return base.mapInArrow(work, schema)


def decode(codes: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """``codes`` with the vector of integers that each code stands for (integers)."""
    flat = [F.lit([[int(v) for v in e] for e in c.tolist()]) for c in codebooks]
    parts = [F.element_at(c, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, c in enumerate(flat)]
    return codes.withColumn("integers", F.concat(*parts).cast("array<bigint>"))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the sum of error over rows of equal label, null labels together."""
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    codebooks = train(vectors)
    coded = materialise(encode(vectors, codebooks, "vec_id", "label"), "codes")
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _round(k: int, last: bool) -> str:
    near = f"""
a{k} AS (
  SELECT r, p, entry, dist FROM (
    SELECT x.r, x.p, c.entry, list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist,
      row_number() OVER (PARTITION BY x.r, x.p ORDER BY dist, c.entry) AS place
    FROM parts x JOIN c{k} c ON c.p = x.p)
  WHERE place = 1
)"""
    if last:
        return near
    return f"""{near}, s{k} AS (
  SELECT p, entry, j, floor(sum(v[j]) / count(*)) AS mean, sum(v[j]) AS total, count(*) AS n
  FROM a{k} JOIN parts USING (r, p), generate_series(1, len(v)) AS g(j) GROUP BY p, entry, j
), m{k} AS (
  SELECT p, entry, list(cast((total - (((total % n) + n) % n)) // n AS bigint) ORDER BY j) AS v FROM s{k} GROUP BY p, entry
), c{k + 1} AS (SELECT p, entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (p, entry)),"""


ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda x: cast(floor(1024 * cast(x AS double)) AS bigint)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT r, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS v FROM kept, (SELECT unnest(range({PARTS})) AS p)
), c0 AS (SELECT p, r - 1 AS entry, v FROM parts WHERE r <= {ENTRIES}), {"".join(_round(k, False) for k in range(ROUNDS))} {_round(ROUNDS, True)}, coded AS (
  SELECT r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY p) AS code, cast(sum(dist) AS bigint) AS error FROM a{ROUNDS} GROUP BY r
), books AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, entry)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books
"""
