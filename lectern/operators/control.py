"""Sources and control tables: uploads, page ranges, layout results, gold data, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_PIXELS = 50 * 1024 * 1024, 25_000_000
JOB_TTL = 3_600
#: EXIF orientations that turn a picture, in degrees.
TURNS = {3: 180, 6: 90, 8: -90}


def ingest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256, kind, problem) of the files in a folder; the kind follows from the content, not the name.
    Files without content are not listed: the reader leaves them out."""
    raw = spark.read.format("binaryFile").load(folder)
    n = F.octet_length("content")
    kind = F.when(F.startswith("content", F.lit("%PDF-").cast("binary")), "pdf").otherwise("image")
    problem = F.when(n == 0, "empty").when(n > MAX_BYTES, "too_large")
    return raw.select("path", n.cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), problem.alias("problem"))


def turn(orientation: Column) -> Column:
    out = F.lit(0)
    for k, v in TURNS.items():
        out = F.when(orientation == k, v).otherwise(out)
    return out


def decoded(upload: Column) -> Column:
    """Bytes of a Base64 text; null where it is not valid."""
    return F.when(upload.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"), F.try_to_binary(upload, F.lit("base64")))


def page_list(pages: Column) -> Column:
    """Sorted, each page once."""
    return F.array_sort(F.array_distinct(pages))


def range_problem(start: Column, end: Column, total: Column) -> Column:
    return F.when(start < 1, "start_below_1").when(end < start, "end_before_start").when(end > total, "end_after_last")


def selected_pages(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pages of the selection, with the wanted ones that do not exist as problem "unknown_page"."""
    x = wanted.select("doc_id", "page").distinct().withColumn("_w", F.lit(True)).join(pages.select("doc_id", "page").distinct().withColumn("_p", F.lit(True)), ["doc_id", "page"], "left")
    return x.select("doc_id", "page", F.when(F.col("_p").isNull(), "unknown_page").alias("problem"))


def normalised_order(regions: DataFrame) -> DataFrame:
    """Raw region orders per page as dense ranks from 1."""
    from pyspark.sql.window import Window

    return regions.withColumn("order_no", F.when(F.col("raw_order").isNotNull(), F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy(F.col("raw_order").asc_nulls_last()))))


def pairing(files: DataFrame) -> DataFrame:
    """Stems (of stem, suffix) that lack one of the three files of a validation pair."""
    need = [".pdf", ".parse.json", ".parse.md"]
    have = files.groupBy("stem").agg(F.collect_set("suffix").alias("have")).where(F.array_contains("have", ".pdf"))
    gone = F.array_sort(F.array_except(F.array(*map(F.lit, need)), F.col("have")))
    return have.select("stem", F.array_join(gone, ",").alias("missing")).where("missing <> ''")


def job_states(events: DataFrame, now: Column) -> DataFrame:
    """Last state of each job (job, state, created, at) and whether its time is up."""
    last = events.groupBy("job").agg(F.max_by("state", F.struct("at", "seq")).alias("state"), F.min("at").alias("created"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))
    return last.withColumn("expired", age >= JOB_TTL * 1_000_000)
