"""Secret scans: fixed patterns, and runs that look more random than like identifiers.

Two first-order Markov models over characters, one of random strings and one of ordinary
identifiers, are trained from labelled samples. A run of 20 or more key characters is a
secret if the log-likelihood ratio of its transitions passes a threshold and no fixed
pattern covers any of it. Everything runs as DataFrame expressions.

Defined cases: a null text counts as empty and has no spans; positions are code points, the
end is exclusive, and a span covers the whole match; overlapping spans of different kinds
are all reported; without samples of both labels every ratio is 0 and only the fixed
patterns report; repeated documents give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, table

#: kind -> pattern, in the order in which spans at the same place are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Least log-likelihood ratio of a secret: random must be a thousand times as likely.
LEAST_RATIO = math.log(1000)
#: Weight of a character's own frequency against its transitions.
BACK_OFF = 5.0
#: Bounds of the labelled samples: random strings made, and documents whose words serve as identifiers.
RANDOM_STRINGS, SAMPLE_DOCS = 20_000, 400

_ADDED = ("n_assign", "n_access", "n_hex", "base_spans", "span_list", "_t", "_assign", "_values", "_access", "_hex", "_runs")
_SPAN = "array<struct<start:bigint,order:int,end:bigint,kind:string>>"


def labelled_samples(docs: DataFrame, random_strings: int = RANDOM_STRINGS, sample_docs: int = SAMPLE_DOCS, seed: int = 7) -> DataFrame:
    """(text, label): 1 for strings made of digests in three spellings, 0 for identifiers made of the words of
    the ``sample_docs`` documents with the smallest hashed ids (outside what the fixed patterns match)."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary"), 256)
    spelled = F.array(digest, F.base64(F.unhex(digest)), F.upper(F.translate(F.base64(F.unhex(digest)), "+/=", "")))
    random = spark.range(random_strings).select(F.element_at(spelled, (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit(1).alias("label"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_docs)
    plain = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ").alias("text"))
    word = plain.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), 0)).alias("w")).distinct()
    w = F.col("w")
    spelled = F.array(w, F.upper(w), F.lower(w), F.concat(F.lower(w), F.lit("_"), F.lower(w)), F.concat(F.upper(w), F.lit("_"), F.upper(w)), F.concat(F.lower(w), F.initcap(w)), F.concat(F.lower(w), F.lit("-"), F.length(w)), F.concat(F.lit("/"), w, F.lit("/"), F.lower(w)))
    ordinary = word.select(F.explode(spelled).alias("text"), F.lit(0).alias("label"))
    numbers = spark.range(1000).select(F.concat_ws("-", F.col("id") + 1200, F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0")).alias("text"), F.lit(0).alias("label"))
    return random.unionByName(ordinary).unionByName(numbers)


def train(samples: DataFrame) -> list[float]:
    """The log-likelihood ratio of each transition, row by row of ALPHABET; a character's own frequency stands
    in for BACK_OFF transitions. What reaches the driver is bounded by the square of the alphabet."""
    chars = samples.select("label", F.regexp_replace("text", r"[^A-Za-z0-9+/_=-]", "").alias("s")).where("length(s) > 1")
    pairs = chars.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("pair"))
    counts = {(r.label, r.pair): r.n for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    if {label for label, _ in counts} != {0, 1}:
        return [0.0] * len(ALPHABET) ** 2
    totals = {(label, a): sum(counts.get((label, a + b), 0) for b in ALPHABET) for label in (0, 1) for a in ALPHABET}
    ends = {(label, b): sum(counts.get((label, a + b), 0) for a in ALPHABET) for label in (0, 1) for b in ALPHABET}
    every = {label: sum(totals[label, a] for a in ALPHABET) for label in (0, 1)}

    def log(label: int, a: str, b: str) -> float:
        alone = (ends[label, b] + 0.5) / (every[label] + 0.5 * len(ALPHABET))
        return math.log((counts.get((label, a + b), 0) + BACK_OFF * alone) / (totals[label, a] + BACK_OFF))

    return [round(log(1, a, b) - log(0, a, b), 6) for a in ALPHABET for b in ALPHABET]


def _ratio(run: Column, ratios: list[float]) -> Column:
    """Sum of the transitions' ratios over a run of ALPHABET."""
    lookup = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    step = lambda acc, p: F.struct(p.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.get(lookup, acc["last"] * len(ALPHABET) + p))).alias("sum"))
    return F.aggregate(places, start, step, lambda acc: acc["sum"])


def _placed(text: Column, pattern: str, matches: Column, kind: str, also: Column | None = None) -> Column:
    """Spans of the matches, whose places follow from the lengths of what lies between them. ``also``: keep[i] per match."""
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("bigint")).alias("gap"),
        F.transform(matches, lambda m: F.length(m).cast("bigint")).alias("size"),
        (F.transform(matches, lambda m: F.lit(True)) if also is None else also).alias("keep"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        end = begin + F.coalesce(p["size"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(p["keep"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    found = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(F.size(matches) == 0, F.array().cast(_SPAN)).otherwise(found)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, ratios: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_spans and span_list (arrays by start, then kind). One row in,
    one row out; columns of these names in ``docs`` are replaced."""
    docs = docs.drop(*_ADDED)
    text = F.coalesce(F.col("text"), F.lit(""))
    work = docs.withColumn("_t", text).withColumns({
        "_assign": F.regexp_extract_all("_t", F.lit(ASSIGN), 0),
        "_values": F.regexp_extract_all("_t", F.lit(ASSIGN), 2),
        "_access": F.regexp_extract_all("_t", F.lit(ACCESS), 0),
        "_hex": F.regexp_extract_all("_t", F.lit(HEX), 0),
        "_runs": F.regexp_extract_all("_t", F.lit(RUN), 0),
    })
    t = F.col("_t")
    work = work.withColumns({
        "_assign": _placed(t, ASSIGN, F.col("_assign"), "assign", F.transform("_values", lambda v: F.length(v) >= 8)),
        "_access": _placed(t, ACCESS, F.col("_access"), "access"),
        "_hex": _placed(t, HEX, F.col("_hex"), "hex"),
        "_runs": _placed(t, RUN, F.col("_runs"), "markov", F.transform("_runs", lambda r: _ratio(r, ratios) >= least)),
    })
    work = work.withColumn("base_spans", F.array_sort(F.concat("_assign", "_access", "_hex")))
    free = F.filter("_runs", lambda r: ~F.exists("base_spans", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    work = work.withColumns({
        "n_assign": F.size("_assign").cast("bigint"), "n_access": F.size("_access").cast("bigint"), "n_hex": F.size("_hex").cast("bigint"),
        "span_list": F.array_sort(F.concat("base_spans", free)),
    })
    return work.drop("_t", "_assign", "_values", "_access", "_hex", "_runs")


def redact(docs: DataFrame, ratios: list[float], mark: str = "[secret]") -> DataFrame:
    """The columns of ``docs``, each secret span of ``text`` replaced by ``mark`` (overlapping spans by one);
    ``n_chars``, if there, follows the new text. Texts without secrets stay as they are."""
    docs, back = set_aside(docs, *_ADDED)
    columns, text = docs.columns, F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("span_list", start, step, lambda acc: F.concat(acc["out"], text.substr((acc["at"] + 1).cast("int"), F.length(text))))
    found = scan(docs, ratios)
    out = found.withColumn("text", F.when(F.size("span_list") > 0, clean).otherwise(text))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.size("span_list") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(out.select(*columns))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs.select("doc_id", "text"), train(labelled_samples(docs)))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spelled(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("span_list")).alias("spans"))
