"""Queries over text, retrieval and published artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import adjudicate as A
from ..operators import publish as P
from ..operators import retrieval as R
from ..sources import adapt
from ..sources.adapt import BLOCKS_SQL

QUERY = "what is the order of the state"
_TERMS = ("order", "state")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return adapt.table(spark, d, "documents")


def _excerpts(spark: SparkSession, d: str) -> DataFrame:
    return R.excerpts(adapt.markdown(_docs(spark, d)))


def x10_tokenize(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select("doc_id", T.search_terms(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"))


def a08_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    w = _docs(spark, d).select("lang", F.explode(T.search_terms(F.col("text"))).alias("term"))
    return w.groupBy("lang", "term").agg(F.count("*").alias("n"))


def w16_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return _excerpts(spark, d).select("doc_id", "excerpt_no", "page", "heading", F.length("excerpt").cast("bigint").alias("n_chars"))


def t01_lexical_score(spark: SparkSession, d: str) -> DataFrame:
    return R.scored(_excerpts(spark, d), "section the order 2 and").select("doc_id", "excerpt_no", "score")


def t02_fair_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.fair_topk(R.scored(_excerpts(spark, d), "section 7 of that"), 12)


def t03_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.stratified(_excerpts(spark, d), 4).select("doc_id", "excerpt_no")


def t04_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return R.retrieve(adapt.markdown(_docs(spark, d)), "section 7 of that").select("rank", "doc_id", "excerpt_no")


def w11_budget_fill(spark: SparkSession, d: str) -> DataFrame:
    x = _excerpts(spark, d).withColumn("n_chars", F.length("excerpt"))
    return R.within_budget(x, "doc_id", "excerpt_no", "n_chars", 2_000)


def w14_recent_history(spark: SparkSession, d: str) -> DataFrame:
    return R.recent_history(adapt.table(spark, d, "conversations")).select("conv_id", "turn", "role")


def u01_ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    return R.ordered_dedup(adapt.blocks(_docs(spark, d)).select("doc_id", "ord", F.md5("text").alias("line")), "doc_id", "line", "ord")


def k01_document_markdown(spark: SparkSession, d: str) -> DataFrame:
    x = P.document_markdown(adapt.blocks(_docs(spark, d)))
    return x.select("doc_id", F.length("markdown").cast("bigint").alias("n_chars"), "document_key")


def k05_table_markup(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda c: F.col(c).cast("string")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(cell("l_linenumber"), cell("l_partkey"), F.concat(F.lit("<"), F.col("l_returnflag"), F.lit("&|")), F.col("l_linestatus")).alias("cells"))))
    x = adapt.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["cells"]).alias("rows"))
    return x.select("l_orderkey", F.md5(P.html_table(F.col("rows"))).alias("html_md5"), F.md5(P.pipe_table(F.col("rows"))).alias("pipe_md5"))


def k08_markup_containment(spark: SparkSession, d: str) -> DataFrame:
    b = adapt.blocks(_docs(spark, d))
    marks = b.where("ord % 5 = 0 and length(text) between 1 and 60").select("doc_id", F.col("text").alias("markup"))
    return P.markup_short(marks, _docs(spark, d).select("doc_id", "text"))


def k10_artifact_entry(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d).select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("name"), F.when(F.col("doc_id") % 10 != 0, F.col("text")).alias("content"))
    return P.artifact_entries(x, "name", "content")


def k13_page_manifest(spark: SparkSession, d: str) -> DataFrame:
    b = adapt.blocks(_docs(spark, d))
    pages = b.where("page % 2 = 1").groupBy("doc_id", "page").agg(F.count("*").alias("n_blocks"))
    return P.page_manifest(b.select("doc_id", "page").distinct(), pages)


def k17_resume(spark: SparkSession, d: str) -> DataFrame:
    work = _docs(spark, d).select(F.concat(F.lit("doc"), "doc_id").alias("stem"))
    done = work.join(adapt.blocks(_docs(spark, d)).select(F.concat(F.lit("doc"), "doc_id").alias("stem"), F.concat(F.lit("f"), F.col("ord") % 5).alias("name")), "stem")
    return P.not_done(work, done, 5)


def k18_names(spark: SparkSession, d: str) -> DataFrame:
    p = adapt.table(spark, d, "pages")
    return p.select("page_id", T.safe_name(F.col("url")).alias("safe"), T.output_name(F.col("url"), "_out.md").alias("output"))


def x08_html_escape(spark: SparkSession, d: str) -> DataFrame:
    return adapt.table(spark, d, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped_md5"), F.md5(T.compact_json_safe(F.col("html"))).alias("json_md5"))


def f09_quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    bench = adapt.table(spark, d, "benchmark")
    n = bench.count()
    x = _docs(spark, d).withColumn("item_id", F.col("doc_id") % n).join(bench.select("item_id", F.col("text").alias("quote")), "item_id")
    return A.ground_quotes(x.select("doc_id", "item_id", "quote"), _docs(spark, d), "doc_id").select("doc_id", "item_id", "grounded", "warning")


def f11_block_evidence(spark: SparkSession, d: str) -> DataFrame:
    b = adapt.blocks(_docs(spark, d))
    e = b.where("ord % 3 = 0").select("doc_id", F.when(F.expr("ord % 2 = 0"), F.col("page")).otherwise(F.col("page") + F.expr("cast(ord % 9 div 6 as int)")).alias("page"), "block_id", "ord", F.substring("text", 2, 12).alias("quote"))
    return A.block_evidence(e, b).select("doc_id", "block_id", "grounded")


QUERIES = {f.__name__: f for f in (x10_tokenize, a08_term_frequencies, w16_excerpts, t01_lexical_score, t02_fair_topk, t03_stratified_sample, t04_retrieve, w11_budget_fill, w14_recent_history, u01_ordered_dedup, k01_document_markdown, k05_table_markup, k08_markup_containment, k10_artifact_entry, k13_page_manifest, k17_resume, k18_names, x08_html_escape, f09_quote_grounding, f11_block_evidence)}

_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_FOLD = lambda c: f"lower(replace({c}, 'ß', 'ss'))"
_WORDS = lambda c: rf"regexp_extract_all({_FOLD(c)}, '[\p{{L}}\p{{N}}_]+')"
#: Each line opens a new excerpt at a page or heading line; so an excerpt is a run of lines.
EXCERPTS_SQL = r"""md_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents
), md_parts AS (
  SELECT doc_id, i, CASE WHEN i % 40 = 0 AND i % 11 <> 0 THEN 1 WHEN i % 11 = 0 THEN 1 ELSE 0 END AS opens, CAST(i // 40 + 1 AS integer) AS page, i % 11 = 0 AS heads, i // 11 + 1 AS section, line FROM md_lines
), md_runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM md_parts
), md_joined AS (
  SELECT doc_id, run, min(page) AS page, CASE WHEN bool_or(heads) THEN 'Section ' || min(section) FILTER (WHERE heads) END AS heading,
    regexp_replace(CASE WHEN bool_or(heads) THEN '# Section ' || min(section) FILTER (WHERE heads) || chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY i), '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS whole
  FROM md_runs GROUP BY doc_id, run
), md_cut AS (
  SELECT doc_id, run, page, heading, regexp_replace(whole[p * 3000 + 1:p * 3000 + 3000], '^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g') AS excerpt, p
  FROM (SELECT *, unnest(generate_series(0, greatest(0, (length(whole) - 1) // 3000))) AS p FROM md_joined)
), excerpts AS (
  SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY run, p) AS integer) AS excerpt_no, page, heading, excerpt FROM md_cut WHERE excerpt <> ''
)"""


def _score_sql(query: str, wanted: list[tuple[str, int]]) -> str:
    one = lambda t: f"len(list_filter(w, lambda x: x = '{t}')) + 2 * len(list_filter(h, lambda x: x = '{t}'))"
    return (
        f"scored AS (SELECT *, {' + '.join(f'{n} * ({one(t)})' for t, n in wanted)} + CASE WHEN contains({_FOLD('excerpt')}, '{query}') THEN 5 ELSE 0 END AS score "
        f"FROM (SELECT *, {_WORDS('excerpt')} AS w, {_WORDS(chr(39) * 2 + ' || coalesce(heading, ' + chr(39) * 2 + ')')} AS h FROM excerpts))"
    )


_T2 = """, best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(excerpt), excerpt_no) = 1),
  every AS (SELECT doc_id, excerpt_no, score, length(excerpt) AS n_chars, 0 AS turn FROM best UNION ALL
    SELECT doc_id, excerpt_no, score, length(excerpt), 1 FROM scored s WHERE score > 0 AND NOT EXISTS (SELECT 1 FROM best b WHERE b.doc_id = s.doc_id AND b.excerpt_no = s.excerpt_no)),
  ranked AS (SELECT *, row_number() OVER (ORDER BY turn, CASE WHEN turn = 1 THEN -score END, CASE WHEN turn = 1 THEN n_chars END, doc_id, excerpt_no) AS rank FROM every)"""
_STRIPPED = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'"
ORACLES = {
    "x10_tokenize": f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, list_filter({_WORDS('text')}, lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents)",
    "a08_term_frequencies": f"SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest({_WORDS('text')}) AS term FROM documents) WHERE NOT list_contains({_STOP}, term) GROUP BY ALL",
    "w16_excerpts": "WITH " + EXCERPTS_SQL + " SELECT doc_id, excerpt_no, page, heading, length(excerpt) AS n_chars FROM excerpts",
    "t01_lexical_score": "WITH " + EXCERPTS_SQL + ", " + _score_sql("section the order 2 and", [("2", 1), ("order", 1), ("section", 1)]) + " SELECT doc_id, excerpt_no, score FROM scored",
    "t02_fair_topk": "WITH " + EXCERPTS_SQL + ", " + _score_sql("section 7 of that", [("7", 1), ("section", 1), ("that", 1)]) + _T2 + " SELECT doc_id, excerpt_no, score, n_chars, cast(rank AS integer) AS rank FROM ranked WHERE rank <= 12",
    "t03_stratified_sample": "WITH " + EXCERPTS_SQL + """, n AS (SELECT doc_id, max(excerpt_no) AS n FROM excerpts GROUP BY 1), p AS (
        SELECT DISTINCT doc_id, CASE WHEN n <= 4 THEN i + 1 ELSE cast(round_even(i * (n - 1) / 3, 0) AS integer) + 1 END AS excerpt_no, n FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM n))
        SELECT doc_id, cast(excerpt_no AS integer) AS excerpt_no FROM p WHERE excerpt_no <= n""",
    "t04_retrieve": "WITH " + EXCERPTS_SQL + ", " + _score_sql("section 7 of that", [("7", 1), ("section", 1), ("that", 1)]) + _T2 + " SELECT cast(rank AS integer) AS rank, doc_id, excerpt_no FROM ranked WHERE rank <= 12",
    "w11_budget_fill": "WITH RECURSIVE " + EXCERPTS_SQL + """, fill AS (
        SELECT doc_id, 0 AS no, cast(0 AS bigint) AS used, 0 AS taken, false AS took FROM (SELECT DISTINCT doc_id FROM excerpts) UNION ALL
        SELECT e.doc_id, e.excerpt_no, used + CASE WHEN taken < 12 AND used + length(excerpt) <= 2000 THEN length(excerpt) ELSE 0 END, taken + CASE WHEN taken < 12 AND used + length(excerpt) <= 2000 THEN 1 ELSE 0 END,
          taken < 12 AND used + length(excerpt) <= 2000 FROM fill f JOIN excerpts e ON e.doc_id = f.doc_id AND e.excerpt_no = f.no + 1),
        total AS (SELECT doc_id, max(used) AS used FROM fill GROUP BY 1)
        SELECT doc_id, used, CASE WHEN took THEN cast(no AS bigint) END AS excerpt_no FROM total JOIN fill USING (doc_id, used) WHERE used = 0 AND no = 0 AND NOT EXISTS (SELECT 1 FROM fill g WHERE g.doc_id = fill.doc_id AND g.took)
        UNION ALL SELECT t.doc_id, t.used, cast(f.no AS bigint) FROM total t JOIN fill f ON f.doc_id = t.doc_id WHERE f.took""",
    "w14_recent_history": "SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6",
    "u01_ordered_dedup": "WITH " + BLOCKS_SQL + " SELECT doc_id, md5(text) AS line, cast(min(ord) AS integer) AS first_ord FROM blocks GROUP BY ALL",
    "k01_document_markdown": "WITH " + BLOCKS_SQL + """, p AS (SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS body FROM blocks GROUP BY ALL),
        m AS (SELECT doc_id, string_agg(body, chr(10) || chr(10) || '<!-- PAGE BREAK -->' || chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY 1)
        SELECT doc_id, length(markdown) AS n_chars, sha256(markdown)[1:20] AS document_key FROM m""",
    "k05_table_markup": r"""WITH c AS (SELECT l_orderkey, l_linenumber, [cast(l_linenumber AS varchar), cast(l_partkey AS varchar), '<' || l_returnflag || '&|', l_linestatus] AS c, 0 AS z FROM lineitem),
        n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, c) AS i FROM c), r AS (SELECT *, CASE WHEN i = 1 THEN 'th' ELSE 'td' END AS tag FROM n),
        s AS (SELECT *, '<tr>' || list_aggregate(list_transform(c, lambda x: '<' || tag || '>' || replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || tag || '>'), 'string_agg', '') || '</tr>' AS h,
          '| ' || list_aggregate(list_transform(c, lambda x: replace(x, '|', '\|')), 'string_agg', ' | ') || ' |' || CASE WHEN i = 1 THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END AS p FROM r)
        SELECT l_orderkey, md5('<table>' || string_agg(h, '' ORDER BY i) || '</table>') AS html_md5, md5(string_agg(p, chr(10) ORDER BY i)) AS pipe_md5 FROM s GROUP BY 1""",
    "k08_markup_containment": "WITH " + BLOCKS_SQL + """, m AS (SELECT doc_id, text AS markup, count(*) AS wanted FROM blocks WHERE ord % 5 = 0 AND length(text) BETWEEN 1 AND 60 GROUP BY ALL),
        f AS (SELECT m.*, (length(d.text) - length(replace(d.text, markup, ''))) // length(markup) AS found FROM m JOIN documents d USING (doc_id)) SELECT * FROM f WHERE found < wanted""",
    "k10_artifact_entry": """SELECT doc_id, 'doc-' || doc_id || '.md' AS name, CASE WHEN doc_id % 10 <> 0 THEN cast(strlen(text) AS bigint) END AS bytes, CASE WHEN doc_id % 10 <> 0 THEN sha256(text) END AS sha256, doc_id % 10 <> 0 AND text IS NOT NULL AS generated FROM documents""",
    "k13_page_manifest": "WITH " + BLOCKS_SQL + " SELECT doc_id, page, CASE WHEN page % 2 = 1 THEN count(*) ELSE 0 END AS n_blocks, CASE WHEN page % 2 = 1 THEN 'parsed' ELSE 'missing' END AS status FROM blocks GROUP BY doc_id, page",
    "k17_resume": "WITH " + BLOCKS_SQL + " SELECT 'doc' || doc_id AS stem FROM blocks GROUP BY doc_id HAVING count(DISTINCT ord % 5) < 5",
    "k18_names": r"""SELECT page_id, regexp_replace(regexp_replace(url, '[^\p{L}\p{N}_-]', '-', 'g'), '^-+|-+$', '', 'g')[1:80] AS safe, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') || '_out.md' AS output FROM pages""",
    "x08_html_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5, md5(replace(replace(replace(html, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e')) AS json_md5 FROM pages""".replace("\\\\u", "\\u"),
    "f09_quote_grounding": """WITH n AS (SELECT count(*) AS n FROM benchmark), q AS (SELECT d.doc_id, b.item_id, b.text AS quote, d.text FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.n)
        SELECT doc_id, item_id, coalesce(contains(text, quote), false) AS grounded, CASE WHEN text IS NULL THEN 'unknown_source' WHEN NOT contains(text, quote) THEN 'quote_mismatch' END AS warning FROM q""",
    "f11_block_evidence": "WITH " + BLOCKS_SQL + """, e AS (SELECT *, CASE WHEN ord % 2 = 0 THEN page ELSE page + (ord % 9) // 6 END AS said, text[2:13] AS quote FROM blocks WHERE ord % 3 = 0)
        SELECT doc_id, block_id, said = page AND contains(text, quote) AS grounded FROM e""",
}
