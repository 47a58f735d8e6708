"""Queries over HTML tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound, html_escape
from ..operators import markup as M
from ..sources import adapt


def _marked(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose lines stand in tables of three: a head over two columns, two rows of cells; a page marker before every seventh table.
    All of a document is made within its row, without a shuffle."""

    def part(own: Column, i: Column) -> Column:
        cell = lambda k: F.coalesce(F.get(own, F.lit(k)), F.lit(""))
        mark = F.when(i % 21 == 0, F.concat(F.lit("<!-- page: "), (i / 21 + 1).cast("int"), F.lit(" -->\n"))).otherwise("")
        table = F.concat(
            F.lit('<TABLE class="x"><tr><th colspan="2">'), cell(0), F.lit("&#38;<br/>&#x3b1;&nope;</th></tr>\n<tr></tr><tr><td>lost<td rowspan='2'> a|b\t"), cell(1), F.lit(" <b>x</b></td><td>2</td><td colspan=zz>3</TD></tr><tr><td>"), cell(2), F.lit("</td></tr><tr><td>open</tr></table>"),
        )
        return F.concat(mark, F.lit("before "), table, F.lit(" after"))

    def parts(lines: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(lines) - 1, F.lit(3)), lambda i: bound(F.slice(lines, i + 1, 3), lambda own: part(own, i)))

    escaped = F.split(html_escape(F.col("text")), "\n")
    return adapt.table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(bound(escaped, parts), "\n").alias("markdown"))


def k18_display_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).select("doc_id", F.md5(M.display_markdown(F.col("markdown"))).alias("shown_md5"))


def w19_grid_columns(spark: SparkSession, d: str) -> DataFrame:
    cells = M.html_cells(_marked(spark, d), "markdown", "doc_id").withColumn("text_md5", F.md5("text")).drop("text")  # no text is shuffled
    return M.grid_columns(cells, "doc_id", "table_no").select("doc_id", "table_no", "row", "col", "tag", "row_span", "col_span", "text_md5")


def w19_placed_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order as cells of rows of three, with spans by their keys."""
    x = adapt.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    x = x.select("l_orderkey", F.expr("cast((l_linenumber - 1) div 3 + 1 as int)").alias("row"), F.col("l_linenumber").cast("int").alias("ord"), F.expr("cast(1 + p % 3 as int)").alias("row_span"), F.expr("cast(1 + p div 3 % 2 as int)").alias("col_span"))
    return M.grid_columns(x, "l_orderkey")


QUERIES = {f.__name__: f for f in (k18_display_markdown, w19_grid_columns, w19_placed_lines)}

_TRIM = r"'^[\s\x0b\x1c-\x1f\x85\p{Z}]+|[\s\x0b\x1c-\x1f\x85\p{Z}]+$', '', 'g'"
_SPACE = r"regexp_replace(regexp_replace({}, '[\s\x0b\x1c-\x1f\x85\p{{Z}}]+', ' ', 'g'), '^ | $', '', 'g')"
_TABLES = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  t AS (SELECT doc_id, pos // 3 AS t, coalesce(max(line) FILTER (WHERE pos % 3 = 0), '') AS a, coalesce(max(line) FILTER (WHERE pos % 3 = 1), '') AS b, coalesce(max(line) FILTER (WHERE pos % 3 = 2), '') AS c FROM l GROUP BY 1, 2),
  x AS (SELECT doc_id, t, {_SPACE.format("a || '& α&nope;'")} AS a, {_SPACE.format("' a|b' || chr(9) || b || ' x'")} AS b, {_SPACE.format("c")} AS c FROM t)"""
_PIPE = "replace({}, '|', '\\|')"
ORACLES = {
    "k18_display_markdown": _TABLES + f""", m AS (SELECT doc_id, string_agg(CASE WHEN t % 7 = 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || '#### Page ' || (t // 7 + 1) || chr(10) || chr(10) ELSE '' END || 'before ' || chr(10) || chr(10) ||
          '| ' || {_PIPE.format("a")} || ' |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || {_PIPE.format("b")} || ' | 2 | 3 |' || chr(10) || '| ' || {_PIPE.format("c")} || ' |  |  |' || chr(10) || chr(10) || ' after', chr(10) ORDER BY t) AS m FROM x GROUP BY doc_id)
        SELECT doc_id, md5(regexp_replace(m, {_TRIM})) AS shown_md5 FROM m""",
    "w19_grid_columns": _TABLES + """, v AS (SELECT doc_id, t, unnest([{'row': 1, 'col': 1, 'tag': 'th', 'rs': 1, 'cs': 2, 'text': a}, {'row': 3, 'col': 1, 'tag': 'td', 'rs': 2, 'cs': 1, 'text': b}, {'row': 3, 'col': 2, 'tag': 'td', 'rs': 1, 'cs': 1, 'text': '2'},
          {'row': 3, 'col': 3, 'tag': 'td', 'rs': 1, 'cs': 1, 'text': '3'}, {'row': 4, 'col': 2, 'tag': 'td', 'rs': 1, 'cs': 1, 'text': c}]) AS v FROM x)
        SELECT doc_id, cast(t + 1 AS int) AS table_no, cast(v.row AS int) AS row, cast(v.col AS int) AS col, v.tag AS tag, cast(v.rs AS int) AS row_span, cast(v.cs AS int) AS col_span, md5(v.text) AS text_md5 FROM v""",
    "w19_placed_lines": """WITH RECURSIVE x AS (SELECT l_orderkey, cast((l_linenumber - 1) // 3 + 1 AS int) AS row, cast(l_linenumber AS int) AS ord, cast(1 + min(l_partkey) % 3 AS int) AS row_span, cast(1 + min(l_partkey) // 3 % 2 AS int) AS col_span,
          row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
        f AS (SELECT DISTINCT l_orderkey, cast(0 AS bigint) AS n, cast([] AS bigint[]) AS taken, cast(0 AS bigint) AS col FROM x UNION ALL
          SELECT x.l_orderkey, x.n, list_concat(taken, list_transform(generate_series(p.col, p.col + col_span - 1), lambda c: c * 1000 + row + row_span - 1)), p.col FROM f JOIN x ON x.l_orderkey = f.l_orderkey AND x.n = f.n + 1,
          LATERAL (SELECT list_min(list_filter(generate_series(1, 40), lambda c: len(list_filter(taken, lambda k: k // 1000 = c AND k % 1000 >= row)) = 0)) AS col) p)
        SELECT l_orderkey, row, ord, row_span, col_span, cast(col AS int) AS col FROM f JOIN x USING (l_orderkey, n)""",
}
