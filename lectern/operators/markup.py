"""HTML tables read from text: cells as rows, pipe tables in their place, columns of cells under spans.

Reading is a scan by patterns within the row of a text: tables, in them closed rows, in them
closed cells; a tag that opens again before it is closed begins anew. Defined cases: tables
without rows become nothing; nested tables are not looked for; null texts have no cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, strip
from ..sources.stage import in_turn

#: Patterns of tables, closed rows and cells, of character references, of page markers, and named characters.
TABLE, ROW, CLOSED = r"(?is)<table\b[^>]*>.*?</table\s*>", r"(?i)<tr\b", r"(?is)^[^>]*>(.*?)</tr\s*>"
CELL, OPENED = r"(?is)<t[dh]\b.*?</t[dh]\s*>", r"(?is)^.*<(t[dh]\b[^>]*>.*?)</t[dh]\s*>$"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]+);"
PAGE_MARKER, PAGE_HEADING = r"(?i)<!--\s*page\s*:\s*(\d+)\s*-->", "\n\n---\n\n#### Page {}\n"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def _character(reference: Column) -> Column:
    """The character that a reference (&amp;, &#38;, &#x26;) stands for; the reference itself if it is not known."""
    return bound(F.regexp_extract(reference, "^&(.*);$", 1), lambda name: _named_character(name, reference))


def _named_character(name: Column, reference: Column) -> Column:
    code = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).when(F.startswith(name, F.lit("#")), F.substr(name, F.lit(2))).try_cast("int")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    out = F.when(F.startswith(name, F.lit("#")) & valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    for word, character in NAMED.items():
        out = out.when(name == word, character)
    return out.otherwise(reference)


def unescaped(text: Column) -> Column:
    """The text with its character references resolved, each once."""
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), 0), _character)
    pairs = F.zip_with(F.split(text, REFERENCE, -1), found, lambda plain, c: F.concat(plain, F.coalesce(c, F.lit(""))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(pairs, "")).otherwise(text)


def cell_text(markup: Column) -> Column:
    """What a cell shows, in one line: line breaks are spaces, other tags nothing."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?i)<br\b[^>]*>", " "), r"(?s)<[^>]*>", "")
    return bound(bare, lambda b: strip(F.regexp_replace(unescaped(b), r"(?U)\s+", " ")))


def _span(attributes: Column, name: str) -> Column:
    """A span of at least 1; 1 where it is no whole number."""
    value = F.regexp_extract(attributes, rf"(?i)(?:^|\s){name}\s*=\s*[\"']?\s*\+?([0-9]+)\s*(?:[\"'\s]|$)", 1)
    number = bound(value, lambda v: F.when(v != "", v.try_cast("int")))  # a cast that fails costs more than the rest
    return F.when(attributes == "", 1).otherwise(F.greatest(F.lit(1), F.coalesce(number, F.lit(1))))


def _rows(table: Column) -> Column:
    """The inner markup of a table's closed rows."""
    return F.flatten(F.transform(F.filter(F.split(table, ROW, -1), lambda _, i: i > 0), lambda r: F.regexp_extract_all(r, F.lit(CLOSED), 1)))


def _cells(row: Column) -> Column:
    """The cells of a row's markup: tag, col_span, row_span, text."""

    def parts(x: Column, head: Column) -> Column:
        text = F.substr(x, F.length(head) + 2)
        return bound(F.substr(head, F.lit(3)), lambda at: F.struct(F.lower(F.substring(head, 1, 2)).alias("tag"), _span(at, "rowspan").alias("row_span"), _span(at, "colspan").alias("col_span"), cell_text(text).alias("text")))

    one = lambda c: bound(F.regexp_extract(c, OPENED, 1), lambda x: bound(F.substring_index(x, ">", 1), lambda head: parts(x, head)))
    return F.transform(F.regexp_extract_all(row, F.lit(CELL), 0), one)


def html_cells(texts: DataFrame, column: str, *keep: str) -> DataFrame:
    """(keep, table_no, row, ord, tag, row_span, col_span, text): the cells of all tables in a text; all numbers count from 1, rows
    without cells count too."""
    t = texts.select(*keep, F.posexplode(F.regexp_extract_all(column, F.lit(TABLE), 0)).alias("t", "_table"))
    r = t.select(*keep, "t", F.posexplode(_rows(F.col("_table"))).alias("r", "_row"))
    c = r.select(*keep, "t", "r", F.posexplode(_cells(F.col("_row"))).alias("o", "c"))
    return c.select(*keep, (F.col("t") + 1).alias("table_no"), (F.col("r") + 1).alias("row"), (F.col("o") + 1).alias("ord"), "c.*")


def grid_columns(cells: DataFrame, *keys: str) -> DataFrame:
    """``cells`` (keys, row, ord, row_span, col_span) with col, from 1: the first column that no cell before, in its own row or reaching
    down from above, has taken. The cells of a table pass in order through one task, which keeps the last row taken of each column."""
    names = cells.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, taken = object(), []
        for b in batches:
            out = []
            for own, row, down, across in zip(zip(*(b.column(k).to_pylist() for k in keys)), *(b.column(c).to_pylist() for c in ("row", "row_span", "col_span"))):
                if own != table:
                    table, taken = own, []
                col = next((k for k, last in enumerate(taken) if last < row), len(taken))
                taken += [0] * (col + across - len(taken))
                for k in range(col, col + across):
                    taken[k] = max(taken[k], row + down - 1)
                out.append(col + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*names, "col"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema) + ", col int"
    return in_turn(cells, list(keys), "row", "ord").mapInArrow(work, schema)


def pipes(table: Column) -> Column:
    """The pipe table of a table's markup, an empty line before and after; nothing if it has no cells. A cell that spans columns is
    followed by empty ones, short rows are filled up."""
    filled = lambda c: F.concat(F.array(F.replace(c["text"], F.lit("|"), F.lit("\\|"))), F.array_repeat(F.lit(""), c["col_span"] - 1))
    row = lambda r: F.flatten(F.transform(_cells(r), filled))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def whole(rows: Column, width: Column) -> Column:
        lines = F.transform(rows, lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        rule = F.array(line(F.array_repeat(F.lit("---"), width)))
        joined = bound(lines, lambda x: F.concat(F.slice(x, 1, 1), rule, F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0)))))
        return F.when(F.size(rows) > 0, F.concat(F.lit("\n\n"), F.array_join(joined, "\n"), F.lit("\n\n"))).otherwise("")

    rows = F.filter(F.transform(_rows(table), row), lambda r: F.size(r) > 0)
    return bound(rows, lambda r: bound(F.coalesce(F.array_max(F.transform(r, F.size)), F.lit(0)), lambda w: whole(r, w)))


def display_markdown(markdown: Column) -> Column:
    """Markdown fit to be shown: HTML tables as pipe tables, page markers as headings, without white space at the ends."""
    tables = F.transform(F.regexp_extract_all(markdown, F.lit(TABLE), 0), pipes)
    pairs = F.zip_with(F.split(markdown, TABLE, -1), tables, lambda plain, t: F.concat(plain, F.coalesce(t, F.lit(""))))
    shown = F.array_join(pairs, "")
    return strip(F.regexp_replace(shown, PAGE_MARKER, PAGE_HEADING.replace("{}", "$1")))
