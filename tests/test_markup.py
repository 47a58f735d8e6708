"""HTML tables, grids under spans, links and repair against plain Python."""

import html
import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lectern.operators import graph as G
from lectern.operators import markup as M
from lectern.operators import repair as R


class Plain(HTMLParser):
    """Rows of (text, span) of closed cells in closed rows."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.row, self.cell, self.span = [], None, None, 1

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.row, self.cell = [], None
        elif tag in ("td", "th") and self.row is not None:
            value = dict(attrs).get("colspan") or "1"
            self.cell, self.span = "", max(1, int(value)) if value.strip().isdigit() else 1
        elif tag == "br" and self.cell is not None:
            self.cell += " "

    def handle_data(self, data):
        if self.cell is not None:
            self.cell += data

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.row += [" ".join(self.cell.split()).replace("|", "\\|")] + [""] * (self.span - 1)
            self.cell = None
        elif tag == "tr" and self.row is not None:
            if self.row:
                self.rows.append(self.row)
            self.row = None


def pipe_table(markup):
    p = Plain()
    p.feed(markup)
    if not p.rows:
        return ""
    n = max(map(len, p.rows))
    rows = [r + [""] * (n - len(r)) for r in p.rows]
    return "\n\n" + "\n".join("| " + " | ".join(r) + " |" for r in [rows[0], ["---"] * n, *rows[1:]]) + "\n\n"


def random_table(rng):
    words = ["a", "b|c", "x &amp; y", "&lt;tag&gt;", "&#65;&#x1F600;", "<b>bold</b>", "line<br>break", "  wide \n space ", "", "&unknown;", "5 < 6", "ß é"]
    cell = lambda: f'<{(t := rng.choice(["td", "th", "TD"]))}{rng.choice(["", " colspan=2", chr(32) + "colspan=" + chr(34) + "3" + chr(34), " colspan=x", " class=q colspan=" + chr(39) + "2" + chr(39)])}>{rng.choice(words)}</{t}>'
    row = lambda: f"<tr{rng.choice(['', ' id=1'])}>" + "".join(cell() for _ in range(rng.randint(0, 4))) + rng.choice(["</tr>", "</tr >", "</tr>\n"])
    return f"<table{rng.choice(['', ' border=1'])}>" + "".join(row() for _ in range(rng.randint(0, 5))) + "</table>"


def test_pipe_tables_equal_a_parser(spark):
    rng = random.Random(1)
    tables = [random_table(rng) for _ in range(300)] + ["<table><tr><td>open<td>two</td></tr><tr><td>x</td><tr><td>y</td></tr></table>", "<table></table>"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in tables], "t string").select(M.pipes(F.col("t"))).collect()]
    assert got == [pipe_table(t) for t in tables]


def test_markdown_is_shown(spark):
    texts = ["<!-- Page : 3 -->\nx", "a<table><tr><td>1</td></tr></table>b<table><tr></tr></table>c", None, "", " plain <table> not closed "]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.display_markdown(F.col("t"))).collect()]
    assert got == ["---\n\n#### Page 3\n\nx", "a\n\n| 1 |\n| --- |\n\nbc", None, "", "plain <table> not closed"]


def test_long_tables_are_read(spark):
    text = "<table>" + "<tr><td>" + "word " * 200_000 + "</td></tr>" + "<tr><td>x</td></tr>" * 2000 + "</table>"
    r = M.html_cells(spark.createDataFrame([(1, text)], "k int, t string"), "t", "k").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("most")).first()
    assert (r.n, r.most) == (2001, 999_999)


def test_references_are_resolved_once(spark):
    texts = ["&amp;lt;", "&#38;amp;", "&#xD800;x", "&#0;&#99999999;", "a & b &", "&quot;&apos;"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(M.unescaped(F.col("t"))).collect()]
    assert got[0] == "&lt;" and got[1] == "&amp;" and got[2] == "&#xD800;x" and got[3] == "&#0;&#99999999;" and got[4] == texts[4] and got[5] == html.unescape(texts[5])


def test_cells_take_the_next_free_column(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for t in range(60):
        taken = set()
        for row in range(1, rng.randint(2, 7)):
            for o in range(rng.randint(0, 5)):
                down, across = rng.randint(1, 3), rng.randint(1, 3)
                col = next(c for c in range(1, 99) if (row, c) not in taken)
                taken |= {(y, x) for y in range(row, row + down) for x in range(col, col + across)}
                rows.append((t if t else None, row, o, down, across))
                want[t if t else None, row, o] = col
    got = M.grid_columns(spark.createDataFrame(rows, "t int, row int, ord int, row_span int, col_span int").repartition(7), "t").collect()
    assert {(r.t, r.row, r.ord): r.col for r in got} == want


def test_links_are_checked_as_by_search(spark):
    rng = random.Random(4)
    nodes = [(g, n, n // 4, n % 4) for g in (1, None) for n in range(10)]
    links = [(g, rng.randint(0, 11), rng.randint(0, 9), rng.choice(["continues", "cites"]), i) for g in (1, None) for i in range(120)]
    got = {(r.g, r.ord): r.issue for r in G.checked_links(spark.createDataFrame(links, "g int, src int, dst int, relation string, ord int"), spark.createDataFrame(nodes, "g int, node int, page int, reading_order int"), "g").collect() if r.g}
    edges, seen, want = {}, set(), {}
    for g, s, d, r, i in links:
        if not g:
            continue
        stack, reached = [d], set()
        while stack:
            n = stack.pop()
            if n not in reached:
                reached.add(n)
                stack += edges.get(n, ())
        want[g, i] = "unknown_endpoint" if s > 9 else "duplicate" if (s, d, r) in seen else "not_forward" if r == "continues" and (s // 4, s % 4) >= (d // 4, d % 4) else "cycle" if s in reached else None
        if want[g, i] is None:
            edges.setdefault(s, set()).add(d)
            seen.add((s, d, r))
    assert got == want and set(want.values()) == {None, "unknown_endpoint", "duplicate", "not_forward", "cycle"}


def test_many_links_of_one_graph_in_bounded_time():
    rng, order = random.Random(5), G.Order()
    rank = list(range(30_000))
    rng.shuffle(rank)
    start = time.perf_counter()
    for _ in range(200_000):
        a, b = rng.randrange(30_000), rng.randrange(30_000)
        if a != b:
            order.add(*((a, b) if abs(rank[a] - rank[b]) > 0 and rank[a] < rank[b] else (b, a)))
    assert time.perf_counter() - start < 60
    assert all(order.place[s] < order.place[d] for s, ends in order.after.items() for d in ends)


ITEMS = "doc_id int, item_id string, stage string, message string, retryable boolean, source_ids array<string>"


def test_repair_stops_at_each_end(spark):
    items = [(1, "a", "parse", "m", True, ["b"]), (2, "a", "parse", "m", True, ["b"]), (3, "a", "parse", "m", True, ["b"]), (4, "a", "checkbox", "m", True, ["b"]), (4, "b", "parse", "m", False, ["b"]), (4, "c", "parse", "m", True, []), (6, "a", "parse", "m", True, ["b"]), (6, "b", "checkbox", "m", True, ["b"])]
    answers = [(1, 1, "a", "resolved", None), (2, 1, "a", "changed", "n"), (2, 2, "a", "changed", "o"), (3, 1, "a", "changed", "m"), (4, 1, "a", "resolved", None), (4, 1, "b", "resolved", None), (6, 1, "a", "changed", "n"), (6, 2, "a", "resolved", None), (6, 2, "b", "resolved", None)]
    docs = spark.createDataFrame([(i,) for i in range(1, 7)], "doc_id int")
    kept = []
    ends, left = R.repair_rounds(docs, spark.createDataFrame(items, ITEMS), spark.createDataFrame(answers, "doc_id int, round int, item_id string, outcome string, message string"), keep=lambda x, r: (kept.append(r), x)[1])
    assert {r.doc_id: (r.rounds, r.state, r.reason) for r in ends.collect()} == {
        1: (1, "ACCEPTED", "accepted"), 2: (2, "REVIEW_REQUIRED", "exhausted"), 3: (1, "REVIEW_REQUIRED", "unchanged"), 4: (0, "REVIEW_REQUIRED", "nothing_retryable"), 5: (0, "ACCEPTED", "accepted"), 6: (2, "REVIEW_REQUIRED", "exhausted"),
    }
    assert sorted((r.doc_id, r.item_id, r.message) for r in left.collect()) == [(2, "a", "o"), (3, "a", "m"), (4, "a", "m"), (4, "b", "m"), (4, "c", "m"), (6, "b", "m")] and kept == [1, 1, 2, 2]
    scoped, _ = R.repair_rounds(docs, spark.createDataFrame(items, ITEMS), spark.createDataFrame(answers, "doc_id int, round int, item_id string, outcome string, message string"), in_scope=lambda ask: ask.where("doc_id = 1"))
    assert {r.doc_id: r.reason for r in scoped.collect()}[2] == "nothing_retryable"


@pytest.mark.parametrize("most, characters, want", [(8, 12_000, ["c", "a", "b"]), (2, 12_000, ["c", "a"]), (8, 10, ["c"]), (8, 25, ["c", "b"])])
def test_scopes_fill_up(spark, most, characters, want):
    rows = [(1, 1, 1, "a", ["b1"], "total total sum", None), (1, 1, 2, "b", ["b2"], "sum", ""), (1, 2, 1, "c", ["b3"], "nothing at all", "nothing at all, long"), (1, 2, 2, "d", ["b4"], "no", None), (1, 3, 1, "c", ["b5"], "sum", None), (2, 1, 1, "z", ["b3"], "total", None)]
    chunks = spark.createDataFrame(rows, "doc_id int, page int, chunk_ord int, chunk_id string, block_ids array<string>, text string, markdown string")
    items = spark.createDataFrame([(1, "Field total_sum requires review"), (1, None)], "doc_id int, message string")
    named = spark.createDataFrame([(1, "b3", None), (1, None, "none")], "doc_id int, block_id string, chunk_id string")
    got = R.repair_scope(R.chunk_scores(chunks, items, named), most, characters).orderBy("place").collect()
    assert [r.chunk_id for r in got] == want and got[0].score == 100
