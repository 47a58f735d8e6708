"""Links between nodes: components of the graph and links that would close a cycle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stage import in_turn, written


def accepted_links(links: DataFrame, by: str) -> DataFrame:
    """Links (by, src, dst, ord) with accepted, in input order within each ``by``: a link is refused if its end already
    leads to its start over the links accepted so far. The links of a ``by`` pass in order through one task, which
    holds its distinct links only and searches once for each; an unknown ``ord`` comes last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, after, refused = None, False, {}, set()
        for b in batches:
            out = []
            for key, src, dst in zip(*(b.column(c).to_pylist() for c in (by, "src", "dst"))):
                if not begun or not (key == last or (key != key and last != last)):
                    last, begun, after, refused = key, True, {}, set()
                if dst not in after.get(src, ()) and (src, dst) not in refused:
                    stack, seen, closes = [dst], set(), src == dst
                    while stack and not closes:
                        n = stack.pop()
                        if n in seen:
                            continue
                        seen.add(n)
                        closes = n == src
                        stack += after.get(n, ())
                    if closes:
                        refused.add((src, dst))
                    else:
                        after.setdefault(src, set()).add(dst)
                out.append((src, dst) not in refused)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema) + ", accepted boolean"
    return in_turn(links, [by], F.asc_nulls_last("ord"), "src", "dst").mapInArrow(work, schema)


class Order:
    """A graph without cycles whose nodes stand in an order that its links follow. A link that agrees with the order costs nothing;
    one against it moves only the nodes that lie between its ends and that one of them reaches (Pearce and Kelly)."""

    def __init__(self) -> None:
        self.place: dict[object, int] = {}
        self.after: dict[object, set] = {}
        self.before: dict[object, set] = {}

    def add(self, src: object, dst: object) -> bool:
        """Take the link, unless it would close a cycle."""
        for n in (src, dst):
            self.place.setdefault(n, len(self.place))
        if src == dst:
            return False
        low, high = self.place[dst], self.place[src]
        if low < high:
            ahead = self._reach(dst, self.after, lambda p: p <= high)
            if src in ahead:
                return False
            behind = self._reach(src, self.before, lambda p: p >= low)
            moved = sorted(behind, key=self.place.get) + sorted(ahead, key=self.place.get)
            self.place.update(zip(moved, sorted(self.place[n] for n in moved)))
        self.after.setdefault(src, set()).add(dst)
        self.before.setdefault(dst, set()).add(src)
        return True

    def _reach(self, start: object, links: dict[object, set], near: Callable[[int], bool]) -> set:
        seen, stack = {start}, [start]
        while stack:
            for n in links.get(stack.pop(), ()):
                if n not in seen and near(self.place[n]):
                    seen.add(n)
                    stack.append(n)
        return seen


def checked_links(links: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """(by, src, dst, relation, ord, issue): every link of a document in input order, with what is wrong with it: an end that is no node, the
    same link before (if that was accepted), a "continues" link that does not lead forward in page and reading order, a cycle with
    the links accepted so far; null if it is accepted. ``nodes``: node, page, reading_order. Ends are looked up by joins; the links of
    a document pass in order through one task, which holds its accepted links and an order of their nodes."""
    at = nodes.select(by, "node", F.struct("page", "reading_order").alias("at"))
    end = lambda c: at.select(by, F.col("node").alias(c), F.col("at").alias(f"{c}_at"))
    x = links.select(by, "src", "dst", "relation", "ord").join(end("src"), [by, "src"], "left").join(end("dst"), [by, "dst"], "left")
    known = F.col("src_at").isNotNull() & F.col("dst_at").isNotNull()
    backward = F.coalesce((F.col("relation") == "continues") & (F.col("src_at") >= F.col("dst_at")), F.lit(False))
    columns = [by, "src", "dst", "relation", "ord"]
    rows = x.select(*columns, known.alias("_known"), backward.alias("_backward"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, begun, order, seen = None, False, Order(), set()
        for b in batches:
            out = []
            for key, src, dst, relation, known, backward in zip(*(b.column(c).to_pylist() for c in (by, "src", "dst", "relation", "_known", "_backward"))):
                if not begun or not (key == last or (key != key and last != last)):
                    last, begun, order, seen = key, True, Order(), set()
                issue = "unknown_endpoint" if not known else "duplicate" if (src, dst, relation) in seen else "not_forward" if backward else None
                if issue is None and not order.add(src, dst):
                    issue = "cycle"
                if issue is None:
                    seen.add((src, dst, relation))
                out.append(issue)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(out, pa.string())], names=[*columns, "issue"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns) + ", issue string"
    return in_turn(rows, [by], F.asc_nulls_last("ord"), "src", "dst", "relation").mapInArrow(work, schema)


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): what each start leads to, in rounds that each add one more step until none adds anything."""
    steps = edges.select(F.col("src").alias("node"), "dst").distinct()
    found = front = written(starts.select("start", F.col("start").alias("node")).distinct(), "reached")
    while not front.isEmpty():  # each round writes what it adds, and nothing again
        front = written(front.join(steps, "node").select("start", F.col("dst").alias("node")).distinct().join(found, ["start", "node"], "left_anti"), "reached")
        found = found.union(front)
    return found
