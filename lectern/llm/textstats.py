"""Surface statistics of whole texts, computed in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD

_WORD = re.compile(WORD)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)

#: Whole-number statistics first, then the ratios that learned rules and scores look at.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = (
    "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate",
    "bang_rate", "pipe_rate", "stop_rate", "mean_line", "distinct_rate", "long_word_rate",
)


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur at least twice in the text, first ones included."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n - 2:
        return 0
    seen = Counter(windows)
    total, covered = 0, 0  # words before position `covered` are counted already
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and RATIOS of a text; null counts as empty, and every ratio of an empty text is 0."""
    text = text or ""
    words = _WORD.findall(text)
    n, chars = len(words), sum(map(len, words))
    hist = np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=128)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    dup, symbols, repeats = len(lines) - len(set(lines)), int(hist[_SYMBOLS].sum()), repeat_words(words)
    upper, per, per_char = int(hist[65:91].sum()), max(n, 1), max(chars, 1)
    ratios = [
        chars / per, symbols / per, dup / max(len(lines), 1), repeats / per, upper / per_char, int(hist[48:58].sum()) / per_char,
        int(hist[33]) / per, int(hist[124]) / per, int(hist[46]) / per, n / max(len(lines), 1), len(set(words)) / per, sum(len(w) > 15 for w in words) / per,
    ]
    return [n, chars, symbols, dup, repeats], ratios


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` with COUNTS (long) and RATIOS (double) of ``text``. One row in, one row out."""
    keep = keep or ("doc_id",)
    base = docs.select(*keep, "text")
    fields = [base.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} bigint" for c in COUNTS] + [f"{c} double" for c in RATIOS])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column("text")]
            ints = np.array([r[0] for r in rows], np.int64).reshape(-1, len(COUNTS))
            reals = np.array([r[1] for r in rows], np.float64).reshape(-1, len(RATIOS))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in keep] + [pa.array(ints[:, i]) for i in range(len(COUNTS))] + [pa.array(reals[:, i]) for i in range(len(RATIOS))],
                names=[*keep, *COUNTS, *RATIOS],
            )

    return base.mapInArrow(work, schema)
