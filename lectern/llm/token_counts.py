"""Token counts by dynamic programming over prefixes.

For every prefix of a piece (a word, digit or run of marks) the table holds the number of
tokens and the last token. A token may follow another if merging the two side by side
leaves them as they are; for each prefix exactly one token that ends there may follow what
its own start has, so one pass over the prefixes gives the exact counts of all of them.
Prefixes that end a piece carry the end mark and have a table of their own. With the sums
over whole pieces this answers, for any prefix of a text, how many tokens it has, and for
any budget, which prefix still fits, without encoding the text again.

Defined cases: a null text counts as empty and has no tokens; prefixes are counted in code
points of the composed (NFC) text; a text within the budget is kept whole; repeated
documents give repeated rows; an empty table gives an empty result.

What kind of character a code point is differs between versions of Unicode. Those that this
Python does not know, but the library may, are put to the library once, one by one.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table

LIMIT = 2048
#: Pieces whose counts a worker remembers; beyond that it starts anew.
MEMORY = 1_000_000
_SPACE = r"\t-\r \x85\xa0  -     　"
#: How the vocabulary's library cuts a lower-case text.
PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+"
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
_LATIN = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-ʯ"
_LATIN_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa00-9\xb2\xb3\xb9\xbc-\xbe{_LATIN}]+")
_BEYOND_LATIN = re.compile("[ʰ-\U0010ffff]")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NFC, _LOWER = tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()
END = "</w>"
#: Keys of a node for the token that ends there; letters are never longer than one.
OPEN, CLOSED = "open", "closed"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


def late_kinds(library: tokenizers.Tokenizer) -> dict[str, str]:
    """For each kind, L, N or other, the code points of that kind in the library which this Python's tables do not have
    but those of the pattern module do."""
    unknown = "".join(c for c in map(chr, range(0x250, 0x110000)) if unicodedata.category(c) == "Cn")
    late = regex.findall(r"\P{Cn}", unknown)
    pieces = lambda text: len(library.pre_tokenizer.pre_tokenize_str(text))
    kinds = {"L": [], "N": [], "other": []}
    for c in late:
        low = _LOWER.normalize_str(_NFC.normalize_str(c))
        kinds["L" if pieces(f"a{low}a") == 1 else "N" if pieces(low * 2) == 2 * len(low) else "other"].append(c)
    return {k: "".join(v) for k, v in kinds.items()}


class _Words(dict):
    """Tokens of words between white space, remembered."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, word: str) -> int:
        if len(self) > MEMORY:
            self.clear()
        found = self[word] = sum(map(self.counter.piece_count, self.counter.pattern(word).findall(word)))
        return found


class PrefixCounter:
    """Exact counts for one vocabulary: ranked merges with an end mark on the last letter."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: list[str], late: dict[str, str] | None = None):
        self.vocabulary, self.ranks = vocabulary, {tuple(m): k for k, m in enumerate(merges)}
        self.letters = byte_letters()
        self.names = {k: t for t, k in vocabulary.items()}
        self.tree = self._tree(vocabulary)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.follows: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.known: dict[str, int] = {}
        self.words = _Words(self)
        late = {k: f"[{re.escape(v)}]" for k, v in (late or {}).items() if v}
        self.late = regex.compile("|".join(late.values())) if late else None
        letter, number = (f"[[\\p{{{k}}}{''.join('--' + v for j, v in late.items() if j != k)}]{'||' + late[k] if k in late else ''}]" for k in "LN")
        piece = PIECE.replace(rf"[^{_SPACE}\p{{L}}\p{{N}}]", f"[^[{_SPACE}]||{letter}||{number}]").replace(r"\p{L}+|\p{N}|", f"{letter}+|{number}|")
        self.any_piece = regex.compile(piece, regex.V1)

    @classmethod
    def of_json(cls, text: str, late: dict[str, str] | None = None) -> PrefixCounter:
        """``late``: what late_kinds gives for the vocabulary, where it is known."""
        j = json.loads(text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
        return cls(j["model"]["vocab"], merges, [t["content"] for t in j.get("added_tokens", [])], late or late_kinds(tokenizers.Tokenizer.from_str(text)))

    @staticmethod
    def _tree(vocabulary: dict[str, int]) -> dict:
        """The tokens by their letters; a node has the token that ends there, without and with the end mark."""
        root: dict = {}
        for token, k in vocabulary.items():
            body, kind = (token[: -len(END)], CLOSED) if token.endswith(END) and token != END else (token, OPEN)
            node = root
            for letter in body:
                node = node.setdefault(letter, {})
            node[kind] = k
        return root

    def merged(self, symbols: list[str], steps: int | None = None) -> list[str]:
        """The merges in order of rank, leftmost first, until none applies (or ``steps`` are done)."""
        symbols = list(symbols)
        while len(symbols) > 1 and steps != 0:
            rank, i = min((self.ranks.get(pair, len(self.ranks)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == len(self.ranks):
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            steps = steps and steps - 1
        return symbols

    def symbols(self, token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def split(self, token: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes ``token``; None for a single letter or a token that is never made."""
        symbols = self.symbols(token)
        while len(symbols) > 2:
            fewer = self.merged(symbols, steps=1)
            if len(fewer) == len(symbols):
                return None
            symbols = fewer
        return tuple(symbols) if len(symbols) == 2 and tuple(symbols) in self.ranks else None

    def edge(self, token: str, side: int) -> list[tuple[str, float, float]]:
        """The symbols at one end of ``token`` (0: its start, 1: its end) on the way back through its
        merges: each with the rank at which it was made and the rank at which it was merged away."""
        found = self.edges[side].get(token)
        if found is None:
            found, gone = [], float("inf")
            while True:
                halves = self.split(token) if len(self.symbols(token)) > 1 else None
                made = self.ranks[halves] if halves else -1
                found.append((token, made, gone))
                if not halves:
                    break
                token, gone = halves[side], made
            self.edges[side][found[0][0]] = found
        return found

    def is_made(self, token: str) -> bool:
        """Whether the merges turn the letters of ``token`` into it."""
        return len(self.merged(self.symbols(token))) == 1

    def may_follow(self, left: int, token: int) -> bool:
        """Whether ``token`` stays whole after ``left`` (-1: at the start), and ``left`` before it: no two
        symbols that meet at the border at the same time have a merge that comes before their own."""
        if len(self.follows) > 2_000_000:
            self.follows.clear()
        if left < 0:
            found = self.is_made(self.names[token])
        else:
            alone = self.follows.get(-1 << 20 | token)
            found = self.may_follow(-1, token) if alone is None else alone
            found = found and self._border_holds(self.edge(self.names[left], 1), self.edge(self.names[token], 0))
        self.follows[left << 20 | token] = found
        return found

    def _border_holds(self, xs: list[tuple[str, float, float]], ys: list[tuple[str, float, float]]) -> bool:
        i = j = 0
        while True:
            x, x_made, x_gone = xs[i]
            y, y_made, y_gone = ys[j]
            rank = self.ranks.get((x, y))
            if rank is not None and rank < x_gone and rank <= y_gone:  # of equal merges the left one is first
                return False
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                i += 1
            else:
                j += 1

    def walk(self, spelled: str, every: bool) -> tuple[list[int], list[int]]:
        """Tokens of each prefix that does not end the piece, and of each that does (``every``; else only of the
        whole). From each start the tokens along the letters are tried; just one that ends at a place may follow."""
        n = len(spelled)
        last, count, ended = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        follows, tree = self.follows, self.tree
        for j in range(n):
            node, left = tree, last[j]
            for i in range(j + 1, n + 1):
                node = node.get(spelled[i - 1])
                if node is None:
                    break
                if i < n and last[i] < 0 and (token := node.get(OPEN)) is not None:
                    ok = follows.get(left << 20 | token)
                    if ok is None:
                        ok = self.may_follow(left, token)
                    if ok:
                        last[i], count[i] = token, count[j] + 1
                if (every or i == n) and not ended[i] and (token := node.get(CLOSED)) is not None:
                    ok = follows.get(left << 20 | token)
                    if ok is None:
                        ok = self.may_follow(left, token)
                    if ok:
                        ended[i] = count[j] + 1
        return count, ended

    def spell(self, piece: str) -> str:
        return "".join(map(self.letters.__getitem__, piece.encode("utf-8")))

    def piece_count(self, piece: str) -> int:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) > MEMORY:
                self.known.clear()
            found = self.known[piece] = self.walk(self.spell(piece), False)[1][-1]
        return found

    def piece_prefix_counts(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ... each taken as a whole piece."""
        ended = self.walk(self.spell(piece), True)[1]
        return [ended[e] for e in accumulate(len(c.encode("utf-8")) for c in piece)]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and those strings."""
        if self.special is None or "<|" not in text:
            yield text, False
            return
        for k, part in enumerate(self.special.split(text)):
            if part:
                yield part, k % 2 == 1

    def is_late(self, text: str) -> bool:
        return bool(self.late and _BEYOND_LATIN.search(text) and self.late.search(text))

    def composed(self, text: str) -> str:
        return text if text.isascii() else _NFC.normalize_str(text) if self.is_late(text) else unicodedata.normalize("NFC", text)

    def lower(self, text: str) -> str:
        """Each code point's own lower case, composed first."""
        if text.isascii():
            return text.lower()
        composed = self.composed(text)
        return _LOWER.normalize_str(composed) if self.is_late(composed) else composed.replace("Σ", "σ").lower()

    def pattern(self, text: str):
        return _ASCII_PIECE if text.isascii() else self.any_piece if _BEYOND_LATIN.search(text) else _LATIN_PIECE

    def count(self, text: str) -> int:
        total = 0
        for part, special in self.segments(text):
            if special:
                total += 1
            else:
                low = self.lower(part)
                if _SEPARATORS.search(low):  # str.split() takes these for white space
                    total += sum(map(self.piece_count, self.pattern(low).findall(low)))
                else:
                    total += sum(map(self.words.__getitem__, low.split()))
        return total

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(self, text)


class PrefixIndex:
    """For one text: where its pieces end, and the tokens up to there."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter = counter
        self.starts, self.ends, self.pieces, self.totals = [], [], [], [0]
        at = 0
        for part, special in counter.segments(text):
            if special:
                self._add(at, at + len(part), None, 1)
                at += len(part)
                continue
            composed = counter.composed(part)
            low = counter.lower(part)
            place = range(len(low) + 1)
            if len(low) != len(composed):  # a code point whose lower case is longer
                place = [k for k, c in enumerate(composed) for _ in counter.lower(c)] + [len(composed)]
            for m in counter.pattern(low).finditer(low):
                self._add(at + place[m.start()], at + place[m.end()], m.group(), counter.piece_count(m.group()))
            at += len(composed)
        self.length = at

    def _add(self, start: int, end: int, piece: str | None, n: int) -> None:
        self.starts.append(start)
        self.ends.append(end)
        self.pieces.append(piece)
        self.totals.append(self.totals[-1] + n)

    def tokens(self, prefix: int) -> int:
        """Tokens of the first ``prefix`` code points (a special string counts once it is complete)."""
        k = bisect_right(self.ends, prefix)
        if k < len(self.ends) and self.starts[k] < prefix and self.pieces[k]:
            inside = self.counter.pattern(self.pieces[k]).findall(self.pieces[k][: prefix - self.starts[k]])
            return self.totals[k] + sum(map(self.counter.piece_count, inside))
        return self.totals[k]

    def fit(self, budget: int) -> int:
        """The longest prefix that ends a piece or lies in the piece after it, with ``budget`` tokens at most."""
        k = bisect_right(self.totals, budget) - 1
        if k == len(self.ends):
            return self.length
        best, piece = self.starts[k], self.pieces[k]
        if piece and self.ends[k] - self.starts[k] == len(piece):
            inside = self.counter.piece_prefix_counts(piece)
            best += max((i for i, n in enumerate(inside, 1) if self.totals[k] + n <= budget), default=0)
        return best


_counters: dict[int, PrefixCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str, *keep: str, limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_tokens, over_limit and fit_chars (code points that fit the limit).
    ``vocabulary``: path of the vocabulary's .json on the driver. One row in, one row out."""
    keep = keep or ("doc_id",)
    base = docs.select(*dict.fromkeys([*keep, "text"]))
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((text, late_kinds(tokenizers.Tokenizer.from_str(text))))  # one vocabulary: a few MB at any size of input
    schema = ", ".join(f"`{base.schema[c].name}` {base.schema[c].dataType.simpleString()}" for c in keep)
    schema += ", n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value[0])
        if key not in _counters:
            _counters.clear()
            _counters[key] = PrefixCounter.of_json(*shared.value)
        c = _counters[key]
        for b in batches:
            texts = [t.as_py() or "" for t in b.column("text")]
            n = [c.count(t) for t in texts]
            fit = [c.index(t).fit(limit) if k > limit else len(c.composed(t)) for t, k in zip(texts, n)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(x) for x in keep), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=[*keep, "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return base.mapInArrow(work, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
