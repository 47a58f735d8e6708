"""Text expressions: case folding, tokens, stripping, escaping, file names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that a search query does not look for.
STOP_WORDS = ("a", "an", "and", "are", "about", "do", "for", "from", "how", "in", "is", "it", "of", "on", "the", "this", "to", "what", "which", "with")

TERM = r"[\p{L}\p{N}_]+"

#: White space of any script, as Python strips it.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), 0)


def casefold(x: Column) -> Column:
    return F.lower(F.replace(x, F.lit("ß"), F.lit("ss")))


def terms(x: Column) -> Column:
    """Folded word runs, stop words included."""
    return F.regexp_extract_all(casefold(x), F.lit(TERM), 0)


def search_terms(x: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(terms(x), lambda t: ~F.array_contains(stop, t))


def word_count(folded: Column, term: str) -> Column:
    """How often ``term`` (a folded word run) is among the words of a folded text: ``terms`` that equal it, without taking the others
    out. A search that begins with the term itself is a plain one; the sign behind the class makes Java look back by code points."""
    word = r"[\p{L}\p{N}_" + "\U00010400]"
    whole = F.regexp_count(folded, F.lit(f"{term}(?!{word})(?<!{word}{term})"))
    return F.when(~F.contains(folded, F.lit(term)), 0).otherwise(whole)


def strip(x: Column) -> Column:
    """Without white space (of any script) at either end."""
    return F.btrim(x, F.lit(SPACES))


def html_escape(x: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(plain), F.lit(name))
    return x


def safe_name(x: Column, most: int = 80) -> Column:
    """Letters, digits, _ and -; other runs become one dash each, none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "-"), "^-+|-+$", ""), 1, most)


def output_name(source: Column, suffix: str) -> Column:
    """The stem of a file name with another suffix."""
    return F.concat(F.regexp_replace(F.regexp_extract(source, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", ""), F.lit(suffix))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs, without overlaps; 0 for an empty part."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def compact_json_safe(x: Column) -> Column:
    """JSON text with &, < and > as unicode escapes, fit for embedding in HTML."""
    for plain, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def block_number(x: Column) -> Column:
    """The number at the end of a block's id; 0 if there is none."""
    return F.coalesce(F.regexp_extract(x, r"-b(\d+)$", 1).try_cast("int"), F.lit(0))


def rebound(x: Column, old_page: Column, new_page: Column) -> Column:
    """An id of a page as that of another page; ids of other pages stay."""
    prefix = F.concat(F.lit("p"), old_page, F.lit("-"))
    return F.when(F.startswith(x, prefix), F.concat(F.lit("p"), new_page, F.lit("-"), F.substr(x, F.length(prefix) + 1))).otherwise(x)


def positive_int(x: Column) -> Column:
    """A whole number of at least 1; 1 for anything that is not a number."""
    return F.greatest(F.lit(1), F.coalesce(F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("int")), F.lit(1)))


def money(x: Column, status: Column) -> Column:
    shown = F.concat(F.lit("$"), F.format_string("%.6f", x), F.when(status == "estimate", " estimated").otherwise(""))
    return F.when(x.isNull() | (status == "unavailable"), "Unavailable").otherwise(shown)


def label_of_control(text: Column, block: Column, control: Column, state: Column) -> Column:
    """A label without the selection mark that was read as its first letter: an X before a capital, at the place of a checked control."""
    bare = strip(text)
    fused = (state == "CHECKED") & bare.rlike("^[Xx][A-Z]") & (block["l"] >= control["l"] - 0.01) & (block["l"] < control["r"]) & (control["r"] - block["l"] <= 0.03)
    return F.when(F.coalesce(fused, F.lit(False)), F.regexp_replace(F.substring(bare, 2, 2**31 - 1), r"(?U)^\s+", "")).otherwise(bare)
