"""Quality rules, line first: clean line by line, then reject documents that lose too much text.

DataFrame functions only. The rules on a line look at its punctuation, at navigation marks and at
boilerplate phrases; a document is kept if the lines that stay hold enough of its characters and it
passes the base rules on words and repetition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import SPACE, fresh, let, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document may lose this share of its characters with the lines that fail.
MAX_LOST = 0.5
#: A line whose last character is none of these has no end mark.
TERMINAL = ".!?:;\"'”’»…。！？)"
NAV_MARKS = "|»›•·<>"
#: More navigation marks than this share of the line's pieces make it a menu.
NAV_SHARE = 0.25
#: A boilerplate phrase counts in lines shorter than this; longer ones are prose that mentions it.
MAX_NOTICE = 200
PHRASES = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "accept cookies",
    "enable javascript", "click here", "sign in", "log in", "subscribe to our", "skip to content", "share this",
    "follow us", "lorem ipsum", "back to top",
)


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that are found twice or more (first included).

    Windows are told apart by a 64-bit hash, built from the hashes of two overlapping halves.
    """

    def cover(places: Column) -> Column:
        step = lambda p, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - p, F.lit(window)))
        return F.aggregate(F.transform(places, step), F.lit(0), lambda a, b: a + b)

    def twice(pairs: Column) -> Column:
        same = lambda j, e: F.coalesce(F.get(pairs, j)["h"] == e["h"], F.lit(False))
        met = F.filter(pairs, lambda e, j: same(j - 1, e) | same(j + 1, e))
        return let(F.array_sort(F.transform(met, lambda e: e["i"])), cover)

    def of(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        none = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none, F.lit(0)).otherwise(let(F.array_sort(pairs), twice))

    def longer(by: int):
        return lambda h: F.zip_with(h, F.slice(h, by + 1, F.size(h)), lambda x, y: F.xxhash64(x, y))

    def hashed(w: Column) -> Column:
        each, span = w, 1
        while span < window:
            by = min(span, window - span)
            each, span = let(each, longer(by)), span + by
        return F.when(F.size(w) < window, F.lit(0)).otherwise(let(F.slice(each, F.lit(1), F.size(w) - (window - 1)), of))

    return let(ws, hashed)


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE)) == ""


def line_fails(line: Column) -> Column:
    """Whether a line with words fails a rule: no end mark, a menu, or a boilerplate phrase."""
    unended = ~F.substring(F.rtrim(line, F.lit(SPACE)), -1, 1).isin(*TERMINAL)
    marks = F.size(F.split(line, f"[{NAV_MARKS}]", -1)) - 1
    menu = (marks > 0) & (marks > NAV_SHARE * F.size(words(line)))
    phrase = (F.length(line) < MAX_NOTICE) & F.lower(line).rlike("|".join(PHRASES))
    return unended | menu | phrase


def clean_lines(text: Column) -> Column:
    """The text without the lines that fail; lines without words stay."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: _blank(x) | ~line_fails(x)), "\n")


def judge(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` and, as last column, a struct (named ``quality`` or a fresh name) of figures and verdict.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal
    an earlier line), n_repeat_words, base_failed, kept, clean_text (the lines that stay). Null texts
    count as empty; texts without words fail the base rules. Rows are judged one by one, so
    repeated rows get the same verdict, and an empty table gives none.
    """
    out = fresh(docs, "quality")
    text = F.coalesce(F.col(text_col), F.lit(""))

    def long(c: Column) -> Column:
        return c.cast("long")

    full = F.filter(F.split(text, "\n", -1), lambda x: ~_blank(x))
    facts = F.struct(
        let(
            words(text),
            lambda w: F.struct(
                F.size(w).alias("n"), repeated_words(w).alias("r"), F.length(F.array_join(w, "")).alias("c")
            ),
        ).alias("w"),
        (F.size(F.split(text, f"[{SYMBOLS}]", -1)) - 1).alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
        clean_lines(text).alias("clean"),
        F.length(text).alias("length"),
    )

    def verdict(f: Column) -> Column:
        n, r = f["w"]["n"], f["w"]["r"]
        failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
        enough = F.length(f["clean"]) >= (1 - MAX_LOST) * f["length"]
        return F.struct(
            long(n).alias("n_words"), long(f["w"]["c"]).alias("word_chars"), long(f["n_symbols"]).alias("n_symbols"),
            long(f["n_dup_lines"]).alias("n_dup_lines"), long(r).alias("n_repeat_words"),
            failed.alias("base_failed"), (~failed & enough).alias("kept"), f["clean"].alias("clean_text"),
        )

    return docs.select("*", let(facts, verdict).alias(out))
