"""Unicode text expressions. All of them stay JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import WHITESPACE, WHITESPACE_CLASS, WORD_PATTERN


def strip(col: Column) -> Column:
    """Trim every Unicode white-space character from both ends (linear time)."""
    return F.btrim(col, F.lit(WHITESPACE))


def is_blank(col: Column) -> Column:
    return F.coalesce(strip(col), F.lit("")) == ""


def collapse(col: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.btrim(F.regexp_replace(col, WHITESPACE_CLASS + "+", " "))


def casefold(col: Column) -> Column:
    """Lower case plus the full foldings that ``lower`` leaves alone."""
    out = F.translate(F.lower(col), "ςſ", "σs")
    for src, dst in (
        ("ß", "ss"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"),
        ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"),
    ):
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def search_form(col: Column) -> Column:
    """Case-folded text with single spaces, the form used for comparisons."""
    return collapse(casefold(col))


def word_count(col: Column) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(WORD_PATTERN))


def word_set(col: Column) -> Column:
    """Distinct lower-cased words, in order of first appearance.

    The text is lower-cased as a whole; only where a capital's lower case
    depends on its neighbours or has two code points are the words lower-cased
    one by one.
    """
    text = F.coalesce(col, F.lit(""))
    find = lambda x: F.regexp_extract_all(x, F.lit(WORD_PATTERN), F.lit(0))
    special = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u03a3"))
    words = F.when(special, F.transform(find(text), F.lower)).otherwise(find(F.lower(text)))
    return F.array_distinct(words)


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def contains_any(col: Column, phrases) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(col, F.lit(phrase))
    return out


def slug(col: Column) -> Column:
    """Tag slug: lower case, every run of non ``[a-z0-9]`` becomes one ``_``."""
    lowered = F.lower(strip(F.coalesce(col, F.lit(""))))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), F.lit("_"))


def display_name(slug_col: Column, uppercase_words) -> Column:
    words = F.filter(F.split(slug_col, "_"), lambda w: w != "")
    named = F.transform(
        words,
        lambda w: F.when(w.isin(*uppercase_words), F.upper(w)).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        ),
    )
    return F.array_join(named, " ")
