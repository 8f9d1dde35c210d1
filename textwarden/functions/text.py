"""Text cleaning as Column functions. Everything here stays JVM-side and needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textwarden import config

# The code points Python's ``str.strip``/``str.split`` treat as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_MEMBERS = (
    r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0"
    r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{SPACE_MEMBERS}]"
WORD = f"[^{SPACE_MEMBERS}]"

# A run of three or more equal code points (a newline does not count) keeps two.
REPEAT_RUN = r"([^\n])\1\1+"

# Marks belong to the word: splitting on them would tear Devanagari words apart.
TOKEN_BREAK = r"[^\p{L}\p{M}\p{N}]+"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (``trim`` alone only knows the ASCII space)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    stripped = strip(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, SPACE + "+")))


def has_words(stripped: Column, n: int) -> Column:
    """Whether a stripped text has at least ``n`` words; stops reading at the n-th word."""
    return stripped.rlike("^" + (SPACE + "+").join([WORD + "+"] * (n - 1) + [WORD]))


def collapse_repeats(text: Column) -> Column:
    """``stuuuuupid`` becomes ``stuupid``."""
    return F.regexp_replace(text, REPEAT_RUN, "$1$1")


def sanitise(text: Column) -> Column:
    return collapse_repeats(strip(text))


def remove_symbols(text: Column, keep_marks: bool = False) -> Column:
    """Drop all but letters, digits, underscore and white space.

    Combining marks go too, as the reference's word class has it; ``keep_marks=True``
    keeps them, which Hindi needs to stay readable.
    """
    marks = r"\p{M}" if keep_marks else ""
    return F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{marks}{SPACE_MEMBERS}]", "")


def normalise_strict(text: Column, keep_marks: bool = False) -> Column:
    return remove_symbols(collapse_repeats(F.lower(text)), keep_marks)


def short_warning(stripped: Column, min_words: int = config.MIN_WORDS) -> Column:
    """Warning for texts under ``min_words`` words, else null. Counts words only if short."""
    short = (stripped != "") & ~has_words(stripped, min_words)
    return F.when(short, F.format_string(config.SHORT_WARNING, word_count(stripped)))


def warnings(stripped: Column, min_words: int = config.MIN_WORDS) -> Column:
    """All warnings of a text in order; an empty array when there are none."""
    blank = F.when(stripped == "", F.lit(config.BLANK_WARNING))
    return F.array_compact(F.array(blank, short_warning(stripped, min_words)))


def preview(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(
        text
    )


def label_key(label: Column) -> Column:
    return F.translate(F.lower(label), " ", "_")


def pieces(text: Column) -> Column:
    """Tokens of the whole text as they fall: blank ones may stand at the ends."""
    return F.split(F.lower(text), TOKEN_BREAK)


def tokens(text: Column, max_tokens: int | None = None) -> Column:
    """Lower-cased word tokens of the whole text, or of its first ``max_tokens`` tokens."""
    words = F.array_remove(pieces(text), "")
    return words if max_tokens is None else F.slice(words, 1, max_tokens)


def percent(value: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(value * 100, digits))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", F.round(value, digits))
