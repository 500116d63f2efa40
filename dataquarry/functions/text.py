"""Text normalisation as JVM expressions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space beyond the ASCII blanks, what the cleaning removes, and
# what is left as a word (letters and digits, not digits only).
UNUSUAL_SPACE = "".join(
    map(chr, [0x0B, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
URL = r"http\S+|www\.\S+"
# A match always starts at the beginning of a word, so later starts need no attempt.
EMAIL = r"(?<!\S)\S+@\S+"
WORD = r"(?<![0-9])[0-9]*+[a-záéíóúüñ][a-záéíóúüñ0-9]*+"
# The same words of two or more characters.
TOKEN = r"(?<![0-9])(?:[0-9]++[a-záéíóúüñ][a-záéíóúüñ0-9]*+|[a-záéíóúüñ][a-záéíóúüñ0-9]++)"


def _without_links(text: Column) -> Column:
    x = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    x = F.translate(x, UNUSUAL_SPACE, " " * len(UNUSUAL_SPACE))
    return F.regexp_replace(F.regexp_replace(x, URL, " "), EMAIL, " ")


def clean_words(text: Column) -> Column:
    """The words that ``clean_text`` keeps, as an array.

    Everything outside the alphabet separates words, so one extraction does the work
    of replacing, splitting and dropping numbers.
    """
    return F.regexp_extract_all(_without_links(text), F.lit(WORD), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """``tokenize(clean_text(text))`` in one extraction."""
    return F.regexp_extract_all(_without_links(text), F.lit(TOKEN), F.lit(0))


def clean_text(text: Column) -> Column:
    """Lower-case; drop URLs, e-mails, foreign characters and numbers; collapse blanks."""
    return F.array_join(clean_words(text), " ")


def tokenize(text: Column) -> Column:
    """Words of two or more characters of a cleaned text."""
    return F.filter(F.split(F.lower(text), " "), lambda t: F.length(t) >= 2)
