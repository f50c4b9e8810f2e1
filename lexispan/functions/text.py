"""Column expressions for splitting text into sentences and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The delimiters of sentences and words. Unicode white space counts as space.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"
SENTENCE_ENDS = "[.?!|]+"
WORD_GAPS = "[,;:| ()]+"


def normalized(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def sentence_pieces(text: Column) -> Column:
    """Stretches between sentence ends that are not empty; null text has none."""
    pieces = F.filter(F.split(normalized(text), SENTENCE_ENDS, -1), lambda x: F.length(x) > 0)
    return F.coalesce(pieces, F.array().cast("array<string>"))


def words_of(sentence: Column) -> Column:
    return F.filter(F.split(sentence, WORD_GAPS, -1), lambda x: F.length(x) > 0)


def py_slice(array: Column, start: int | None = None, stop: int | None = None) -> Column:
    """``array[start:stop]`` with the clamping of Python slices."""
    n = F.size(array)
    place = lambda x, default: default if x is None else F.lit(x) if x >= 0 else F.greatest(F.lit(0), n + x)
    lo, hi = place(start, F.lit(0)), F.least(n, place(stop, n))
    return F.slice(array, lo + 1, F.greatest(F.lit(0), hi - lo))


def document_text(text: Column) -> Column:
    """A text's sentences joined by a stop and a newline, and a last stop; computed in the text's row."""
    return F.concat(F.array_join(F.transform(sentence_pieces(text), lambda p: F.array_join(words_of(p), " ")), ".\n"), F.lit("."))


def document_length(text: Column) -> Column:
    """The number of a text's sentences, empty ones counted."""
    return F.size(sentence_pieces(text)).cast("int")
