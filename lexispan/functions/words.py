"""Column expressions on words: types, filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no "
    "nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't "
    "isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()


def word_type(word: Column, to_lowercase: bool = True) -> Column:
    """``STOP_WORD`` or ``STANDARD``."""
    return F.when((F.lower(word) if to_lowercase else word).isin(*STOP_WORDS), "STOP_WORD").otherwise("STANDARD")


def is_alpha(word: Column) -> Column:
    """All characters are letters, and there is one."""
    return word.rlike(r"^\p{L}+\z")


def dropping(*tests: Callable[[Column], Column], base: Callable[[Column], Column] = F.lower) -> Callable[[Column], Column]:
    """A word filter: the base form, or null (left out of queries) where a test fails."""

    def keep(word: Column) -> Column:
        out = base(word)
        for test in tests:
            out = F.when(test(word), out)
        return out

    return keep


def not_among(*words: str) -> Callable[[Column], Column]:
    return lambda word: ~F.lower(word).isin(*words)
