"""Conflict resolution: values computed from the candidates of each span."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.operators.corpus import call
from lexispan.operators.match import candidates_of


def longest(candidates: Column) -> Column:
    """The first of the candidates with most words."""
    return _best(candidates, F.array_max, lambda c: c["stop"] - c["start"])


def shortest(candidates: Column) -> Column:
    """The first of the candidates with fewest words."""
    return _best(candidates, F.array_min, lambda c: c["start"] - c["stop"])


def _best(candidates: Column, end: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """Candidates of one start, as matchers make them, are told by their stops, which is compiled; others by a lambda."""
    starts, stops = candidates["start"], candidates["stop"]
    by_stop = F.array_position(stops, end(stops)).cast("int") - 1
    place = F.array_max(F.transform(candidates, lambda c, i: F.struct(value(c).alias("v"), (-i).alias("i"))))["i"]
    return F.get(candidates, F.when(F.array_min(starts) == F.array_max(starts), by_stop).otherwise(-place))


def resolve(spans: DataFrame, functions: dict[str, Callable[..., Column]]) -> DataFrame:
    """Sets a column for each function; columns of an earlier resolver go.

    A function gets the candidates, or, if it takes two arguments, the candidates and the whole span: a
    struct of all its columns, with start, stop and what earlier resolvers set.
    """
    base = spans.columns[: spans.columns.index("candidates") + 1]
    span = F.struct(*spans.columns)
    return spans.select(*base, *[call(f, F.col("candidates"), span).alias(k) for k, f in functions.items()])


def resolve_in_python(spans: DataFrame, functions: dict[str, Callable[[dict], object]], kinds: dict[str, str]) -> DataFrame:
    """The same for Python functions of a span, a dict of its columns (candidates: dicts, in order).

    ``kinds`` gives the type of each value. Spans go to the workers in batches; nothing is shuffled.
    """
    base = spans.columns[: spans.columns.index("candidates") + 1]
    schema = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in base) + "".join(f", `{k}` {kinds[k]}" for k in functions)

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{**x, "candidates": list(x["candidates"])} for x in frame.to_dict("records")]
            yield frame[base].assign(**{k: pd.Series([f(x) for x in rows], index=frame.index, dtype=object) for k, f in functions.items()})

    return spans.mapInPandas(values, schema)


def resolve_hits(hits: DataFrame, name: str, longest_window: bool = True, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, name): ``longest`` or ``shortest`` of each span, straight from its hits.

    One candidate a span is shuffled, after the hits of each task have been summed up.
    """
    pick = F.max_by if longest_window else F.min_by
    hit = F.struct("start", "stop", F.slice("responses", 1, 1).alias("responses"))
    best = hits.groupBy(id_col, "sent_idx", "start").agg(F.max("stop").alias("stop"), pick(hit, "stop").alias("hit"))
    return best.select(id_col, "sent_idx", "start", "stop", F.get(candidates_of(F.col("hit")), 0).alias(name))
