"""Named stages that are run in order; each maps a corpus to a corpus and stays lazy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from lexispan.operators.corpus import Corpus, annotate, split_sentences
from lexispan.operators.resolve import resolve
from lexispan.sources.registry import KnowledgeBase

Stage = Callable[[Corpus], Corpus]


class Pipeline:
    def __init__(self):
        self.stages: dict[str, Stage] = {}

    def add(self, stage: Stage, name: str) -> Pipeline:
        """Appends a stage; a name in use keeps its place and gets the new stage."""
        self.stages[name] = stage
        return self

    def run(self, corpus: Corpus | None = None) -> Corpus:
        corpus = corpus or Corpus()
        for stage in self.stages.values():
            corpus = stage(corpus)
        return corpus


def load_texts(texts: DataFrame, text_col: str = "text") -> Stage:
    """Sentences of the texts take the place of those there were, and their spans go."""
    return lambda c: c.with_(sentences=split_sentences(texts, c.id_col, text_col), spans=None, matchers=0)


def process_words(functions: dict[str, Callable[..., Column]]) -> Stage:
    return lambda c: c.with_(sentences=annotate(c.sentences, functions))


def match_windows(kb: DataFrame | KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None) -> Stage:
    """Appends spans, after those of earlier matchers; matchers that follow each other share a pass where they can."""
    return lambda c: c.matching(kb, size, pre_filter)


def process_spans(functions: dict[str, Callable[[Column], Column]]) -> Stage:
    return lambda c: c if c.spans is None else c.with_(spans=resolve(c.spans, functions))
