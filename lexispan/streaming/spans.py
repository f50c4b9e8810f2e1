"""Streams of texts.

A span's words lie in one sentence of one text, so no stage has to wait for other rows. Splitting and annotating are
stateless; with a registered knowledge base windows meet its prefix table as a stream meets a table, and a
start's hits are folded in its row: rows are appended as texts come, without state, watermark or shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexispan.operators.corpus import Corpus, annotate, split_sentences
from lexispan.operators.prefix import Matcher, spans_in_row
from lexispan.operators.resolve import resolve
from lexispan.plans.pipeline import Pipeline, Stage, load_texts


def span_stream(texts: DataFrame, matchers: list[Matcher], annotations: dict[str, Callable[..., Column]] | None = None, resolvers: dict[str, Callable[..., Column]] | None = None) -> DataFrame:
    """The spans of a stream (doc_id, text), as a stream; the same plan as over a table."""
    sentences = split_sentences(texts)
    if annotations:
        sentences = annotate(sentences, annotations)
    found = spans_in_row(sentences, matchers)
    return resolve(found, resolvers) if resolvers else found


def append_to(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", **trigger) -> StreamingQuery:
    """Appends a stream's rows to a table of files, each exactly once, also after a restart from ``checkpoint``."""
    return stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_spans(texts: DataFrame, stages: dict[str, Stage], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Runs any stages over each micro-batch of a stream (doc_id, text); ``sink`` gets spans and batch id.

    For stages that a stream cannot hold, such as lookups in knowledge bases that are not broadcast. ``sink`` has to
    be idempotent by batch id for exactly-once results.
    """

    def batch(frame: DataFrame, batch_id: int) -> None:
        line = Pipeline().add(load_texts(frame), "texts")
        for name, stage in stages.items():
            line.add(stage, name)
        spans = line.run(Corpus()).spans
        if spans is not None:
            sink(spans, batch_id)

    return texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
