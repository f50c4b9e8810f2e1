"""Sliding-window matching: shrinking word windows are looked up in a knowledge base by an equi-join.

``hits``: id, sent_idx, start, stop, responses; one row for each window that the knowledge base answers.
``spans``: id, sent_idx, matcher_idx, start, stop, candidates array<struct<start, stop, resp_idx,
concept_id, response>>, longest window first, responses in their order; one row for each start that
has a candidate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.operators.corpus import call
from lexispan.sources.registry import KnowledgeBase

#: Windows of at most so many words are written out one by one, which the compiler likes; longer ones use lambdas.
WRITTEN_OUT = 16
#: Windows of registered knowledge bases grow word by word up to so many words; each is a level of the plan.
LEVELS = 16
#: Counted windows are dealt by their first two words to so many buckets, and these to tasks.
BUCKETS = 1 << 20


def kept_words(sentences: DataFrame, pre_filter: Callable[..., Column] | None) -> Column:
    """The words as they are looked up; null where ``pre_filter`` gives null or '', which leaves them out."""
    filled = lambda ws: F.transform(ws, lambda w: F.when(w != "", w))  # noqa: E731  a second pass, so that no filter is computed twice
    if pre_filter is None:
        return F.col("words")
    if "meta" in sentences.columns:
        return filled(F.transform(F.arrays_zip("words", "meta"), lambda p: call(pre_filter, p["words"], p["meta"])))
    return filled(F.transform("words", lambda w: call(pre_filter, w)))


def windows(sentences: DataFrame, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, query) of all windows of at most ``size`` words within a sentence.

    Words for which ``pre_filter`` gives null or '' are left out of the query but not of the window.
    """
    if size <= 0:
        sentences, size = sentences.where(F.lit(False)), 1
    rows = sentences.select(id_col, "sent_idx", F.size("words").alias("n"), kept_words(sentences, pre_filter).alias("kept"))
    # no filter on the words' number before: it would split the texts once more
    starts = rows.select(id_col, "sent_idx", "n", "kept", F.posexplode_outer("kept").alias("start", "first")).where("start IS NOT NULL")
    left = F.col("n") - F.col("start")
    window = lambda k, query: F.struct((F.col("start") + k).cast("int").alias("stop"), query.alias("query"))
    if size <= WRITTEN_OUT:
        words = [F.col("first"), *[F.get("kept", F.col("start") + k) for k in range(1, size)]]
        made = F.slice(F.array(*[window(k, F.concat_ws(" ", *words[:k])) for k in range(1, size + 1)]), 1, F.least(F.lit(size), left))
    else:
        made = F.transform(F.sequence(F.lit(1), F.least(F.lit(size), left)), lambda k: window(k, F.array_join(F.slice("kept", F.col("start") + 1, k), " ")))
    # explode_outer: a plain explode makes the optimizer compute the windows once more for a filter
    return starts.select(id_col, "sent_idx", "start", F.explode_outer(made).alias("w")).select(id_col, "sent_idx", "start", "w.stop", "w.query")


def window_counts(sentences: DataFrame, size: int = 4, pre_filter: Callable[..., Column] | None = None, parts: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(query, n, n_words) of all ``windows``: how many have a query, and the number of words of the shortest.

    A start is shuffled once, as its longest window, to a bucket of that query's first two words, where its shorter windows of
    two words or more are counted too. Starts with words that are left out, or that hold spaces, send their windows one by
    one. Queries without a space are summed in each task first. ``parts``: tasks that count; each keeps its part's queries.
    """
    if size <= 0 or size > WRITTEN_OUT:
        found = windows(sentences, size, pre_filter, id_col)
        return found.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("stop") - F.col("start")).cast("int").alias("n_words"))
    rows = sentences.select(F.size("words").alias("n"), kept_words(sentences, pre_filter).alias("kept"))
    starts = rows.select("n", "kept", F.posexplode_outer("kept").alias("start", "first")).where("start IS NOT NULL")
    m = F.least(F.lit(size), F.col("n") - F.col("start")).cast("int")
    starts = starts.select(m.alias("m"), F.nullif("first", F.lit("")).alias("w1"), *[F.nullif(F.get("kept", F.col("start") + k), F.lit("")).alias(f"w{k + 1}") for k in range(1, size)])
    names = [f"w{k}" for k in range(1, size + 1)]
    plain = sum((F.coalesce(~F.contains(F.col(w), F.lit(" ")), F.lit(False)).cast("int") for w in names), F.lit(0)) == F.col("m")
    row = lambda query, k: F.struct(query.alias("query"), k.alias("k"))  # noqa: E731  k below 0: all windows of -k words or fewer
    each = F.array(*[F.when(F.col("m") >= k, row(F.concat_ws(" ", *names[:k]), F.lit(k))) for k in range(1, size + 1)])
    sent = starts.select(F.explode_outer(F.when(plain, F.array(row(F.concat_ws(" ", *names), -F.col("m")))).otherwise(each)).alias("w")).where("w IS NOT NULL")
    bucket = F.pmod(F.xxhash64(F.substring_index("query", " ", 2)), F.lit(BUCKETS)).cast("int")
    dealt = sent.select("w.query", "w.k").select(bucket.alias("bucket"), "query", "k")
    dealt = dealt.repartition(parts, "bucket") if parts else dealt.repartition("bucket")
    single = F.when(F.col("k") < 0, row(F.substring_index("query", " ", 1), F.lit(1))).when(~F.contains(F.col("query"), F.lit(" ")), row(F.col("query"), F.col("k")))
    longer = [F.when(F.col("k") <= -k, row(F.substring_index("query", " ", k), F.lit(k))) for k in range(2, size + 1)]
    one_by_one = F.when((F.col("k") > 0) & F.contains(F.col("query"), F.lit(" ")), row(F.col("query"), F.col("k")))
    counted = [F.count(F.lit(1)).alias("n"), F.min("k").alias("n_words")]
    # a filter of an exploded column is not pushed below the shuffle, so both counts read the same one
    singles = dealt.select(F.explode_outer(F.array(single)).alias("w")).where("w IS NOT NULL").select("w.query", "w.k").groupBy("query").agg(*counted)
    others = dealt.select("bucket", F.explode_outer(F.array(*longer, one_by_one)).alias("w")).where("w IS NOT NULL").select("bucket", "w.query", "w.k")
    return singles.unionByName(others.groupBy("bucket", "query").agg(*counted).drop("bucket"))


def candidates_by_window(found: DataFrame, kb: DataFrame) -> DataFrame:
    """Windows that the knowledge base answers, with ``responses``.

    The optimizer sends the knowledge base to all executors if its size in bytes, by the statistics of its
    table or of the shuffle that made it, is below ``spark.sql.autoBroadcastJoinThreshold``, else it joins by shuffles.
    """
    return found.join(kb, "query")


def candidates(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each response: id, sent_idx, start, stop, resp_idx, concept_id, response."""
    rows = hits.select(id_col, "sent_idx", "start", "stop", F.posexplode("responses").alias("resp_idx", "r"))
    return rows.select(id_col, "sent_idx", "start", "stop", "resp_idx", F.col("r.concept_id").alias("concept_id"), F.col("r").alias("response"))


def candidates_of(hit: Column) -> Column:
    """The candidates of one hit (start, stop, responses)."""
    return F.transform(hit["responses"], lambda r, k: F.struct(hit["start"].alias("start"), hit["stop"].alias("stop"), k.alias("resp_idx"), r["concept_id"].alias("concept_id"), r.alias("response")))


def fold_spans(hits: DataFrame, matcher_idx: int = 0, id_col: str = "doc_id") -> DataFrame:
    """Hits of one start become a span."""
    shrinking = F.array_sort(F.collect_list(F.struct((-F.col("stop")).alias("order"), "start", "stop", "responses")))
    grouped = hits.groupBy(id_col, "sent_idx", "start").agg(F.max("stop").alias("stop"), shrinking.alias("hits"))
    return grouped.select(id_col, "sent_idx", F.lit(matcher_idx).alias("matcher_idx"), "start", "stop", F.flatten(F.transform("hits", candidates_of)).alias("candidates"))


def _grows(kb: DataFrame | KnowledgeBase, size: int) -> bool:
    """Whether the spans of a start are found in its row."""
    return isinstance(kb, KnowledgeBase) and kb.small and size <= LEVELS


def span_sizes_of(sentences: DataFrame, kb: DataFrame | KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, sent_idx, start, stop, n_candidates) of each span that ``match`` finds."""
    if _grows(kb, size):
        from lexispan.operators.prefix import Matcher, sizes_in_row

        return sizes_in_row(sentences, Matcher(kb, size, pre_filter), id_col)
    return span_sizes(find_hits(sentences, kb, size, pre_filter, id_col), id_col)


def span_sizes(hits: DataFrame, id_col: str = "doc_id", parts: int | None = None) -> DataFrame:
    """(id, sent_idx, start, stop, n_candidates) of each span; no response is shuffled. With ``parts``, hits are dealt by their
    starts to so many tasks, and none is summed up before, as few starts have several."""
    if parts:
        sizes = hits.select(id_col, "sent_idx", "start", "stop", F.size("responses").alias("n")).repartition(parts, id_col, "sent_idx", "start")
        return sizes.groupBy(id_col, "sent_idx", "start").agg(F.max("stop").alias("stop"), F.sum("n").cast("int").alias("n_candidates"))
    return hits.groupBy(id_col, "sent_idx", "start").agg(F.max("stop").alias("stop"), F.sum(F.size("responses")).cast("int").alias("n_candidates"))


def find_hits(sentences: DataFrame, kb: DataFrame | KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The windows that a knowledge base answers: grown by its prefixes if it is registered, else all looked up."""
    if not isinstance(kb, KnowledgeBase):
        return candidates_by_window(windows(sentences, size, pre_filter, id_col), kb)
    if _grows(kb, size):
        from lexispan.operators.prefix import Matcher, hit_rows

        return hit_rows(sentences, Matcher(kb, size, pre_filter), id_col)
    if kb.filter is not None and size <= LEVELS:
        from lexispan.operators.lookup import large_hits

        return large_hits(sentences, kb, size, pre_filter, id_col=id_col)
    return candidates_by_window(windows(sentences, size, pre_filter, id_col), kb.entries)


def match(sentences: DataFrame, kb: DataFrame | KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None, matcher_idx: int = 0, id_col: str = "doc_id") -> DataFrame:
    if _grows(kb, size):
        from lexispan.operators.prefix import Matcher, spans_in_row

        return spans_in_row(sentences, [Matcher(kb, size, pre_filter)], matcher_idx, id_col)
    return fold_spans(find_hits(sentences, kb, size, pre_filter, id_col), matcher_idx, id_col)


def match_all(sentences: DataFrame, matchers: Sequence[tuple], first_idx: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The spans of several matchers (kb, size, pre_filter), numbered in their order. Those with small registered
    knowledge bases, whose responses are of one type, go over the words together."""
    numbered = [(first_idx + k, *m) for k, m in enumerate(matchers)]
    together = [m for m in numbered if _grows(m[1], m[2])]
    out = None
    if len(together) > 1 and len({m[1].about["schema"] for m in together}) == 1:
        from lexispan.operators.prefix import Matcher, spans_in_row

        out = spans_in_row(sentences, [Matcher(*m) for _, *m in together], id_col=id_col)
        place = F.element_at(F.array(*[F.lit(k) for k, *_ in together]), F.col("matcher_idx") + 1)
        out = out.withColumn("matcher_idx", place)
        numbered = [m for m in numbered if m not in together]
    for k, kb, size, pre_filter in numbered:
        found = match(sentences, kb, size, pre_filter, k, id_col)
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def find_span(sentences: DataFrame, kb: DataFrame | KnowledgeBase, start: int, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The span at one start of each sentence.

    Sentences without a candidate there, and those too short to have a word there, give an empty span: stop
    is start, and there are no candidates.
    """
    n = F.size("words")
    words = F.slice("words", start + 1, size) if start >= 0 and size > 0 else F.slice("words", 1, 0)
    here = sentences.withColumns({"words": words, **({"meta": F.slice("meta", start + 1, max(size, 1))} if "meta" in sentences.columns else {})})
    if _grows(kb, size):
        from lexispan.operators.prefix import Matcher, span_at

        return span_at(here, Matcher(kb, size, pre_filter), start, id_col)
    here = here.where(n > 0)
    hits = candidates_by_window(windows(here, size, pre_filter, id_col).where(F.col("start") == 0), kb.entries if isinstance(kb, KnowledgeBase) else kb)
    hits = hits.withColumns({"start": F.col("start") + start, "stop": F.col("stop") + start})
    found = fold_spans(hits, 0, id_col)
    kind = found.schema["candidates"].dataType
    all_ = sentences.select(id_col, "sent_idx").join(found, [id_col, "sent_idx"], "left")
    return all_.select(id_col, "sent_idx", F.lit(0).alias("matcher_idx"), F.lit(start).alias("start"), F.coalesce("stop", F.lit(start)).alias("stop"), F.coalesce("candidates", F.array().cast(kind)).alias("candidates"))


def kb_from_callable(queries: DataFrame, query_method: Callable[[str], Iterable[dict] | None], response: str = "struct<concept_id:string>") -> DataFrame:
    """A knowledge base (query, responses) from a Python function, asked once for each distinct query."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers = [[r for r in (query_method(q) or []) if r] for q in frame["query"]]
            yield pd.DataFrame({"query": frame["query"], "responses": answers})

    return queries.select("query").distinct().mapInPandas(ask, f"query string, responses array<{response}>").where(F.size("responses") > 0)


def span_text(spans: DataFrame, sentences: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans with ``span_text``: their words as they stand in the sentence."""
    held = sentences.select(id_col, "sent_idx", "words")
    return spans.join(held, [id_col, "sent_idx"]).withColumn("span_text", F.array_join(F.slice("words", F.col("start") + 1, F.col("stop") - F.col("start")), " ")).drop("words")


def is_empty(candidates_col: Column, start: Column, stop: Column) -> Column:
    return (F.size(candidates_col) == 0) | (start == stop)


def spans_of_candidates(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, stop, candidates) from candidates (keys, nth, start, stop, ...), added in order of nth.

    The first candidate sets start and stop; later ones widen them, but where the span has no width so far
    the next candidate sets them anew.
    """
    fields = [c for c in rows.columns if c not in (*keys, "nth")]
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("nth", F.struct(*fields).alias("c")))).alias("listed"))
    held = listed.select(*keys, F.transform("listed", lambda x: x["c"]).alias("candidates"))
    none = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"))

    def add(span: Column, c: Column) -> Column:
        fresh = span["start"] == span["stop"]
        pick = lambda f, name: F.when(fresh, c[name].cast("int")).otherwise(f(span[name], c[name].cast("int"))).alias(name)
        return F.struct(pick(F.least, "start"), pick(F.greatest, "stop"))

    folded = held.withColumn("span", F.aggregate("candidates", none, add))
    return folded.select(*keys, "span.start", "span.stop", "candidates")
