"""Queries of the extraction engine over the tables, and the same in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.functions.stem import MODES, stem, stem_sql
from lexispan.functions.words import STOP_WORDS, dropping, is_alpha, not_among, word_type
from lexispan.operators import corpus as C
from lexispan.operators import match as M
from lexispan.operators import prefix as P
from lexispan.operators import resolve as R
from lexispan.operators.ask import asked_hits
from lexispan.plans.pipeline import Pipeline, load_texts, match_windows, process_spans, process_words
from lexispan.sources.knowledge import from_dict, from_ngrams
from lexispan.sources.registry import KnowledgeBase, Registry, fingerprint
from lexispan.sources.shared import shared_dir
from lexispan.sources.texts import dealt, parts_of, read_texts

SPAN = ("doc_id", "sent_idx", "start", "stop")
#: The share of the texts that tables of common words and hot queries are estimated from; results do not depend on it.
SAMPLE = 0.05
#: Bytes of a table of texts whose windows are counted in one task.
COUNTED_BYTES = 2 << 20


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table is one file here; as many tasks as cores split its texts."""
    return dealt(read_texts(spark, f"{sf_dir}/documents.parquet"))


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_sentences(docs(spark, sf_dir))


def registered(spark: SparkSession, sf_dir: str, name: str, build: Callable[[DataFrame], DataFrame], **more) -> KnowledgeBase:
    """A knowledge base made from the benchmark's items; registered once for a table as long as its files stay."""
    path = f"{sf_dir}/benchmark.parquet"
    registry = Registry(spark, f"{shared_dir(spark)}/lexispan-knowledge/{hashlib.sha256(path.encode()).hexdigest()[:16]}")
    return registry.ensure(name, fingerprint(spark, path), lambda: build(spark.read.parquet(path)), **more)


def base_kb(spark: SparkSession, sf_dir: str, **more) -> KnowledgeBase:
    """All windows of the benchmark's items, answering with their ids."""
    return registered(spark, sf_dir, "items", lambda items: from_ngrams(items, 4, "item_id"), **more)


def lowered(w):
    return F.lower(w)


def dropped(w):
    return dropping(is_alpha, not_among("in", "is", "of"))(w)


def stemmed(w):
    return stem(w)


def no_stop_words(w):
    return F.when(~F.lower(w).isin(*STOP_WORDS), F.lower(w))


def sizes_of(spark, sf_dir, size=4, pre_filter=lowered):
    return M.span_sizes_of(sents(spark, sf_dir), base_kb(spark, sf_dir), size, pre_filter)


def spans_of(spark, sf_dir, size=4, pre_filter=lowered):
    return M.match(sents(spark, sf_dir), base_kb(spark, sf_dir), size, pre_filter)


def span_max_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.best_in_row(sents(spark, sf_dir), P.Matcher(base_kb(spark, sf_dir), 4, lowered), "best")
    return found.select(*SPAN, F.col("best.concept_id").alias("concept_id"), (F.col("best.stop") - F.col("best.start")).alias("n_words"))


def span_min_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.resolve(spans_of(spark, sf_dir), {"best": R.shortest})
    return found.select(*SPAN, F.col("best.concept_id").alias("concept_id"), (F.col("best.stop") - F.col("best.start")).alias("n_words"))


def words_with(name, column):
    return lambda spark, sf_dir: C.words(sents(spark, sf_dir)).select("doc_id", "sent_idx", "word_idx", "word", column(F.col("word")).alias(name))


def stems(mode, to_lowercase=True):
    def query(spark, sf_dir):
        return C.words(sents(spark, sf_dir)).select("word").distinct().select("word", stem(F.col("word"), mode, to_lowercase).alias("stem"))

    return query


def word_metadata(spark, sf_dir):
    """Stems of the common words of a sample of the texts are looked up, those of others computed in place."""
    d = docs(spark, sf_dir)
    known = C.common_words(C.split_sentences(d.sample(SAMPLE, seed=5)), {"stem": stemmed})
    found = C.words_by_vocabulary(C.split_sentences(d), {"stem": stemmed}, known)
    return found.select("*", F.lower("word").alias("lowercase"), word_type(F.col("word")).alias("type"))


def word_metadata_replaced(spark, sf_dir):
    """A second word processor sees the first one's values and takes their place."""
    once = C.annotate(sents(spark, sf_dir), {"lowercase": lambda w: F.lower(w), "type": lambda w: word_type(w)})
    return C.words(C.annotate(once, {"tagged": lambda w, meta: F.concat_ws("/", meta["lowercase"], meta["type"])}))


def prefilter_query(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", "sent_idx", F.array_join(F.filter(F.transform("words", dropped), lambda w: w.isNotNull() & (w != "")), " ").alias("query"))


def query_ngrams(spark, sf_dir):
    d = docs(spark, sf_dir)
    return M.window_counts(C.split_sentences(d), 4, lowered, parts_of(d, COUNTED_BYTES))


def candidate_rows(spark, sf_dir):
    hits = M.find_hits(sents(spark, sf_dir), base_kb(spark, sf_dir), 4, lowered)
    return M.candidates(hits).select(*SPAN, "resp_idx", "concept_id")


def span_text(spark, sf_dir):
    s = sents(spark, sf_dir)
    return M.span_text(M.match(s, base_kb(spark, sf_dir), 4, lowered), s).select(*SPAN, "span_text")


def span_empty_check(spark, sf_dir):
    """All spans, and the one at the third word of every sentence, which is empty where nothing starts there."""
    s, kb = sents(spark, sf_dir), base_kb(spark, sf_dir)
    found = M.match(s, kb, 4, lowered).unionByName(M.find_span(s, kb, 2, 4, lowered))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(M.is_empty(F.col("candidates"), F.col("start"), F.col("stop")).cast("long")).alias("n_empty"))


def match_stemmed(spark, sf_dir):
    """Words and knowledge base both by stems; those of common words of a sample are read from a table, others computed in place."""
    d = docs(spark, sf_dir)
    known = C.known_values(C.split_sentences(d.sample(SAMPLE, seed=5)), stemmed)
    return M.span_sizes_of(C.split_by_known(d, stemmed, known), registered(spark, sf_dir, "stems", stem_kb), 4)


def stem_kb(items: DataFrame) -> DataFrame:
    found = M.windows(C.split_sentences(items, "item_id"), 4, stemmed, "item_id").select("query", "item_id").distinct()
    return found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("item_id").alias("concept_id")))).alias("responses"))


def two_matchers(spark, sf_dir):
    kb = base_kb(spark, sf_dir)
    line = Pipeline().add(load_texts(docs(spark, sf_dir)), "texts").add(match_windows(kb, 1, lowered), "one").add(match_windows(kb, 2, lowered), "two")
    return line.run().spans.select(*SPAN, "matcher_idx", F.size("candidates").cast("int").alias("n_candidates"))


def full_line(spark, sf_dir, size=4):
    line = Pipeline().add(load_texts(docs(spark, sf_dir)), "texts")
    line.add(process_words({"lowercase": lambda w: F.lower(w), "type": lambda w: word_type(w)}), "words")
    line.add(match_windows(base_kb(spark, sf_dir), size, lambda w, meta: F.when(meta["type"] == "STANDARD", meta["lowercase"])), "match")
    return line.add(process_spans({"best": R.longest}), "resolve")


def pipeline_full(spark, sf_dir):
    return full_line(spark, sf_dir).run().spans.select(*SPAN, F.col("best.concept_id").alias("concept_id"))


def pipeline_replace_node(spark, sf_dir):
    """The matcher is added again under its name: the new one runs in the old one's place."""
    line = full_line(spark, sf_dir)
    line.add(match_windows(base_kb(spark, sf_dir), 2, lowered), "match")
    return line.run().spans.select(*SPAN, F.col("best.concept_id").alias("concept_id"))


def custom_query_method(spark, sf_dir):
    """A Python function as knowledge base: it knows words of six letters by their length."""
    known = lambda q: [{"concept_id": f"six:{q}"}] if len(q) == 6 and " " not in q else None
    return M.span_sizes(asked_hits(sents(spark, sf_dir), known, 2, lowered))


def custom_word_udf(spark, sf_dir):
    """A Python function on words, run in batches where the words stand; for costly ones there is ``map_words``."""

    @F.pandas_udf("string")
    def backwards(w: pd.Series) -> pd.Series:
        return w.str[::-1]

    return C.words(sents(spark, sf_dir)).withColumn("backwards", backwards("word"))


#: A small knowledge base with metadata in its responses.
SUFFIX_KB = {"the": [{"concept_id": 3, "kind": "article", "weight": 0.5}], "of the": [{"concept_id": 7, "kind": "pair", "weight": 2.0}, {"concept_id": 8, "kind": "phrase", "weight": 1.5}], "the and": [{"concept_id": 11, "kind": "pair", "weight": 2.5}], "and": [{"concept_id": 4, "kind": "link", "weight": 0.25}]}


def span_responses(spark, sf_dir):
    """Whole responses as the candidates' metadata, and resolvers that see the span: its heaviest candidate and width."""
    found = M.match(sents(spark, sf_dir), from_dict(spark, SUFFIX_KB), 2, lowered)
    heaviest = lambda cs: F.get(F.array_sort(F.transform(cs, lambda c: F.struct((-c["response"]["weight"]).alias("w"), c["response"].alias("r")))), 0)["r"]
    width = lambda cs, span: span["stop"] - span["start"]
    out = R.resolve(found, {"heaviest": heaviest, "width": width})
    return out.select(*SPAN, "heaviest.concept_id", "heaviest.kind", "heaviest.weight", "width")


def resolver_python(spark, sf_dir):
    """A resolver that is a Python function of the span."""
    found = M.match(sents(spark, sf_dir), from_dict(spark, SUFFIX_KB), 2, lowered)
    total = lambda span: sum(c["concept_id"] for c in span["candidates"]) + span["stop"]
    return R.resolve_in_python(found, {"total": total}, {"total": "long"}).select(*SPAN, "total")


def find_span(spark, sf_dir):
    """The span at the third word of every sentence; an empty one where there is none."""
    found = M.find_span(sents(spark, sf_dir), base_kb(spark, sf_dir), 2, 4, lowered)
    return found.select(*SPAN, F.size("candidates").cast("int").alias("n_candidates"))


def document_parts(spark, sf_dir):
    """``document[1:-1]`` and ``document[-1]``."""
    found = C.parts_in_row(docs(spark, sf_dir), {"1:-1": (1, -1), "-1": -1})
    return found.select("doc_id", "part", "sent_idx", C.sentence_text(F.col("words")).alias("text"))


def spans_by_candidates(spark, sf_dir):
    """Candidates added one by one to a span for each sentence, in order of their start, longest first.

    The span of an even sentence begins with a candidate without width at its start, so the next one sets it anew.
    """
    s = sents(spark, sf_dir)
    hits = M.candidates_by_window(M.windows(s, 2, lowered), from_dict(spark, SUFFIX_KB))
    rows = M.candidates(hits).select("doc_id", "sent_idx", F.struct("start", (-F.col("stop")).alias("s"), "resp_idx").alias("nth"), "start", "stop", "concept_id")
    zero = F.lit(0)
    empty = s.where("sent_idx % 2 = 0 AND size(words) > 0").select("doc_id", "sent_idx", F.struct(F.lit(-1).alias("start"), zero.alias("s"), zero.alias("resp_idx")).alias("nth"), zero.alias("start"), zero.alias("stop"), zero.cast("long").alias("concept_id"))
    return M.spans_of_candidates(rows.unionByName(empty), "doc_id", "sent_idx").select(*SPAN, F.size("candidates").cast("int").alias("n_candidates"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    s = sents
    return {
        "span_max_candidate": span_max_candidate,
        "sentences": lambda spark, d: s(spark, d).select("doc_id", "sent_idx", F.size("words").cast("int").alias("n_words")),
        "words": lambda spark, d: C.words(s(spark, d)),
        "doc_len": lambda spark, d: C.texts_in_row(docs(spark, d)).select("doc_id", "n_sentences"),
        "sentence_len": lambda spark, d: s(spark, d).select("doc_id", "sent_idx", F.size("words").cast("int").alias("len")),
        "empty_sentences": lambda spark, d: s(spark, d).where(F.size("words") == 0).select("doc_id", "sent_idx"),
        "sentence_str": lambda spark, d: s(spark, d).select("doc_id", "sent_idx", C.sentence_text(F.col("words")).alias("text")),
        "document_str": lambda spark, d: C.texts_in_row(docs(spark, d)).select("doc_id", "text"),
        "sentence_slice": lambda spark, d: C.sentence_slice(s(spark, d), 1, -1),
        "word_lower": words_with("lowercase", F.lower),
        "word_type": words_with("type", word_type),
        "word_type_cased": words_with("type", lambda w: word_type(w, to_lowercase=False)),
        "word_metadata": word_metadata,
        "word_metadata_replaced": word_metadata_replaced,
        "stem_nltk": stems(MODES[0]),
        "stem_martin": stems(MODES[1]),
        "stem_original": stems(MODES[2]),
        "stem_cased": stems(MODES[0], to_lowercase=False),
        "query_ngrams": query_ngrams,
        "prefilter_query": prefilter_query,
        "candidates": candidate_rows,
        "spans": lambda spark, d: sizes_of(spark, d),
        "span_text": span_text,
        "span_empty_check": span_empty_check,
        "span_candidate_count": lambda spark, d: sizes_of(spark, d).groupBy("n_candidates").agg(F.count(F.lit(1)).alias("n_spans")),
        "span_min_candidate": span_min_candidate,
        "match_stemmed": match_stemmed,
        "match_drop_stopwords": lambda spark, d: sizes_of(spark, d, 4, no_stop_words),
        "match_default_prefilter": lambda spark, d: sizes_of(spark, d, 4, None),
        "match_window_1": lambda spark, d: sizes_of(spark, d, 1),
        "match_window_2": lambda spark, d: sizes_of(spark, d, 2),
        "match_window_8": lambda spark, d: sizes_of(spark, d, 8),
        "two_matchers_append": two_matchers,
        "pipeline_full": pipeline_full,
        "pipeline_replace_node": pipeline_replace_node,
        "custom_query_method": custom_query_method,
        "custom_word_udf": custom_word_udf,
        "span_responses": span_responses,
        "resolver_python": resolver_python,
        "find_span": find_span,
        "document_parts": document_parts,
        "spans_by_candidates": spans_by_candidates,
    }


# -- SQL --------------------------------------------------------------------------------------


def sents_sql(source: str = "documents", id_col: str = "doc_id") -> str:
    """(id, sent_idx, words)"""
    return f"""SELECT {id_col}, CAST(i - 1 AS INTEGER) AS sent_idx, list_filter(regexp_split_to_array(p[i], '[,;:| ()]+'), lambda x: length(x) > 0) AS words
      FROM (SELECT {id_col}, p, unnest(generate_series(1, len(p))) AS i FROM
        (SELECT {id_col}, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[.?!|]+'), lambda x: length(x) > 0) AS p FROM {source}))"""


def words_sql(source: str = "documents", id_col: str = "doc_id") -> str:
    return f"SELECT {id_col}, sent_idx, CAST(j - 1 AS INTEGER) AS word_idx, words[j] AS word FROM (SELECT *, unnest(generate_series(1, len(words))) AS j FROM ({sents_sql(source, id_col)}))"


def kept_sql(sentences: str, word: str, id_col: str = "doc_id") -> str:
    """Sentences with ``kept``: an SQL expression of x for each word, null if it is left out."""
    return f"SELECT {id_col}, sent_idx, len(words) AS n, list_transform(words, lambda x: {word}) AS kept FROM ({sentences})"


def windows_sql(kept: str, size: int, id_col: str = "doc_id") -> str:
    return f"""SELECT {id_col}, sent_idx, CAST(i AS INTEGER) AS start, CAST(i + k AS INTEGER) AS stop, coalesce(array_to_string(list_filter(kept[i + 1:i + k], lambda w: w IS NOT NULL AND w <> ''), ' '), '') AS query
      FROM (SELECT *, unnest(range(n)) AS i FROM ({kept})), (SELECT unnest(range(1, {size + 1})) AS k) WHERE i + k <= n"""


def kb_sql(word: str = "lower(x)") -> str:
    return f"SELECT query, item_id AS concept_id, row_number() OVER (PARTITION BY query ORDER BY item_id) - 1 AS resp_idx FROM (SELECT DISTINCT query, item_id FROM ({windows_sql(kept_sql(sents_sql('benchmark', 'item_id'), word, 'item_id'), 4, 'item_id')}))"


def candidates_sql(word: str = "lower(x)", size: int = 4, kb: str | None = None) -> str:
    return f"SELECT doc_id, sent_idx, start, stop, CAST(resp_idx AS INTEGER) AS resp_idx, concept_id FROM ({windows_sql(kept_sql(sents_sql(), word), size)}) JOIN ({kb or kb_sql()}) USING (query)"


def spans_sql(candidates: str) -> str:
    return f"SELECT doc_id, sent_idx, start, max(stop) AS stop, CAST(count(*) AS INTEGER) AS n_candidates FROM ({candidates}) GROUP BY doc_id, sent_idx, start"


def best_sql(candidates: str, order: str) -> str:
    return f"""SELECT doc_id, sent_idx, start, whole AS stop, concept_id, n_words FROM (SELECT doc_id, sent_idx, start, max(stop) OVER s AS whole, concept_id, stop - start AS n_words,
      row_number() OVER (PARTITION BY doc_id, sent_idx, start ORDER BY {order}, resp_idx) AS nth FROM ({candidates}) WINDOW s AS (PARTITION BY doc_id, sent_idx, start)) WHERE nth = 1"""


STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
LETTERS = "regexp_full_match(x, '\\p{L}+')"


def oracle_sql() -> dict[str, str]:
    w, s = words_sql(), sents_sql()
    typed = lambda x: f"CASE WHEN {x} IN ({STOP_SQL}) THEN 'STOP_WORD' ELSE 'STANDARD' END"
    vocabulary = f"SELECT DISTINCT word FROM ({w})"
    found = candidates_sql()
    plain = f"CASE WHEN lower(x) NOT IN ({STOP_SQL}) THEN lower(x) END"
    stem_kept = lambda source, i: f"SELECT {i}, sent_idx, count(*) AS n, list(stem ORDER BY word_idx) AS kept FROM ({words_sql(source, i)}) JOIN ({stem_sql(f'SELECT DISTINCT word FROM ({words_sql(source, i)})')}) USING (word) GROUP BY {i}, sent_idx"
    stem_kb_sql = f"SELECT DISTINCT query, item_id AS concept_id, 0 AS resp_idx FROM ({windows_sql(stem_kept('benchmark', 'item_id'), 4, 'item_id')})"
    kb_rows = ", ".join(f"('{q}', {k}, {r['concept_id']}, '{r['kind']}', {r['weight']})" for q, rs in SUFFIX_KB.items() for k, r in enumerate(rs))
    known = f"SELECT doc_id, sent_idx, start, stop, resp_idx, CAST(concept_id AS BIGINT) AS concept_id, kind, CAST(weight AS DOUBLE) AS weight FROM ({windows_sql(kept_sql(s, 'lower(x)'), 2)}) JOIN (VALUES {kb_rows}) AS kb (query, resp_idx, concept_id, kind, weight) USING (query)"
    return {
        "span_max_candidate": best_sql(found, "stop DESC"),
        "sentences": f"SELECT doc_id, sent_idx, CAST(len(words) AS INTEGER) AS n_words FROM ({s})",
        "words": w,
        "doc_len": f"SELECT doc_id, CAST(count(sent_idx) AS INTEGER) AS n_sentences FROM documents LEFT JOIN ({s}) USING (doc_id) GROUP BY doc_id",
        "sentence_len": f"SELECT doc_id, sent_idx, CAST(len(words) AS INTEGER) AS len FROM ({s})",
        "empty_sentences": f"SELECT doc_id, sent_idx FROM ({s}) WHERE len(words) = 0",
        "sentence_str": f"SELECT doc_id, sent_idx, coalesce(array_to_string(words, ' '), '') AS text FROM ({s})",
        "document_str": f"SELECT doc_id, coalesce(string_agg(coalesce(array_to_string(words, ' '), ''), '.' || chr(10) ORDER BY sent_idx) FILTER (WHERE sent_idx IS NOT NULL), '') || '.' AS text FROM documents LEFT JOIN ({s}) USING (doc_id) GROUP BY doc_id",
        "sentence_slice": f"SELECT doc_id, sent_idx, coalesce(array_to_string(words[2:len(words) - 1], ' '), '') AS text FROM ({s})",
        "word_lower": f"SELECT *, lower(word) AS lowercase FROM ({w})",
        "word_type": f"SELECT *, {typed('lower(word)')} AS type FROM ({w})",
        "word_type_cased": f"SELECT *, {typed('word')} AS type FROM ({w})",
        "word_metadata": f"SELECT *, lower(word) AS lowercase, {typed('lower(word)')} AS type FROM ({w}) JOIN ({stem_sql(vocabulary)}) USING (word)",
        "word_metadata_replaced": f"SELECT *, lower(word) || '/' || {typed('lower(word)')} AS tagged FROM ({w})",
        "stem_nltk": stem_sql(vocabulary, MODES[0]),
        "stem_martin": stem_sql(vocabulary, MODES[1]),
        "stem_original": stem_sql(vocabulary, MODES[2]),
        "stem_cased": stem_sql(vocabulary, MODES[0], to_lowercase=False),
        "query_ngrams": f"SELECT query, count(*) AS n, CAST(min(stop - start) AS INTEGER) AS n_words FROM ({windows_sql(kept_sql(s, 'lower(x)'), 4)}) GROUP BY query",
        "prefilter_query": f"SELECT doc_id, sent_idx, coalesce(array_to_string(list_filter(kept, lambda k: k IS NOT NULL), ' '), '') AS query FROM ({kept_sql(s, f'CASE WHEN {LETTERS} AND lower(x) NOT IN (' + chr(39) + 'in' + chr(39) + ', ' + chr(39) + 'is' + chr(39) + ', ' + chr(39) + 'of' + chr(39) + ') THEN lower(x) END')})",
        "candidates": found,
        "spans": spans_sql(found),
        "span_text": f"SELECT doc_id, sent_idx, start, stop, array_to_string(words[start + 1:stop], ' ') AS span_text FROM ({spans_sql(found)}) JOIN ({s}) USING (doc_id, sent_idx)",
        "span_empty_check": f"""WITH s AS ({s}), spans AS ({spans_sql(found)}), third AS (SELECT doc_id, sent_idx, coalesce(stop, 2) AS stop, coalesce(n_candidates, 0) AS n_candidates FROM s LEFT JOIN (SELECT * FROM spans WHERE start = 2) USING (doc_id, sent_idx)),
          both_ AS (SELECT doc_id, start, stop, n_candidates FROM spans UNION ALL SELECT doc_id, 2, stop, n_candidates FROM third)
          SELECT doc_id, count(*) AS n_spans, CAST(count(*) FILTER (WHERE n_candidates = 0 OR start = stop) AS BIGINT) AS n_empty FROM both_ GROUP BY doc_id""",
        "span_candidate_count": f"SELECT n_candidates, count(*) AS n_spans FROM ({spans_sql(found)}) GROUP BY n_candidates",
        "span_min_candidate": best_sql(found, "stop"),
        "match_stemmed": spans_sql(f"SELECT doc_id, sent_idx, start, stop FROM ({windows_sql(stem_kept('documents', 'doc_id'), 4)}) JOIN ({stem_kb_sql}) USING (query)"),
        "match_drop_stopwords": spans_sql(candidates_sql(plain)),
        "match_default_prefilter": spans_sql(candidates_sql("x")),
        "match_window_1": spans_sql(candidates_sql(size=1)),
        "match_window_2": spans_sql(candidates_sql(size=2)),
        "match_window_8": spans_sql(candidates_sql(size=8)),
        "two_matchers_append": f"SELECT *, CAST(0 AS INTEGER) AS matcher_idx FROM ({spans_sql(candidates_sql(size=1))}) UNION ALL SELECT *, CAST(1 AS INTEGER) FROM ({spans_sql(candidates_sql(size=2))})",
        "pipeline_full": f"SELECT * EXCLUDE (n_words) FROM ({best_sql(candidates_sql(plain), 'stop DESC')})",
        "pipeline_replace_node": f"SELECT * EXCLUDE (n_words) FROM ({best_sql(candidates_sql(size=2), 'stop DESC')})",
        "custom_query_method": f"SELECT doc_id, sent_idx, start, max(stop) AS stop, CAST(count(*) AS INTEGER) AS n_candidates FROM ({windows_sql(kept_sql(s, 'lower(x)'), 2)}) WHERE length(query) = 6 AND query NOT LIKE '% %' GROUP BY doc_id, sent_idx, start",
        "custom_word_udf": f"SELECT *, reverse(word) AS backwards FROM ({w})",
        "span_responses": f"SELECT doc_id, sent_idx, start, whole AS stop, concept_id, kind, weight, whole - start AS width FROM (SELECT *, max(stop) OVER s AS whole, row_number() OVER (PARTITION BY doc_id, sent_idx, start ORDER BY weight DESC) AS nth FROM ({known}) WINDOW s AS (PARTITION BY doc_id, sent_idx, start)) WHERE nth = 1",
        "resolver_python": f"SELECT doc_id, sent_idx, start, max(stop) AS stop, CAST(sum(concept_id) + max(stop) AS BIGINT) AS total FROM ({known}) GROUP BY doc_id, sent_idx, start",
        "find_span": f"SELECT doc_id, sent_idx, CAST(2 AS INTEGER) AS start, coalesce(stop, 2) AS stop, coalesce(n_candidates, 0) AS n_candidates FROM ({s}) LEFT JOIN (SELECT * FROM ({spans_sql(found)}) WHERE start = 2) USING (doc_id, sent_idx)",
        "document_parts": f"WITH s AS (SELECT doc_id, sent_idx, coalesce(array_to_string(words, ' '), '') AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM ({s})) SELECT doc_id, '1:-1' AS part, sent_idx, text FROM s WHERE sent_idx >= 1 AND sent_idx < n - 1 UNION ALL SELECT doc_id, '-1', sent_idx, text FROM s WHERE sent_idx = n - 1",
        "spans_by_candidates": f"""WITH real_ AS (SELECT doc_id, sent_idx, min(start) AS start, max(stop) AS stop, count(*) AS n FROM ({known}) GROUP BY doc_id, sent_idx),
          zero AS (SELECT doc_id, sent_idx FROM ({s}) WHERE sent_idx % 2 = 0 AND len(words) > 0)
          SELECT doc_id, sent_idx, CAST(coalesce(start, 0) AS INTEGER) AS start, CAST(coalesce(stop, 0) AS INTEGER) AS stop, CAST(coalesce(n, 0) + CASE WHEN z.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_candidates
          FROM real_ r FULL JOIN zero z USING (doc_id, sent_idx)""",
    }
