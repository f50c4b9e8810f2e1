"""Queries with knowledge bases on disk, large ones, streams, several matchers, and spans that do not overlap."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan import queries as Q
from lexispan.operators import corpus as C
from lexispan.operators import lookup as L
from lexispan.operators import match as M
from lexispan.operators import prefix as P
from lexispan.operators import resolve as R
from lexispan.operators.overlap import without_overlaps
from lexispan.sources.registry import Registry
from lexispan.sources.shared import shared_dir
from lexispan.sources.texts import parts_of, stream_texts
from lexispan.streaming.spans import append_to, span_stream

SPAN = Q.SPAN
#: Bytes of a table of texts whose windows meet in one bucket.
BUCKET_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexispan-{name}-{uuid.uuid4().hex}"


def lookup_large_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base that is not broadcast: filters before the shuffle, hot queries of a sample of the texts salted."""
    docs, kb = Q.docs(spark, sf_dir), Q.base_kb(spark, sf_dir, bloom=True)
    hot = L.hot_queries(C.split_sentences(docs.sample(Q.SAMPLE, seed=5)), kb, 4, Q.lowered)
    return M.span_sizes(L.large_hits(C.split_sentences(docs), kb, 4, Q.lowered, hot))


def lookup_bucketed_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows go to the buckets of a registered knowledge base, which itself is not shuffled; more texts get more buckets."""
    docs = Q.docs(spark, sf_dir)
    buckets = max(parts_of(docs, BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    kb = Q.registered(spark, sf_dir, f"items_{buckets}", lambda items: Q.from_ngrams(items, 4, "item_id"), bloom=True, buckets=buckets)
    hot = L.hot_queries(C.split_sentences(docs.sample(Q.SAMPLE, seed=5)), kb, 4, Q.lowered)
    return M.span_sizes(L.bucketed_hits(C.split_sentences(docs), kb, hot, 4, Q.lowered), parts=buckets)


def window_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many windows of each size are made for windows of up to 8 words."""
    return P.windows_made(Q.sents(spark, sf_dir), P.Matcher(Q.base_kb(spark, sf_dir), 8, Q.lowered))


def nulls_kb(items: DataFrame) -> DataFrame:
    """First words of the items; odd items answer with null only, the others with null and a response."""
    first = C.words(C.split_sentences(items, "item_id"), "item_id").where("sent_idx = 0 AND word_idx = 0").groupBy(F.lower("word").alias("query")).agg(F.min("item_id").alias("item"))
    none = F.lit(None).cast("struct<concept_id:bigint,kind:string>")
    good = F.struct(F.col("item").alias("concept_id"), F.lit("first").alias("kind"))
    return first.select("query", F.when(F.col("item") % 2 == 1, F.array(none)).otherwise(F.array(none, good, none)).alias("responses"))


def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base with null responses, registered twice and loaded by name: both versions are there, the last answers."""
    registry = Registry(spark, scratch(spark, "registry"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    registry.register("First_Words", nulls_kb(items.where("item_id < 0")))
    registry.register("first_words", nulls_kb(items))
    kb = registry.load("FIRST_words")
    found = M.match(Q.sents(spark, sf_dir), kb, 2, Q.lowered)
    return found.select(*SPAN, F.col("candidates")[0]["response"]["concept_id"].alias("concept_id"), F.col("candidates")[0]["response"]["kind"].alias("kind"), F.lit(kb.version).alias("version"), F.lit(len(registry.versions("first_words"))).alias("n_versions"))


def _streamed(spark: SparkSession, sf_dir: str, name: str, arrivals: list[list[int]]) -> tuple[DataFrame, int]:
    """Texts arrive in files; after each arrival the stream runs until all is read, and is started anew for the next.
    What it appended, and the number of its micro-batches."""
    base, batches, n = scratch(spark, name), 0, sum(map(len, arrivals))
    docs, files = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 4 * spark.sparkContext.defaultParallelism
    matcher = P.Matcher(Q.base_kb(spark, sf_dir), 4, Q.lowered)
    for some in arrivals:
        for k in some:  # some files for each core, so the last task is short; they make a micro-batch
            docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).repartition(files).write.mode("append").parquet(f"{base}/in")
        texts = stream_texts(spark, f"{base}/in", files_per_batch=files)
        spans = span_stream(texts, [matcher], resolvers={"best": R.longest})
        rows = spans.select(*SPAN, F.size("candidates").cast("int").alias("n_candidates"), F.col("best.concept_id").alias("concept_id"))
        query = append_to(rows, f"{base}/out", f"{base}/state")
        query.awaitTermination()
        batches += len(query.recentProgress)
    return spark.read.schema(rows.schema).parquet(f"{base}/out"), batches


def stream_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of several micro-batches, their spans appended to a table."""
    return _streamed(spark, sf_dir, "stream", [[0, 1, 2, 3]])[0]


def stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream that is stopped, gets more texts, and goes on from its checkpoint."""
    return _streamed(spark, sf_dir, "restart", [[0], [1, 2]])[0]


def three_matchers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matchers with other sizes, word filters and knowledge bases in one pass over the words."""
    base = Q.base_kb(spark, sf_dir)
    odd = Q.registered(spark, sf_dir, "odd", lambda items: Q.from_ngrams(items.where("item_id % 2 = 1"), 4, "item_id"))
    found = M.match_all(Q.sents(spark, sf_dir), [(base, 4, Q.lowered), (odd, 3, Q.lowered), (base, 2, Q.no_stop_words)])
    return found.select(*SPAN, "matcher_idx", F.size("candidates").cast("int").alias("n_candidates"))


def spans_without_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of overlapping spans the set of greatest total weight, the square of the width."""
    sizes = M.span_sizes_of(Q.sents(spark, sf_dir), Q.base_kb(spark, sf_dir), 4, Q.lowered)
    return without_overlaps(sizes)


def costly_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A costly Python function of words, run once for each distinct word, and for each salt of a heavy one."""

    @F.pandas_udf("string")
    def turned(w: pd.Series) -> pd.Series:
        return w.str[::-1]

    docs = Q.docs(spark, sf_dir)
    return C.map_words_by_sample(C.split_sentences(docs), "turned", turned, C.split_sentences(docs.sample(Q.SAMPLE, seed=5)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (lookup_large_kb, lookup_bucketed_kb, window_growth, registry_lookup, stream_spans, stream_restarted, three_matchers, spans_without_overlap, costly_words)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    found, s = Q.candidates_sql(), Q.sents_sql()
    sizes = Q.spans_sql(found)
    longest = Q.best_sql(found, "stop DESC")
    streamed = f"SELECT a.*, b.concept_id FROM ({sizes}) a JOIN ({longest}) b USING (doc_id, sent_idx, start)"
    odd = Q.kb_sql().replace("benchmark", "(SELECT * FROM benchmark WHERE item_id % 2 = 1)")
    plain = f"CASE WHEN lower(x) NOT IN ({Q.STOP_SQL}) THEN lower(x) END"
    tagged = " UNION ALL ".join(f"SELECT *, CAST({k} AS INTEGER) AS matcher_idx FROM ({Q.spans_sql(c)})" for k, c in enumerate((found, Q.candidates_sql(size=3, kb=odd), Q.candidates_sql(plain, 2))))
    return {
        "lookup_large_kb": sizes,
        "lookup_bucketed_kb": sizes,
        "window_growth": f"""WITH w AS ({Q.windows_sql(Q.kept_sql(s, "lower(x)"), 8)}), kb AS (SELECT DISTINCT string_split(query, ' ') AS q FROM ({Q.kb_sql()})),
          cuts AS (SELECT DISTINCT array_to_string(q[1:k], ' ') AS prefix FROM (SELECT q, unnest(range(1, len(q))) AS k FROM kb)),
          grown AS (SELECT a.doc_id, a.sent_idx, a.start, a.stop FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.start = b.start AND a.stop = b.stop + 1 WHERE b.query IN (SELECT prefix FROM cuts)
            UNION ALL SELECT doc_id, sent_idx, start, stop FROM w WHERE stop = start + 1)
          SELECT CAST(k AS INTEGER) AS n_words, count(stop) AS n_windows FROM (SELECT unnest(range(1, 9)) AS k) LEFT JOIN grown ON stop - start = k GROUP BY k""",
        "registry_lookup": f"""WITH kb AS (SELECT query, item AS concept_id FROM (SELECT lower(word) AS query, min(item_id) AS item FROM ({Q.words_sql("benchmark", "item_id")}) WHERE sent_idx = 0 AND word_idx = 0 GROUP BY ALL) WHERE item % 2 = 0)
          SELECT doc_id, sent_idx, start, max(stop) AS stop, arg_max(concept_id, stop) AS concept_id, 'first' AS kind, CAST(2 AS INTEGER) AS version, CAST(2 AS INTEGER) AS n_versions FROM ({Q.windows_sql(Q.kept_sql(s, "lower(x)"), 2)}) JOIN kb USING (query) GROUP BY doc_id, sent_idx, start""",
        "stream_spans": streamed,
        "stream_restarted": streamed,
        "three_matchers": tagged,
        "costly_words": f"SELECT *, reverse(word) AS turned FROM ({Q.words_sql()})",
        "spans_without_overlap": f"""WITH RECURSIVE spans AS MATERIALIZED (SELECT * FROM ({sizes})),
          numbered AS MATERIALIZED (SELECT *, (stop - start) * (stop - start) AS w, row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY start DESC) AS k FROM spans),
          back AS (
            SELECT doc_id, sent_idx, start, stop, n_candidates, k, true AS take, [{{'place': start, 'best': CAST(w AS BIGINT)}}] AS next FROM numbered WHERE k = 1
            UNION ALL
            SELECT doc_id, sent_idx, start, stop, n_candidates, k, take >= skip, list_prepend({{'place': start, 'best': greatest(take, skip)}}, next)[1:5] FROM (
              SELECT n.*, b.next, b.next[1].best AS skip, n.w + coalesce(list_filter(b.next, lambda p: p.place >= n.stop)[1].best, 0) AS take
              FROM back b JOIN numbered n ON n.doc_id = b.doc_id AND n.sent_idx = b.sent_idx AND n.k = b.k + 1)),
          taken AS MATERIALIZED (SELECT doc_id, sent_idx, start, stop, n_candidates FROM back WHERE take),
          linked AS MATERIALIZED (SELECT a.*, b.start AS follows FROM taken a ASOF LEFT JOIN taken b ON a.doc_id = b.doc_id AND a.sent_idx = b.sent_idx AND a.stop <= b.start),
          kept AS (
            SELECT * FROM linked QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY start) = 1
            UNION ALL SELECT l.* FROM kept k JOIN linked l ON l.doc_id = k.doc_id AND l.sent_idx = k.sent_idx AND l.start = k.follows)
          SELECT doc_id, sent_idx, start, stop, n_candidates FROM kept""",
    }
