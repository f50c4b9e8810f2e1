"""Lookups in knowledge bases that are too large to broadcast.

Windows grow by the filter of prefixes and pass the filter of queries, so of those that are shuffled nearly
all are hits. Then they meet the entries: by buckets, which leaves the entries where they are, or, with ``hot``
queries known, dealt over salts, so that a query that a large share of the windows asks for is answered by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.operators.prefix import grown_windows
from lexispan.sources.registry import KnowledgeBase

#: At most so many queries are salted, those of more than a share of the asked windows of a sample.
HOT, HOT_SHARE = 256, 0.002
SALTS = 64


def hot_queries(sample: DataFrame, kb: KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """(query, salts) of queries that many windows of ``sample`` ask for, estimated in one pass without a shuffle of windows.

    The sample decides only how rows are dealt, not which hits there are.
    """
    found = grown_windows(sample, kb, size, pre_filter, id_col)
    top = found.agg(F.expr(f"approx_top_k(query, {HOT})").alias("top"), F.count(F.lit(1)).alias("all"))
    share = F.col("t.count") / F.col("all")
    return top.select(F.explode("top").alias("t"), "all").select(F.col("t.item").alias("query"), share.alias("share")).where(F.col("share") > HOT_SHARE).select("query", F.least(F.lit(SALTS), F.ceil(F.col("share") / HOT_SHARE)).cast("int").alias("salts"))


def bucketed_hits(sentences: DataFrame, kb: KnowledgeBase, hot: DataFrame, size: int = 4, pre_filter: Callable[..., Column] | None = None, id_col: str = "doc_id") -> DataFrame:
    """``large_hits`` by the buckets of the entries, which stay where they are, in memory that does not grow with the texts.

    A task holds its bucket's entries and reads windows past them, which are not sorted. Windows of ``hot`` queries are dealt over
    all buckets by keys that no entry has, and answered by the few entries of those queries, which are broadcast.
    """
    names = [id_col, "sent_idx", "start", "stop"]
    few = F.broadcast(kb.entries.join(F.broadcast(hot.select("query")), "query").select(F.col("query").alias("hot_"), F.col("responses").alias("held_")))
    found = grown_windows(sentences, kb, size, pre_filter, id_col).join(F.broadcast(hot.select(F.col("query").alias("hot_"))), F.col("query") == F.col("hot_"), "left")
    apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*names), F.lit(1 << 20)).cast("string"))
    dealt = found.select(*names, F.coalesce(F.when(F.col("hot_").isNotNull(), apart), "query").alias("key_"), "hot_")
    entries = kb.entries.select(F.col("query").alias("query_"), "responses").hint("shuffle_hash")
    met = dealt.join(entries, F.col("key_") == F.col("query_"), "left").join(few, "hot_", "left")
    query, responses = F.coalesce("hot_", "key_"), F.when(F.col("hot_").isNotNull(), F.col("held_")).otherwise(F.col("responses"))
    return met.select(query.alias("query"), *names, responses.alias("responses")).where("responses IS NOT NULL")


def large_hits(sentences: DataFrame, kb: KnowledgeBase, size: int = 4, pre_filter: Callable[..., Column] | None = None, hot: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(query, id, sent_idx, start, stop, responses) of the windows that the knowledge base answers; the
    knowledge base is not broadcast."""
    found = grown_windows(sentences, kb, size, pre_filter, id_col)
    entries = kb.entries.hint("merge")
    if hot is None:  # windows go to the buckets of the entries
        return found.join(entries, "query")
    hot = F.broadcast(hot)
    dealt = found.join(hot, "query", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(id_col, "sent_idx", "start"), "salts"), F.lit(0)).cast("int")).drop("salts")
    copies = kb.entries.join(hot, "query", "left").select("query", "responses", F.explode_outer(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return dealt.join(copies.hint("merge"), ["query", "salt"]).drop("salt")
