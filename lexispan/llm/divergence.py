"""Operator 12: how the sources of a language differ in their terms, by DuckDB aggregation of shards.

Terms are counted by vectorized SQL in DuckDB, where texts are read, in slices of ``SLICE_BYTES``; Spark
sums the counts by language, source and term. Shards by a hash of language and term then go through
DuckDB twice: one query finds the terms that enough documents of a language hold, and one, once the
totals of all groups are known, gives partial sums of differences for all pairs of sources and the shard's
top terms of each group. Spark merges sums and rankings.

A source's share of a term is p = 1 + floor(10^9 * (count + 5) / (N + 5 V)). A pair's sum over V terms is
V * |z - z'| (z: p of a term that a source does not hold) plus, for the terms that one of the two holds,
|p - p'| - |z - z'|; so work grows with the counts that exist times the sources of their language, and only
integers are summed. Shards are so many that each holds at most about ``SHARD_ROWS`` counts and meets
about ``SHARD_WORK`` pairs of a count and a source; a term's counts are at most one for each source.

Defined cases: null text, language or source count as ''; every group that occurs is ranked, with or without
terms; a language without kept terms has pairs of value 0 and no terms; repeated rows are documents of
their own; ties go by the item's bytes; columns other than the three are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.llm.common import Scratch, require

# What a term is, and the smoothing of shares.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE, SMOOTH = 1_000_000_000, 5

SLICE_BYTES = 24 << 20
SHARD_ROWS = 500_000
SHARD_WORK = 20_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long"
PARTS = "lang string, source string, part string, item string, value long"


def _types(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


COUNT_SQL = f"""
SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM (
  SELECT lang, source, row, term, count(*) AS n FROM (
    SELECT lang, source, row, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM texts)
  GROUP BY ALL)
GROUP BY ALL
UNION ALL SELECT DISTINCT lang, source, NULL, 0, 0 FROM texts
"""

# A group's own row has no term; a language's row of a term has no source.
KEEP_SQL = """
WITH kept AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE term IS NOT NULL GROUP BY lang, term HAVING sum(docs) >= {least})
SELECT lang, source, term, n FROM counts JOIN (SELECT lang, term FROM kept) USING (lang, term)
UNION ALL SELECT lang, NULL, term, n FROM kept
UNION ALL SELECT lang, source, NULL, 0 FROM counts WHERE term IS NULL
"""

def _share(n: str, total: str) -> str:
    return f"CAST(1 + (CAST({SCALE} AS HUGEINT) * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v) AS BIGINT)"


PART_SQL = f"""
WITH z AS (SELECT lang, source, {_share("0", "total")} AS z FROM groups),
p AS (SELECT lang, source, term, n, z, {_share("n", "total")} AS p FROM counts JOIN groups USING (lang, source) JOIN z USING (lang, source)),
q AS (SELECT lang, term, {_share("n", "lang_total")} AS q FROM counts JOIN (SELECT DISTINCT lang, lang_total, v FROM groups) USING (lang) WHERE counts.source IS NULL),
met AS (
  SELECT a.lang, a.source AS a, g.source AS b, abs(a.p - coalesce(b.p, g.z)) - abs(a.z - g.z) AS f
  FROM p a JOIN z g ON a.lang = g.lang AND a.source <> g.source
  LEFT JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source = g.source
  WHERE b.p IS NULL OR a.source < g.source),
pairs AS (SELECT lang, least(a, b) AS source, greatest(a, b) AS item, CAST(sum(f) AS BIGINT) AS value FROM met GROUP BY ALL),
terms AS (SELECT p.lang, source, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
  QUALIFY row_number() OVER (PARTITION BY p.lang, source ORDER BY p - q DESC, p.term) <= {{top}})
SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
"""


def _query(schema: str, sql: str, **tables: pa.Table) -> pa.Table:
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    try:
        for name, held in tables.items():
            con.register(name, held)
        return con.sql(sql).to_arrow_table().cast(_types(schema))
    finally:
        con.close()


def _count_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted() -> Iterator[pa.RecordBatch]:
        texts = pa.Table.from_batches(held)
        yield from _query(COUNTS, COUNT_SQL, texts=texts.append_column("row", pa.array(range(texts.num_rows), pa.int64()))).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        at = 0
        while at < batch.num_rows:  # as many rows as fit into a slice, one at least
            ends, stop = batch.column("ends"), at + 1
            size += ends[at].as_py()
            while stop < batch.num_rows and size + (more := ends[stop].as_py()) <= SLICE_BYTES:
                size, stop = size + more, stop + 1
            held.append(batch.slice(at, stop - at).select(["lang", "source", "text"]))
            at = stop
            if size >= SLICE_BYTES or at < batch.num_rows:
                yield from counted()
                held, size = [], 0
    if held:
        yield from counted()


def source_divergence(df: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks a group's distances to the other sources of its
    language, part ``term`` its ``top`` terms above the language's share."""
    scratch = Scratch(df.sparkSession, "divergence")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    texts = require(df, text_col, lang_col, source_col).select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    counted = texts.withColumn("ends", F.octet_length("text").cast("long")).mapInArrow(_count_texts, COUNTS)
    counts = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")

    # terms that enough documents of a language hold
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    shard = lambda n: F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int").alias("shard")
    keep_sql = KEEP_SQL.format(least=int(least_docs))
    keep = lambda key, held: _query(KEPT, keep_sql, counts=held)
    kept = scratch.save(counts.select("*", shard(shards)).groupBy("shard").applyInArrow(keep, KEPT), "kept")
    scratch.drop("counts")

    # totals of groups and of languages
    by_lang = kept.where("source IS NULL").groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    totals = kept.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = scratch.save(totals.join(by_lang, "lang", "left").select("lang", "source", "total", F.coalesce("lang_total", none).alias("lang_total"), F.coalesce("v", none).alias("v")), "groups")

    # partial sums and top terms, shard by shard
    rows = kept.where("term IS NOT NULL")
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    n_rows = rows.count()
    shards = max(1, -(-n_rows // SHARD_ROWS), -(-n_rows * widest // SHARD_WORK))
    part_sql = PART_SQL.format(top=int(top))
    part = lambda key, held, known: _query(PARTS, part_sql, counts=held, groups=known)
    dealt = rows.select("*", shard(shards)).groupBy("shard")
    known = groups.where("v > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).groupBy("shard")
    parts = scratch.save(dealt.cogroup(known).applyInArrow(part, PARTS), "parts")

    # all pairs of sources, with the difference of the shares of terms that neither holds
    z = F.when(F.col("v") > 0, F.expr(f"1L + {SCALE * SMOOTH}L div (total + {SMOOTH}L * v)")).otherwise(none)
    held = groups.select("lang", "source", "v", z.alias("z"))
    others = held.select("lang", F.col("source").alias("item"), F.col("z").alias("z_"))
    base = held.join(others, "lang").where(F.col("source") < F.col("item")).select("lang", "source", "item", (F.col("v") * F.abs(F.col("z") - F.col("z_"))).alias("value"))
    summed = base.unionByName(parts.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("item").alias("item")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    pairs = summed.select("lang", "value", sides.alias("s")).select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))
    return ranked(pairs).unionByName(ranked(parts.where("part = 'term'")).where(F.col("rank") <= top))
