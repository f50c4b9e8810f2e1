"""The queries opN_<name> over the corpus tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexispan.llm.common import Scratch, spread, table
from lexispan.llm.divergence import source_divergence
from lexispan.llm.html_text import extract_pages
from lexispan.llm.jaccard import near_duplicates
from lexispan.llm.licenses import scan_licenses
from lexispan.llm.neighbours import nearest_neighbours
from lexispan.llm.packing import pack_documents
from lexispan.llm.quality import robust_quality
from lexispan.llm.spelling import changed_words, spelling_groups
from lexispan.llm.sql import divergence_sql, licenses_sql, spelling_sql
from lexispan.llm.suffixes import remove_repeats
from lexispan.llm.tokens import round_trip_digests, token_counts
from lexispan.llm.urls import judge_urls
from lexispan.llm.warc import audit_digests, warc_record

TOKENIZER = "byte_bpe_50k.json"
ARCHIVE_RECORDS = 1000


def archived(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Digests (archive, offset, length, sha256) of two replicas of the pages as WARC records.

    1000 consecutive ids are an archive. The replica has planted faults: a changed byte where
    id % 97 = 13, records lost where id % 389 = 5. Records are digested where they are read; only
    digests are dealt out to find the offsets.
    """
    body = F.coalesce("html", F.lit(""))
    rotten = F.when((F.col("page_id") % 97 == 13) & (F.length(body) > 0), F.concat(F.lit("~"), F.substring(body, 2, 1 << 30))).otherwise(body)
    record = lambda b: warc_record("response", F.col("url"), F.col("page_id"), b)
    both = pages.select("page_id", "url", F.floor(F.col("page_id") / ARCHIVE_RECORDS).cast("string").alias("archive"), record(body).alias("good"), record(rotten).alias("held"))
    digests = both.select("page_id", "url", "archive", *[f(n) for n in ("good", "held") for f in (lambda n: F.octet_length(n).cast("long").alias(f"{n}_length"), lambda n: F.sha2(F.col(n).cast("binary"), 256).alias(f"{n}_sha256"))])
    by = Window.partitionBy("archive").orderBy("page_id", "url", "good_sha256").rowsBetween(Window.unboundedPreceding, -1)
    placed = digests.withColumn("offset", F.coalesce(F.sum("good_length").over(by), F.lit(0)))
    placed = Scratch(pages.sparkSession, "archived").save(placed.where("archive is not null"), "placed")
    side = lambda n: ("archive", "offset", F.col(f"{n}_length").alias("length"), F.col(f"{n}_sha256").alias("sha256"))
    return placed.select(*side("good")), placed.where("page_id % 389 <> 5").select(*side("held"))


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_digests(*archived(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


def op3_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op4_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    judged = robust_quality(docs, payload=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER), limit=1024)


def op6_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(table(spark, sf_dir, "documents")))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spread(table(spark, sf_dir, "pages").select("page_id", "url")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(spread(table(spark, sf_dir, "documents")), public_tokenizers.path(TOKENIZER))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(changed_words(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spread(table(spark, sf_dir, "documents").select("text", "lang", "source")))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and name[2:].split("_")[0].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


FIXITY_SQL = f"""
WITH sized AS (
  SELECT page_id, url, coalesce(html, '') AS body, CAST(page_id // {ARCHIVE_RECORDS} AS VARCHAR) AS archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10) || 'Content-Length: ' AS head
  FROM pages),
whole AS (
  SELECT *, head || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10) AS good,
    CASE WHEN page_id % 97 = 13 AND length(body) > 0 THEN '~' || substr(body, 2) ELSE body END AS body_b FROM sized),
placed AS (
  SELECT *, head || strlen(body_b) || chr(13) || chr(10) || chr(13) || chr(10) || body_b || chr(13) || chr(10) || chr(13) || chr(10) AS held,
    coalesce(sum(strlen(good)) OVER (PARTITION BY archive ORDER BY page_id, url, sha256(good) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM whole)
SELECT archive, CAST(place AS BIGINT) AS "offset", CASE WHEN page_id % 389 = 5 THEN 'missing' ELSE 'corrupt' END AS status,
  CAST(strlen(good) AS BIGINT) AS primary_length, CASE WHEN page_id % 389 = 5 THEN NULL ELSE CAST(strlen(held) AS BIGINT) END AS replica_length,
  sha256(good) AS primary_sha256, CASE WHEN page_id % 389 = 5 THEN NULL ELSE sha256(held) END AS replica_sha256
FROM placed WHERE page_id % 389 = 5 OR held <> good
"""


# Sets of shingles, pairs by their common shingles, and the closure of the links.
JACCARD_SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END))) AS i FROM texts),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN sizes USING (doc_id)
"""
# Bytes are pairs of hexadecimal digits here; windows are grouped by two hashes.
REPEATS_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(length(h) // 2 - 399)) AS s FROM texts WHERE length(h) >= 800),
windows AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 800)) AS x, hash(substr(h, 2 * s + 201, 600)) AS y FROM starts),
repeated AS (SELECT doc_id, s FROM windows QUALIFY count(*) OVER (PARTITION BY x, y) > 1),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER d <= 400 THEN 0 ELSE 1 END AS fresh FROM repeated WINDOW d AS (PARTITION BY doc_id ORDER BY s)),
numbered AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
spans AS (SELECT doc_id, run, min(s) AS a, max(s) + 400 AS z FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_merkle_fixity": FIXITY_SQL, "op2_ngram_jaccard": JACCARD_SQL, "op6_deep_shallow": REPEATS_SQL, "op11_spelling_variants": spelling_sql(), "op12_source_divergence": divergence_sql(), "op13_license_diagonals": licenses_sql()}
