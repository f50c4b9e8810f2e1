"""The registered queries on the small tables, against DuckDB, the tokenizer library, NumPy and an HTML parser."""

import hashlib
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from lexispan.llm.packing import cut

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.fixture(scope="module")
def texts(db):
    return {k: t or "" for k, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def run(spark, name):
    return entry.queries()[name](spark, SF)


@pytest.mark.parametrize("name", ["op1_merkle_fixity", "op2_ngram_jaccard", "op6_deep_shallow", "op11_spelling_variants", "op12_source_divergence", "op13_license_diagonals"])
def test_against_their_sql(spark, db, name):
    df = run(spark, name)
    got = Counter(tuple(r) for r in df.collect())
    assert got == Counter(db.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({entry.oracle_sql()[name]})").fetchall())


def test_neighbours(spark, db):
    rows = db.execute("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id").fetchall()
    rows = [(k, np.array(v, dtype=np.float64)) for k, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([k for k, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in run(spark, "op3_kmeans_tree").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {int(k) for k in ids if k % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        score = x @ x[ids == q][0]
        want = sorted((-s, k) for k, s in zip(ids.tolist(), score) if k != q)[:20]
        assert [r for r, *_ in found] == list(range(1, len(want) + 1)) and [(-s, k) for _, k, s in found] == sorted((-s, k) for _, k, s in found)
        assert all(abs(s - score[ids == k][0]) < 1e-9 and k != q for _, k, s in found)
        hits += len({k for _, k, _ in found} & {k for _, k in want})
    assert hits >= 0.9 * 20 * len(got)


BASE_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM w WHERE len(w) >= 5),
again AS (SELECT doc_id, i FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, array_to_string(w[i + 1:i + 5], ' ')) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(5) AS r(k) GROUP BY doc_id),
counted AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
  coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
"""


def test_quality_base(spark, db):
    got = run(spark, "op4_robust_outliers").collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(tuple(r[c] for c in columns) for r in got) == Counter(db.execute(f"SELECT {', '.join(columns)} FROM ({BASE_SQL})").fetchall())
    assert not any(r["kept"] and r["base_failed"] for r in got) and all(r["kept"] == (not r["base_failed"] and r["distance"] <= 30.856) for r in got)


def test_tokens_and_packing(spark, texts, library):
    ids = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {tuple(r) for r in run(spark, "op5_token_counts").collect()} == {(k, len(texts[k].encode()), len(v), len(v) > 1024) for k, v in ids.items()}
    assert {tuple(r) for r in run(spark, "op10_bpe_round_trip").collect()} == {(k, len(v), sha(",".join(map(str, v))), sha(library.decode(v, skip_special_tokens=False))) for k, v in ids.items()}
    packed = run(spark, "op9_best_fit_packing").collect()
    want = {(k, n, s, size, zlib.crc32(np.array([*v, 0], dtype="<u4")[s : s + size].tobytes())) for k, v in ids.items() for n, (s, size) in enumerate(cut(len(v) + 1, 2048))}
    assert {tuple(r)[:5] for r in packed} == want and len(packed) == len(want)
    bins = {}
    for r in packed:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= 2048
    assert len(bins) <= sum(r["length"] for r in packed) / 2048 + 2


RULES_SQL = r"""
WITH split AS (SELECT page_id, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
rules (rule, name, start, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block'))
SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
FROM split LEFT JOIN rules ON (host = name OR host LIKE '%.' || name) AND starts_with(path, start) GROUP BY page_id, host, path
"""


def test_url_rules(spark, db):
    got = {r["page_id"]: r for r in run(spark, "op7_url_filter").collect()}
    want = db.execute(f"SELECT * FROM ({RULES_SQL})").fetchall()
    assert len(got) == len(want)
    for page, host, path, rule, verdict in want:
        r = got[page]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or ("block" if r["block_probability"] > 0.5 else "allow"))


class ArticleParser(HTMLParser):
    """The blocks of the article of a page of the test tables."""

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.parts = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article" or self.depth > 0 and tag == "div"
        self.skip += tag in ("script", "style") or bool({"ad", "comments"} & set((dict(attrs).get("class") or "").split()))
        if tag in ("p", "h1", "h2", "h3", "div", "li", "br"):
            self.parts.append("\0")

    def handle_endtag(self, tag):
        self.depth -= tag == "article" or self.depth > 1 and tag == "div"
        self.skip -= self.skip > 0 and tag in ("script", "style", "div")
        if tag in ("p", "h1", "h2", "h3", "div", "li"):
            self.parts.append("\0")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.parts.append(data)


def test_page_texts(spark, db):
    got = {r["page_id"]: r["text"] for r in run(spark, "op8_html_text").collect()}
    for page, html in db.execute("SELECT page_id, html FROM pages").fetchall():
        parser = ArticleParser()
        parser.feed(html or "")
        parser.close()
        blocks = [" ".join(b.split()) for b in "".join(parser.parts).split("\0")]
        assert got[page] == " ".join(b for b in blocks if b), page
